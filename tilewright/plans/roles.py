"""How the driver tables stand in for the domain tables, as DataFrames and as SQL common table expressions.

``cells``        embeddings: one cell per vector, position from the first two components, sample from the label (a third of
                 all cells are moved to S0), prototype and cell type from the largest of five components, unevenly
``tiles``        cells averaged over a square grid per sample; expression in long form
``measures``     lineitem with its order, customer and part: unit, gene, value, weight, sample, layer
``patients``     orders with their customer: follow-up time, event, risk and group
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import load

CELL_TYPES = ["Connective", "Neoplastic", "Dead", "Epithelial", "Inflammatory"]
SCALE = 1000.0
TILE = 50.0
GENES = 64  # every vector component is a gene of a tile
PROTO_BIAS = [0.1, 0.04, 0.0, -0.02, -0.06]
TYPE_BIAS = [0.06, 0.03, 0.0, 0.0, -0.03]


def _largest(first: int, bias: list[float]):
    """Place (from 0) of the largest of five vector components, each raised by its bias."""
    five = F.transform(F.slice("embedding", first, 5), lambda x, i: x.cast("double") + F.array(*map(F.lit, bias))[i])
    return (F.array_position(five, F.array_max(five)) - 1).cast("int")


def _largest_sql(first: int, bias: list[float]) -> str:
    five = "[" + ", ".join(f"embedding[{first + i}]::double + {b}::double" for i, b in enumerate(bias)) + "]"
    return f"(list_position({five}, list_max({five})) - 1)::int"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in CELL_TYPES])
    e = load(spark, sf, "embeddings")
    sample = F.when(F.col("vec_id") % 3 == 0, 0).otherwise(F.col("label"))
    return e.select(
        F.concat(F.lit("S"), sample.cast("string")).alias("sample_name"),
        F.col("vec_id").alias("node_idx"),
        F.concat(F.lit("C"), (sample % 3).cast("string")).alias("cohort"),
        (sample % 2).cast("int").alias("label"),
        (F.col("embedding")[0].cast("double") * SCALE).alias("pos_x"),
        (F.col("embedding")[1].cast("double") * SCALE).alias("pos_y"),
        _largest(4, PROTO_BIAS).alias("prototype_id"),
        types[_largest(9, TYPE_BIAS)].alias("cell_type"),
        F.col("embedding")[2].cast("double").alias("score"),
        "embedding",
    )


CELLS = f"""cells as (
  select 'S' || s as sample_name, vec_id as node_idx, 'C' || (s % 3) as cohort, (s % 2)::int as label,
    embedding[1]::double * 1000.0::double as pos_x, embedding[2]::double * 1000.0::double as pos_y,
    {_largest_sql(4, PROTO_BIAS)} as prototype_id,
    ({CELL_TYPES})[{_largest_sql(9, TYPE_BIAS)} + 1] as cell_type,
    embedding[3]::double as score, embedding
  from (select *, case when vec_id % 3 = 0 then 0 else label end as s from embeddings))"""


def knn_sql(k: int, by_sample: bool = True, name: str = "knn") -> str:
    """Brute-force pairs for the SQL side."""
    group = "a.sample_name = b.sample_name and " if by_sample else ""
    part = "a.sample_name, " if by_sample else ""
    return f"""{name} as (
  select sample_name, src, dst, rank, dist from (
    select a.sample_name, a.node_idx as src, b.node_idx as dst,
      sqrt((a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y)) as dist,
      row_number() over (partition by {part}a.node_idx
        order by (a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y), b.node_idx) as rank
    from cells a join cells b on {group}a.node_idx <> b.node_idx) where rank <= {k})"""


def tile_expr(spark: SparkSession, sf: str) -> DataFrame:
    """Long tile expression (sample_name, tile_x, tile_y, gene, value): mean of the cells in each square."""
    c = cells(spark, sf)
    return (
        c.select(
            "sample_name",
            (F.floor(F.col("pos_x") / TILE) * TILE).alias("tile_x"),
            (F.floor(F.col("pos_y") / TILE) * TILE).alias("tile_y"),
            F.posexplode(F.slice("embedding", 1, GENES)).alias("g", "v"),
        )
        .groupBy("sample_name", "tile_x", "tile_y", F.concat(F.lit("G"), F.col("g").cast("string")).alias("gene"))
        .agg(F.avg(F.col("v").cast("double")).alias("value"))
    )


TILE_EXPR = f"""tile_expr as (
  select sample_name, floor(pos_x / {TILE}) * {TILE}::double as tile_x, floor(pos_y / {TILE}) * {TILE}::double as tile_y,
    'G' || (i - 1) as gene, avg(v::double) as value
  from (select sample_name, pos_x, pos_y, unnest(embedding[1:{GENES}]) as v,
          generate_subscripts(embedding[1:{GENES}], 1) as i from cells)
  group by all)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tile centres with an id that is stable per position."""
    return (
        cells(spark, sf)
        .select(
            "sample_name",
            (F.floor(F.col("pos_x") / TILE) * TILE).alias("tile_x"),
            (F.floor(F.col("pos_y") / TILE) * TILE).alias("tile_y"),
        )
        .distinct()
        .withColumn(
            "tile_id", F.format_string("%d_%d", F.col("tile_x").cast("long"), F.col("tile_y").cast("long"))
        )
        .withColumns({"pos_x": F.col("tile_x") + TILE / 2, "pos_y": F.col("tile_y") + TILE / 2})
    )


TILES = f"""tiles as (
  select distinct sample_name, tile_x, tile_y, tile_x::bigint || '_' || tile_y::bigint as tile_id,
    tile_x + {TILE / 2}::double as pos_x, tile_y + {TILE / 2}::double as pos_y
  from (select sample_name, floor(pos_x / {TILE}) * {TILE}::double as tile_x,
          floor(pos_y / {TILE}) * {TILE}::double as tile_y from cells))"""

RADIUS = 2.5 * TILE

EDGES = f"""edges as (
  select a.sample_name, a.node_idx as src, b.tile_id as dst,
    sqrt((a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y)) as dist
  from cells a join tiles b on a.sample_name = b.sample_name
  where (a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y) <= {RADIUS * RADIUS}::double),
weighted as (
  select *, case when max(dist) over w > min(dist) over w
    then 1 - (dist - min(dist) over w) / (max(dist) over w - min(dist) over w) else 1.0::double end as weight
  from edges window w as (partition by sample_name))"""


def measures(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c, p = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "part"))
    return (
        li.join(p.select("p_partkey", "p_brand", "p_type"), li.l_partkey == p.p_partkey)
        .join(
            o.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), o.o_custkey == c.c_custkey).select(
                "o_orderkey", "c_nationkey", "c_mktsegment"
            ),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .select(
            F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("sample_name"),
            (F.col("c_nationkey") % 2).cast("int").alias("label"),
            F.concat(F.lit("C"), (F.col("c_nationkey") % 3).cast("string")).alias("cohort"),
            F.col("l_orderkey").alias("unit"),
            F.col("l_linenumber").alias("line"),
            F.upper(F.regexp_replace("p_brand", "#", "")).alias("gene"),
            F.col("p_type").alias("pathway"),
            F.col("l_quantity").alias("value"),
            (1 - F.col("l_discount")).alias("weight"),
            (F.col("l_linenumber") % 5).cast("int").alias("prototype_id"),
            F.when(F.col("l_returnflag") == "A", "core")
            .when(F.col("l_returnflag") == "R", "interface")
            .otherwise("edge")
            .alias("layer"),
            F.col("c_mktsegment").alias("cell_type"),
        )
    )


MEASURES = """measures as (
  select 'N' || lpad(c_nationkey::varchar, 2, '0') as sample_name, (c_nationkey % 2)::int as label,
    'C' || (c_nationkey % 3) as cohort, l_orderkey as unit, l_linenumber as line,
    upper(replace(p_brand, '#', '')) as gene, p_type as pathway, l_quantity as value, 1 - l_discount as weight,
    (l_linenumber % 5)::int as prototype_id,
    case l_returnflag when 'A' then 'core' when 'R' then 'interface' else 'edge' end as layer,
    c_mktsegment as cell_type
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey)"""


def patients(spark: SparkSession, sf: str) -> DataFrame:
    """Survival table: days from the order to the last order day, event by status, risk by price."""
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    last = o.agg(F.max("o_orderdate")).scalar()
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("patient"),
        F.col("c_mktsegment").alias("arm"),
        F.datediff(last, "o_orderdate").cast("double").alias("t"),
        (F.col("o_orderstatus") == "F").cast("int").alias("e"),
        (F.col("o_totalprice") / 100000.0).alias("risk"),
    )


PATIENTS = """patients as (
  select o_orderkey as patient, c_mktsegment as arm,
    date_diff('day', o_orderdate::date, (select max(o_orderdate)::date from orders))::double as t,
    (o_orderstatus = 'F')::int as e, o_totalprice / 100000.0::double as risk
  from orders join customer on o_custkey = c_custkey)"""


_staged: dict[tuple, str] = {}


def staged(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A table several queries share, written once per application into the shared work folder."""
    from tilewright.session import new_path

    at = (spark.sparkContext.applicationId, *key)
    if at not in _staged:
        path = new_path(spark, "stage")
        build().write.parquet(path)
        _staged[at] = path
    return spark.read.parquet(_staged[at])


def knn(spark: SparkSession, sf: str, k: int, by_sample: bool = True) -> DataFrame:
    """Neighbour pairs of ``cells``; ecology, density and transition queries all start from them."""
    from tilewright.operators.neighbors import knn_join

    groups = ["sample_name"] if by_sample else []
    return staged(spark, ("knn", sf, k, by_sample), lambda: knn_join(cells(spark, sf), k, groups))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Cell to tile edges within the radius with inverse-distance weights per sample."""
    from tilewright.operators.neighbors import within_radius
    from tilewright.operators.ordered import group_minmax

    raw = within_radius(cells(spark, sf), tiles(spark, sf), RADIUS, ["sample_name"], right_id="tile_id")
    return group_minmax(raw, ["sample_name"], "dist", "weight", 1.0, invert=True)


CENTERS = """centers as (
  select k, list(m order by i) as vec from (
    select label::int as k, i, avg(v::double) as m from (
      select label % 5 as label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)
    group by label, i) group by k)"""


def centers(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators.prototypes import mean_vectors

    e = load(spark, sf, "embeddings").withColumn("label", (F.col("label") % 5).cast("int"))
    return mean_vectors(e, "label", "embedding", 64)


_N = "sqrt(list_sum(list_transform({v}, lambda x: x::double * x::double)))"
_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"

SOFT = f"""sims as (
  select sample_name, node_idx, label, cohort, k,
    {_D.format(a='embedding', b='vec')} / (({_N.format(v='embedding')} + 1e-8) * ({_N.format(v='vec')} + 1e-8)) as cosine
  from cells, centers),
ex as (select *, exp(cosine / 0.3) as e from sims),
soft as (select *, e / (sum(e) over w + 1e-8) as p, row_number() over (partition by node_idx order by e desc, k) as rk
  from ex window w as (partition by node_idx))"""
