"""Folder readers and exports over their own files, and short top-n and reshaping queries."""

from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.operators import ecology as E
from tilewright.operators import neighbors as N
from tilewright.operators import scoring as Sc
from tilewright.plans.q_ecology import _TRANS, transition
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, cells, knn_sql
from tilewright.session import load, new_path
from tilewright.sources import readers as R
from tilewright.sources import writers as W


@query("S7 F7", """select 'N' || s_nationkey as sample, s_suppkey * 16 as x, s_nationkey * 16 as y from supplier where s_suppkey % 10 <> 0""")
def patch_files(spark, sf):
    """One patch file per supplier; every tenth name lacks its coordinates."""
    name = F.when(
        F.col("s_suppkey") % 10 != 0, F.format_string("tile_%d_%d.jpg", F.col("s_suppkey") * 16, F.col("s_nationkey") * 16)
    ).otherwise(F.format_string("tile%d.jpg", F.col("s_suppkey")))
    path = F.concat_ws("/", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), name)
    folder = new_path(spark, "patches")
    W.write_files(load(spark, sf, "supplier").select(path.alias("path"), F.lit(b"\xff\xd8").alias("content")), folder)
    return R.patches(spark, folder).select("sample", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("S22 U1", "select 'P' || (p_size % 3) as pair, p_brand as gene, p_partkey::bigint as k from part where p_size % 4 <> 3")
def tagged_result_union(spark, sf):
    """Result files by name, of which those without the needed column are left out, whatever the order of the columns."""
    rows = load(spark, sf, "part")
    kind = F.col("p_size") % 4  # 0 to 2: columns in turn; 3: a file that lacks one
    line = F.when(kind == 0, F.concat_ws(",", "p_brand", "p_partkey", F.lit("x"))).when(
        kind == 3, F.concat_ws(",", "p_brand", F.lit("x"))
    ).otherwise(F.concat_ws(",", "p_partkey", "p_brand"))
    head = F.when(kind == 0, "gene,k,note").when(kind == 3, "gene,note").otherwise("k,gene")
    name = F.format_string("P%d_DEGs_%d.csv", F.col("p_size") % 3, kind)
    each = rows.select(name.alias("path"), head.alias("head"), line.alias("line"), F.floor(F.col("p_partkey") / 1000).alias("part"))
    body = each.groupBy("path", "part").agg(F.concat(F.min("head"), F.lit("\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("t"))
    folder = new_path(spark, "results")
    place = F.concat(F.lit("batch"), F.col("part").cast("string"), F.lit("/"), F.col("path"))
    W.write_files(body.select(place.alias("path"), F.encode("t", "UTF-8").alias("content")), folder)
    found = R.tagged_results(spark, folder, ["gene", "k"], r"^(P\d+)_DEGs", "pair")
    return found.select("pair", "gene", F.col("k").cast("long").alias("k"))


_SCALED = f"""{CELLS}, {knn_sql(8, False, 'knn_all')}, {_TRANS.format(n='knn_all')},
    s as (select src, dst, (value - (select min(value) from tr)) / ((select max(value) - min(value) from tr) + 1e-9) as value from tr)"""


@query("S33", f"""with {_SCALED} select 'edge' as kind, a.src, a.dst, round((a.value + b.value) / 2, 6) as value
    from s a join s b on a.src = b.dst and a.dst = b.src where a.src < a.dst union all select 'matrix', src, dst, round(value, 6) from s""")
def interaction_exports(spark, sf):
    """Square matrix and edge list, written as CSV and read back."""
    m = E.minmax_matrix(transition(spark, sf))
    folder = new_path(spark, "interaction")
    square = W.write_square_matrix(m, f"{folder}/matrix", range(5)).select(F.lit("matrix").alias("kind"), "src", "dst", "value")
    edges = W.write_csv(E.symmetric_edges(m), f"{folder}/edges", ["src", "dst", "weight"])
    return square.unionByName(edges.select(F.lit("edge").alias("kind"), "src", "dst", F.col("weight").alias("value"))).withColumns(r6("value"))


@query("S17", """select p_partkey % 50 as gene, 'BC' || l_orderkey as barcode, sum(l_quantity) as x from lineitem join part on p_partkey = l_partkey group by all""")
def tenx_directory(spark, sf):
    """Matrix, feature and barcode files of one directory, read back by name."""
    folder = new_path(spark, "tenx")
    part, li = load(spark, sf, "part"), load(spark, sf, "lineitem")
    genes = part.select((F.col("p_partkey") % 50).alias("g")).distinct()
    W.write_files(
        genes.groupBy(F.lit("features.tsv").alias("path")).agg(
            F.encode(F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: F.concat(F.lit("ENS"), g.cast("string"), F.lit("\t"), g.cast("string"))), "\n"), "UTF-8").alias("content")
        ),
        folder,
    )
    cells_ = li.select("l_orderkey").distinct()
    cells_.orderBy("l_orderkey").select(F.concat(F.lit("BC"), F.col("l_orderkey").cast("string"))).write.text(f"{folder}/barcodes.tsv")
    x = li.join(part.select("p_partkey"), F.col("p_partkey") == F.col("l_partkey")).groupBy((F.col("p_partkey") % 50).alias("g"), "l_orderkey").agg(F.sum("l_quantity").alias("x"))
    names = R.numbered_lines(spark, f"{folder}/barcodes.tsv").select(F.col("value").alias("barcode"), (F.col("idx") + 1).alias("c"))
    lines = x.join(names, F.concat(F.lit("BC"), F.col("l_orderkey").cast("string")) == F.col("barcode"))
    order = R.numbered_lines(spark, f"{folder}/features.tsv").select((F.col("idx") + 1).alias("r"), F.split("value", "\t")[1].cast("long").alias("g"))
    lines.join(order, "g").select(F.concat_ws(" ", "r", "c", "x")).write.text(f"{folder}/matrix.mtx")
    return R.tenx(spark, folder).select(F.col("gene").cast("long").alias("gene"), "barcode", "x")


@query("L6", """with l as (select vec_id as cell, unnest(embedding[1:5])::double as s, generate_subscripts(embedding[1:5], 1) - 1 as p from embeddings),
    t as (select cell, max(s) as s from (select *, row_number() over (partition by p order by s desc, cell) as rk from l) where rk <= 20 group by cell)
    select cell, round(s, 6) as score from t order by s desc, cell limit 60""")
def top_cells_per_prototype(spark, sf):
    """The 20 best cells of each of five prototypes, each cell once, 60 in all."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode(F.slice("embedding", 1, 5)).alias("prototype", "s"))
    best = Sc.top_cells(e.withColumn("s", F.col("s").cast("double")), "prototype", "cell", "s", 20, 60)
    return best.select("cell", F.round("s", 6).alias("score"))


@query("L4", f"with {CELLS} select sample_name, count(*) as cells from cells group by 1 order by 2 desc, 1 limit 4")
def largest_samples(spark, sf):
    return Sc.largest_groups(cells(spark, sf), "sample_name", 4, "cells")


@query("P5", f"""with {CELLS}, o as (select sample_name, node_idx, case node_idx % 7 when 0 then null when 1 then 'nan'::double else pos_x end as pos_x, pos_y,
    case when node_idx % 11 = 0 then null else prototype_id end as prototype_id from cells)
    select sample_name, count(*) as n from o where pos_x is not null and not isnan(pos_x) and prototype_id is not null group by 1""")
def placed_cells(spark, sf):
    """Cells that have both coordinates and a prototype."""
    i = F.col("node_idx")
    odd = cells(spark, sf).withColumn("pos_x", F.when(i % 7 == 0, None).when(i % 7 == 1, F.lit(float("nan"))).otherwise(F.col("pos_x")))
    odd = odd.withColumn("prototype_id", F.when(i % 11 == 0, None).otherwise(F.col("prototype_id")))
    return N.placed(odd, "pos_x", "pos_y").na.drop(subset=["prototype_id"]).groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"))


@query("F55", """with w as (select p_brand as gene, avg(p_retailprice) / 1000 - 1.5 as core_vs_edge, avg(p_size) / 25 - 1 as pcr from part group by 1),
    l as (select gene, 'core_vs_edge' as contrast, core_vs_edge as v from w union all select gene, 'edge_vs_core', -core_vs_edge from w union all select gene, 'pcr', pcr from w)
    select gene, contrast, round(v, 6) as log2fc, case when round(v, 6) > 0 then 'up' when round(v, 6) < 0 then 'down' else 'none' end as direction from l""")
def contrasts_in_long_form(spark, sf):
    """Contrasts as rows, the spatial one in both directions."""
    wide = load(spark, sf, "part").groupBy(F.col("p_brand").alias("gene")).agg(
        F.round(F.avg("p_retailprice") / 1000 - 1.5, 6).alias("core_vs_edge"), F.round(F.avg("p_size") / 25 - 1, 6).alias("pcr")
    )
    return T.contrasts_long(wide, ["gene"], ["core_vs_edge", "pcr"]).select("gene", "contrast", "log2fc", "direction")
