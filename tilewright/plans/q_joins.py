"""Queries: lookups, filters, set operations, sampling."""

from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.operators import ecology as E
from tilewright.operators import lookup as L
from tilewright.operators import ordered as O
from tilewright.operators import sampling as X
from tilewright.plans.tail_sql import PLACES
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, EDGES, MEASURES, PATIENTS, TILES, cells, edges, measures, patients, tiles
from tilewright.session import load


@query("J1 J16", "select l_orderkey::int as Label, o_orderpriority as type, round(sum(l_quantity), 2) as area from orders join lineitem on l_orderkey = o_orderkey group by all")
def typed_feature_join(spark, sf):
    types = load(spark, sf, "orders").select(F.col("o_orderkey").alias("Label"), F.col("o_orderpriority").alias("type"))
    feats = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("Label")).agg(F.round(F.sum("l_quantity"), 2).alias("area"))
    return L.typed_features(types, feats)


_SAMPLES = """smp as (select o_orderkey, case when o_orderkey % 3 = 0 then 'S' || o_custkey when o_orderkey % 3 = 1 then lpad(o_custkey::varchar, 6, '0') || '_' || o_orderkey else 'X' || o_orderkey end as sample_name from orders),
    lab as (select case when c_custkey % 2 = 0 then 'S' || c_custkey when c_custkey < 10 then lpad(c_custkey::varchar, 3, '0') else c_custkey::varchar end as patient_id, (c_nationkey % 2)::int as label from customer)"""


def _samples(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    name = (
        F.when(k == 0, F.concat(F.lit("S"), "o_custkey"))
        .when(k == 1, F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("_"), "o_orderkey"))
        .otherwise(F.concat(F.lit("X"), "o_orderkey"))
    )
    c = load(spark, sf, "customer")
    pid = (
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("S"), "c_custkey"))
        .when(F.col("c_custkey") < 10, F.lpad(F.col("c_custkey").cast("string"), 3, "0"))
        .otherwise(F.col("c_custkey").cast("string"))
    )
    return o.select("o_orderkey", name.alias("sample_name")), c.select(pid.alias("patient_id"), (F.col("c_nationkey") % 2).cast("int").alias("label"))


_LABELLED = f"""with {_SAMPLES}, t as (select distinct sample_name, case when regexp_replace(split_part(sample_name, '_', 1), '^0+', '') = '' then '0' else regexp_replace(split_part(sample_name, '_', 1), '^0+', '') end as tok from smp),
    m as (select t.sample_name, coalesce(a.label, b.label, c.label, -1) as label from t left join lab a on a.patient_id = t.sample_name left join lab b on b.patient_id = tok left join lab c on c.patient_id = case when length(tok) < 3 then lpad(tok, 3, '0') else tok end)"""


@query("J2 F1 F2", f"{_LABELLED} select sample_name, label from m")
def label_attachment(spark, sf):
    s, labels = _samples(spark, sf)
    return L.attach_labels(s.select("sample_name").distinct(), labels)


@query("P2", f"{_LABELLED} select label, count(*) as n from m where label >= 0 group by label")
def labelled_only(spark, sf):
    s, labels = _samples(spark, sf)
    return L.labelled(L.attach_labels(s.select("sample_name").distinct(), labels)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("P1 U6", f"with {CELLS} select sample_name, count(*) as n from cells where lower(cohort) in ('c0', 'c2') group by 1")
def cohort_allow_list(spark, sf):
    c = cells(spark, sf)
    kept = L.allowed_cohorts(c, [" C0", "c 2"])
    return L.same_samples(c, kept).groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"))


@query("J3 P17 D12", """select p_partkey % 30 as i, coalesce(case when n_nationkey is not null then 'GENE_' || n_name end, (p_partkey % 30)::varchar) as gene, count(*) as n
    from part left join nation on n_nationkey = p_partkey % 30 group by all""")
def ordinal_gene_names(spark, sf):
    s = load(spark, sf, "part").select((F.col("p_partkey") % 30).alias("i"), (F.col("p_partkey") % 30).cast("string").alias("gene"))
    genes = load(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("GENE_"), "n_name").alias("symbol"))
    return L.named_signature(s, genes).groupBy("i", "gene").agg(F.count(F.lit(1)).alias("n"))


_BOX = "bx as (select sample_name, node_idx as poly_id, pos_x as x0, pos_x + 20 + abs(score) * 100 as x1, pos_y as y0, pos_y + 15 as y1 from cells)"


@query("J12 O8", f"""with {CELLS}, {_BOX}, a as (select *, unnest(range(floor(x0 / 50)::bigint, floor(x1 / 50)::bigint + 1)) as tx from bx), b as (select *, unnest(range(floor(y0 / 50)::bigint, floor(y1 / 50)::bigint + 1)) as ty from a)
    select sample_name, poly_id, tx, ty, round((least(x1, (tx + 1) * 50) - greatest(x0, tx * 50)) * (least(y1, (ty + 1) * 50) - greatest(y0, ty * 50)) / ((x1 - x0) * (y1 - y0)), 6) as share from b""")
def boxes_on_tiles(spark, sf):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("pos_x"), F.col("pos_y")
    w = F.lit(20) + F.abs("score") * 100
    p = cells(spark, sf).select("sample_name", F.col("node_idx").alias("poly_id"), F.array(point(x, y), point(x + w, y), point(x + w, y + 15)).alias("ring"))
    b = L.bounding_boxes(p).withColumn("x1", F.col("x1")).withColumn("y1", F.col("y1"))
    return L.boxes_on_tiles(b, 50).withColumns(r6("share"))


@query("F43", f"""with {CELLS}, e as (select sample_name, ceil(max(pos_x) - min(pos_x))::int as width, ceil(max(pos_y) - min(pos_y))::int as height from cells group by 1), a as (select *, unnest(range(0, width, 96)) as ox from e)
    select sample_name, ox::int as ox, unnest(range(0, height, 96))::int as oy from a""")
def tile_grid(spark, sf):
    size = lambda c: F.ceil(F.max(c) - F.min(c)).cast("int")
    e = cells(spark, sf).groupBy("sample_name").agg(size("pos_x").alias("width"), size("pos_y").alias("height"))
    return L.tile_grid(e, 128, 32)


@query("F44", f"""with {CELLS}, l as (select sample_name, unnest(range(0, 5))::int as level, count(*) * 100 as base from cells group by 1),
    s as (select sample_name, level, floor(base / pow(2, level)) as w from l) select sample_name, coalesce(min(level) filter (w * w <= 2000000), max(level)) as level from s group by 1""")
def mask_level(spark, sf):
    l = cells(spark, sf).groupBy("sample_name").agg((F.count(F.lit(1)) * 100).alias("base")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4))))
    w = F.floor(F.col("base") / F.pow(F.lit(2.0), F.col("level")))
    return L.level_under_budget(l.withColumn("width", w).withColumn("height", w), 2_000_000)


@query("P13", f"""with {CELLS} select sample_name, floor(pos_x / 100)::bigint as tx, floor(pos_y / 100)::bigint as ty, round(avg((prototype_id <= 2)::int), 6) as coverage from cells group by 1, 2, 3 having avg((prototype_id <= 2)::int) >= 0.7""")
def tissue_tiles(spark, sf):
    c = cells(spark, sf).withColumn("tissue", F.col("prototype_id") <= 2)
    return L.tissue_tiles(c, 100, 0.7, "tissue").withColumns(r6("coverage"))


@query("J17 U7", f"""with {CELLS} select node_idx, round(case when prototype_id = 2 then score + 1 else score end, 6) as P0 from cells""")
def probability_backfill(spark, sf):
    c = cells(spark, sf)
    gaps = c.select("node_idx", F.when(F.col("prototype_id") != 2, F.col("score")).alias("P0"))
    other = c.select("node_idx", (F.col("score") + 1).alias("P0"))
    return L.backfill(gaps, other, ["cell_id", "node_idx"], ["P0"]).select("node_idx", F.round("P0", 6).alias("P0"))


@query("U7", """select coalesce(a.p_brand, b.p_brand) as p_brand, round(coalesce(a.v, b.v), 6) as v from (select p_brand, avg(p_retailprice) as v from part where p_size > 25 group by 1 having p_brand <> 'Brand#3') a
    full join (select p_brand, avg(p_size) as v from part group by 1) b on a.p_brand = b.p_brand""")
def combine_first(spark, sf):
    p = load(spark, sf, "part")
    a = p.where("p_size > 25 and p_brand <> 'Brand#3'").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    b = p.groupBy("p_brand").agg(F.avg("p_size").alias("v"))
    return L.combine_first(a, b, ["p_brand"]).withColumns(r6("v"))


@query("J22 F4", """select o_orderpriority as cohort, case when o_orderpriority = '4-NOT SPECIFIED' then 'r_spec' when o_orderpriority = '1-URGENT' then 'r_urgent' end as root, count(*) as n from orders group by all""")
def cohort_containment(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("cohort"))
    names = o.distinct().where("cohort in ('4-NOT SPECIFIED', '1-URGENT')")
    roots = names.select(
        F.when(F.col("cohort") == "1-URGENT", " urgent ").otherwise("Not  Spec").alias("name"),
        F.when(F.col("cohort") == "1-URGENT", "r_urgent").otherwise("r_spec").alias("root"),
    )
    return L.match_cohort(o, roots).groupBy("cohort", "root").agg(F.count(F.lit(1)).alias("n"))


@query("U1 U3", "select distinct k from (select c_nationkey as k from customer union all select s_nationkey from supplier)")
def union_and_distinct(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).dropDuplicates()


@query("U2", "select c_nationkey as k, round(c_acctbal, 2) as bal, null::varchar as name, 'customer' as src from customer union all select s_nationkey, null, s_name, 'supplier' from supplier")
def union_with_missing_columns(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.round("c_acctbal", 2).alias("bal"), F.lit("customer").alias("src"))
    b = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("src"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U6 J14 J16", "select distinct c_nationkey as k from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000)")
def id_intersection(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(load(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("U5 J15", "select distinct p_name as gene from part where p_size <= 10 and p_name not in (select p_name from part where p_retailprice > 1800)")
def gene_set_difference(spark, sf):
    p = load(spark, sf, "part").withColumnRenamed("p_name", "gene")
    return p.where("p_size <= 10").select("gene").distinct().join(p.where("p_retailprice > 1800").select("gene"), "gene", "left_anti")


@query("G52", f"with {CELLS}, t as (select c.sample_name, c.node_idx, count(e.src) > 0 as has_edges, prototype_id > 2 as rare from cells c left join (select * from edges) e on e.src = c.node_idx group by all) select has_edges, rare, count(*) as n from t group by all".replace("(select * from edges)", "edges").replace(f"with {CELLS}", f"with {CELLS}, {TILES}, {EDGES}"))
def coverage_counts(spark, sf):
    from tilewright.sources.writers import flag_counts

    e = edges(spark, sf).select("sample_name", F.col("src").alias("node_idx"), F.lit(True).alias("has_edges")).distinct()
    c = cells(spark, sf).join(e, ["sample_name", "node_idx"], "left").withColumn("has_edges", F.coalesce("has_edges", F.lit(False)))
    return flag_counts(c.withColumn("rare", F.col("prototype_id") > 2), ["has_edges", "rare"])


# ---------------------------------------------------------------- sampling and splits

_KEY = "md5('{s}:' || {i})"
_NUM = "('0x' || substr(md5('{s}:' || {i}), 1, 13))::bigint"


@query("X1 L6 L9", f"select o_orderkey from orders order by {_KEY.format(s=42, i='o_orderkey')}, o_orderkey limit 500")
def capped_rows(spark, sf):
    return X.cap_rows(load(spark, sf, "orders").select("o_orderkey"), 500, ["o_orderkey"])


@query("X2 L6", f"select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by {_KEY.format(s=42, i='o_orderkey')}, o_orderkey) as r from orders) where r <= 50")
def capped_per_group(spark, sf):
    return X.cap_per_group(load(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], 50, ["o_orderkey"])


@query("X3", f"""with {CELLS}, {TILES}, {EDGES}, k as (select sample_name, src, dst, md5('42000127:' || src || ':' || dst) as k from edges where ('0x' || substr(md5('42000127:' || src || ':' || dst), 1, 13))::bigint < {int(0.8 * 16**13)})
    select sample_name, src, dst from (select *, row_number() over (partition by sample_name order by k, src, dst) as r from k) where r <= 200""")
def sampled_edges(spark, sf):
    e = edges(spark, sf).select("sample_name", "src", "dst")
    return X.sample_edges(e, 0.8, 200, ["sample_name"], ["src", "dst"], seed=42, epoch=1)


@query("X4", f"""with {PATIENTS}, s as (select arm, e, count(*) as c from patients group by all), t as (select arm, least(100, min(c)) as take from s group by arm having count(*) = 2),
    r as (select arm, e, patient, row_number() over (partition by arm, e order by {_KEY.format(s=42, i='patient')}, patient) as r from patients) select arm, e, patient from r join t using (arm) where take >= 3 and r <= take""")
def equal_subsample(spark, sf):
    return X.equal_subsample(patients(spark, sf).select("arm", "e", "patient"), ["arm"], "e", 100, ["patient"])


_POS = "row_number() over ({p} order by {n}, md5('42:' || {i}), {i})"


@query("X5", f"""with {PATIENTS}, r as (select *, row_number() over (partition by arm, e order by md5('42:' || patient)) as pos, count(*) over (partition by arm, e) as n from patients) select patient, case when pos <= round(n * 0.2::double) then 'test' else 'train' end as split from r""")
def stratified_split(spark, sf):
    return X.stratified_split(patients(spark, sf).select("patient", "arm", "e"), ["arm", "e"], ["patient"]).select("patient", "split")


@query("X6", f"""with s as (select distinct c_nationkey from customer), r as (select *, row_number() over (order by md5('42:' || c_nationkey)) as pos, count(*) over () as n from s)
    select c_custkey, case when pos <= greatest(floor(n * 0.2::double), 1) then 'val' else 'train' end as split from customer join r using (c_nationkey)""")
def split_by_sample(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return X.split_by_sample(c, "c_nationkey").select("c_custkey", "split")


@query("X7", "select c_custkey, ((row_number() over (order by md5('42:' || c_custkey)) - 1) % 5 + 1)::int as fold from customer")
def k_fold_assignment(spark, sf):
    return X.k_folds(load(spark, sf, "customer").select("c_custkey"), 5, ["c_custkey"])


@query("X8", f"""with {PLACES.format(i='c_custkey', t='customer', f=1.0, space=float(16**13))} select round, count(*) as drawn, sum(weight)::bigint as total, sum(weight * c_custkey)::bigint as weighted_ids from dr join pl using (pos) group by round""")
def bootstrap_weights(spark, sf):
    b = X.bootstrap(load(spark, sf, "customer").select("c_custkey"), 50, ["c_custkey"])
    g = b.groupBy(F.col("round").cast("long").alias("round"))
    return g.agg(F.count(F.lit(1)).alias("drawn"), F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("c_custkey")).alias("weighted_ids"))
