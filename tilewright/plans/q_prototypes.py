"""Queries: prototype assignment, composition, merging, hubs, stability."""

from pyspark.sql import functions as F

from tilewright.operators import ecology as E
from tilewright.operators import ordered as O
from tilewright.operators import prototypes as P
from tilewright.operators import sampling as X
from tilewright.plans import tail_sql as Q
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import _N, CELL_TYPES, CELLS, CENTERS, MEASURES, SOFT, cells, centers, knn, knn_sql, measures
from tilewright.session import load

_BASE = f"with {CELLS}, {CENTERS}, {SOFT}"


def assigned(spark, sf, tau=0.3):
    return P.assign(cells(spark, sf), centers(spark, sf), tau)


@query("A1 F25 F26 F28 D14", f"""{_BASE}, h as (select node_idx, 1 + sum(p * ln(p + 1e-12)) / ln(5) as confidence from soft group by node_idx)
    select s.node_idx, s.k as prototype, round(p, 6) as top_prob, round(confidence, 6) as confidence from soft s join h using (node_idx) where rk = 1""")
def prototype_assignment(spark, sf):
    a = assigned(spark, sf)
    return a.select("node_idx", "prototype", F.round(F.array_max("soft_prob"), 6).alias("top_prob"), F.round("confidence", 6).alias("confidence"))


@query("A1 G1 G2", f"""{_BASE}, h as (select node_idx, 1 + sum(p * ln(p + 1e-12)) / ln(5) as confidence from soft group by node_idx),
    a as (select s.sample_name, s.k as prototype, confidence from soft s join h using (node_idx) where rk = 1)
    select sample_name, prototype, count(*) as n, round(avg(confidence), 6) as mean_confidence, round(count(*) / sum(count(*)) over (partition by sample_name), 6) as share
    from a group by sample_name, prototype""")
def prototype_composition(spark, sf):
    a = assigned(spark, sf)
    c = a.groupBy("sample_name", "prototype").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
    return P.shares(c, ["sample_name"]).withColumns(r6("mean_confidence", "share"))


@query("A2", f"""{_BASE} select node_idx, k as prototype, round(cosine, 6) as cosine from soft where rk = 1""")
def hard_assignment(spark, sf):
    return P.assign_hard(cells(spark, sf), centers(spark, sf)).select("node_idx", "prototype", F.round("cosine", 6).alias("cosine"))


@query("J19 L10", f"""{_BASE} select node_idx, k as prompt, round(cosine, 6) as similarity, rk::int as rank from soft where rk <= 3""")
def ranked_retrieval(spark, sf):
    return P.retrieve(cells(spark, sf).select("node_idx", "embedding"), centers(spark, sf), top=3).drop("embedding").withColumns(r6("similarity"))


@query("F57", f"""with u as (select label, i, avg(v / n) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i,
      sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-8 as n from embeddings) group by label, i),
    l as (select label, sqrt(sum(m * m)) + 1e-8 as l from u group by label)
    select label as k, (i - 1)::int as pos, round(m / l, 6) as v from u join l using (label)""")
def class_vectors(spark, sf):
    v = P.class_vectors(load(spark, sf, "embeddings"), "label", "embedding", 64)
    return v.select("k", F.posexplode("vec").alias("pos", "v")).withColumns(r6("v"))


@query("F29 G46", f"""with {CELLS}, {CENTERS}, u as (select node_idx, k, sqrt(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: x::double / ne), list_transform(vec, lambda x: x / nc)), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d
      from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as ne from cells), (select *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) as nc from centers)),
    q as (select node_idx, k, exp(-d / 0.4) / sum(exp(-d / 0.4)) over (partition by node_idx) as q from u), t as (select max(q) as top from q group by node_idx)
    select k, round(avg(q), 6) as mean_assignment, (select round(avg(top), 6) from t) as max_mean, (select round(median(top), 6) from t) as max_median,
      (select round(quantile_cont(top, 0.9), 6) from t) as max_p90 from q group by k""")
def assignment_usage(spark, sf):
    return P.usage(cells(spark, sf), centers(spark, sf), 0.4).withColumns(r6("mean_assignment", "max_mean", "max_median", "max_p90"))


@query("G2 P24 G51", f"""with {CELLS} select sample_name, {', '.join(f'round(count(*) filter (prototype_id = {k}) / count(*), 6) as global_P{k}' for k in range(5))}, 0.0::double as global_P9
    from cells group by sample_name""")
def composition_per_sample(spark, sf):
    w = P.composition_wide(cells(spark, sf), ["sample_name"], "prototype_id", range(5), "global_P")
    names = [f"global_P{k}" for k in range(5)]
    return P.ensure_columns(w, ["sample_name"], [*names, "global_P9"]).withColumns(r6(*names))


@query("G3", f"""with {CELLS} select cohort, label, {', '.join(f'round(count(*) filter (prototype_id = {k}) / count(*), 6) as Proto_{k}' for k in range(5))} from cells group by cohort, label""")
def composition_by_label(spark, sf):
    w = P.composition_wide(cells(spark, sf), ["cohort", "label"], "prototype_id", range(5), "Proto_")
    return w.withColumns(r6(*[f"Proto_{k}" for k in range(5)]))


@query("G4 G5 G51", f"""with {CELLS} select 'Archetype' || prototype_id as archetype, cell_type, count(*) as n, round(count(*) / sum(count(*)) over (partition by prototype_id), 6) as share
    from cells group by prototype_id, cell_type""")
def cell_types_per_prototype(spark, sf):
    c = P.composition(cells(spark, sf), ["prototype_id"], "cell_type")
    return c.select(F.concat(F.lit("Archetype"), "prototype_id").alias("archetype"), "cell_type", "n", F.round("share", 6).alias("share"))


@query("G6", f"""with {CELLS}, p as (select unnest(range(0, 7))::int as prototype_id) select p.prototype_id, round(coalesce(avg(label), 0.5), 6) as r
    from p left join cells using (prototype_id) group by 1""")
def responder_share(spark, sf):
    protos = spark.range(7).select(F.col("id").cast("int").alias("prototype_id"))
    return P.responder_share(cells(spark, sf), protos).withColumns(r6("r"))


@query("G7 P15 P16 P17", f"""with {CELLS}, f as (select prototype_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from cells),
    m as (select prototype_id, 'embed_' || i as feature, avg(v) as mean from f group by all)
    select * exclude (mean), round(mean, 6) as mean from (select *, row_number() over (partition by prototype_id order by mean desc, feature)::int as rank from m) where rank <= 15""")
def top_mean_features(spark, sf):
    f = cells(spark, sf).select("prototype_id", F.posexplode("embedding").alias("i", "v"))
    m = f.groupBy("prototype_id", F.concat(F.lit("embed_"), F.col("i").cast("string")).alias("feature")).agg(F.avg(F.col("v").cast("double")).alias("mean"))
    return O.top_n(m, ["prototype_id"], [F.desc("mean"), F.col("feature")], 15).withColumns(r6("mean"))


@query("G31 L3 L8", f"""with {CELLS}, c as (select sample_name, prototype_id, count(*) as n from cells group by all)
    select sample_name, prototype_id as dominant, n from (select *, row_number() over (partition by sample_name order by n desc, prototype_id) as rk from c) where rk = 1""")
def dominant_prototype(spark, sf):
    c = P.composition(cells(spark, sf), ["sample_name"], "prototype_id")
    b = c.groupBy("sample_name").agg(F.max_by(F.struct("prototype_id", "n"), F.struct("n", -F.col("prototype_id"))).alias("b"))
    return b.select("sample_name", F.col("b.prototype_id").alias("dominant"), "b.n")


@query("L3 L4 L8", f"""with {CELLS}, c as (select prototype_id, count(*) as n from cells group by 1) select * from c order by n desc, prototype_id limit 3""")
def most_frequent_prototypes(spark, sf):
    return cells(spark, sf).groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prototype_id").limit(3)


@query("G32 G33", f"""with {CELLS}, c as (select sample_name, cell_type, count(*) as n from cells group by all),
    m as (select sample_name, cell_type from (select *, row_number() over (partition by sample_name order by n desc, cell_type) as rk from c) where rk = 1)
    select m.sample_name, m.cell_type as modal_type, f.cohort as first_cohort from m join (select sample_name, arg_min(cohort, node_idx) as cohort from cells group by 1) f using (sample_name)""")
def modal_and_first_values(spark, sf):
    return cells(spark, sf).groupBy("sample_name").agg(F.mode("cell_type", True).alias("modal_type"), F.min_by("cohort", "node_idx").alias("first_cohort"))


@query("G34", f"""with {CELLS} select cohort, count(distinct sample_name) as samples, count(*) as n from cells group by cohort""")
def samples_per_cohort(spark, sf):
    c = cells(spark, sf).groupBy("cohort", "sample_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("cohort").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("n"))


@query("A4 U7", f"""with {CELLS}, m as (select * from (values (3, 1), (4, 0)) t(src, dst)) select sample_name, coalesce(dst, prototype_id)::int as merged, count(*) as n
    from cells left join m on src = prototype_id group by 1, 2""")
def merge_map_application(spark, sf):
    m = cells(spark, sf).select("prototype_id").distinct().where("prototype_id >= 3").select(
        F.col("prototype_id").alias("src"), (4 - F.col("prototype_id")).cast("int").alias("dst")
    )
    a = P.apply_map(cells(spark, sf), m)
    return a.groupBy("sample_name", "merged").agg(F.count(F.lit(1)).alias("n"))


_COS = """cosim as (select a.k as src, b.k as dst, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) /
    ((sqrt(list_sum(list_transform(a.vec, lambda x: x * x))) + 1e-8) * (sqrt(list_sum(list_transform(b.vec, lambda x: x * x))) + 1e-8)) as value from centers a, centers b)"""
_TRANS = """tr as (select a.prototype_id as src, b.prototype_id as dst, count(*) / sum(count(*)) over (partition by a.prototype_id) as value
    from {n} n join cells a on a.node_idx = n.src join cells b on b.node_idx = n.dst group by 1, 2)"""
_ENRICH = """fr as (select sample_name, prototype_id, count(*) / sum(count(*)) over (partition by sample_name) as f, sum(count(*)) over (partition by sample_name) as n from cells group by 1, 2),
    per as (select sample_name, count(*) as edges from knn group by 1),
    exx as (select a.prototype_id as src, b.prototype_id as dst, sum(a.f * b.f * edges) as expected from fr a join fr b using (sample_name) join per using (sample_name) where a.n >= 4 group by 1, 2),
    obs as (select a.prototype_id as src, b.prototype_id as dst, count(*) as observed from knn n join cells a on a.node_idx = n.src join cells b on b.node_idx = n.dst group by 1, 2),
    en as (select src, dst, coalesce(observed, 0) as observed, coalesce(expected, 0) as expected, log2((coalesce(observed, 0) + 1e-9) / (coalesce(expected, 0) + 1e-9)) as value
      from exx full join obs using (src, dst))"""


def transition(spark, sf, k=8):
    return E.transition_matrix(knn(spark, sf, k, False), cells(spark, sf))


def enrichment(spark, sf, k=8):
    return E.log2_enrichment(knn(spark, sf, k), cells(spark, sf))


@query("A3 J18 L11", f"""with {CELLS}, {CENTERS}, {knn_sql(8)}, {knn_sql(8, False, 'knn_all')}, {_COS}, {_TRANS.format(n='knn_all')}, {_ENRICH},
    s as (select k as p, coalesce(n, 0) as n, coalesce(r, 0.5) as r from centers left join (select prototype_id, count(*) as n, avg(label) as r from cells group by 1) c on k = prototype_id),
    o as (select *, row_number() over (order by n desc, p) <= 2 as target, n / sum(n) over () as share from s),
    c as (select a.p as src, b.p as dst, 0.35 * (1 - abs(a.r - b.r)) + 0.25 * greatest(coalesce(en.value, 0), 0) + 0.25 * coalesce(tr.value, 0) + 0.05 * (cosim.value + 1) / 2 as score
      from o a, o b left join en on en.src = a.p and en.dst = b.p left join tr on tr.src = a.p and tr.dst = b.p left join cosim on cosim.src = a.p and cosim.dst = b.p
      where not a.target and b.target and not (a.share >= 0.01 and a.n >= 5000)),
    b as (select *, row_number() over (partition by src order by score desc, dst) as rk from c)
    select src, dst, round(score, 6) as score from b where rk = 1 union all select p, p, null from o where target or (share >= 0.01 and n >= 5000)""")
def merge_map_scores(spark, sf):
    m = P.merge_map(cells(spark, sf), centers(spark, sf), transition(spark, sf), enrichment(spark, sf))
    return m.withColumns(r6("score"))


_FUSED = f"""with {CELLS}, {CENTERS}, {knn_sql(8)}, {knn_sql(8, False, 'knn_all')}, {_COS}, {_TRANS.format(n='knn_all')}, {_ENRICH},
    rs as (select prototype_id as p, avg(label) as r from cells group by 1),
    raw as (select c.src, c.dst, (greatest(least(c.value, 1), -1) + 1) / 2 as c, coalesce((tr.value - (select min(value) from tr)) / ((select max(value) from tr) - (select min(value) from tr)), 0) as t,
      1 / (1 + exp(-coalesce(en.value, 0))) as e, 1 - abs(coalesce(a.r, 0.5) - coalesce(b.r, 0.5)) as p
      from cosim c left join tr using (src, dst) left join en using (src, dst) left join rs a on a.p = c.src left join rs b on b.p = c.dst),
    fused as (select x.src, x.dst, case when x.src = x.dst then 1.0::double else (0.35 * greatest(0, least(1, (x.c + y.c) / 2)) + 0.30 * greatest(0, least(1, (x.t + y.t) / 2)) + 0.25 * greatest(0, least(1, (x.e + y.e) / 2))
      + 0.1 * greatest(0, least(1, (x.p + y.p) / 2))) / 1.0::double end as value from raw x join raw y on x.src = y.dst and x.dst = y.src)"""


def fused(spark, sf):
    c = centers(spark, sf)
    resp = P.responder_share(cells(spark, sf), c.select(F.col("k").alias("prototype_id")))
    return P.fused_similarity(P.center_similarity(c), transition(spark, sf), enrichment(spark, sf), resp)


@query("A7 F24", f"{_FUSED} select src, dst, round(value, 6) as value from fused")
def fused_prototype_similarity(spark, sf):
    return fused(spark, sf).withColumns(r6("value"))


@query("J20 E6", f"""with {CELLS}, {knn_sql(8)}, g as (select distinct least(src, dst) as src, greatest(src, dst) as dst from knn),
    v as (select g.src, g.dst, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) /
      ((sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) + 1e-8) * (sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))) + 1e-8)) as value
      from g join cells a on a.node_idx = g.src join cells b on b.node_idx = g.dst)
    select src, dst, round(value, 6) as value from v where value > 0.1""")
def similar_neighbour_pairs(spark, sf):
    return _similar(spark, sf, 0.1).select("src", "dst", "value").withColumns(r6("value"))


def _similar(spark, sf, threshold):
    c = cells(spark, sf).select("sample_name", "node_idx", "embedding")
    return E.similar_neighbors(knn(spark, sf, 8), c, "embedding", threshold)


@query("A5", f"""with recursive {CELLS}, {knn_sql(8)}, g as (select distinct src, dst from (select src, dst from knn union all select dst, src from knn)),
    e as (select g.src, g.dst from g join cells a on a.node_idx = g.src join cells b on b.node_idx = g.dst
      where list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) /
      ((sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) + 1e-8) * (sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))) + 1e-8)) > 0.15),
    r(node, lab) as (select node_idx, node_idx from cells union select e.src, r.lab from r join e on e.dst = r.node),
    c as (select node, min(lab) as root from r group by node), s as (select root, count(*) as n from c group by root),
    f as (select node, case when n >= 3 then root else node end as root from c join s using (root))
    select node, dense_rank() over (order by root) - 1 as hub from f""")
def similarity_components(spark, sf):
    nodes = cells(spark, sf).select(F.col("node_idx").alias("node"))
    return P.components(_similar(spark, sf, 0.15), nodes, 0.15, min_size=3)


@query("A5 A6", f"""{_FUSED}, r(node, lab) as (select k, k from centers union select f.src, r.lab from r join fused f on f.dst = r.node and f.value >= 0.6 and f.src <> f.dst),
    c as (select node, min(lab) as root from r group by node), h as (select node, dense_rank() over (order by root) - 1 as hub from c)
    select hub, count(*) as cells from cells join h on node = prototype_id group by hub""".replace("with cells", "with recursive cells", 1))
def hub_cell_counts(spark, sf):
    hubs = P.components(fused(spark, sf), centers(spark, sf).select(F.col("k").alias("node")), 0.6)
    c = cells(spark, sf).join(hubs.withColumnRenamed("node", "prototype_id"), "prototype_id")
    return c.groupBy("hub").agg(F.count(F.lit(1)).alias("cells"))


_ARI = """n2 as (select *, n * (n - 1) / 2 as c from cont), i as (select rnd, sum(c) as sij, sum(n) as n from n2 group by rnd),
    a as (select rnd, sum(n * (n - 1) / 2) as s from (select rnd, a, sum(n) as n from cont group by all) group by rnd), b as (select rnd, sum(n * (n - 1) / 2) as s from (select rnd, b, sum(n) as n from cont group by all) group by rnd)
    select rnd as round, round((sij - a.s * b.s / (i.n * (i.n - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (i.n * (i.n - 1) / 2)), 6) as ari from i join a using (rnd) join b using (rnd)"""


@query("A37 X8", f"""{_BASE}, h as (select node_idx, k as a from soft where rk = 1), {Q.PLACES.format(i='node_idx', t='h', f=0.8, space=float(16**13))},
    cont as (select round as rnd, a, c.prototype_id as b, sum(weight)::double as n from dr join pl using (pos) join cells c using (node_idx) group by all), {_ARI}""")
def bootstrap_stability(spark, sf):
    a = assigned(spark, sf).select("node_idx", "prototype", "prototype_id")
    b = X.bootstrap(a, 50, ["node_idx"], 0.8)
    return P.adjusted_rand(b, ["round"], "prototype", "prototype_id", "weight").withColumns(r6("ari")).withColumn("round", F.col("round").cast("long"))


def _seeded(k, rounds, starts=2, passes=2):
    """Hashed oversampling, thinning to k and fixed rounds of Lloyd's algorithm for every start, unrolled; the best start."""
    d2 = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [f"""u as materialized (select vec_id, list_transform(embedding, lambda x: x::double / ({_N.format(v='embedding')} + 1e-8)) as u from embeddings where embedding is not null)"""]
    for s in range(starts):
        out.append(f"t{s}_0 as materialized (select 1 as c, u as vec from u order by md5('42s{s}:' || vec_id), vec_id limit 1)")
        for p in range(passes):
            out.append(f"""f{s}_{p} as materialized (select vec_id, u, min({d2('u', 'vec')}) as d from u, t{s}_{p} group by vec_id, u),
    t{s}_{p + 1} as materialized (select * from t{s}_{p} union all select (select count(*) from t{s}_{p}) + row_number() over (order by vec_id), u from f{s}_{p}
      where ('0x' || substr(md5('42s{s}p{p}:' || vec_id), 1, 13))::bigint / {float(16**13)}::double < {2.0 * k}::double * d / (select sum(d) from f{s}_{p}))""")
        out.append(f"""w{s} as materialized (select t.c, t.vec, coalesce(n, 0) as n from t{s}_{passes} t left join (
      select c, count(*) as n from (select vec_id, arg_min(c, ({d2('u', 'vec')}, c)) as c from u, t{s}_{passes} group by vec_id) group by c) x on x.c = t.c),
    h{s}_0 as materialized (select 0 as k, c, vec from w{s} order by n desc, c limit 1)""")
        for i in range(1, k):
            out.append(f"""h{s}_{i} as materialized (select * from h{s}_{i - 1} union all select {i}, c, vec from (
      select w.c, w.vec, round(w.n * min({d2('w.vec', 'h.vec')}), 9) as score from w{s} w, h{s}_{i - 1} h where w.c not in (select c from h{s}_{i - 1}) group by w.c, w.vec, w.n order by score desc, c limit 1))""")
        out.append(f"l{s}_0 as materialized (select k, vec from h{s}_{k - 1})")
        for i in range(rounds):
            out.append(f"""l{s}_{i + 1} as materialized (select c.k, coalesce(m.vec, c.vec) as vec from l{s}_{i} c left join (select k, list(m order by p) as vec from (
      select k, p, avg(v) as m from (select k, unnest(u) as v, generate_subscripts(u, 1) as p from (select vec_id, u, arg_min(k, ({d2('u', 'vec')}, k)) as k from u, l{s}_{i} group by vec_id, u)) group by k, p) group by k) m using (k))""")
        out.append(f"e{s} as (select {s} as start, round(sum(d), 9) as inertia from (select vec_id, min({d2('u', 'vec')}) as d from u, l{s}_{rounds} group by vec_id))")
    every = " union all ".join(f"select {s} as start, k, vec from l{s}_{rounds}" for s in range(starts))
    inertia = " union all ".join(f"select * from e{s}" for s in range(starts))
    out.append(f"every as ({every}), top as (select start from ({inertia}) order by inertia, start limit 1)")
    return ",\n    ".join(out)


@query("A38", f"with {_seeded(5, 10)} select k, (generate_subscripts(vec, 1) - 1)::int as pos, round(unnest(vec), 4) as v from every where start = (select start from top)")
def kmeans_centres(spark, sf):
    c = P.kmeans_centers(load(spark, sf, "embeddings"), 5)
    return c.select("k", F.posexplode("vec").alias("pos", "v")).withColumns(r6("v", digits=4))
