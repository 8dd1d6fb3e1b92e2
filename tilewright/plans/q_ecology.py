"""Queries: neighbourhood ecology, interfaces, gates, grids."""

from pyspark.sql import functions as F

from tilewright import session
from tilewright.functions import predicates as B
from tilewright.functions.scores import clip01
from tilewright.operators import ecology as E
from tilewright.operators import neighbors as nb
from tilewright.operators import ordered as O
from tilewright.operators import prototypes as P
from tilewright.operators import thinning
from tilewright.plans.q_neighbors import _BETWEEN
from tilewright.plans.q_prototypes import _ENRICH, _TRANS, enrichment, transition
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import (
    CELL_TYPES, CELLS, CENTERS, EDGES, TILE_EXPR, TILES, cells, centers, edges, knn, knn_sql, staged, tile_expr, tiles,
)
from tilewright.session import dealt

PROTOS = list(range(5))
PAIRS = [(i, j) for i in PROTOS for j in PROTOS if i < j]
_MIX = f"""mix as (select c.sample_name, c.node_idx, c.prototype_id, c.cell_type, c.label, c.cohort, c.pos_x, c.pos_y, c.score,
      {', '.join(f'coalesce(avg((b.prototype_id = {k})::int), 0) as p{k}' for k in PROTOS)},
      {', '.join(f"coalesce(avg((b.cell_type = '{t}')::int), 0) as t{i}" for i, t in enumerate(CELL_TYPES))}
    from cells c left join knn n on n.src = c.node_idx left join cells b on b.node_idx = n.dst group by all)"""
_B = f"with {CELLS}, {knn_sql(15)}, {_MIX}"


def mixed(spark, sf):
    def build():
        c, pairs = cells(spark, sf), dealt(knn(spark, sf, 15), ["sample_name", "dst"], session.SPREAD)
        m = E.with_mix(c, E.neighbor_mix(pairs, c, "prototype_id", PROTOS), "mix", 5)
        return E.with_mix(m, E.neighbor_mix(pairs, c, "cell_type", CELL_TYPES, "types"), "types", 5).drop("embedding")

    return staged(spark, ("mixed", sf), build)


@query("G13 D1", f"""{_B} select node_idx, {', '.join(f'round(p{k}, 6) as P{k}' for k in PROTOS)}, {', '.join(f'round(t{i}, 6) as CT_{t}' for i, t in enumerate(CELL_TYPES))} from mix""")
def local_ecology(spark, sf):
    m = mixed(spark, sf)
    return m.select(
        "node_idx",
        *[F.round(F.col("mix")[k], 6).alias(f"P{k}") for k in PROTOS],
        *[F.round(F.col("types")[i], 6).alias(f"CT_{t}") for i, t in enumerate(CELL_TYPES)],
    )


_LONGP = "(select * from (values " + ", ".join(f"({k})" for k in PROTOS) + ") v(k))"


@query("G14 P6", f"""{_B} select prototype_id as anchor, count(*) as n_cells, k as prototype_id, round(avg(case k {' '.join(f'when {k} then p{k}' for k in PROTOS)} end), 6) as share
    from mix, {_LONGP} group by prototype_id, k having count(*) >= 20""")
def anchor_ecology(spark, sf):
    m = mixed(spark, sf).withColumnRenamed("prototype_id", "anchor")
    return E.anchor_mix(m, ["anchor"], "mix", PROTOS, "prototype_id", 20).withColumns(r6("share"))


@query("G15", f"""{_B} select sample_name, prototype_id as anchor, count(*) as n_cells, ({CELL_TYPES})[(k + 1)::int] as cell_type, round(avg(case k {' '.join(f'when {k} then t{k}' for k in PROTOS)} end), 6) as share
    from mix, {_LONGP} group by sample_name, prototype_id, k having count(*) >= 5""")
def sample_ecology_signature(spark, sf):
    m = mixed(spark, sf).withColumnRenamed("prototype_id", "anchor")
    return E.anchor_mix(m, ["sample_name", "anchor"], "types", CELL_TYPES, "cell_type", 5).withColumns(r6("share"))


_DENSITY = """density as (select sample_name, count(*) filter (false) as z, greatest(sum(dist), 1e-6) as total_edge_len, avg((ps <> pt)::int) as edges_cross_rate,
      {cols} from (select n.*, a.prototype_id as ps, b.prototype_id as pt from knn n join cells a on a.node_idx = n.src join cells b on b.node_idx = n.dst) group by sample_name)""".format(
    cols=", ".join(
        f"sum(case when (ps = {a} and pt = {b}) or (ps = {b} and pt = {a}) then dist else 0 end) / greatest(sum(dist), 1e-6) as ID_{a}_{b}" for a, b in [(2, 0), (2, 4)]
    )
)


@query("G8", f"""with {CELLS}, {knn_sql(15)}, {_DENSITY} select sample_name, n_cells, round(total_edge_len, 3) as total_edge_len, round(edges_cross_rate, 6) as edges_cross_rate,
    round(ID_2_0, 6) as ID_2_0, round(ID_2_4, 6) as ID_2_4 from density join (select sample_name, count(*) as n_cells from cells group by 1) using (sample_name) where n_cells >= 17""")
def interface_density(spark, sf):
    pairs = dealt(knn(spark, sf, 15), ["sample_name", "src"], session.SPREAD)
    d = E.interface_density(pairs, cells(spark, sf), [(2, 0), (2, 4)], 15)
    return d.withColumns(r6("edges_cross_rate", "ID_2_0", "ID_2_4")).withColumn("total_edge_len", F.round("total_edge_len", 3))


_NEAR0 = """near0 as (select a.sample_name, a.node_idx, a.prototype_id, min(sqrt((a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y))) as d
    from cells a join cells b on a.sample_name = b.sample_name and b.prototype_id = 0 group by all),
    prox as (select sample_name, {c} from near0 group by sample_name)""".format(
    c=", ".join(f"count(*) filter (d <= {r} and prototype_id = 2) / nullif(count(*) filter (d <= {r}), 0) as P2_occ_r{r}" for r in (30, 60, 100))
)


@query("G9 J8", f"""with {CELLS}, {_NEAR0} select sample_name, {', '.join(f'round(P2_occ_r{r}, 6) as P2_occ_r{r}' for r in (30, 60, 100))} from prox""")
def proximity_occupancy(spark, sf):
    p = E.proximity_occupancy(cells(spark, sf), (30, 60, 100))
    return p.withColumns(r6("P2_occ_r30", "P2_occ_r60", "P2_occ_r100"))


def _others(k):
    return "greatest(" + ", ".join(f"p{i}" for i in PROTOS if i != k) + ")"


_CORE = "core as (" + " union all ".join(
    f"select sample_name, {k} as prototype_id, avg((p{k} >= 0.3 and p{k} - {_others(k)} >= 0.05)::int) as core_frac, count(*) filter (p{k} >= 0.3 and p{k} - {_others(k)} >= 0.05) as core_count, "
    f"avg(p{k} - {_others(k)}) filter (p{k} >= 0.3 and p{k} - {_others(k)} >= 0.05) as core_margin_mean, avg(p{k}) as prop_mean from mix group by sample_name" for k in PROTOS
) + ")"


@query("G10 P7", f"""{_B}, {_CORE} select sample_name, prototype_id, round(core_frac, 6) as core_frac, core_count, round(core_margin_mean, 6) as core_margin_mean, round(prop_mean, 6) as prop_mean from core""")
def core_metrics(spark, sf):
    return E.core_metrics(mixed(spark, sf), "mix", PROTOS, 0.3, 0.05).withColumns(r6("core_frac", "core_margin_mean", "prop_mean"))


@query("G10 G11 P8 F46", f"""{_B}, x as ({' union all '.join(f"select sample_name, 'P{i}_P{j}' as pair, least(p{i}, p{j}) as s from mix" for i, j in PAIRS)})
    select sample_name, pair, round(avg((s >= 0.2)::int), 6) as interface_frac, count(*) filter (s >= 0.2) as interface_count, round(avg(s) filter (s >= 0.2), 6) as interface_mean_strength, round(avg(s), 6) as mean_strength from x group by all""")
def interface_metrics(spark, sf):
    return E.interface_metrics(mixed(spark, sf), "mix", PAIRS, 0.2).withColumns(r6("interface_frac", "interface_mean_strength", "mean_strength"))


@query("G12", f"""{_B}, m as (select sample_name, {', '.join(f'avg(p{k}) as m{k}' for k in PROTOS)} from mix group by 1)
    select distinct i, j from ({' union all '.join(f'select {i} as i, {j} as j, (m{i} >= 0.2 and m{j} >= 0.2) as ok from m' for i in PROTOS for j in PROTOS if i < j)}) where ok""")
def existing_interface_pairs(spark, sf):
    return E.existing_pairs(mixed(spark, sf), "mix", PROTOS, 0.2)


@query("P8 P9 P10 P12 P11", f"""{_B}, q as (select sample_name, quantile_cont(least(p0, p2), 0.75) as q from mix group by 1)
    select node_idx, least(p0, p2) >= 0.2 as interface, (p0 >= 0.3 and p2 <= 0.8) or (p2 >= 0.3 and p0 <= 0.8) as pair_core, abs(p0 - p2) <= 0.1 as balanced,
      least(p0, p2) >= q as above_quantile, case when (case prototype_id {' '.join(f'when {k} then p{k}' for k in PROTOS)} end) >= 0.3 then 'core' else 'edge' end as zone from mix join q using (sample_name)""")
def interface_predicates(spark, sf):
    m = mixed(spark, sf).withColumn("s", B.interface_strength(F.col("mix"), 0, 2))
    m = O.with_quantiles(m, ["sample_name"], "s", [0.75])
    x = F.col("mix")
    return m.select(
        "node_idx",
        B.is_interface(x, 0, 2, 0.2).alias("interface"),
        B.is_pair_core(x, 0, 2, 0.3, 0.2).alias("pair_core"),
        B.is_balanced(x, 0, 2, 0.1).alias("balanced"),
        (F.col("s") >= F.col("q")[0]).alias("above_quantile"),
        B.zone(F.col("prototype_id"), x, 0.3).alias("zone"),
    )


@query("J4 J16 G33", f"""{_B}, {_DENSITY}, {_NEAR0}, {_CORE}, cw as (select sample_name, {', '.join(f'max(core_frac) filter (prototype_id = {k}) as core_frac_P{k}' for k in PROTOS)} from core group by 1),
    g as (select sample_name, {', '.join(f'count(*) filter (prototype_id = {k}) / count(*) as global_P{k}' for k in PROTOS)}, arg_min(cohort, node_idx) as cohort, arg_min(label, node_idx) as label from cells group by 1)
    select sample_name, cohort, label, round(ID_2_0, 6) as ID_2_0, round(edges_cross_rate, 6) as edges_cross_rate, round(P2_occ_r60, 6) as P2_occ_r60, {', '.join(f'round(core_frac_P{k}, 6) as core_frac_P{k}, round(global_P{k}, 6) as global_P{k}' for k in PROTOS)}
    from density full join prox using (sample_name) full join cw using (sample_name) left join g using (sample_name)""")
def sample_metric_table(spark, sf):
    c, m = cells(spark, sf), mixed(spark, sf)
    density = E.interface_density(knn(spark, sf, 15), c, [(2, 0)], 15).select("sample_name", "ID_2_0", "edges_cross_rate")
    prox = E.proximity_occupancy(c, [60])
    core = E.core_metrics(m, "mix", PROTOS, 0.3, 0.05).groupBy("sample_name").pivot("prototype_id", PROTOS).agg(F.max("core_frac"))
    core = core.select("sample_name", *[F.col(f"`{k}`").alias(f"core_frac_P{k}") for k in PROTOS])
    shares = P.composition_wide(c, ["sample_name"], "prototype_id", PROTOS, "global_P")
    t = E.assemble_metrics(density, prox, core, shares, c)
    return t.withColumns(r6("ID_2_0", "edges_cross_rate", "P2_occ_r60", *[f"core_frac_P{k}" for k in PROTOS], *[f"global_P{k}" for k in PROTOS]))


@query("G16", f"""with {CELLS}, nr as (select b.cell_type, sqrt((a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y)) as dist
      from cells a join cells b on a.prototype_id = 1 and a.node_idx <> b.node_idx and abs(a.pos_x - b.pos_x) <= 100 and abs(a.pos_y - b.pos_y) <= 100),
    e as (select radius, cell_type from nr, (select unnest([20.0, 40.0, 60.0, 100.0])::double as radius) where dist <= radius)
    select radius, cell_type, count(*) as n, round(count(*) / sum(count(*)) over (partition by radius), 6) as share from e group by radius, cell_type""")
def radial_profile(spark, sf):
    return E.radial_profile(cells(spark, sf), 1, [20, 40, 60, 100], "cell_type").withColumns(r6("share"))


@query("G17 D15", f"""with {CELLS}, {knn_sql(8, False, 'knn_all')}, {_TRANS.format(n='knn_all')} select src, dst, round(value, 6) as value from tr""")
def transition_matrix(spark, sf):
    return transition(spark, sf).select("src", "dst", F.round("value", 6).alias("value"))


@query("G18 S33", f"""with {CELLS}, {knn_sql(8, False, 'knn_all')}, {_TRANS.format(n='knn_all')}, s as (select src, dst, (value - (select min(value) from tr)) / ((select max(value) - min(value) from tr) + 1e-9) as value from tr)
    select a.src, a.dst, round((a.value + b.value) / 2, 6) as weight from s a join s b on a.src = b.dst and a.dst = b.src where a.src < a.dst""")
def scaled_interaction_edges(spark, sf):
    return E.symmetric_edges(E.minmax_matrix(transition(spark, sf))).withColumns(r6("weight"))


@query("G19", f"""with {CELLS}, {knn_sql(8)}, {_ENRICH} select src, dst, observed, round(expected, 4) as expected, round(value, 6) as value from en""")
def log2_enrichment(spark, sf):
    return enrichment(spark, sf).select("src", "dst", "observed", F.round("expected", 4).alias("expected"), F.round("value", 6).alias("value"))


@query("G20", f"""with {CELLS}, {knn_sql(8)}, e as (select a.label as lab, a.prototype_id as src, b.prototype_id as dst, count(*) / sum(count(*)) over (partition by a.label, a.prototype_id) as value
      from knn n join cells a on a.node_idx = n.src join cells b on b.node_idx = n.dst group by 1, 2, 3)
    select coalesce(x.src, y.src) as src, coalesce(x.dst, y.dst) as dst, round(coalesce(x.value, 0) - coalesce(y.value, 0), 6) as value from (select * from e where lab = 1) x full join (select * from e where lab = 0) y on x.src = y.src and x.dst = y.dst""")
def differential_enrichment(spark, sf):
    c, pairs = cells(spark, sf), knn(spark, sf, 8)
    side = lambda v: E.transition_matrix(pairs, c.where(F.col("label") == v), groups=["sample_name"])
    return E.difference(side(1), side(0)).withColumns(r6("value"))


@query("G21", f"""{_B}, x as ({' union all '.join(f'select {k} as anchor, cell_type from mix where p{k} >= 0.25' for k in PROTOS)})
    select anchor, cell_type, count(*) as n, round(count(*) / sum(count(*)) over (partition by anchor), 6) as share from x group by anchor, cell_type""")
def anchor_focus_shares(spark, sf):
    return E.focus_shares(mixed(spark, sf), "mix", PROTOS, "cell_type", 0.25).withColumns(r6("share"))


_G = f"with {CELLS}, {TILES}, {EDGES}, gate as (select c.sample_name, c.node_idx, c.prototype_id, c.cell_type, coalesce(avg(weight), 0) as gate from cells c left join weighted w on w.sample_name = c.sample_name and w.src = c.node_idx group by all)"


@query("G22 F35 E1", f"""{_G}, q as (select quantile_cont(gate, [0.01, 0.99]) as q from gate) select node_idx, round(gate, 6) as gate, round(least(greatest((gate - q[1]) / greatest(q[2] - q[1], 1e-6), 0), 1), 6) as gate_norm from gate, q""")
def gate_strength(spark, sf):
    g = E.gate_strength(edges(spark, sf), cells(spark, sf))
    return g.select("node_idx", F.round("gate", 6).alias("gate"), F.round("gate_norm", 6).alias("gate_norm"))


@query("G23", f"""{_G} select prototype_id, cell_type, count(*) as n, round(avg(gate), 6) as mean, round(median(gate), 6) as median, round(stddev_samp(gate), 6) as std,
    round(avg(gate) - (select avg(gate) from gate g2 where g2.prototype_id = gate.prototype_id), 6) as delta from gate group by prototype_id, cell_type""")
def gate_summary(spark, sf):
    g = E.gate_strength(edges(spark, sf), cells(spark, sf))
    return E.gate_summary(g).withColumns(r6("mean", "median", "std", "delta"))


@query("G55", f"""with {CELLS}, {TILES}, {EDGES}, s as (select c.sample_name, c.node_idx, coalesce(sum(weight), 0) as strength from cells c left join weighted w on w.sample_name = c.sample_name and w.src = c.node_idx group by all),
    q as (select sample_name, quantile_cont(strength, 0.05) as lo, quantile_cont(strength, 0.95) as hi from s where strength > 0 group by 1),
    w as (select s.*, greatest(least(strength, coalesce(hi, 1)), coalesce(lo, 0)) as w from s left join q using (sample_name))
    select sample_name, node_idx, round(strength, 6) as strength, round((w - min(w) over p) / (max(w) over p - min(w) over p + 1e-9), 6) as scaled from w window p as (partition by sample_name)""")
def cell_edge_strength(spark, sf):
    return E.edge_strength(edges(spark, sf), cells(spark, sf)).withColumns(r6("strength", "scaled"))


@query("G39 F39 D4", f"""with {CELLS}, {TILES}, {EDGES} select sample_name, src, dst, round(weight, 6) as weight from weighted""")
def edge_weights(spark, sf):
    return edges(spark, sf).select("sample_name", "src", "dst", F.round("weight", 6).alias("weight"))


@query("G29", f"""with {CELLS}, {TILES}, {EDGES}, tp as (select *, (abs(tile_x::bigint // 50 + tile_y::bigint // 50) % 3)::int as tile_proto from tiles),
    m as (select w.sample_name, src, {', '.join(f'sum(case when tile_proto = {k} then weight else 0 end) / greatest(sum(weight), 1e-6) as m{k}' for k in range(3))} from weighted w join tp on tp.sample_name = w.sample_name and tp.tile_id = w.dst group by 1, 2)
    select prototype_id as anchor, count(*) as n_cells, k as tile_proto, round(avg(case k when 0 then m0 when 1 then m1 else m2 end), 6) as share from m join cells on node_idx = src, (select unnest([0, 1, 2]) as k) group by prototype_id, k having count(*) >= 20""")
def anchor_tile_mix(spark, sf):
    t = tiles(spark, sf).withColumn("tile_proto", (F.abs((F.col("tile_x") / 50).cast("long") + (F.col("tile_y") / 50).cast("long")) % 3).cast("int"))
    m = E.tile_prototype_mix(edges(spark, sf), t, range(3))
    j = cells(spark, sf).select("sample_name", "node_idx", F.col("prototype_id").alias("anchor")).join(m, ["sample_name", "node_idx"])
    return E.anchor_mix(j, ["anchor"], "mix", range(3), "tile_proto", 20).withColumns(r6("share"))


@query("F30 F49", f"""with {CELLS}, {TILES}, {EDGES}, c as (select *, list_transform(embedding[1:3], lambda x: exp(x::double)) as e from cells), qc as (select *, list_transform(e, lambda x: x / list_sum(e)) as q from c),
    t as (select sample_name, tile_id, [0.5, 0.25 + (abs(tile_x) % 100) / 1000.0::double, 0.25] as q from tiles),
    s as (select w.sample_name, src, (a.q[1] * 0.8 + a.q[2] * 0.1 + a.q[3] * 0.1) * t.q[1] + (a.q[1] * 0.1 + a.q[2] * 0.8 + a.q[3] * 0.1) * t.q[2] + (a.q[1] * 0.1 + a.q[2] * 0.1 + a.q[3] * 0.8) * t.q[3] as d, weight
      from weighted w join qc a on a.node_idx = w.src join t on t.sample_name = w.sample_name and t.tile_id = w.dst),
    p as (select src, sum(sign(d * weight) * pow(abs(d * weight) + 1e-8, 0.5)) / (count(*) + 1e-8) as score from s group by src),
    f as (select node_idx, coalesce(p.score, 0) as score from cells left join p on src = node_idx)
    select sample_name, node_idx, round((score - (select min(score) from f)) / (select max(score) - min(score) from f), 6) as score from (select node_idx, f.score, sample_name from f join cells using (node_idx)) f""")
def cross_modal_compatibility(spark, sf):
    from tilewright.functions.arrays import total

    e = F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(x.cast("double")))
    c = cells(spark, sf).withColumn("_e", e).withColumn("soft_prob", F.transform("_e", lambda x: x / total(F.col("_e"))))
    t = tiles(spark, sf).withColumn("soft_prob", F.array(F.lit(0.5), 0.25 + (F.abs("tile_x") % 100) / 1000.0, F.lit(0.25)))
    bridge = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    return E.compatibility(edges(spark, sf), c, t, bridge, 2.0).withColumns(r6("score"))


@query("G40", f"""with {CELLS}, {TILES}, {EDGES}, x as (select min(weight) as lo, max(weight) as hi, count(*) as n from weighted), b as (select least(floor((weight - lo) / ((hi - lo) / 50)), 49)::bigint as bin from weighted, x)
    select bin, count(*) as n, round(count(*) / ((select n from x) * (select (hi - lo) / 50 from x)), 6) as density from b group by bin""")
def weight_histogram(spark, sf):
    return E.histogram(edges(spark, sf), "weight", 50).withColumns(r6("density"))


@query("G41", f"""with {CELLS}, x as (select min(pos_x) as x0, max(pos_x) as x1, min(pos_y) as y0, max(pos_y) as y1 from cells)
    select least(floor((pos_x - x0) / ((x1 - x0) / 20)), 19)::bigint as gx, least(floor((pos_y - y0) / ((y1 - y0) / 20)), 19)::bigint as gy, count(*) as n, round(avg(score), 6) as score, round(avg((prototype_id = 0)::int), 6) as flag_share from cells, x group by 1, 2""")
def grid_score_means(spark, sf):
    c = cells(spark, sf).withColumn("flag", F.col("prototype_id") == 0)
    return E.grid_means(c, "score", "flag", 20).withColumns(r6("score", "flag_share"))


@query("G42 P13", f"""with {CELLS}, s as (select sample_name, floor(pos_x / 100)::bigint as gx, floor(pos_y / 100)::bigint as gy, cell_type, count(*) as c from cells group by all), n as (select *, sum(c) over (partition by sample_name, gx, gy) as n from s)
    select sample_name, gx, gy, cell_type, n::bigint as n, round(c / n, 6) as share from n where n >= 3 and c / n >= 0.3""")
def type_enriched_squares(spark, sf):
    return E.type_enrichment(cells(spark, sf), 100.0, 0.3, 3).withColumns(r6("share"))


@query("J11 F35", f"""with {CELLS}, {TILES}, {_BETWEEN.format(k=1)}, q as (select quantile_cont(score, [0.01, 0.99]) as q from cells)
    select n.sample_name, src as tile_id, round(least(greatest((score - q[1]) / greatest(q[2] - q[1], 1e-6), 0), 1), 6) as score from near n join cells c on c.node_idx = n.dst, q""")
def clipped_scalar_transfer(spark, sf):
    c = cells(spark, sf)
    q = O.quantiles(c, [], "score", [0.01, 0.99]).scalar()
    scaled = c.withColumn("_q", q).withColumn("s01", clip01(F.col("score"), F.col("_q")[0], F.col("_q")[1]))
    near = nb.knn_between(
        tiles(spark, sf).withColumn("node_idx", F.col("tile_id")), c, 1, ["sample_name"]
    )
    return near.join(scaled.select("sample_name", F.col("node_idx").alias("dst"), "s01"), ["sample_name", "dst"]).select(
        "sample_name", F.col("src").alias("tile_id"), F.round("s01", 6).alias("score")
    )


@query("A57", f"""with recursive {CELLS}, c as (select sample_name, node_idx, pos_x, pos_y, row_number() over (partition by sample_name order by node_idx) as rn from cells),
    k(sample_name, rn, kept) as (select distinct sample_name, 0::bigint, []::bigint[] from c union all
      select k.sample_name, c.rn, case when exists (select 1 from cells o where list_contains(k.kept, o.node_idx) and (o.pos_x-c.pos_x)*(o.pos_x-c.pos_x)+(o.pos_y-c.pos_y)*(o.pos_y-c.pos_y) <= 30.0*30.0) then k.kept else list_append(k.kept, c.node_idx) end
      from k join c on c.sample_name = k.sample_name and c.rn = k.rn + 1)
    select sample_name, unnest(kept) as node_idx from (select sample_name, arg_max(kept, rn) as kept from k group by sample_name)""")
def spatial_deduplication(spark, sf):
    return thinning.deduplicate(cells(spark, sf), 30.0, ["sample_name"]).select("sample_name", "node_idx")
