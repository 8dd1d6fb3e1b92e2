"""Queries: expression transforms, profiles and differential expression."""

from pyspark.sql import functions as F

from tilewright.operators import expression as X
from tilewright.operators import ordered as O
from tilewright.operators import prototypes as P
from tilewright.operators import sampling
from tilewright.operators import stats as S
from tilewright.plans import tail_sql as Q
from tilewright.plans.q_ecology import _B, PAIRS, PROTOS, mixed
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, EDGES, MEASURES, TILE_EXPR, TILES, cells, edges, measures, staged, tile_expr, tiles
from tilewright.session import load, spread

_CX = f"""{TILES}, {TILE_EXPR}, {EDGES}, cx as (select w.sample_name, src as node_idx, gene, sum(weight * value) / sum(weight) as value from weighted w
    join tiles t on t.sample_name = w.sample_name and t.tile_id = w.dst join tile_expr e on e.sample_name = t.sample_name and e.tile_x = t.tile_x and e.tile_y = t.tile_y group by all having sum(weight) > 0)"""


def cell_expr(spark, sf):
    def build():
        t = tile_expr(spark, sf).withColumn(
            "tile_id", F.format_string("%d_%d", F.col("tile_x").cast("long"), F.col("tile_y").cast("long"))
        )
        return X.weighted_expression(edges(spark, sf), t.select("sample_name", "tile_id", "gene", "value"))

    return staged(spark, ("cell_expr", sf), build)


@query("J6 D3", f"with {CELLS}, {_CX} select sample_name, node_idx, gene, round(value, 6) as value from cx")
def weighted_cell_expression(spark, sf):
    return cell_expr(spark, sf).withColumns(r6("value"))


@query("F33 G36", f"""with {MEASURES}, l as (select unit, sum(value) as library from measures group by 1) select unit, line, gene, library, round(ln(1 + value / library * 10000), 6) as norm from measures join l using (unit)""")
def log_normalised_counts(spark, sf):
    m = X.log_normalize(measures(spark, sf).select("unit", "line", "gene", "value"), ["unit"], keep=True)
    return m.select("unit", "line", "gene", "library", F.round("norm", 6).alias("norm"))


@query("F32 G38", f"""with {MEASURES}, g as (select upper(replace(p_brand, '#', '')) as gene, sum(p_size)::double * 10 as length from part group by 1),
    r as (select unit, line, gene, case when length > 0 then value / (length / 1000) else 0 end as rpk from measures left join g using (gene))
    select unit, line, gene, round(ln(1 + rpk / (sum(rpk) over (partition by unit) / 1e6)) / ln(2), 6) as tpm_log from r""")
def tpm_log_transform(spark, sf):
    p = load(spark, sf, "part")
    lengths = p.groupBy(F.upper(F.regexp_replace("p_brand", "#", "")).alias("gene")).agg((F.sum("p_size").cast("double") * 10).alias("length"))
    t = X.tpm_log(measures(spark, sf).select("unit", "line", "gene", "value"), lengths, ["unit"])
    return t.select("unit", "line", "gene", F.round("tpm_log", 6).alias("tpm_log"))


@query("G24", f"""with {MEASURES} select sample_name, label, gene, count(*) as n, round(avg(value), 6) as value from measures group by all""")
def pseudobulk_means(spark, sf):
    return X.pseudobulk(measures(spark, sf), ["sample_name", "label", "gene"]).withColumns(r6("value"))


@query("G25", f"""with {MEASURES}, s as (select sample_name, prototype_id, gene, avg(value) as v, count(*) as c from measures group by all)
    select prototype_id, gene, round(avg(v), 6) as value, sum(c)::bigint as n from s group by all having sum(c) >= 200""")
def prototype_expression(spark, sf):
    return X.prototype_expression(measures(spark, sf), 200).withColumns(r6("value"))


_WIN = """q as (select sample_name, layer, gene, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from measures group by all),
    w as (select m.sample_name, m.layer, m.gene, greatest(least(value, hi), lo) as v from measures m join q on q.sample_name = m.sample_name and q.layer = m.layer and q.gene = m.gene)"""


@query("G26 F38", f"""with {MEASURES}, {_WIN} select sample_name, layer, gene, round(median(v), 6) as value from w group by all""")
def robust_group_profile(spark, sf):
    return X.robust_profile(measures(spark, sf), ["sample_name", "layer", "gene"]).withColumns(r6("value"))


@query("G26 E1", f"""with {MEASURES}, {_WIN} select sample_name, layer, gene, round(avg(v), 6) as value from w group by all""")
def robust_group_profile_mean(spark, sf):
    return X.robust_profile(measures(spark, sf), ["sample_name", "layer", "gene"], how="mean").withColumns(r6("value"))


@query("G28", f"""with {MEASURES}, s as (select sample_name, label, prototype_id, gene, avg(value) filter (layer = 'core') as c, avg(value) filter (layer = 'edge') as e from measures group by all)
    select prototype_id, gene, round(avg(c), 6) as core, round(avg(e), 6) as edge, round(avg(c) filter (label = 1), 6) as core_responder, round(avg(c) filter (label = 0), 6) as core_other from s group by all""")
def core_edge_profiles(spark, sf):
    on = lambda layer: F.avg(F.when(F.col("layer") == layer, F.col("value")))
    s = measures(spark, sf).groupBy("sample_name", "label", "prototype_id", "gene").agg(on("core").alias("c"), on("edge").alias("e"))
    out = s.groupBy("prototype_id", "gene").agg(
        F.avg("c").alias("core"), F.avg("e").alias("edge"),
        F.avg(F.when(F.col("label") == 1, F.col("c"))).alias("core_responder"),
        F.avg(F.when(F.col("label") == 0, F.col("c"))).alias("core_other"),
    )
    return out.withColumns(r6("core", "edge", "core_responder", "core_other"))


@query("G30 G37", f"""with {MEASURES}, c as (select cohort, cell_type, gene, avg(value) as m from measures group by all) select gene, round(median(m), 6) as median_over_cohorts from c group by gene""")
def median_across_cohorts(spark, sf):
    c = measures(spark, sf).groupBy("cohort", "cell_type", "gene").agg(F.avg("value").alias("m"))
    return c.groupBy("gene").agg(F.round(F.median("m"), 6).alias("median_over_cohorts"))


@query("G37", f"""with {MEASURES} select cell_type, prototype_id, round(avg(value), 6) as mean_score, count(*) as n from measures group by all""")
def mean_score_per_cluster(spark, sf):
    return measures(spark, sf).groupBy("cell_type", "prototype_id").agg(F.round(F.avg("value"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query("G35 P21", f"""with {MEASURES}, z as (select *, case when gene = 'BRAND3' then 0 else value end as v from measures) select sample_name, gene, round(avg(v), 6) as value from z where gene <> 'BRAND3' group by all""")
def collapsed_genes(spark, sf):
    m = measures(spark, sf).withColumn("value", F.when(F.col("gene") == "BRAND3", 0.0).otherwise(F.col("value")))
    return X.collapse_genes(m.withColumn("gene", F.lower("gene")), ["sample_name"]).withColumns(r6("value"))


@query("P20 P4 P5", f"""with {MEASURES}, f as (select gene, stddev_samp(value) as s, count(value) as n from measures group by gene) select gene, count(*) as rows_kept from measures join f using (gene) where s > 0 and n >= 5 group by gene""")
def informative_features(spark, sf):
    m = X.informative_features(measures(spark, sf).na.drop(subset=["value"]), "gene", "value")
    return m.groupBy("gene").agg(F.count(F.lit(1)).alias("rows_kept"))


@query("G44 E1", f"""with {MEASURES} select gene, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(median(value), 6) as median, max(value) as max, min(value) as min, sum(value) as sum, round(sum(value * weight) / sum(weight), 6) as average from measures group by gene""")
def summary_dispatch(spark, sf):
    m = measures(spark, sf)
    s = X.summarise(m, ["gene"], "value", ["mean", "std", "median", "max", "min", "sum"])
    return s.join(X.weighted_mean(m, ["gene"], "value", "weight"), "gene").withColumns(r6("mean", "std", "median", "average"))


@query("L7 L5 A58", f"""with {MEASURES}, v as (select gene, var_samp(value) as variance from measures group by gene) select gene, round(variance, 6) as variance from v order by v.variance desc, gene limit 10""")
def variable_genes(spark, sf):
    return X.variable_genes(measures(spark, sf), 10).withColumns(r6("variance"))


@query("L7", f"""with {MEASURES}, v as (select gene, avg(value) as m from measures group by gene) select gene, round(m, 6) as mean from v order by m desc, gene limit 5""")
def top_expressed_genes(spark, sf):
    return measures(spark, sf).groupBy("gene").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "gene").limit(5).withColumns(r6("mean"))


def _features(spark, sf):
    return cells(spark, sf).select("node_idx", F.col("embedding").cast("array<double>").alias("f"))


@query("A58")
def principal_components(spark, sf):
    p = X.pca(_features(spark, sf), "f", 5)
    return p.select("node_idx", *[F.round(F.col("components")[i], 4).alias(f"pc{i + 1}") for i in range(5)])


@query("A58", f"""with {CELLS}, v as (select node_idx, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as p from cells)
    select a.p::int as i, b.p::int as j, round(corr(a.x, b.x), 6) as value from v a join v b using (node_idx) group by a.p, b.p""")
def component_reconstruction(spark, sf):
    return X.reconstructed_correlation(_features(spark, sf), "f", 64).withColumns(r6("value"))


@query("A58", f"""with {CELLS}, v as (select node_idx, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as p from cells) select count(distinct p)::double as total, 0.0::double as shared, 0 as unordered from v""")
def component_variances(spark, sf):
    """All components: their variances add up to the number of features, they share nothing, and they come in order."""
    p = X.pca(_features(spark, sf), "f", 64)
    c = lambda i: F.col("components")[i]
    r = p.agg(*[F.var_samp(c(i)).alias(f"v{i}") for i in range(64)], *[F.covar_samp(c(i), c(i + 1)).alias(f"s{i}") for i in range(63)])
    total = sum((F.col(f"v{i}") for i in range(1, 64)), F.col("v0"))
    shared = F.greatest(*[F.abs(f"s{i}") for i in range(63)])
    unordered = sum(((F.col(f"v{i}") < F.col(f"v{i + 1}") - 1e-9).cast("int") for i in range(1, 63)), (F.col("v0") < F.col("v1") - 1e-9).cast("int"))
    return r.select(F.round(total, 6).alias("total"), F.round(shared, 6).alias("shared"), unordered.alias("unordered"))


# ---------------------------------------------------------------- differential expression

_PX = f"""pij(i, j) as (select * from (values {', '.join(map(str, PAIRS))})), px as (select sample_name, node_idx, 'P' || i || '_P' || j as pair, m[i + 1] as x, m[j + 1] as y from (select *, [{', '.join(f'p{k}' for k in PROTOS)}] as m from mix), pij)"""
_TAG = f"""{_PX}, tag as (select pair, sample_name, node_idx, 'interface' as layer from px where least(x, y) >= 0.2 union all
      select pair, sample_name, node_idx, 'core' from px where (x >= 0.3 and y <= 1 - 0.2::double) or (y >= 0.3 and x <= 1 - 0.2::double))"""
_DEPROF = """sz as (select pair, sample_name from tag group by all having count(*) filter (layer = 'interface') >= {m} and count(*) filter (layer = 'core') >= {m}),
    rws as (select t.pair, t.sample_name, t.layer, c.gene, c.value from tag t join sz on sz.pair = t.pair and sz.sample_name = t.sample_name join cx c on c.sample_name = t.sample_name and c.node_idx = t.node_idx),
    wq as (select pair, sample_name, layer, gene, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from rws group by all),
    pr as (select r.pair, r.sample_name, r.layer, r.gene, median(greatest(least(value, hi), lo)) as v from rws r join wq q on q.pair = r.pair and q.sample_name = r.sample_name and q.layer = r.layer and q.gene = r.gene group by all),
    prof as (select pair, sample_name, gene, max(v) filter (layer = 'interface') as a, max(v) filter (layer = 'core') as b from pr group by all having max(v) filter (layer = 'interface') is not null and max(v) filter (layer = 'core') is not null)"""


def tagged(spark, sf, **more):
    return X.tag_layers(mixed(spark, sf), "mix", PAIRS, 0.3, 0.2, **more)


def profiles(spark, sf):
    return staged(spark, ("profiles", sf), lambda: X.layer_profiles(tagged(spark, sf), cell_expr(spark, sf), ["sample_name", "node_idx"], 3))


@query("G27 P9", f"{_B}, {_TAG}, {_CX}, {_DEPROF.format(m=3)} select pair, sample_name, gene, round(a, 6) as interface, round(b, 6) as core from prof")
def interface_core_profiles(spark, sf):
    return profiles(spark, sf).select("pair", "sample_name", "gene", F.round("a", 6).alias("interface"), F.round("b", 6).alias("core"))


_PT = f"""pt as (select pair, gene, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) as t from prof group by all having count(*) >= {{n}}),
    tests as (select *, {Q.student('t', '(n - 1)')} as p from pt), final as ({Q.bh('pair', 'p')})"""


@query("A8 A18 E2 P19", f"""{_B}, {_TAG}, {_CX}, {_DEPROF.format(m=3)}, {_PT.format(n=2)}
    select pair, gene, n, round(mean_a, 6) as mean_interface, round(mean_b, 6) as mean_core, round(log2(mean_a + 1) - log2(mean_b + 1), 6) as log2fc, round(p, 5) as p, round(q, 5) as q from final""")
def interface_expression_ttest(spark, sf):
    d = X.paired_expression(profiles(spark, sf), test="ttest", eps=1.0)
    return d.select("pair", "gene", "n", F.round("mean_a", 6).alias("mean_interface"), F.round("mean_b", 6).alias("mean_core"), F.round("log2fc", 6).alias("log2fc"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query("A8 A17", f"""{_B.replace('with ', 'with recursive ', 1)}, dp(n, s, c) as (select 0, 0, 1.0::double union all
      select n + 1, s + d * (n + 1), sum(c) from dp, (select unnest([0, 1]) as d) where n < 25 group by n + 1, s + d * (n + 1)),
    {_TAG}, {_CX}, {_DEPROF.format(m=3)}, d as (select pair, gene, a - b as d from prof where a - b is not null),
    r as (select pair, gene, d, {Q.avg_rank('pair, gene', 'abs(d)')} as rk, count(*) over (partition by pair, gene, abs(d)) as c from d where d <> 0),
    w as (select pair, gene, count(*) as n, coalesce(sum(rk) filter (d > 0), 0) as w_plus, sum(c * c - 1.0::double) as ties from r group by all),
    z as (select *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - ties / 48.0::double) as z,
      ties = 0 and n <= 25 and n = (select count(*) from d where d.gene = w.gene and d.pair = w.pair) as clean from w),
    e as (select w.pair, w.gene, sum(c) / pow(2, w.n) as tail from w join dp on dp.n = w.n and dp.s <= least(w_plus, w.n * (w.n + 1) / 2 - w_plus) group by w.pair, w.gene, w.n),
    pv as (select pair, gene, case when clean then least(2 * tail, 1) else {Q.normal('z')} end as p from z left join e using (pair, gene)),
    tests as (select m.*, log2(mean_a + 1) - log2(mean_b + 1) as log2fc, p from (select pair, gene, count(*) as n, avg(a) as mean_a, avg(b) as mean_b from prof group by all having count(*) >= 2) m join (select distinct pair, gene from d) using (pair, gene) left join pv using (pair, gene)),
    final as ({Q.bh('pair', 'p')}) select pair, gene, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(log2fc, 6) as log2fc, round(p, 6) as p, round(q, 6) as q from final""")
def interface_expression_signed_rank(spark, sf):
    d = X.paired_expression(profiles(spark, sf), test="wilcoxon", eps=1.0)
    return d.withColumns(r6("mean_a", "mean_b", "log2fc", "p", "q"))


def _contrast_sql(c, to, only="true"):
    """One run of thresholds ``c`` over the pairs that ``only`` selects, as CTEs that end in ``to``."""
    n = to
    return f"""
    tq{n} as (select pair, sample_name, quantile_cont(least(x, y), 0.6) as q from px where {only} group by all),
    tg{n} as (select pair, sample_name, node_idx, 'interface' as layer from px join tq{n} using (pair, sample_name) where least(x, y) >= greatest({c.interface}, q) and abs(x - y) <= 0.25::double
      union all select pair, sample_name, node_idx, 'core' from px where {only} and ((x >= {c.core} and y <= 1 - {c.interface}::double) or (y >= {c.core} and x <= 1 - {c.interface}::double))),
    sz{n} as (select pair, sample_name, least(20, count(*) filter (layer = 'interface'), count(*) filter (layer = 'core')) as take from tg{n} group by all having least(count(*) filter (layer = 'interface'), count(*) filter (layer = 'core')) >= {c.min_cells}),
    tk{n} as (select * from (select t.*, take, row_number() over (partition by pair, sample_name, layer order by md5('1337:' || pair || ':' || node_idx), node_idx) as r from tg{n} t join sz{n} using (pair, sample_name)) where r <= take),
    rw{n} as (select t.pair, t.sample_name, t.layer, c.gene, c.value from tk{n} t join cx c on c.sample_name = t.sample_name and c.node_idx = t.node_idx),
    wq{n} as (select pair, sample_name, layer, gene, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from rw{n} group by all),
    pr{n} as (select pair, sample_name, layer, gene, median(greatest(least(value, hi), lo)) as v from rw{n} join wq{n} using (pair, sample_name, layer, gene) group by all),
    pf{n} as (select pair, sample_name, gene, max(v) filter (layer = 'interface') as a, max(v) filter (layer = 'core') as b from pr{n} group by all having max(v) filter (layer = 'interface') is not null and max(v) filter (layer = 'core') is not null),
    pt{n} as (select pair, gene, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) as t from pf{n} group by all having count(*) >= 3),
    ps{n} as (select *, log2(mean_a + 1) - log2(mean_b + 1) as log2fc, {Q.student('t', '(n - 1)')} as p from pt{n}),
    pk{n} as (select * from ps{n} where p <= {c.p_max} and abs(log2fc) >= {c.min_lfc}),
    {to} as ({Q.bh('pair', 'p').replace('from tests', f'from pk{n}')})"""


_STRICT, _RELAXED = X.Contrast(0.4, 0.25, 6, 0.05, 0.02), X.Contrast(0.3, 0.15, 3, 0.2, 0.01)


@query("A9 P10 P11 X4 U8", f"""{_B}, {_PX}, {_CX}, {_contrast_sql(_STRICT, 'strict')}, {_contrast_sql(_RELAXED, 'relaxed', 'pair not in (select pair from strict)')}
    select pair, gene, n, round(log2fc, 6) as log2fc, round(p, 5) as p, round(q, 5) as q, fallback from (select *, false as fallback from strict union all select *, true from relaxed)""")
def interface_expression_balanced(spark, sf):
    d = X.interface_expression(mixed(spark, sf), "mix", cell_expr(spark, sf), PAIRS, _STRICT, _RELAXED, delta=0.25, quantile=0.6, subsample=20, test="ttest", eps=1.0)
    return d.select("pair", "gene", "n", F.round("log2fc", 6).alias("log2fc"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"), "fallback")


@query("U8 U2", f"""with {MEASURES}, m as (select gene, avg(value) as v from measures group by gene) select gene, round(v, 6) as v, true as fallback from m""")
def relaxed_fallback(spark, sf):
    m = measures(spark, sf).groupBy("gene").agg(F.avg("value").alias("v"))
    return X.with_fallback(m.where("v > 1000"), m.where("v > 0")).withColumns(r6("v"))


@query("G54", f"""{_B}, {_TAG}, s as (select distinct sample_name from cells), p as (select 'P' || i || '_P' || j as pair from pij),
    d as (select pair, sample_name, (select count(*) from tag t where t.pair = p.pair and t.sample_name = s.sample_name and layer = 'interface') as n_interface, (select count(*) from tag t where t.pair = p.pair and t.sample_name = s.sample_name and layer = 'core') as n_core from s, p)
    select *, case when n_interface < 8 and n_core < 8 then 'few_both' when n_interface < 8 then 'few_interface' when n_core < 8 then 'few_core' else 'used' end as reason from d""")
def filter_diagnostics(spark, sf):
    return X.layer_diagnostics(tagged(spark, sf), cells(spark, sf), PAIRS, 8)


@query("G53", f"""{_B}, {_TAG}, d as (select pair, sample_name, count(*) filter (layer = 'interface') as ni, count(*) filter (layer = 'core') as nc from tag group by all)
    select pair, count(*) filter (ni >= 8 and nc >= 8) as samples, coalesce(sum(ni) filter (ni >= 8 and nc >= 8), 0)::bigint as interface_cells, coalesce(sum(nc) filter (ni >= 8 and nc >= 8), 0)::bigint as core_cells from d group by pair""")
def pair_sample_counts(spark, sf):
    return X.pair_totals(X.layer_diagnostics(tagged(spark, sf), cells(spark, sf), PAIRS, 8))


@query("A10", f"""{_B}, {_TAG}, {_CX}, {_DEPROF.format(m=3)}, st as (select distinct case when substr(gene, 2)::int % 2 = 1 then 'odd' else 'even' end as name, gene from prof),
    sm as (select pair, name as gene, sample_name, avg(a) as a, avg(b) as b from prof join st using (gene) group by all),
    pt as (select pair, gene, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) as t from sm group by all having count(*) >= 2), tests as (select *, {Q.student('t', '(n - 1)')} as p from pt), final as ({Q.bh('pair', 'p')})
    select pair, gene as name, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(p, 5) as p, round(q, 5) as q from final""")
def all_gene_set_paired_test(spark, sf):
    return _paired_sets(profiles(spark, sf))


def _paired_sets(prof):
    odd = F.substring("gene", 2, 9).cast("int") % 2 == 1
    sets = prof.select("gene").distinct().select(F.when(odd, "odd").otherwise("even").alias("name"), "gene")
    d = X.paired_expression(X.set_means(prof, sets, ["pair", "sample_name"]), test="ttest", eps=1.0)
    return d.select("pair", F.col("gene").alias("name"), "n", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


_W = """wm as (select {k}, count(*) filter ({f}) as n1, count(*) filter (not ({f})) as n0, avg(value) filter ({f}) as mean1, avg(value) filter (not ({f})) as mean0,
      var_samp(value) filter ({f}) as v1, var_samp(value) filter (not ({f})) as v0 from {t} group by all having count(*) filter ({f}) >= {m} and count(*) filter (not ({f})) >= {m}),
    wt as (select *, (mean1 - mean0) / sqrt(v1 / n1 + v0 / n0) as t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) as df from wm)"""
_WSEL = "n1, n0, round(log2((mean1 + 1e-6) / (mean0 + 1e-6)), 6) as log2fc, round(p, 5) as p, round(q, 5) as q"


def _wsel(df, *keys):
    return df.select(*keys, "n1", "n0", F.round("log2fc", 6).alias("log2fc"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query("A11", f"""with {MEASURES}, x as (select * from measures where layer <> 'interface'), {_W.format(k='prototype_id, gene', f="layer = 'core'", t='x', m=5)},
    tests as (select *, {Q.student('t', 'df')} as p from wt), final as ({Q.bh('prototype_id', 'p')}) select prototype_id, gene, {_WSEL} from final""")
def core_vs_edge_expression(spark, sf):
    m = measures(spark, sf).where("layer <> 'interface'").withColumn("core", (F.col("layer") == "core").cast("int"))
    return _wsel(X.welch_expression(m, ["prototype_id", "gene"], "core", 5, family=["prototype_id"]), "prototype_id", "gene")


@query("A12", f"""with {MEASURES}, x as (select sample_name, label, prototype_id, gene, avg(value) as value from measures group by all having count(*) >= 3), {_W.format(k='prototype_id, gene', f="label = 1", t='x', m=2)},
    tests as (select *, {Q.student('t', 'df')} as p from wt), final as ({Q.bh('prototype_id', 'p')}) select prototype_id, gene, {_WSEL} from final""")
def responder_expression(spark, sf):
    m = X.pseudobulk(measures(spark, sf), ["sample_name", "label", "prototype_id", "gene"], min_rows=3)
    return _wsel(X.welch_expression(m, ["prototype_id", "gene"], "label", 2, family=["prototype_id"]), "prototype_id", "gene")


_OVR = """dom as (select unit, arg_min(prototype_id, struct_pack(n := -n, p := prototype_id)) as d from (select unit, prototype_id, count(*) as n from measures group by all) group by unit),
    x0 as (select unit, d, {g} as gene, avg(value) as value from measures join dom using (unit) group by all), x as (select x0.*, target from x0, (select unnest(range(0, 5))::int as target))"""


def _dominant_units(spark, sf, gene):
    m = spread(measures(spark, sf).select("unit", "prototype_id", F.col(gene).alias("gene"), "value"), ["unit"])
    c = m.groupBy("unit", "prototype_id").agg(F.count(F.lit(1)).alias("n"))
    dom = c.groupBy("unit").agg(F.max_by("prototype_id", F.struct("n", -F.col("prototype_id"))).alias("d"))
    x = m.join(dom, "unit").groupBy("unit", "d", "gene").agg(F.avg("value").alias("value"))
    return X.one_vs_rest(x, "d", range(5))


@query("A13", f"""with {MEASURES}, {_OVR.format(g='gene')}, {_W.format(k='target, gene', f="d = target", t='x', m=3)}, tests as (select *, {Q.student('t', 'df')} as p from wt), final as ({Q.bh('target', 'p')})
    select target, gene, {_WSEL} from final""")
def one_vs_rest_markers(spark, sf):
    return _wsel(X.welch_expression(_dominant_units(spark, sf, "gene"), ["target", "gene"], "flag", 3, family=["target"]), "target", "gene")


@query("A14", f"""with {MEASURES}, {_OVR.format(g='pathway')}, {_W.format(k='target, gene', f="d = target", t='x', m=3)}, tests as (select *, {Q.student('t', 'df')} as p from wt), final as ({Q.bh('target', 'p')})
    select target, gene as pathway, {_WSEL} from final""")
def pathway_differences(spark, sf):
    d = X.welch_expression(_dominant_units(spark, sf, "pathway"), ["target", "gene"], "flag", 3, family=["target"])
    return _wsel(d, "target", "gene").withColumnRenamed("gene", "pathway")


_SPARSE = """cnt as (select unit, gene, ln(1 + sum(value) / any_value(lib) * 10000) as value from measures join (select unit, sum(value) as lib from measures group by 1) using (unit) group by unit, gene),
    cl as (select unit, any_value(cell_type) as cell_type, (unit % 5)::int as proto from measures group by unit),
    mt as (select cl.*, target, (proto = target)::int as flag from cl, (select unnest([0, 2, 4])::int as target)), msz as (select cell_type, target, sum(flag) as c1, sum(1 - flag) as c0 from mt group by all),
    mall as (select mt.cell_type, mt.target, mt.flag, g.gene, coalesce(cnt.value, 0) as value from mt, (select distinct gene from cnt) g left join cnt on cnt.unit = mt.unit and cnt.gene = g.gene)"""


def sparse(spark, sf):
    """(unit, gene, value, cell_type, proto): normalised counts with the class of their unit, written once."""

    def build():
        m = spread(measures(spark, sf).select("unit", "gene", "value", "cell_type"), ["unit"])
        raw = m.groupBy("unit", "gene").agg(F.sum("value").alias("value"))
        c = m.groupBy("unit").agg(F.min("cell_type").alias("cell_type")).withColumn("proto", (F.col("unit") % 5).cast("int"))
        x = X.log_normalize(raw, ["unit"]).select("unit", "gene", F.col("norm").alias("value"))
        return x.join(c, "unit")

    return staged(spark, ("sparse", sf), build)


def sparse_cells(spark, sf):
    def build():
        return sparse(spark, sf).groupBy("unit").agg(F.min("cell_type").alias("cell_type"), F.min("proto").alias("proto"))

    return staged(spark, ("sparse_cells", sf), build)


def sparse_counts(spark, sf):
    return sparse(spark, sf).select("unit", "gene", "value")


def markers(spark, sf):
    def build():
        return X.find_markers(sparse_cells(spark, sf), sparse_counts(spark, sf), ["cell_type"], "proto", [0, 2, 4], 0.0, 0.0)

    return staged(spark, ("markers", sf), build)


_MK = f"""mrk as (select cell_type, target, gene, avg((value > 0)::int) filter (flag = 1) as pct1, avg((value > 0)::int) filter (flag = 0) as pct2,
      log2(avg(exp(value) - 1) filter (flag = 1) + 1) - log2(avg(exp(value) - 1) filter (flag = 0) + 1) as avg_log2fc from mall group by all)"""


@query("A47 P23", f"""with {MEASURES}, {_SPARSE}, {_MK}, rk as (select *, {Q.avg_rank('cell_type, target, gene', 'round(value, 12)')} as rk, count(*) over (partition by cell_type, target, gene, round(value, 12)) as c from mall),
    u as (select cell_type, target, gene, count(*)::double as n, sum(flag)::double as n1, sum(1 - flag)::double as n0, sum(rk * flag) - sum(flag) * (sum(flag) + 1) / 2.0::double as u, sum(c * c - 1.0::double) as ties from rk group by all),
    z as (select cell_type, target, gene, greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) as z from u)
    select cell_type, target, gene, round(pct1, 6) as pct1, round(pct2, 6) as pct2, round(avg_log2fc, 5) as avg_log2fc, round(z, 4) as z, round({Q.normal('z')}, 4) as p from mrk join z using (cell_type, target, gene)""")
def sparse_markers(spark, sf):
    m = markers(spark, sf)
    return m.select("cell_type", "target", "gene", F.round("pct1", 6).alias("pct1"), F.round("pct2", 6).alias("pct2"), F.round("avg_log2fc", 5).alias("avg_log2fc"), F.round("z", 4).alias("z"), F.round("p", 4).alias("p"))


_FIVE = ", ".join(f"abs(c{k})" for k in range(5))


@query("P19 L1 L2", f"""with {MEASURES}, g as (select gene, {', '.join(f"log2(avg(value) filter (prototype_id = {k}) / avg(value) filter (prototype_id <> {k})) as c{k}" for k in range(5))} from measures group by gene)
    select gene, round(greatest({_FIVE}), 6) as effect from g order by greatest({_FIVE}) desc, gene limit 8""")
def top_genes_of_all_prototypes(spark, sf):
    return _top_genes(spark, sf, range(5))


def _top_genes(spark, sf, prototypes):
    avg = lambda c: F.avg(F.when(c, F.col("value")))
    p = F.col("prototype_id")
    g = measures(spark, sf).groupBy("gene").agg(*[F.log2(avg(p == k) / avg(p != k)).alias(f"c{k}") for k in prototypes])
    e = F.greatest(*[F.abs(f"c{k}") for k in prototypes])
    return g.withColumn("effect", e).orderBy(F.desc("effect"), "gene").limit(8).select("gene", F.round("effect", 6).alias("effect"))
