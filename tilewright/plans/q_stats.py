"""Queries: ranks, tests, effect sizes, agreement."""

from pyspark.sql import functions as F

from tilewright.operators import ordered as O
from tilewright.operators import stats as S
from tilewright.plans import tail_sql as Q
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, MEASURES, cells, measures
from tilewright.session import load

_RANKED = f"ranked as (select *, {Q.avg_rank('gene', 'value')} as rk, count(*) over (partition by gene, value) as c from measures)"


@query("W2 W16", f"""with {MEASURES}, {_RANKED}
    select gene, unit, line, round(rk, 6) as avg_rank, round((rk - 1) / (count(*) over (partition by gene) - 1), 6) as unit_rank from ranked""")
def average_ranks(spark, sf):
    m = measures(spark, sf).select("gene", "unit", "line", "value")
    ranked = O.unit_ranks(O.attach_ranks(m, ["gene"], "value").drop("avg_rank_n"), ["gene"], "value")
    return ranked.select("gene", "unit", "line", F.round("avg_rank", 6).alias("avg_rank"), F.round("unit_rank", 6).alias("unit_rank"))


@query("W1", f"""with {MEASURES} select gene, unit, line, round((value - avg(value) over (partition by gene)) / (stddev_samp(value) over (partition by gene) + 1e-9), 6) as z,
    round(value - avg(value) over (partition by gene, cell_type), 6) as residual from measures""")
def group_zscores(spark, sf):
    m = measures(spark, sf).select("gene", "unit", "line", "value", "cell_type")
    z = O.group_zscore(m, ["gene"], "value")
    mean = m.groupBy("gene", "cell_type").agg(F.avg("value").alias("_m"))
    return z.join(mean, ["gene", "cell_type"]).select(
        "gene", "unit", "line", F.round("z", 6).alias("z"), F.round(F.col("value") - F.col("_m"), 6).alias("residual")
    )


@query("W5 F39", f"""with {MEASURES} select sample_name, unit, line, round(case when max(weight) over w > min(weight) over w
    then (weight - min(weight) over w) / (max(weight) over w - min(weight) over w) else 1.0::double end, 6) as scaled,
    round(case when max(weight) over w > min(weight) over w
    then 1 - (weight - min(weight) over w) / (max(weight) over w - min(weight) over w) else 0.5::double end, 6) as inverse
    from measures window w as (partition by sample_name)""")
def minmax_in_group(spark, sf):
    m = measures(spark, sf).select("sample_name", "unit", "line", "weight")
    both = O.group_minmax(m, ["sample_name"], "weight", "scaled")
    both = O.group_minmax(both, ["sample_name"], "weight", "inverse", 0.5, invert=True)
    return both.drop("weight").withColumns(r6("scaled", "inverse"))


@query("W11", """select o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as last_order,
      arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as first_order from orders group by o_custkey""")
def first_and_last_rows(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    last = O.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True)
    first = O.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.select("o_custkey", F.col("o_orderkey").alias("last_order")).join(
        first.select("o_custkey", F.col("o_orderkey").alias("first_order")), "o_custkey"
    )


@query("W12", "select *, row_number() over (partition by l_suppkey order by key) - 1 as ordinal from (select l_suppkey, l_orderkey * 100 + l_linenumber as key, min(l_quantity) as q from lineitem group by all)")
def row_ordinals(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    one = li.groupBy("l_suppkey", "key").agg(F.min("l_quantity").alias("q"))
    return O.numbered(one, ["l_suppkey"], "key").select("l_suppkey", "key", "q", "ordinal")


@query("A16 A11 A12", f"""with {MEASURES}, m as (select gene, count(*) filter (label = 1) as n1, count(*) filter (label = 0) as n0,
      avg(value) filter (label = 1) as mean1, avg(value) filter (label = 0) as mean0,
      var_samp(value) filter (label = 1) as v1, var_samp(value) filter (label = 0) as v0 from measures group by gene),
    t as (select *, (mean1 - mean0) / sqrt(v1 / n1 + v0 / n0) as t,
      pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) as df from m)
    select gene, n1, n0, round(mean1, 6) as mean1, round(mean0, 6) as mean0, round(t, 6) as t, round(df, 4) as df, round({Q.student('t', 'df')}, 6) as p from t""")
def welch_test(spark, sf):
    w = S.welch(measures(spark, sf), ["gene"], "value", "label")
    return w.withColumns(r6("mean1", "mean0", "t", "p")).withColumn("df", F.round("df", 4))


_MWU = """mwu as (select {k}, n1, n0, u, u / (n1 * n0) as auc,
      greatest(abs(u - n1 * n0 / 2.0::double) - 0.5, 0) / sqrt(n1 * n0 / 12.0::double * (n + 1 - ties / (n * (n - 1.0::double)))) as z from (
      select {k}, count(*) as n, sum({f}) as n1, sum(1 - {f}) as n0, sum(rk * {f}) - sum({f}) * (sum({f}) + 1) / 2.0::double as u,
        sum(c * c - 1.0::double) as ties from {t} group by {k}))"""


@query("A15 A28", f"""with {MEASURES}, both_ as (select *, unnest(['ALL', cohort]) as scope from measures),
    ranked as (select *, {Q.avg_rank('gene, scope', 'value')} as rk, count(*) over (partition by gene, scope, value) as c from both_),
    {_MWU.format(k='gene, scope', f='label', t='ranked')},
    tests as (select *, {Q.normal('z')} as p from mwu), final as ({Q.bh('', 'p')}),
    means as (select gene, scope, avg(value) filter (label = 1) as mean1, avg(value) filter (label = 0) as mean0 from both_ group by all)
    select gene, scope, n1::bigint as n1, n0::bigint as n0, round(u, 2) as u, round(auc, 6) as auc, round(z, 6) as z, round(p, 6) as p,
      round(mean1, 6) as mean1, round(mean0, 6) as mean0, round(q, 6) as q from final join means using (gene, scope)""")
def mann_whitney_all_and_cohort(spark, sf):
    t = S.mann_whitney_by_cohort(measures(spark, sf), "gene", "cohort", "value", "label")
    return t.withColumns(r6("auc", "z", "p", "mean1", "mean0", "q")).withColumn("u", F.round("u", 2))


@query("A28 F53 W9", f"""with {MEASURES}, {_RANKED}, {_MWU.format(k='gene', f='label', t='ranked')},
    tests as (select *, {Q.normal('z')} as p from mwu), final as ({Q.bh('', 'p')})
    select gene, round(p, 6) as p, round(q, 6) as q, case when q < 0.001 then '***' when q < 0.01 then '**' when q < 0.05 then '*' else 'ns' end as stars from final""")
def group_comparison_stars(spark, sf):
    from tilewright.functions.scores import stars

    t = O.fdr(S.mann_whitney(measures(spark, sf), ["gene"], "value", "label"), [])
    return t.select("gene", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), stars(F.col("q")).alias("stars"))


@query("A23 A36", f"""with {MEASURES}, {_RANKED}
    select gene, sum(label)::bigint as n1, sum(1 - label)::bigint as n0,
      round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label)), 6) as auc from ranked group by gene""")
def auc_per_gene(spark, sf):
    return S.roc_auc(measures(spark, sf), ["gene"], "value", "label").withColumns(r6("auc"))


@query("A24 W17", f"""with {MEASURES}, c as (select gene, value, sum(label) as n1, sum(1 - label) as n0 from measures group by all),
    r as (select *, sum(n1) over w as tp, sum(n0) over w as fp, sum(n1) over (partition by gene) as tpa from c window w as (partition by gene order by value desc))
    select gene, round(sum(n1 / tpa * tp / (tp + fp)), 6) as average_precision from r group by gene""")
def precision_recall_area(spark, sf):
    return S.average_precision(measures(spark, sf), ["gene"], "value", "label").withColumns(r6("average_precision"))


@query("W17", f"""with {MEASURES}, c as (select gene, value, sum(label) as n1, sum(1 - label) as n0 from measures group by all)
    select gene, value, round(sum(n1) over w / sum(n1) over (partition by gene), 6) as tpr, round(sum(n0) over w / sum(n0) over (partition by gene), 6) as fpr,
      round(sum(n1) over w / (sum(n1) over w + sum(n0) over w), 6) as precision from c window w as (partition by gene order by value desc)""")
def roc_points(spark, sf):
    return S.roc_curve(measures(spark, sf), ["gene"], "value", "label").withColumns(r6("tpr", "fpr", "precision"))


_AUC_CI = f"""c as (select gene, value, sum(label) as n1, sum(1 - label) as n0 from measures group by all),
    r as (select *, sum(n1) over w as c1, sum(n0) over w as c0, sum(n1) over g as t1, sum(n0) over g as t0 from c
      window w as (partition by gene order by value), g as (partition by gene)),
    p as (select gene, n1, n0, t1, t0, (c0 - n0 / 2.0::double) / t0 as v1, (t1 - c1 + n1 / 2.0::double) / t1 as v0 from r),
    s as (select gene, max(t1) as n1, max(t0) as n0, sum(n1 * v1) / max(t1) as a, sum(n1 * v1 * v1) as q1, sum(n0 * v0 * v0) as q0 from p group by gene),
    d as (select s.*, sqrt((q1 - n1 * a * a) / (n1 - 1) / n1 + (q0 - n0 * a * a) / (n0 - 1) / n0) as se, m1 < m0 as down from s
      join (select gene, median(value) filter (label = 1) as m1, median(value) filter (label = 0) as m0 from measures group by gene) using (gene)),
    auc as (select gene, n1::bigint as n1, n0::bigint as n0, case when down then 1 - a else a end as auc, case when down then '>' else '<' end as direction,
      ((case when down then 1 - a else a end) - 0.5) / se as z, se from d)"""


@query("A25", f"""with {MEASURES}, {_AUC_CI}
    select gene, n1, n0, round(auc, 6) as auc, round(greatest(auc - 1.959963984540054 * se, 0), 6) as auc_low, round(least(auc + 1.959963984540054 * se, 1), 6) as auc_high,
      direction, round(z, 6) as z, round({Q.normal('z')}, 6) as p from auc""")
def auc_with_interval(spark, sf):
    return S.auc_interval(measures(spark, sf), ["gene"], "value", "label").withColumns(r6("auc", "auc_low", "auc_high", "z", "p"))


_SPEAR = f"""rk as (select gene, label, {Q.avg_rank('gene', 'value')} as rx, {Q.avg_rank('gene', 'label')} as ry from measures),
    rho as (select gene, corr(rx, ry) as rho from rk group by gene)"""


@query("A26 A27 F51", f"""with {MEASURES}, {_AUC_CI}, {_SPEAR}, tests as (select auc.*, rho, {Q.normal('z')} as p from auc join rho using (gene)), final as ({Q.bh('', 'p')})
    select gene, n1, n0, round(auc, 6) as auc, round(greatest(auc - 1.959963984540054 * se, 0), 6) as auc_low, round(least(auc + 1.959963984540054 * se, 1), 6) as auc_high,
      direction, round(z, 6) as z, round(p, 6) as p, round(rho, 6) as rho, round(2 * auc - 1, 6) as rank_biserial, round(q, 6) as q from final""")
def association_table(spark, sf):
    t = S.association(measures(spark, sf), ["gene"], "value", "label")
    return t.withColumns(r6("auc", "auc_low", "auc_high", "z", "p", "rho", "rank_biserial", "q"))


@query("G49 P22", f"""with {MEASURES}, {_AUC_CI}, {_SPEAR}
    select left(gene, 6) as prototype, round(max(abs(2 * auc - 1)), 6) as best_rb, round(max(auc), 6) as best_auc, round(max(abs(rho)), 6) as best_rho, count(*) filter (auc >= 0.5) as strong
    from auc join rho using (gene) group by 1""")
def evidence_per_prototype(spark, sf):
    t = S.association(measures(spark, sf), ["gene"], "value", "label")
    return t.groupBy(F.left("gene", F.lit(6)).alias("prototype")).agg(
        F.round(F.max(F.abs("rank_biserial")), 6).alias("best_rb"),
        F.round(F.max("auc"), 6).alias("best_auc"),
        F.round(F.max(F.abs("rho")), 6).alias("best_rho"),
        F.count_if(F.col("auc") >= 0.5).alias("strong"),
    )


_PROFILE = """profile as (select sample_name, gene, avg(value) filter (layer = 'interface') as a, avg(value) filter (layer = 'core') as b from measures group by all)"""


def _profile(spark, sf):
    on = lambda layer: F.avg(F.when(F.col("layer") == layer, F.col("value")))
    return measures(spark, sf).groupBy("sample_name", "gene").agg(on("interface").alias("a"), on("core").alias("b"))


@query("A18", f"""with {MEASURES}, {_PROFILE}, m as (select gene, count(a - b) as n, avg(a - b) as mean_diff, stddev_samp(a - b) as sd from profile group by gene),
    t as (select *, mean_diff / (sd / sqrt(n)) as t from m)
    select gene, n, round(mean_diff, 6) as mean_diff, round(sd, 6) as sd, round(t, 6) as t, round({Q.student('t', '(n - 1)')}, 6) as p_t, round({Q.normal('t')}, 6) as p_z from t""")
def paired_t_and_z(spark, sf):
    return S.paired_t(_profile(spark, sf), ["gene"], "a", "b").withColumns(r6("mean_diff", "sd", "t", "p_t", "p_z"))


@query("A17 E2", f"""with recursive dp(n, s, c) as (select 0, 0, 1.0::double union all
      select n + 1, s + d * (n + 1), sum(c) from dp, (select unnest([0, 1]) as d) where n < 25 group by n + 1, s + d * (n + 1)),
    {MEASURES}, {_PROFILE}, d as (select gene, a - b as d from profile where a - b is not null),
    r as (select gene, d, {Q.avg_rank('gene', 'abs(d)')} as rk, count(*) over (partition by gene, abs(d)) as c from d where d <> 0),
    w as (select gene, count(*) as n, sum(rk) filter (d > 0) as w_plus, sum(c * c - 1.0::double) as ties from r group by gene),
    z as (select *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - ties / 48.0::double) as z,
      ties = 0 and n = (select count(*) from d where d.gene = w.gene) as clean from w),
    e as (select w.gene, sum(c) / pow(2, w.n) as tail from w join dp on dp.n = w.n and dp.s <= least(w_plus, w.n * (w.n + 1) / 2 - w_plus) group by w.gene, w.n)
    select gene, (select count(*) from d where d.gene = w.gene) as pairs, w.n, round(w_plus, 2) as w_plus,
      round(case when clean then least(2 * tail, 1) else {Q.normal('z')} end, 6) as p from z as w join e using (gene)""")
def signed_rank_test(spark, sf):
    return S.signed_rank(_profile(spark, sf), ["gene"], "a", "b").withColumns(r6("p")).withColumn("w_plus", F.round("w_plus", 2))


_KW = f"""r as (select gene, cell_type, value, {Q.avg_rank('gene', 'value')} as rk, count(*) over (partition by gene, value) as c from measures),
    k as (select gene, cell_type, count(*) as n, sum(rk) as rs, sum(c * c - 1.0::double) as tie from r group by all),
    g as (select gene, sum(n) as total, sum(tie) as ties, count(*) as classes, sum(rs * rs / n) as ss from k group by gene)"""


@query("A19", f"""with {MEASURES}, {_KW}, h as (select gene, classes, total::bigint as n, (12.0::double / (total * (total + 1)) * ss - 3 * (total + 1)) / (1 - ties / (pow(total, 3) - total)) as h from g)
    select gene, classes, n, round(h, 6) as h, round({Q.chi2('h', '(classes - 1)')}, 6) as p from h""")
def kruskal_wallis(spark, sf):
    return S.kruskal(measures(spark, sf), ["gene"], "value", "cell_type").withColumns(r6("h", "p"))


@query("A20", f"""with {MEASURES}, {_KW}, tests as (select a.gene, a.cell_type as a, b.cell_type as b,
      (a.rs / a.n - b.rs / b.n) / sqrt((total * (total + 1) / 12.0::double - ties / (12 * (total - 1))) * (1.0::double / a.n + 1.0::double / b.n)) as z
      from k a join k b on a.gene = b.gene and a.cell_type < b.cell_type join g on g.gene = a.gene),
    t2 as (select *, {Q.normal('z')} as p from tests), final as ({Q.bh('gene', 'p').replace('from tests', 'from t2')})
    select gene, a, b, round(z, 6) as z, round(p, 6) as p, round(q, 6) as q from final""")
def dunn_pairs(spark, sf):
    return S.dunn(measures(spark, sf), ["gene"], "value", "cell_type").withColumns(r6("z", "p", "q"))


@query("A21", f"""with {MEASURES}, rk as (select gene, {Q.avg_rank('gene', 'value')} as rx, {Q.avg_rank('gene', 'weight')} as ry from measures)
    select gene, count(*) as n, round(corr(rx, ry), 6) as rho from rk group by gene""")
def spearman_correlation(spark, sf):
    return S.spearman(measures(spark, sf), ["gene"], "value", "weight").withColumns(r6("rho"))


@query("A22", f"""with {MEASURES} select gene, round(corr(value, weight), 6) as r from measures group by gene having stddev_pop(value) >= 1e-6 and stddev_pop(weight) >= 1e-6""")
def pearson_per_gene(spark, sf):
    return S.pearson_per_gene(measures(spark, sf), "gene", "value", "weight").withColumns(r6("r"))


@query("A22", f"""with {MEASURES} select round(avg(r), 6) as mean_r from (select gene, corr(value, weight) as r from measures group by gene)""")
def pearson_mean(spark, sf):
    return S.pearson_per_gene(measures(spark, sf), "gene", "value", "weight").agg(F.round(F.avg("r"), 6).alias("mean_r"))


@query("A54 J14 E7", f"""with {MEASURES}, u as (select distinct p_partkey as gene from part), h as (select distinct p_partkey as gene from part where p_retailprice > 970 or p_brand like 'Brand#1%'),
    s as (select distinct p_brand as name, p_partkey as gene from part union all select distinct 'Name ' || p_name, p_partkey from part),
    o as (select name, count(*) as set_size, count(h.gene) as overlap from s left join h using (gene) group by name),
    tests as (select *, {Q.hypergeom('overlap', 'drawn', 'set_size', 'universe')} as p from (select *, (select count(*) from h) as drawn, (select count(*) from u) as universe from o)),
    final as ({Q.bh('', 'p')})
    select name, set_size, overlap, drawn, universe, round(log10(p), 4) as log10_p, round(q, 6) as q from final""")
def over_representation(spark, sf):
    p = load(spark, sf, "part").withColumn("gene", F.col("p_partkey"))
    sets = p.select(F.explode(F.array("p_brand", F.concat(F.lit("Name "), F.col("p_name")))).alias("name"), "gene")
    t = S.over_representation(p.where("p_retailprice > 970 or p_brand like 'Brand#1%'"), sets, p)
    log = F.when(F.col("p") == 0, float("-inf")).otherwise(F.log10("p"))  # Spark has null for the logarithm of a p below the smallest double
    return t.select("name", "set_size", "overlap", "drawn", "universe", F.round(log, 4).alias("log10_p"), F.round("q", 6).alias("q"))


_PAIR = "pair as (select event_id % 5 as t, (event_id + case when value > 40 then user_id else 0 end) % 5 as p from events)"


@query("A35", f"""with {_PAIR}, c as (select t, p, count(*) as n from pair group by all), tot as (select sum(n) as n from c),
    per as (select k, coalesce(sum(nt), 0) as nt, coalesce(sum(np), 0) as np, coalesce(sum(tp), 0) as tp from (
      select t as k, n as nt, 0 as np, case when t = p then n else 0 end as tp from c union all select p, 0, n, 0 from c) group by k),
    e as (select sum(a.nt * b.np / (select n from tot)::double * pow(a.k - b.k, 2)) as expected, sum(case when a.k = b.k then a.nt * b.np else 0 end) / pow((select n from tot), 2) as pe from per a, per b)
    select round((select sum(tp) from per) / (select n from tot), 6) as accuracy, round((select avg(tp / nt) from per where nt > 0), 6) as balanced_accuracy,
      round(((select sum(tp) from per) / (select n from tot) - pe) / (1 - pe), 6) as kappa,
      round(1 - (select sum(n * pow(t - p, 2)) from c) / expected, 6) as quadratic_kappa,
      round((select sum(nt * 2 * tp / (nt + np)) from per) / (select n from tot), 6) as weighted_f1 from e""")
def classification_metrics(spark, sf):
    e = load(spark, sf, "events")
    pair = e.select(
        (F.col("event_id") % 5).alias("t"),
        ((F.col("event_id") + F.when(F.col("value") > 40, F.col("user_id")).otherwise(0)) % 5).alias("p"),
    )
    r = S.classification_report(pair, "t", "p")
    return r.withColumns(r6(*r.columns))


@query("A35", f"""with {CELLS}, c as (select prototype_id as y, embedding from cells), k as (select unnest(range(0, 5))::int as a),
    d as (select ka.a, kb.a as b, embedding[ka.a + 1] as s, (y = ka.a)::int as f from c, k ka, k kb where ka.a <> kb.a and (y = ka.a or y = kb.a)),
    r as (select *, {Q.avg_rank('a, b', 's')} as rk from d)
    select round(avg(auc), 6) as macro_ovo_auc from (select a, b, (sum(rk * f) - sum(f) * (sum(f) + 1) / 2.0::double) / (sum(f) * sum(1 - f)) as auc from r group by a, b)""")
def macro_one_vs_one_auc(spark, sf):
    return S.one_vs_one_auc(cells(spark, sf), "prototype_id", "embedding", range(5)).withColumns(r6("macro_ovo_auc"))


@query("A36", f"""with c as (select quality as y, n_chars / (n_chars + 1000.0::double) as p from labels join documents using (doc_id)), r as (select *, {Q.avg_rank('', 'p')} as rk from c)
    select round(avg(((p > 0.5)::int = y)::int), 6) as accuracy, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)), 6) as auc from r""")
def accuracy_at_half(spark, sf):
    c = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    c = c.select(F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))
    return S.threshold_accuracy(c, "p", "y").withColumns(r6("accuracy", "auc"))


@query("F38 F35 W13", f"""with {MEASURES}, q as (select gene, quantile_cont(value, 0.05) as l, quantile_cont(value, 0.95) as h from measures group by gene)
    select gene, unit, line, round(greatest(least(value, h), l), 6) as winsor, round(least(greatest((value - l) / greatest(h - l, 1e-6), 0), 1), 6) as clipped,
      round(case when h - l < 1e-8 then 0 else least(greatest((value - l) / (h - l + 1e-8), 0), 1) end, 6) as stretched from measures join q using (gene)""")
def winsorise_and_clip(spark, sf):
    from tilewright.functions.scores import clip01, stretch01

    m = O.with_quantiles(measures(spark, sf).select("gene", "unit", "line", "value"), ["gene"], "value", [0.05, 0.95])
    lo, hi, v = F.col("q")[0], F.col("q")[1], F.col("value")
    return m.select(
        "gene", "unit", "line",
        F.round(F.greatest(F.least(v, hi), lo), 6).alias("winsor"),
        F.round(clip01(v, lo, hi), 6).alias("clipped"),
        F.round(stretch01(v, lo, hi), 6).alias("stretched"),
    )


@query("F36", f"""with {MEASURES}, q as (select gene, median(value) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from measures group by gene)
    select gene, unit, line, round((value - m) / case when iqr = 0 then 1 else iqr end, 6) as scaled from measures join q using (gene)""")
def robust_scale(spark, sf):
    from tilewright.operators.expression import robust_scale as scale

    m = measures(spark, sf).select("gene", "unit", "line", "value")
    return scale(m, ["gene"], "value").select("gene", "unit", "line", F.round("scaled", 6).alias("scaled"))


@query("F37", f"""with {MEASURES}, q as (select gene, median(value) as m, stddev_samp(value) as sd from measures group by gene),
    a as (select gene, m, sd, 1.4826 * median(abs(value - m)) as mad from measures join q using (gene) group by gene, m, sd)
    select gene, unit, line, round((value - m) / (case when mad > 0 then mad when sd > 0 then sd else 1 end), 6) as z from measures join a using (gene)""")
def robust_zscores(spark, sf):
    from tilewright.operators.expression import robust_z

    m = measures(spark, sf).select("gene", "unit", "line", "value")
    return robust_z(m, ["gene"], "value").select("gene", "unit", "line", F.round("z", 6).alias("z"))
