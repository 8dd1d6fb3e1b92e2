"""Queries: survival."""

from pyspark.sql import functions as F

from tilewright.operators import survival as V
from tilewright.plans import tail_sql as Q
from tilewright.plans.registry import query, r6, scaled6
from tilewright.plans.roles import PATIENTS, patients


@query("A31 W7 W6 D2", f"""with {PATIENTS}, c as (select arm, t, count(*) as n, sum(e)::bigint as events from patients group by all),
    r as (select *, (sum(n) over (partition by arm order by t desc))::bigint as at_risk from c)
    select arm, t, at_risk, events, round(case when max((events = at_risk)::int) over w = 1 then 0 else exp(sum(case when events = at_risk then 0 else ln(1 - events / at_risk) end) over w) end, 6) as survival
    from r window w as (partition by arm order by t)""")
def kaplan_meier_curves(spark, sf):
    return V.kaplan_meier(patients(spark, sf), ["arm"]).withColumns(r6("survival"))


_HIGH = "h as (select *, (risk >= (select median(risk) from patients))::int as high from patients)"


@query("A30 W8 A34", f"""with {PATIENTS}, {_HIGH}, c as (select arm, t, count(*) as n, sum(high) as n1, sum(e) as d, sum(e * high) as d1 from h group by all),
    r as (select *, sum(n) over w as r, sum(n1) over w as r1 from c window w as (partition by arm order by t desc)),
    s as (select arm, sum(d1 - d * r1 / r) as diff, sum(case when r > 1 then d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) else 0 end) as var from r where d > 0 group by arm),
    x as (select arm, diff * diff / var as chi2 from s)
    select arm, round(chi2, 6) as chi2, round({Q.chi2('chi2', '1')}, 6) as p from x""")
def log_rank_test(spark, sf):
    return V.log_rank(V.median_split(patients(spark, sf)), "high", ["arm"]).withColumns(r6("chi2", "p"))


@query("A34 G43", f"""with {PATIENTS}, {_HIGH} select case when high = 1 then 'High' else 'Low' end as risk_group, count(*) as n, round(avg(risk), 6) as mean_risk,
      round(avg(t), 6) as mean_time, round(avg(e), 6) as event_rate from h group by 1""")
def risk_group_summary(spark, sf):
    g = V.risk_groups(V.median_split(patients(spark, sf)))
    return g.withColumns(r6("mean_risk", "mean_time", "event_rate"))


@query("A29 P3", f"""with {PATIENTS}, s as (select a.arm, count(*) as comparable, sum((a.risk > b.risk)::int)::bigint as concordant, sum((a.risk = b.risk)::int)::bigint as tied
      from patients a join patients b on a.arm = b.arm and a.t < b.t where a.e = 1 group by a.arm)
    select *, round((concordant + tied / 2) / comparable, 6) as c_index from s""")
def concordance_index(spark, sf):
    return V.concordance(patients(spark, sf), ["arm"]).withColumns(r6("c_index"))


_GRID = f"g as (select unnest(list_distinct(quantile_cont(risk, {[0.1 + 0.8 * i / 99 for i in range(100)]}))) as cut from patients)"


@query("A33 E4", f"""with {PATIENTS}, {_GRID}, m as (select cut, t, e, (risk >= cut)::int as hi from patients, g),
    s as (select cut, count(*) as total, sum(hi) as high from m group by cut),
    c as (select cut, t, count(*) as n, sum(hi) as n1, sum(e) as d, sum(e * hi) as d1 from m group by all),
    r as (select *, coalesce(sum(n) over w, 0) as aft, coalesce(sum(n1) over w, 0) as aft1 from c window w as (partition by cut order by t desc rows between unbounded preceding and 1 preceding)),
    z as (select cut, sum(d1 * (aft - aft1) + d1 * aft1 / 2 + (d - d1) * (aft - aft1) / 2) / sum(d * aft) as score from r group by cut)
    select round(cut, 6) as cut, round(score, 6) as score, high::bigint as high, (total - high)::bigint as low from z join s using (cut) where least(high, total - high) >= greatest(10, total * 0.05)""")
def threshold_search_cindex(spark, sf):
    return V.threshold_search(patients(spark, sf), "cindex", 100).withColumns(scaled6("cut", "score"))


@query("A33 L11", f"""with {PATIENTS}, {_GRID}, m as (select cut, t, e, (risk >= cut)::int as hi from patients, g),
    s as (select cut, count(*) as total, sum(hi) as high from m group by cut),
    c as (select cut, t, count(*) as n, sum(hi) as n1, sum(e) as d, sum(e * hi) as d1 from m group by all),
    r as (select *, sum(n) over w as r, sum(n1) over w as r1 from c window w as (partition by cut order by t desc)),
    z as (select cut, pow(sum(d1 - d * r1 / r), 2) / sum(case when r > 1 then d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) else 0 end) as score from r group by cut),
    f as (select cut, score, high, total - high as low from z join s using (cut) where least(high, total - high) >= greatest(10, total * 0.05))
    select round(cut, 6) as cut, round(score, 6) as score, high::bigint as high, low::bigint as low from f order by round(score, 12) desc, abs(high - low), cut limit 1""")
def best_threshold_logrank(spark, sf):
    return V.best_threshold(V.threshold_search(patients(spark, sf), "logrank", 100)).withColumns(scaled6("cut", "score"))


def _newton(steps):
    """Newton steps of the Efron partial likelihood, unrolled from 0."""
    out = ["base as (select t, risk as x, count(*) as n, sum(e) as d from patients group by all)", "b0 as (select 0.0::double as b, 0.0::double as info)"]
    for i in range(steps):
        w = "exp(b * x)"
        out.append(f"""m{i} as (select t, {', '.join(f'sum(n * {w} * pow(x, {k})) as s{k}, sum(d * {w} * pow(x, {k})) as e{k}' for k in range(3))}, sum(d)::bigint as d, sum(d * x) as dx from base, b{i} group by t),
    r{i} as (select *, {', '.join(f'sum(s{k}) over w as r{k}' for k in range(3))} from m{i} window w as (order by t desc)),
    l{i} as (select dx / d as dx, {', '.join(f'r{k} - l / d::double * e{k} as q{k}' for k in range(3))} from (select *, unnest(range(0, d)) as l from r{i} where d > 0)),
    b{i + 1} as materialized (select b + greatest(-2, least(2, score / fi)) as b, fi as info from b{i}, (select sum(dx - q1 / q0) as score, sum(q2 / q0 - pow(q1 / q0, 2)) as fi from l{i}))""")
    return ",\n    ".join(out)


@query("A32", f"""with {PATIENTS}, {_newton(8)}, z as (select b as coef, 1 / sqrt(info) as se from b8)
    select round(coef, 6) as coef, round(se, 6) as se, round(exp(coef), 6) as hr, round(exp(coef - 1.959963984540054 * se), 6) as low, round(exp(coef + 1.959963984540054 * se), 6) as high, round({Q.normal('coef / se')}, 6) as p from z""")
def cox_single_covariate(spark, sf):
    return V.cox(patients(spark, sf), "risk").withColumns(r6("coef", "se", "hr", "low", "high", "p"))


@query("W15 X5", f"""with {PATIENTS}, q as (select quantile_cont(t, [0.25, 0.5, 0.75]) as e from patients)
    select (len(list_filter(e.e, lambda x: x < t)) || '_' || patients.e) as stratum, count(*) as n from patients, q as e group by 1""")
def quartile_strata(spark, sf):
    from tilewright.operators.sampling import quartile_stratum

    s = quartile_stratum(patients(spark, sf), "t", "e")
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
