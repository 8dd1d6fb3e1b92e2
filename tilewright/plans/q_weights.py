"""Queries: weights of combined features, chosen by cross-validation, and their report."""

from pyspark.sql import functions as F

from tilewright.operators import weights as W
from tilewright.plans import tail_sql as Q
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import staged
from tilewright.session import load

#: Identity, spatial and functional scores of three prototypes; the spatial score of the second counts against.
NINE = ["id0", "id2", "id4", "sp0", "sp2", "sp4", "fn0", "fn2", "fn4"]
SIGNS = dict(zip(NINE, [1, 1, 1, 1, -1, 1, 1, 1, 1], strict=True))
TWO, THREE = ["id4", "sp2"], ["id4", "sp2", "fn0"]

_FEAT = """feat as (select c_custkey as unit, (c_acctbal / 1000 + count(*) / 4.0::double + c_nationkey % 7 > 10)::int as y, c_acctbal / 1000 as id0, sum(o_totalprice) / 100000 as id2,
      count(*)::double as id4, max(o_totalprice) / 100000 as sp0, min(o_totalprice) / 100000 as sp2, avg(o_totalprice) / 100000 as sp4, avg((o_orderstatus = 'F')::int::double) as fn0,
      date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date)::double as fn2, avg(month(o_orderdate)::double) as fn4
    from customer join orders on c_custkey = o_custkey group by c_custkey, c_nationkey, c_acctbal)"""


def features(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    grouped = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey", "c_nationkey", "c_acctbal")
    price = lambda f: (f("o_totalprice") / 100000)
    rows = grouped.agg(
        price(F.sum).alias("id2"), F.count(F.lit(1)).cast("double").alias("id4"), price(F.max).alias("sp0"), price(F.min).alias("sp2"),
        price(F.avg).alias("sp4"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("fn0"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("fn2"), F.avg(F.month("o_orderdate").cast("double")).alias("fn4"),
    )
    y = (F.col("c_acctbal") / 1000 + F.col("id4") / 4 + F.col("c_nationkey") % 7 > 10).cast("int")
    return rows.select(F.col("c_custkey").alias("unit"), y.alias("y"), (F.col("c_acctbal") / 1000).alias("id0"), *NINE[1:])


_KEY = "('0x' || substr(md5('{s}:' || {i}), 1, 13))::bigint"


def _rows_sql(names):
    """Turned features, folds, and the features scaled by the other folds."""
    return f"""{_FEAT}, fold as (select unit, y, [{', '.join(f'{SIGNS[n]} * {n}' for n in names)}] as xs, ((row_number() over (order by {_KEY.format(s=42, i='unit')}, md5('42:' || unit)) - 1) % 5 + 1)::int as fold from feat),
    lng as (select unit, y, fold, f, xs[f] as x from fold, (select unnest(range(1, {len(names) + 1})) as f)),
    md as (select t.fold as fold, l.f, median(x) as mu, stddev_samp(x) as sd from lng l, (select unnest(range(1, 6)) as fold) t where l.fold <> t.fold group by t.fold, l.f),
    ft as (select t.fold, t.f, mu, sd, 1.4826 * median(abs(x - mu)) as mad from md t join lng l on l.f = t.f and l.fold <> t.fold group by all),
    zs as (select unit, y, l.fold, list((x - mu) / (case when mad > 0 then mad when sd > 0 then sd else 1 end) order by l.f) as zs from lng l join ft on ft.fold = l.fold and ft.f = l.f group by all)"""


def _auc_sql(src, keys, to):
    """AUC of column s against y, oriented by the class medians."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""rk{to} as (select *, {Q.avg_rank(keys, 's')} as rk from {src}),
    {to} as (select {', '.join('a.' + k for k in keys.split(', '))}, case when m1 < m0 then 1 - a else a end as auc from
      (select {keys}, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)) as a from rk{to} group by all) a
      join (select {keys}, median(s) filter (y = 1) as m1, median(s) filter (y = 0) as m0 from {src} group by all) b on {on})"""


def _search_sql(names, candidates):
    s = "0 + " + " + ".join(f"w[{i}] * zs[{i}]" for i in range(1, len(names) + 1))
    return f"""{_rows_sql(names)}, cd as materialized ({candidates}), sc as (select fold, cand, y, {s} as s from zs, cd), {_auc_sql('sc', 'fold, cand', 'au')},
    found as materialized (select cand, w, auc from (select cand, avg(auc) as auc from au group by cand) join cd using (cand)),
    best as materialized (select * from found order by round(auc, 12) desc, cand limit 1)"""


_GRID2 = "select i as cand, [i / 100.0::double, (100 - i) / 100.0::double] as w from (select unnest(range(0, 101)) as i)"
_GRID3 = "select i + 101 * j as cand, [i / 100.0::double, j / 100.0::double, (100 - i - j) / 100.0::double] as w from (select unnest(range(0, 101)) as i), (select unnest(range(0, 101)) as j) where i + j <= 100"
_DRAWN = f"""select cand, list_transform(es, lambda e: e / list_sum(es)) as w from (
      select i as cand, [{', '.join(f"-ln(({_KEY.format(s='42d', i=f'i || chr(58) || {k}')} + 1) / {float(16**13 + 1)}::double)" for k in range(9))}] as es from (select unnest(range(0, 2000)) as i))"""


def search(spark, sf, names, candidates, key):
    return staged(spark, (key, sf), lambda: W.weight_search(features(spark, sf), "unit", "y", names, candidates, signs=[SIGNS[n] for n in names]))


def two(spark, sf):
    return search(spark, sf, TWO, W.simplex_grid(spark, 2, 100), "two-weights")


def nine(spark, sf):
    return search(spark, sf, NINE, W.dirichlet_candidates(spark, 9, 2000), "nine-weights")


@query("A49 L11", f"with {_search_sql(TWO, _GRID2)} select cand, round(auc, 6) as auc from found")
def two_feature_weights(spark, sf):
    return two(spark, sf).select("cand", F.round("auc", 6).alias("auc"))


@query("A49 L11", f"with {_search_sql(TWO, _GRID2)} select cand, w[1] as w0, round(auc, 6) as auc from best")
def chosen_two_feature_weights(spark, sf):
    return W.best_candidate(two(spark, sf)).select("cand", F.col("w")[0].alias("w0"), F.round("auc", 6).alias("auc"))


@query("A50", f"with {_search_sql(THREE, _GRID3)} select cand, round(auc, 6) as auc, cand = (select cand from best) as chosen from found")
def three_feature_weights(spark, sf):
    found = search(spark, sf, THREE, W.simplex_grid(spark, 3, 100), "three-weights")
    chosen = W.best_candidate(found).select("cand").scalar()
    return found.select("cand", F.round("auc", 6).alias("auc"), (F.col("cand") == chosen).alias("chosen"))


@query("A51 E4", f"with {_search_sql(NINE, _DRAWN)} select cand, round(auc, 6) as auc from found")
def random_simplex_weights(spark, sf):
    return nine(spark, sf).select("cand", F.round("auc", 6).alias("auc"))


_ALL = f"""al as (select unit, y, f, xs[f] as x from fold, (select unnest(range(1, 10)) as f)), am as (select f, median(x) as mu, stddev_samp(x) as sd from al group by f),
    ad as (select f, mu, sd, 1.4826 * median(abs(x - mu)) as mad from al join am using (f) group by all),
    az as (select unit, y, f, (x - mu) / (case when mad > 0 then mad when sd > 0 then sd else 1 end) as z from al join ad using (f)),
    combos as (select unit, y, ({NINE})[f] as combo, round(z, 9) as s from az union all
      select unit, y, 'equal', round(sum(1 / 9.0::double * z), 9) from az group by unit, y union all select unit, y, 'tuned', round(sum(w[f] * z), 9) from az, best group by unit, y)"""


@query("A51 A53", f"""with {_search_sql(NINE, _DRAWN)}, {_ALL}, {_auc_sql('combos', 'combo', 'full_auc')}
    select ({NINE})[f] as feature, round(w[f], 6) as weight, round(auc, 6) as auc_cv, (select round(auc, 5) from full_auc where combo = 'tuned') as auc_full from best, (select unnest(range(1, 10)) as f)""")
def chosen_nine_feature_weights(spark, sf):
    t = W.tuned(features(spark, sf), "unit", "y", NINE, nine(spark, sf), [SIGNS[n] for n in NINE])
    return t.select("feature", F.round("weight", 6).alias("weight"), F.round("auc_cv", 6).alias("auc_cv"), F.round("auc_full", 5).alias("auc_full"))


@query("A53", f"""with {_search_sql(NINE, _DRAWN)}, {_ALL}, c as (select combo, s, sum(y) as n1, sum(1 - y) as n0 from combos group by all),
    r as (select *, sum(n1) over w as c1, sum(n0) over w as c0, sum(n1) over g as t1, sum(n0) over g as t0 from c window w as (partition by combo order by s), g as (partition by combo)),
    p as (select combo, n1, n0, t1, t0, (c0 - n0 / 2.0::double) / t0 as v1, (t1 - c1 + n1 / 2.0::double) / t1 as v0 from r),
    q as (select combo, max(t1) as n1, max(t0) as n0, sum(n1 * v1) / max(t1) as a, sum(n1 * v1 * v1) as q1, sum(n0 * v0 * v0) as q0 from p group by combo),
    d as (select q.combo, case when m1 < m0 then 1 - a else a end as auc, m1 < m0 as down, sqrt((q1 - n1 * a * a) / (n1 - 1) / n1 + (q0 - n0 * a * a) / (n0 - 1) / n0) as se from q
      join (select combo, median(s) filter (y = 1) as m1, median(s) filter (y = 0) as m0 from combos group by combo) using (combo))
    select combo, round(auc, 5) as auc, round(greatest(auc - 1.959963984540054 * se, 0), 5) as auc_low, round(least(auc + 1.959963984540054 * se, 1), 5) as auc_high, case when down then '>' else '<' end as direction from d""")
def combination_report(spark, sf):
    best = W.best_candidate(nine(spark, sf)).first()
    rows = W.signed(features(spark, sf), NINE, [SIGNS[n] for n in NINE])
    r = W.combination_report(rows, "unit", "y", NINE, {"equal": [1 / 9] * 9, "tuned": best["w"]})
    return r.select("combo", *[F.round(c, 5).alias(c) for c in ("auc", "auc_low", "auc_high")], "direction")


def _net_sql(steps=60, penalty=0.02):
    x = range(1, 10)
    line = "ahead[1] + " + " + ".join(f"ahead[{j + 1}] * x[{j}]" for j in x)
    grad = "[sum(w * (p - y)) / sum(w), " + ", ".join(f"sum(w * (p - y) * x[{j}]) / sum(w)" for j in x) + "]"
    step = lambda j: f"(1 / (2.5::double * m2[{j}] + {penalty} * (1 - a)))"
    new = "[ahead[1] - grad[1] / 2.5::double, " + ", ".join(
        f"greatest(ahead[{j + 1}] - {step(j)} * (grad[{j + 1}] + {penalty} * (1 - a) * ahead[{j + 1}]) - {step(j)} * {penalty} * a, 0)" for j in x
    ) + "]"
    plain = _rows_sql(NINE).replace("-1 * sp2", "1 * sp2")
    return f"""with recursive {plain}, {_ALL.split('combos as')[0].rstrip().rstrip(',')},
    rws as materialized (select y, fold, case when y = 1 then 0.5::double / (select sum(y) from feat) else 0.5::double / (select sum(1 - y) from feat) end as w, list(z order by f) as x from az join (select unit, fold from fold) using (unit) group by unit, y, fold),
    mo as materialized (select [{', '.join(f'sum(w * x[{j}] * x[{j}]) / sum(w)' for j in x)}] as m2 from rws),
    g(i, h, a, now, before) as (select 0, h, a / 10.0::double, [{', '.join(['0.0::double'] * 10)}], [{', '.join(['0.0::double'] * 10)}] from (select unnest(range(0, 6)) as h), (select unnest(range(0, 11)) as a)
      union all select i + 1, h, a, {new}, now from (
        select i, h, a, now, ahead, {grad} as grad from (
          select t.*, r.w, r.y, r.x, 1 / (1 + exp(-({line}))) as p from (
            select *, list_transform(list_zip(now, before), lambda v: v[1] + i / (i + 3.0::double) * (v[1] - v[2])) as ahead from g where i < {steps}) t join rws r on r.fold <> t.h)
        group by i, h, a, now, ahead), mo),
    fin as materialized (select h, a, now[2:] as b from g where i = {steps}),
    sc as (select fold, a as alpha, y, round(0 + {' + '.join(f'b[{j}] * x[{j}]' for j in x)}, 9) as s from rws join fin on h = fold), {_auc_sql('sc', 'fold, alpha', 'au')},
    best as (select alpha, avg(auc) as auc from au group by alpha order by round(avg(auc), 9) desc, alpha limit 1)
    select ({NINE})[f] as feature, round(case when list_sum(b) > 0 then b[f] / list_sum(b) else 1 / 9.0::double end, 5) as weight, alpha, round(auc, 5) as auc_cv
    from best join fin on h = 0 and a = alpha, (select unnest(range(1, 10)) as f)"""


@query("A52", _net_sql())
def elastic_net_weights(spark, sf):
    return W.elastic_net(features(spark, sf), "unit", "y", NINE).withColumns(r6("weight", "auc_cv", digits=5))
