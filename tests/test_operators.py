"""Operators against brute force and hand-computed fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import tails
from tilewright.operators import expression, lookup, neighbors, ordered, prototypes, sampling, stats, survival, thinning


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_knn(pts, k):
    out = {}
    for g, i, x, y in pts:
        near = sorted(((x - b) ** 2 + (y - c) ** 2, j) for h, j, b, c in pts if h == g and j != i)
        out[(g, i)] = [j for _, j in near[:k]]
    return out


def check_knn(spark, pts, k):
    df = spark.createDataFrame(pts, "g string, node_idx long, pos_x double, pos_y double")
    got = {}
    for r in neighbors.knn_join(df, k, ["g"]).orderBy("rank").collect():
        got.setdefault((r.g, r.src), []).append(r.dst)
    want = {k_: v for k_, v in brute_knn(pts, k).items() if v}
    assert got == want


def test_knn_lattice_with_copy_and_small_group(spark):
    pts = [("a", 5 * i + j, float(i), float(j)) for i in range(5) for j in range(5)] + [("a", 99, 2.0, 2.0), ("b", 1, 0.0, 0.0), ("b", 2, 3.0, 4.0)]
    check_knn(spark, pts, 4)


def test_knn_skewed_density_and_pile_of_copies(spark):
    rnd = random.Random(3)
    pts = [("a", i, rnd.gauss(0, 1e-4), rnd.gauss(0, 1e-4)) for i in range(150)]
    pts += [("a", 1000 + i, 7.0, 7.0) for i in range(120)]  # a third of the rows at one point
    pts += [("a", 2000 + i, rnd.uniform(-1e5, 1e5), rnd.uniform(-1e5, 1e5)) for i in range(60)]
    check_knn(spark, pts, 6)


def test_between_and_radius_match_brute_force(spark):
    rnd = random.Random(5)
    a = [("s", i, rnd.random() * 10, rnd.random() * 10) for i in range(60)]
    b = [("s", 100 + i, rnd.random() ** 3 * 10, rnd.random() * 10) for i in range(40)]
    schema = "g string, node_idx long, pos_x double, pos_y double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {(r.src, r.rank): r.dst for r in neighbors.knn_between(da, db, 3, ["g"]).collect()}
    for _, i, x, y in a:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for _, j, u, v in b)[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == [j for _, j in near]
    pairs = {(r.src, r.dst) for r in neighbors.within_radius(da, db, 2.0, ["g"]).collect()}
    assert pairs == {(i, j) for _, i, x, y in a for _, j, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= 4.0}


def test_running_equals_sorted_cumulation_under_skew(spark):
    rnd = random.Random(1)
    data = [("hot", float(rnd.randint(0, 500)), 1) for _ in range(900)] + [(f"g{i % 20}", rnd.random(), 2) for i in range(300)]
    df = spark.createDataFrame(data, "g string, v double, n int")
    for asc in (True, False):
        got = {(r.g, r.v): (r.s, r.s_all, r.m) for r in ordered.running(df, ["g"], "v", {"s": ("sum", "n"), "m": ("max", "v")}, ascending=asc).collect()}
        for g in {d[0] for d in data}:
            total = sum(d[2] for d in data if d[0] == g)
            for v in {d[1] for d in data if d[0] == g}:
                part = [d for d in data if d[0] == g and (d[1] <= v if asc else d[1] >= v)]
                assert got[(g, v)] == (sum(d[2] for d in part), total, max(d[1] for d in part))


def test_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.normal(size=301), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = ordered.quantiles(df, [], "v", [0.0, 0.05, 0.37, 0.5, 1.0]).first()[0]
    assert np.allclose(got, np.quantile(x, [0.0, 0.05, 0.37, 0.5, 1.0]))


def test_fdr_is_monotone_and_matches_definition(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.9, 0.2]
    got = dict(rows(ordered.fdr(spark.createDataFrame([(v,) for v in p], "p double"), []).select("p", "q").distinct()))
    want = {}
    for v in p:
        want[v] = min(1.0, min(w * len(p) / sum(u <= w for u in p) for w in p if w >= v))
    assert got == pytest.approx(want)


def test_concordance_equals_pair_count_with_ties_and_censoring(spark):
    rnd = random.Random(4)
    d = [(float(rnd.randint(1, 30)), rnd.randint(0, 1), float(rnd.randint(0, 12))) for _ in range(150)]
    r = survival.concordance(spark.createDataFrame(d, "t double, e int, risk double")).first()
    pairs = [(a, b) for a in d for b in d if a[0] < b[0] and a[1] == 1]
    assert r.comparable == len(pairs)
    assert r.concordant == sum(a[2] > b[2] for a, b in pairs)
    assert r.tied == sum(a[2] == b[2] for a, b in pairs)


def test_cox_maximises_efron_likelihood(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=80).round(1)
    t = np.ceil(rnd.exponential(5 * np.exp(-0.7 * x))).clip(1, 20)
    e = (rnd.random(80) < 0.8).astype(int)

    def loglik(b):
        out = 0.0
        for s in np.unique(t[e == 1]):
            dead = (t == s) & (e == 1)
            n, w = dead.sum(), np.exp(b * x)
            out += b * x[dead].sum() - sum(math.log(w[t >= s].sum() - i / n * w[dead].sum()) for i in range(n))
        return out

    grid = np.linspace(-1, 3, 4001)
    best = grid[np.argmax([loglik(b) for b in grid])]
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, x)], "t double, e int, x double")
    r = survival.cox(df, "x").first()
    assert abs(r.coef - best) < 2e-3
    h = 1e-3
    info = -(loglik(r.coef + h) - 2 * loglik(r.coef) + loglik(r.coef - h)) / h**2
    assert r.se == pytest.approx(1 / math.sqrt(info), rel=1e-2)


def test_kaplan_meier_reaches_zero_and_never_rises(spark):
    d = [(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (4.0, 0), (5.0, 1)]
    k = rows(survival.kaplan_meier(spark.createDataFrame(d, "t double, e int").withColumn("g", F.lit("a")), ["g"]).orderBy("t").select("survival"))
    s = [v[0] for v in k]
    assert s == pytest.approx([6 / 7, 6 / 7 * 5 / 6, 6 / 7 * 5 / 6 * 0.5, 6 / 7 * 5 / 6 * 0.5, 0.0])


def test_greedy_thinning_keeps_first_and_third_of_a_chain(spark):
    d = [("s", 1, 0.0, 0.0), ("s", 2, 4.0, 0.0), ("s", 3, 8.0, 0.0), ("s", 4, 8.0, 0.0)]
    df = spark.createDataFrame(d, "g string, node_idx long, pos_x double, pos_y double")
    assert sorted(r.node_idx for r in thinning.deduplicate(df, 5.0, ["g"]).collect()) == [1, 3]


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 40) if i != 20], "src long, dst long, value double")
    hubs = dict(rows(prototypes.components(pairs, spark.range(42).select(F.col("id").alias("node")), 0.5)))
    assert len(set(hubs.values())) == 3 and hubs[0] == hubs[20] and hubs[21] == hubs[40] != hubs[0]


def test_auc_ties_single_class_and_reversal(spark):
    d = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 1), (0.2, 1), (0.9, 0)]
    df = spark.createDataFrame(d, "s double, y int")
    pos, neg = [s for s, y in d if y], [s for s, y in d if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert stats.roc_auc(df, [], "s", "y").first().auc == pytest.approx(want)
    assert stats.roc_auc(df.withColumn("s", -F.col("s")), [], "s", "y").first().auc == pytest.approx(1 - want)
    assert stats.roc_auc(df.where("y = 1"), [], "s", "y").first().auc is None


def test_signed_rank_exact_and_zero_handling(spark):
    d = [("a", float(i), 0.0) for i in range(1, 7)] + [("z", 1.0, 1.0), ("z", 2.0, 2.0)]
    got = {r.k: r for r in stats.signed_rank(spark.createDataFrame(d, "k string, a double, b double"), ["k"], "a", "b").collect()}
    assert got["a"].p == pytest.approx(2 / 64) and got["z"].p is None and got["z"].n == 0


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(1.959963984540054, 2.2281388519649385, 10.0, 3.841458820694124, 1.0)], "z double, t double, v double, x double, k double")
    r = df.select(
        tails.normal_p("z").alias("n"), tails.t_p("t", "v").alias("t"), tails.chi2_p("x", "k").alias("c"),
        tails.hypergeom_p(F.lit(2), F.lit(3), F.lit(4), F.lit(10)).alias("h"),
    ).first()
    assert r.n == pytest.approx(0.05) and r.t == pytest.approx(0.05) and r.c == pytest.approx(0.05)
    assert r.h == pytest.approx((36 + 4) / 120)


def test_sampling_is_deterministic_and_sized(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    a = sampling.cap_per_group(df, ["g"], 50, ["id"])
    b = sampling.cap_per_group(df.repartition(7), ["g"], 50, ["id"])
    assert sorted(rows(a)) == sorted(rows(b)) and a.count() == 100
    folds = sampling.k_folds(df, 4, ["id"]).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [250, 250, 250, 250]
    split = sampling.stratified_split(df, ["g"], ["id"]).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in split} == {(1, "test"): 67, (1, "train"): 267, (0, "test"): 133, (0, "train"): 533}


def test_gathering_refuses_to_truncate(spark):
    df = spark.range(20).select(F.col("id").alias("k"))
    with pytest.raises(Exception, match="more than 10 rows"):
        spark.range(1).withColumn("x", prototypes.gathered(df, "k", 10)).collect()


def test_ordinal_names_only_when_all_are_numbers(spark):
    genes = spark.createDataFrame([(0, "EGFR"), (1, "CD74")], "idx int, symbol string")
    sig = lambda v: spark.createDataFrame([(x,) for x in v], "gene string")
    assert sorted(r.gene for r in lookup.named_signature(sig(["0", "7"]), genes).collect()) == ["7", "EGFR"]
    assert sorted(r.gene for r in lookup.named_signature(sig(["0", "TP53"]), genes).collect()) == ["0", "TP53"]


def test_weighted_expression_drops_cells_without_weight(spark):
    e = spark.createDataFrame([("s", 1, "a", 1.0), ("s", 1, "b", 3.0), ("s", 2, "a", 0.0), ("s", 3, "x", 1.0), ("s", 4, "b", None)], "sample_name string, src long, dst string, weight double")
    t = spark.createDataFrame([("s", "a", "G", 2.0), ("s", "b", "G", 6.0)], "sample_name string, tile_id string, gene string, value double")
    assert sorted(rows(expression.weighted_expression(e, t).select("node_idx", "value"))) == [(1, 5.0), (4, 6.0)]


def test_plans_push_filters_and_columns(spark, tmp_path):
    from tilewright.sources import readers

    path = str(tmp_path / "p")
    spark.range(100).select(F.concat(F.lit("S"), F.col("id") % 4).alias("sample_name"), "id", F.lit(1.0).alias("unused")).write.parquet(path)
    plan = readers.sample_rows(spark, path, "S1", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sample_name,S1)" in plan and "unused" not in plan
