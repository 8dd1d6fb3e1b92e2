"""Weight searches, fits, set scores, matches and draws against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import tails
from tilewright.operators import expression, lookup, prototypes, sampling, scoring, weights


def table(spark, n=120, seed=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    x = r.normal(size=(n, 3)) + y[:, None] * np.array([1.0, -0.7, 0.0])
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "unit long, y int, a double, b double, c double")


def robust(x, of):
    mu = np.median(of)
    mad = 1.4826 * np.median(np.abs(of - mu))
    return (x - mu) / (mad if mad > 0 else of.std(ddof=1) or 1.0)


def auc(y, s):
    one, zero = s[y == 1], s[y == 0]
    a = ((one[:, None] > zero).sum() + 0.5 * (one[:, None] == zero).sum()) / (len(one) * len(zero))
    return 1 - a if np.median(one) < np.median(zero) else a


def test_weight_search_in_blocks(spark):
    df = table(spark)
    folds = {r["unit"]: r["fold"] for r in sampling.k_folds(df.select("unit"), 5, ["unit"]).collect()}
    rows = sorted(df.collect())
    x, y, f = np.array([[r["a"], -r["b"], r["c"]] for r in rows]), np.array([r["y"] for r in rows]), np.array([folds[r["unit"]] for r in rows])
    found = weights.weight_search(df, "unit", "y", ["a", "b", "c"], weights.simplex_grid(spark, 3, 5), signs=[1, -1, 1], block=4).collect()
    assert len(found) == 21
    for r in found:
        want = []
        for k in range(1, 6):
            z = np.stack([robust(x[f == k, j], x[f != k, j]) for j in range(3)], axis=1)
            want.append(auc(y[f == k], z @ np.array(r["w"])))
        assert math.isclose(r["auc"], np.mean(want), abs_tol=1e-9)
    best = weights.best_candidate(weights.weight_search(df, "unit", "y", ["a", "b", "c"], weights.simplex_grid(spark, 3, 5), signs=[1, -1, 1]))
    assert best.first()["auc"] == max(r["auc"] for r in found)


def test_elastic_net_stays_non_negative_and_near_the_optimum(spark):
    df = table(spark, 300)
    got = {r["feature"]: r for r in weights.elastic_net(df, "unit", "y", ["a", "b", "c"], steps=150).collect()}
    assert got["b"]["weight"] == 0 and got["a"]["weight"] > 0.8 and math.isclose(sum(r["weight"] for r in got.values()), 1)
    rows = sorted(df.collect())
    x = np.stack([robust(v, v) for v in np.array([[r["a"], r["b"], r["c"]] for r in rows]).T], axis=1)
    y, alpha = np.array([r["y"] for r in rows]), got["a"]["alpha"]
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    beta, start = np.zeros(3), 0.0
    for _ in range(20_000):
        error = w * (1 / (1 + np.exp(-(start + x @ beta))) - y)
        start -= 0.2 * error.sum()
        beta = np.maximum(beta - 0.2 * (error @ x + 0.02 * (1 - alpha) * beta + 0.02 * alpha), 0)
    assert np.allclose([got[c]["weight"] for c in "abc"], beta / beta.sum(), atol=2e-3)


def test_elastic_net_without_signal_is_uniform(spark):
    df = spark.createDataFrame([(i, i % 2, float(i // 2 % 7), float(-(i // 2) % 5)) for i in range(140)], "unit long, y int, a double, b double")
    assert [r["weight"] for r in weights.elastic_net(df, "unit", "y", ["a", "b"], alphas=[1.0], penalty=5.0, steps=20).collect()] == [0.5, 0.5]


def test_alignment_equals_the_walk(spark):
    r = random.Random(2)
    comp = lambda p, n: [(f"{p}{i:03}", f"m{m}", r.choice([0.1, 0.2, 0.5])) for i in range(n) for m in r.sample(range(6), 3)]
    seen, prior = comp("s", 40), comp("t", 30)
    schema = "name string, macro string, frac double"
    got = {x["source"]: x["target"] for x in scoring.align_by_similarity(spark.createDataFrame(seen, schema), spark.createDataFrame(prior, schema)).collect()}
    vec = lambda rows, n: {m: f for a, m, f in rows if a == n}
    norm = lambda v: math.sqrt(sum(f * f for f in v.values()))
    want, used = {}, set()
    for s in sorted({a for a, *_ in seen}):
        a = vec(seen, s)
        options = []
        for t in sorted({b for b, *_ in prior} - used):
            b = vec(prior, t)
            if a.keys() & b.keys():
                options.append((round(-sum(a[m] * b[m] for m in a.keys() & b.keys()) / (norm(a) * norm(b)), 12), t))
        if options:
            want[s] = min(options)[1]
            used.add(want[s])
    same = sum(got.get(s) == t for s, t in want.items())
    assert got.keys() == want.keys() and len(set(got.values())) == len(got)
    assert same >= len(want) - 2  # equal similarities may differ in the last digit


def test_ten_thousand_gene_sets(spark):
    df = spark.createDataFrame([("u", f"G{i}", float(i + 1)) for i in range(30)], "unit string, gene string, value double")
    sets = spark.range(10_000).select(
        F.concat(F.lit("set"), F.col("id")).alias("name"),
        F.explode(F.array(*[F.concat(F.lit("G"), (F.col("id") * 7 + F.lit(j)) % 3000) for j in range(3)])).alias("gene"),
    )
    found = {r["name"]: r["score"] for r in scoring.rank_score(df, sets, ["unit"], 20).collect()}
    assert 0 < len(found) < 400  # sets without a gene of the unit have no row
    every = scoring.rank_score_everywhere(df, sets, ["unit"], 20)
    assert every.count() == 10_000
    rule = scoring.zero_rule(sets, 20).first()["score"]
    assert every.where(F.col("score") == rule).count() >= 10_000 - len(found)
    assert {r["name"]: r["score"] for r in every.collect() if r["name"] in found} == found


def test_enrichment_of_a_set_that_holds_everything_is_null(spark):
    df = spark.createDataFrame([("u", f"G{i}", float(i)) for i in range(5)], "unit string, gene string, value double")
    sets = spark.createDataFrame([("all", f"G{i}") for i in range(5)] + [("two", "G4"), ("two", "G3")], "name string, gene string")
    got = {r["name"]: r["score"] for r in scoring.enrichment_score(df, sets, ["unit"]).collect()}
    assert got["all"] is None and got["two"] > 0


def test_containment_over_many_roots(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randrange(1, 7)))
    names, roots = sorted({word() for _ in range(80)}), sorted({word() for _ in range(60)})
    key = lambda s: "".join(s.split()).lower()
    df = spark.createDataFrame([(n,) for n in names], "cohort string")
    got = {x["cohort"]: x["root"] for x in lookup.match_cohort(df, spark.createDataFrame([(n, "r" + key(n)) for n in roots], "name string, root string")).collect()}
    keys = sorted({key(x) for x in roots} - {""})
    for n in names:
        k = key(n)
        hits = [x for x in keys if x == k] or [x for x in keys if k and (x in k or k in x)]
        assert got[n] == ("r" + hits[0] if hits else None)
    many = spark.range(100_000).select(F.concat(F.lit("root"), "id", F.lit("x")).alias("name"), F.col("id").cast("string").alias("root"))
    one = spark.createDataFrame([("the Root 77777 X",), ("ot99999x",), ("none",)], "cohort string")
    assert {x["cohort"]: x["root"] for x in lookup.match_cohort(one, many).collect()} == {"the Root 77777 X": "77777", "ot99999x": "99999", "none": None}


@pytest.mark.parametrize("fraction", [1.0, 0.8, 0.001])
def test_bootstrap_draws_exactly_its_size(spark, fraction):
    df = spark.range(137).withColumnRenamed("id", "k").repartition(5)
    rows = sampling.bootstrap(df, 20, ["k"], fraction).groupBy("round").agg(F.sum("weight").alias("n"), F.max("weight").alias("most")).collect()
    assert [r["n"] for r in sorted(rows)] == [max(1, int(fraction * 137))] * 20
    assert fraction < 0.5 or max(r["most"] for r in rows) > 1


def test_hypergeometric_far_tail(spark):
    cases = [(49, 64, 50, 2000), (0, 5, 3, 10), (3, 3, 3, 10), (10, 400, 40, 2000)]
    df = spark.createDataFrame(cases, "k long, n long, m long, u long")
    got = [r[0] for r in df.select(tails.hypergeom_p("k", "n", "m", "u")).collect()]
    for (k, n, m, u), p in zip(cases, got, strict=True):
        want = sum(Fraction(math.comb(m, i) * math.comb(u - m, n - i), math.comb(u, n)) for i in range(k, min(n, m) + 1))
        assert math.isclose(p, float(want), rel_tol=1e-8)


def test_fallback_runs_for_empty_pairs_alone(spark):
    r = np.random.default_rng(4)
    cells, expr = [], []
    for s in range(6):
        for i in range(60):
            side = i % 3  # 0: interface of P0 and P1, 1 and 2: cores; P2 never dominates
            mix = {0: [0.5, 0.5, 0.0], 1: [0.95, 0.05, 0.0], 2: [0.05, 0.7, 0.25]}[side]
            cells.append((f"s{s}", i, mix))
            expr.append((f"s{s}", i, "up", float((side == 0) + 0.1 * r.random() + 1)))
            expr.append((f"s{s}", i, "flat", float(1 + 0.1 * r.random())))
    c = spark.createDataFrame(cells, "sample_name string, node_idx long, mix array<double>")
    e = spark.createDataFrame(expr, "sample_name string, node_idx long, gene string, value double")
    strict, relaxed = expression.Contrast(0.9, 0.4, 5), expression.Contrast(0.6, 0.2, 5, 0.5, 0.0)
    rows = expression.interface_expression(c, "mix", e, [(0, 1), (1, 2), (0, 2)], strict, relaxed, subsample=7, test="ttest").collect()
    found = {(x["pair"], x["gene"]): x for x in rows}
    assert found["P0_P1", "up"]["fallback"] is False and found["P0_P1", "up"]["log2fc"] > 0.5
    assert {x["fallback"] for x in rows if x["pair"] != "P0_P1"} <= {True} and ("P0_P2", "up") not in found


def test_profiles_take_equally_many_cells(spark):
    tagged = spark.createDataFrame(
        [("P0_P1", "s", i, "interface") for i in range(9)] + [("P0_P1", "s", 100 + i, "core") for i in range(40)],
        "pair string, sample_name string, node_idx long, layer string",
    )
    e = tagged.select("sample_name", "node_idx", F.lit("g").alias("gene"), F.lit(1.0).alias("value"))
    both = sampling.equal_subsample(tagged, ["pair", "sample_name"], "layer", 20, ["pair", "node_idx"], 1337, least=1)
    assert {(r["layer"], r["count"]) for r in both.groupBy("layer").count().collect()} == {("interface", 9), ("core", 9)}
    assert expression.layer_profiles(tagged, e, ["sample_name", "node_idx"], 3, subsample=20).first()["a"] == 1.0


def test_principal_components_against_numpy(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(200, 5)) @ r.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [None] * 5)], "i long, f array<double>")
    got = {p["i"]: p["components"] for p in expression.pca(df, "f", 3).collect()}
    assert got[200] is None and got[201] is None
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z.T))
    want = z @ axes[:, ::-1][:, :3]
    assert np.allclose(np.abs([got[i] for i in range(200)]), np.abs(want), atol=1e-8)
    left = expression.reconstructed_correlation(df, "f", 5).toPandas().pivot(index="i", columns="j", values="value")
    assert np.allclose(left, pd.DataFrame(z).corr(), atol=1e-9)


def test_seeded_centres(spark):
    r = np.random.default_rng(6)
    blobs = np.eye(6)[:4] * 5
    x = [(i, (blobs[i % 4] + 0.1 * r.normal(size=6)).tolist()) for i in range(200)]
    c = prototypes.kmeans_centers(spark.createDataFrame(x, "vec_id long, embedding array<double>"), 4).collect()
    assert sorted(int(np.argmax(v["vec"])) for v in c) == [0, 1, 2, 3]
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert len(prototypes.kmeans_centers(few, 3).collect()) <= 2
    assert prototypes.kmeans_centers(few.limit(0), 3).count() == 0
