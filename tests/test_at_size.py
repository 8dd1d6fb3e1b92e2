"""Faults that only larger or more skewed tables show, on small tables made for them."""

import random

import numpy as np
from check import compare, connect
from pyspark.sql import functions as F

from tilewright import session
from tilewright.operators import ecology, expression, neighbors, ordered, scoring, stats, survival, weights
from tilewright.plans import all_queries


def test_over_representation_of_a_set_whose_p_underflows(spark, tmp_path):
    part = spark.range(6000).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id") % 7).alias("p_name"), F.lit(900.0).alias("p_retailprice"),
        F.when(F.col("id") < 300, "Brand#1").otherwise(F.concat(F.lit("Brand#"), 2 + F.col("id") % 3)).alias("p_brand"),
    )
    part.write.parquet(str(tmp_path / "part.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    q = all_queries()["over_representation"]
    assert q.build(spark, str(tmp_path)).where("log10_p = double('-inf')").count() == 1
    assert compare(spark, con, q, str(tmp_path))[0].startswith("ok")


def test_weight_search_ranks_by_range_without_rows_for_each_score(spark, monkeypatch):
    monkeypatch.setattr(weights, "RANGE", 16, raising=False)
    monkeypatch.setattr(weights, "SCORES", 4000, raising=False)
    written, keep = [], weights.cut_lineage
    monkeypatch.setattr(weights, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    r = np.random.default_rng(5)
    y, x = r.integers(0, 2, 600), np.round(r.normal(size=(600, 2)), 1)  # ties
    x[:150] = x[0]  # copies
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(600)], "unit long, y int, a double, b double")
    found = {c["cand"]: c["auc"] for c in weights.weight_search(df, "unit", "y", ["a", "b"], weights.simplex_grid(spark, 2, 10)).collect()}
    rows = weights._scaled_by_fold(df, "unit", "y", ["a", "b"], 5, 42)
    scored = rows.crossJoin(weights.simplex_grid(spark, 2, 10)).withColumn("s", F.lit(0.0) + F.col("w")[0] * F.col("zs")[0] + F.col("w")[1] * F.col("zs")[1])
    want = {c["cand"]: c["auc"] for c in stats.auc_interval(scored, ["fold", "cand"], "s", "y").groupBy("cand").agg(F.avg("auc").alias("auc")).collect()}
    assert found.keys() == want.keys() and len(found) == 11 and all(abs(found[c] - want[c]) < 1e-12 for c in want)
    assert len(written) > 6 and max(w.count() for w in written) <= 600
    seen = []
    monkeypatch.setattr(ordered, "cut_lineage", lambda d: seen.append(keep(d)) or seen[-1])
    weights.weight_search(df, "unit", "y", ["a", "b"], weights.simplex_grid(spark, 2, 10)).count()
    assert all("cand" not in d.columns for d in seen)  # one record per row and candidate before


def test_bank_scores_do_not_leave_the_partitions_to_bytes(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD", 100, raising=False)
    df = spark.range(2000).select((F.col("id") % 500).alias("unit"), F.concat(F.lit("g"), F.floor(F.col("id") / 500)).alias("gene"), F.col("id").cast("double").alias("value"))
    bank = spark.createDataFrame([(p, t, f"g{i}") for p in range(3) for i, t in enumerate(("identity_up", "identity_down", "core", "edge"))], "prototype int, tag string, gene string")
    weights = bank.withColumn("weight", F.lit(1.0))
    out = scoring.bank_scores(df, bank, weights, ["unit"])
    assert out.select(F.spark_partition_id()).distinct().count() >= 10
    assert {(r["identity"], r["spatial"], r["functional"]) for r in out.collect()} == {(-500.0, -500.0, 0.0)} and out.count() == 1500
    ranks = scoring.rank_score_everywhere(df, bank.select(F.col("tag").alias("name"), "gene").distinct(), ["unit"], 30)
    assert ranks.count() == 2000


def test_quantiles_send_only_the_ranges_that_hold_them(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = [float(x) for x in np.round(r.normal(size=20000), 4)] + [float("nan"), None] * 20
    df = spark.createDataFrame([(i % 4, x) for i, x in enumerate(v)], "g long, v double")
    written, keep = [], ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda d: written.append(keep(d)) or written[-1])
    got = {x["g"]: x["q"] for x in ordered.quantiles(df, ["g"], "v", [0.05, 0.5, 0.95]).collect()}
    for g in range(4):
        own = [x for x in v[g::4] if x is not None and x == x]
        assert np.allclose(got[g], np.quantile(own, [0.05, 0.5, 0.95]), atol=1e-12)
    # a row for each wanted range of a group, next to the values; every range of a group was joined before
    assert len(written) == 2 and written[1].count() <= 4 * 6
    w = {x["g"]: x["v"] for x in expression.robust_profile(df, ["g"], "v").collect()}
    plain = {x["g"]: x["v"] for x in expression.robust_profile(df.where("not isnan(v) and v is not null"), ["g"], "v").collect()}
    for g in range(4):
        own = np.array([x for x in v[g::4] if x is not None and x == x])
        lo, hi = np.quantile(own, [0.05, 0.95])
        odd = [hi] * sum(x is None or x != x for x in v[g::4])
        assert abs(plain[g] - np.median(np.clip(own, lo, hi))) < 1e-12 and abs(w[g] - np.median([*np.clip(own, lo, hi), *odd])) < 1e-12


def test_ranges_are_the_same_in_every_read(spark, monkeypatch):
    keep = F.percentile_approx

    def arrives_anew(*of):
        shift = lambda edges: edges and [x + d for d in [random.SystemRandom().uniform(0, 0.5)] for x in edges]
        return F.udf(shift, "array<double>").asNondeterministic()(keep(*of))

    monkeypatch.setattr(F, "percentile_approx", arrives_anew)  # as sketches that merge in another order at each run
    v = np.round(np.random.default_rng(8).normal(size=5000), 3)
    df = spark.createDataFrame([(i, float(x), int(i % 3 > 0)) for i, x in enumerate(v)], "id long, risk double, e int")
    probs = [i / 20 for i in range(21)]
    assert np.allclose(ordered.quantiles(df, [], "risk", probs).first()["q"], np.quantile(v, probs), atol=1e-12)
    run = ordered.running(df.withColumn("one", F.lit(1)), [], "risk", {"n": ("sum", "one")})
    assert all(x["n"] == (v <= x["risk"]).sum() for x in run.collect())
    found = survival.threshold_search(df.withColumn("t", F.col("id") % 50), "cindex", 100).collect()
    assert len(found) == len(set(np.quantile(v, [0.1 + 0.8 * i / 99 for i in range(100)])))
    assert all(x["high"] == (v >= x["cut"]).sum() for x in found)


def test_cuts_that_are_prices_are_rounded_as_in_sql(spark, tmp_path):
    con, prices = connect("/root/testdata/sf0.001"), [203091.55, 102076.65, 201823.55, 101661.25, 150000.0]
    con.execute(f"copy (select * replace ({prices}[1 + o_orderkey % 5]::double as o_totalprice) from orders) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet'")
    con.execute(f"create or replace view orders as select * from '{tmp_path}/orders.parquet'")
    for name in ("threshold_search_cindex", "best_threshold_logrank"):
        message, good = compare(spark, con, all_queries()[name], str(tmp_path))
        assert good, message


def test_expression_of_a_cell_is_added_up_where_its_edges_lie(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD", 100)
    edges = spark.range(3000).select(F.lit("S").alias("sample_name"), (F.col("id") % 300).alias("src"), (F.col("id") % 7).alias("dst"), (F.col("id") % 3).cast("double").alias("weight"))
    tiles = spark.range(70).select(F.lit("S").alias("sample_name"), (F.col("id") % 7).alias("tile_id"), F.concat(F.lit("g"), F.floor(F.col("id") / 7)).alias("gene"), F.col("id").cast("double").alias("value"))
    out = expression.weighted_expression(edges, tiles)
    assert out.select(F.spark_partition_id()).distinct().count() >= 10  # one partition before, whatever it grew to
    e = edges.join(tiles.withColumnRenamed("tile_id", "dst"), ["sample_name", "dst"])
    want = e.groupBy("src", "gene").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("w"), F.sum("weight").alias("s")).where("s > 0")
    both = out.join(want, (out.node_idx == want.src) & (out.gene == want.gene))
    assert both.where("abs(value - w) < 1e-9").count() == out.count() == want.count()


def test_files_lie_in_few_folders_and_many_tasks_write_them(spark, monkeypatch):
    from tilewright.plans import q_sources

    monkeypatch.setattr(q_sources, "FILES", 2, raising=False)
    f = q_sources.R.files(spark, q_sources._folder(spark, "/root/testdata/sf0.001"), [".txt"])
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    assert f.count() == n.count()
    folders = f.select(F.regexp_extract("path", "(.*)/", 1)).distinct().count()
    assert folders == n.select("s_nationkey").distinct().count()  # one for each supplier before
    roots = []
    keep = q_sources.R.files
    monkeypatch.setattr(q_sources.R, "files", lambda s, p, e: roots.append(p) or keep(s, p, e))
    assert q_sources.patch_index(spark, "/root/testdata/sf0.001").count() == n.where("s_suppkey % 7 <> 0").count()
    tasks = keep(spark, roots[0], [".txt"]).select(F.regexp_extract("name", r"part-(\d+)", 1)).distinct().count()
    assert tasks > 1  # one task wrote all before


def test_candidates_of_neighbours_are_dealt_by_positions(spark, monkeypatch):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(300, 2)))], "node_idx long, pos_x double, pos_y double")
    want = sorted(tuple(x) for x in neighbors.knn_join(df, 4).collect())
    monkeypatch.setattr(neighbors, "ASKS", 20, raising=False)
    pairs = neighbors.knn_join(df, 4)
    # the bytes of the positions decided before, and all came to one task
    assert "RepartitionByExpression" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(x) for x in pairs.collect()) == want and len(want) == 1200


def test_radius_pairs_are_dealt_by_candidates_and_not_made_distinct(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PAIRS", 500, raising=False)
    r = np.random.default_rng(9)
    xy = np.round(r.normal(size=(200, 2)), 2)  # most of them in one grid cell or two
    df = spark.createDataFrame([(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(xy)], "node_idx long, pos_x double, pos_y double, prototype_id int")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    want = {(i, j) for i, j in zip(*np.where(d <= 2.0), strict=True) if i != j}
    graph = neighbors.spatial_graph(df, "radius", [], radius=2.0)
    assert sorted((x.src, x.dst) for x in graph.collect()) == sorted(want)
    assert "Aggregate" not in graph._jdf.queryExecution().optimizedPlan().toString()  # a distinct over all pairs before
    tasks = neighbors.within_radius(df, df, 2.0).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and max(t["count"] for t in tasks) < len(want) // 3
    twice = neighbors.spatial_graph(df.unionByName(df.limit(5)), "radius", [], radius=2.0)
    assert sorted((x.src, x.dst) for x in twice.collect()) == sorted(want)
    near = ecology.radial_profile(df, 1, [0.5, 2.0], "prototype_id")
    got = {(x.radius, x.prototype_id): x.n for x in near.collect()}
    for radius in (0.5, 2.0):
        for kind in range(3):
            assert got[radius, kind] == sum(d[i, j] <= radius and i != j for i in range(kind, 200, 3) for j in range(1, 200, 3))
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5  # one more, over all pairs, before


def test_markers_rank_once_for_all_targets(spark, monkeypatch):
    seen, keep = [], ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda d: seen.append(keep(d)) or seen[-1])
    cells = spark.range(60).select(F.col("id").alias("unit"), F.lit("a").alias("kind"), (F.col("id") % 3).cast("int").alias("proto"))
    counts = spark.range(60).where("id % 2 = 0").select(F.col("id").alias("unit"), F.lit("g").alias("gene"), (F.col("id") % 7 + 1).cast("double").alias("value"))
    m = expression.find_markers(cells, counts, ["kind"], "proto", [0, 1, 2], 0.0, 0.0).collect()
    assert sorted(x["target"] for x in m) == [0, 1, 2] and all(abs(x["pct1"] - 0.5) < 1e-12 for x in m)
    assert seen and all("target" not in d.columns for d in seen)  # every row once for each target before
