import random

import pytest

from tilewright.operators import thinning


def scan(rows, r):
    kept = []
    for i, x, y in sorted(rows):
        if all((x - a) ** 2 + (y - b) ** 2 > r * r for _, a, b in kept):
            kept.append((i, x, y))
    return {i for i, _, _ in kept}


def thinned(spark, rows, r, **more):
    df = spark.createDataFrame([("s", *row) for row in rows], "sample_name string, node_idx long, pos_x double, pos_y double")
    return {row[0] for row in thinning.deduplicate(df.repartition(4), r, ["sample_name"], **more).select("node_idx").collect()}


@pytest.mark.parametrize("tile, minima", [(512, 2), (4, 1), (2, 0)])
def test_same_as_the_scan(spark, tile, minima):
    r = random.Random(tile)
    rows = [(i, r.uniform(-40, 40), r.uniform(-40, 40)) for i in range(500)]
    rows += [(1000 + i, 3 + r.uniform(0, 1), 3 + r.uniform(0, 1)) for i in range(200)]  # a crowded square
    rows += [(2000 + i, float(i % 9), float(i // 9)) for i in range(81)]  # distances that equal the radius
    assert thinned(spark, rows, 5.0, tile=tile, minima=minima) == scan(rows, 5.0)


def test_long_chain_and_pile_in_few_rounds(spark, monkeypatch):
    rounds = []
    plain = thinning._scan
    monkeypatch.setattr(thinning, "_scan", lambda *a: rounds.append(1) or plain(*a))
    chain = [(i, 4.0 * i, 0.0) for i in range(10_000)]
    assert thinned(spark, chain, 5.0, tile=4096) == set(range(0, 10_000, 2))
    assert len(rounds) <= 5
    rounds.clear()
    r = random.Random(1)
    pile = [(i, r.gauss(0, 0.1), r.gauss(0, 0.1)) for i in range(5_000)]
    assert thinned(spark, pile, 5.0) == {0}
    assert not rounds  # settled by minima


def test_copies_missing_positions_and_groups(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.0), ("b", 3, 0.0, 0.0), ("a", 4, None, 1.0), ("a", 5, float("nan"), 1.0), ("a", 6, 5.0, 0.0), ("a", 7, 5.1, 0.0)]
    df = spark.createDataFrame(rows, "sample_name string, node_idx long, pos_x double, pos_y double")
    found = thinning.deduplicate(df, 5.0, ["sample_name"])
    assert {r["node_idx"] for r in found.collect()} == {1, 3, 4, 5, 7}
    assert thinning.deduplicate(df.limit(0), 5.0, ["sample_name"]).count() == 0
