"""Deterministic sampling and splitting: the draw follows a hash of a stable id and a seed, so any re-run, retry or other
engine picks the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.operators.ordered import quantiles, running, top_n
from tilewright.session import cut_lineage

_SPACE = 16**13


def draw_key(ids: Sequence[str], seed: int, salt: str = "") -> Column:
    """Hexadecimal key whose order is a random permutation of the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed) + salt), *[F.col(c).cast("string") for c in ids]))


def draw_number(ids: Sequence[str], seed: int, salt: str = "") -> Column:
    """The leading 52 bits of the key as an integer, exact as a double."""
    return F.conv(F.substring(draw_key(ids, seed, salt), 1, 13), 16, 10).cast("long")


def cap_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows, uniformly: each partition keeps its n smallest keys before one merge (TakeOrdered)."""
    return df.withColumn("_k", draw_key(ids, seed)).orderBy("_k", *ids).limit(n).drop("_k")


def cap_per_group(df: DataFrame, groups: Sequence[str], n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows of each group; every input partition is cut to n per group before the shuffle."""
    keyed = df.withColumn("_k", draw_key(ids, seed))
    return top_n(keyed, groups, [F.col("_k"), *[F.col(c) for c in ids]], n, "_r").drop("_k", "_r")


def keep_fraction(df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Each row independently with the given probability; a pure filter without a shuffle."""
    return df.where(draw_number(ids, seed) < int(fraction * _SPACE))


def sample_edges(
    edges: DataFrame, fraction: float, cap: int, groups: Sequence[str], ids: Sequence[str], seed: int = 42, epoch: int = 0
) -> DataFrame:
    """A fraction of the edges, then at most ``cap`` per group, seeded by (seed, epoch, edge)."""
    mixed = seed * 1000003 + epoch
    return cap_per_group(keep_fraction(edges, fraction, ids, mixed), groups, cap, ids, mixed)


def equal_subsample(
    df: DataFrame, group: Sequence[str], side: str, n: int, ids: Sequence[str], seed: int = 42, least: int = 3
) -> DataFrame:
    """min(n, |a|, |b|) rows of both sides of every group, only where that is at least ``least``."""
    sizes = df.groupBy(*group, side).agg(F.count(F.lit(1)).alias("_c"))
    take = sizes.groupBy(*group).agg(
        F.least(F.lit(n), F.min("_c")).alias("_take"), F.count(F.lit(1)).alias("_sides")
    )
    capped = cap_per_group(df, [*group, side], n, ids, seed)
    w = Window.partitionBy(*group, side).orderBy("_k", *ids)  # at most n rows per partition here
    ranked = capped.withColumn("_k", draw_key(ids, seed)).withColumn("_r", F.row_number().over(w))
    return (
        ranked.join(take, list(group))
        .where((F.col("_sides") == 2) & (F.col("_take") >= least) & (F.col("_r") <= F.col("_take")))
        .drop("_k", "_r", "_take", "_sides")
    )


def _positions(df: DataFrame, groups: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """Rows with their place ``_pos`` (from 1) in the hash order of the group and the group size ``_size``.

    Places come from running counts over the key's leading bits, so no group is sorted in one task; the rows that share
    those bits (practically none) are told apart by the full key inside their small tie group.
    """
    keyed = df.withColumn("_h", draw_number(ids, seed)).withColumn("_k", draw_key(ids, seed))
    run = running(keyed.withColumn("_1", F.lit(1)), groups, "_h", {"_cum": ("sum", "_1")})
    tie = Window.partitionBy(*groups, "_h").orderBy(F.desc("_k"), *[F.desc(c) for c in ids])
    return (
        keyed.join(run, [*groups, "_h"])
        .withColumn("_pos", F.col("_cum") - F.row_number().over(tie) + 1)
        .withColumn("_size", F.col("_cum_all"))
        .drop("_cum", "_cum_all", "_h", "_k")
    )


def stratified_split(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], test_share: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Label rows train / test with the share rounded inside every stratum."""
    p = _positions(df, strata, ids, seed)
    return p.withColumn(
        name, F.when(F.col("_pos") <= F.round(F.col("_size") * test_share), "test").otherwise("train")
    ).drop("_pos", "_size")


def split_by_sample(df: DataFrame, sample: str, val_share: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Whole samples to train / val, at least one sample in val."""
    placed = _positions(df.select(sample).distinct(), [], [sample], seed)
    wanted = F.greatest(F.floor(F.col("_size") * val_share), F.lit(1))
    side = placed.select(sample, F.when(F.col("_pos") <= wanted, "val").otherwise("train").alias(name))
    return df.join(side, sample)


def k_folds(df: DataFrame, k: int, ids: Sequence[str], seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled fold numbers 1..k of nearly equal size."""
    p = _positions(df, [], ids, seed)
    return p.withColumn(name, ((F.col("_pos") - 1) % k + 1).cast("int")).drop("_pos", "_size")


def bootstrap(df: DataFrame, rounds: int, ids: Sequence[str], fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Each row with its ``weight`` per bootstrap ``round``: how often it is among the round's max(1, int(fraction * n)) draws
    with replacement; rows that aren't drawn are left out.

    The ids must be unique. Rows have places 1..n in their hash order; draw number j of a round falls on a place by a hash of
    (round, j), so every round has exactly its size, and a retry draws the same. What is moved is one pair of numbers per
    draw, combined before it is joined with the rows.
    """
    placed = cut_lineage(_positions(df, [], ids, seed))
    n = placed.count()
    if not n:
        return df.withColumn("round", F.lit(1)).withColumn("weight", F.lit(1).cast("long"))
    size = max(1, int(fraction * n))
    draws = df.sparkSession.range(rounds * size).select(
        (F.floor(F.col("id") / size) + 1).cast("int").alias("round"), (F.col("id") % size).alias("_j")
    )
    place = F.floor(draw_number(["round", "_j"], seed, "b") / F.lit(float(_SPACE)) * n) + 1
    drawn = draws.groupBy("round", place.alias("_pos")).agg(F.count(F.lit(1)).alias("weight"))
    return placed.join(drawn, "_pos").select(*df.columns, "round", "weight")


def quartile_stratum(df: DataFrame, time: str, event: str, name: str = "stratum") -> DataFrame:
    """Quartile of the time crossed with the event flag."""
    q = quantiles(df, [], time, [0.25, 0.5, 0.75]).scalar()
    bin_ = F.size(F.filter("_q", lambda e: e < F.col(time)))
    return df.withColumn("_q", q).withColumn(name, F.concat_ws("_", bin_.cast("string"), F.col(event).cast("string"))).drop("_q")
