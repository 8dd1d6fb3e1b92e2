"""Ordered analytics that never put one whole group into one task.

A window over ``PARTITION BY sample ORDER BY value`` sends a sample to a single task; when one sample holds a third
of all rows that task decides the run time. The operators here work in two levels instead:

1. rows with equal (group, value) are collapsed first, with map-side combine, so a hot value costs one row;
2. values are cut into ranges of about equal row count (edges from ``percentile_approx``, which merges partial
   sketches), so that (group, range) is a small, evenly filled partition;
3. running totals are taken inside each (group, range) and shifted by the totals of the ranges before it. There
   are at most ``buckets`` ranges per group, so the second level is tiny.

Every rank statistic of the package (average ranks, AUC, U tests, false-discovery rates, survival curves, risk-set sums,
concordance) is built from :func:`running`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright import session
from tilewright.session import cut_lineage

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "own": F.sum}


def bucket_count(df: DataFrame) -> int:
    """Ranges to cut values into: the next power of two above the session's shuffle partitions."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 16
    while size < wanted and size < 16384:
        size *= 2
    return size


def _range_of(value: Column, edges: Column, buckets: int) -> Column:
    """Number of edges below ``value``: a binary search over the sorted edge array in log2(buckets) steps."""
    steps, step = [], buckets // 2
    while step >= 1:
        steps.append(step)
        step //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, s: pos
        + F.when(F.coalesce(F.element_at(edges, pos + s), F.lit(float("inf"))) < value, s).otherwise(0),
    )


SKETCHES = 16


def _edges(df: DataFrame, value: str, buckets: int) -> Column:
    """Edges between ``buckets`` ranges of about equal row count, as an array in a scalar subquery.

    Where sketches are full, their edges depend on the order in which they arrive and merge. So the edges are written: all
    reads see the same ranges, in whichever query they occur.
    """
    # sketches of many partitions merge in SKETCHES tasks first, and one task merges what is left of those
    grid, exact = [i / buckets for i in range(1, buckets)], max(10000, 4 * buckets)
    fine = [i / (4 * buckets) for i in range(1, 4 * buckets)]
    some = df.groupBy(F.pmod(F.xxhash64(value), F.lit(SKETCHES))).agg(
        F.percentile_approx(F.col(value).cast("double"), fine, exact).alias("_q")
    )
    merged = some.select(F.explode("_q").alias("_q")).agg(F.percentile_approx("_q", grid, exact).alias("_edges"))
    return session.cut_lineage(merged).scalar()


def running(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    measures: dict[str, tuple[str, str]],
    ascending: bool = True,
    buckets: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Running sum / min / max of columns in the order of a numeric column, peers included.

    ``measures`` maps an output name to ``(fold, column)``. The result has one row per (groups, order) with, for each
    measure, the inclusive running value ``<name>`` and the group's total ``<name>_all``; the fold "own" gives just the
    row's own sum. Group columns must not be null; rows with a null order are left out. ``unique`` tells that
    (groups, order) is already a key of the input, which saves an aggregate.
    """
    groups = list(groups)
    buckets = buckets or bucket_count(df)
    folded = {name: fold for name, (fold, _) in measures.items() if fold != "own"}
    valued = df.where(F.col(order).isNotNull())
    if unique:
        cells = valued.select(*groups, order, *[F.col(col).alias(f"_v_{name}") for name, (_, col) in measures.items()])
    else:
        cells = valued.groupBy(*groups, order).agg(
            *[_FOLD[fold](col).alias(f"_v_{name}") for name, (fold, col) in measures.items()]
        )
    cells = cut_lineage(cells)  # read three times below; the input itself is computed once, however deep its plan
    edges = _edges(cells, order, buckets)
    # coalesce makes the range a non-null column: otherwise Spark infers "range is not null" from the join below and
    # pushes the whole search down to every input row
    ranged = (
        cells.withColumn("_edges", edges)
        .withColumn("_range", F.coalesce(_range_of(F.col(order).cast("double"), F.col("_edges"), buckets), F.lit(0)))
        .drop("_edges")
    )

    direction = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    before = Window.partitionBy(*groups).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    totals = ranged.groupBy(*groups, "_range").agg(*[_FOLD[f](f"_v_{n}").alias(f"_t_{n}") for n, f in folded.items()])
    totals = totals.select(
        *groups,
        "_range",
        *[_FOLD[f](f"_t_{n}").over(before).alias(f"_b_{n}") for n, f in folded.items()],
        *[_FOLD[f](f"_t_{n}").over(whole).alias(f"{n}_all") for n, f in folded.items()],
    )
    inside = (
        Window.partitionBy(*groups, "_range")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select(
        *groups,
        order,
        "_range",
        *[
            (F.col(f"_v_{n}") if fold == "own" else _FOLD[fold](f"_v_{n}").over(inside)).alias(f"_r_{n}")
            for n, (fold, _) in measures.items()
        ],
    )
    joined = local.join(totals, [*groups, "_range"])

    def combine(name: str, fold: str) -> Column:
        here = F.col(f"_r_{name}")
        if fold == "own":
            return here
        prior = F.col(f"_b_{name}")
        if fold == "sum":
            return here + F.coalesce(prior, F.lit(0))
        return F.least(here, prior) if fold == "min" else F.greatest(here, prior)

    return joined.select(
        *groups,
        order,
        *[combine(name, fold).alias(name) for name, (fold, _) in measures.items()],
        *[f"{name}_all" for name in folded],
    )


def value_ranks(
    df: DataFrame, groups: Sequence[str], value: str, sums: dict[str, Column] | None = None
) -> DataFrame:
    """Average-tie rank of every distinct value within its group.

    One row per (groups, value): ``n`` copies, ``avg_rank`` and the group size ``n_all``, plus any extra per-value
    ``sums`` (for example the number of positives among the copies) with their group totals ``<name>_all``.
    """
    sums = sums or {}
    base = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"{k}") for k, c in sums.items()]
    )
    own = {"n": ("own", "n"), **{k: ("own", k) for k in sums}}
    run = running(base, groups, value, {"cum": ("sum", "n"), **{f"cum_{k}": ("sum", k) for k in sums}, **own}, unique=True)
    return run.select(
        *groups,
        value,
        "n",
        (F.col("cum") - (F.col("n") - 1) / 2).alias("avg_rank"),
        F.col("cum_all").alias("n_all"),
        *sums,
        *[F.col(f"cum_{k}_all").alias(f"{k}_all") for k in sums],
    )


def attach_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Rows with the average-tie rank of ``value`` in its group and the group size ``<name>_n``."""
    ranks = value_ranks(df, groups, value).select(
        *groups, value, F.col("avg_rank").alias(name), F.col("n_all").alias(f"{name}_n")
    )
    return df.join(ranks, [*groups, value])


def unit_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str = "unit_rank") -> DataFrame:
    """Average-tie ranks scaled to [0, 1] within the group; a group of one gets 0."""
    out = attach_ranks(df, groups, value, "_rk")
    return out.withColumn(
        name, F.when(F.col("_rk_n") > 1, (F.col("_rk") - 1) / (F.col("_rk_n") - 1)).otherwise(F.lit(0.0))
    ).drop("_rk", "_rk_n")


def fdr(df: DataFrame, groups: Sequence[str], p: str = "p", name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values over each family of tests; null p stays null and does not count."""
    df = cut_lineage(df)  # one row per test: small next to the observations, and read several times below
    ranks = running(df.select(*groups, p, F.lit(1).alias("_one")), groups, p, {"_cum": ("sum", "_one")})
    raw = ranks.select(*groups, p, (F.col(p) * F.col("_cum_all") / F.col("_cum")).alias("_raw"))
    low = running(raw, groups, p, {"_low": ("min", "_raw")}, ascending=False, unique=True)
    adjusted = low.select(*groups, p, F.least(F.col("_low"), F.lit(1.0)).alias(name))
    return df.join(adjusted, [*groups, p], "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``; an aggregate, so duplicates combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. Spark prunes each input partition to ``n`` rows per group before the shuffle
    (WindowGroupLimit), so a hot group never travels whole."""
    w = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def group_zscore(df: DataFrame, groups: Sequence[str], value: str, name: str = "z", eps: float = 1e-9) -> DataFrame:
    """(x - mean) / (sample std + eps) within the group, through a combined aggregate and a join back."""
    stats = df.groupBy(*groups).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return (
        df.join(stats, list(groups))
        .withColumn(name, (F.col(value) - F.col("_m")) / (F.coalesce("_s", F.lit(0.0)) + eps))
        .drop("_m", "_s")
    )


def group_minmax(
    df: DataFrame, groups: Sequence[str], value: str, name: str = "scaled", degenerate: float = 1.0, invert: bool = False
) -> DataFrame:
    """(x - min) / (max - min) within the group, or one minus that; ``degenerate`` where max equals min."""
    lo, hi = F.col("_lo"), F.col("_hi")
    share = (F.col(value) - lo) / (hi - lo)
    ext = df.groupBy(*groups).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if groups:
        joined = df.join(ext, list(groups))
    else:
        joined = df.withColumn("_lo", ext.select("_lo").scalar()).withColumn("_hi", ext.select("_hi").scalar())
    return joined.withColumn(
        name, F.when(hi > lo, 1 - share if invert else share).otherwise(F.lit(float(degenerate)))
    ).drop("_lo", "_hi")


def numbered(df: DataFrame, groups: Sequence[str], order: str, name: str = "ordinal", start: int = 0) -> DataFrame:
    """Dense row numbers by a unique numeric key per group, through running counts instead of one sorted task."""
    run = running(df.withColumn("_one", F.lit(1)), groups, order, {"_pos": ("sum", "_one")})
    return df.join(run.select(*groups, order, (F.col("_pos") - 1 + start).alias(name)), [*groups, order])


#: Ranges of a value when its order statistics are looked for in many groups.
RANGES = 64


def with_ranges(df: DataFrame, value: str, buckets: int = RANGES) -> DataFrame:
    """Rows with the number of the range that holds the value (``_range``), null for missing values.

    The ranges hold about equally many rows. They only divide the work of :func:`order_statistics`, so the edges may come
    from rows that are repeated later.
    """
    v = F.col(value).cast("double")
    known = v.isNotNull() & ~F.isnan(v)
    edges = _edges(df.select(v.alias(value)).where(known), value, buckets)
    at = F.when(known, F.coalesce(_range_of(F.col(value).cast("double"), F.col("_edges"), buckets), F.lit(0)))
    return df.withColumn("_edges", edges).withColumn("_range", at).drop("_edges")


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(groups, _n, _l0, _h0, _l1, ...): number of values and the two order statistics around each wanted quantile.

    ``df`` comes from :func:`with_ranges` and is read twice. Rows are counted by (group, range); only rows of the few ranges
    that hold a wanted position travel, equal ones as one.
    """
    rows = df.where(F.col("_range").isNotNull())
    counts = rows.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns(
        {"_b": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy(*groups))}
    )
    steps = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    wanted = [f(h) for h in steps for f in (F.floor, F.ceil)]
    held = F.lit(False)
    for at in wanted:
        held = held | ((F.col("_b") <= at) & (at < F.col("_b") + F.col("_c")))
    # written, so that its size is known before the rows are: they need not travel for the join
    picked = rows.join(cut_lineage(placed.where(held).drop("_c")), [*groups, "_range"])
    equal = picked.groupBy(*groups, "_range", "_b", "_n", F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*groups, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = equal.withColumn("_end", F.col("_b") + F.sum("_c").over(inside))
    at = [F.max(F.when((F.col("_end") - F.col("_c") <= h) & (h < F.col("_end")), F.col("_v"))) for h in wanted]
    names = [f"_{side}{i}" for i in range(len(probs)) for side in "lh"]
    return run.groupBy(*groups).agg(F.max("_n").alias("_n"), *[c.alias(n) for c, n in zip(at, names, strict=True)])


def between(low: Column, high: Column, p: float, n: Column) -> Column:
    """Linear interpolation between the order statistics around quantile ``p`` of ``n`` values."""
    h = F.lit(float(p)) * (n - 1)
    return low + (high - low) * (h - F.floor(h))


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], name: str = "q"
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as one array column.

    ``percentile`` keeps every distinct value of a group in one buffer; here each wanted order statistic is looked for in
    the range of values that holds it, so the aggregates carry a few numbers per group.
    """
    groups = list(groups)
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias(value)))
    buckets = RANGES if groups else bucket_count(df)
    found = order_statistics(with_ranges(rows, value, buckets), groups, value, probs)
    out = [between(F.col(f"_l{i}"), F.col(f"_h{i}"), p, F.col("_n")) for i, p in enumerate(probs)]
    return found.select(*groups, F.array(*out).alias(name))


def with_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """Rows with their group's quantile array."""
    q = quantiles(df, groups, value, probs, name)
    return df.join(q, list(groups)) if groups else df.withColumn(name, q.scalar())
