"""Survival: Kaplan-Meier, log-rank, Cox, concordance, threshold search, time bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tails import chi2_p, normal_p
from tilewright.operators.ordered import quantiles, running
from tilewright.session import cut_lineage


def time_bins(df: DataFrame, time: str, k: int = 20, method: str = "quantile") -> DataFrame:
    """One row ``edges``: distinct quantiles of the finite times, or a uniform grid where at most two remain."""
    t = df.where(F.col(time).isNotNull() & ~F.isnan(time))
    s = t.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).withColumn(
        "q", F.array_distinct(quantiles(t, [], time, [i / k for i in range(k + 1)]).scalar())
    )
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(k)),
        lambda i: F.coalesce(F.col("lo"), F.lit(0.0)) + i / k * (F.coalesce(F.col("hi") + 1e-8 - F.col("lo"), F.lit(1.0))),
    )
    uniform = F.lit(method != "quantile") | F.col("q").isNull() | (F.size("q") <= 2)
    return s.select(F.when(uniform, grid).otherwise(F.col("q")).alias("edges"))


def kaplan_meier(df: DataFrame, groups: Sequence[str], time: str = "t", event: str = "e", min_group: int = 3) -> DataFrame:
    """Product-limit curve per group: (groups, t, at_risk, events, survival) at every distinct time."""
    groups = list(groups)
    cells = df.groupBy(*groups, time).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("events"))
    left = running(cells, groups, time, {"at_risk": ("sum", "n"), "events": ("own", "events")}, ascending=False, unique=True)
    step = (
        left.where(F.col("at_risk_all") >= min_group)
        .withColumn("gone", (F.col("events") == F.col("at_risk")).cast("int"))
        .withColumn("log_s", F.when(F.col("gone") == 0, F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(F.lit(0.0)))
    )
    own = {"at_risk": ("own", "at_risk"), "events": ("own", "events")}
    run = running(step, groups, time, {"acc": ("sum", "log_s"), "dead": ("max", "gone"), **own}, unique=True)
    return run.select(
        *groups,
        time,
        "at_risk",
        "events",
        F.when(F.col("dead") == 1, F.lit(0.0)).otherwise(F.exp("acc")).alias("survival"),
    )


def log_rank(df: DataFrame, flag: str, groups: Sequence[str] = (), time: str = "t", event: str = "e") -> DataFrame:
    """Two-sample log-rank test of ``flag`` (0 / 1): statistic and p per group of ``groups``."""
    groups = list(groups)
    cells = df.groupBy(*groups, time).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(flag).alias("n1"),
        F.sum(event).alias("d"),
        F.sum(F.col(event) * F.col(flag)).alias("d1"),
    )
    own = {"d": ("own", "d"), "d1": ("own", "d1")}
    risk = running(cells, groups, time, {"r": ("sum", "n"), "r1": ("sum", "n1"), **own}, ascending=False, unique=True)
    share = F.col("r1") / F.col("r")
    stat = (
        risk.where(F.col("d") > 0)
        .groupBy(*groups)
        .agg(
            F.sum(F.col("d1") - F.col("d") * share).alias("diff"),
            F.sum(
                F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(
                    F.lit(0.0)
                )
            ).alias("var"),
        )
        .select(*groups, F.when(F.col("var") > 0, F.col("diff") * F.col("diff") / F.col("var")).alias("chi2"))
    )
    return stat.withColumn("p", chi2_p("chi2", F.lit(1.0)))


def concordance(df: DataFrame, groups: Sequence[str] = (), time: str = "t", event: str = "e", risk: str = "risk") -> DataFrame:
    """Concordance index per group: over pairs with t_i < t_j and an event at i, the share with risk_i > risk_j, ties half.

    Counting is by digits, not by pairs. With risks as dense ranks in base 4, risk_j < risk_i exactly when the two ranks
    agree above some digit and j has the smaller digit there. So every row is listed once per digit under its higher
    digits, and the later rows with a smaller digit are read off running counts: n log n rows, not n squared pairs. Equal
    risks (all digits agree) and comparable pairs (none looked at) are two more such lists, so one pass counts all three.
    """
    groups = list(groups)
    base = df.where(
        F.col(time).isNotNull() & F.col(risk).isNotNull() & ~F.isnan(F.col(time)) & ~F.isnan(F.col(risk))
    )
    cells = cut_lineage(base.groupBy(*groups, time, risk).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("d")))
    per_risk = cells.groupBy(*groups, risk).agg(F.lit(1).alias("_1"), F.count(F.lit(1)).alias("_times"))
    dense = running(per_risk, groups, risk, {"rk": ("sum", "_1"), "_times": ("own", "_times")}, unique=True)
    ranked = cut_lineage(cells.join(dense.select(*groups, risk, "rk", "_times"), [*groups, risk]).drop(risk))
    top = ranked.agg(F.max("rk")).first()[0]  # one number: how many digits the ranks have
    places = max(1, (int(top or 1).bit_length() + 1) // 2)
    # place -1 keeps whole ranks together (only those with several times can tie), the place above all digits everything
    first = F.when(F.col("_times") > 1, F.lit(-1)).otherwise(F.lit(0))
    inner = F.col("place").between(0, places - 1)
    listed = (
        ranked.withColumn("place", F.explode(F.sequence(first, F.lit(places))))
        .withColumn("prefix", F.expr("case when place < 0 then rk else shiftright(rk, 2 * place + 2) end"))
        .withColumn("digit", F.when(inner, F.expr("shiftright(rk, 2 * place) & 3")))
    )
    # a digit wins over those below it; the outer lists use the sums of digit 1 and count every later row
    sums = lambda on, c, name: F.sum(F.when(on, F.col(c)).otherwise(0)).alias(name)
    below = [sums(~inner | (F.col("digit") < k), "n", f"b{k}") for k in (1, 2, 3)]
    events = [sums((F.col("digit") == k) | (~inner & F.lit(k == 1)), "d", f"e{k}") for k in (1, 2, 3)]
    keys = [*groups, "place", "prefix"]
    digits = listed.groupBy(*keys, time).agg(*below, *events)
    runs = {f"r{k}": ("sum", f"b{k}") for k in (1, 2, 3)}
    own = {f"{c}{k}": ("own", f"{c}{k}") for c in "be" for k in (1, 2, 3)}
    later = running(digits, keys, time, {**runs, **own}, ascending=False, unique=True)
    won = sum((F.col(f"e{k}") * (F.col(f"r{k}") - F.col(f"b{k}")) for k in (1, 2, 3)), F.lit(0))
    kinds = {"comparable": F.col("place") == places, "tied": F.col("place") < 0, "concordant": inner}
    counted = later.select(*groups, "place", won.alias("won")).groupBy(*groups)
    out = counted.agg(*[F.sum(F.when(on, F.col("won"))).alias(name) for name, on in kinds.items()])
    out = out.fillna(0, ["concordant", "tied"])
    return out.select(
        *groups,
        "comparable",
        "concordant",
        "tied",
        F.when(F.col("comparable") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("comparable")).alias("c_index"),
    )


def median_split(df: DataFrame, risk: str = "risk", name: str = "high") -> DataFrame:
    """1 where the risk is at least the median."""
    middle = quantiles(df, [], risk, [0.5]).scalar()
    return df.withColumn(name, (F.col(risk) >= middle[0]).cast("int"))


def risk_groups(df: DataFrame, flag: str = "high", time: str = "t", event: str = "e", risk: str = "risk") -> DataFrame:
    return df.groupBy(F.when(F.col(flag) == 1, "High").otherwise("Low").alias("risk_group")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(risk).alias("mean_risk"),
        F.avg(time).alias("mean_time"),
        F.avg(event).alias("event_rate"),
    )


def threshold_search(
    df: DataFrame,
    criterion: str = "cindex",
    candidates: int = 100,
    min_share: float = 0.05,
    min_group: int = 10,
    time: str = "t",
    event: str = "e",
    risk: str = "risk",
) -> DataFrame:
    """Score risk cut-offs between the 10 % and 90 % quantiles; the best row first by (score, balance).

    The candidates are at most ``candidates`` numbers held in one array, so every patient row is counted per time and
    candidate in one combined aggregate.
    """
    steps = [0.1 + 0.8 * i / (candidates - 1) for i in range(candidates)]
    grid = F.array_distinct(quantiles(df, [], risk, steps).scalar())
    marked = df.withColumn("_grid", grid).select(
        time, event, F.explode(F.transform("_grid", lambda c: F.struct(c.alias("cut"), (F.col(risk) >= c).cast("int").alias("hi")))).alias("m")
    ).select(F.col("m.cut").alias("cut"), F.col(time).alias("t"), F.col(event).alias("e"), F.col("m.hi").alias("hi"))
    cells = cut_lineage(
        marked.groupBy("cut", "t").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("hi").alias("n1"),
            F.sum("e").alias("d"),
            F.sum(F.col("e") * F.col("hi")).alias("d1"),
        )
    )
    sizes = cells.groupBy("cut").agg(F.sum("n").alias("total"), F.sum("n1").alias("high"))
    own = {c: ("own", c) for c in ("n", "n1", "d", "d1")}
    at = running(cells, ["cut"], "t", {"r": ("sum", "n"), "r1": ("sum", "n1"), **own}, ascending=False, unique=True)
    after, after_hi = F.col("r") - F.col("n"), F.col("r1") - F.col("n1")
    if criterion == "cindex":
        # an event in the high group beats later low ones; equal groups count half
        won = F.col("d1") * (after - after_hi) + F.col("d1") * after_hi / 2 + (F.col("d") - F.col("d1")) * (after - after_hi) / 2
        score = at.groupBy("cut").agg((F.sum(won) / F.sum(F.col("d") * after)).alias("score"))
    elif criterion == "logrank":
        share = F.col("r1") / F.col("r")
        var = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
        score = at.groupBy("cut").agg(
            (F.pow(F.sum(F.col("d1") - F.col("d") * share), 2) / F.sum(var)).alias("score")
        )
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    smallest = F.greatest(F.lit(float(min_group)), F.col("total") * min_share)
    return (
        score.join(sizes, "cut")
        .where(F.least(F.col("high"), F.col("total") - F.col("high")) >= smallest)
        .select("cut", "score", "high", (F.col("total") - F.col("high")).alias("low"))
    )


def best_threshold(scored: DataFrame, digits: int = 12) -> DataFrame:
    """Highest score; on a tie the smaller difference of group sizes, then the smaller cut-off."""
    key = F.struct(F.round("score", digits), -F.abs(F.col("high") - F.col("low")), -F.col("cut"))
    return scored.agg(F.max_by(F.struct("cut", "score", "high", "low"), key).alias("b")).select("b.*")


TIES = 1024


def cox(df: DataFrame, x: str, time: str = "t", event: str = "e", rounds: int = 25, tol: float = 1e-9) -> DataFrame:
    """One-covariate Cox model with Efron ties: coefficient, standard error, hazard ratio, 95 % interval, p.

    Each Newton step is one aggregate to distinct times, running sums over the times from the last to the first, and one
    row back to the driver.
    """
    spark = df.sparkSession
    base = cut_lineage(
        df.where(F.col(x).isNotNull() & F.col(time).isNotNull())
        .groupBy(F.col(time).alias("t"), F.col(x).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("d"))
    )
    beta, info = 0.0, float("nan")
    for _ in range(rounds):
        w = F.exp(F.lit(beta) * F.col("x"))
        moments = {f"s{k}": F.sum(F.col("n") * w * F.pow("x", F.lit(k))) for k in range(3)}
        events = {f"e{k}": F.sum(F.col("d") * w * F.pow("x", F.lit(k))) for k in range(3)}
        at = base.groupBy("t").agg(
            *[c.alias(k) for k, c in {**moments, **events}.items()],
            F.sum("d").alias("d"),
            F.sum(F.col("d") * F.col("x")).alias("dx"),
        )
        own = {c: ("own", c) for c in ("e0", "e1", "e2", "d", "dx")}
        risk = running(at, [], "t", {**{f"r{k}": ("sum", f"s{k}") for k in range(3)}, **own}, ascending=False, unique=True)
        # Efron: the l-th of d tied events sees the risk set less l/d of the tied events' weight
        # (a row per tied event, unfolded in bounded steps however many tie)
        block = F.explode(F.sequence(F.lit(0), F.floor((F.col("d") - 1) / TIES).cast("int"))).alias("_b")
        tied = risk.where(F.col("d") > 0).select("*", block)
        last = F.least(F.col("d") - 1, F.col("_b") * TIES + (TIES - 1)).cast("int")
        tied = tied.select("*", F.explode(F.sequence(F.col("_b") * TIES, last)).alias("_l"))
        q0, q1, q2 = (F.col(f"r{k}") - F.col("_l") / F.col("d") * F.col(f"e{k}") for k in range(3))
        row = tied.agg(
            F.sum(F.when(F.col("_l") == 0, F.col("dx")).otherwise(0.0) - q1 / q0).alias("score"),
            F.sum(q2 / q0 - F.pow(q1 / q0, 2)).alias("info"),
        ).first()
        if row.info is None or row.info <= 0:
            break
        info = row.info
        step = max(-2.0, min(2.0, row.score / info))
        beta += step
        if abs(step) < tol:
            break
    se = 1.0 / math.sqrt(info) if info > 0 else float("nan")
    out = spark.range(1).select(F.lit(beta).alias("coef"), F.lit(se).alias("se"))
    return out.select(
        "coef",
        "se",
        F.exp("coef").alias("hr"),
        F.exp(F.col("coef") - 1.959963984540054 * F.col("se")).alias("low"),
        F.exp(F.col("coef") + 1.959963984540054 * F.col("se")).alias("high"),
        normal_p(F.col("coef") / F.col("se")).alias("p"),
    )
