"""Weights of combined features: searches over candidates, a non-negative elastic net, and the report that compares them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.expression import robust_z, robust_z_fit
from tilewright.operators.sampling import draw_number, k_folds
from tilewright.operators.stats import auc_interval
from tilewright.session import cut_lineage

# ---------------------------------------------------------------- candidates


def simplex_grid(spark, parts: int, steps: int) -> DataFrame:
    """(cand, w): all weight vectors of ``parts`` entries in multiples of 1 / steps that sum to 1."""
    total = (steps + 1) ** (parts - 1)
    digits = [F.floor(F.col("id") / F.lit((steps + 1) ** i)) % (steps + 1) for i in range(parts - 1)]
    used = sum(digits[1:], digits[0])
    w = F.array(*[(d / steps).cast("double") for d in digits], ((steps - used) / steps).cast("double"))
    return spark.range(total).where(used <= steps).select(F.col("id").alias("cand"), w.alias("w"))


def dirichlet_candidates(spark, parts: int, n: int, seed: int = 42) -> DataFrame:
    """(cand, w): uniform weights on the simplex, -log(u) normalised, u from a hash of the candidate and the entry."""
    base = spark.range(n).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    u = (draw_number(["id", "i"], seed, "d") + 1) / F.lit(float(16**13 + 1))
    e = base.withColumn("e", -F.log(u)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v["e"])
    return e.withColumn("_t", total).select(F.col("id").alias("cand"), F.transform("x", lambda v: v["e"] / F.col("_t")).alias("w"))


# ---------------------------------------------------------------- search


def signed(df: DataFrame, features: Sequence[str], signs: Sequence[int] | None) -> DataFrame:
    """Features turned in their fixed direction."""
    return df.withColumns({c: F.col(c).cast("double") * s for c, s in zip(features, signs or [1] * len(features), strict=True)})


def _scaled_by_fold(df: DataFrame, unit: str, label: str, features: Sequence[str], k: int, seed: int) -> DataFrame:
    """(label, fold, zs): each row's features, scaled robustly with the fit of the other folds."""
    folded = cut_lineage(k_folds(df.select(unit, label, *features), k, [unit], seed))
    names = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(features)])
    long = folded.select(unit, label, "fold", F.explode(names).alias("z")).select(unit, label, "fold", "z.f", "z.x")
    others = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i != F.col("fold"))
    fit = robust_z_fit(long.select("f", "x", F.explode(others).alias("fold")), ["fold", "f"], "x")
    z = long.join(fit, ["fold", "f"]).withColumn("z", (F.col("x") - F.col("mu")) / F.col("spread"))
    rows = z.groupBy(unit, label, "fold").agg(F.sort_array(F.collect_list(F.struct("f", "z"))).alias("v"))
    return cut_lineage(rows.select(F.col(label).alias("y"), "fold", F.transform("v", lambda p: p["z"]).alias("zs")))


#: Scores that are on disk at a time, of 16 bytes each, and scores of a fold that a task ranks at a time.
SCORES, RANGE = 1 << 28, 1 << 16


def _edges(w: np.ndarray, sizes: dict[int, int], sample: list) -> dict[int, np.ndarray]:
    """Per fold, for each weighting: scores that cut it into ranges of about RANGE rows, from a sample (of any quality: edges
    only balance the ranges)."""
    out = {}
    for fold, n in sizes.items():
        z = np.array([r["zs"] for r in sample if r["fold"] == fold])
        cuts = -(-n // RANGE) - 1
        out[fold] = np.quantile(z @ w.T, np.arange(1, cuts + 1) / (cuts + 1), axis=0).T if cuts > 0 and len(z) else np.empty((len(w), 0))
    return out


def _fold_aucs(rows: DataFrame, totals: dict[int, tuple[int, int]], some: list, edges: dict[int, np.ndarray], tasks: int) -> DataFrame:
    """(fold, cand, auc) of some candidates over the distinct (fold, zs, n1, n0).

    A task scores its rows and sends the sorted scores of a (fold, candidate, range) as one record; the records come back in
    the order of the ranges, and running counts follow them, a range at a time.
    """
    names, w = [r["cand"] for r in some], np.array([r["w"] for r in some], float)
    count = "i4" if sum(map(sum, totals.values())) < 1 << 31 else "i8"
    schema = "fold int, cand long, place int, s binary, n1 binary, n0 binary"

    def merged(s, n1, n0, kind=None):
        order = np.argsort(s, kind=kind)
        s, n1, n0 = s[order], n1[order], n0[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return (s, n1, n0) if len(first) == len(s) else (s[first], np.add.reduceat(n1, first, dtype=n1.dtype), np.add.reduceat(n0, first, dtype=n0.dtype))

    def chunks(batches, size=1 << 17):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            folds, n1, n0 = (t.column(i).to_numpy() for i in (0, 2, 3))
            z = pa.concat_arrays([c.flatten() for c in t.column(1).chunks]).to_numpy().reshape(len(folds), -1)
            for fold in np.unique(folds).tolist():
                mine = folds == fold
                x, ones, zeros = np.ascontiguousarray(z[mine].T), n1[mine].astype(count), n0[mine].astype(count)
                sent = []
                for name, each, cuts in zip(names, w, edges[fold], strict=True):
                    s = 0.0
                    for a, b in zip(each, x, strict=True):  # in the order of the features, as SQL adds them
                        s = s + a * b
                    s[np.isnan(s)] = np.inf  # last, as Spark orders them
                    s, a1, a0 = merged(s, ones, zeros)
                    at = [0, *np.searchsorted(s, cuts, side="right").tolist(), len(s)]
                    sent += [(fold, name, i, *(v[lo:hi].tobytes() for v in (s, a1, a0))) for i, (lo, hi) in enumerate(zip(at, at[1:])) if lo < hi]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                for i in range(0, len(sent), 256):
                    columns = [pa.array(v, kind) for v, kind in zip(zip(*sent[i : i + 256]), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["fold", "cand", "place", "s", "n1", "n0"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6))))
        for (fold, cand), group in groupby(records, key=lambda r: r[:2]):
            before, pairs, middle = [0, 0], 0.0, [{}, {}]
            for _, same in groupby(group, key=lambda r: r[2]):
                same = list(same)
                s, n1, n0 = (np.concatenate([np.frombuffer(r[i], kind) for r in same]) for i, kind in ((3, "f8"), (4, count), (5, count)))
                s, n1, n0 = merged(s, n1.astype("i8"), n0.astype("i8"), "stable")
                c1, c0 = before[0] + np.cumsum(n1), before[1] + np.cumsum(n0)
                pairs += float((n1 * (c0 - n0 / 2)).sum())
                for i, c in enumerate((c1, c0)):
                    last = totals[fold][i] - 1
                    for p in {last // 2, -(-last // 2)}:
                        if before[i] <= p < c[-1]:
                            middle[i][p] = s[np.searchsorted(c, p, side="right")]
                before = [int(c1[-1]), int(c0[-1])]
            m1, m0 = ((min(m.values()) + max(m.values())) / 2 for m in middle)
            auc = pairs / before[0] / before[1]
            yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int32()), "cand": [cand], "auc": [1 - auc if m1 < m0 else auc]})

    sent = rows.where(F.col("fold").isin([f for f, n in totals.items() if min(n)])).mapInArrow(score, schema)
    dealt = sent.repartition(tasks, "fold", "cand").sortWithinPartitions("fold", "cand", "place")
    return dealt.mapInArrow(rank, "fold int, cand long, auc double")


def weight_search(
    df: DataFrame, unit: str, label: str, features: Sequence[str], candidates: DataFrame, k: int = 5, seed: int = 42,
    signs: Sequence[int] | None = None, block: int = 2048,
) -> DataFrame:
    """(cand, w, auc): mean over folds of the AUC of each weighting of the features, oriented by the class medians, with the
    scaling learned on the other folds. ``signs`` turns features beforehand.

    Candidates are a table of any size, cut into blocks by a hash of their number: at most about ``block`` of them, and about
    SCORES scores. Scores travel as packed arrays, a block at a time, and are gone before the next one, so the disk holds
    16 bytes for each of SCORES scores whatever the number of candidates and rows; the work is rows times candidates.
    """
    spark = df.sparkSession
    rows = _scaled_by_fold(signed(df, features, signs), unit, label, features, k, seed)
    rows = rows.where(F.col("y").isNotNull() & ~F.exists("zs", F.isnull))
    one = F.col("y").cast("int").cast("long")
    rows = cut_lineage(rows.groupBy("fold", "zs").agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n0")).select("fold", "zs", "n1", "n0"))
    folds = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()
    sizes, totals = {r["fold"]: r["n"] for r in folds}, {r["fold"]: (r["n1"], r["n0"]) for r in folds}
    n = sum(sizes.values())
    sample = rows.select("fold", "zs").orderBy(F.xxhash64("fold", "zs")).limit(8192).collect() if max(sizes.values(), default=0) > RANGE else []
    candidates = cut_lineage(candidates)
    many = candidates.count()
    blocks = max(1, -(-many // block), -(-many * n // SCORES))
    place = F.pmod(F.xxhash64("cand"), F.lit(blocks))
    found = []
    for b in range(blocks):
        some = candidates.where(place == b).collect()
        if some:
            tasks = max(1, min(len(some) * len(sizes), len(some) * n >> 20))
            auc = _fold_aucs(rows, totals, some, _edges(np.array([r["w"] for r in some], float), sizes, sample), tasks)
            found.append(cut_lineage(auc.groupBy("cand").agg(F.avg("auc").alias("auc"))))
            if blocks > 1:
                del auc
                spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffled scores of a block once nothing refers to them
    return candidates.join(reduce(DataFrame.unionByName, found), "cand")


def best_candidate(searched: DataFrame, digits: int = 12) -> DataFrame:
    """The row of the largest AUC, the first of equal ones."""
    return searched.agg(F.max_by(F.struct("cand", "w", "auc"), F.struct(F.round("auc", digits), -F.col("cand"))).alias("b")).select("b.*")


def tuned(df: DataFrame, unit: str, label: str, features: Sequence[str], searched: DataFrame, signs: Sequence[int] | None = None) -> DataFrame:
    """(feature, weight, auc_cv, auc_full): the chosen weights, and the AUC of the combination over all rows."""
    best = best_candidate(searched).first()  # one row of as many numbers as there are features
    report = combination_report(signed(df, features, signs), unit, label, features, {"tuned": best["w"]})
    full = report.where("combo = 'tuned'").select(F.col("auc").alias("auc_full"))
    rows = [(c, float(w), float(best["auc"])) for c, w in zip(features, best["w"], strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, auc_cv double").withColumn("auc_full", full.scalar())


# ---------------------------------------------------------------- elastic net


def _gradients(rows: DataFrame, models: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Gradient of the weighted log loss of every model over the rows outside its held-out fold, divided by their weight.

    ``models`` is [model, 1 + features] with the intercept first. Each task adds up its rows; what is summed and collected
    is one line per model.
    """
    n, width = models.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width + 1))
        for b in batches:
            fold, y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            x = np.hstack([np.ones((len(y), 1)), x])
            used = w[:, None] * (fold[:, None] != held[None])
            error = used * (1 / (1 + np.exp(-np.clip(x @ models.T, -500, 500))) - y[:, None])
            total[:, :width] += error.T @ x
            total[:, width] += used.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype="i4")), pa.array(total.tolist(), pa.list_(pa.float64()))], ["m", "g"]
        )

    parts = rows.select("fold", "y", "w", "x").mapInArrow(run, "m int, g array<double>")
    sums = parts.groupBy("m").agg(*[F.sum(F.col("g")[i]) for i in range(width + 1)])
    out = np.zeros((n, width + 1))
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out[:, :width] / np.maximum(out[:, width:], 1e-300)


def elastic_net(
    df: DataFrame, unit: str, label: str, features: Sequence[str], alphas: Sequence[float] = tuple(i / 10 for i in range(11)),
    penalty: float = 0.02, k: int = 5, seed: int = 42, steps: int = 60,
) -> DataFrame:
    """(feature, weight, alpha, auc_cv): class-balanced logistic regression with an elastic net penalty and coefficients held
    at or above 0 inside the fit.

    Accelerated proximal gradient with a fixed number of ``steps``, so another engine can follow it; all mixings and folds,
    and the fits over all rows, move together, one pass over the rows a step. The step of a coefficient follows from the
    second moment of its feature. The mixing with the largest mean AUC over the folds is taken (the first of equal ones),
    and its coefficients over all rows are scaled to sum 1; where all are 0 the weights are uniform. Features are scaled
    robustly beforehand.
    """
    names = list(features)
    folded = k_folds(df.select(unit, label, *names), k, [unit], seed)
    long = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)])
    z = robust_z(folded.select(unit, label, "fold", F.explode(long).alias("q")).select(unit, label, "fold", "q.f", "q.v"), ["f"], "v")
    rows = z.groupBy(unit, F.col(label).cast("double").alias("y"), "fold").agg(F.sort_array(F.collect_list(F.struct("f", "z"))).alias("q"))
    rows = cut_lineage(rows.select("y", "fold", F.transform("q", lambda p: p["z"]).alias("x")))
    n1, n = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    rows = rows.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(n1, 1)).otherwise(0.5 / max(n - n1, 1)))
    moments = rows.agg(F.sum("w"), *[F.sum(F.col("w") * F.col("x")[i] * F.col("x")[i]) for i in range(len(names))]).first()
    width = len(names) + 1
    second = np.array([1.0, *[m / moments[0] for m in moments[1:]]])

    mix = np.repeat(np.array(alphas, float), k + 1)
    held = np.tile(np.arange(k + 1), len(alphas))  # 0 holds out nothing
    shrink = np.hstack([np.zeros((len(mix), 1)), np.repeat(penalty * (1 - mix)[:, None], width - 1, axis=1)])
    cut = np.hstack([np.zeros((len(mix), 1)), np.repeat(penalty * mix[:, None], width - 1, axis=1)])
    step = 1 / (0.25 * width * second[None] + shrink)
    now = before = np.zeros((len(mix), width))
    for i in range(1, steps + 1):
        ahead = now + (i - 1) / (i + 2) * (now - before)
        moved = ahead - step * (_gradients(rows, ahead, held) + shrink * ahead)
        before, now = now, np.hstack([moved[:, :1], np.maximum(moved[:, 1:] - step[:, 1:] * cut[:, 1:], 0)])

    fits = [(int(h), float(a), [float(b) for b in m[1:]]) for h, a, m in zip(held, mix, now, strict=True)]
    models = df.sparkSession.createDataFrame([f for f in fits if f[0]], "fold int, alpha double, b array<double>")
    scored = rows.join(F.broadcast(models), "fold")  # folds times mixings
    s = reduce(lambda t, i: t + F.col("b")[i] * F.col("x")[i], range(len(names)), F.lit(0.0))
    auc = auc_interval(scored.select("fold", "alpha", "y", F.round(s, 9).alias("s")), ["fold", "alpha"], "s", "y")
    mean = auc.groupBy("alpha").agg(F.avg("auc").alias("auc"))
    best = mean.orderBy(F.desc(F.round("auc", 9)), "alpha").first()
    beta = next(b for h, a, b in fits if h == 0 and a == best["alpha"])
    total = sum(beta)
    weights = [(c, b / total if total > 0 else 1 / len(names), best["alpha"], best["auc"]) for c, b in zip(names, beta, strict=True)]
    return df.sparkSession.createDataFrame(weights, "feature string, weight double, alpha double, auc_cv double")


# ---------------------------------------------------------------- report


def combination_report(df: DataFrame, unit: str, label: str, features: Sequence[str], weights: dict[str, Sequence[float]]) -> DataFrame:
    """(combo, auc and interval): every single feature and every named weighting of the robustly scaled features."""
    names = F.array(*[F.struct(F.lit(c).alias("combo"), F.col(c).cast("double").alias("x")) for c in features])
    z = cut_lineage(robust_z(df.select(unit, label, F.explode(names).alias("n")).select(unit, label, "n.*"), ["combo"], "x", "s"))
    single = z.select(unit, label, "combo", "s")
    place = F.create_map(*[F.lit(v) for kv in enumerate(features) for v in reversed(kv)])
    for name, w in weights.items():
        ws = F.array(*[F.lit(float(v)) for v in w])
        part = z.groupBy(unit, label).agg(F.sum(F.get(ws, place[F.col("combo")]) * F.col("s")).alias("s"))
        single = single.unionByName(part.withColumn("combo", F.lit(name)))
    return auc_interval(single.withColumn("s", F.round("s", 9)), ["combo"], "s", label)
