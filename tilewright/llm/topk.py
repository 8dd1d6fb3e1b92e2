"""Exact inner-product search over vectors that are grouped by length.

Candidates are sorted by length and packed into buckets of neighbouring lengths. A query's best scores so far are a lower
bound of what is still wanted, so in each bucket a query needs a certain cosine: bound / (query length * longest vector). A
bucket whose needed cosine is over 1 never meets a block of such queries. Where it is high, a candidate's coordinate along
the query's largest coordinate must lie in a narrow range (coordinate pruning); else only candidates that are long enough
remain (length pruning). What remains is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, only

#: Vectors of a bucket and queries of a block.
BUCKET, BLOCK = 4096, 1024
#: Lanes that buckets are dealt to: each gets a copy of the queries, a small share of the vectors. Bytes of queries that a
#: task holds: from there on blocks come in groups, and each group gets a copy of the buckets.
LANES, HELD = 32, 1 << 25
#: Blocks whose best results a task keeps before they leave it.
KEPT = 256
#: Partitions that vectors are sorted into at most; the driver sees a sample of each one's lengths.
SORTED = 1024
#: From this needed cosine on, the coordinate range is narrower than what length alone leaves.
COORDINATE = 0.5
#: Products and sums below this are exact in double precision.
EXACT = 2.0**53


def integers(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v, dim, norm): components times ``scale``, rounded down; vectors that are null, or hold null or a non-finite
    component, are left out."""
    x = only(df, id=id_col, x=F.transform(df[vector_col], lambda c: c.cast("double") * F.lit(scale)))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    v = v.select("id", F.transform("x", lambda c: F.floor(c)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return v.withColumns({"dim": F.size("v"), "norm": F.sqrt(square)})


def _packed(df: DataFrame, size: int, stem: str) -> DataFrame:
    """Rows of up to ``size`` vectors of one dimension, highest ``rank_by`` first: (dim, block, most, least, ids, vectors,
    bounds), where ``most`` and ``least`` are the ends of ``rank_by`` in the block; ids, vectors and bounds are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []
        for b in chain(batches, [None]):
            parts = [*held, *([] if b is None else [b.to_pandas()])]
            held = []
            if not parts:
                continue
            for dim, own in pd.concat(parts).groupby("dim", sort=False):
                for at in range(0, len(own), size):
                    some = own.iloc[at : at + size]
                    if len(some) < size and b is not None:
                        held.append(some)
                        continue
                    v = _narrow(np.stack(some["v"].to_numpy()).astype("int64"))
                    columns = [
                        [int(dim)], [(part << 32) + n], [float(some["rank_by"].max())], [float(some["rank_by"].min())],
                        [some["id"].to_numpy("int64").tobytes()], [v.tobytes()],
                        [some["bound"].to_numpy("float64").tobytes()],
                    ]
                    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["dim", "block", "most", "least", "ids", "vectors", "bounds"],
                    )
                    n += 1

    rows = df.select("dim", "id", "v", "rank_by", "bound").sortWithinPartitions("dim", F.col("rank_by").desc(), "id")
    schema = "dim int, block bigint, most double, least double, ids binary, vectors binary, bounds binary"
    return fresh(rows.mapInArrow(run, schema), stem)


def _narrow(v: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds all of them: blocks travel in many copies."""
    low, high = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "int64")
    size = len(vectors) // max(1, len(i) * dim)  # bytes of a component; vectors without components have none
    return i, np.frombuffer(vectors, f"i{size or 1}").reshape(len(i), dim).astype("int64")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype("float64") @ b.T.astype("float64")).astype("int64")
    return a @ b.T


def bucket_best(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int,
                floor: np.ndarray | None = None) -> Iterator[tuple]:
    """(query, id, score) of the at most k best of one bucket for each query, ties to the smaller id; none below its bound
    or ``floor``, and of a repeated id the best. The bucket's vectors come longest first."""
    floor = bounds if floor is None else np.maximum(bounds, floor)
    repeats = len(np.unique(ids)) < len(ids)
    lengths = np.sqrt((v.astype("float64") ** 2).sum(axis=1))
    own = np.sqrt((q.astype("float64") ** 2).sum(axis=1))
    longest = lengths[0] if len(lengths) else 0.0
    slack = 1 + 1e-9
    unit = v / np.maximum(lengths, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(np.isneginf(bounds), -np.inf, bounds / (own * longest * slack))
    needed[np.isnan(needed)] = -np.inf  # a zero query or an empty length: every product is zero
    order: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    whole = [i for i in range(len(q)) if needed[i] <= 1 and needed[i] < COORDINATE]
    for i in range(len(q)):
        if not COORDINATE <= needed[i] <= 1:
            continue
        f = int(np.abs(q[i]).argmax())
        if f not in order:
            at = np.argsort(unit[:, f], kind="stable")
            order[f] = at, unit[at, f]
        at, values = order[f]
        c = q[i, f] / own[i]
        spread = np.sqrt(max(0.0, (1 - needed[i] ** 2) * (1 - c**2)))
        middle = c * needed[i]
        # cosine at least t means an angle to the query of at most arccos t: the coordinate's range on the sphere
        low = -1.0 if -c >= needed[i] else middle - spread
        high = 1.0 if c >= needed[i] else middle + spread
        some = np.sort(at[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")])
        yield from _best(q_ids[i], products(q[i : i + 1], v[some])[0], ids[some], floor[i], k, repeats)
    for at in range(0, len(whole), 256):
        rows = np.array(whole[at : at + 256])
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(bounds[rows] > 0, bounds[rows] / (own[rows] * slack), 0)
        enough = int((lengths >= np.nanmin(least)).sum())  # a prefix, as lengths fall
        scores = products(q[rows], v[:enough])
        for i, s in zip(rows, scores, strict=True):
            yield from _best(q_ids[i], s, ids[:enough], floor[i], k, repeats)


def _best(query: int, scores: np.ndarray, ids: np.ndarray, bound: float, k: int, repeats: bool) -> Iterator[tuple]:
    keep = np.flatnonzero((ids != query) & (scores >= bound))
    if repeats:
        keep = keep[np.lexsort((-scores[keep], ids[keep]))]
        keep = keep[np.unique(ids[keep], return_index=True)[1]]
    if len(keep) > k:
        edge = np.partition(scores[keep], -k)[-k]
        keep = keep[scores[keep] >= edge]
    for i in keep[np.lexsort((ids[keep], -scores[keep]))][:k]:
        yield int(query), int(ids[i]), int(scores[i])


def _best_so_far(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, id, score) the ``k`` best ids of each query, each with its best score, ties to the smaller id."""
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)][: len(found)]]
    found = found[np.lexsort((found[:, 1], -found[:, 2], found[:, 0]))]
    return found[_places(found) < k]


def _places(found: np.ndarray) -> np.ndarray:
    """Numbers from 0 within each query, of rows that come by query."""
    start = np.flatnonzero(np.r_[True, found[1:, 0] != found[:-1, 0]][: len(found)])
    return np.arange(len(found)) - np.repeat(start, np.diff(np.r_[start, len(found)]))


def _floor(q_ids: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query so far; minus infinity for those that have fewer."""
    last = best[_places(best) == k - 1]
    out = np.full(len(q_ids), -np.inf)
    if len(last):
        at = np.minimum(np.searchsorted(last[:, 0], q_ids), len(last) - 1)
        out = np.where(last[at, 0] == q_ids, last[at, 2], out)
    return out


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the joined rows of a query block (q_block, q_ids, q_vectors, q_bounds) and a bucket. A
    pair is unpacked at a time; a block's results of all buckets of a task leave it as the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for found in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["query_id", "vec_id", "score"])
            held.clear()

        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                ids, v = _unpacked(r["ids"], r["vectors"], r["dim"])
                q_ids, q = _unpacked(r["q_ids"], r["q_vectors"], r["dim"])
                if r["q_block"] not in held and len(held) >= KEPT:
                    yield from emptied()
                best = held.get(r["q_block"], np.empty((0, 3), "int64"))
                bounds = np.frombuffer(r["q_bounds"], "f8")
                found = list(bucket_best(q_ids, q, bounds, ids, v, k, _floor(q_ids, best, k)))
                new = np.array(found, "int64").reshape(len(found), 3)
                held[r["q_block"]] = _best_so_far(np.concatenate([best, new]), k)
        yield from emptied()

    columns = ["dim", "ids", "vectors", "q_block", "q_ids", "q_vectors", "q_bounds"]
    return pairs.select(*columns).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _query_blocks(asked: DataFrame, size: int, stem: str) -> DataFrame:
    """Blocks of queries under the names that a pair has: (dim, q_block, q_least, q_ids, q_vectors, q_bounds)."""
    names = {"block": "q_block", "least": "q_least", "ids": "q_ids", "vectors": "q_vectors", "bounds": "q_bounds"}
    return _packed(asked, size, stem).select("dim", *[F.col(a).alias(b) for a, b in names.items()])


def _dealt(block: str, n: int) -> Column:
    """Number below ``n`` of a block: blocks of one partition share it, those of neighbouring partitions don't."""
    return F.pmod(F.shiftright(block, 32), F.lit(n)).cast("int")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _met(buckets: DataFrame, blocks: DataFrame, cells: int) -> DataFrame:
    """Pairs of a bucket and a block of queries of one dimension and ``cell``, for buckets that are long enough for the block.

    Both sides are dealt by cell: nothing is broadcast, as one side would pass through the driver with all its copies, and
    partitions aren't merged by their bytes, as the work is in the pairs.
    """
    b = buckets.select(F.col("dim").alias("b_dim"), F.col("cell").alias("b_cell"), "most", "ids", "vectors")
    b = b.repartition(cells, "b_dim", "b_cell").hint("merge")
    met = (F.col("dim") == F.col("b_dim")) & (F.col("cell") == F.col("b_cell"))
    enough = F.col("most") * F.lit(1 + 1e-9) >= F.col("q_least")
    return b.join(blocks.repartition(cells, "dim", "cell"), met & enough)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50,
          scale: float = 256.0) -> DataFrame:
    """Per query (rows whose id is divisible by ``every``) the ``k`` best other rows by integer inner product.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; ties go to the smaller id, and a query with fewer than
    ``k`` candidates gets all of them. Only vectors of a query's own dimension are its candidates. Rows with a null id or
    an unusable vector take no part; rows that repeat an id with the same vector count once (the id itself is never its own
    candidate), and an id with several vectors counts once, with its best product; an empty table gives no rows. Queries
    come in blocks and candidates in buckets; a task compares one of each at a time, and holds the blocks of one group.
    """
    spark = df.sparkSession
    own = fresh(integers(df, id_col, vector_col, scale).dropDuplicates(["id", "v"]), "vectors")
    n = own.count()
    spread = max(1, min(-(-n // BUCKET), SORTED))
    unbounded = F.lit(float("-inf"))
    dealt = own.withColumns({"rank_by": F.col("norm"), "bound": unbounded})
    dealt = dealt.repartitionByRange(spread, F.col("dim"), F.col("norm").desc(), F.xxhash64("id"))
    buckets = _packed(dealt, BUCKET, "buckets").drop("bounds")
    asked = own.where(F.col("id") % every == 0)
    parts = max(1, -(-n // (every * BLOCK)))

    # the bucket with the longest vectors of each dimension gives every query its first bound
    first = buckets.groupBy("dim").agg(F.max_by("block", F.struct("most", "block")).alias("block"))
    seeds = fresh(buckets.join(first, ["dim", "block"]), "seeds")
    begun = asked.withColumns({"rank_by": unbounded, "bound": unbounded}).repartition(parts, F.xxhash64("id"))
    begun = _query_blocks(begun, BLOCK, "begun").withColumn("cell", _dealt("q_block", parts))
    begun = _searched(_met(seeds.withColumn("cell", _each(parts)), begun, parts), k)
    begun = begun.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    worst = begun.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(unbounded).alias("bound")
    )

    # a better product needs a vector of at least bound / own length; queries of like need share a block
    bounded = asked.join(worst, "id", "left").withColumn("bound", F.coalesce("bound", unbounded))
    # (of an id with several vectors, a zero vector can't reach a bound that another one has set)
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm"))
    need = need.when(F.col("bound") > 0, F.lit(float("inf"))).otherwise(unbounded)
    bounded = bounded.withColumn("rank_by", need)
    bounded = bounded.repartitionByRange(parts, F.col("dim"), F.col("rank_by").desc(), F.xxhash64("id"))
    bounded = _query_blocks(bounded, BLOCK, "queries")

    # buckets are dealt to lanes, and the blocks go to each lane; a pair is made only if the bucket is long enough for it
    size = sum(F.octet_length(c) for c in ("q_ids", "q_vectors", "q_bounds"))
    lanes, groups = min(spread, LANES), max(1, -(-(bounded.agg(F.sum(size)).first()[0] or 0) // HELD))
    each_group = buckets.withColumn("group", _each(groups)).withColumn("cell", _dealt("block", lanes) * groups + F.col("group"))
    each_lane = bounded.withColumn("lane", _each(lanes)).withColumn("cell", F.col("lane") * groups + _dealt("q_block", groups))
    pairs = _met(each_group, each_lane, lanes * groups)
    best = _searched(pairs, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
