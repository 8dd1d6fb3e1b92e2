"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are estimated: one of target text (rows labelled good), one of all raw text. The log
ratio of a document under the two, summed over its n-grams, is its log importance weight, and a sample without replacement is
drawn by Gumbel top-k: each weight gets independent standard Gumbel noise, and the k largest sums are the sample, which takes
documents one after the other with a probability in proportion to their weights. n-grams are words, pairs of words, and the
last two bytes of words; a word that follows itself is one pair whatever it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Memo, fresh, give_back, text_groups
from tilewright.session import forget

#: Slots of each of the three kinds of n-grams, and how many rows of a slot's count are doubted.
SLOTS, DOUBT = 1 << 14, 16.0
KINDS = 3
#: Characters of text whose slots are held at a time.
AT_ONCE = 200_000
MULTIPLIER, MIXER = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)

def _hashes(words: list[bytes]) -> list[int]:
    from xxhash import xxh32_intdigest

    return [xxh32_intdigest(w, 7) << 32 | xxh32_intdigest(w[-2:], 9) for w in words]


def ngram_slots(group: list[str], memo: Memo) -> Iterator[np.ndarray]:
    """The slots of every n-gram of each text."""
    words = [t.encode().lower().split() for t in group]
    memo.fill(set().union(*words), _hashes)
    for w in words:
        both = np.fromiter(map(memo.__getitem__, w), "u8", len(w))
        word, end = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        pair = ((word[:-1] * MULTIPLIER + word[1:]) * MIXER >> np.uint64(40)) % np.uint64(SLOTS)
        pair[word[:-1] == word[1:]] = 0
        yield np.concatenate(
            [word % np.uint64(SLOTS), pair + np.uint64(SLOTS), end % np.uint64(SLOTS) + np.uint64(2 * SLOTS)]
        ).astype("i4")


def _labelled(labels: DataFrame, fit_rows: int) -> dict:
    """id -> good, of at most ``fit_rows`` labelled rows (those with the smallest hash); ids with both labels are left out."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    good, bad = {r[0] for r in rows if r[1] > 0}, {r[0] for r in rows if r[1] <= 0}
    return {i: i in good for i in good ^ bad}


def fit(df: DataFrame, id_col: str, text_col: str, labelled: dict) -> np.ndarray:
    """Log ratio of each slot. Raw counts are those of all rows, target counts those of the rows labelled good."""
    good = {i for i, g in labelled.items() if g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        raw, target = np.zeros((2, KINDS * SLOTS), "int64")
        for b in batches:
            ids = iter(b.column(0).to_pylist())
            for group in text_groups(b.column(1), AT_ONCE):
                found = list(ngram_slots(group, memo))
                wanted = [slots for slots in found if next(ids) in good]
                for counts, some in ((raw, found), (target, wanted)):
                    if some:
                        counts += np.bincount(np.concatenate(some), minlength=KINDS * SLOTS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (used, raw[used], target[used])], ["slot", "raw", "target"]
        )
        del memo
        give_back()

    counts = df.select(id_col, text_col).mapInArrow(run, "slot bigint, raw bigint, target bigint")
    raw, target = np.zeros((2, KINDS, SLOTS))
    for slot, r, t in counts.groupBy("slot").agg(F.sum("raw"), F.sum("target")).collect():
        raw.flat[slot], target.flat[slot] = r, t
    share = target.sum(axis=1, keepdims=True) / np.maximum(raw.sum(axis=1, keepdims=True), 1)
    return np.log((target + DOUBT) / (raw * share + DOUBT)).ravel()


def weigh(df: DataFrame, id_col: str, text_col: str, carry: list[str], ratio: np.ndarray, seed: int) -> DataFrame:
    """(row, log_weight, gumbel_key): the log ratio summed over a text's n-grams, and that plus standard Gumbel noise that
    follows the row's id. A text without words has no weight."""

    @F.arrow_udf("double")
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo()
        for batch in batches:
            slots = (s for g in text_groups(batch, AT_ONCE) for s in ngram_slots(g, memo))
            yield pa.array([float(ratio[s].sum()) if len(s) else None for s in slots], pa.float64())
        del memo
        give_back()

    # only texts go to Python, and only numbers come back; the rows stay where they are
    row = F.struct(*carry) if carry else F.lit(None)
    out = df.select(row.alias("row"), weight(F.col(text_col)).alias("log_weight"), F.col(id_col).alias("id"))
    return out.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("id"), seed)).drop("id")


def gumbel(id_: Column, seed: int) -> Column:
    """Standard Gumbel noise by the hash of an id."""
    unit = (F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(unit))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """Exact k-th largest value by histograms: the driver gets at most 4096 counts, and then at most 4096 values."""
    bins, rank = 4096, k
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        if low == high:
            return low
        inside = df.where(F.col(column).between(low, high))
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")
        edges = inside.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min(column), F.max(column))
        for _, n, least, most in sorted(edges.collect(), reverse=True):
            if rank <= n:
                low, high = least, most
                break
            rank -= n
        if n <= bins:
            values = sorted(r[0] for r in inside.where(F.col(column).between(low, high)).select(column).collect())
            return values[-rank]


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             carry: list[str] | None = None, k: int | None = None, share: float | None = None, fit_rows: int = 20_000,
             seed: int = 11) -> DataFrame:
    """Weigh every row, draw k of them, and say which.

    Returns ``row`` (a struct of the ``carry`` columns, all of them by default), ``log_weight``, ``gumbel_key`` and
    ``kept``. The target model is fitted on at most ``fit_rows`` rows of ``labels(doc_id, quality)``; the raw model and the
    weights cover all rows. The size of the sample is ``k``, or ``share`` of the rows with a weight, by default the target's
    share of the labelled rows, so that the sample is as large as the part of the corpus that is like the target; without
    labels of both classes every row with a weight is kept. Null, empty and blank texts have no weight and are not kept;
    repeated rows share their noise and stay or go together, as do ties at the k-th key; an empty table gives no rows.

    Named ``carry`` columns are written with the weights. For whole rows the texts are weighed a second time instead, so that
    the corpus is not written once more.
    """
    labelled = _labelled(labels, fit_rows)
    ratio = fit(df, id_col, text_col, labelled)
    again = carry is None
    held = weigh(df, id_col, text_col, [id_col] if again else [*dict.fromkeys([id_col, *carry])], ratio, seed)
    held = fresh(held, "weights")
    weighted = held.where("log_weight is not null")
    total = weighted.count()
    if k is None:
        good = sum(labelled.values())
        like = share if share is not None else good / len(labelled) if 0 < good < len(labelled) else 1.0
        k = round(like * total)
    at = -math.inf if k >= total else kth_largest(weighted, "gumbel_key", k) if k > 0 else math.inf
    if again:
        forget(held)
        held = weigh(df, id_col, text_col, [*dict.fromkeys([id_col, *df.columns])], ratio, seed)
    return held.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(at), F.lit(False)))
