"""Harmonic packing of token sequences.

A piece of t ids belongs to class k = capacity // t, and a bin of class k holds exactly k pieces. A document is cut so that
each piece nearly fills its share: the longest piece that fits is taken off until the rest is itself close to a share. Every
worker fills the bins of each class by itself; it keeps at most k - 1 pieces of a class in hand. What is left in hand at the
end is filled again by ever fewer workers. The last remainder, bounded by the capacity alone, is packed by decreasing length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.byte_bpe import byte_characters
from tilewright.llm.common import Memo, fresh, give_back, only, single_threaded, text_groups, tokenizer_path

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: A piece may leave this part of its share unused.
SLACK = 1 / 128
#: So many workers' rests go to one worker of the next round.
FAN_IN = 16


#: Marks that never belong to the letters before them, and the end of the letters whose properties all libraries agree on.
MARKS, LETTERS = ".,;:!?%$&*|#()", "\u0530"


class WordIds:
    """Ids of texts. White space splits the tokenizer's words and is dropped, so each stretch between ASCII white space has
    its ids by itself; stretches met before come from a bounded memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        single_threaded()
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in self.specials)) if self.specials else None
        # their strings stand for themselves as written; lower-cased words that only look like them are ordinary text
        self.tokenizer.encode_special_tokens = True
        self.shown = dict(enumerate(byte_characters()))
        self.memo, self.stems = Memo(200_000), Memo()

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of plain letters are one word of the model; the others go through the whole tokenizer."""
        plain = [self._plain(w) for w in words]
        rest = [w for w, p in zip(words, plain, strict=True) if p is None]
        whole = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        merged = self.tokenizer.model.tokenize
        ids = [next(whole).ids if p is None else [t.id for t in merged(p)] for p in plain]
        return [struct.pack(f"<{len(i)}I", *i) for i in ids]

    def _plain(self, word: str) -> str | None:
        """The word as the model sees it, if it is made of letters below U+0530 that normalisation leaves as they are."""
        if word.isascii():
            return word if word.isalpha() and word.islower() else None
        plain = word.isalpha() and max(word) < LETTERS and word == word.lower() and is_normalized("NFC", word)
        return word.encode().decode("latin-1").translate(self.shown) if plain else None

    def _solve(self, words: list[bytes]) -> list[bytes]:
        """Marks after a letter are a word of the tokenizer by themselves."""
        texts = [w.decode() for w in words]
        stems = [t.rstrip(MARKS) for t in texts]
        apart = [
            s is not t and s[-1:] < LETTERS and len(c := s[-1:].lower()) == 1 and c.isalpha()  # lower case may add marks
            for s, t in zip(stems, texts, strict=True)
        ]
        stems = [s if a else t for s, a, t in zip(stems, apart, texts, strict=True)]
        ends = [t[len(s) :] for s, t in zip(stems, texts, strict=True)]
        self.stems.fill({*stems, *ends} - {""}, self._encode)
        return [self.stems[s] + (self.stems[e] if e else b"") for s, e in zip(stems, ends, strict=True)]

    def ids(self, group: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. A special token's string is its id, and the text on each side
        of it is encoded by itself."""
        found = {i: None for i, t in enumerate(group) if any(s in t for s in self.specials)}
        if not found:
            return self._ids(group)
        parts = [self.special.split(group[i]) for i in found]
        parts = [[p for p in own if p is not None] for own in parts]
        flat = [p for own in parts for p in own if p not in self.specials]
        plain = iter(self._ids([t for i, t in enumerate(group) if i not in found] + flat))
        out = [b"" if i in found else next(plain) for i in range(len(group))]
        for i, own in zip(found, parts, strict=True):
            out[i] = b"".join(struct.pack("<I", self.specials[p]) if p in self.specials else next(plain) for p in own)
        return out

    def _ids(self, group: list[str]) -> list[bytes]:
        words = [t.encode().lower().split() for t in group]  # the tokenizer lowers letters anyway
        self.memo.fill(set().union(*words), self._solve)
        return [b"".join(map(self.memo.__getitem__, w)) for w in words]


@lru_cache(65536)
def cuts(n: int, capacity: int) -> tuple[int, ...]:
    """Lengths that a document of ``n`` ids is cut into."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - SLACK) * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return tuple(out)


def cutter(capacity: int, end_id: int, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, text) to a row per piece: where it starts in the document's ids, how long it is, and the CRC-32 of its
    ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, end = WordIds(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            all_ids = (x for group in text_groups(batch.column(1), 300_000) for x in use.ids(group))
            for row, ids in enumerate(all_ids):
                ids += end
                here, n = 0, len(ids) // 4
                for size in cuts(n, capacity):
                    at.append(row)
                    start.append(here)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * here : 4 * (here + size)]))
                    total.append(n)
                    here += size
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *numbers],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        del use

    return run


def filler(capacity: int, level: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fill a worker's bins. Pieces in full bins get a sequence and an offset; those left in hand get none, or are packed
    by decreasing length if this is the last worker."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = (level << 56) | (TaskContext.get().partitionId() << 32), 0
        hands: dict[int, list[tuple]] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            values = zip(*rows, strict=True) if rows else [[]] * len(columns)
            arrays = [pa.array(list(v), pa.int64() if i else kind) for i, v in enumerate(values)]
            return pa.RecordBatch.from_arrays(arrays, columns)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            full = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = capacity // row[2]
                hand = hands.setdefault(k, [])
                hand.append(row)
                if len(hand) == k:
                    at = 0
                    for r in hand:
                        full.append((*r, base + made, at))
                        at += r[2]
                    made += 1
                    hand.clear()
            yield batch(full)
        rest = [r for hand in hands.values() for r in hand]
        if not last:
            for i in range(0, len(rest), 10_000):
                yield batch([(*r, None, None) for r in rest[i : i + 10_000]])
            return
        used: list[int] = []
        out, first = [], {}
        for r in sorted(rest, key=lambda r: -r[2]):  # a stable order: ties stay as they came
            i = first.get(r[2], 0)  # bins before it have no room for this length
            while i < len(used) and used[i] + r[2] > capacity:
                i += 1
            first[r[2]] = i
            if i == len(used):
                used.append(0)
            out.append((*r, base + made + i, used[i]))
            used[i] += r[2]
        if out:
            yield batch(out)

    return run


def harmonic_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2,
                     path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack every whole text.

    Returns a row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.
    A null or empty text is the end id alone; strings of special tokens become their ids, as the tokenizer has it; repeated rows are packed each; null ids stay null; an empty table gives no
    rows; other columns are not carried. ``path`` is the tokenizer's file. Each round is written once to the shared
    folder, so that a lost executor doesn't deal pieces anew.
    """
    where = path or tokenizer_path("word_bpe_49k.json")
    level = 0
    docs = only(df, doc_id=id_col, text=text_col)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {PIECE}, sequence_id bigint, offset bigint"
    parts = docs.rdd.getNumPartitions()
    cut, first = cutter(capacity, end_id, where), filler(capacity, level, parts <= 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from first(cut(batches))  # in one worker process
        give_back()

    done = fresh(docs.mapInArrow(packed, schema), "packed")
    rounds = [done]
    while parts > 1:
        level, parts = level + 1, -(-parts // FAN_IN)
        rest = done.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset").coalesce(parts)
        done = fresh(rest.mapInArrow(filler(capacity, level, parts == 1), schema), "packed")
        rounds.append(done)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.where(F.col("sequence_id").isNotNull())
