"""Byte-level BPE through a SentencePiece model that is written directly from a rank file.

Every byte is mapped to a printable character, so that each byte string of the vocabulary is a piece of text. The piece's
score is its negative rank: SentencePiece merges the best-scored pair first and the leftmost of equals, which is the rank
rule of byte-level BPE. Nothing is normalised. Text is cut into pre-tokens, each is encoded by itself, and decoding maps
ids to pieces and their characters back to bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm import proto
from tilewright.llm.common import Memo, map_arrow, only, text_groups, tokenizer_path


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The vocabulary as a SentencePiece BPE model; ids are ranks, the unknown piece comes last."""
    shown = byte_characters()
    pieces = [("".join(shown[b] for b in t), -float(i), proto.NORMAL) for i, t in enumerate(tokens)]
    return proto.model([*pieces, ("<unk>", 0.0, proto.UNKNOWN)], proto.BPE, len(tokens), False, False, False)


class Codec:
    """Encoder and decoder of one rank file; pre-tokens that were met before come from a bounded memo."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        shown = byte_characters()
        self.to_shown = {b: c for b, c in enumerate(shown)}
        back = {c: b for b, c in enumerate(shown)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        # pre-tokens never reach over a single blank or line feed that has other characters on both sides
        self.cuts = pattern == public_tokenizers.PATTERN
        self.words, self.stretches = Memo(), Memo()

    def _solve_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        ids = self.model.encode([r.decode("latin-1").translate(self.to_shown) for r in raw], num_threads=1)
        # a pre-token that is itself in the vocabulary is that token, whether or not merges lead to it
        whole = self.whole
        return [self.packed(whole[r]) if r in whole else struct.pack(f"<{len(i)}i", *i) for r, i in zip(raw, ids)]

    @staticmethod
    def packed(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def _solve_stretches(self, parts: list[str]) -> list[bytes | None]:
        """``part`` follows a blank, unless it starts with the line feed that it follows. None: its ends are white space,
        so that it can't be split by itself."""
        inner = [p[p[:1] == "\n" :] for p in parts]
        sound = [bool(i) and not i[0].isspace() and not i[-1].isspace() for i in inner]
        split = [
            self.split(p if p[0] == "\n" else " " + p) if good else () for p, good in zip(parts, sound, strict=True)
        ]
        flat = [w for words in split for w in words]
        ids = iter(self._solve_words(flat))
        return [b"".join(next(ids) for _ in words) if good else None for words, good in zip(split, sound, strict=True)]

    def encode(self, group: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [t.replace("\n", " \n").split(" ") if self.cuts else [] for t in group]
        firsts = [parts[0] if parts else "" for parts in cut]
        sound = [bool(f) and not f[0].isspace() and not f[-1].isspace() for f in firsts]
        self.stretches.fill(set().union(*(parts[1:] for parts, good in zip(cut, sound) if good)), self._solve_stretches)
        look = self.stretches.__getitem__
        found = [list(map(look, parts[1:])) if good else [None] for parts, good in zip(cut, sound, strict=True)]
        # the first word has no blank before it; texts with other white space are split as a whole
        by_pattern = [self.split(t if None in f else first) for t, f, first in zip(group, found, firsts, strict=True)]
        self.words.fill(set().union(*by_pattern), self._solve_words)
        look = self.words.__getitem__
        return [
            b"".join([*map(look, words), *(() if None in f else f)])
            for words, f in zip(by_pattern, found, strict=True)
        ]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Ids of every whole text, in one narrow pass.

    Returns ``doc_id`` and ``ids`` (array of int). A null or empty text has no ids; rows that repeat are encoded each;
    null row ids stay null; other columns of ``df`` are not carried. ``path`` is a rank file, ``pattern`` the expression
    whose matches are the pre-tokens.
    """
    where = _defaults(path, pattern)
    known = dict(df.dtypes)[id_col]

    def make():
        use = Codec(*where)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [ids for group in text_groups(batch.column(1)) for ids in use.encode(group)]
            ends = np.cumsum([0, *map(len, parts)], dtype="int64") // 4
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), flat)
            return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

        return each

    return map_arrow(only(df, doc_id=id_col, text=text_col), make, f"doc_id {known}, ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Replaces the ids by their bytes (``out``, binary) and keeps the other columns. Null ids give null; an id outside
    the vocabulary is an error."""
    where = _defaults(path, pattern)
    keep = [c for c in df.columns if c not in (ids_col, out)]
    kinds = dict(df.dtypes)

    def make():
        use = Codec(*where)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            decoded = [None if i is None else use.decode(i.tolist()) for i in _lists(batch.column(len(keep)))]
            columns = [batch.column(i) for i in range(len(keep))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(decoded, pa.binary())], [*keep, out])

        return each

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` binary"])
    return map_arrow(df.select(*[df[c] for c in keep], df[ids_col]), make, schema)


def _lists(column: pa.ListArray) -> list[np.ndarray | None]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [None if null else flat[a:b] for a, b, null in zip(ends, ends[1:], column.is_null().to_pylist())]
