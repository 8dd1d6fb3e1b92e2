"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches; dynamic programming carries, for each position, the best score
and the number of pieces on the best path. The tokenizer's rules hold exactly: a candidate replaces the best one only if it
is strictly better, candidates come by ascending start, a character without a piece of its own may be unknown (lowest score
less 10) and then counts one piece per byte, and scores add up in single precision.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm import proto
from tilewright.llm.common import Memo, map_arrow, only, text_groups, tokenizer_path

#: Fixed values of the public format: the mark that stands for a blank, and what an unknown character loses.
MARK, PENALTY = "▁", 10.0
#: Scores are multiples of 1 / STEPS, so that sums below 2^24 / STEPS are exact in single precision.
STEPS = 32


def unigram_pieces(path: str | None = None) -> list[tuple[str, float, int]]:
    """Pieces of a public vocabulary as a unigram model: the n-th normal piece scores -log(n + 1), after Zipf's law, to the
    nearest 1/32. Nothing is trained."""
    out, n = [], 0
    for piece, _, kind in proto.read_pieces(path or tokenizer_path("piece_bpe_32k.model")):
        n += kind == proto.NORMAL
        out.append((piece, -round(STEPS * math.log(n + 1)) / STEPS if kind == proto.NORMAL else 0.0, kind))
    return out


def unigram_model(pieces: list[tuple[str, float, int]]) -> bytes:
    """The same pieces as a model file, for the tokenizer that the counts must equal."""
    unknown = next(i for i, p in enumerate(pieces) if p[2] == proto.UNKNOWN)
    return proto.model(pieces, proto.UNIGRAM, unknown, True, True, True)


class Counter:
    """Counts pieces text by text. Stretches of text that no piece can cross are solved once and kept in a bounded memo."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        normal = [(p, s) for p, s, kind in pieces if kind == proto.NORMAL]
        self.automaton = ahocorasick.Automaton()
        for piece, score in normal:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in normal) - PENALTY
        self.single = {p for p, _ in normal if len(p) == 1}
        self.exact = all(float(s * STEPS).is_integer() for _, s in normal)
        # no piece crosses from another character to a mark or holds a line feed, so best paths have borders there
        self.cuts = all(MARK not in p.lstrip(MARK) and "\n" not in p for p, _ in normal)
        self.memo = Memo(200_000)

    def stretch(self, s: str, start: float = 0.0, rounded: bool = False) -> tuple[float, int]:
        """Best score and number of pieces of ``s``, from score ``start``."""
        n, single, unknown = len(s), self.single, self.unknown
        best, count, at = [start, *[None] * n], [0] * (n + 1), 1  # at: the position in work
        once = (lambda x: float(np.float32(x))) if rounded else (lambda x: x)
        for end, (length, score) in chain(self.automaton.iter(s), ((n, (0, 0.0)),)):
            while at <= end:  # all matches that end at this position are in; its character may be unknown
                if s[at - 1] not in single:
                    new = unknown + best[at - 1]
                    if best[at] is None or new > best[at]:
                        best[at], count[at] = once(new), count[at - 1] + len(s[at - 1].encode())
                at += 1
            if length:  # longest first, so by ascending start
                new = score + best[at - length]
                if best[at] is None or new > best[at]:
                    best[at], count[at] = once(new), count[at - length] + 1
        return best[n], count[n]

    def _solve(self, parts: list[str]) -> list[tuple[float, int]]:
        return [self.stretch(p if p[:1] == "\n" else MARK + p) for p in parts]

    def parts(self, text: str) -> list[str]:
        """The text cut before blanks and line feeds. A part stands for itself with a mark before it, unless it starts with
        a line feed."""
        cut = text.replace("\n", " \n").split(" ")
        if "" not in cut:
            # the mark that starts every text is a part of its own before a line feed
            return ["", *cut] if text[0] == "\n" else cut
        out, run = [], -1  # run: blanks before the next part, without the one that a part has itself
        for p in cut:
            if not p:
                run += 1
            elif p[0] == "\n":
                if run >= 0:
                    out.append(MARK * run)
                out.append(p)
                run = -1
            else:
                out.append(MARK * (run + 1) + p)
                run = -1
        return [*out, MARK * run] if run >= 0 else out

    def count(self, group: list[str]) -> list[tuple[float, int]]:
        """Best score and number of pieces of each text."""
        cut = [self.parts(t) if t and self.cuts and MARK not in t else [] for t in group]
        self.memo.fill(set().union(*cut), self._solve)
        return [self._total(t, parts) for t, parts in zip(group, cut, strict=True)]

    def _total(self, text: str, parts: list[str]) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not parts:
            return self.stretch(MARK + text.replace(" ", MARK), rounded=True)
        scores, counts = zip(*map(self.memo.__getitem__, parts), strict=True)
        score = sum(scores)
        if self.exact and -score < 2**24 / STEPS - 64:
            return score, sum(counts)
        score, pieces = 0.0, 0  # sums are rounded from here on, and rounding may decide
        for p, own, n in zip(parts, scores, counts, strict=True):
            if self.exact and -(score + own) < 2**24 / STEPS - 64:
                score, pieces = score + own, pieces + n
            else:
                score, n = self.stretch(p if p[:1] == "\n" else MARK + p, score, rounded=True)
                pieces += n
        return score, pieces


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_pieces`` and ``best_score`` of the whole text, in one narrow pass.

    A null or empty text has no pieces and score 0; repeated rows are counted each; null ids stay null; other columns of
    ``df`` are not carried. ``path`` is the vocabulary's model file.
    """
    where = path or tokenizer_path("piece_bpe_32k.model")

    def make():
        use = Counter(unigram_pieces(where))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [x for group in text_groups(batch.column(1)) for x in use.count(group)]
            counts = pa.array([n for _, n in found], pa.int64())
            scores = pa.array([float(s) for s, _ in found], pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0), counts, scores], ["doc_id", "n_pieces", "best_score"])

        return each

    kind = dict(df.dtypes)[id_col]
    return map_arrow(
        only(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_pieces bigint, best_score double"
    )
