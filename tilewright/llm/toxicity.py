"""Toxicity by a learned lexicon, misspellings included, and the context of each hit.

The lexicon is learned from labelled texts: whole words and word beginnings that texts labelled toxic hold far more often. It
is kept as a trie. Every word of a text becomes a Levenshtein automaton, whose states are run against the trie, so a term is
found in all spellings within the edit bound without listing them. The evidence of a term as it is and of its misspellings is
estimated apart. A window of words around each hit tells quotation (quotation marks around it, verbs of saying) from abuse
(address in the second person), and a logistic model over few totals gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Memo, give_back, only, text_groups

#: A word, or a quotation mark.
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»‹›]")
MARKS = frozenset("\"“”„«»‹›")
#: Verbs of saying and forms of address in the corpus's languages: fixed values.
SAYING = frozenset(
    "said says say wrote writes called calls quote quoted quotes word words term "
    "dit dits écrit écrivait appelé cité mot mots citation "
    "sagte sagt schrieb nannte genannt zitat zitiert wort wörter "
    "dijo dice escribió llamó cita citó palabra palabras".split()
)
ADDRESS = frozenset("you your yours u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú usted ustedes vosotros".split())
#: Words looked at on each side of a hit, and how far the other mark of a quotation may lie.
WINDOW, QUOTATION = 5, 12
#: Lengths of word beginnings that may become terms; whole words may be longer. The mark of a whole word.
SHORTEST, LONGEST = 3, 10
WHOLE = "$"
#: Letters of a word that settle whether it can match at all.
HEAD = 5
#: Minima by which copies among the training texts are told.
SKETCHES = 3
#: Likelihood ratio statistic from which a candidate is a term: millions of candidates are tried.
LEAST_GAIN = 25.0
#: Pseudo-observations behind each estimated weight.
DOUBT = 2.0
FEATURES = 8


@dataclass
class Lexicon:
    """Terms with their evidence at each number of edits, as a trie of dictionaries: ``#`` leads to a term's number."""

    terms: list[str]
    weights: np.ndarray  # [term, edits]
    trie: dict = field(default_factory=dict)
    deepest: int = 0

    def __post_init__(self):
        for number, term in enumerate(self.terms):
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node["#"] = number
        self.deepest = max(map(len, self.terms), default=0)


def edit_bound(term: str, bound: int) -> int:
    """Edits allowed in a term: none in short ones, where another word is too near."""
    return min(bound, max(0, (len(term.rstrip(WHOLE)) - 2) // 3))


def matches(word: str, lexicon: Lexicon, bound: int = 1) -> list[tuple[int, int]]:
    """(term, edits) of every term that the word holds within its bound, each at its fewest edits.

    The automaton of the word is kept as one bit set per number of edits: bit p is set if the letters read so far turn into
    the word's first p letters with that many edits. Reading a letter of the trie moves the sets; a branch ends when all are
    empty. A whole word needs the last bit at its end mark; a word beginning needs any bit.
    """
    n = len(word)
    full = (1 << (n + 1)) - 1
    last = 1 << n
    at = Counter()
    for p, c in enumerate(word):
        at[c] |= 1 << p
    found = {}
    start = [(1 << (d + 1)) - 1 & full for d in range(bound + 1)]  # letters of the word may go unread at the start
    stack = [(lexicon.trie, start)]
    while stack:
        node, sets = stack.pop()
        for c, below in node.items():
            if c == "#":
                for d, s in enumerate(sets):
                    if s:
                        _hit(found, below, d, lexicon, bound)
                        break
                continue
            if c == WHOLE:
                for d, s in enumerate(sets):
                    if s & last:
                        _hit(found, below["#"], d, lexicon, bound)
                        break
                continue
            moved = _moved(sets, at[c] if c in at else 0, full)
            if any(moved):
                stack.append((below, moved))
    return sorted(found.items())


def may_match(head: str, lexicon: Lexicon, bound: int) -> bool:
    """Whether a word that starts with these letters can hold a term: some beginning of a term is within the bound of the
    head, or a whole term of one of the head's beginnings. Settles most words by a few letters that many share."""
    last = 1 << len(head)
    full = 2 * last - 1
    at = Counter()
    for p, c in enumerate(head):
        at[c] |= 1 << p
    stack = [(lexicon.trie, [(1 << (d + 1)) - 1 & full for d in range(bound + 1)])]
    while stack:
        node, sets = stack.pop()
        if "#" in node or WHOLE in node or any(s & last for s in sets):
            return True
        for c, below in node.items():
            moved = _moved(sets, at[c] if c in at else 0, full)
            if any(moved):
                stack.append((below, moved))
    return False


def _moved(sets: list[int], same: int, full: int) -> list[int]:
    """The automaton's sets after a letter of the trie that the word has at the places ``same``."""
    before = sets[0]
    moved = [(before & same) << 1]
    for here in sets[1:]:
        # a letter that fits; one exchanged; one that the word lacks; one of the word that is skipped
        moved.append(((here & same) << 1 | before << 1 | before | moved[-1] << 1) & full)
        before = here
    return moved


def _hit(found: dict, term: int, edits: int, lexicon: Lexicon, bound: int) -> None:
    if edits <= edit_bound(lexicon.terms[term], bound):
        found[term] = min(edits, found.get(term, edits))


class Matcher:
    """All matches of words, with the heads that can't match remembered (a bounded number of them)."""

    def __init__(self, lexicon: Lexicon, bound: int):
        self.lexicon, self.bound = lexicon, bound
        self.may = lru_cache(100_000)(lambda head: may_match(head, lexicon, bound))

    def __call__(self, word: str) -> list[tuple[int, int]]:
        if len(word) < SHORTEST or not self.may(word[:HEAD]):
            return []
        return matches(word, self.lexicon, self.bound)


def evidence(found: list[tuple[int, int]], weights: np.ndarray) -> float:
    """Evidence of the strongest term of a word. Fewer edits come first: a word that is a term isn't a misspelling of
    another."""
    least = min((d for _, d in found), default=0)
    return max((float(weights[t, d]) for t, d in found if d == least), default=0.0)


def quotation(tokens: list[str], at: int) -> float:
    """How much a hit's window speaks for a quotation, 0 to 1: marks on both sides, verbs of saying before it; address in the
    second person beside it speaks against."""
    before, after = tokens[max(0, at - QUOTATION) : at], tokens[at + 1 : at + 1 + QUOTATION]
    opened = sum(t in MARKS for t in before) % 2 == 1
    within = opened and any(t in MARKS for t in after)
    near = tokens[max(0, at - WINDOW) : at]
    around = near + tokens[at + 1 : at + 1 + WINDOW]
    score = 0.7 * within + 0.4 * (not SAYING.isdisjoint(near)) - 0.3 * (not within and not ADDRESS.isdisjoint(around))
    return min(1.0, max(0.0, score))


def features(tokens: list[str], hits: list[tuple[int, float]]) -> list[float]:
    """Totals of one text's hits (place, evidence) for the logistic model."""
    abuse = quoted = most = 0.0
    for at, weight in hits:
        q = quotation(tokens, at)
        quoted += weight * q
        abuse += weight * (1 - q)
        most = max(most, weight * (1 - q))
    words = len(tokens) + 1
    return [
        1.0,
        math.log1p(abuse),
        abuse / math.sqrt(words),
        most,
        math.log1p(len(hits)),
        100 * len(hits) / (words + 100),
        math.log1p(quoted),
        math.log1p(words) / 4,
    ]


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def training(df: DataFrame, labels: DataFrame, fit_rows: int) -> dict:
    """id -> toxic, of about ``fit_rows`` labelled ids of the training folds, chosen by their hash; ids that are labelled both
    ways are left out."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    known = labels.where("doc_id is not null and toxic is not null and toxic in (0, 1)").select("doc_id", "toxic")
    known = known.where(F.crc32(text_id.cast("binary")) % 3 != 1)
    per_id = known.groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("most")).where("least = most")
    total = per_id.count()
    if total > fit_rows:
        share = fit_rows / total
        per_id = per_id.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < int(share * 2**31))
    return {r[0]: bool(r[1]) for r in per_id.select("doc_id", "most").collect()}


def distinct_texts(rows: DataFrame, known: dict) -> dict:
    """``known`` without copies and near copies: a labelled text that is copied a hundred times says no more than once, and
    its own words would look like signs of its label. Of texts that share one of ``SKETCHES`` minima over their hashed
    three-word shingles, the first by (minima, id) counts. What comes to the driver is a few numbers a training row."""
    seeds = np.random.default_rng(5).integers(1, 1 << 63, SKETCHES, dtype="u8") | np.uint64(1)

    def each(text: str) -> list[int]:
        words = np.array([zlib.crc32(w.encode()) for w in TOKEN.findall(text.lower())], "u8")
        if len(words) > 2:
            words = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:]
        mixed = (words ^ (words >> np.uint64(29)))[:, None] * seeds
        return ((mixed ^ (mixed >> np.uint64(32))).min(axis=0) >> np.uint64(1)).tolist() if len(words) else [0] * SKETCHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [each(t) for group in text_groups(b.column(1)) for t in group]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "m"])

    kind = dict(rows.dtypes)["doc_id"]
    sketches = sorted((r["m"], r["doc_id"]) for r in rows.mapInArrow(run, f"doc_id {kind}, m array<bigint>").collect())
    seen, first = [set() for _ in range(SKETCHES)], {}
    for minima, doc_id in sketches:
        if not any(m in s for m, s in zip(minima, seen, strict=True)):
            first[doc_id] = known[doc_id]
        for m, s in zip(minima, seen, strict=True):
            s.add(m)
    return first


def candidates(word: str) -> Iterator[str]:
    if len(word) >= SHORTEST:
        yield word + WHOLE
        for n in range(SHORTEST, min(len(word), LONGEST) + 1):
            yield word[:n]


def _labelled_texts(df: DataFrame, known: dict) -> DataFrame:
    """(id, text) of the training rows: the ids travel as one bounded broadcast list."""
    ids = df.sparkSession.createDataFrame([(i,) for i in known], f"id {dict(df.dtypes)['doc_id']}")
    return df.join(F.broadcast(ids), df["doc_id"] == ids["id"]).select("doc_id", "text")


def learn_terms(rows: DataFrame, known: dict, most_terms: int, min_docs: int) -> list[str]:
    """The terms that tell toxic texts apart, no one the beginning of another.

    Texts that hold a candidate are counted by label; the candidates with the largest likelihood ratio statistic come
    first, and a candidate goes if it begins a chosen one or the other way round.
    """
    counts = label_counts(rows, known, lambda: lambda tokens: {c for w in set(tokens) for c in candidates(w)})
    n1 = max(sum(known.values()), 1)
    n0 = max(len(known) - n1, 1)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    seen = a + b
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = seen / (n0 + n1)
    gain = part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0)
    better = counts.where((a >= min_docs) & (a * n0 > 4 * b * n1)).withColumn("gain", 2 * gain).where(F.col("gain") > LEAST_GAIN)
    ranked = better.orderBy(F.desc(F.round("gain", 9)), F.desc(F.length("key")), "key").limit(8 * most_terms)
    taken, heads = [], set()  # heads: every beginning of a chosen term
    for row in ranked.select("key").collect():
        term = row[0]
        starts = {term[:i] for i in range(1, len(term) + 1)}
        if term in heads or not starts.isdisjoint(taken) or len(taken) == most_terms:
            continue
        taken.append(term)
        heads |= starts
    return taken


def label_counts(rows: DataFrame, known: dict, make: Callable[[], Callable[[list[str]], set[str]]]) -> DataFrame:
    """(key, toxic, clean): how many training texts of either label hold a key. ``make`` runs once per task and gives the
    function from a text's tokens to its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        keys = make()

        def out() -> pa.RecordBatch:
            every = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(every, pa.string()), *(pa.array([counts[x][k] for k in every], pa.int64()) for x in (1, 0))]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "toxic", "clean"])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for group in text_groups(batch.column(1)):
                for text in group:
                    counts[known[next(ids)]].update(keys(TOKEN.findall(text.lower())))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield out()
        yield out()
        give_back()

    found = rows.mapInArrow(run, "key string, toxic bigint, clean bigint")
    return found.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_weights(rows: DataFrame, known: dict, terms: list[str], bound: int) -> Lexicon:
    """The log ratio of toxic to clean texts with each term, by number of edits. Misspellings that the labelled texts don't
    show get half the evidence of the term itself."""
    blank = Lexicon(terms, np.ones((len(terms), bound + 1)))

    def make():
        memo, matcher = Memo(60_000), Matcher(blank, bound)

        def keys(tokens: list[str]) -> set[str]:
            words = set(tokens)
            memo.fill(words, lambda new: [matcher(w) for w in new])
            return {f"{t} {d}" for w in words for t, d in memo[w]}

        return keys

    n1 = max(sum(known.values()), 1)
    n0 = max(len(known) - n1, 1)
    seen = np.zeros((2, len(terms), bound + 1))
    for key, toxic, clean in label_counts(rows, known, make).collect():  # terms times edits
        t, d = map(int, key.split())
        seen[:, t, d] = toxic, clean * n1 / n0
    weights = np.zeros((len(terms), bound + 1))
    for d in range(bound + 1):
        odds = np.exp(weights[:, d - 1] / 2) if d else np.full(len(terms), 1.0)
        a, b = seen[0, :, d] + DOUBT * odds / (1 + odds), seen[1, :, d] + DOUBT / (1 + odds)
        weights[:, d] = np.maximum(np.log(a / b), 0)
    return Lexicon(terms, weights)


def described(df: DataFrame, lexicon: Lexicon, bound: int, head: list[str], finish) -> DataFrame:
    """The ``head`` columns of each row (doc_id, text first) and ``finish`` of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, matcher = Memo(60_000), Matcher(lexicon, bound)
        solve = lambda words: [evidence(matcher(w), lexicon.weights) for w in words]
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for group in text_groups(batch.column(1)):
                for text in group:
                    tokens = TOKEN.findall(text.lower())
                    words = set(tokens)
                    memo.fill(words, solve)
                    hot = {w: memo[w] for w in words if memo[w]}
                    hits = [(i, hot[w]) for i, w in enumerate(tokens) if w in hot] if hot else []
                    out.append(features(tokens, hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), finish(np.array(out))], head)
        del memo, matcher
        give_back()

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, {head[1]} " + (
        "array<double>" if head[1] == "features" else "double"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton's steps with a ridge on all but the first, so they stay finite where the classes part."""
    if not len(x) or y.all() or not y.any():
        out = np.zeros(FEATURES)
        out[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(x) else 0.0
        return out
    coef, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * coef)
        coef = coef + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return coef


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    bound: int


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000,
        most_terms: int = 256, min_docs: int = 3, bound: int = 1) -> Model:
    """Learn lexicon, evidence and model from about ``fit_rows`` labelled rows of the training folds, copies once. The model has at most
    ``most_terms`` terms, whatever the corpus; terms need ``min_docs`` toxic texts."""
    docs = only(df, doc_id=id_col, text=text_col)
    known = training(docs, labels, fit_rows)
    known = distinct_texts(_labelled_texts(docs, known), known)
    rows = _labelled_texts(docs, known)
    terms = learn_terms(rows, known, most_terms, min_docs)
    lexicon = learn_weights(rows, known, terms, bound)
    whole = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    seen = described(rows, lexicon, bound, ["doc_id", "features"], whole).collect()  # fit_rows times a few numbers
    x = np.array([r["features"] for r in seen]).reshape(-1, FEATURES)
    y = np.array([known[r["doc_id"]] for r in seen], bool)
    return Model(lexicon, logistic(x, y), bound)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    docs = only(df, doc_id=id_col, text=text_col)
    coef = model.coefficients
    finish = lambda x: pa.array(1 / (1 + np.exp(-np.clip(x.reshape(-1, FEATURES) @ coef, -30, 30))))
    out = described(docs, model.lexicon, model.bound, ["doc_id", "score"], finish)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Fit on labelled training rows of ``df`` and score every row.

    Returns ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.7). Rows whose crc32 of the id
    leaves 1 modulo 3 are held out. Null, empty and blank texts have no hits and get the score of a text without words; a
    null id is scored and never trains; repeated rows get the same score, and train if labelled; without labels of
    both classes the score is their share; an empty table gives no rows. Other columns are neither used nor carried.
    """
    return score(df, fit(df, labels, id_col, text_col, **settings), id_col, text_col)
