"""A hidden Markov model of words, trained by Baum-Welch over all partitions, and exact likelihoods of whole texts.

A word is emitted in two steps: a state emits a class, and the class emits the word. The most frequent words are classes of
their own; the others share classes by their ending. What a state emits is therefore of bounded size, while the probability
of a word within its class comes from counts of all words, which stay a distributed table. Unknown words of a class get the
mass that words seen once hold there.

Texts are encoded once, in chunks with their own small vocabularies: a chunk's words meet the word counts in a join of
(chunk, word) rows rather than of tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, only, text_groups

#: Words with a class of their own, and classes that the others share.
OWN, SHARED = 4096, 4096
#: Characters of a chunk, and tokens of a training sequence.
CHUNK, STRETCH = 8_000_000, 128
END = b""  # no word is empty
#: Weights of the prior: each state's emissions lean to the overall ones, its transitions to equal ones.
LEAN, EQUAL = 50.0, 1.0


def held_out(doc_id) -> bool:
    """Whether the row is left out of training: CRC-32 of its id as text leaves remainder 1 by 5. A null id is an empty
    text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def squeezed(ids: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, compressed: these are what moves between executors."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<i4").view("u1").reshape(-1, 4).T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4")[:, 0]


def chunks(df: DataFrame) -> DataFrame:
    """(chunk, docs, ids, words, counts): runs of documents as numbers of the chunk's own words, with each word's count in
    the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = iter(b.column(0).to_pylist())
            for group in text_groups(b.column(1), CHUNK):
                number: dict[bytes, int] = {END: 0}
                docs, parts, train = [], [], []
                for text in group:
                    doc_id = next(rows)
                    words = text.encode().lower().split()
                    for w in words:
                        if w not in number:
                            number[w] = len(number)
                    ids = np.fromiter(map(number.__getitem__, words), "<i4", len(words))
                    parts += [ids, np.zeros(1, "<i4")]
                    out = held_out(doc_id)
                    docs.append({"doc_id": doc_id, "held_out": out, "n": len(words) + 1})
                    if not out:
                        train += parts[-2:]
                counts = np.bincount(np.concatenate(train), minlength=len(number)) if train else [0] * len(number)
                columns = [[(part << 32) + n], [docs], [squeezed(np.concatenate(parts))], [list(number)], [list(counts)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                n += 1

    names = ["chunk", "docs", "ids", "words", "counts"]
    id_kind = dict(df.dtypes)["doc_id"]
    id_arrow = pa.int32() if id_kind == "int" else pa.string() if id_kind == "string" else pa.int64()
    doc = pa.struct([("doc_id", id_arrow), ("held_out", pa.bool_()), ("n", pa.int64())])
    kinds = (pa.int64(), pa.list_(doc), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    schema = (
        f"chunk bigint, docs array<struct<doc_id: {id_kind}, held_out: boolean, n: bigint>>, ids binary, "
        "words array<binary>, counts array<bigint>"
    )
    return fresh(df.mapInArrow(run, schema), "chunks", "zstd")


@dataclass
class Lexicon:
    """Bounded summary of the word counts: tokens and distinct words, the classes' sizes and what unknown words get."""

    tokens: int
    distinct: int
    own: dict[bytes, int]
    class_tokens: np.ndarray
    once: np.ndarray

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def unknown(self) -> np.ndarray:
        """Share of unknown words in each shared class."""
        return (self.once + 0.5) / (self.class_tokens + 1.0)


def shared_class(word: bytes) -> int:
    """Class of a word without its own: the last three bytes decide."""
    return OWN + zlib.crc32(word[-3:]) % SHARED


def lexicon(made: DataFrame) -> tuple[DataFrame, Lexicon]:
    """(word, c, class) of every word, and the summary."""
    each = made.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    counts = fresh(each.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), "counts", "zstd")
    tokens, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where((F.col("c") > 0) & (F.length("word") > 0)).orderBy(F.col("c").desc(), "word").limit(OWN - 1)
    own = {END: 0} | {bytes(r[0]): i + 1 for i, r in enumerate(top.select("word").collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes = [own[w] if w in own else shared_class(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(classes, pa.int32())], ["word", "c", "class"])

    classed = fresh(counts.mapInArrow(run, "word binary, c bigint, class int"), "lexicon", "zstd")
    sizes, once = np.zeros((2, OWN + SHARED))
    for k, n, n1 in (
        classed.groupBy("class").agg(F.sum("c"), F.sum((F.col("c") == 1).cast("long"))).collect()
    ):
        sizes[k], once[k] = n, n1
    return classed, Lexicon(tokens, distinct, own, sizes, once)


def encoded(made: DataFrame, classed: DataFrame, lex: Lexicon) -> DataFrame:
    """(docs, classes): each chunk's documents with their sums over words that need no state, and the classes of all
    tokens."""
    each = made.select("chunk", F.posexplode(F.col("words")).alias("at", "word"))
    looked = each.join(classed, "word").groupBy("chunk").agg(F.collect_list(F.struct("at", "c", "class")).alias("known"))
    unknown, sizes, total = lex.unknown(), lex.class_tokens, lex.base_total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                known = b.column(2)[i].values
                at = known.field("at").to_numpy()
                c, cls = np.zeros((2, len(at)), "int64")
                c[at], cls[at] = known.field("c").to_numpy(), known.field("class").to_numpy()
                base = np.log10((c + 0.5) / total)
                share = np.where(c > 0, (1 - unknown[cls]) * c / np.maximum(sizes[cls], 1), unknown[cls])
                inner = np.where(cls < OWN, 0.0, np.log(share))
                ids = unsqueezed(b.column(1)[i].as_py())
                docs = b.column(0)[i].as_py()
                starts = np.cumsum([0, *(d["n"] for d in docs)])[:-1]
                sums = [np.add.reduceat(x[ids], starts) for x in (base, inner, (c > 0).astype("int64"))]
                for d, base_, inner_, n_known in zip(docs, *(s.tolist() for s in sums), strict=True):
                    d |= {"base": base_, "inner": inner_, "n_known": n_known}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs], doc), pa.array([cls[ids].astype("<u2").tobytes()], pa.binary())], ["docs", "classes"]
                )

    id_kind = made.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    id_arrow = pa.int32() if id_kind == "int" else pa.string() if id_kind == "string" else pa.int64()
    fields = [("doc_id", id_arrow), ("held_out", pa.bool_()), ("n", pa.int64()), ("base", pa.float64())]
    doc = pa.list_(pa.struct([*fields, ("inner", pa.float64()), ("n_known", pa.int64())]))
    joined = made.select("chunk", "docs", "ids").join(looked, "chunk").select("docs", "ids", "known")
    schema = (
        f"docs array<struct<doc_id: {id_kind}, held_out: boolean, n: bigint, base: double, inner: double, "
        "n_known: bigint>>, classes binary"
    )
    return fresh(joined.mapInArrow(run, schema), "encoded", "zstd")


@dataclass
class Model:
    """Start, transition and emission probabilities; emission has a row per class."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_model(states: int, overall: np.ndarray, seed: int) -> Model:
    """Overall emissions, disturbed differently for each state, and states that mostly stay."""
    emit = overall[:, None] * np.random.default_rng(seed).lognormal(0.0, 1.0, (len(overall), states))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of the sequences, and their log likelihood: scaled forward-backward over
    all sequences at once, longest first."""
    k = len(model.start)
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
    total = 0.0
    a_, p_, e_ = (x.astype("float32") for x in (model.step, model.start, model.emit))
    order = sorted(sequences, key=len, reverse=True)
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        lengths = np.array([len(s) for s in some])
        longest = int(lengths[0])
        active = [int((lengths > t).sum()) for t in range(longest)]
        symbols = np.zeros((longest, len(some)), "int64")
        for i, s in enumerate(some):
            symbols[: len(s), i] = s
        b = e_[symbols]
        alpha, scale = np.zeros_like(b), np.ones(symbols.shape, "float32")
        now = p_ * b[0]
        for t in range(longest):
            n = active[t]
            if t:
                now = (alpha[t - 1, :n] @ a_) * b[t, :n]
            scale[t, :n] = now.sum(axis=1)
            alpha[t, :n] = now / scale[t, :n, None]
        beta = np.ones_like(b)
        for t in range(longest - 2, -1, -1):
            n = active[t + 1]
            beta[t, :n] = ((b[t + 1, :n] * beta[t + 1, :n]) / scale[t + 1, :n, None]) @ a_.T
        gamma = alpha * beta
        live = np.arange(longest)[:, None] < lengths[None, :]
        start += gamma[0].sum(axis=0)
        for t in range(1, longest):
            n = active[t]
            step += alpha[t - 1, :n].T @ (b[t, :n] * beta[t, :n] / scale[t, :n, None])
        own, seen = gamma[live], symbols[live]
        for s in range(k):
            emit[:, s] += np.bincount(seen, weights=own[:, s], minlength=len(emit))
        total += float(np.log(scale[live], dtype="float64").sum())
    return start, step * model.step, emit, total


def train(table: DataFrame, overall: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """Baum-Welch: each task sums the expected counts of its documents, Spark adds the sums, and the driver gets tables of
    the model's own size."""
    model = first_model(states, overall, seed)
    classes = len(overall)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
            for b in batches:
                for i in range(b.num_rows):
                    symbols = np.frombuffer(b.column(1)[i].as_buffer(), "<u2")
                    at, sequences = 0, []
                    for d in b.column(0)[i].as_py():
                        if not d["held_out"]:
                            own = symbols[at : at + d["n"]]
                            sequences += [own[j : j + STRETCH] for j in range(0, len(own), STRETCH)]
                        at += d["n"]
                    if sequences:
                        s, t, e, _ = expected(model, sequences)
                        start += s
                        step += t
                        emit += e
            table_ = np.concatenate([start[None], step, emit])
            used = np.flatnonzero(table_.sum(axis=1))
            rows = pa.array(list(table_[used]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), rows], ["row", "x"])

        sums = table.select("docs", "classes").mapInArrow(run, "row bigint, x array<double>")
        added = sums.groupBy("row").agg(*[F.sum(F.col("x")[s]).alias(f"x{s}") for s in range(states)])
        counts = np.zeros((1 + states + classes, states))
        for r in added.collect():
            counts[r[0]] = r[1:]
        start, step, emit = counts[0] + EQUAL, counts[1 : 1 + states] + EQUAL, counts[1 + states :]
        emit = emit + LEAN * overall[:, None]
        model = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each whole sequence by the scaled forward recursion in double precision."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    out = np.zeros(len(sequences))
    for at in range(0, len(order), 1024):
        some = order[at : at + 1024]
        lengths = np.array([len(sequences[i]) for i in some])
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([sequences[i] for i in some])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than t
        sums = np.zeros(len(some))
        now = model.start * model.emit[flat[starts]]
        for t, n in enumerate(active.tolist()):
            if t:
                now = (now[:n] @ model.step) * model.emit[flat[starts[:n] + t]]
            scale = now.sum(axis=1)
            sums[:n] += np.log(scale)
            now /= scale[:, None]
        out[some] = sums
    return out


def language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 6,
                   seed: int = 5) -> DataFrame:
    """Train on the rows that aren't held out and score every whole text.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score`` (the
    smoothed word frequencies' log10 probability) and ``score`` (the model's). A null, empty or blank text is the end alone;
    repeated rows are trained on and scored each; a null id counts as an empty text for holding out; without training rows
    every word is unknown; an empty table gives no rows; other columns are not carried.
    """
    made = chunks(only(df, doc_id=id_col, text=text_col))
    classed, lex = lexicon(made)
    table = encoded(made, classed, lex)
    overall = (lex.class_tokens + 0.5) / (lex.class_tokens + 0.5).sum()
    model = train(table, overall, states, rounds, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                symbols = np.frombuffer(b.column(1)[i].as_buffer(), "<u2").astype("int64")
                docs = b.column(0)[i].as_py()
                ends = np.cumsum([d["n"] for d in docs])
                found = log_likelihoods(model, np.split(symbols, ends[:-1]))
                inner = np.array([d["inner"] for d in docs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d["doc_id"] for d in docs], id_arrow),
                        pa.array([d["held_out"] for d in docs]),
                        pa.array([d["n"] for d in docs], pa.int64()),
                        pa.array([d["n_known"] for d in docs], pa.int64()),
                        pa.array([lex.tokens] * len(docs), pa.int64()),
                        pa.array([d["base"] for d in docs], pa.float64()),
                        pa.array((found + inner) / np.log(10)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    id_kind = dict(df.dtypes)[id_col]
    id_arrow = pa.int32() if id_kind == "int" else pa.string() if id_kind == "string" else pa.int64()
    lex.own.clear()  # the tasks need only the numbers
    return table.mapInArrow(
        run,
        f"doc_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double",
    )
