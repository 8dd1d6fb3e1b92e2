"""Line deduplication by deletion neighbourhoods.

A line in normal form (trimmed, ASCII lower case) is dropped if an equal line, or one within one edit (a character put in,
taken out or exchanged), comes earlier in the order of documents and lines. Two lines within one edit share a variant: a line
itself or a line without one character. All variants are emitted as hashes; lines meet where hashes are equal. Exchanged
characters were taken out at the same place, so within a variant the earliest line of each place, of the whole lines and of
the shortened ones are all that is needed, and no pairs are listed. The partner found is verified by its edit distance.

With a larger bound, a variant lacks up to that many characters, and its key also holds the places where a partner may differ:
the line's own, filled up with all others to the full bound. Lines that share such a key are within the bound, so the earliest
line of a key is again all that is needed.

Only lines that could have a partner emit variants: k edits leave one of k + 1 parts of the shorter line intact, so a line takes
part if another line has one of its parts, moved by no more than the edits on either side of it can move it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, combinations_with_replacement, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from tilewright.llm.common import SPACES, fresh, give_back, in_groups, text_groups
from tilewright.llm.rules import _let

BASE = 0x9E3779B97F4A7C15
WHOLE = -1  # the place of a line from which nothing was taken


def _each_line(text: str) -> Iterator[tuple[int, bytes, int]]:
    """(number, normal form, characters) of every line with a word."""
    for no, raw in enumerate(text.split("\n")):
        line = raw.strip(SPACES)
        if line:
            yield no, line.encode().lower(), len(line)


def _digest(line: bytes) -> tuple[int, int]:
    """96 bits of a line; with its length the identity of a line."""
    return _signed(xxh64_intdigest(line, 1)), xxh32_intdigest(line, 2)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(line: bytes, n: int, edits: int) -> list[int]:
    """Hashes of the edits + 1 parts of a line, as the shorter and as the longer one of a pair. Some part is left alone by the
    edits with at most i of them before part i and the rest after it: that bounds how far it can have moved."""
    cut = line if len(line) == n else line.decode()
    out = set()
    for longer in range(min(edits, n) + 1):
        m = n - longer  # characters of the shorter line
        size = m // (edits + 1)
        for i in range(edits + 1):
            own = i * (m - size) // edits if edits else 0
            for moved in range(max(-i, longer - (edits - i)), min(i, longer + edits - i) + 1):
                at = own + moved
                if 0 <= at <= n - size:
                    out.add(_signed(xxh64_intdigest(cut[at : at + size], (edits + 1) * size + i)))
    return list(out)


def _mapped(docs: DataFrame, each: Callable, kinds: list[pa.DataType], schema: str) -> DataFrame:
    """``each(text)`` gives tuples; the result has the row's (doc_id, doc) and the values of each tuple."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = 0
            for group in text_groups(b.column(2), 4_000_000):
                rows = [(first + i, *x) for i, t in enumerate(group) for x in each(t)]
                first += len(group)
                if rows:
                    at, *values = zip(*rows, strict=True)
                    own = [c.take(pa.array(at)) for c in b.columns[:2]]
                    arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *arrays], ["doc_id", "doc", *names])
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "doc", "text").mapInArrow(run, f"doc_id {kind}, doc bigint, {schema}")


#: Places order lines: rows without an id come last, then by id, by text among rows that share an id, and by line.
AT = ("doc_id", "doc", "no")


def _placed(lines: DataFrame) -> DataFrame:
    at = F.expr(f"named_struct('last', doc_id is null, {', '.join(f'{c!r}, {c}' for c in AT)})")
    return lines.withColumns({"at": at, "h": F.struct("a", "b", "n")}).drop(*AT, "a", "b", "n")


def _lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """(at, h, parts): every line with a word, by place and digest; the text itself stays behind."""

    def each(text: str) -> Iterator[tuple]:
        for no, line, n in _each_line(text):
            yield no, *_digest(line), n, _parts(line, n, edits)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    return _placed(_mapped(docs, each, kinds, "no int, a bigint, b bigint, n int, parts array<bigint>"))


#: Bits of the filter that spares most lines a join with the suspects.
FILTER = 1 << 23


def _texts_of(suspects: DataFrame, docs: DataFrame) -> DataFrame:
    """(at, h, line) of the suspects. The documents are read again; a filter of fixed size (a bit for each digest that is
    asked for) goes to all tasks, and what passes it is joined exactly."""
    bit = F.pmod(F.col("h.a"), F.lit(FILTER))
    words = suspects.select(F.floor(bit / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h.a, {FILTER}) % 64 as int))").alias("x"))
    asked = np.zeros(FILTER // 64, "i8")
    for w, x in words.groupBy("w").agg(F.bit_or("x")).collect():
        asked[w] = x

    def each(text: str) -> Iterator[tuple]:
        for no, line, n in _each_line(text):
            a, b = _digest(line)
            at = a % FILTER
            if int(asked[at // 64]) >> (at % 64) & 1:
                yield no, a, b, n, line.decode()

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    some = _placed(_mapped(docs, each, kinds, "no int, a bigint, b bigint, n int, line string"))
    wanted = suspects.select(F.col("h").alias("s_h"), F.col("at").alias("s_at"))
    found = some.join(wanted, (some["h"] == wanted["s_h"]) & (some["at"] == wanted["s_at"]), "left_semi")
    return found.dropDuplicates(["h"])  # rows that repeat a place count once


def variants(suspects: DataFrame) -> DataFrame:
    """(key, place, at): the hash of each line, and of each line without the character at ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = 0
            for group in in_groups(b.column(0).to_pylist(), 200_000):
                keys, places, rows = [], [], []
                for i, line in enumerate(group):
                    k = _variant_keys(line)
                    keys.append(k)
                    places.append(np.arange(WHOLE, len(k) - 1, dtype="int32"))
                    rows.append(np.full(len(k), first + i))
                first += len(group)
                at = b.column(1).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(places)), at], ["key", "place", "at"]
                )
        give_back()

    kind = dict(suspects.dtypes)["at"]
    return suspects.select("line", "at").mapInArrow(run, f"key bigint, place int, at {kind}")


def _prefix_sums(line: str) -> np.ndarray:
    """The polynomial hashes of all beginnings of a line."""
    with np.errstate(over="ignore"):
        c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
        c = (c ^ (c << np.uint64(25))) * np.uint64(0xD6E8FEB86659FD93)
        c ^= c >> np.uint64(32)
        power = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(len(c), BASE, "u8")]))
        return np.concatenate([np.zeros(1, "u8"), np.cumsum(c * power[:-1])])


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


def _some(tuples: Iterable[tuple], width: int, most: int = 1024) -> Iterator[np.ndarray]:
    """Tuples of ``width`` numbers as arrays of at most ``most`` rows."""
    tuples = iter(tuples)
    while rows := list(islice(tuples, most)):
        yield np.array(rows, "i8").reshape(len(rows), width)


def _keys_within(line: str, edits: int) -> Iterator[np.ndarray]:
    """Keys of the variants without up to ``edits`` characters, each with every multiset of ``edits`` gaps of the variant that
    holds the gaps of the characters taken out. Two lines share a key exactly if they are within the bound; the keys of long
    lines come in arrays of bounded size."""
    prefix, n = _prefix_sums(line), len(line)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    for gone in range(min(edits, n) + 1):
        for cuts in _some(combinations(range(n), gone), gone):
            with np.errstate(over="ignore"):
                value, scale = np.zeros(len(cuts), "u8"), np.uint64(1)
                for j in range(gone + 1):  # the stretch before each cut, moved to where it stands in the variant
                    start = prefix[cuts[:, j - 1] + 1] if j else np.uint64(0)
                    end = prefix[cuts[:, j]] if j < gone else prefix[n]
                    value += (end - start) * scale
                    scale *= inverse
            gaps = cuts - np.arange(gone)
            for more in _some(combinations_with_replacement(range(n - gone + 1), edits - gone), edits - gone):
                both = np.empty((len(gaps), len(more), edits), "i8")
                both[:, :, :gone], both[:, :, gone:] = gaps[:, None], more[None]
                both.sort(axis=2)
                with np.errstate(over="ignore"):
                    keys = np.repeat(_mixed(value), len(more))
                    for j in range(edits):
                        keys = _mixed(keys * np.uint64(BASE) + both[:, :, j].ravel().astype("u8") + np.uint64(1))
                yield np.unique(keys)


def variants_within(suspects: DataFrame, edits: int) -> DataFrame:
    """(key, at): the keys of all variants of each line within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for keys in _keys_within(b.column(0)[i].as_py(), edits):
                    at = b.column(1).take(pa.array(np.full(len(keys), i)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view("int64")), at], ["key", "at"])
        give_back()

    kind = dict(suspects.dtypes)["at"]
    return suspects.select("line", "at").mapInArrow(run, f"key bigint, at {kind}")


def _variant_keys(line: str) -> np.ndarray:
    """A polynomial hash of the line and of it without each character, from prefix sums."""
    prefix = _prefix_sums(line)
    with np.errstate(over="ignore"):
        suffix = prefix[-1] - prefix[1:]  # without the characters up to the place; one power too high
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        return _mixed(np.concatenate([prefix[-1:], prefix[:-1] + suffix * inverse]))


def _one_edit_pairs(found: DataFrame) -> DataFrame:
    """(at, other): to each line the earliest ones that it meets in a variant within one edit."""
    key, place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    whole = F.col("place") == WHOLE
    met = variants(found).select(
        "at",
        F.min(F.when(whole, F.col("at"))).over(key).alias("by_whole"),
        F.when(whole, F.min(F.when(~whole, F.col("at"))).over(key)).alias("by_part"),
        F.when(~whole, F.min("at").over(place)).alias("by_place"),
    )
    return met.select("at", F.explode(F.array_distinct(F.array("by_whole", "by_part", "by_place"))).alias("other"))


def near_lines(first: DataFrame, docs: DataFrame, least: int, edits: int = 1) -> DataFrame:
    """(h): distinct lines that have an earlier distinct line within ``edits`` edits. ``first(h, at, parts)`` holds the distinct
    lines of ``docs``."""
    parts = first.where(F.col("h.n") >= least).select("h", "at", F.explode("parts").alias("part"))
    shared = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    suspects = parts.join(shared, "part", "left_semi").select("h", "at").distinct()
    found = fresh(_texts_of(fresh(suspects, "asked"), docs), "suspects")
    if edits == 1:
        met = _one_edit_pairs(found)
    else:
        met = variants_within(found, edits).select("at", F.min("at").over(Window.partitionBy("key")).alias("other"))
    pairs = met.where("other < at").distinct()
    a = found.select("at", "h", "line")
    b = found.select(F.col("at").alias("other"), F.col("line").alias("earlier"))
    checked = pairs.join(a, "at").join(b, "other").where(F.levenshtein("line", "earlier", edits) >= 0)
    return checked.select("h").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, edits: int = 1) -> DataFrame:
    """Drop lines that repeat an earlier one, or one within ``edits`` edits (none: equal lines alone).

    Returns ``row`` (a struct of all columns of ``df``), ``text`` without the dropped lines, ``n_lines`` (lines with a
    word), ``n_exact`` and ``n_near`` (dropped as equal, and as within the bound). The keys of a line grow with its length to the
    power of ``edits``: bounds beyond one are for short lines. Lines of fewer than ``least`` characters
    are dropped only if they are equal to an earlier one; lines without a word stay. The order is that of ids, then of
    lines; a document whose lines are all dropped keeps an empty text. A null text is empty; rows without an id come last in
    the order; rows that repeat an id and its text are one document and lose the same lines; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.xxhash64(text).alias("doc")
    docs = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), doc)
    lines = fresh(_lines(docs, edits), "lines")
    first = fresh(lines.groupBy("h").agg(F.min("at").alias("at"), F.first("parts").alias("parts")), "first")
    near = near_lines(first, docs, least, edits).withColumn("near", F.lit(True))
    known = fresh(first.select("h", F.col("at").alias("first")).join(near, "h", "left"), "known")
    places = lines.select("h", "at").join(known, "h")
    gone = places.select(
        F.col("at.doc_id").alias("g_id"),
        F.col("at.doc").alias("g_doc"),
        F.col("at.no").alias("no"),
        F.when(F.col("at") != F.col("first"), "exact").when(F.col("near"), "near").alias("why"),
    )
    # repeated rows have the same places: each counts once
    per_doc = fresh(
        gone.where("why is not null").groupBy("g_id", "g_doc").agg(F.collect_set(F.struct("no", "why")).alias("gone")), "gone"
    )
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), doc)
    joined = rows.join(per_doc, rows["id"].eqNullSafe(per_doc["g_id"]) & (rows["doc"] == per_doc["g_doc"]), "left")
    joined = joined.select("row", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"), "gone")  # moved once
    split = F.split("text", "\n", -1)
    kept = _let(
        split,
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")["no"]), lambda i: F.get(x, i)
            ),
            "\n",
        ),
    )
    with_words = F.size(F.filter(split, lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long")
    count = lambda why: F.coalesce(
        F.size(F.filter("gone", lambda g: g["why"] == why)).cast("long"), F.lit(0).cast("long")
    )
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        with_words.alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(count("exact")).alias("n_exact"),
        F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(count("near")).alias("n_near"),
    )


#: The same over ``documents``: candidates share a half, and pairs are verified character by character.
LINES_SQL = r"""
with split as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as raw from documents),
each_line as (
  select doc_id, i - 1 as no, raw[i] as raw, translate(regexp_replace(raw[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from (select doc_id, raw, unnest(range(1, len(raw) + 1)) as i from split)),
firsts as (
  select line, min(struct_pack(d := doc_id, n := no)) as place, length(line) as n from each_line where line <> '' group by line),
halves as (
  select distinct line, place, n, h, side, case side when 0 then left(line, h) else right(line, h) end as half
  from (select *, unnest([n // 2, (n - 1) // 2]) as h from firsts where n >= 20), (values (0), (1)) s(side)),
pairs as (
  select distinct a.line, b.line as earlier, a.n, b.n as m
  from halves a join halves b on a.h = b.h and a.side = b.side and a.half = b.half and b.place < a.place and abs(a.n - b.n) <= 1),
near as (
  select distinct line from pairs where len(list_filter(range(0, greatest(n, m) + 1), lambda i:
    left(line, i::int) = left(earlier, i::int)
    and substr(line, i::int + 1 + (n >= m)::int) = substr(earlier, i::int + 1 + (m >= n)::int))) > 0),
judged as (
  select e.doc_id, e.no, e.raw, e.line <> '' as has_word,
    case when e.line = '' then null when f.place <> struct_pack(d := e.doc_id, n := e.no) then 'exact'
      when near.line is not null then 'near' end as why
  from each_line e left join firsts f on e.line = f.line left join near on e.line = near.line)
select doc_id, count(*) filter (has_word)::bigint as n_lines, count(*) filter (why = 'exact')::bigint as n_exact,
  count(*) filter (why = 'near')::bigint as n_near,
  md5(coalesce(string_agg(raw, chr(10) order by no) filter (why is null), '')) as text_md5
from judged group by doc_id
"""
