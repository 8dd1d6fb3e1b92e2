"""Fill-in-the-middle: a text's middle is cut out and moved to its end, behind markers.

Texts are cut as UTF-8 bytes. What ties bytes to code points is a sparse exception index: only characters of several bytes
are recorded, each with its position and the bytes by which it exceeds one. A cut is converted by a binary search in these
positions; stretches of ASCII are arithmetic and take no room.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import give_back, only

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RESULT = (
    "doc_id {}, n bigint, form string, prefix_chars bigint, middle_chars bigint, prefix_bytes bigint, middle_bytes bigint, "
    "output string"
)
#: Bytes of output that go back to Spark at a time.
CHUNK = 8 << 20


class Exceptions:
    """Sparse index of one UTF-8 text: byte positions of the characters of several bytes, and the excess bytes up to each."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype("i8") + (lead >= 0xF0))
        self.n_bytes = len(data)

    def chars(self, byte: int | np.ndarray) -> np.ndarray:
        """Code points before a byte position that starts a character or ends the text."""
        return byte - self._before(np.searchsorted(self.at, byte))

    def bytes(self, char: int | np.ndarray) -> np.ndarray:
        """Byte position of a code point (or of the end)."""
        places = self.at - self._before(np.arange(len(self.at)))
        return char + self._before(np.searchsorted(places, char))

    def _before(self, k: int | np.ndarray) -> np.ndarray:
        """Excess of the first ``k`` exceptions."""
        return np.concatenate([[0], self.excess])[k]


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte positions at which units end: a word with the blanks before it, and blanks that end the text."""
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def draws(doc_id: int | str | None, seed: int) -> list[int]:
    """Four numbers from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(data: bytes, h: list[int], rate: int, spm_rate: int, unit: str) -> tuple:
    """(n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output) of one text."""
    codes = np.frombuffer(data, "u1")
    index = Exceptions(codes)
    ends = unit_ends(codes) if unit == "words" else None
    n = int(index.chars(len(data))) if ends is None else len(ends)
    if not data or h[2] % 100 >= rate or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None, data
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if ends is None:
        first, last = low, high
        a, b = (int(x) for x in index.bytes(np.array([low, high])))
    else:
        a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
        first, last = (int(x) for x in index.chars(np.array([a, b])))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm_rate:
        form, output = "spm", b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    else:
        form, output = "psm", b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return n, form, first, last - first, a, b - a, output


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80,
                   seed: int = 42, unit: str = "words") -> DataFrame:
    """Per row: ``doc_id``, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` in code points, ``prefix_bytes`` and
    ``middle_bytes`` in UTF-8 bytes, and ``output``.

    Cuts lie between ``words`` (with the blanks before them) or between ``chars`` (code points), by ``unit``; ``n`` counts
    these. The cuts and the form follow from the id alone, so retries and repeated rows give the same result. ``rate`` percent of
    the texts are transformed, ``spm_rate`` percent of them with the suffix first. A text that is null, empty or holds a
    marker stays plain, with null lengths (a null text reads as the empty one); a null id draws like an empty id; an empty
    table gives no rows; other columns are not carried. Rows stay in their partitions.
    """

    if unit not in ("words", "chars"):
        raise ValueError(f"unit {unit!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            done, start, size = [], 0, 0
            for i in range(len(ids)):
                data = texts[i].as_py() or b""
                done.append(transform(data, draws(ids[i].as_py(), seed), rate, spm_rate, unit))
                size += len(done[-1][-1])
                if size >= CHUNK or i + 1 == len(ids):
                    yield _rows(ids.slice(start, len(done)), done)
                    done, start, size = [], i + 1, 0
        give_back()

    docs = only(df, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, RESULT.format(dict(docs.dtypes)["doc_id"]))


def _rows(ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
    n, form, *lengths, output = zip(*done, strict=True)
    columns = [ids, pa.array(n, pa.int64()), pa.array(form), *(pa.array(x, pa.int64()) for x in lengths)]
    names = "doc_id n form prefix_chars middle_chars prefix_bytes middle_bytes output".split()
    return pa.RecordBatch.from_arrays([*columns, pa.array(output, pa.binary()).cast(pa.string())], names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no part of a transformed text holds a marker, so the markers split it."""
    parts = F.split(output, "<[PSM]>", -1)
    back = lambda *order: F.concat(*[F.element_at(parts, i) for i in order])
    return F.when(form == "psm", back(2, 4, 3)).when(form == "spm", back(3, 4, 2)).otherwise(output)


#: The same over the table ``documents``.
FILL_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
drawn as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b,
    text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
      or ('0x' || h[17:24])::bigint % 100 >= 50 as plain,
    ('0x' || h[25:32])::bigint % 100 < 80 as suffix_first
  from units),
cut as (
  select doc_id, n, text, case when plain then 'plain' when suffix_first then 'spm' else 'psm' end as form,
    array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(u[greatest(a, b) + 1:], '') as s
  from drawn)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
  case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""
