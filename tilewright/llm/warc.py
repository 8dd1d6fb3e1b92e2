"""WARC archives with a shared Zstandard dictionary.

A dictionary is built from a bounded sample of the records. Each archive starts with a skippable frame that holds the
dictionary, and every record after it is a frame of its own, so a reader needs nothing but the file and can start at any
record. Of records with equal payloads one is stored as a response and the others as revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, only
from tilewright.session import new_path

#: Fixed values of the format for dictionary-compressed archives and of Zstandard: the magic numbers of the skippable frame
#: that holds the dictionary, of a frame, and of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
LEVEL = 3
WINDOW = 1 << 16
#: So many times the records wanted for the dictionary are drawn by hash, out of this many hashes.
DRAWN, HASHES = 4, 1 << 40


def record(kind: str, id_: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload; its length and digest stay in the header."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if id_ is None else id_}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            f"X-Payload-Length: {len(payload)}",
        ]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; its parts must have the lengths that it states."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or not sep or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, rest[:n]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or a raw one of the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def sampled_records(rows: DataFrame, n: int, records: int, longest: int, total: int) -> list[bytes]:
    """Whole records for the dictionary: those with the smallest hashes among those of at most ``longest`` bytes, up to
    ``total`` bytes. This is all that the driver gets. ``n`` is the number of all rows: only about ``DRAWN`` times
    ``records`` of them, chosen by hash before a payload is looked at, leave their tasks, and repeated rows count once."""
    h = F.xxhash64("id", "uri")
    share = min(1.0, DRAWN * records / max(1, n))
    few = rows.where(F.pmod(h, F.lit(HASHES)) < F.lit(int(share * HASHES)))
    few = few.where(F.col("length").between(1, longest)).dropDuplicates(["id", "uri", "digest"])
    some = few.orderBy(h, "digest").limit(records)
    out, size = [], 0
    for r in some.select("id", "uri", "payload", "digest").toLocalIterator():
        out.append(record("response", r[0], r[1], bytes(r[2]), r[3], None))
        size += len(out[-1])
        if size >= total:
            break
    return out


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, rotate: int) -> DataFrame:
    """Each task writes archives of about ``rotate`` bytes under ``folder``. Returns the manifest (archive, records, bytes).

    A file has a name that no other attempt uses, and only the attempts that Spark accepts are in the manifest; what a lost
    executor left is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        out, name, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for id_, uri, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    size = 8 + len(dictionary)
                kind = "response" if refers_to is None else "revisit"
                size += out.write(press.compress(record(kind, id_, uri, payload, digest, refers_to)))
                records += 1
                if size >= rotate:
                    out.close()
                    out = None
                    done.append((name, records, size))
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            kinds = (pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["archive", "records", "bytes"])

    columns = rows.select("id", "uri", "payload", "digest", "refers_to")
    return fresh(columns.mapInArrow(run, "archive string, records bigint, bytes bigint"), "manifest")


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time; ``stream`` is read in small windows."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    known = stream.read(size)
    if len(known) >= 4 and struct.unpack("<I", known[:4])[0] == FRAME:
        known = zstandard.ZstdDecompressor().decompress(known)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
    rest = stream.read(WINDOW)
    while rest:
        frame, parts = unpress.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(WINDOW)
        yield b"".join(parts)
        rest = rest or stream.read(WINDOW)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives in ``manifest``: id, uri, record_type, refers_to, payload_bytes, payload_digest, payload
    (null for revisits). Payloads are checked against their digests."""

    def number(urn: str) -> int | None:
        inner = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, rows, size = 0, [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in frames(stream):
                        fields, payload = parsed(data)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        refers = number(fields["WARC-Refers-To"]) if revisit else None
                        length = int(fields["X-Payload-Length"]) if revisit else len(payload)
                        rows.append(
                            (number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], refers,
                             length, digest, None if revisit else payload)
                        )
                        found += 1
                        size += len(data)
                        if size > 4_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                if found != records:
                    raise ValueError(f"{name} holds {found} records instead of {records}")
                if rows:
                    yield batch(rows)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    schema = "id bigint, uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return manifest.select("archive", "records").mapInArrow(run, schema)


def with_referents(df: DataFrame, id_col: str, uri_col: str, body_col: str, least: int) -> DataFrame:
    """(id, uri, payload, length, digest, refers_to): a payload of at least ``least`` bytes that others have too refers to the
    largest id of those, unless it is that id's own."""
    payload = F.encode(F.coalesce(df[body_col], F.lit("")), "UTF-8")
    uri = F.regexp_replace(F.coalesce(df[uri_col], F.lit("")), r"[\x00-\x1F\x7F]", "")
    rows = only(df, id=df[id_col].cast("long"), uri=uri, payload=payload)
    rows = rows.withColumns({"length": F.length("payload"), "digest": F.sha1("payload")})
    # digests alone are counted; only those of several ids come back, a few copies of each so that a hot one is spread
    several = (
        rows.where(F.col("length") >= least)
        .groupBy("digest", "length")
        .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("last").isNotNull())
        .select("digest", "length", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    found = salted.join(several, ["digest", "length", "salt"], "left")
    other = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("id"))
    return found.select("id", "uri", "payload", "length", "digest", F.when(other, F.col("last")).alias("refers_to"))


SALTS = 8


def archive(df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html",
            least: int = 1000, rotate: int = 256 << 20, dictionary_bytes: int = 112_640, sample_records: int = 1000,
            sample_bytes: int = 8 << 20) -> DataFrame:
    """Write a record per row to ``.warc.zst`` files under ``folder`` and return their manifest.

    The payload is the UTF-8 body (null: empty). Among equal payloads of at least ``least`` bytes the row with the largest
    id is the response and the others revisit it; rows that repeat the largest id are responses each. A null id never is a
    referent while its group has another id. Control characters are left out of the URI. The dictionary is built from at
    most ``sample_records`` whole records or ``sample_bytes``, whatever the table's size. An empty table gives an empty manifest. Other columns are
    not archived. ``folder`` is a URI that all executors reach.
    """
    rows = with_referents(df, id_col, uri_col, body_col, least)
    plain = only(df, id=df[id_col].cast("long"), uri=F.coalesce(df[uri_col], F.lit("")),
                 payload=F.encode(F.coalesce(df[body_col], F.lit("")), "UTF-8"))
    plain = plain.withColumns({"length": F.length("payload"), "digest": F.sha1("payload")})
    longest = max(least, sample_bytes // 64)
    samples = sampled_records(plain, df.count(), sample_records, longest, sample_bytes)
    return write_archives(rows, folder, build_dictionary(samples, dictionary_bytes), rotate)


def shared_uri(spark: SparkSession, stem: str) -> str:
    """A new folder under the shared one, as a URI."""
    path = new_path(spark, stem)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


#: What the round trip over ``pages`` must give.
ARCHIVE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
m as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as last from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and last is not null and page_id is distinct from last then 'revisit' else 'response' end
    as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from last then last end as refers_to
from m
"""
