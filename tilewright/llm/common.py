"""Small helpers the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tables that `fresh` wrote and nothing deleted yet.
MADE: list[str] = []


def fresh(df: DataFrame, stem: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: later branches see the same rows, and a lost executor
    costs a re-read instead of the whole lineage."""
    path = new_path(df.sparkSession, stem)
    MADE.append(path)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._state_path = path
    return out


def discard(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables made after the first ``since`` ones, all but ``keep``."""
    for path in MADE[since:]:
        if path != keep._state_path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    MADE[since:] = [keep._state_path]


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Exactly the named columns, so that other columns of the input can't clash with a result."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``make`` runs once per task and gives the function applied to each Arrow batch. What it holds (a tokenizer, a memo)
    ends with the task: workers serve many operators, and their memories would add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)
        del each
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: idle workers stay for a while beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep theirs
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_groups(column: pa.Array, most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters at a time; null reads as the empty text."""
    texts = (x or "" for at in range(0, len(column), 256) for x in column.slice(at, 256).to_pylist())
    return in_groups(texts, most)


class Memo(dict):
    """Results by key, in two generations of at most ``most`` entries, so memory is bounded whatever the corpus holds.
    Entries still in use move on when a generation is full."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most, self.older = most, {}

    def fill(self, wanted: set, solve: Callable[[list], list]) -> None:
        """Solve those of ``wanted`` that aren't known; all of them can be looked up afterwards."""
        missing = [x for x in wanted if x not in self]
        if len(self) + len(missing) > self.most:
            self.older = dict(self)
            self.clear()
            missing = list(wanted)
        older = self.older
        self.update((x, older[x]) for x in missing if x in older)
        missing = [x for x in missing if x not in older]
        self.update(zip(missing, solve(missing), strict=True))


def in_groups(values: Iterable[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, each text whole."""
    group, size = [], 0
    for v in values:
        group.append(v)
        size += len(v)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def single_threaded() -> None:
    """Tokenizer libraries stay on the core that Spark gave the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
