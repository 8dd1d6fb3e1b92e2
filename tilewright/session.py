"""Session settings, table loading and the shared work folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: str = "8", name: str = "tilewright", shuffle: str = "8") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the caller passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # small tables on one machine: keep all cores busy rather than filling 64 MB partitions
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_own_dir: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master (tests, one machine) may lack that setting: a temporary folder is made once per application and
    removed when Python ends. Elsewhere executors would each write to their own disk, so its absence is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return _own_dir[app]


def new_path(spark: SparkSession, stem: str) -> str:
    """A fresh path under the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's state as a Parquet table in the shared folder and read it back.

    Survives the loss of executors, unlike cached or locally checkpointed blocks, and keeps column statistics.
    """
    path = new_path(df.sparkSession, "state")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._state_path = path
    return out


#: Rows of a partition that :func:`spread` aims at.
SPREAD = 1 << 18


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows materialised and dealt by ``keys`` to partitions of about SPREAD rows.

    For steps that make several rows or groups of each row behind the shuffle: adaptive execution merges partitions by the
    bytes that arrive, so a task's memory would follow from what it makes of them.
    """
    return dealt(cut_lineage(df), keys, SPREAD)


def dealt(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Rows of a written table dealt by ``keys`` to partitions of about ``size`` rows; they are counted first."""
    return df.repartition(max(1, -(-df.count() // size)), *keys)


def forget(df: DataFrame) -> None:
    """Delete the files of an iteration's state that nothing reads any more."""
    path = getattr(df, "_state_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
