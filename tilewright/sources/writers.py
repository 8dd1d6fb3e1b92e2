"""Writers, manifests and resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_per_sample(df: DataFrame, path: str, sample: str = "sample_name") -> DataFrame:
    """One folder per sample and a manifest of row counts; returns the manifest.

    Rows are spread over (sample, hash) so that a huge sample is written by many tasks, as several files.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(F.col(sample), (F.xxhash64(*df.columns[:3]) % tasks))
    spread.write.mode("overwrite").partitionBy(sample).parquet(f"{path}/data")
    manifest = df.sparkSession.read.parquet(f"{path}/data").groupBy(sample).agg(F.count(F.lit(1)).alias("rows"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def write_predictions_wide(df: DataFrame, path: str, genes: Sequence[str]) -> DataFrame:
    """Per-sample CSV, one row per ``<x>_<y>``, one column per listed gene."""
    row = F.format_string("%d_%d", F.col("x").cast("long"), F.col("y").cast("long")).alias("spot")
    wide = df.groupBy("sample_name", row).pivot("gene", list(genes)).agg(F.avg("value"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = wide.repartition(F.col("sample_name"), F.xxhash64("spot") % tasks)  # few files, and many tasks for a huge sample
    wide.write.mode("overwrite").partitionBy("sample_name").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(
        "spot string, " + ", ".join(f"`{g}` double" for g in genes) + ", sample_name string"
    ).csv(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns as CSV with a header; read back with the same schema."""
    out = df.select(*columns)
    out.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(out.schema).csv(path)


def write_survival_predictions(df: DataFrame, path: str) -> DataFrame:
    return write_csv(df, path, ["sample_index", "sample_name", "risk_score", "time_years", "event"])


def write_response_predictions(df: DataFrame, path: str) -> DataFrame:
    return write_csv(df, path, ["prediction", "label"])


def write_manifest(df: DataFrame, path: str, **about) -> DataFrame:
    """A one-row JSON record of a table's size and the given parameters."""
    facts = df.agg(F.count(F.lit(1)).alias("rows")).withColumns({k: F.lit(v) for k, v in about.items()})
    facts = facts.withColumn("columns", F.lit(len(df.columns)))
    facts.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(facts.schema).json(path)


def unfinished(units: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Units that have no result yet."""
    return units.join(done.select(*key).distinct(), list(key), "left_anti")


def content_key(df: DataFrame, column: str, **params) -> str:
    """Hash of a stage's parameters, of its samples and of the content of all its rows, for reuse of a stored stage.

    Rows are hashed one by one and the hashes folded by count, sum and xor, so nothing is gathered.
    """
    h, name = F.xxhash64(*sorted(df.columns)), F.xxhash64(column)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.sum(name.cast("decimal(38,0)")).alias("m")
    ).withColumn("key", F.sha1(F.concat_ws("|", F.lit(repr(sorted(params.items()))), F.lit(",".join(sorted(df.columns))), "n", "x", "s", "m")))
    return row.first()["key"]


def cached_stage(df: DataFrame, root: str, column: str, build, **params) -> DataFrame:
    """Stored result of ``build(df)`` for these parameters and this set of samples, made on first use."""
    spark = df.sparkSession
    path = f"{root}/{content_key(df, column, **params)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def asset_report(samples: DataFrame, listed: DataFrame) -> DataFrame:
    """Per sample the first listed path that contains one of its name variants, and whether one was found.

    Candidates meet through shared tokens of both names, an equi-join, and are then checked for containment; a sample is
    compared with the files that share a token, not with all files.
    """
    from tilewright.functions.text import name_variants

    tokens = lambda c: F.array_distinct(F.split(F.lower(c), "[^A-Za-z0-9]+"))
    s = samples.withColumn("_v", F.explode(name_variants(F.col("sample_name")))).withColumn(
        "_t", F.element_at(F.array_sort(F.filter(tokens(F.col("_v")), lambda t: t != ""), lambda a, b: F.length(b) - F.length(a)), 1)
    )
    f = listed.withColumn("_t", F.explode(F.filter(tokens(F.regexp_extract("path", r"([^/]+)$", 1)), lambda t: t != "")))
    hits = s.join(f, "_t").where(F.contains("path", "_v")).groupBy("sample_name").agg(F.min("path").alias("path"))
    return samples.join(hits, "sample_name", "left").withColumn("found", F.col("path").isNotNull())


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def write_files(df: DataFrame, folder: str) -> None:
    """A file per row of (path, content): executors write below the shared ``folder``. A repeated attempt writes the same
    bytes to the same name."""
    root = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{base}/{path}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content)
            yield b.select(["path"])

    df.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def write_square_matrix(m: DataFrame, path: str, labels: Sequence[int]) -> DataFrame:
    """A long matrix (src, dst, value) as CSV with a row and a column per label; read back in long form, absent entries left
    out."""
    names = [str(x) for x in labels]
    wide = m.groupBy("src").pivot("dst", list(labels)).agg(F.first("value"))
    wide.write.mode("overwrite").option("header", True).csv(path)
    kinds = m.schema["src"].dataType.simpleString()
    back = m.sparkSession.read.option("header", True).schema(f"src {kinds}, " + ", ".join(f"`{x}` double" for x in names)).csv(path)
    long = back.unpivot(["src"], [F.col(f"`{x}`") for x in names], "dst", "value").where("value is not null")
    return long.withColumn("dst", F.col("dst").cast(m.schema["dst"].dataType))
