"""Readers: files to typed DataFrames. Every reader is a lazy scan; schemas are given, not inferred, where rows can be many."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import text as T
from tilewright.operators.ordered import first_per_key

# Columns of a nucleus table that are not features, and the nucleus types.
NOT_FEATURES = [
    "Identifier.CentoidX_Global", "Identifier.CentoidY_Global", "Global_Nuclei_ID", "type",
    "Shape.HuMoments2", "Shape.HuMoments3", "Shape.HuMoments4", "Shape.HuMoments5", "Shape.HuMoments6", "Shape.HuMoments7",
    "Shape.WeightedHuMoments2", "Shape.WeightedHuMoments3", "Shape.WeightedHuMoments4", "Shape.WeightedHuMoments6",
]
NUCLEUS_TYPES = ["Connective", "Neoplastic", "Dead", "Epithelial", "Inflammatory"]

COHORTS = """model_path string, output_dir string, cohort_allowlist array<string>, cohorts array<struct<name:string,
processed_root:string, cell_root:string, gene_root:string, svs_root:string, geojson_root:string, pos_level:int,
label:struct<file:string, format:string, sheet_name:string, patient_column:string, value_column:string,
positive_values:array<string>, value_mapping:map<string,int>>>>"""


def _place() -> Column:
    """Sortable place of a row in its files: path, split start, position."""
    return F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    )


def _in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a place ``_at`` numbered from 0 by path, split and position: ranks within each split, and one small table of
    the splits' sizes."""
    split = ["_at.f", "_at.b"]
    at = Window.partitionBy(*split).orderBy("_at.i")
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*[F.col(c).alias(c[-1]) for c in split]).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(at) - 1)
    joined = ranked.join(starts, (F.col("_at.f") == F.col("f")) & (F.col("_at.b") == F.col("b")))
    return joined.withColumn(name, F.col("_start") + F.col("_rank")).drop("_start", "_rank", "f", "b", "_at")


def _stem() -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)


def cohort_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row per cohort of a JSON config, defaults filled in."""
    raw = spark.read.schema(COHORTS).option("multiLine", True).json(path)
    c = raw.select("model_path", "output_dir", "cohort_allowlist", F.explode("cohorts").alias("c"))
    positives = F.array(*[F.lit(v) for v in T.DEFAULT_POSITIVES])
    return c.select(
        "model_path",
        "output_dir",
        "cohort_allowlist",
        *[F.col(f"c.{n}").alias(n) for n in ("name", "processed_root", "cell_root", "gene_root", "svs_root", "geojson_root", "pos_level")],
        F.col("c.label.file").alias("label_file"),
        F.coalesce("c.label.format", F.lit("csv")).alias("label_format"),
        F.coalesce("c.label.patient_column", F.lit("patient")).alias("patient_column"),
        F.coalesce("c.label.value_column", F.lit("pCR")).alias("value_column"),
        F.coalesce("c.label.positive_values", positives).alias("positive_values"),
        F.col("c.label.value_mapping").alias("value_mapping"),
    )


def cohort_labels(
    spark: SparkSession, path: str, patient: str = "patient", value: str = "pCR", positives: Sequence[str] = tuple(T.DEFAULT_POSITIVES),
    mapping: dict[str, int] | None = None,
) -> DataFrame:
    """(patient_id, label): ids trimmed, blanks dropped, the last row of a repeated id wins."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(
        F.trim(F.col(patient)).alias("patient_id"), T.label_value(F.col(value), mapping, positives).alias("label"), _place().alias("_at")
    ).where("patient_id <> ''")
    return first_per_key(rows, ["patient_id"], ["_at"], last=True).drop("_at")


def survival_labels(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, t, e): first 12 characters as key, days to years, non-numeric rows dropped, the first row wins."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(
        F.substring("PatientID", 1, 12).alias("patient_id"),
        (F.col("T").try_cast("double") / 365.0).alias("t"),
        F.col("E").try_cast("double").alias("e"),
        _place().alias("_at"),
    ).na.drop(subset=["t", "e"])
    return first_per_key(rows, ["patient_id"], ["_at"]).drop("_at")


def nuclei(spark: SparkSession, path: str) -> DataFrame:
    """(sample_name, global_id, x, y, cell_type, feats): numeric columns by name order in the file, bad cells as 0, then the
    one-hot type."""
    from tilewright.functions.arrays import one_hot

    raw = spark.read.option("header", True).csv(path)
    keep = [c for c in raw.columns if c not in NOT_FEATURES]
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
    feats = F.array(*[number(c) for c in keep]) if keep else F.array().cast("array<double>")
    return raw.select(
        _stem().alias("sample_name"),
        F.col("Global_Nuclei_ID").try_cast("long").alias("global_id"),
        F.col("`Identifier.CentoidX_Global`").try_cast("double").alias("x"),
        F.col("`Identifier.CentoidY_Global`").try_cast("double").alias("y"),
        F.col("type").alias("cell_type"),
        F.concat(feats, one_hot(F.col("type"), NUCLEUS_TYPES)).alias("feats"),
    )


def tile_expression(spark: SparkSession, path: str) -> DataFrame:
    """Long (sample_name, x, y, gene, value) from wide per-sample files whose first column is ``<x>_<y>``. The sample is the
    value of a ``<column>=<value>`` folder, or else the file's stem."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    key, genes = raw.columns[0], raw.columns[1:]
    at = F.split(F.col(f"`{key}`"), "_")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/[^/=]+=([^/]*)/[^/]+$", 1)
    wide = raw.select(
        F.when(folder != "", folder).otherwise(_stem()).alias("sample_name"),
        F.coalesce(F.get(at, F.lit(0)).try_cast("double"), F.lit(0.0)).alias("x"),
        F.coalesce(F.get(at, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("y"),
        *[F.coalesce(F.col(f"`{g}`").try_cast("double"), F.lit(0.0)).alias(g) for g in genes],
    )
    return wide.unpivot(["sample_name", "x", "y"], genes, "gene", "value")


def training_expression(spark: SparkSession, path: str) -> DataFrame:
    """Long (sample_name, x, y, gene, value) from a wide file whose first column is ``<sample>_<x>_<y>``."""
    raw = spark.read.option("header", True).csv(path)
    key, genes = raw.columns[0], raw.columns[1:]
    p = T.stem_parts(F.col(f"`{key}`"))
    wide = raw.select(
        p["sample"].alias("sample_name"), p["x"].alias("x"), p["y"].alias("y"), *[F.col(f"`{g}`").try_cast("double").alias(g) for g in genes]
    )
    return wide.unpivot(["sample_name", "x", "y"], genes, "gene", "value")


def files(spark: SparkSession, root: str, extensions: Sequence[str], recursive: bool = True) -> DataFrame:
    """(path, name) of the files with one of the extensions; the content column is never read."""
    wanted = sorted({e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions})
    f = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return f.where(ext.isin(wanted)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).orderBy("path")


def patches(spark: SparkSession, root: str) -> DataFrame:
    """(sample, x, y, path) of ``<sample>/<stem>_<x>_<y>.jpg``; malformed names are skipped."""
    f = files(spark, root, [".jpg"])
    p = T.stem_parts(F.regexp_replace("name", r"\.[^.]*$", ""))
    out = f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample"), p["x"].alias("x"), p["y"].alias("y"), "path")
    return out.na.drop(subset=["x", "y"])


GEOJSON = "array<struct<geometry:struct<type:string,coordinates:string>,classification:struct<name:string>,properties:struct<downsample:double,level:int>>>"


def polygons(spark: SparkSession, path: str, root: str = "features") -> DataFrame:
    """(sample_name, poly_id, class, ring): exterior rings at level 0 of Polygon and MultiPolygon features.

    The file holds a list of features or a collection; the scale comes from the first feature that carries one.
    """
    whole = spark.read.option("wholetext", True).text(path).select(_stem().alias("sample_name"), F.trim("value").alias("v"))
    body = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", f"$.{root}"))
    f = whole.select("sample_name", F.from_json(body, GEOJSON).alias("fs"))
    scale = F.get(F.filter(F.transform("fs", lambda x: F.coalesce(x["properties"]["downsample"], F.pow(F.lit(2.0), x["properties"]["level"]))), lambda v: v.isNotNull()), F.lit(0))
    f = f.select("sample_name", F.coalesce(scale, F.lit(1.0)).alias("ds"), F.posexplode("fs").alias("i", "x"))
    g = F.col("x.geometry.coordinates")
    multi = F.from_json(g, "array<array<array<array<double>>>>")
    single = F.array(F.from_json(g, "array<array<array<double>>>"))
    parts = F.when(F.col("x.geometry.type") == "MultiPolygon", multi).when(F.col("x.geometry.type") == "Polygon", single)
    r = f.select("sample_name", "ds", "i", F.col("x.classification.name").alias("class"), F.posexplode(parts).alias("part", "poly"))
    ring = F.transform(F.get(F.col("poly"), F.lit(0)), lambda p: F.struct((p[0] * F.col("ds")).alias("x"), (p[1] * F.col("ds")).alias("y")))
    return r.select("sample_name", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("part")).alias("poly_id"), "class", ring.alias("ring"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Parsed GTF rows (gene_id, gene_name, feature, start, end) in file order."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(
        "c0 string, c1 string, feature string, start string, stop string, c5 string, c6 string, c7 string, attributes string"
    ).csv(path)
    m = T.attribute_map(F.col("attributes"))
    rows = raw.where(F.col("attributes").isNotNull()).select(
        T.without_version(F.try_element_at(m, F.lit("gene_id"))).alias("gene_id"),
        F.try_element_at(m, F.lit("gene_name")).alias("gene_name"),
        "feature",
        F.col("start").try_cast("long").alias("start"),
        F.col("stop").try_cast("long").alias("stop"),
        _place().alias("_at"),
    )
    return rows.where(F.col("gene_id") != "")


def gene_names(rows: DataFrame) -> DataFrame:
    """(gene_name, gene_id): the first id of every name."""
    named = rows.where(F.col("gene_name") != "").select("gene_name", "gene_id", "_at")
    return first_per_key(named, ["gene_name"], ["_at"]).drop("_at")


def exon_lengths(rows: DataFrame) -> DataFrame:
    exons = rows.where((F.col("feature") == "exon") & F.col("start").isNotNull() & F.col("stop").isNotNull())
    return exons.groupBy("gene_id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.col("start") + 1)).alias("length"))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(idx, gene): first token of every line that is neither blank nor a comment, numbered in file order."""
    raw = spark.read.text(path).select(F.trim("value").alias("v"), _place().alias("_at"))
    rows = raw.where((F.col("v") != "") & ~F.col("v").startswith("#")).select(F.get(F.split("v", r"[\s,]+"), F.lit(0)).alias("gene"), "_at")
    return _in_file_order(rows, "idx").select("idx", "gene")


def gene_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(idx, symbol, ensembl) from a headerless two-column file, ids without version, numbered from 0."""
    raw = spark.read.option("sep", sep).schema("symbol string, ensembl string").csv(path)
    rows = raw.select("symbol", T.without_version(F.col("ensembl")).alias("ensembl"), _place().alias("_at"))
    return _in_file_order(rows, "idx").select("idx", "symbol", "ensembl")


def gene_lengths(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(gene, length); the columns are found by name in any case: gene..., and length or merged."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    low = {c.lower(): c for c in raw.columns}
    gene = next((low[c] for c in low if c.startswith("gene")), raw.columns[0])
    size = next((low[c] for c in low if c in ("length", "merged")), raw.columns[1])
    return raw.select(T.without_version(F.col(gene)).alias("gene"), F.col(size).try_cast("double").alias("length")).na.drop()


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, direction, gene) from ``{name: {genes: [...], direction: ...}}``; malformed sets dropped."""
    whole = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string, struct<genes:array<string>, direction:string>>")
    s = whole.select(F.explode(m).alias("name", "s")).where(F.col("s.genes").isNotNull())
    return s.select("name", F.coalesce("s.direction", F.lit("two-sided")).alias("direction"), F.explode("s.genes").alias("gene")).withColumn(
        "gene", F.trim("gene")
    ).where("gene <> ''")


def prior_composition(spark: SparkSession, path: str, macros: Sequence[str], sep: str = ",") -> DataFrame:
    """(prototype, macro, frac) from a long or a wide table; missing classes 0, rows scaled to 1, empty rows uniform."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    low = {c.lower(): c for c in raw.columns}
    key = next(low[c] for c in low if "proto" in c or "archetype" in c)
    kind = next((low[c] for c in low if low[c] != key and ("macro" in c or "type" in c or "class" in c)), None)
    if kind is not None:
        size = next(low[c] for c in low if "frac" in c or "prop" in c or "value" in c)
        long = raw.select(T.prototype_name(F.col(key)).alias("prototype"), F.col(kind).alias("macro"), F.col(size).try_cast("double").alias("v"))
    else:
        have = [m for m in macros if m in raw.columns]
        wide = raw.select(T.prototype_name(F.col(key)).alias("prototype"), *[F.col(m).try_cast("double").alias(m) for m in have])
        long = wide.unpivot(["prototype"], have, "macro", "v")
    sums = long.groupBy("prototype").agg(*[F.coalesce(F.sum(F.when(F.col("macro") == m, F.greatest("v", F.lit(0.0)))), F.lit(0.0)).alias(m) for m in macros])
    total = sum((F.col(m) for m in macros[1:]), F.col(macros[0]))
    frac = [F.when(total > 0, F.col(m) / total).otherwise(F.lit(1.0 / len(macros))).alias(m) for m in macros]
    return sums.select("prototype", *frac).unpivot(["prototype"], list(macros), "macro", "frac")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(gene_idx, cell_idx, x) from coordinate lines; comments and the size line are skipped.

    A matrix may be cut into several files; the size line is the first line without "%" of each file with a banner.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("i"))
    t = raw.where(~F.col("value").startswith("%")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    heads = raw.where(F.col("value").startswith("%%MatrixMarket")).select("file_path").distinct()
    first = t.join(heads, "file_path", "left_semi").groupBy("file_path").agg(F.min("i").alias("i0"))
    return t.join(first, "file_path", "left").where("i0 is null or i > i0").select(
        F.col("p")[0].cast("int").alias("gene_idx"), F.col("p")[1].cast("int").alias("cell_idx"), F.col("p")[2].cast("double").alias("x")
    )


def prefilter_cells(counts: DataFrame, min_counts: float, keep_top: int | None = None) -> DataFrame:
    """Counts of the cells with at least ``min_counts`` in total; with ``keep_top``, of so many of the largest."""
    lib = counts.groupBy("cell_idx").agg(F.sum("x").alias("library")).where(F.col("library") >= min_counts)
    best = (lib if keep_top is None else lib.orderBy(F.desc("library"), "cell_idx").limit(keep_top)).select("cell_idx")
    return counts.join(best, "cell_idx", "left_semi")


def attach_metadata(counts: DataFrame, barcodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts with barcode and cell type; a barcode unknown to the metadata is tried again without its "-1" suffix."""
    m = meta.select(F.col("barcode").alias("_b"), "celltype")
    short = meta.select(T.strip_barcode(F.col("barcode")).alias("_b"), F.col("celltype").alias("_short"))
    b = barcodes.join(m, barcodes.barcode == m._b, "left").drop("_b")
    short = short.groupBy("_b").agg(F.min("_short").alias("_short"))
    b = b.withColumn("_k", T.strip_barcode(F.col("barcode"))).join(short, F.col("_k") == F.col("_b"), "left")
    b = b.select("cell_idx", "barcode", F.coalesce("celltype", "_short").alias("celltype"))
    return counts.join(b, "cell_idx", "left")


def bulk_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long (gene, sample, value) from a genes x samples CSV."""
    raw = spark.read.option("header", True).csv(path)
    key, samples = raw.columns[0], raw.columns[1:]
    wide = raw.select(F.col(f"`{key}`").alias("gene"), *[F.col(f"`{s}`").try_cast("double").alias(s) for s in samples])
    long = wide.unpivot(["gene"], samples, "sample", "value")
    return long.withColumn("sample", T.squeeze(F.col("sample")))


def phenotype(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(sample, response); a table with attributes as rows is turned round first."""
    raw = spark.read.option("header", True).csv(path)
    key = raw.columns[0]
    if column not in raw.columns:  # attributes are rows: keep the wanted one and turn its columns into rows
        one = raw.where(F.col(f"`{key}`") == column)
        long = one.unpivot([key], raw.columns[1:], "sample", "v").select("sample", F.col("v"))
    else:
        long = raw.select(F.col(f"`{key}`").alias("sample"), F.col(f"`{column}`").alias("v"))
    return long.select(T.squeeze(F.col("sample")).alias("sample"), T.response_label(F.col("v")).alias("response"))


def slide_bags(
    patches_: DataFrame, slides: DataFrame, labels: DataFrame, target: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Patch embeddings with their patient and label: slides of a patient form one bag. ``target`` maps the label column."""
    bags = patches_.join(slides, "slide_id").join(labels, "patient_id")
    return bags.withColumn("label", target(F.col("label"))) if target else bags


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(set, class, prompt) from ``{set: {classnames: {class: [...]}, templates: [...]}}``: every name in every template."""
    whole = spark.read.option("wholetext", True).text(path)
    kind = "map<string, struct<classnames:map<string,array<string>>, templates:array<string>>>"
    s = whole.select(F.explode(F.from_json("value", kind)).alias("set", "s"))
    c = s.select("set", F.explode("s.classnames").alias("class", "names"), F.col("s.templates").alias("templates"))
    return c.select("set", "class", F.explode(T.expand_templates(F.col("names"), F.col("templates"))).alias("prompt"))


def tile_index(df: DataFrame, root: str, identifier: str, folder: str | None, target: str, classes: dict[str, int]) -> DataFrame:
    """(id, path, label): tile path from root, optional folder and id; rows of unknown classes dropped."""
    parts = [F.lit(root), *( [F.col(folder)] if folder else []), F.col(identifier)]
    table = F.create_map(*[F.lit(v) for kv in classes.items() for v in kv])
    return df.where(F.col(target).isin(list(classes))).select(
        F.col(identifier).alias("id"), F.concat_ws("/", *parts).alias("path"), F.element_at(table, F.col(target)).alias("label")
    )


def sample_rows(spark: SparkSession, path: str, sample: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of one sample; both the filter and the columns reach the Parquet scan."""
    return spark.read.parquet(path).where(F.col("sample_name") == sample).select(*columns)


def tagged_results(spark: SparkSession, path: str, required: Sequence[str], pattern: str, tag: str = "tag") -> DataFrame:
    """Result CSVs anywhere below a folder as one table, with a tag taken from the file name.

    Files that lack a required column, or whose name has no tag, are left out; other columns may differ and are null where a
    file lacks them. The driver sees one header line per file.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", "_metadata.file_path", _place().alias("_at"))
    heads = raw.where("_at.b = 0").groupBy("file_path").agg(F.min_by("value", "_at.i").alias("head"))
    tagged = F.regexp_extract(F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1), pattern, 1)
    by_head: dict[str, list[str]] = {}
    for file, head in heads.where(tagged != "").collect():
        if set(required) <= {c.strip().strip('"') for c in head.split(",")}:
            by_head.setdefault(head, []).append(file)
    out = None
    for files_ in by_head.values():
        own = spark.read.option("header", True).csv(files_)
        own = own.select(*own.columns, F.regexp_extract(_stem(), pattern, 1).alias(tag))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*required, tag]))
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): lines of a text file or folder from 0, in file order."""
    return _in_file_order(spark.read.text(path).select("value", _place().alias("_at")), "idx").select("idx", "value")


def tenx(spark: SparkSession, folder: str) -> DataFrame:
    """(gene, barcode, x) of a directory with matrix.mtx, features.tsv and barcodes.tsv: entries by the names their numbers
    stand for; a feature's second column is its name where there is one."""
    parts = F.split("value", "\t")
    genes = numbered_lines(spark, f"{folder}/features.tsv").select(
        (F.col("idx") + 1).alias("gene_idx"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).alias("gene")
    )
    barcodes = numbered_lines(spark, f"{folder}/barcodes.tsv").select((F.col("idx") + 1).alias("cell_idx"), F.trim("value").alias("barcode"))
    return matrix_market(spark, f"{folder}/matrix.mtx").join(genes, "gene_idx").join(barcodes, "cell_idx").select("gene", "barcode", "x")


def signature_table(spark: SparkSession, path: str) -> DataFrame:
    """Long (gene, column, value) of a wide signature CSV with a ``gene`` column."""
    raw = spark.read.option("header", True).csv(path)
    if "gene" not in raw.columns:
        raise ValueError("a signature table needs a gene column")
    rest = [c for c in raw.columns if c != "gene"]
    wide = raw.select(T.clean_gene(F.col("gene")).alias("gene"), *[F.col(c).try_cast("double").alias(c) for c in rest])
    return wide.where("gene is not null").unpivot(["gene"], rest, "column", "value")
