"""Joins by key variants, names, boxes; filters; unions with gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import text as T


def typed_features(types: DataFrame, features: DataFrame, key: str = "Label") -> DataFrame:
    """Nucleus types with their measured features, inner on an integer label."""
    as_int = lambda df: df.withColumn(key, F.col(key).cast("int"))
    return as_int(types).join(as_int(features), key)


def attach_labels(samples: DataFrame, labels: DataFrame, fallback: bool = True) -> DataFrame:
    """Samples with a label: the exact name, else (with ``fallback``) the token before "_" without leading zeros, else that
    token padded to three; -1 where nothing matches. One join over the exploded variants, the best variant wins."""
    token = T.canon_id(F.split_part("sample_name", F.lit("_"), F.lit(1)))
    keys = [F.col("sample_name"), *([token, T.zero_pad(token)] if fallback else [])]
    v = samples.select("sample_name", F.posexplode(F.array(*keys)).alias("_rank", "patient_id"))
    hit = v.join(labels.select("patient_id", F.col("label").alias("_l")), "patient_id").groupBy("sample_name").agg(F.min_by("_l", "_rank").alias("_l"))
    return samples.join(hit, "sample_name", "left").withColumn("label", F.coalesce("_l", F.lit(-1))).drop("_l")


def labelled(df: DataFrame) -> DataFrame:
    return df.where("label >= 0")


def allowed_cohorts(cells: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Rows whose cohort, ignoring case and blanks, is on the list."""
    names = sorted({"".join(a.split()).lower() for a in allow})
    return cells.where(T.cohort_key(F.col("cohort")).isin(names))


def same_samples(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("sample_name").distinct(), "sample_name", "left_semi")


def named_signature(sig: DataFrame, genes: DataFrame) -> DataFrame:
    """Signature genes that are ordinals become symbols, but only if every gene of the table is a number."""
    number = F.col("gene").try_cast("int")
    numeric = sig.agg(F.coalesce(F.bool_and(number.isNotNull()), F.lit(False))).scalar()
    s = sig.withColumn("_all", numeric).withColumn("_i", F.when(F.col("_all"), number))
    return (
        s.join(genes.select(F.col("idx").alias("_i"), "symbol"), "_i", "left")
        .withColumn("gene", F.coalesce("symbol", F.col("gene")))
        .drop("_i", "_all", "symbol")
    )


def boxes_on_tiles(boxes: DataFrame, tile: float) -> DataFrame:
    """(poly_id, tx, ty, share): tiles a box touches and the share of the box inside each."""
    t = F.lit(float(tile))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / t), F.floor(F.col(b) / t))
    x = boxes.withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))
    inside = lambda a, b, c: F.least(F.col(b), (F.col(c) + 1) * t) - F.greatest(F.col(a), F.col(c) * t)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return x.select("sample_name", "poly_id", "tx", "ty", (inside("x0", "x1", "tx") * inside("y0", "y1", "ty") / area).alias("share"))


def bounding_boxes(polygons: DataFrame) -> DataFrame:
    axis = lambda a: F.transform("ring", lambda p: p[a])
    return polygons.select(
        "sample_name", "poly_id", F.array_min(axis("x")).alias("x0"), F.array_max(axis("x")).alias("x1"),
        F.array_min(axis("y")).alias("y0"), F.array_max(axis("y")).alias("y1"),
    )


def tile_grid(extents: DataFrame, patch: int, overlap: int = 0) -> DataFrame:
    """(sample, ox, oy): tile origins from 0 below the width and height, stepping by patch - overlap."""
    step = patch - overlap
    axis = lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.col(c) / step).cast("int") - 1), lambda i: i * step)
    return extents.withColumn("ox", F.explode(axis("width"))).withColumn("oy", F.explode(axis("height"))).select("sample_name", "ox", "oy")


def tissue_tiles(pixels: DataFrame, tile: float, least: float, flag: str) -> DataFrame:
    """Tiles whose mean tissue flag reaches the threshold."""
    t = pixels.groupBy("sample_name", F.floor(F.col("pos_x") / tile).alias("tx"), F.floor(F.col("pos_y") / tile).alias("ty"))
    return t.agg(F.avg(F.col(flag).cast("double")).alias("coverage")).where(F.col("coverage") >= least)


def level_under_budget(levels: DataFrame, budget: int) -> DataFrame:
    """Per sample the finest level whose pixels fit the budget, else the coarsest level."""
    fits = F.col("width") * F.col("height") <= budget
    return levels.groupBy("sample_name").agg(
        F.coalesce(F.min(F.when(fits, F.col("level"))), F.max("level")).alias("level")
    )


def backfill(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Missing values of the columns from the other table, joined on the first key both tables have."""
    key = next((k for k in keys if k in df.columns and k in other.columns), None)
    if key is None:
        raise ValueError(f"no shared key among {list(keys)}")
    o = other.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(f"_o_{c}") for c in columns if c in other.columns])
    j = df.join(o, key, "left")
    for c in columns:
        sides = [F.col(x) for x in (c, f"_o_{c}") if x in j.columns]
        j = j.withColumn(c, F.coalesce(*sides) if sides else F.lit(None).cast("double"))
    return j.drop(*[f"_o_{c}" for c in columns])


def combine_first(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys of both tables, values of the first where present, else of the second."""
    vals = [c for c in a.columns if c not in keys]
    o = b.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in vals])
    return a.join(o, list(keys), "full_outer").select(*keys, *[F.coalesce(c, f"_o_{c}").alias(c) for c in vals])


def match_cohort(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Root of each cohort name: equal after normalising, else the first root (by key) whose key contains it or is contained.

    A key that contains another has it among its pieces of the other's length. So each side is cut into pieces of the
    lengths that the other side has, and pieces meet keys by equality; a name costs its own pieces, however many
    roots there are. Blank names and roots match nothing.
    """
    names = df.select("cohort").distinct().withColumn("k", T.cohort_key(F.col("cohort"))).where("k is not null and k <> ''")
    table = roots.select(T.cohort_key(F.col("name")).alias("k"), "root").where("k is not null and k <> ''")
    table = table.groupBy("k").agg(F.min("root").alias("root"))
    inside = _pieces(names, table).join(table.select(F.col("k").alias("_piece"), F.col("root").alias("_root")), "_piece")
    inside = inside.select("cohort", "k", F.col("_piece").alias("at"), "_root")
    around = _pieces(table, names).join(names.select(F.col("k").alias("_piece"), "cohort"), "_piece")
    around = around.select("cohort", F.col("_piece").alias("k"), F.col("k").alias("at"), F.col("root").alias("_root"))
    found = inside.unionByName(around).groupBy("cohort").agg(
        F.min_by("_root", F.struct((F.col("k") != F.col("at")).alias("other"), F.col("at"))).alias("root")
    )
    return df.join(found, "cohort", "left")


def _pieces(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows with each distinct ``_piece`` of their key that has the length of some key of the other table."""
    lengths = other.agg(F.coalesce(F.collect_set(F.length("k")), F.array().cast("array<int>"))).scalar()
    whole = F.length("k")
    cuts = F.flatten(
        F.transform(
            F.filter("_lengths", lambda n: n <= whole),
            lambda n: F.transform(F.sequence(F.lit(1), whole - n + 1), lambda i: F.substr("k", i, n)),
        )
    )
    return df.withColumn("_lengths", lengths).withColumn("_piece", F.explode(F.array_distinct(cuts))).drop("_lengths")
