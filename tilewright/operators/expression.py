"""Expression tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import between, order_statistics, quantiles, with_ranges
from tilewright.session import cut_lineage, spread


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, name: str = "scaled") -> DataFrame:
    """(x - median) / interquartile range per key; a zero range divides by 1."""
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75], "_q")
    width = F.col("_q")[2] - F.col("_q")[0]
    return (
        df.join(q, list(keys))
        .withColumn(name, (F.col(value) - F.col("_q")[1]) / F.when(width == 0, F.lit(1.0)).otherwise(width))
        .drop("_q")
    )


def robust_z_fit(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and spread per key: 1.4826 times the median absolute deviation, else the standard deviation, else 1."""
    mid = cut_lineage(quantiles(df, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias("mu")))
    sd = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"))
    away = df.join(mid, list(keys)).withColumn("_away", F.abs(F.col(value) - F.col("mu")))
    mad = quantiles(away, keys, "_away", [0.5], "_q").select(*keys, (1.4826 * F.col("_q")[0]).alias("_mad"))
    return (
        mid.join(mad, list(keys))
        .join(sd, list(keys))
        .select(*keys, "mu", F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0).alias("spread"))
    )


def robust_z(df: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    fit = robust_z_fit(df, keys, value)
    return df.join(fit, list(keys)).withColumn(name, (F.col(value) - F.col("mu")) / F.col("spread")).drop("mu", "spread")


# ---------------------------------------------------------------- transforms


def weighted_expression(edges: DataFrame, tile_expr: DataFrame, groups: Sequence[str] = ("sample_name",)) -> DataFrame:
    """(groups, node_idx, gene, value): edge-weighted mean tile expression per cell; cells whose weights sum to 0 drop out.

    A missing weight counts as 1. Edges whose tile is not in the table vanish in the join. Edges are dealt by cell and meet
    the genes of a tile as one row, so that a row for each edge and gene need not travel.
    """
    groups = list(groups)
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    e = spread(edges.select(*groups, F.col("src"), F.col("dst").alias("tile_id"), w.alias("_w")), [*groups, "src"])
    genes = tile_expr.groupBy(*groups, "tile_id").agg(F.collect_list(F.struct("gene", "value")).alias("_g"))
    return (
        e.join(genes, [*groups, "tile_id"])
        .select(*groups, "src", "_w", F.inline("_g"))
        .groupBy(*groups, F.col("src").alias("node_idx"), "gene")
        .agg(F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("value")).alias("_sv"))
        .where("_sw > 0")
        .select(*groups, "node_idx", "gene", (F.col("_sv") / F.col("_sw")).alias("value"))
    )


def tpm_log(df: DataFrame, lengths: DataFrame, unit: Sequence[str], value: str = "value", name: str = "tpm_log") -> DataFrame:
    """log2(1 + TPM) per unit with gene lengths in bases; a missing or non-positive length gives 0."""
    j = df.join(lengths.select("gene", "length"), "gene", "left")
    j = j.withColumn("_rpk", F.when(F.col("length") > 0, F.col(value) / (F.col("length") / 1000.0)).otherwise(F.lit(0.0)))
    total = j.groupBy(*unit).agg(F.sum("_rpk").alias("_t"))
    tpm = F.when(F.col("_t") > 0, F.col("_rpk") / (F.col("_t") / 1e6)).otherwise(F.lit(0.0))
    return j.join(total, list(unit)).withColumn(name, F.log1p(tpm) / F.log(F.lit(2.0))).drop("_rpk", "_t", "length")


def library_size(counts: DataFrame, cell: Sequence[str], value: str = "value") -> DataFrame:
    return counts.groupBy(*cell).agg(F.sum(value).alias("library"))


def log_normalize(counts: DataFrame, cell: Sequence[str], value: str = "value", scale: float = 1e4, name: str = "norm", keep: bool = False) -> DataFrame:
    """log(1 + x / library * scale); an empty library counts as 1. ``keep`` leaves the library's size in a column."""
    lib = library_size(counts, cell, value)
    size = F.when(F.col("library") == 0, F.lit(1.0)).otherwise(F.col("library"))
    return counts.join(lib, list(cell)).withColumn(name, F.log1p(F.col(value) / size * scale)).drop(*() if keep else ("library",))


def collapse_genes(df: DataFrame, sample: Sequence[str], value: str = "value") -> DataFrame:
    """Upper-case symbols, duplicates averaged, genes that are null or zero everywhere dropped."""
    up = df.withColumn("gene", F.upper("gene"))
    alive = up.groupBy("gene").agg(F.max(F.abs(value)).alias("_m")).where("_m > 0").drop("_m")
    return up.join(alive, "gene", "left_semi").groupBy(*sample, "gene").agg(F.avg(value).alias(value))


def informative_features(df: DataFrame, feature: str, value: str, least: int = 5) -> DataFrame:
    """Rows of features with a positive standard deviation and at least ``least`` finite values."""
    finite = F.when(~F.isnan(F.col(value)), F.col(value))
    ok = df.groupBy(feature).agg(F.stddev_samp(finite).alias("_s"), F.count(finite).alias("_n"))
    return df.join(ok.where((F.col("_s") > 0) & (F.col("_n") >= least)).select(feature), feature, "left_semi")


def variable_genes(df: DataFrame, n: int, gene: str = "gene", value: str = "value") -> DataFrame:
    """The n genes of the largest variance."""
    return df.groupBy(gene).agg(F.var_samp(value).alias("variance")).orderBy(F.desc("variance"), gene).limit(n)


MAX_FEATURES = 4096


def _feature_moments(df: DataFrame, features: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and standard deviations (n - 1; 0 becomes 1) of each feature, in one aggregate."""
    f = [F.col(features)[i].cast("double") for i in range(width)]
    row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in f], *[F.stddev_samp(c) for c in f]).first()
    spread = np.array([s if s else 1.0 for s in row[1 + width :]], float)
    return row[0], np.array([m or 0.0 for m in row[1 : 1 + width]], float), spread


def gram(df: DataFrame, features: str, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Products of the standardised features, summed over all rows: every task adds up its rows as one matrix product and
    sends one line per feature."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = (b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean) / spread
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    parts = df.select(F.col(features).cast("array<double>").alias("x")).mapInArrow(run, "i int, g array<double>")
    cells = parts.select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r")).toLocalIterator():  # one row per feature
        out[r["i"]] = [c["v"] for c in r["r"]]
    return (out + out.T) / 2


def principal_axes(df: DataFrame, features: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(variances, axes, mean, spread): the ``k`` largest variances of the standardised features with their axes (columns),
    each turned so that its largest entry is positive. Only rows with all features present count; at most 4096 features."""
    width = df.agg(F.max(F.size(features))).first()[0] or 0
    if width > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features: choose the variable ones first")
    whole = df.where((F.size(features) == width) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)))
    n, mean, spread = _feature_moments(whole, features, width)
    values, axes = np.linalg.eigh(gram(whole, features, mean, spread) / max(n - 1, 1))
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order]
    turn = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values[order], axes * np.where(turn == 0, 1, turn), mean, spread


def pca(df: DataFrame, features: str, k: int) -> DataFrame:
    """``df`` with ``components``: the first ``k`` principal components of the standardised feature arrays; null where a
    feature is missing. Rows are read three times (moments, products, scores) and never shuffled."""
    _, axes, mean, spread = principal_axes(df, features, k)
    width = len(mean)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            ok = [v is not None and len(v) == width and not any(x is None or x != x for x in v) for v in batch]
            out = np.empty(len(batch), object)
            if any(ok):
                x = (np.array([v for v, o in zip(batch, ok, strict=True) if o], float) - mean) / spread
                out[np.flatnonzero(ok)] = list(x @ axes)
            yield pd.Series(out)

    return df.withColumn("components", scores(F.col(features).cast("array<double>")))


def reconstructed_correlation(df: DataFrame, features: str, k: int) -> DataFrame:
    """(i, j, value): the correlation matrix as the sum of the first ``k`` axes times their variances. With all axes it is
    the correlation matrix itself; with fewer, what is lacking is what these components leave unexplained."""
    values, axes, _, _ = principal_axes(df, features, k)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate((axes * values) @ axes.T)]
    table = df.sparkSession.createDataFrame(rows, "i int, r array<double>")
    return table.select("i", F.posexplode("r").alias("j", "value"))


# ---------------------------------------------------------------- profiles


def pseudobulk(df: DataFrame, keys: Sequence[str], value: str = "value", min_rows: int = 1) -> DataFrame:
    """Mean value per keys, keys with at least ``min_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value)).where(F.col("n") >= min_rows)


def prototype_expression(df: DataFrame, min_cells: int = 1) -> DataFrame:
    """(prototype, gene): mean over samples of the sample means, prototypes with enough cells."""
    per = df.groupBy("sample_name", "prototype_id", "gene").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("c"))
    return per.groupBy("prototype_id", "gene").agg(F.avg("v").alias("value"), F.sum("c").alias("n")).where(F.col("n") >= min_cells)


def winsorise(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    q = quantiles(df, keys, value, [low, high], "_q")
    return df.join(q, list(keys)).withColumn(value, F.greatest(F.least(F.col(value), F.col("_q")[1]), F.col("_q")[0])).drop("_q")


def robust_profile(df: DataFrame, keys: Sequence[str], value: str = "value", how: str = "median", winsor: tuple | None = (0.05, 0.95)) -> DataFrame:
    """Median or mean of the winsorised values per keys; a missing value counts as the upper quantile, see below."""
    keys = list(keys)
    if how == "mean":
        w = winsorise(df, keys, value, *winsor) if winsor else df
        return w.groupBy(*keys).agg(F.avg(value).alias(value))
    if how != "median":
        raise ValueError(f"unknown aggregate {how!r}")
    if not winsor:
        return quantiles(df, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias(value))
    return winsorised_median(cut_lineage(with_ranges(df.select(*keys, value), value)), keys, value, *winsor)


def winsorised_median(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Median per keys after values beyond the two quantiles are moved to them; ``df`` comes from ``with_ranges``, written.

    Moving values keeps their order, so that the median lies between the same two order statistics, moved. Null and NaN are
    not counted in the quantiles; ``least`` turns them into the upper one, here as in the SQL, and rows that hold any are
    written again with the moved values.
    """
    keys = list(keys)
    odd = df.where(F.col(value).isNull() | F.isnan(value))
    if odd.isEmpty():
        s, n = order_statistics(df, keys, value, [low, 0.5, high]), F.col("_n")
        move = lambda c: F.greatest(F.least(F.col(c), F.col("_hi")), F.col("_lo"))
        s = s.withColumns({"_lo": between(F.col("_l0"), F.col("_h0"), low, n), "_hi": between(F.col("_l2"), F.col("_h2"), high, n)})
        return s.select(*keys, between(move("_l1"), move("_h1"), 0.5, n).alias(value))
    w = winsorise(df.drop("_range"), keys, value, low, high)
    return quantiles(w, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias(value))


SUMMARIES = {"mean": F.avg, "std": F.stddev_pop, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}


def summarise(df: DataFrame, keys: Sequence[str], value: str, how: Sequence[str]) -> DataFrame:
    """Several named summaries of one column; the median goes through exact distributed quantiles."""
    plain = [SUMMARIES[h](value).alias(h) for h in how if h != "median"]
    out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    if "median" in how:
        med = quantiles(df, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias("median"))
        out = out.join(med, list(keys))
    return out.select(*keys, *how)


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """Running average's end value: sum(value * n) / sum(n)."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("average"))


# ---------------------------------------------------------------- differential expression


def layer_profiles(
    tagged: DataFrame, expr: DataFrame, unit: Sequence[str], min_cells: int, how: str = "median",
    winsor: tuple | None = (0.05, 0.95), subsample: int = 0, seed: int = 1337,
) -> DataFrame:
    """(pair, sample, gene, a, b): interface and core profiles of the samples with enough cells in both layers.

    ``tagged`` has one row per cell and pair with its layer. Expression is computed once and shared by all pairs. With
    ``subsample``, both layers of a (pair, sample) are cut to the same number of cells, at most that many, before any
    expression is read.
    """
    from tilewright.operators.sampling import equal_subsample

    size = tagged.groupBy("pair", "sample_name").agg(
        F.count_if(F.col("layer") == "interface").alias("ni"), F.count_if(F.col("layer") == "core").alias("nc")
    )
    ok = size.where((F.col("ni") >= min_cells) & (F.col("nc") >= min_cells)).select("pair", "sample_name")
    kept = tagged.join(ok, ["pair", "sample_name"], "left_semi")
    if subsample:
        kept = equal_subsample(cut_lineage(kept), ["pair", "sample_name"], "layer", subsample, ["pair", "node_idx"], seed, least=1)
    by = ["pair", "sample_name", "layer", "gene"]
    if how == "median" and winsor:
        # ranges are found once per expression value, not for every pair that reads it
        rows = kept.join(with_ranges(expr, "value"), list(unit)).select(*by, "value", "_range")
        p = winsorised_median(cut_lineage(rows), by, "value", *winsor)
    else:
        p = robust_profile(cut_lineage(kept.join(expr, list(unit)).select(*by, "value")), by, "value", how, winsor)
    on = lambda layer: F.max(F.when(F.col("layer") == layer, F.col("value")))
    wide = p.groupBy("pair", "sample_name", "gene").agg(on("interface").alias("a"), on("core").alias("b"))
    return wide.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def paired_expression(
    profiles: DataFrame, keys: Sequence[str] = ("pair",), test: str = "wilcoxon", eps: float = 1e-6, min_samples: int = 2,
    adjust: bool = True,
) -> DataFrame:
    """(keys, gene): means, log2 fold change, paired p and, with ``adjust``, q within each key over the whole family of genes."""
    from tilewright.operators.ordered import fdr
    from tilewright.operators.stats import PAIRED_TESTS

    keys = list(keys)
    by = [*keys, "gene"]
    profiles = cut_lineage(profiles)
    m = profiles.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    m = m.where(F.col("n") >= min_samples).withColumn("log2fc", F.log2(F.col("mean_a") + eps) - F.log2(F.col("mean_b") + eps))
    p = PAIRED_TESTS[test](profiles, by, "a", "b").drop("pairs")
    return fdr(m.join(p, by), keys) if adjust else m.join(p, by)


def pair_name(i: int, j: int) -> str:
    return f"P{i}_P{j}"


def tag_layers(
    cells: DataFrame, mix: str, pairs: Sequence[tuple[int, int]], core: float, interface: float, delta: float | None = None,
    quantile: float | None = None, balanced: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """One row per cell, pair and layer (interface / core) from the neighbour shares.

    The pairs are rows: the plan has one branch however many there are. ``delta`` keeps only balanced interface cells;
    ``quantile`` raises the interface level to that quantile within the pair and sample. Both hold for the ``balanced``
    pairs, all of them by default.
    """
    from tilewright.functions import predicates as P

    strict = {tuple(sorted(p)) for p in (pairs if balanced is None else balanced)}
    table = F.array(
        *[
            F.struct(
                F.lit(pair_name(i, j)).alias("pair"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                F.lit(tuple(sorted((i, j))) in strict).alias("strict"),
            )
            for i, j in pairs
        ]
    )
    x = cells.select("sample_name", "node_idx", F.col(mix).alias("_m"), F.explode(table).alias("z"))
    m, i, j = F.col("_m"), F.col("z.i"), F.col("z.j")
    x = x.select(
        "sample_name",
        "node_idx",
        "z.pair",
        "z.strict",
        P.interface_strength(m, i, j).alias("s"),
        P.is_pair_core(m, i, j, core, interface).alias("core"),
        (P.is_balanced(m, i, j, delta) if delta is not None else F.lit(True)).alias("ok"),
    )
    at = F.lit(float(interface))
    if quantile is not None:
        x = cut_lineage(x)
        q = quantiles(x.where("strict"), ["pair", "sample_name"], "s", [quantile], "_q")
        x = x.join(q, ["pair", "sample_name"], "left")
        at = F.greatest(at, F.when(F.col("strict"), F.col("_q")[0]))
    layers = F.array_compact(
        F.array(
            F.when((F.col("s") >= at) & (F.col("ok") | ~F.col("strict")), F.lit("interface")),
            F.when(F.col("core"), F.lit("core")),
        )
    )
    return cut_lineage(x.select("pair", "sample_name", "node_idx", F.explode(layers).alias("layer")))


@dataclass(frozen=True)
class Contrast:
    """Thresholds of one interface-against-core run."""

    core: float = 0.8
    interface: float = 0.45
    min_cells: int = 60
    p_max: float = 0.05
    min_lfc: float = 0.1


def interface_expression(
    cells: DataFrame, mix: str, expr: DataFrame, pairs: Sequence[tuple[int, int]], strict: Contrast, relaxed: Contrast | None = None,
    unit: Sequence[str] = ("sample_name", "node_idx"), delta: float | None = None, quantile: float | None = None,
    balanced: Sequence[tuple[int, int]] | None = None, subsample: int = 0, test: str = "wilcoxon", how: str = "median",
    winsor: tuple | None = (0.05, 0.95), eps: float = 1e-9, min_samples: int = 3, seed: int = 1337,
) -> DataFrame:
    """(pair, gene, n, mean_a, mean_b, log2fc, p, q, fallback): genes that differ between the interface and the cores of
    every pair of prototypes, paired by sample.

    Genes with p up to ``p_max`` and a fold change of at least ``min_lfc`` stay, and q covers those of a pair. A pair without
    any under the ``strict`` thresholds is run again under the ``relaxed`` ones, and only such pairs are. The driver sees
    the names of the pairs with a result.
    """
    from tilewright.operators.ordered import fdr

    def run(some: Sequence[tuple[int, int]], at: Contrast) -> DataFrame:
        tagged = tag_layers(cells, mix, some, at.core, at.interface, delta, quantile, balanced)
        profiles = layer_profiles(tagged, expr, unit, at.min_cells, how, winsor, subsample, seed)
        d = paired_expression(profiles, ("pair",), test, eps, min_samples, adjust=False)
        return fdr(d.where((F.col("p") <= at.p_max) & (F.abs("log2fc") >= at.min_lfc)), ["pair"])

    first = cut_lineage(run(pairs, strict).withColumn("fallback", F.lit(False)))
    if relaxed is None:
        return first
    found = {r[0] for r in first.select("pair").distinct().collect()}
    rest = [p for p in pairs if pair_name(*p) not in found]
    return first.unionByName(run(rest, relaxed).withColumn("fallback", F.lit(True))) if rest else first


def layer_diagnostics(tagged: DataFrame, samples: DataFrame, pairs: Sequence[tuple[int, int]], min_cells: int) -> DataFrame:
    """(pair, sample): cell counts per layer and why the pair was skipped there, if it was."""
    names = F.array(*[F.lit(pair_name(i, j)) for i, j in pairs])
    base = samples.select("sample_name").distinct().withColumn("pair", F.explode(names))
    n = tagged.groupBy("pair", "sample_name").agg(
        F.count_if(F.col("layer") == "interface").alias("n_interface"), F.count_if(F.col("layer") == "core").alias("n_core")
    )
    d = base.join(n, ["pair", "sample_name"], "left").fillna(0, ["n_interface", "n_core"])
    reason = (
        F.when((F.col("n_interface") < min_cells) & (F.col("n_core") < min_cells), "few_both")
        .when(F.col("n_interface") < min_cells, "few_interface")
        .when(F.col("n_core") < min_cells, "few_core")
        .otherwise("used")
    )
    return d.withColumn("reason", reason)


def pair_totals(diagnostics: DataFrame) -> DataFrame:
    used = F.col("reason") == "used"
    return diagnostics.groupBy("pair").agg(
        F.count_if(used).alias("samples"),
        F.sum(F.when(used, F.col("n_interface")).otherwise(0)).alias("interface_cells"),
        F.sum(F.when(used, F.col("n_core")).otherwise(0)).alias("core_cells"),
    )


def with_fallback(strict: DataFrame, relaxed: DataFrame, tag: str = "fallback") -> DataFrame:
    """The strict result, or the relaxed one where the strict one is empty; the tag tells which."""
    none = ~strict.select(F.lit(1)).limit(1).exists()
    return strict.withColumn(tag, F.lit(False)).unionByName(relaxed.where(none).withColumn(tag, F.lit(True)), allowMissingColumns=True)


def welch_expression(df: DataFrame, keys: Sequence[str], flag: str, min_group: int, eps: float = 1e-6, family: Sequence[str] = ()) -> DataFrame:
    """Welch test of flagged against other rows per key with log2 fold change of the means and q."""
    from tilewright.operators.ordered import fdr
    from tilewright.operators.stats import welch

    w = welch(df, keys, "value", flag, min_group)
    return fdr(w.withColumn("log2fc", F.log2((F.col("mean1") + eps) / (F.col("mean0") + eps))), family)


def one_vs_rest(df: DataFrame, label: str, values: Sequence, name: str = "target") -> DataFrame:
    """Every row once per listed value with ``flag`` = whether it carries that value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]))).withColumn(
        "flag", (F.col(label) == F.col(name)).cast("int")
    )


def set_means(profiles: DataFrame, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, a, b): mean of both profiles over the genes of each set."""
    return profiles.join(sets.select("name", "gene").distinct(), "gene").groupBy(*keys, F.col("name").alias("gene")).agg(
        F.avg("a").alias("a"), F.avg("b").alias("b")
    )


def find_markers(
    cells: DataFrame, counts: DataFrame, keys: Sequence[str], label: str, targets: Sequence, min_pct: float = 0.1, min_lfc: float = 0.0
) -> DataFrame:
    """Marker genes of each target class against the rest, per keys, from sparse counts.

    ``cells(unit, keys, label)`` lists every cell, ``counts(unit, gene, value)`` only non-zero normalised values. Zeros
    are never written out: they enter the means through the group sizes and the rank test as one block of ties.
    """
    from tilewright.functions.tails import normal_p
    from tilewright.operators.ordered import running

    keys, targets = list(keys), list(targets)
    # every target sees the same cells and the same ranks, only the flags differ: they are columns until the sums are made
    flag = [(F.col(label) == F.lit(t)).cast("int") for t in targets]
    t = one_vs_rest(cells, label, targets)
    size = t.groupBy(*keys, "target").agg(F.sum("flag").alias("c1"), F.sum(1 - F.col("flag")).alias("c0"))
    rows = counts.select("unit", "gene", "value").join(cells.select("unit", *keys, label), "unit")
    by = [*keys, "gene"]
    on = lambda f, i: F.sum(F.when(flag[i] == f, F.expm1("value")).otherwise(0.0))
    each = range(len(targets))
    per_target = lambda **cols: F.array(
        *[F.struct(F.lit(targets[i]).alias("target"), *[make(i).alias(name) for name, make in cols.items()]) for i in each]
    )
    m = rows.groupBy(*by).agg(
        per_target(
            z1=lambda i: F.count_if(flag[i] == 1), z0=lambda i: F.count_if(flag[i] == 0), s1=lambda i: on(1, i), s0=lambda i: on(0, i)
        ).alias("_t")
    )
    m = m.select(*by, F.inline("_t")).join(size, [*keys, "target"])
    by_target = [*keys, "target", "gene"]
    m = m.select(
        *by_target,
        "c1",
        "c0",
        "z1",
        "z0",
        (F.col("z1") / F.col("c1")).alias("pct1"),
        (F.col("z0") / F.col("c0")).alias("pct2"),
        (F.log2(F.col("s1") / F.col("c1") + 1) - F.log2(F.col("s0") / F.col("c0") + 1)).alias("avg_log2fc"),
    ).where((F.greatest("pct1", "pct2") >= min_pct) & (F.abs("avg_log2fc") >= min_lfc))
    base = rows.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(flag[i]).alias(f"n1_{i}") for i in each]
    )
    own = {"n": ("own", "n"), **{f"n1_{i}": ("own", f"n1_{i}") for i in each}}
    ranks = running(base, by, "value", {"cum": ("sum", "n"), **own}, unique=True)
    rank = F.col("cum") - (F.col("n") - 1) / 2
    sums = ranks.groupBy(*by).agg(
        per_target(r=lambda i: F.sum(F.col(f"n1_{i}") * rank), f=lambda i: F.sum(f"n1_{i}")).alias("_t"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
    )
    # ranks above the block of zeros: shift by the number of zeros
    shift = F.col("c1") + F.col("c0") - F.col("z1") - F.col("z0")
    r = sums.select(*by, "ties", F.inline("_t")).join(m, by_target).withColumn("r1", F.col("r") + F.col("f") * shift)
    n1, n0 = F.col("c1"), F.col("c0")
    n = n1 + n0
    u = F.col("r1") + (n1 - F.col("z1")) * (shift + 1) / 2 - n1 * (n1 + 1) / 2
    ties = F.col("ties") + F.pow(shift, F.lit(3)) - shift
    var = n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))
    z = F.when(var > 0, F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(F.lit(0.0))
    return r.select(*by_target, "pct1", "pct2", "avg_log2fc", z.alias("z")).withColumn("p", normal_p("z"))
