"""Tests and effect sizes as grouped aggregates: one result row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tails import chi2_p, hypergeom_p, normal_p, signed_rank_p, t_p
from tilewright.operators.ordered import fdr, running, value_ranks
from tilewright.session import cut_lineage


def _flag(flag: str) -> Column:
    return F.col(flag).cast("int")


# ---------------------------------------------------------------- two groups


def welch(df: DataFrame, keys: Sequence[str], value: str, flag: str, min_group: int = 2) -> DataFrame:
    """Unequal-variance t-test of flag = 1 against flag = 0 per key; null values are left out."""
    one = lambda f, on: f(F.when(_flag(flag) == on, F.col(value)))
    m = df.groupBy(*keys).agg(
        *[
            one(f, on).alias(f"{name}{on}")
            for on in (1, 0)
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    ).where((F.col("n1") >= min_group) & (F.col("n0") >= min_group))
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    return m.select(
        *keys,
        "n1",
        "n0",
        "mean1",
        "mean0",
        F.when(a + b > 0, (F.col("mean1") - F.col("mean0")) / F.sqrt(a + b)).alias("t"),
        F.when(a + b > 0, F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("df"),
    ).withColumn("p", t_p("t", "df"))


def _rank_totals(df: DataFrame, keys: Sequence[str], value: str, flag: str) -> DataFrame:
    ranks = value_ranks(df.where(F.col(flag).isNotNull()), keys, value, {"n1": _flag(flag)})
    return ranks.groupBy(*keys).agg(
        F.max("n_all").alias("n"),
        F.max("n1_all").alias("n1"),
        F.sum(F.col("n1") * F.col("avg_rank")).alias("r1"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
    ).withColumn("n0", F.col("n") - F.col("n1"))


def mann_whitney(
    df: DataFrame, keys: Sequence[str], value: str, flag: str, min_group: int = 1, min_total: int = 2
) -> DataFrame:
    """Rank-sum test per key: U of the flagged group, AUC, z with tie and continuity correction, two-sided p."""
    return _rank_sum(_rank_totals(df, keys, value, flag), keys, min_group, min_total)


def _rank_sum(totals: DataFrame, keys: Sequence[str], min_group: int, min_total: int, also: Sequence[str] = ()) -> DataFrame:
    r = totals.where((F.col("n1") >= min_group) & (F.col("n0") >= min_group) & (F.col("n") >= min_total))
    n, n1, n0 = F.col("n"), F.col("n1"), F.col("n0")
    r = r.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    shift = F.abs(F.col("u") - n1 * n0 / 2)
    var = n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return r.select(
        *keys,
        "n1",
        "n0",
        "u",
        (F.col("u") / (n1 * n0)).alias("auc"),
        F.when(var > 0, F.greatest(shift - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(F.lit(0.0)).alias("z"),
        *also,
    ).withColumn("p", normal_p("z"))


def mann_whitney_by_cohort(
    df: DataFrame, metric: str, cohort: str, value: str, flag: str, min_group: int = 3, min_total: int = 6
) -> DataFrame:
    """Rank-sum test per metric over all rows ("ALL") and per cohort, with group means and one q over everything."""
    # equal values of a cohort collapse first; "ALL" is rolled up from what is left
    known = df.where(F.col(flag).isNotNull() & F.col(value).isNotNull())
    cells = known.groupBy(metric, F.col(cohort).cast("string").alias("scope"), value).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_flag(flag)).alias("n1")
    )
    keys = [metric, "scope"]
    both = cells.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit("ALL"), F.col("scope")))))
    both = both.where("scope is not null").groupBy(*keys, value).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    own = {"n": ("own", "n"), "n1": ("own", "n1")}
    run = running(both, keys, value, {"c": ("sum", "n"), "c1": ("sum", "n1"), **own}, unique=True)
    n, n1 = F.col("n"), F.col("n1")
    totals = run.groupBy(*keys).agg(
        F.max("c_all").alias("n"),
        F.max("c1_all").alias("n1"),
        F.sum(n1 * (F.col("c") - (n - 1) / 2)).alias("r1"),
        F.sum(F.pow(n, F.lit(3)) - n).alias("ties"),
        (F.sum(n1 * F.col(value)) / F.sum("n1")).alias("mean1"),
        (F.sum((n - n1) * F.col(value)) / F.sum(n - n1)).alias("mean0"),
    ).withColumn("n0", F.col("n") - F.col("n1"))
    return fdr(_rank_sum(totals, keys, min_group, min_total, ["mean1", "mean0"]), [])


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, flag: str) -> DataFrame:
    """Area under the ROC curve per key, null where only one class occurs."""
    r = _rank_totals(df, keys, score, flag)
    n1, n0 = F.col("n1"), F.col("n0")
    return r.select(
        *keys, "n1", "n0", F.when((n1 > 0) & (n0 > 0), (F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc")
    )


def _thresholds(df: DataFrame, keys: Sequence[str], score: str, flag: str) -> DataFrame:
    """Per distinct score, from the top: true and false positives so far and the class totals."""
    cells = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(_flag(flag)).alias("n1"), F.sum(1 - _flag(flag)).alias("n0")
    )
    own = {"n1": ("own", "n1"), "n0": ("own", "n0")}
    return running(cells, keys, score, {"tp": ("sum", "n1"), "fp": ("sum", "n0"), **own}, ascending=False, unique=True)


def roc_curve(df: DataFrame, keys: Sequence[str], score: str, flag: str) -> DataFrame:
    """ROC and precision-recall points at every distinct score."""
    t = _thresholds(df, keys, score, flag)
    return t.select(
        *keys,
        score,
        (F.col("tp") / F.col("tp_all")).alias("tpr"),
        (F.col("fp") / F.col("fp_all")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def average_precision(df: DataFrame, keys: Sequence[str], score: str, flag: str) -> DataFrame:
    """Sum of recall steps times precision, tied scores in one step."""
    t = _thresholds(df, keys, score, flag)
    return t.groupBy(*keys).agg(
        F.sum(F.col("n1") / F.col("tp_all") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision")
    )


def _middle(score: str, running_count: str, own: str) -> Column:
    """Median of a class within an aggregate over its running counts by score."""
    last = F.col(running_count) - 1
    first = last - F.col(own) + 1
    top = F.col(f"{running_count}_all") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(score).cast("double")))

    return (at(F.floor(top / 2)) + at(F.ceil(top / 2))) / 2


def auc_interval(df: DataFrame, keys: Sequence[str], score: str, flag: str, auto: bool = True) -> DataFrame:
    """AUC with DeLong variance, 95 % interval and p against 0.5; ``auto`` orients it by the group medians."""
    cells = df.where(F.col(score).isNotNull() & F.col(flag).isNotNull()).groupBy(*keys, score).agg(
        F.sum(_flag(flag)).alias("n1"), F.sum(1 - _flag(flag)).alias("n0")
    )
    own = {"n1": ("own", "n1"), "n0": ("own", "n0")}
    run = running(cells, keys, score, {"c1": ("sum", "n1"), "c0": ("sum", "n0"), **own}, unique=True)
    j = run.where("c1_all > 0 and c0_all > 0")
    case = (F.col("c0") - F.col("n0") / 2) / F.col("c0_all")
    control = (F.col("c1_all") - F.col("c1") + F.col("n1") / 2) / F.col("c1_all")
    s = j.groupBy(*keys).agg(
        F.max("c1_all").alias("n1"),
        F.max("c0_all").alias("n0"),
        (F.sum(F.col("n1") * case) / F.max("c1_all")).alias("auc"),
        F.sum(F.col("n1") * case * case).alias("q1"),
        F.sum(F.col("n0") * control * control).alias("q0"),
        (_middle(score, "c1", "n1")).alias("m1"),
        (_middle(score, "c0", "n0")).alias("m0"),
    )
    n1, n0, auc = F.col("n1"), F.col("n0"), F.col("auc")
    var = (F.col("q1") - n1 * auc * auc) / (n1 - 1) / n1 + (F.col("q0") - n0 * auc * auc) / (n0 - 1) / n0
    s = s.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0))))
    down = F.col("m1") < F.col("m0") if auto else F.lit(False)
    s = s.withColumn("direction", F.when(down, ">").otherwise("<")).withColumn("auc", F.when(down, 1 - auc).otherwise(auc))
    half = 1.959963984540054 * F.col("se")
    return s.select(
        *keys,
        "n1",
        "n0",
        "auc",
        F.greatest(F.col("auc") - half, F.lit(0.0)).alias("auc_low"),
        F.least(F.col("auc") + half, F.lit(1.0)).alias("auc_high"),
        "direction",
        F.when(F.col("se") > 0, (F.col("auc") - 0.5) / F.col("se")).alias("z"),
    ).withColumn("p", normal_p("z"))


def association(df: DataFrame, keys: Sequence[str], score: str, flag: str) -> DataFrame:
    """Per key: Spearman correlation with the label, oriented AUC with interval, rank-biserial, p and q."""
    auc = auc_interval(df, keys, score, flag)
    rho = spearman(df.withColumn("_y", _flag(flag).cast("double")), keys, score, "_y")
    out = auc.join(rho.select(*keys, "rho"), list(keys)).withColumn("rank_biserial", 2 * F.col("auc") - 1)
    return fdr(out, [])


# ---------------------------------------------------------------- paired


def paired_t(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """t-test and normal test on the differences a - b per key."""
    d = F.col(a) - F.col(b)
    m = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return (
        m.where("n >= 2")
        .withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))))
        .withColumns({"p_t": t_p("t", F.col("n") - 1.0), "p_z": normal_p("t")})
    )


def signed_rank(df: DataFrame, keys: Sequence[str], a: str, b: str, method: str = "auto", most_exact: int = 25) -> DataFrame:
    """Paired two-sided signed-rank test of a - b per key, zero differences dropped.

    ``method``: "normal" takes the tie-corrected normal tail, "exact" the exact one wherever there are neither ties nor
    zeros, "auto" (the usual convention) the exact one in those cases up to ``most_exact`` pairs.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("_d")).where(F.col("_d").isNotNull())
    zeros = d.groupBy(*keys).agg(F.sum((F.col("_d") == 0).cast("int")).alias("zeros"), F.count(F.lit(1)).alias("pairs"))
    moved = d.where("_d <> 0").withColumn("_abs", F.abs("_d")).withColumn("_up", (F.col("_d") > 0).cast("int"))
    r = value_ranks(moved, keys, "_abs", {"up": F.col("_up")})
    w = r.groupBy(*keys).agg(
        F.max("n_all").alias("n"),
        F.sum(F.col("up") * F.col("avg_rank")).alias("w_plus"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
    )
    out = zeros.join(w, list(keys), "left")
    clean = (F.col("ties") == 0) & (F.col("zeros") == 0) & F.lit(method != "normal")
    if method == "auto":
        clean = clean & (F.col("n") <= most_exact)
    return out.select(
        *keys,
        "pairs",
        F.coalesce("n", F.lit(0)).alias("n"),
        "w_plus",
        F.coalesce("ties", F.lit(0.0)).alias("ties"),
        F.coalesce(clean, F.lit(False)).alias("clean"),
    ).withColumn("p", signed_rank_p("w_plus", "n", "ties", "clean")).drop("ties", "clean")


def _wilcoxon(df, keys, a, b):
    return signed_rank(df, keys, a, b).select(*keys, "pairs", "p")


def _ttest(df, keys, a, b):
    return paired_t(df, keys, a, b).select(*keys, F.col("n").alias("pairs"), F.col("p_t").alias("p"))


def _ztest(df, keys, a, b):
    return paired_t(df, keys, a, b).select(*keys, F.col("n").alias("pairs"), F.col("p_z").alias("p"))


PAIRED_TESTS = {"wilcoxon": _wilcoxon, "ttest": _ttest, "z": _ztest}


# ---------------------------------------------------------------- several groups


def _class_ranks(df: DataFrame, keys: Sequence[str], value: str, label: str, min_group: int) -> DataFrame:
    """Per (keys, class): size and rank sum, with the key's total and tie term."""
    sized = df.where(F.col(value).isNotNull())
    big = sized.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_group).drop("_n")
    kept = sized.join(big, [*keys, label], "left_semi")
    cells = kept.groupBy(*keys, value, label).agg(F.count(F.lit(1)).alias("c"))
    ranks = value_ranks(kept, keys, value)
    per_class = cells.join(ranks, [*keys, value]).groupBy(*keys, label).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("rank_sum")
    )
    totals = ranks.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")
    )
    return per_class.join(totals, list(keys))


def kruskal(df: DataFrame, keys: Sequence[str], value: str, label: str, min_group: int = 1) -> DataFrame:
    """Kruskal-Wallis H with tie correction over the classes of each key that are large enough."""
    r = _class_ranks(df, keys, value, label, min_group)
    n = F.max("total")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    out = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"),
        n.alias("n"),
        (h / (1 - F.max("ties") / (F.pow(n, F.lit(3)) - n))).alias("h"),
    )
    return out.where("classes >= 2").withColumn("p", chi2_p("h", F.col("classes") - 1.0))


def dunn(df: DataFrame, keys: Sequence[str], value: str, label: str, min_group: int = 1) -> DataFrame:
    """Pairwise comparison of class mean ranks per key, q within the key. Classes pair up, not rows."""
    r = cut_lineage(_class_ranks(df, keys, value, label, min_group).withColumn("mean_rank", F.col("rank_sum") / F.col("n")))
    a = r.select(*keys, F.col(label).alias("a"), F.col("n").alias("na"), F.col("mean_rank").alias("ra"), "total", "ties")
    b = r.select(*keys, F.col(label).alias("b"), F.col("n").alias("nb"), F.col("mean_rank").alias("rb"))
    n = F.col("total")
    var = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    pairs = a.join(b, list(keys)).where("a < b").select(*keys, "a", "b", ((F.col("ra") - F.col("rb")) / F.sqrt(var)).alias("z"))
    return fdr(pairs.withColumn("p", normal_p("z")), keys)


# ---------------------------------------------------------------- correlation


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key over complete cases, from average-tie ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    rank = lambda c, name: value_ranks(both, keys, c).select(*keys, c, F.col("avg_rank").alias(name))
    ranked = both.join(rank(x, "_rx"), [*keys, x]).join(rank(y, "_ry"), [*keys, y])
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def pearson_per_gene(df: DataFrame, gene: str, pred: str, truth: str, min_sd: float = 1e-6) -> DataFrame:
    """Correlation of prediction and truth per gene; genes that hardly vary on either side are left out."""
    s = df.groupBy(gene).agg(
        F.corr(pred, truth).alias("r"), F.stddev_pop(pred).alias("_sp"), F.stddev_pop(truth).alias("_st")
    )
    return s.where((F.col("_sp") >= min_sd) & (F.col("_st") >= min_sd)).select(gene, "r")


# ---------------------------------------------------------------- enrichment and agreement


def over_representation(hits: DataFrame, sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Upper hypergeometric tail per gene set: ``hits(gene)`` drawn from ``universe(gene)``, ``sets(name, gene)``."""
    genes = universe.select("gene").distinct()
    drawn = hits.select("gene").distinct().join(genes, "gene", "left_semi").withColumn("hit", F.lit(1))
    members = sets.select("name", "gene").distinct().join(genes, "gene", "left_semi").join(drawn, "gene", "left")
    per = members.groupBy("name").agg(F.count(F.lit(1)).alias("set_size"), F.count("hit").alias("overlap"))
    out = per.withColumns(
        {
            "drawn": drawn.agg(F.count(F.lit(1))).scalar(),
            "universe": genes.agg(F.count(F.lit(1))).scalar(),
        }
    )
    return fdr(out.withColumn("p", hypergeom_p("overlap", "drawn", "set_size", "universe")), [])


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, balanced accuracy, kappa, quadratic kappa and weighted F1 from the confusion counts.

    Only per-class and whole-table sums of the counts are needed, so the classes are never paired up:
    with weights (t - p)^2 the expected disagreement follows from the first two moments of both margins.
    """
    c = confusion(df, truth, pred)
    rows = c.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("np"))
    per = rows.join(cols, "k", "full_outer").fillna(0, ["nt", "np", "tp"])
    total = F.sum("nt")
    k = F.col("k").cast("double")
    f1 = F.when(F.col("nt") + F.col("np") > 0, 2 * F.col("tp") / (F.col("nt") + F.col("np"))).otherwise(F.lit(0.0))
    s = per.agg(
        total.alias("n"),
        F.sum("tp").alias("hit"),
        F.avg(F.when(F.col("nt") > 0, F.col("tp") / F.col("nt"))).alias("balanced_accuracy"),
        (F.sum(F.col("nt") * f1) / total).alias("weighted_f1"),
        F.sum(F.col("nt") * F.col("np")).alias("chance"),
        F.sum(F.col("nt") * k * k).alias("tt"),
        F.sum(F.col("np") * k * k).alias("pp"),
        F.sum(F.col("nt") * k).alias("st"),
        F.sum(F.col("np") * k).alias("sp"),
    )
    square = c.agg(F.sum(F.col("n") * F.pow(F.col("t").cast("double") - F.col("p").cast("double"), 2))).scalar()
    n, acc, pe = F.col("n"), F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    expected = (F.col("tt") + F.col("pp")) / n - 2 * F.col("st") * F.col("sp") / (n * n)
    return s.select(
        acc.alias("accuracy"),
        "balanced_accuracy",
        ((acc - pe) / (1 - pe)).alias("kappa"),
        (1 - square / n / expected).alias("quadratic_kappa"),
        "weighted_f1",
    )


def one_vs_one_auc(df: DataFrame, truth: str, scores: str, classes: Sequence[int]) -> DataFrame:
    """Macro mean over class pairs of the two one-sided AUCs. ``classes`` is the fixed label list of the task."""
    listed = [(a, b) for a in classes for b in classes if a != b]
    duels = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in listed])
    mine = F.filter(duels, lambda d: (d["a"] == F.col(truth)) | (d["b"] == F.col(truth)))
    long = df.select(truth, scores, F.explode(mine).alias("d")).select(
        F.col("d.a").alias("a"),
        F.col("d.b").alias("b"),
        F.get(F.col(scores), F.col("d.a")).alias("s"),
        (F.col(truth) == F.col("d.a")).cast("int").alias("y"),
    )
    return roc_auc(long, ["a", "b"], "s", "y").agg(F.avg("auc").alias("macro_ovo_auc"))


def threshold_accuracy(df: DataFrame, prob: str, label: str, cut: float = 0.5) -> DataFrame:
    """Accuracy of prob > cut, and the AUC (0 on a single class)."""
    acc = df.agg(F.avg(((F.col(prob) > cut).cast("int") == F.col(label)).cast("double")).alias("accuracy"))
    return acc.withColumn("auc", F.coalesce(roc_auc(df, [], prob, label).select("auc").scalar(), F.lit(0.0)))
