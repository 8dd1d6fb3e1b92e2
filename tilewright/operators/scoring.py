"""Signature discovery, marker banks, set scores, prototype calls and score-weight search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scores import LIGAND_RECEPTOR
from tilewright.operators.ordered import group_minmax, quantiles, top_n
from tilewright.operators.prototypes import gathered
from tilewright.session import cut_lineage, forget, spread

# ---------------------------------------------------------------- discovery and banks


def discover(sig: DataFrame, by_p: bool = True, p_max: float = 0.05, min_lfc: float = 0.25) -> DataFrame:
    """Signature rows that pass: p at most ``p_max``, or a large enough fold change; with a gene and a direction.

    ``sig(prototype, other, contrast, gene, log2fc, p)`` with contrast core_vs_edge, pcr, pair_core or pair_edge.
    """
    keep = F.col("p") <= p_max if by_p else F.abs("log2fc") >= min_lfc
    up = F.col("log2fc") > 0
    kind = F.col("contrast")
    layer = F.regexp_extract("contrast", "^pair_(.*)$", 1)
    side = F.when(up, F.col("prototype")).otherwise(F.col("other"))
    label = (
        F.when(kind == "core_vs_edge", F.when(up, "Up_in_core").otherwise("Up_in_edge"))
        .when(kind == "pcr", F.when(up, "Up_in_pCR").otherwise("Up_in_non_pCR"))
        .otherwise(F.concat(F.lit("Up_in_P"), side.cast("string"), F.lit("_"), layer))
    )
    return sig.where(keep & (F.col("gene") != "") & (F.col("log2fc") != 0)).withColumn("direction", label)


def marker_bank(found: DataFrame) -> DataFrame:
    """Long bank (prototype, tag, gene) from discovered signatures."""
    g = found.withColumn("gene", F.upper("gene"))
    kind, way = F.col("contrast"), F.col("direction")
    named = g.where(kind.startswith("pair_")).select(
        F.regexp_extract("direction", r"^Up_in_P(\d+)_", 1).cast("int").alias("prototype"), "gene"
    )
    up = named.distinct().withColumn("tag", F.lit("identity_up"))
    # what is up in some other prototype and not in this one; prototypes are few, genes stay distributed
    ids = gathered(up.select("prototype").distinct().withColumn("_x", F.lit(1)), "prototype")
    other = up.withColumn("_ids", ids).select("gene", F.col("prototype").alias("_own"), F.explode("_ids.prototype").alias("prototype"))
    down = (
        other.where("prototype <> _own").select("prototype", "gene").distinct()
        .join(up.select("prototype", "gene"), ["prototype", "gene"], "left_anti")
        .withColumn("tag", F.lit("identity_down"))
    )
    tags = {"Up_in_core": "core", "Up_in_edge": "edge", "Up_in_pCR": "pcr_up", "Up_in_non_pCR": "pcr_down"}
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    rest = g.where(~kind.startswith("pair_")).select("prototype", "gene", F.try_element_at(table, way).alias("tag")).distinct()
    return up.unionByName(down).unionByName(rest).select("prototype", "tag", "gene")


def high_low_lists(sig: DataFrame, keys: Sequence[str], n: int = 25) -> DataFrame:
    """Top n positive and top n negative genes per keys."""
    high = top_n(sig.where("log2fc > 0"), keys, [F.desc("log2fc"), F.col("gene")], n).withColumn("side", F.lit("high"))
    low = top_n(sig.where("log2fc < 0"), keys, [F.asc("log2fc"), F.col("gene")], n).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def refine_weights(markers: DataFrame, seeds: DataFrame, prior: DataFrame, signal: DataFrame, n: int = 120) -> DataFrame:
    """(tag, prototype, gene, weight): per cell type the top markers, scaled to [0, 1], times the prior of the type's macro
    class and, for core and edge, the positive correlation with the seed signal; summed over types.

    ``markers(cell_type, macro, prototype, gene, avg_log2fc)``, ``signal(cell_type, prototype, tag, gene, r)``.
    """
    tags = F.array(*[F.lit(t) for t in ("identity_up", "identity_down", "core", "edge")])
    m = markers.withColumn("tag", F.explode(tags))
    down = F.col("tag") == "identity_down"
    m = m.where(F.when(down, F.col("avg_log2fc") < 0).otherwise(F.col("avg_log2fc") > 0)).withColumn("score", F.abs("avg_log2fc"))
    keys = ["cell_type", "macro", "prototype", "tag"]
    top = top_n(m, keys, [F.desc("score"), F.col("gene")], n)
    w = group_minmax(top, keys, "score", "w", 1.0)
    w = w.join(prior, ["prototype", "macro"], "left").join(signal, ["cell_type", "prototype", "tag", "gene"], "left")
    has = seeds.groupBy("prototype", "tag").agg((F.count(F.lit(1)) >= 3).alias("seeded"))
    w = w.join(has, ["prototype", "tag"], "left")
    fit = F.when(F.col("tag").isin("core", "edge") & F.coalesce("seeded", F.lit(False)), F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(0.0)))
    weight = F.col("w") * F.coalesce("frac", F.lit(1.0)) * F.coalesce(fit, F.lit(1.0))
    return (
        w.withColumn("weight", weight).where("weight > 0")
        .groupBy("prototype", "tag", "gene").agg(F.sum("weight").alias("weight"))
    )


def fuse_markers(
    seed: DataFrame, bank: DataFrame, weights: DataFrame, bonus: float = 0.6, malus: float = 0.5, cross: float = 0.3,
    top: int = 200, least: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """Three marker sources as one bank and one weight table.

    Seeds join the bank; identity genes without a weight get 0.6 of the median weight; response genes raise or lower
    the weight while ranking, genes rare over all sets rank higher, the best ``top`` stay; core and edge sets are
    filled up to ``least`` genes from the identity genes in gene order.
    """
    both = bank.select("prototype", "tag", "gene").unionByName(seed.select("prototype", "tag", "gene"))
    both = both.withColumn("gene", F.upper("gene")).distinct()
    w = weights.withColumn("gene", F.upper("gene"))
    mid = quantiles(w, [], "weight", [0.5]).scalar()
    up = both.where("tag = 'identity_up'")
    missing = up.join(w, ["prototype", "tag", "gene"], "left_anti").withColumn("_m", mid)
    w = w.unionByName(missing.select("prototype", "tag", "gene", (F.coalesce(F.col("_m")[0], F.lit(1.0)) * 0.6).alias("weight")))
    rarity = w.groupBy("gene").agg((1 / F.count(F.lit(1))).alias("rarity"))
    mark = lambda t, name: both.where(F.col("tag") == t).select("prototype", "gene", F.lit(1).alias(name))
    n_up = both.where("tag = 'pcr_up'").groupBy("gene").agg(F.count_distinct("prototype").alias("n_up"))
    ranked = (
        w.where("tag = 'identity_up'")
        .join(mark("pcr_up", "u"), ["prototype", "gene"], "left")
        .join(mark("pcr_down", "d"), ["prototype", "gene"], "left")
        .join(n_up, "gene", "left")
        .join(rarity, "gene")
    )
    elsewhere = F.coalesce("n_up", F.lit(0)) - F.coalesce("u", F.lit(0)) > 0
    score = (
        F.col("weight")
        * F.when(F.col("u") == 1, 1 + bonus).otherwise(1.0)
        * F.when(F.col("d") == 1, max(0.0, 1 - malus)).otherwise(1.0)
        * F.when(elsewhere, max(0.0, 1 - cross)).otherwise(1.0)
        * F.col("rarity")
    )
    best = top_n(ranked.withColumn("score", score), ["prototype"], [F.desc("score"), F.col("gene")], top)
    kept = best.select("prototype", F.lit("identity_up").alias("tag"), "gene", "weight")
    weights_out = kept.unionByName(w.where("tag <> 'identity_up'").select("prototype", "tag", "gene", "weight"))
    identity = kept.select("prototype", "gene")
    ids = gathered(identity.select("prototype").distinct().withColumn("_x", F.lit(1)), "prototype")
    down = (
        identity.withColumn("_ids", ids).select("gene", F.col("prototype").alias("_own"), F.explode("_ids.prototype").alias("prototype"))
        .where("prototype <> _own").select("prototype", "gene").distinct()
        .join(identity, ["prototype", "gene"], "left_anti")
    )

    def filled(tag: str, avoid: DataFrame | None) -> DataFrame:
        own = both.where(F.col("tag") == tag).select("prototype", "gene")
        add = identity.join(own, ["prototype", "gene"], "left_anti")
        if avoid is not None:
            add = add.join(avoid, ["prototype", "gene"], "left_anti")
        have = own.groupBy("prototype").agg(F.count(F.lit(1)).alias("_h"))
        add = top_n(add, ["prototype"], [F.col("gene")], least, "_r").join(have, "prototype", "left")
        return own.unionByName(add.where(F.col("_r") <= least - F.coalesce("_h", F.lit(0))).select("prototype", "gene"))

    core = filled("core", None)
    parts = {"identity_up": identity, "identity_down": down, "core": core, "edge": filled("edge", core)}
    bank_out = both.where(F.col("tag").isin("pcr_up", "pcr_down"))
    for tag, part in parts.items():
        bank_out = bank_out.unionByName(part.withColumn("tag", F.lit(tag)))
    func = both.where(F.col("tag").isin("pcr_up", "pcr_down")).withColumn("weight", F.lit(1.0))
    return bank_out, weights_out.unionByName(func.select("prototype", "tag", "gene", "weight"))


# ---------------------------------------------------------------- set scores


def rank_in_unit(df: DataFrame, unit: Sequence[str], value: str, name: str = "rk", descending: bool = True) -> DataFrame:
    """Average-tie rank of the genes of one unit. The partition is one unit's genes, bounded by the gene panel."""
    v = -F.col(value) if descending else F.col(value)
    w = Window.partitionBy(*unit)
    ordered = w.orderBy("_v")
    same = Window.partitionBy(*unit, "_v")
    return (
        df.withColumn("_v", v)
        .withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2)
        .withColumn(f"{name}_n", F.count(F.lit(1)).over(w))
        .drop("_v")
    )


def rank_score(df: DataFrame, sets: DataFrame, unit: Sequence[str], max_rank: int = 1500, value: str = "value") -> DataFrame:
    """Rank-based signature score per unit and set: 1 - U / (n * max_rank) over the set's genes, ranks capped; genes of
    the set that the unit lacks take the worst rank.

    Only units that hold a gene of a set have a row for it; everywhere else the score is that of :func:`zero_rule`, so
    thousands of sets cost what their genes are found, not units times sets.
    """
    distinct = cut_lineage(sets.select("name", "gene").distinct())
    names = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    worst = F.lit(float(max_rank + 1))
    r = rank_in_unit(df.where(F.col(value) > 0), unit, value)
    r = r.withColumn("rk", F.least(F.col("rk"), worst))
    hit = r.join(distinct, "gene").groupBy(*unit, "name").agg(F.sum("rk").alias("s"), F.count(F.lit(1)).alias("found"))
    n = F.col("n")
    u = F.col("s") + (n - F.col("found")) * worst - n * (n + 1) / 2
    return hit.join(names, "name").select(*unit, "name", F.greatest(1 - u / (n * max_rank), F.lit(0.0)).alias("score"))


def zero_rule(sets: DataFrame, max_rank: int = 1500) -> DataFrame:
    """(name, score): the rank score of a set in a unit that holds none of its genes."""
    n = F.col("n")
    u = n * F.lit(float(max_rank + 1)) - n * (n + 1) / 2
    size = sets.groupBy("name").agg(F.count_distinct("gene").alias("n"))
    return size.select("name", F.greatest(1 - u / (n * max_rank), F.lit(0.0)).alias("score"))


def rank_score_everywhere(df: DataFrame, sets: DataFrame, unit: Sequence[str], max_rank: int = 1500, value: str = "value") -> DataFrame:
    """:func:`rank_score` with a row for every unit and set, as a table of few sets is wanted in wide form. The result has
    units times sets rows; sets meet units through blocks of names, each one array of at most 1024."""
    df = spread(df.select(*unit, "gene", value), unit)
    found = rank_score(df, sets, unit, max_rank, value)
    rule = cut_lineage(zero_rule(sets, max_rank))
    blocks = rule.groupBy(F.pmod(F.xxhash64("name"), F.lit(max(1, rule.count() // 512))).alias("_b")).agg(
        F.collect_list(F.struct("name", "score")).alias("_z")
    )
    many = F.explode(F.sequence(F.lit(0), F.lit(max(1, rule.count() // 512) - 1))).alias("_b")
    full = df.select(*unit).distinct().select(*unit, many).join(blocks, "_b")
    full = full.select(*unit, F.explode("_z").alias("z")).select(*unit, "z.name", F.col("z.score").alias("_zero"))
    return full.join(found, [*unit, "name"], "left").select(*unit, "name", F.coalesce("score", "_zero").alias("score"))


def enrichment_score(df: DataFrame, sets: DataFrame, unit: Sequence[str], power: float = 0.25, value: str = "value") -> DataFrame:
    """Single-sample enrichment: sum over ranked genes of the in-set minus the out-of-set cumulative share.

    Summed by parts, a gene at position i adds to the last n - i + 1 running values, so only the set's own genes are read
    and no running sum over all genes is needed. A set that holds every gene of a unit has no genes outside and so no
    contrast: its score there is null. Units without any gene of a set have no row for it.
    """
    w = Window.partitionBy(*unit)
    ordered = w.orderBy(F.desc(value), "gene")
    r = df.withColumn("pos", F.row_number().over(ordered)).withColumn("n", F.count(F.lit(1)).over(w))
    r = r.withColumn("tail", F.col("n") - F.col("pos") + 1)  # also the gene's rank from the bottom
    weight = F.pow(F.col("tail").cast("double"), F.lit(power))
    s = r.join(sets.select("name", "gene").distinct(), "gene").groupBy(*unit, "name").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("m"),
        (F.sum(weight * F.col("tail")) / F.sum(weight)).alias("inside"),
        F.sum("tail").alias("t"),
    )
    n, m = F.col("n"), F.col("m")
    outside = F.when(n > m, (n * (n + 1) / 2 - F.col("t")) / (n - m))
    return s.select(*unit, "name", (F.col("inside") - outside).alias("score"))


TRACKS = [("identity", "identity_up", "identity_down"), ("spatial", "core", "edge"), ("functional", "pcr_up", "pcr_down")]


def bank_scores(df: DataFrame, bank: DataFrame, weights: DataFrame, unit: Sequence[str], value: str = "value") -> DataFrame:
    """(unit, prototype, identity, spatial, functional): weighted mean of up minus down genes per track.

    A set none of whose genes has a weight uses the plain mean; a set without present genes scores 0.
    """
    b = bank.select("prototype", "tag", F.upper("gene").alias("gene")).distinct()
    clean = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    g = b.join(weights.select("prototype", "tag", F.upper("gene").alias("gene"), "weight"), ["prototype", "tag", "gene"], "left").withColumn("w", clean)
    g = cut_lineage(g)  # small, and known to be: units stay where they were dealt
    s = spread(df.select(*unit, F.upper("gene").alias("gene"), value), unit).join(g, "gene").groupBy(*unit, "prototype", "tag").agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col(value)).alias("swv"), F.avg(value).alias("plain")
    ).withColumn("score", F.when(F.col("sw") > 0, F.col("swv") / F.col("sw")).otherwise(F.col("plain")))
    pick = lambda t: F.coalesce(F.max(F.when(F.col("tag") == t, F.col("score"))), F.lit(0.0))
    return s.groupBy(*unit, "prototype").agg(*[(pick(u) - pick(d)).alias(name) for name, u, d in TRACKS])


def call_prototypes(
    scores: DataFrame, macro: DataFrame, prior: DataFrame, unit: str, w_spatial: float = 0.5, w_func: float = 0.5,
    beta: float = 1.0, min_margin: float = 0.1, min_tracks: int = 2, prior_gate: float | None = None,
) -> DataFrame:
    """One row per unit: best prototype, margin to the second, and the call if margin, consensus and prior gates pass."""
    s = scores.join(macro, unit, "left").withColumn("macro", F.coalesce("macro", F.lit("Unknown")))
    s = s.join(prior, ["prototype", "macro"], "left")
    factor = F.pow(F.greatest(F.coalesce("frac", F.lit(1.0)), F.lit(1e-6)), F.lit(float(beta)))
    s = s.withColumn("raw", (F.col("identity") + w_spatial * F.col("spatial") + w_func * F.col("functional")) * factor)
    s = spread(s, [unit])  # read for the spread of each prototype and again for the scores
    st = s.groupBy("prototype").agg(F.avg("raw").alias("mu"), F.stddev_samp("raw").alias("sd"))
    st = st.withColumn("sd", F.when(F.col("sd") >= 1e-6, F.col("sd")).otherwise(1.0))
    positive = sum(((F.col(t) > 0).cast("int") for t in ("spatial", "functional")), (F.col("identity") > 0).cast("int"))
    z = s.join(st, "prototype").withColumn("z", (F.col("raw") - F.col("mu")) / F.col("sd"))
    row = F.struct((-F.col("z")).alias("neg"), F.col("prototype"), positive.alias("tracks"), F.col("frac").alias("frac"))
    best = z.groupBy(unit).agg(F.sort_array(F.collect_list(row)).alias("r"))  # one entry per prototype
    top, second = F.col("r")[0], F.get(F.col("r"), F.lit(1))
    margin = second["neg"] - top["neg"]
    ok = (margin >= min_margin) & (top["tracks"] >= min_tracks)
    if prior_gate is not None:
        ok = ok & (F.coalesce(top["frac"], F.lit(float("-inf"))) >= prior_gate)
    return best.select(
        unit,
        top["prototype"].alias("best"),
        (-top["neg"]).alias("top1"),
        (-second["neg"]).alias("top2"),
        margin.alias("margin"),
        F.when(ok, top["prototype"]).alias("called"),
    )


def align_by_similarity(observed: DataFrame, prior: DataFrame) -> DataFrame:
    """(source, target, similarity): each source in order takes its most similar target that is still free.

    ``observed`` and ``prior`` are (name, macro, frac) compositions. The walk is deferred acceptance in which every target
    prefers the source that comes first: in each round the free sources ask for their best target that hasn't turned them
    down, and a target keeps the first of all that asked. As all targets rank the sources alike, the end is the same as
    walking through the sources one by one, whatever their number. A source without a free target has no row.
    """
    pair = observed.select(F.col("name").alias("s"), "macro", F.col("frac").alias("a")).join(
        prior.select(F.col("name").alias("t"), "macro", F.col("frac").alias("b")), "macro"
    )
    dots = pair.groupBy("s", "t").agg(F.sum(F.col("a") * F.col("b")).alias("d"))
    size = lambda df, key, name: df.groupBy(F.col("name").alias(key)).agg(F.sqrt(F.sum(F.col("frac") * F.col("frac"))).alias(name))
    sim = dots.join(size(observed, "s", "na"), "s").join(size(prior, "t", "nb"), "t").select(
        "s", "t", (F.col("d") / (F.col("na") * F.col("nb"))).alias("sim")
    )
    live = cut_lineage(sim)  # pairs whose target has not turned the source down
    while True:
        asked = live.groupBy("s").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "t")).alias("o"))
        asked = cut_lineage(asked.select("s", F.col("o.t").alias("t"), (-F.col("o.neg")).alias("sim")))
        kept = cut_lineage(asked.groupBy("t").agg(F.min("s").alias("_first")))
        if asked.count() == kept.count():
            return asked.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("sim").alias("similarity"))
        # what a target holds can only come earlier, so it turns down every later source, asked or not
        left = cut_lineage(live.join(kept, "t", "left").where("_first is null or s <= _first").drop("_first"))
        for state in (live, asked, kept):
            forget(state)
        live = left


def top_j_pooling(df: DataFrame, slide: str, item: Sequence[str], scores: str, j: int) -> DataFrame:
    """(slide, class, score): mean of the j largest item scores per class; partitions are cut to j before the shuffle."""
    long = df.select(slide, *item, F.posexplode(scores).alias("cls", "s"))
    best = top_n(long, [slide, "cls"], [F.desc("s"), *[F.col(c) for c in item]], j)
    return best.groupBy(slide, "cls").agg(F.avg(F.col("s").cast("double")).alias("score"))


# ---------------------------------------------------------------- ligand and receptor


def pair_table(spark) -> DataFrame:
    rows = [(axis, l, r) for axis, pairs in LIGAND_RECEPTOR.items() for l, r in pairs]
    return spark.createDataFrame(rows, "axis string, ligand string, receptor string")


def axis_scores(expr: DataFrame, unit: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(unit, axis, score): mean over an axis' pairs of sqrt(L * R) after min-max per gene within the scope."""
    keys = [*scope, "gene"]
    ext = expr.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = expr.join(ext, keys).withColumn("v", (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9))
    x = x.withColumn("v", F.greatest(F.least("v", F.lit(1.0)), F.lit(0.0)))
    pairs = pair_table(expr.sparkSession)
    lig = x.select(*unit, F.col("gene").alias("ligand"), F.col("v").alias("l")).join(pairs, "ligand")
    rec = x.select(*unit, F.col("gene").alias("receptor"), F.col("v").alias("r"))
    return lig.join(rec, [*unit, "receptor"]).groupBy(*unit, "axis").agg(F.avg(F.sqrt(F.col("l") * F.col("r"))).alias("score"))


def communication(means: DataFrame, pairs: DataFrame, group: str = "grp") -> DataFrame:
    """(axis, ligand, receptor, source, target, prob): mean ligand of the source group times mean receptor of the target."""
    lig = means.select(F.col(group).alias("source"), F.col("gene").alias("ligand"), F.col("value").alias("l"))
    rec = means.select(F.col(group).alias("target"), F.col("gene").alias("receptor"), F.col("value").alias("r"))
    return pairs.join(lig, "ligand").join(rec, "receptor").select(
        "axis", "ligand", "receptor", "source", "target", (F.col("l") * F.col("r")).alias("prob")
    )


def sender_receiver(weights: DataFrame) -> DataFrame:
    """(grp, sent, received): row and column sums of the pair weights."""
    s = weights.groupBy(F.col("source").alias("grp")).agg(F.sum("prob").alias("sent"))
    r = weights.groupBy(F.col("target").alias("grp")).agg(F.sum("prob").alias("received"))
    return s.join(r, "grp", "full_outer").fillna(0.0, ["sent", "received"])


# ---------------------------------------------------------------- rows and groups


def top_cells(df: DataFrame, prototype: str, cell: str, score: str, n: int, total: int) -> DataFrame:
    """(cell, score): the ``n`` best cells of every prototype, each cell once with its best score, at most ``total`` in all."""
    w = Window.partitionBy(prototype).orderBy(F.col(score).desc(), cell)
    best = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return best.groupBy(cell).agg(F.max(score).alias(score)).orderBy(F.col(score).desc(), cell).limit(total)


def largest_groups(df: DataFrame, group: str, n: int, name: str = "n") -> DataFrame:
    """The ``n`` groups with the most rows, ties by name."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), group).limit(n)
