"""Neighbourhood composition, interfaces, proximity and their per-sample summaries, all in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import predicates as P
from tilewright.functions.arrays import best_other_margin
from tilewright.functions.scores import clip01
from tilewright.operators.neighbors import distance_to_nearest
from tilewright.operators.ordered import quantiles


def neighbor_mix(pairs: DataFrame, cells: DataFrame, label: str, classes: Sequence, name: str = "mix", groups: Sequence[str] = ("sample_name",)) -> DataFrame:
    """(groups, node_idx, mix): share of every listed class among a cell's neighbours, as one array in list order."""
    kinds = cells.select(*groups, F.col("node_idx").alias("dst"), F.col(label).alias("_c"))
    shares = F.array(*[F.avg((F.col("_c") == F.lit(c)).cast("double")) for c in classes])
    return (
        pairs.join(kinds, [*groups, "dst"])
        .groupBy(*groups, F.col("src").alias("node_idx"))
        .agg(shares.alias(name))
    )


def with_mix(cells: DataFrame, mix: DataFrame, name: str, n: int, groups: Sequence[str] = ("sample_name",)) -> DataFrame:
    """Cells with their neighbour shares, zeros where a cell has no neighbours."""
    return cells.join(mix, [*groups, "node_idx"], "left").withColumn(
        name, F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), n))
    )


def long_mix(df: DataFrame, keys: Sequence[str], mix: str, classes: Sequence, label: str) -> DataFrame:
    """One row per class: (keys, label, share)."""
    names = F.array(*[F.lit(c) for c in classes])
    return df.select(*keys, F.explode(F.arrays_zip(names.alias("c"), F.col(mix).alias("s"))).alias("z")).select(
        *keys, F.col("z.c").alias(label), F.col("z.s").alias("share")
    )


def anchor_mix(df: DataFrame, keys: Sequence[str], mix: str, classes: Sequence, label: str, min_cells: int) -> DataFrame:
    """Mean neighbour share per anchor keys, anchors with at least ``min_cells`` cells."""
    means = F.array(*[F.avg(F.get(F.col(mix), F.lit(i))) for i in range(len(classes))])
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), means.alias("_m")).where(F.col("n_cells") >= min_cells)
    return long_mix(a, [*keys, "n_cells"], "_m", classes, label)


def _with_classes(pairs: DataFrame, cells: DataFrame, label: str, groups: Sequence[str]) -> DataFrame:
    s = cells.select(*groups, F.col("node_idx").alias("src"), F.col(label).alias("ps"))
    t = cells.select(*groups, F.col("node_idx").alias("dst"), F.col(label).alias("pt"))
    return pairs.join(s, [*groups, "src"]).join(t, [*groups, "dst"])


def interface_density(pairs: DataFrame, cells: DataFrame, wanted: Sequence[tuple[int, int]], k: int) -> DataFrame:
    """Per sample: share of neighbour-edge length between each unordered prototype pair, and the rate of unlike edges."""
    groups = ["sample_name"]
    ok = cells.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= max(10, k + 2))
    e = _with_classes(pairs, cells, "prototype_id", groups)
    ps, pt, total = F.col("ps"), F.col("pt"), F.greatest(F.sum("dist"), F.lit(1e-6))
    between = lambda a, b: ((ps == a) & (pt == b)) | ((ps == b) & (pt == a))
    agg = e.groupBy(*groups).agg(
        total.alias("total_edge_len"),
        F.avg((ps != pt).cast("double")).alias("edges_cross_rate"),
        *[(F.sum(F.when(between(a, b), F.col("dist")).otherwise(0.0)) / total).alias(f"ID_{a}_{b}") for a, b in wanted],
    )
    return agg.join(ok, groups)


def proximity_occupancy(cells: DataFrame, radii: Sequence[float], focus: int = 2, anchor: int = 0, scale: float = 1.0) -> DataFrame:
    """Per sample and radius: share of the focus prototype among cells within the radius of any anchor cell."""
    near = distance_to_nearest(cells, cells.where(F.col("prototype_id") == anchor), ["sample_name"])
    d = cells.select("sample_name", "node_idx", "prototype_id").join(near, ["sample_name", "node_idx"])
    away = F.col("dist") * scale
    share = lambda r: F.count_if((away <= r) & (F.col("prototype_id") == focus)) / F.nullif(F.count_if(away <= r), F.lit(0))
    return d.groupBy("sample_name").agg(*[share(r).alias(f"P{focus}_occ_r{int(r)}") for r in radii])


def core_metrics(df: DataFrame, mix: str, protos: Sequence[int], core: float = 0.7, margin: float = 0.12) -> DataFrame:
    """(sample, prototype): fraction and number of core cells, their mean margin, and the mean share."""
    m = F.col(mix)
    cells = df.select(
        "sample_name",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        P.share(m, k).alias("s"),
                        best_other_margin(m, k).alias("m"),
                        P.is_core(m, k, core, margin).alias("core"),
                    )
                    for k in protos
                ]
            )
        ).alias("z"),
    ).select("sample_name", "z.*")
    return cells.groupBy("sample_name", F.col("k").alias("prototype_id")).agg(
        F.avg(F.col("core").cast("double")).alias("core_frac"),
        F.count_if("core").alias("core_count"),
        F.avg(F.when(F.col("core"), F.col("m"))).alias("core_margin_mean"),
        F.avg("s").alias("prop_mean"),
    )


def interface_metrics(df: DataFrame, mix: str, pairs: Sequence[tuple[int, int]], threshold: float = 0.4) -> DataFrame:
    """(sample, pair): fraction, number and mean strength of interface cells, and the mean strength of all cells."""
    m = F.col(mix)
    rows = F.array(
        *[F.struct(F.lit(f"P{i}_P{j}").alias("pair"), P.interface_strength(m, i, j).alias("s")) for i, j in pairs]
    )
    x = df.select("sample_name", F.explode(rows).alias("z")).select("sample_name", "z.*")
    on = F.col("s") >= threshold
    return x.groupBy("sample_name", "pair").agg(
        F.avg(on.cast("double")).alias("interface_frac"),
        F.count_if(on).alias("interface_count"),
        F.avg(F.when(on, F.col("s"))).alias("interface_mean_strength"),
        F.avg("s").alias("mean_strength"),
    )


def existing_pairs(df: DataFrame, mix: str, protos: Sequence[int], threshold: float = 0.05) -> DataFrame:
    """(i, j) such that some sample has a mean share of at least ``threshold`` for both."""
    means = df.groupBy("sample_name").agg(*[F.avg(P.share(F.col(mix), k)).alias(f"_m{k}") for k in protos])
    listed = [(i, j) for a, i in enumerate(protos) for j in protos[a + 1 :]]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((F.col(f"_m{i}") >= threshold) & (F.col(f"_m{j}") >= threshold)).alias("both"))
            for i, j in listed
        ]
    )
    x = means.select(F.explode(rows).alias("z")).select("z.*")
    return x.groupBy("i", "j").agg(F.bool_or("both").alias("ok")).where("ok").drop("ok")


def radial_profile(cells: DataFrame, anchor: int, radii: Sequence[float], label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(radius, class, share): classes of all cells within each radius of the anchor cells, an anchor itself left out."""
    from tilewright.operators.neighbors import within_radius

    anchors = cells.where(F.col("prototype_id") == anchor)
    # the label comes with the cell: pairs are counted in the task that finds them and never travel
    near = within_radius(cells, anchors, max(radii), groups, keep=[label]).where("src <> dst")
    rows = F.array(*[F.lit(float(r)) for r in radii])
    e = near.withColumn("radius", F.explode(F.filter(rows, lambda r: F.col("dist") <= r)))
    c = e.groupBy("radius", label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("radius")))


def transition_matrix(pairs: DataFrame, cells: DataFrame, label: str = "prototype_id", groups: Sequence[str] = ()) -> DataFrame:
    """(src, dst, n, value): neighbour class counts per source class, rows summing to 1."""
    e = _with_classes(pairs, cells, label, groups)
    c = e.groupBy(F.col("ps").alias("src"), F.col("pt").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def minmax_matrix(m: DataFrame) -> DataFrame:
    """A long matrix scaled to [0, 1] over all its entries (absent entries count as 0)."""
    full = m.agg(
        F.struct(
            F.when(F.count(F.lit(1)) < F.count_distinct("src") * F.count_distinct("dst"), F.least(F.min("value"), F.lit(0.0)))
            .otherwise(F.min("value"))
            .alias("lo"),
            F.max("value").alias("hi"),
        ).alias("x")
    ).scalar()
    return m.withColumn("_x", full).select(
        "src", "dst", ((F.col("value") - F.col("_x.lo")) / (F.col("_x.hi") - F.col("_x.lo") + 1e-9)).alias("value")
    )


def symmetric_edges(m: DataFrame) -> DataFrame:
    """Upper triangle of the symmetrised matrix: (src, dst, weight) with src < dst."""
    lo, hi = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    return m.where("src <> dst").select(lo, hi, "value").groupBy("a", "b").agg((F.sum("value") / 2).alias("weight")).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "weight"
    )


def log2_enrichment(pairs: DataFrame, cells: DataFrame, label: str = "prototype_id", min_cells: int = 4) -> DataFrame:
    """(src, dst, observed, expected, value): neighbour pair counts against independent mixing per sample."""
    g = ["sample_name"]
    size = cells.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    kept = cells.join(size, g)
    freq = kept.groupBy(*g, label).agg((F.count(F.lit(1)) / F.max("n")).alias("f"), F.max("n").alias("n"))
    e = _with_classes(pairs, kept, label, g)
    per = pairs.join(size, g, "left_semi").groupBy(*g).agg(F.count(F.lit(1)).alias("edges"))
    a = freq.select(*g, F.col(label).alias("src"), F.col("f").alias("fa"))
    b = freq.select(*g, F.col(label).alias("dst"), F.col("f").alias("fb"))
    expected = a.join(b, g).join(per, g).groupBy("src", "dst").agg(
        F.sum(F.col("fa") * F.col("fb") * F.col("edges")).alias("expected")
    )
    observed = e.groupBy(F.col("ps").alias("src"), F.col("pt").alias("dst")).agg(F.count(F.lit(1)).alias("observed"))
    j = expected.join(observed, ["src", "dst"], "full_outer").fillna(0, ["observed", "expected"])
    return j.withColumn("value", F.log2((F.col("observed") + F.lit(1e-9)) / (F.col("expected") + F.lit(1e-9))))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b of two long matrices, missing entries as 0."""
    j = a.select("src", "dst", F.col("value").alias("va")).join(
        b.select("src", "dst", F.col("value").alias("vb")), ["src", "dst"], "full_outer"
    )
    return j.select("src", "dst", (F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0))).alias("value"))


def focus_shares(df: DataFrame, mix: str, anchors: Sequence[int], label: str, threshold: float) -> DataFrame:
    """(anchor, class, n, share): classes of the cells whose neighbour share of the anchor reaches the threshold."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), P.share(F.col(mix), k).alias("s")) for k in anchors])
    x = df.select(label, F.explode(rows).alias("z")).where(F.col("z.s") >= threshold)
    c = x.groupBy(F.col("z.k").alias("anchor"), label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("anchor")))


GATE_AGGREGATES = {"mean": F.avg, "max": F.max}


def gate_strength(edges: DataFrame, cells: DataFrame, how: str = "mean") -> DataFrame:
    """Cells with the mean or largest weight of their tile edges (0 without edges) and its 1-99 % clipped form."""
    w = edges.groupBy("sample_name", F.col("src").alias("node_idx")).agg(GATE_AGGREGATES[how]("weight").alias("gate"))
    g = cells.join(w, ["sample_name", "node_idx"], "left").withColumn("gate", F.coalesce("gate", F.lit(0.0)))
    q = quantiles(g, [], "gate", [0.01, 0.99]).scalar()
    return g.withColumn("_q", q).withColumn("gate_norm", clip01(F.col("gate"), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def gate_summary(df: DataFrame, value: str = "gate") -> DataFrame:
    """(prototype, type): n, mean, median, std, and the difference to the prototype's mean."""
    keys = ["prototype_id", "cell_type"]
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    med = quantiles(df, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias("median"))
    proto = df.groupBy("prototype_id").agg(F.avg(value).alias("_pm"))
    return s.join(med, keys).join(proto, "prototype_id").withColumn("delta", F.col("mean") - F.col("_pm")).drop("_pm")


def edge_strength(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of edge weights per cell and that sum winsorised at 5-95 % of the positives, scaled to [0, 1] per sample."""
    g = ["sample_name"]
    s = edges.groupBy(*g, F.col("src").alias("node_idx")).agg(F.sum("weight").alias("strength"))
    full = cells.select(*g, "node_idx").join(s, [*g, "node_idx"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    q = quantiles(full.where("strength > 0"), g, "strength", [0.05, 0.95], "_q")
    lo = F.coalesce(F.col("_q")[0], F.lit(0.0))
    hi = F.coalesce(F.col("_q")[1], F.lit(1.0))
    w = full.join(q, g, "left").withColumn("_w", F.greatest(F.least(F.col("strength"), hi), lo)).drop("_q")
    ext = w.groupBy(*g).agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi"))
    return w.join(ext, g).select(
        *g, "node_idx", "strength", ((F.col("_w") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).alias("scaled")
    )


def similar_neighbors(
    edges: DataFrame, points: DataFrame, vector: str, threshold: float, metric: str = "cosine", groups: Sequence[str] = ("sample_name",)
) -> DataFrame:
    """(groups, src, dst, value): graph neighbours, each pair once, whose vectors are more similar than the threshold."""
    from tilewright.functions.arrays import cosine, pearson

    groups = list(groups)
    score = {"cosine": cosine, "pearson": pearson}[metric]
    once = edges.select(*groups, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a = points.select(*groups, F.col("node_idx").alias("src"), F.col(vector).alias("_u"))
    b = points.select(*groups, F.col("node_idx").alias("dst"), F.col(vector).alias("_v"))
    scored = once.join(a, [*groups, "src"]).join(b, [*groups, "dst"]).withColumn("value", score(F.col("_u"), F.col("_v")))
    return scored.where(F.col("value") > threshold).drop("_u", "_v")


def tile_prototype_mix(edges: DataFrame, tiles: DataFrame, protos: Sequence[int]) -> DataFrame:
    """(sample, node_idx, mix): edge-weighted share of tile prototypes per cell."""
    kinds = tiles.select("sample_name", F.col("tile_id").alias("dst"), F.col("tile_proto"))
    total = F.greatest(F.sum("weight"), F.lit(1e-6))
    shares = F.array(*[F.sum(F.when(F.col("tile_proto") == p, F.col("weight")).otherwise(0.0)) / total for p in protos])
    return edges.join(kinds, ["sample_name", "dst"]).groupBy("sample_name", F.col("src").alias("node_idx")).agg(shares.alias("mix"))


def compatibility(edges: DataFrame, soft_cells: DataFrame, soft_tiles: DataFrame, bridge: Sequence[Sequence[float]], temperature: float = 1.0, how: str = "mean") -> DataFrame:
    """(sample, node_idx, score): softened weighted agreement of cell and tile assignments through a K x K bridge matrix,
    averaged (or maximised) per cell and min-max scaled over all cells."""
    from tilewright.functions.arrays import dot
    from tilewright.functions.scores import soften

    cols = F.array(*[F.array(*[F.lit(float(row[j])) for row in bridge]) for j in range(len(bridge[0]))])
    a = soft_cells.select("sample_name", F.col("node_idx").alias("src"), F.transform(cols, lambda c: dot(F.col("soft_prob"), c)).alias("qb"))
    b = soft_tiles.select("sample_name", F.col("tile_id").alias("dst"), F.col("soft_prob").alias("qg"))
    e = edges.join(a, ["sample_name", "src"]).join(b, ["sample_name", "dst"])
    s = e.select("sample_name", F.col("src").alias("node_idx"), soften(dot(F.col("qb"), F.col("qg")) * F.col("weight"), temperature).alias("s"))
    agg = F.max("s") if how == "max" else F.sum("s") / (F.count("s") + F.lit(1e-8))
    per = s.groupBy("sample_name", "node_idx").agg(agg.alias("score"))
    full = soft_cells.select("sample_name", "node_idx").join(per, ["sample_name", "node_idx"], "left").fillna(0.0, ["score"])
    ext = full.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("x")).scalar()
    span = F.col("_x.hi") - F.col("_x.lo")
    return full.withColumn("_x", ext).select(
        "sample_name", "node_idx", F.when(span < 1e-8, F.lit(0.0)).otherwise((F.col("score") - F.col("_x.lo")) / span).alias("score")
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n, density) over equal-width bins from the minimum to the maximum."""
    ext = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("n")).alias("x")).scalar()
    x = df.where(F.col(value).isNotNull()).withColumn("_x", ext)
    width = (F.col("_x.hi") - F.col("_x.lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_x.lo")) / width), F.lit(bins - 1))
    return x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (F.max("_x.n") * F.max(width))).alias("density"))


def grid_means(df: DataFrame, score: str, flag: str, bins: int = 200) -> DataFrame:
    """(gx, gy, n, score, flag share) on a bins x bins grid over the extent of all points."""
    ext = df.agg(
        F.struct(F.min("pos_x").alias("x0"), F.max("pos_x").alias("x1"), F.min("pos_y").alias("y0"), F.max("pos_y").alias("y1")).alias("x")
    ).scalar()
    at = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / ((F.col(b) - F.col(a)) / bins)), F.lit(bins - 1))
    return (
        df.withColumn("_x", ext)
        .groupBy(at("pos_x", "_x.x0", "_x.x1").alias("gx"), at("pos_y", "_x.y0", "_x.y1").alias("gy"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score"), F.avg(F.col(flag).cast("double")).alias("flag_share"))
    )


def type_enrichment(df: DataFrame, grid: float, threshold: float, min_cells: int) -> DataFrame:
    """(sample, gx, gy, cell_type, share): grid squares with enough cells where a type reaches the threshold."""
    keys = ["sample_name", "gx", "gy"]
    sq = df.withColumns({"gx": F.floor(F.col("pos_x") / grid), "gy": F.floor(F.col("pos_y") / grid)})
    c = sq.groupBy(*keys, "cell_type").agg(F.count(F.lit(1)).alias("_c"))
    c = c.withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))  # one row per type in a square
    return c.where(F.col("n") >= min_cells).withColumn("share", F.col("_c") / F.col("n")).where(F.col("share") >= threshold).drop("_c")


def assemble_metrics(density: DataFrame, proximity: DataFrame, core: DataFrame, shares: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per sample: all metric tables outer-joined, then composition, cohort and label attached."""
    about = cells.groupBy("sample_name").agg(F.min_by("cohort", "node_idx").alias("cohort"), F.min_by("label", "node_idx").alias("label"))
    return (
        density.join(proximity, "sample_name", "full_outer")
        .join(core, "sample_name", "full_outer")
        .join(shares, "sample_name", "left")
        .join(about, "sample_name", "left")
    )
