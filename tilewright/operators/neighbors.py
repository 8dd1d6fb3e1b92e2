"""Spatial relations: k nearest neighbours, nearest reference, radius pairs, votes and interpolation.

kNN uses a multi-level grid instead of a tree. A square covering all points is halved again and again; level ``l`` has
cells of width ``span / 2**l``. For every query position the deepest cell that still holds ``k`` reference points bounds
the k-th distance by the distance to that cell's farthest corner, so only the cells of that level touching this circle
can hold a neighbour. Dense areas use fine levels and sparse areas coarse ones, so the work follows the local density;
no radius has to be guessed and nothing loops on the driver.

Copies are handled once: positions are made distinct first and keep only their ``k`` smallest ids, because with ties
ordered by id no further copy can be among the k nearest. A pile of equal points costs one position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.session import cut_lineage

MAX_LEVEL = 24

#: Query positions whose candidates one task lists.
ASKS = 1 << 13

#: Candidate pairs of a radius join that one task compares.
PAIRS = 1 << 24


def placed(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points with both coordinates: neither null nor NaN nor infinite."""
    inside = [F.abs(F.col(c).cast("double")) < float("inf") for c in (x, y)]
    return points.where(inside[0] & inside[1] & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))


def _positions(points: DataFrame, groups: list[str], x: str, y: str, node: str, keep: int) -> DataFrame:
    """Distinct positions with their ``keep`` smallest ids (bounded), as (groups, px, py, ids)."""
    p = placed(points, x, y).select(
        *groups, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), F.col(node).alias("_id")
    )
    w = Window.partitionBy(*groups, "px", "py").orderBy("_id")
    few = p.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return few.groupBy(*groups, "px", "py").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    groups: Sequence[str] = (),
    x: str = "pos_x",
    y: str = "pos_y",
    node: str = "node_idx",
) -> DataFrame:
    """The k nearest reference points of each distinct query position, ties by (distance, id).

    Returns (groups, px, py, near) where ``near`` is an array of (d2, dst), at most ``k`` long, in order.
    """
    groups = list(groups)
    spots = _positions(refs, groups, x, y, node, k)
    asks = (
        placed(queries, x, y)
        .select(*groups, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
        .distinct()
    )
    # the driver learns four numbers: the bounding square of all points
    ends = [F.min(x), F.max(x), F.min(y), F.max(y)]
    box = [placed(p, x, y).agg(*[e.cast("double") for e in ends]).first() for p in (queries, refs)]
    known = [b for b in box if b[0] is not None and b[2] is not None]
    x0, y0 = (min((b[i] for b in known), default=0.0) for i in (0, 2))
    x1, y1 = (max((b[i] for b in known), default=0.0) for i in (1, 3))
    span = max(x1 - x0, y1 - y0) * 1.0001 + 1e-9  # strictly larger than the extent: level 0 is one cell

    def cells(df: DataFrame) -> list[Column]:
        width = F.lit(span) / F.pow(F.lit(2.0), F.col("lv"))
        return [
            F.floor((F.col("px") - F.lit(x0)) / width).alias("cx"),
            F.floor((F.col("py") - F.lit(y0)) / width).alias("cy"),
        ]

    # reference points per cell and level; coarse levels collapse in the map-side combine
    leveled = spots.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))))
    counts = (
        leveled.select(*groups, "lv", *cells(leveled), F.size("ids").alias("m"))
        .groupBy(*groups, "lv", "cx", "cy")
        .agg(F.sum("m").alias("m"))
    )
    dense = counts.where(F.col("m") >= k).drop("m")
    # a cell wholly made of dense quarters cannot be the deepest dense cell of a query
    up = dense.select(*groups, (F.col("lv") - 1).alias("lv"), *[F.floor(F.col(c) / 2).alias(c) for c in ("cx", "cy")])
    marked = dense.withColumn("own", F.lit(1)).withColumn("q", F.lit(0)).unionByName(
        up.withColumn("own", F.lit(0)).withColumn("q", F.lit(1))
    )
    edge = (
        marked.groupBy(*groups, "lv", "cx", "cy")
        .agg(F.max("own").alias("own"), F.sum("q").alias("q"))
        .where("own = 1 and q < 4")
        .drop("own", "q")
    )
    edge = cut_lineage(edge)  # small next to the points, and read twice below
    used = sorted(r.lv for r in edge.select("lv").distinct().collect())  # at most MAX_LEVEL + 1 numbers
    levels = F.array(*[F.lit(v) for v in sorted({0, *used})])
    probe = asks.withColumn("lv", F.explode(levels))
    level = (
        probe.select(*groups, "px", "py", "lv", *cells(probe))
        .join(edge.withColumn("hit", F.col("lv")), [*groups, "lv", "cx", "cy"], "left")
        .groupBy(*groups, "px", "py")
        .agg(F.coalesce(F.max("hit"), F.lit(0)).alias("lv"))  # no hit: the whole group has fewer than k references
        .withColumn("w", F.lit(span) / F.pow(F.lit(2.0), F.col("lv")))
    )
    cx = F.floor((F.col("px") - F.lit(x0)) / F.col("w"))
    cy = F.floor((F.col("py") - F.lit(y0)) / F.col("w"))

    def reach(coord: str, origin: float, cell: Column) -> Column:
        left = F.col(coord) - (F.lit(origin) + cell * F.col("w"))
        return F.greatest(left, F.col("w") - left)

    # a hair of slack keeps border ties; the exact order decides afterwards
    radius = F.sqrt(F.pow(reach("px", x0, cx), 2) + F.pow(reach("py", y0, cy), 2)) * (1 + 1e-9) + 1e-12
    # a position makes many more candidates than bytes: dealt by number, or one task would list those of all
    aimed = cut_lineage(level.select(*groups, "px", "py", "lv", "w", radius.alias("r")))
    parts = max(1, -(-aimed.count() // ASKS))

    def side(coord: str, origin: float, sign: int) -> Column:
        return F.floor((F.col(coord) + sign * F.col("r") - F.lit(origin)) / F.col("w"))

    wanted = aimed.withColumn("cx", F.explode(F.sequence(side("px", x0, -1), side("px", x0, 1)))).withColumn(
        "cy", F.explode(F.sequence(side("py", y0, -1), side("py", y0, 1)))
    )

    def gap(coord: str, origin: float, cell: str) -> Column:
        low = F.lit(origin) + F.col(cell) * F.col("w")
        return F.greatest(low - F.col(coord), F.col(coord) - low - F.col("w"), F.lit(0.0))

    wanted = wanted.where(
        F.pow(gap("px", x0, "cx"), 2) + F.pow(gap("py", y0, "cy"), 2) <= F.pow(F.col("r"), 2)
    ).select(*groups, "px", "py", "lv", "cx", "cy", "r")
    offered = spots.withColumn("lv", F.explode(levels))
    offered = offered.select(
        *groups, "lv", *cells(offered), F.col("px").alias("qx"), F.col("py").alias("qy"), "ids"
    )
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    pairs = (
        wanted.repartition(parts, *groups, "lv", "cx", "cy")
        .join(offered.repartition(parts, *groups, "lv", "cx", "cy"), [*groups, "lv", "cx", "cy"])
        .withColumn("d2", dx * dx + dy * dy)
        .where(F.col("d2") <= F.col("r") * F.col("r"))
        .select(*groups, "px", "py", "d2", F.explode("ids").alias("dst"))
    )
    w = Window.partitionBy(*groups, "px", "py").orderBy("d2", "dst")
    return (
        pairs.withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= k)
        .groupBy(*groups, "px", "py")
        .agg(F.sort_array(F.collect_list(F.struct("d2", "dst"))).alias("near"))
    )


def knn_join(
    points: DataFrame,
    k: int,
    groups: Sequence[str] = (),
    x: str = "pos_x",
    y: str = "pos_y",
    node: str = "node_idx",
) -> DataFrame:
    """Directed k-nearest-neighbour pairs (groups, src, dst, rank, dist) within each group, self excluded by id."""
    groups = list(groups)
    near = nearest(points, points, k + 1, groups, x, y, node)
    rows = points.select(
        *groups, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), F.col(node).alias("src")
    )
    own = F.slice(F.filter("near", lambda p: p["dst"] != F.col("src")), 1, k)
    return (
        rows.join(near, [*groups, "px", "py"])
        .select(*groups, "src", F.posexplode(own).alias("_p", "_n"))
        .select(
            *groups,
            "src",
            F.col("_n.dst").alias("dst"),
            (F.col("_p") + 1).alias("rank"),
            F.sqrt("_n.d2").alias("dist"),
        )
    )


def knn_between(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    groups: Sequence[str] = (),
    x: str = "pos_x",
    y: str = "pos_y",
    node: str = "node_idx",
) -> DataFrame:
    """(groups, src, dst, rank, dist): the k nearest reference rows of every query row (a query may meet itself)."""
    groups = list(groups)
    near = nearest(queries, refs, k, groups, x, y, node)
    rows = queries.select(
        *groups, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), F.col(node).alias("src")
    )
    return (
        rows.join(near, [*groups, "px", "py"])
        .select(*groups, "src", F.posexplode("near").alias("_p", "_n"))
        .select(
            *groups,
            "src",
            F.col("_n.dst").alias("dst"),
            (F.col("_p") + 1).alias("rank"),
            F.sqrt("_n.d2").alias("dist"),
        )
    )


def distance_to_nearest(queries: DataFrame, refs: DataFrame, groups: Sequence[str] = (), **names) -> DataFrame:
    """Distance from every query row to its nearest reference; groups without references drop out."""
    return knn_between(queries, refs, 1, groups, **names).select(*groups, F.col("src").alias("node_idx"), "dist")


def within_radius(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    groups: Sequence[str] = (),
    x: str = "pos_x",
    y: str = "pos_y",
    left_id: str = "node_idx",
    right_id: str = "node_idx",
    keep: Sequence[str] = (),
) -> DataFrame:
    """All (src, dst, dist) with distance at most ``radius``: a 3 x 3 grid-cell equi-join and an exact filter.

    The right side is replicated over the nine cells around it; pass the smaller relation there. ``keep`` names columns of the
    left side to carry. Tasks are dealt by candidate pairs: a crowded cell's left rows are cut into slices, each of which
    meets all its right rows, so that no task compares more than about PAIRS, whatever the bytes that arrive.
    """
    groups, keep = list(groups), list(keep)
    at = [*groups, "cx", "cy"]
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = placed(left, x, y).select(
        *groups,
        F.col(left_id).alias("src"),
        F.col(x).cast("double").alias("ax"),
        F.col(y).cast("double").alias("ay"),
        *keep,
    ).withColumns({"cx": cell("ax"), "cy": cell("ay")})
    b = (
        placed(right, x, y).select(
            *groups,
            F.col(right_id).alias("dst"),
            F.col(x).cast("double").alias("bx"),
            F.col(y).cast("double").alias("by"),
        )
        .withColumn("_i", F.explode(near))
        .withColumn("_j", F.explode(near))
        .withColumns({"cx": cell("bx") + F.col("_i"), "cy": cell("by") + F.col("_j")})
        .drop("_i", "_j")
    )
    size = a.groupBy(*at).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(*at).agg(F.count(F.lit(1)).alias("nb")), at)
    slices = F.ceil(F.col("na") * F.col("nb") / F.lit(PAIRS)).cast("int")
    size = cut_lineage(size.select(*at, slices.alias("_s"), (F.col("na") * F.col("nb")).alias("_p")))
    parts = -(-int(size.agg(F.sum("_p")).first()[0] or 1) // PAIRS)  # one number
    size = size.drop("_p")
    a = a.join(size, at).withColumn("_slice", F.pmod(F.xxhash64("src"), F.col("_s")).cast("int")).drop("_s")
    b = b.join(size, at).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    by = [*at, "_slice"]
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return (
        a.repartition(parts, *by)
        .join(b.repartition(parts, *by), by)
        .withColumn("d2", dx * dx + dy * dy)
        .where(F.col("d2") <= float(radius) * float(radius))
        .select(*groups, "src", "dst", F.sqrt("d2").alias("dist"), *keep)
    )


def undirected(edges: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge once, without loops."""
    back = edges.select(*groups, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(*groups, "src", "dst").where("src <> dst").unionByName(back.where("src <> dst")).distinct()


def spatial_graph(points: DataFrame, kind: str, groups: Sequence[str], k: int = 8, radius: float = 0.0) -> DataFrame:
    """Undirected neighbour graph on given coordinates, by ``radius`` or ``knn``.

    A radius join of points with themselves lists both directions already, and each once if no id repeats; only otherwise
    are the pairs, which grow faster than the points, made distinct.
    """
    if kind == "radius":
        pairs = within_radius(points, points, radius, groups)
        if points.groupBy(*groups, "node_idx").count().where("count > 1").isEmpty():
            return pairs.where("src <> dst").select(*groups, "src", "dst")
        return undirected(pairs, groups)
    if kind == "knn":
        return undirected(knn_join(points, k, groups), groups)
    raise ValueError(f"unknown graph kind {kind!r}")


def majority_vote(
    queries: DataFrame, refs: DataFrame, label: str, k: int, groups: Sequence[str] = (), node: str = "node_idx"
) -> DataFrame:
    """Most frequent class among the k nearest references (smallest class on a tie) and its share of the votes."""
    groups = list(groups)
    classes = refs.select(*groups, F.col(node).alias("dst"), F.col(label).alias("_c"))
    votes = (
        knn_between(queries, refs, k, groups, node=node)
        .join(classes, [*groups, "dst"])
        .groupBy(*groups, "src", "_c")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return (
        votes.groupBy(*groups, "src")
        .agg(F.min(F.struct(-F.col("votes"), F.col("_c"))).alias("_b"), F.sum("votes").alias("_n"))
        .select(
            *groups,
            F.col("src").alias(node),
            F.col("_b._c").alias("voted"),
            (-F.col("_b.col1") / F.col("_n")).alias("confidence"),
        )
    )


def interpolate(
    queries: DataFrame, refs: DataFrame, score: str, k: int = 3, sigma: float = 24.0, groups: Sequence[str] = ()
) -> DataFrame:
    """Distance-weighted mean of the k nearest references' scores: Gaussian weights, or inverse distance if sigma <= 0."""
    groups = list(groups)
    weight = (
        F.exp(-F.col("dist") * F.col("dist") / F.lit(2.0 * sigma * sigma))
        if sigma > 0
        else 1.0 / (F.col("dist") + F.lit(1e-6))
    )
    scores = refs.select(*groups, F.col("node_idx").alias("dst"), F.col(score).alias("_s"))
    return (
        knn_between(queries, refs, k, groups)
        .join(scores, [*groups, "dst"])
        .withColumn("_w", weight)
        .groupBy(*groups, "src")
        .agg((F.sum(F.col("_w") * F.col("_s")) / (F.sum("_w") + F.lit(1e-8))).alias("score"))
        .withColumnRenamed("src", "node_idx")
    )
