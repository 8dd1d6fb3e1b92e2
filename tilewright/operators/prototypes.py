"""Prototype assignment, composition, merging, hubs and stability.

Centres are few (at most ``MAX_CENTERS``, enforced when they are gathered), so they travel as one array in a scalar
subquery: scoring a vector needs no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import arrays as A
from tilewright.session import cut_lineage, forget

MAX_CENTERS = 4096


def gathered(df: DataFrame, order: str, limit: int = MAX_CENTERS) -> Column:
    """A small table as one sorted array of structs; more than ``limit`` rows is an error, not a truncation."""
    cols = [order, *[c for c in df.columns if c != order]]
    rows = F.sort_array(F.collect_list(F.struct(*cols)))
    return df.limit(limit + 1).agg(
        F.when(F.count(F.lit(1)) <= limit, rows).otherwise(F.raise_error(F.lit(f"more than {limit} rows to gather")))
    ).scalar()


def mean_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(k, vec): element-wise mean vector per key, one aggregate without exploding the vectors."""
    return df.groupBy(F.col(key).alias("k")).agg(
        F.array(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dim)]).alias("vec")
    )


def class_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Mean of unit vectors per class, scaled to unit length again."""
    unit = df.withColumn("_u", A.l2_normalize(F.col(vector)))
    return mean_vectors(unit, key, "_u", dim).withColumn("vec", A.l2_normalize(F.col("vec")))


def _similarities(df: DataFrame, centers: DataFrame, vector: str) -> DataFrame:
    ready = centers.select("k", A.l2_normalize(F.col("vec")).alias("vec"))
    length = A.norm(F.col(vector)) + F.lit(1e-8)
    return (
        df.withColumn("_centers", gathered(ready, "k"))
        .withColumn("_len", length)
        .withColumn("_sim", F.transform("_centers", lambda c: A.dot(F.col(vector), c["vec"]) / F.col("_len")))
    )


def assign(df: DataFrame, centers: DataFrame, tau: float = 0.3, vector: str = "embedding") -> DataFrame:
    """Soft and hard prototype of every row: softmax of cosine over tau, arg max, entropy confidence."""
    s = _similarities(df, centers, vector).withColumn("soft_prob", A.tempered_softmax(F.col("_sim"), tau))
    n = F.size("soft_prob").cast("double")
    entropy = F.aggregate("soft_prob", F.lit(0.0), lambda h, p: h - p * F.ln(p + F.lit(1e-12)))
    return s.withColumns(
        {
            "prototype": F.get(F.col("_centers"), A.argmax(F.col("soft_prob")))["k"],
            "confidence": F.lit(1.0) - entropy / F.ln(n),
        }
    ).drop("_centers", "_len", "_sim")


def assign_hard(df: DataFrame, centers: DataFrame, vector: str = "embedding") -> DataFrame:
    """Prototype of the largest cosine and that cosine."""
    s = _similarities(df, centers, vector)
    return s.withColumns(
        {"prototype": F.get(F.col("_centers"), A.argmax(F.col("_sim")))["k"], "cosine": F.array_max("_sim")}
    ).drop("_centers", "_len", "_sim")


def retrieve(items: DataFrame, prompts: DataFrame, vector: str = "embedding", top: int | None = None) -> DataFrame:
    """Items against a bounded list of prompt vectors (k, vec), ranked by cosine within each item."""
    s = _similarities(items, prompts, vector)
    pair = F.zip_with("_centers", "_sim", lambda c, v: F.struct((-v).alias("neg"), c["k"].alias("k")))
    ranked = F.array_sort(pair)
    ranked = F.slice(ranked, 1, top) if top else ranked
    out = s.select(*items.columns, F.posexplode(ranked).alias("_p", "_r"))
    return out.select(
        *items.columns, F.col("_r.k").alias("prompt"), (-F.col("_r.neg")).alias("similarity"), (F.col("_p") + 1).alias("rank")
    )


def usage(df: DataFrame, centers: DataFrame, temperature: float, vector: str = "embedding") -> DataFrame:
    """(k, mean_assignment) of the distance-softmax assignment on unit vectors, with summaries of its maximum."""
    from tilewright.operators.ordered import quantiles

    ready = centers.select("k", A.l2_normalize(F.col("vec"), 1e-12).alias("vec"))
    q = (
        df.withColumn("_centers", gathered(ready, "k"))
        .withColumn("_unit", A.l2_normalize(F.col(vector), 1e-12))
        .withColumn("_q", A.softmax(F.transform("_centers", lambda c: -A.distance(F.col("_unit"), c["vec"])), temperature))
        .select("_q", "_centers", F.array_max("_q").alias("top"))
    )
    mean = q.select(F.posexplode("_q").alias("pos", "p"), "_centers").groupBy(
        F.get(F.col("_centers"), F.col("pos"))["k"].alias("k")
    ).agg(F.avg("p").alias("mean_assignment"))
    mid = quantiles(q, [], "top", [0.5, 0.9]).scalar()
    return mean.withColumns({"max_mean": q.agg(F.avg("top")).scalar(), "max_median": mid[0], "max_p90": mid[1]})


def composition(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Counts and shares of a label within keys. The window runs over the aggregated classes, not over rows."""
    return shares(df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n")), keys)


def shares(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Counts with their share of the total within keys."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*keys)))


def composition_wide(df: DataFrame, keys: Sequence[str], label: str, values: Sequence, prefix: str) -> DataFrame:
    """Row-normalised counts, one column per listed value (missing ones 0), in the given order."""
    p = df.groupBy(*keys).pivot(label, list(values)).agg(F.count(F.lit(1)))
    names = [str(v) for v in values]
    total = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names[1:]), F.coalesce(F.col(f"`{names[0]}`"), F.lit(0)))
    return p.select(*keys, *[(F.coalesce(F.col(f"`{n}`"), F.lit(0)) / total).alias(f"{prefix}{n}") for n in names])


def ensure_columns(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The named columns in the given order, missing ones and nulls as 0."""
    have = set(df.columns)
    return df.select(*keys, *[(F.coalesce(F.col(n), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names])


def responder_share(df: DataFrame, prototypes: DataFrame, label: str = "label") -> DataFrame:
    """(prototype_id, r): share of label 1 among 0 / 1, 0.5 where there are none."""
    r = df.where(F.col(label).isin(0, 1)).groupBy("prototype_id").agg(F.avg(label).alias("r"))
    return prototypes.join(r, "prototype_id", "left").select("prototype_id", F.coalesce("r", F.lit(0.5)).alias("r"))


def center_similarity(centers: DataFrame) -> DataFrame:
    """(src, dst, value): cosine of every centre pair; K x K from the bounded centre list."""
    ready = centers.select("k", A.l2_normalize(F.col("vec")).alias("vec"))
    s = ready.withColumn("_c", gathered(ready, "k")).withColumn("d", F.explode("_c"))
    return s.select(F.col("k").alias("src"), F.col("d.k").alias("dst"), A.dot(F.col("vec"), F.col("d.vec")).alias("value"))


def merge_map(
    cells: DataFrame,
    centers: DataFrame,
    transition: DataFrame,
    enrichment: DataFrame,
    p_min: float = 0.01,
    n_min: int = 5000,
    keep_top: int = 2,
    prefer: Sequence[int] = (),
    weights: Sequence[float] = (0.35, 0.25, 0.25, 0.10, 0.05),
    min_center: float = 0.0,
) -> DataFrame:
    """(src, dst, score): where each prototype goes when small ones are merged into the kept ones.

    Prototypes big enough or among the targets keep themselves. The others take the target of the highest weighted sum
    of responder agreement, positive log2 enrichment, kNN transition and centre similarity, if that similarity suffices.
    """
    protos = centers.select(F.col("k").cast("int").alias("prototype_id"))
    count = cells.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n"))
    sized = protos.join(count, "prototype_id", "left").fillna(0, ["n"])
    sized = sized.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "prototype_id")  # K rows
    sized = sized.withColumn("target", (F.row_number().over(order) <= max(1, keep_top)) | F.col("prototype_id").isin(list(prefer)))
    resp = responder_share(cells, protos)
    base = cut_lineage(sized.join(resp, "prototype_id"))
    small = base.where(~F.col("target") & ~((F.col("share") >= p_min) & (F.col("n") >= n_min)))
    goal = gathered(base.where("target").select(F.col("prototype_id").alias("t"), "r"), "t")
    cand = small.withColumn("_g", goal).select(
        F.col("prototype_id").alias("src"), F.col("r").alias("rs"), F.explode("_g").alias("g")
    ).select("src", F.col("g.t").alias("dst"), "rs", F.col("g.r").alias("rt"))
    named = lambda df, name: df.select("src", "dst", F.col("value").alias(name))
    cos01 = center_similarity(centers).withColumn("value", (F.col("value") + 1) / 2)
    scored = (
        cand.join(named(enrichment, "e"), ["src", "dst"], "left")
        .join(named(transition, "t"), ["src", "dst"], "left")
        .join(named(cos01, "c"), ["src", "dst"], "left")
        .withColumn(
            "score",
            weights[0] * (1 - F.abs(F.col("rs") - F.col("rt")))
            + weights[1] * F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(0.0))
            + weights[2] * F.coalesce("t", F.lit(0.0))
            + weights[4] * F.coalesce("c", F.lit(0.5)),
        )
    )
    best = scored.groupBy("src").agg(
        F.max_by(F.struct("dst", "score", "c"), F.struct("score", -F.col("dst"))).alias("b")
    )
    moved = best.select(
        "src", F.when(F.col("b.c") >= min_center, F.col("b.dst")).otherwise(F.col("src")).alias("dst"), F.col("b.score").alias("score")
    )
    kept = base.select(F.col("prototype_id").alias("src")).join(moved, "src", "left_anti")
    return moved.unionByName(kept.select("src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("score")))


def apply_map(df: DataFrame, mapping: DataFrame, column: str = "prototype_id", name: str = "merged") -> DataFrame:
    """Mapped id, identity where the map has no entry."""
    m = mapping.select(F.col("src").alias(column), F.col("dst").alias("_to"))
    return df.join(m, column, "left").withColumn(name, F.coalesce("_to", F.col(column))).drop("_to")


def components(pairs: DataFrame, nodes: DataFrame, threshold: float, min_size: int = 1) -> DataFrame:
    """(node, hub): connected components of ``pairs(src, dst, value)`` at value >= threshold.

    Every node takes the smallest label around it and then that label's own label, until nothing changes; the label jump
    makes the number of rounds logarithmic in practice. Components below ``min_size`` fall apart into single nodes. Hubs are
    numbered in the order of their smallest node.
    """
    link = pairs.where((F.col("value") >= threshold) & (F.col("src") != F.col("dst"))).select("src", "dst")
    edges = cut_lineage(link.unionByName(link.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    state = held = cut_lineage(nodes.select(F.col("node"), F.col("node").alias("lab")))
    while True:
        around = (
            edges.join(state.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("lab").alias("low"))
        )
        lowered = state.join(around, "node", "left").select(
            "node", "lab", F.least("lab", F.coalesce("low", F.col("lab"))).alias("new")
        )
        lowered, before = cut_lineage(lowered), held
        jump = lowered.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = cut_lineage(
            lowered.join(jump, "new", "left").select("node", F.col("lab").alias("old"), F.least("new", "far").alias("lab"))
        )
        changed = nxt.where("lab <> old").limit(1).count()
        state, held = nxt.select("node", "lab"), nxt
        forget(before)
        forget(lowered)
        if not changed:
            break
    size = state.groupBy("lab").agg(F.count(F.lit(1)).alias("_n"))
    final = state.join(size, "lab").select(
        "node", F.when(F.col("_n") >= max(1, min_size), F.col("lab")).otherwise(F.col("node")).alias("root")
    )
    from tilewright.operators.ordered import running

    roots = final.select("root").distinct().withColumn("_1", F.lit(1))
    ids = running(roots, [], "root", {"hub": ("sum", "_1")}).select("root", (F.col("hub") - 1).alias("hub"))
    return final.join(ids, "root").select("node", "hub")


def fused_similarity(
    center: DataFrame, transition: DataFrame, enrichment: DataFrame, responder: DataFrame, resp_weight: float = 0.1
) -> DataFrame:
    """(src, dst, value): weighted mean of centre cosine, min-max transition, sigmoid enrichment and responder agreement,
    each made symmetric and kept in [0, 1]; diagonal 1."""
    ext = transition.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("x")).scalar()
    span = F.col("_x.hi") - F.col("_x.lo")
    scaled = transition.withColumn("_x", ext).select(
        "src", "dst", F.when(span > 0, (F.col("value") - F.col("_x.lo")) / span).otherwise(F.lit(0.0)).alias("t")
    )
    j = (
        center.select("src", "dst", ((F.greatest(F.least("value", F.lit(1.0)), F.lit(-1.0)) + 1) / 2).alias("c"))
        .join(scaled, ["src", "dst"], "left")
        .join(enrichment.select("src", "dst", F.col("value").alias("e")), ["src", "dst"], "left")
        .join(responder.select(F.col("prototype_id").alias("src"), F.col("r").alias("rs")), "src", "left")
        .join(responder.select(F.col("prototype_id").alias("dst"), F.col("r").alias("rd")), "dst", "left")
        .fillna(0.0, ["t", "e"])
        .fillna(0.5, ["rs", "rd"])
    )
    w = [0.35, 0.30, 0.25, float(resp_weight)]
    total = sum(w)
    raw = j.select(
        "src",
        "dst",
        "c",
        "t",
        (1 / (1 + F.exp(-F.col("e")))).alias("e"),
        (1 - F.abs(F.col("rs") - F.col("rd"))).alias("p"),
    )
    flip = raw.select(F.col("src").alias("dst"), F.col("dst").alias("src"), *[F.col(c).alias(f"{c}2") for c in "ctep"])
    both = raw.join(flip, ["src", "dst"])
    mean = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) + F.col(f"{c}2")) / 2))
    value = (w[0] * mean("c") + w[1] * mean("t") + w[2] * mean("e") + w[3] * mean("p")) / total
    return both.select("src", "dst", F.when(F.col("src") == F.col("dst"), F.lit(1.0)).otherwise(value).alias("value"))


def adjusted_rand(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labellings per key, from the weighted contingency counts."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    c = df.groupBy(*keys, a, b).agg(n.alias("n"))
    two = lambda x: x * (x - 1) / 2
    pair = lambda t, by: t.groupBy(*keys, *by).agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n")
    )
    both = pair(c, [a, b]).select(*keys, F.col("s").alias("sij"), "n")
    rows = pair(c, [a]).select(*keys, F.col("s").alias("si"))
    cols = pair(c, [b]).select(*keys, F.col("s").alias("sj"))
    j = both.join(rows, list(keys)).join(cols, list(keys))
    expect = F.col("si") * F.col("sj") / two(F.col("n"))
    top = (F.col("si") + F.col("sj")) / 2 - expect
    return j.select(*keys, F.when(top == 0, F.lit(1.0)).otherwise((F.col("sij") - expect) / F.when(top != 0, top)).alias("ari"))


def _nearest(centers: Sequence[Sequence[float]]) -> Column:
    """Squared distances of ``u`` to each centre, as an array."""
    away = [F.aggregate(F.zip_with("u", F.lit(list(c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v) for c in centers]
    return F.array(*away)


def _seeds(unit: DataFrame, node: str, k: int, start: int, passes: int, seed: int) -> list[list[float]]:
    """First centres by oversampling (k-means||): from one hashed vector on, every pass takes each vector with a probability
    in proportion to its squared distance to what was taken, 2k in expectation, and the few candidates are thinned to k by
    the vectors that they stand for: the next is the one with the largest weight times squared distance."""
    from tilewright.operators.sampling import _SPACE, draw_key, draw_number

    taken = [list(r["u"]) for r in unit.orderBy(draw_key([node], seed, f"s{start}"), node).limit(1).collect()]
    if not taken:
        return []
    for p in range(passes):
        far = unit.withColumn("_d", F.array_min(_nearest(taken)))
        total = far.agg(F.sum("_d")).first()[0] or 0.0
        if total <= 0:
            break
        u = draw_number([node], seed, f"s{start}p{p}") / F.lit(float(_SPACE))
        taken += [list(r["u"]) for r in far.where(u < 2.0 * k * F.col("_d") / total).orderBy(node).select("u").collect()]  # about 2k rows
    near = unit.select(_nearest(taken).alias("d"))
    counts = near.groupBy(F.array_position("d", F.array_min("d")).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    weight = {r["at"] - 1: r["n"] for r in counts}
    square = lambda a, b: sum((x - y) * (x - y) for x, y in zip(a, b))
    chosen: list[int] = []
    while len(chosen) < min(k, len(taken)):
        score = lambda c: weight.get(c, 0) * (min(square(taken[c], taken[o]) for o in chosen) if chosen else 1.0)
        chosen.append(max((c for c in range(len(taken)) if c not in chosen), key=lambda c: (round(score(c), 9), -c)))
    return [taken[c] for c in chosen]


def kmeans_centers(
    df: DataFrame, k: int, rounds: int = 10, vector: str = "embedding", node: str = "vec_id", starts: int = 2, passes: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(k, vec): centres of the unit vectors after ``rounds`` of Lloyd's algorithm, from the start with the least inertia.

    Each start takes its first centres by hashed oversampling (``passes`` over the rows), so the outcome is fixed; a vector
    goes to the nearest centre, the lowest number on a tie, and a centre without vectors stays. Each round is one aggregate
    of k rows; the driver holds centres and candidates alone. Fewer distinct vectors than ``k`` give fewer centres.
    """
    unit = cut_lineage(df.where(F.col(vector).isNotNull()).select(node, A.l2_normalize(F.col(vector)).alias("u")))
    best: tuple[float, list] = (float("inf"), [])
    for start in range(starts):
        centers = _seeds(unit, node, k, start, passes, seed)
        if not centers:
            break
        for _ in range(rounds):
            near = unit.select("u", _nearest(centers).alias("d")).select("u", F.array_position("d", F.array_min("d")).alias("at"))
            for r in near.groupBy("at").agg(*[F.avg(F.col("u")[i]) for i in range(len(centers[0]))]).collect():
                centers[r[0] - 1] = list(r[1:])
        inertia = round(unit.agg(F.sum(F.array_min(_nearest(centers)))).first()[0], 9)
        if inertia < best[0]:
            best = inertia, centers
    return df.sparkSession.createDataFrame(list(enumerate(best[1])), "k int, vec array<double>")
