"""Centroid clustering whose bounds loosen by geometry, not by whole drifts.

Every vector carries its centroid's number, an upper bound of the distance to it and a lower bound of the distance to all
others. When centroids move, the lower bound has to shrink by what the others may have come nearer. A vector lies in the sphere
around its old centroid that holds the cluster, so a moved centroid is seen from its old place under an angle of at least that
of the sphere's edge; only the part of the drift in that direction counts (in the plane through the sphere's centre and the
drift), which is less than the drift and may even be an increase. Vectors whose bounds still cross are scanned exactly, in
integers. The bounds decide which vectors are scanned, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, give_back, only
from tilewright.session import forget

#: Bounds are doubles; they give way by this share so that rounding never decides.
SLACK = 1e-9
#: Scaled components beyond this could make a squared distance of 64 of them overflow 64 bits.
LARGEST = 1 << 27
ROWS = 4096
STATE = "vec_id {}, v array<bigint>, cluster int, moved_from int, upper double, lower double, scanned boolean"


@dataclass
class Shift:
    """What a round needs: the centroids, how far each moved, and how much the lower bound of a cluster's vectors gives way."""

    centroids: np.ndarray
    drift: np.ndarray | None = None
    loosen: np.ndarray | None = None


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    return np.stack([np.square(v - c).sum(axis=1) for c in centroids], axis=1)


def approach(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[a, j]: by how much centroid j may have come nearer to a vector within ``radius[a]`` of old centroid a.

    With x a vector and p a point that moves along the drift, the distance changes at the cosine of the angle between the
    drift and x - p, which falls as p moves on. At the old place that angle is at least the one to the sphere's centre less
    the sphere's angular radius.
    """
    old, new = old.astype("f8"), new.astype("f8")
    move = new - old
    drift = np.sqrt(np.square(move).sum(axis=1))
    to = old[:, None, :] - old[None, :, :]  # from centroid j to the centre of cluster a
    away = np.sqrt(np.square(to).sum(axis=2))
    with np.errstate(invalid="ignore", divide="ignore"):
        angle = np.arccos(np.clip((to * move[None]).sum(axis=2) / (away * drift[None]), -1, 1))
        seen = np.arcsin(np.clip(radius[:, None] / away, 0, 1))
        part = np.where(radius[:, None] < away, np.cos(np.maximum(angle - seen, 0)), 1.0)
    return np.where(drift[None] > 0, drift[None] * np.minimum(part + SLACK, 1), 0.0)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much the lower bound of each cluster's vectors gives way: the nearest approach of any other centroid."""
    near = approach(old, new, radius)
    np.fill_diagonal(near, -np.inf)
    return near.max(axis=1) if len(old) > 1 else np.zeros(1)


def assign(v: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, shift: Shift) -> tuple:
    """(cluster, upper, lower, scanned) of some vectors after a shift. Without earlier clusters all are scanned."""
    n = len(v)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, "i4"), np.full(n, np.inf), np.zeros(n)
    else:
        upper = (upper + shift.drift[cluster]) * (1 + SLACK)
        gives = shift.loosen[cluster]
        lower = np.maximum(lower - gives - SLACK * (np.abs(lower) + np.abs(gives)), 0)
    doubt = np.flatnonzero(~(upper < lower))
    own = np.sqrt(np.square(v[doubt] - shift.centroids[cluster[doubt]]).sum(axis=1).astype("f8"))
    upper[doubt] = own * (1 + SLACK)  # an exact distance often settles it
    doubt = doubt[~(upper[doubt] < lower[doubt])]
    for part in (doubt[i : i + ROWS] for i in range(0, len(doubt), ROWS)):
        d = squared(v[part], shift.centroids)
        best = d.argmin(axis=1)  # the first of equal ones
        at = np.arange(len(part))
        cluster[part], upper[part] = best, np.sqrt(d[at, best].astype("f8")) * (1 + SLACK)
        d = d.astype("f8")
        d[at, best] = np.inf
        lower[part] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
    scanned = np.zeros(n, bool)
    scanned[doubt] = True
    return cluster, upper, lower, scanned


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def assigned(state: DataFrame, shift: Shift, width: int) -> DataFrame:
    """One round over all vectors, each in its partition."""
    first = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), width)
            if np.abs(v).max() > LARGEST:
                raise ValueError(f"a scaled component lies beyond {LARGEST}: squared distances would overflow")
            before = None if first else b.column(2).to_numpy().copy()
            bounds = [None, None] if first else [b.column(i).to_numpy().copy() for i in (4, 5)]
            cluster, upper, lower, scanned = assign(v, None if first else before.copy(), *bounds, shift)
            moved = np.ones(len(v), bool) if first else cluster != before
            came_from = pa.array(np.zeros(len(v), "i4") - 1 if first else before, mask=~moved)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cluster.astype("i4")), came_from, pa.array(upper), pa.array(lower),
                 pa.array(scanned)],
                ["vec_id", "v", "cluster", "moved_from", "upper", "lower", "scanned"],
            )
        give_back()

    return state.mapInArrow(run, STATE.format(dict(state.dtypes)["vec_id"]))


def moved_sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of each cluster's component sums and of its size: only vectors that changed their cluster are read."""
    moved = state.where("moved_from is not null")
    signed = moved.select("v", F.explode(F.array(
        F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")),
        F.struct(F.col("moved_from").alias("c"), F.lit(-1).alias("sign")),
    )).alias("x")).where("x.c >= 0")
    sums = [F.sum(F.col("v")[i] * F.col("x.sign")).alias(f"s{i}") for i in range(width)]
    change, size = np.zeros((k, width), "i8"), np.zeros(k, "i8")
    for row in signed.groupBy("x.c").agg(F.sum("x.sign").alias("n"), *sums).collect():  # k rows
        size[row[0]], change[row[0]] = row[1], row[2:]
    return change, size


def radii(state: DataFrame, k: int) -> np.ndarray:
    """Radius of the sphere that holds each cluster, from the upper bounds."""
    out = np.zeros(k)
    for c, r in state.groupBy("cluster").agg(F.max("upper")).collect():  # k rows
        out[c] = r
    return out


def scaled(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors of exactly ``width`` finite components, as integers."""
    rows = only(df, vec_id=id_col, e=vector_col)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("e") == width) & finite).select("vec_id", scaled(F.col("e"), scale).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in that order; rows without an id come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], "i8")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
            width: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(state, centroids, scans): every kept vector with its ``cluster`` and exact ``distance`` (squared) under the last
    centroids, these centroids, and how many vectors each assignment scanned.

    Vectors that are null, have another width or hold null or non-finite components take no part; the others keep their id,
    null included, and repeated rows each count. Components become floor(scale * x). Ties go to the smaller number; empty
    clusters keep their centroid; with fewer than ``k`` vectors there are as many centroids as vectors; an empty table gives
    no rows and no centroids. Components of more than 2**27 after scaling are an error. Every round reads the vectors with
    their bounds once and writes them once, without a shuffle; sums are updated from the vectors that moved.
    """
    state = kept_vectors(df, id_col, vector_col, width, scale)
    centroids = starts(state, k, seed)
    if not len(centroids):
        empty = state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.where("false"), centroids, []
    shift, scans = Shift(centroids), []
    total, size = np.zeros((len(centroids), width), "i8"), np.zeros(len(centroids), "i8")
    for i in range(rounds + 1):
        new = fresh(assigned(state, shift, width), "clusters")
        if i:
            forget(state)
        state = new
        scans.append(state.where("scanned").count())
        if i == rounds:
            break
        change, more = moved_sums(state, len(centroids), width)
        total, size = total + change, size + more
        moved = centroids.copy()
        used = size > 0
        moved[used] = total[used] // size[used, None]
        drift = np.sqrt(np.square((moved - centroids).astype("f8")).sum(axis=1)) * (1 + SLACK)
        shift = Shift(moved, drift, loosening(centroids, moved, radii(state, len(centroids)) * (1 + SLACK)))
        centroids = moved
    away = F.zip_with("v", _of_cluster(centroids), lambda a, b: (a - b) * (a - b))
    exact = F.aggregate(away, F.lit(0).cast("long"), lambda s, x: s + x)
    return state.select("vec_id", "cluster", exact.alias("distance")), centroids, scans


def _of_cluster(values: np.ndarray) -> Column:
    """The value of each row's cluster, out of one per cluster (k literals)."""
    literal = lambda x: F.array(*[F.lit(int(i)).cast("long") for i in x]) if np.ndim(x) else F.lit(x)
    return F.array(*[literal(v) for v in values])[F.col("cluster")]


def clustered(df: DataFrame, **settings) -> DataFrame:
    """Per kept vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``, the
    digest of the final centroid's components. Settings and edge cases are those of :func:`cluster`."""
    from hashlib import sha256

    state, centroids, _ = cluster(df, **settings)
    found = fresh(state, "assigned")
    sums = {c: s for c, s in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows
    per_cluster = [sums.get(c, 0) for c in range(len(centroids))] or [0]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.array(*[F.lit(s).cast("long") for s in per_cluster])[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(per_cluster)).cast("long").alias("inertia"),
        F.array(*[F.lit(d) for d in digests])[F.col("cluster")].alias("centroid_sha256"),
    )


def clusters_sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same over the table ``embeddings``: every round scans all distances."""
    d2 = "list_sum(list_transform(list_zip(r.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    near = """select rid, {d2} as d, c.k from rows_ r, c{i} c
    qualify row_number() over (partition by rid order by {d2}, c.k) = 1"""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized ({near.format(d2=d2, i=i)})")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
  select c.k, coalesce(n.m, c.m) as m from c{i} c left join (
    select k, list(m order by j) as m from (
      select a.k, j, floor_div(sum(r.v[j]), count(*)) as m from a{i} a join rows_ r using (rid), range(1, {width + 1}) t(j)
      group by a.k, j) group by k) n on c.k = n.k)""")
    steps = ",\n".join(steps).replace(
        "floor_div(sum(r.v[j]), count(*))",
        "((sum(r.v[j]) - ((sum(r.v[j]) % count(*)) + count(*)) % count(*)) // count(*))::bigint",
    )
    return f"""
with rows_ as materialized (
  select row_number() over () as rid, vec_id,
    list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
c0 as materialized (
  select (row_number() over (order by h, v) - 1)::int as k, v as m from (
    select sha256('{seed}:' || vec_id) as h, v from rows_ order by h nulls last, v limit {k})),
{steps}
select r.vec_id, a.k as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia,
  (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.m, ',')) as centroid_sha256
from a{rounds} a join rows_ r using (rid) join c{rounds} c on a.k = c.k
"""
