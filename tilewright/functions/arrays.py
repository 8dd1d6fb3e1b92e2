"""Vectors as array Columns: products, normalisation, soft assignment, encodings, polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    """x / (|x| + eps), the length computed once per vector."""
    return F.element_at(
        F.transform(F.array(norm(v) + F.lit(eps)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1
    )


def cosine(a: Column, b: Column, eps: float = 1e-8, clip: bool = False) -> Column:
    c = dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) if clip else c


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays."""
    centred = lambda v: F.transform(v, lambda x: x.cast("double") - total(v) / F.size(v))
    return dot(centred(a), centred(b)) / (norm(centred(a)) * norm(centred(b)))


def tempered_softmax(scores: Column, tau: float, eps: float = 1e-8) -> Column:
    """exp(s / tau) / (sum + eps); scores are cosines, so no shift is needed. tau is at least 1e-6."""
    e = F.transform(scores, lambda s: F.exp(s / F.lit(max(float(tau), 1e-6))))
    return F.element_at(
        F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / (total(v) + F.lit(eps)))), 1
    )


def shannon(p: Column) -> Column:
    """Entropy in nats of clipped, renormalised weights; nothing left gives 0."""
    w = F.transform(p, lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    t = total(w)
    h = F.aggregate(w, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / t * F.ln(x / t)).otherwise(F.lit(0.0)))
    return F.when(t > 0, h).otherwise(F.lit(0.0))


def argmax(v: Column) -> Column:
    """Index of the first maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax shifted by the maximum."""
    t = F.lit(max(float(temperature), 1e-6))
    e = F.transform(F.array(scores), lambda v: F.transform(v, lambda s: F.exp((s - F.array_max(v)) / t)))
    return F.element_at(F.transform(e, lambda v: F.transform(v, lambda x: x / total(v))), 1)


def one_hot(c: Column, categories: Sequence[str]) -> Column:
    """Indicator array over fixed categories; an unseen non-null value is an error."""
    flags = F.array(*[(c == F.lit(k)).cast("double") for k in categories])
    return F.when(c.isin(list(categories)), flags).otherwise(
        F.raise_error(F.concat(F.lit("category outside the fixed list: "), F.coalesce(c, F.lit("null"))))
    )


def from_one_hot(flags: Column, categories: Sequence[str]) -> Column:
    """Category of the largest flag, the first on a tie."""
    return F.element_at(F.array(*[F.lit(k) for k in categories]), argmax(flags) + 1)


def offset_feature(x1: Column, y1: Column, x2: Column, y2: Column, width: int) -> Column:
    """(x2 - x1, y2 - y1) padded with zeros or cut to ``width`` entries."""
    return F.slice(F.concat(F.array(x2 - x1, y2 - y1), F.array_repeat(F.lit(0.0), width)), 1, width)


def sinusoidal(x: Column, y: Column, dim: int, base: float = 10000.0) -> Column:
    """2-D position encoding: sine and cosine interleaved, the first half from x, the second from y."""
    if dim % 2:
        raise ValueError("the encoding width must be even")
    half = dim // 2

    def axis(c: Column) -> Column:
        steps = F.sequence(F.lit(0), F.lit(half - 1))

        def entry(i: Column) -> Column:
            angle = c * F.exp((i - i % 2) * F.lit(-1.0) * F.ln(F.lit(base)) / half)
            return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

        return F.transform(steps, entry)

    return F.concat(axis(x), axis(y))


def polygon_centroid(ring: Column) -> Column:
    """Area-weighted centroid (x, y) of a ring of points; the vertex mean if the area vanishes; null below 3 points."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    area = total(F.zip_with(ring, nxt, cross)) / 2
    mx = total(F.zip_with(ring, nxt, lambda p, q: (p["x"] + q["x"]) * cross(p, q)))
    my = total(F.zip_with(ring, nxt, lambda p, q: (p["y"] + q["y"]) * cross(p, q)))
    flat = F.abs(area) < 1e-6
    mean = lambda axis: total(F.transform(ring, lambda p: p[axis])) / F.size(ring)
    return F.when(
        F.size(ring) >= 3,
        F.struct(
            F.when(flat, mean("x")).otherwise(mx / (6 * area)).alias("x"),
            F.when(flat, mean("y")).otherwise(my / (6 * area)).alias("y"),
        ),
    )


def best_other_margin(v: Column, index: int) -> Column:
    """v[index] minus the largest other entry."""
    others = F.filter(v, lambda x, i: i != index)
    return F.get(v, F.lit(index)) - F.array_max(others)
