"""Discrete-time hazards as array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v.cast("double"))))


def time_bin(t: Column, edges: Column) -> Column:
    """Edges (all but the last) strictly below t, minus one, kept within the bins."""
    inner = F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(1)))
    below = F.size(F.filter(inner, lambda e: e < t)) - 1
    return F.least(F.greatest(below, F.lit(0)), F.size(edges) - 2)


def log_likelihood(hazards: Column, bin_id: Column, event: Column, eps: float = 1e-7) -> Column:
    """Event: survival of the earlier bins and the hazard of its own; censored: survival through its own bin."""
    surv = F.transform(hazards, lambda h: F.ln(F.lit(1.0) - h + F.lit(eps)))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    before = add(F.slice(surv, 1, bin_id))
    at = F.ln(F.element_at(hazards, bin_id + 1) + F.lit(eps))
    return F.when(event == 1, before + at).otherwise(add(F.slice(surv, 1, bin_id + 1)))


def _survive(hazards: Column) -> Column:
    return F.aggregate(hazards, F.lit(1.0), lambda s, h: s * (F.lit(1.0) - h))


def _cuminc(hazards: Column) -> Column:
    return F.lit(1.0) - _survive(hazards)


def _cumhaz(hazards: Column) -> Column:
    return F.aggregate(hazards, F.lit(0.0), lambda s, h: s - F.ln(F.lit(1.0) - h + F.lit(1e-6)))


def _exp_time(hazards: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("t"), F.lit(0.0).alias("i"))
    walked = F.aggregate(
        hazards,
        start,
        lambda a, h: F.struct(
            (a["s"] * (F.lit(1.0) - h)).alias("s"),
            (a["t"] + h * a["s"] * a["i"]).alias("t"),
            (a["i"] + F.lit(1.0)).alias("i"),
        ),
    )
    return -walked["t"]


RISK_MODES = {"cuminc": _cuminc, "cumhaz": _cumhaz, "exp_time": _exp_time}


def risk(hazards: Column, mode: str = "cumhaz") -> Column:
    """One risk number per hazard array; see ``RISK_MODES``."""
    return RISK_MODES[mode](hazards)
