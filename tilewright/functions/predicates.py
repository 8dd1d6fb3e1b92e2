"""Boolean Columns over a cell's neighbour-share array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.arrays import best_other_margin


def share(mix: Column, k: int | Column) -> Column:
    return F.coalesce(F.get(mix, k if isinstance(k, Column) else F.lit(k)), F.lit(0.0))


def is_core(mix: Column, k: int, core: float = 0.7, margin: float = 0.12) -> Column:
    """Share of k at least ``core`` and ahead of every other share by ``margin``."""
    return (share(mix, k) >= core) & (best_other_margin(mix, k) >= margin)


def interface_strength(mix: Column, i: int | Column, j: int | Column) -> Column:
    return F.least(share(mix, i), share(mix, j))


def is_interface(mix: Column, i: int | Column, j: int | Column, threshold: float = 0.4) -> Column:
    return interface_strength(mix, i, j) >= threshold


def is_pair_core(mix: Column, i: int | Column, j: int | Column, core: float, interface: float) -> Column:
    """One side dominates and the other stays below the interface level."""
    a, b = share(mix, i), share(mix, j)
    return ((a >= core) & (b <= 1 - interface)) | ((b >= core) & (a <= 1 - interface))


def is_balanced(mix: Column, i: int | Column, j: int | Column, delta: float) -> Column:
    return F.abs(share(mix, i) - share(mix, j)) <= delta


def zone(prototype: Column, mix: Column, core: float) -> Column:
    """core where the cell's own prototype has a share of at least ``core``, else edge."""
    own = F.coalesce(F.get(mix, prototype), F.lit(0.0))
    return F.when(own >= core, "core").otherwise("edge")
