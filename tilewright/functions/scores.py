"""Small numeric and labelling expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_fold(a: Column, b: Column, eps: float) -> Column:
    return F.log2((a + F.lit(eps)) / (b + F.lit(eps)))


def soften(x: Column, temperature: float) -> Column:
    """sign(x) * (|x| + 1e-8) ** (1 / temperature)."""
    return F.signum(x) * F.pow(F.abs(x) + F.lit(1e-8), F.lit(1.0 / max(1e-6, float(temperature))))


def clip01(x: Column, low: Column, high: Column, floor: float = 1e-6) -> Column:
    """(x - low) / (high - low) with the width at least ``floor``, kept within [0, 1]."""
    return F.least(F.greatest((x - low) / F.greatest(high - low, F.lit(floor)), F.lit(0.0)), F.lit(1.0))


def stretch01(x: Column, low: Column, high: Column) -> Column:
    """As ``clip01`` for the (2, 98) percentiles; a collapsed range gives 0, or x over its upper end if that is not 0."""
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return (
        F.when((high - low < 1e-8) & (high == 0), F.lit(0.0))
        .when(high - low < 1e-8, inside(x / (high + F.lit(1e-8))))
        .otherwise(inside((x - low) / (high - low + F.lit(1e-8))))
    )


def rank_biserial(auc: Column) -> Column:
    return 2 * auc - 1


def stars(p: Column) -> Column:
    return (
        F.when(p.isNull() | F.isnan(p), "NA")
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .otherwise("ns")
    )


def direction(lfc: Column, up: Column | str, down: Column | str) -> Column:
    """Label by the sign of a fold change; zero and null give null."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(lfc > 0, lit(up)).when(lfc < 0, lit(down))


def spatial_label(best: Column, delta: float) -> Column:
    """Core / Edge / Interface / Other from the strongest core-minus-edge difference."""
    eps = max(0.05, delta / 2)
    return (
        F.when((F.abs(best) < delta) & (F.abs(best) >= eps), "Interface")
        .when(best >= delta, "Core")
        .when(best <= -delta, "Edge")
        .otherwise("Other")
    )


def to_level0(x: Column, downsample: Column | float, origin: Column | float = 0.0) -> Column:
    """Coordinate of a level to level 0: origin + x * downsample."""
    return F.lit(origin) + x * F.lit(downsample)


def from_level0(x: Column, downsample: Column | float) -> Column:
    return F.round(x / F.lit(downsample)).cast("long")


# Ligand-receptor axes and their (ligand, receptor) pairs.
LIGAND_RECEPTOR = {
    "IFN_axis": [("IFNG", "IFNGR1"), ("IFNG", "IFNGR2")],
    "TGFb_axis": [("TGFB1", "TGFBR1"), ("TGFB1", "TGFBR2"), ("TGFB3", "TGFBR1"), ("TGFB3", "TGFBR2")],
    "CXCL_axis": [("CXCL12", "CXCR4"), ("CXCL14", "CXCR4")],
    "EGFR_axis": [("EGF", "EGFR"), ("EREG", "EGFR")],
    "IL6_axis": [("IL6", "IL6R")],
    "CCL_axis": [("CCL5", "CCR1")],
    "CSF1_axis": [("CSF1", "CSF1R")],
    "SPP1_axis": [("SPP1", "ITGAV")],
    "VEGF_PGF_axis": [("VEGFA", "NRP1"), ("VEGFA", "NRP2"), ("PGF", "NRP1"), ("PGF", "NRP2")],
    "PDGF_axis": [("PDGFA", "PDGFRB")],
    "SLIT_ROBO_axis": [("SLIT2", "ROBO1")],
    "Immune_Adhesion_axis": [("ITGAL", "ICAM1"), ("ITGAL", "ICAM2")],
    "MIF_axis": [("MIF", "CD74")],
    "GRN_axis": [("GRN", "SORT1")],
}
