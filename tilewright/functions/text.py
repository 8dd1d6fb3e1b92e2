"""Identifiers, gene symbols, labels: string Columns to clean Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of a missing cell type, and the values counted as a response by default.
MISSING_TYPES = ["", "nan", "None", "NA", "N/A", "NULL"]
DEFAULT_POSITIVES = ["responder", "1", "true", "positive"]

# Published cell-type names and their macro class.
MACRO_CLASS = {
    "Connective": [
        "CAFs MSC iCAF-like s1", "CAFs MSC iCAF-like s2", "CAFs Transitioning s3", "CAFs myCAF like s4",
        "CAFs myCAF like s5", "Cycling PVL", "Endothelial ACKR1", "Endothelial CXCL12",
        "Endothelial Lymphatic LYVE1", "Endothelial RGS5", "Myoepithelial", "PVL Differentiated s3",
        "PVL Immature s1", "PVL_Immature s2",
    ],
    "Inflammatory": [
        "B cells Memory", "B cells Naive", "Cycling_Myeloid", "Myeloid_c0_DC_LAMP3",
        "Myeloid_c10_Macrophage_1_EGR1", "Myeloid_c11_cDC2_CD1C", "Myeloid_c12_Monocyte_1_IL1B",
        "Myeloid_c1_LAM1_FABP5", "Myeloid_c2_LAM2_APOE", "Myeloid_c3_cDC1_CLEC9A", "Myeloid_c4_DCs_pDC_IRF7",
        "Myeloid_c5_Macrophage_3_SIGLEC1", "Myeloid_c7_Monocyte_3_FCGR3A", "Myeloid_c8_Monocyte_2_S100A9",
        "Myeloid_c9_Macrophage_2_CXCL10", "Plasmablasts", "T_cells_c0_CD4+_CCR7", "T_cells_c10_NKT_cells_FCGR3A",
        "T_cells_c11_MKI67", "T_cells_c1_CD4+_IL7R", "T_cells_c2_CD4+_T-regs_FOXP3", "T_cells_c3_CD4+_Tfh_CXCL13",
        "T_cells_c4_CD8+_ZFP36", "T_cells_c5_CD8+_GZMK", "T_cells_c6_IFIT1", "T_cells_c7_CD8+_IFNG",
        "T_cells_c8_CD8+_LAG3", "T_cells_c9_NK_cells_AREG",
    ],
    "Epithelial": ["Luminal Progenitors", "Mature Luminal"],
    "Neoplastic": ["Cancer Basal SC", "Cancer Cycling", "Cancer Her2 SC", "Cancer LumA SC", "Cancer LumB SC"],
}

# Keywords of the macro class of a name that is not listed, tried in this order.
MACRO_KEYWORDS = [
    ("Neoplastic", "tumou|tumor|malig|carcin|neoplas"),
    ("Epithelial", "epi|duct|luminal|basal|keratin"),
    ("Connective", "fibro|stromal|endo|endothelial|pericyte|connect"),
    ("Inflammatory", "t cell|b cell|myeloid|mono|macro|dend|nk|mast|plasma|immune"),
    ("Dead", "dead|apop|debris"),
]


def canon_id(c: Column) -> Column:
    """Trim and drop leading zeros; all zeros give "0", blank stays blank."""
    s = F.trim(c)
    z = F.regexp_replace(s, "^0+", "")
    return F.when((z == "") & (s != ""), "0").otherwise(z)


def zero_pad(c: Column, width: int = 3) -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def cohort_key(c: Column) -> Column:
    """Whitespace removed, lower case; blank gives null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit(""))


def file_token(c: Column) -> Column:
    """Runs of characters unsafe in a file name become "_"; empty gives "sample"."""
    token = F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("sample"))


def name_variants(c: Column) -> Column:
    """Distinct spellings of a sample name: as is, without spaces, "_" as "-", "-" as "_"."""
    s = F.trim(c)
    made = F.array(s, F.replace(s, F.lit(" "), F.lit("")), F.replace(s, F.lit("_"), F.lit("-")),
                   F.replace(s, F.lit("-"), F.lit("_")))
    return F.array_distinct(F.filter(made, lambda v: v != ""))


def gene_symbol(c: Column) -> Column:
    """Upper case, letters, digits, "_", "." and "-" only."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9_.-]", "")


def gene_symbol_base(c: Column) -> Column:
    """Cut at the first ".", keep letters, digits and "-", upper case; null gives ""."""
    base = F.split_part(F.trim(c), F.lit("."), F.lit(1))
    return F.coalesce(F.upper(F.regexp_replace(base, "[^A-Za-z0-9-]", "")), F.lit(""))


def gene_prefix(c: Column) -> Column:
    """Leading run of capitals, digits, "." and "-"; the value itself where there is none."""
    m = F.regexp_extract(c, r"^[A-Z0-9.\-]+", 0)
    return F.when(m != "", m).otherwise(c)


def clean_gene(c: Column) -> Column:
    """Drop an ENSG suffix and everything after "|", trim, upper case; blank gives null."""
    s = F.regexp_replace(c, r"(\||_|\()+ENSG[0-9]+(\.[0-9]+)?\)?$", "")
    s = F.regexp_replace(s, r"ENSG[0-9]+(\.[0-9]+)?$", "")
    s = F.trim(F.regexp_replace(s, r"\|.*$", ""))
    return F.nullif(F.upper(s), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of whitespace, also no-break spaces, become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, "[\\s ]+", " "))


def prototype_name(c: Column) -> Column:
    """``Prototype<k>`` from the first integer in the text, else null."""
    k = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(k != "", F.concat(F.lit("Prototype"), k))


def prototype_index(c: Column) -> Column:
    """All digits of the text as an integer, null where there are none."""
    return F.regexp_replace(c, r"\D", "").try_cast("int")


def mapped_gene(c: Column, names: Column) -> Column:
    """``gene_expr_<i>`` or bare digits become entry i of a name map; without an entry the canonical symbol."""
    i = F.coalesce(F.nullif(F.regexp_extract(c, r"^gene_expr_(\d+)$", 1), F.lit("")),
                   F.nullif(F.regexp_extract(c, r"^(\d+)$", 1), F.lit("")))
    hit = F.try_element_at(names, i.try_cast("int"))
    return F.when(i.isNull(), c).otherwise(F.coalesce(hit, gene_symbol_base(c)))


def strip_barcode(c: Column) -> Column:
    return F.regexp_replace(c, "-1$", "")


def response_label(c: Column, prefix: str = r"^pcr:\s*", yes: str = "^(yes|y|pcr)$", no: str = "^(no|n|nonpcr)$") -> Column:
    """Phenotype text to pCR / non_pCR: strip the prefix, cut at the first separator, match whole words."""
    v = F.regexp_replace(F.lower(c), prefix, "")
    v = F.trim(F.regexp_replace(v, "[;|,].*$", ""))
    return F.when(v.rlike(yes), "pCR").when(v.rlike(no), "non_pCR")


def stem_parts(c: Column) -> Column:
    """``<sample...>_<x>_<y>`` to a struct (sample, x, y); x and y null where malformed."""
    t = F.split(c, "_")
    n = F.size(t)
    return F.struct(
        F.when(n >= 3, F.array_join(F.slice(t, 1, F.greatest(n - 2, F.lit(0))), "_")).alias("sample"),
        F.when(n >= 3, F.try_element_at(t, F.lit(-2)).try_cast("int")).alias("x"),
        F.when(n >= 3, F.try_element_at(t, F.lit(-1)).try_cast("int")).alias("y"),
    )


def attribute_map(c: Column) -> Column:
    """``key "value"; ...`` to a map, the last entry of a repeated key winning."""
    fields = F.filter(F.transform(F.split(c, ";"), lambda f: F.trim(f)), lambda f: F.instr(f, " ") > 0)
    pairs = F.transform(
        fields,
        lambda f: F.struct(
            F.substring_index(f, " ", 1).alias("key"),
            F.regexp_replace(F.trim(F.regexp_replace(f, "^[^ ]+ ", "")), '^"+|"+$', "").alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(last)


def without_version(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def cell_type(c: Column) -> Column:
    """Trimmed; any spelling of "missing" gives Unknown."""
    s = F.trim(c)
    return F.when(s.isNull() | s.isin(MISSING_TYPES), "Unknown").otherwise(s)


def label_value(c: Column, mapping: dict[str, int] | None = None, positives: Sequence[str] = tuple(DEFAULT_POSITIVES)) -> Column:
    """Label text to an integer: a mapping with its "default", else a number, else membership in the positives."""
    s = F.trim(c)
    if mapping:
        table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
        return F.coalesce(F.try_element_at(table, s), F.lit(int(mapping.get("default", 0))))
    hits = [str(p).strip().lower() for p in positives]
    return F.coalesce(s.try_cast("double").cast("int"), F.lower(s).isin(hits).cast("int"))


def macro_class(c: Column) -> Column:
    """Listed cell-type name to its macro class, else by keyword, else Unknown."""
    entries = [F.lit(v) for macro, names in MACRO_CLASS.items() for n in names for v in (n, macro)]
    out = F.lit("Unknown")
    for macro, pattern in reversed(MACRO_KEYWORDS):
        out = F.when(F.lower(c).rlike(pattern), macro).otherwise(out)
    return F.coalesce(F.try_element_at(F.create_map(*entries), c), out)


def expand_templates(classes: Column, templates: Column) -> Column:
    """Every class name put into every template in place of CLASSNAME."""
    return F.flatten(
        F.transform(classes, lambda n: F.transform(templates, lambda t: F.replace(t, F.lit("CLASSNAME"), n)))
    )


def contrasts_long(df: DataFrame, keys: list[str], contrasts: list[str]) -> DataFrame:
    """(keys, contrast, log2fc, direction): a row per contrast; ``core_vs_edge`` also comes negated as ``edge_vs_core``."""
    both = {"edge_vs_core": -F.col("core_vs_edge")} if "core_vs_edge" in contrasts else {}
    long = df.withColumns(both).unpivot(keys, [*contrasts, *both], "contrast", "log2fc")
    sign = F.when(F.col("log2fc") > 0, "up").when(F.col("log2fc") < 0, "down").otherwise("none")
    return long.withColumn("direction", sign)
