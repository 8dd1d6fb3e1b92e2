"""Queries: scalar functions applied to whole table columns."""

from pyspark.sql import functions as F

from tilewright.functions import arrays as A
from tilewright.functions import scores as S
from tilewright.functions import survival as V
from tilewright.functions import text as T
from tilewright.operators import ordered as O
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELL_TYPES, CELLS, MEASURES, PATIENTS, cells, measures, patients
from tilewright.session import load

_CANON = "case when trim({c}) <> '' and regexp_replace(trim({c}), '^0+', '') = '' then '0' else regexp_replace(trim({c}), '^0+', '') end"


@query(
    "F1 F2 F14 F18",
    f"""with s as (select c_custkey, ' ' || lpad((c_custkey % 1000)::varchar, 6, '0') || ' ' as raw,
      'ENSG' || c_custkey || '.' || c_nationkey as gene, c_name || '-1' as barcode from customer)
    select c_custkey, {_CANON.format(c='raw')} as id,
      case when length({_CANON.format(c='raw')}) < 3 then lpad({_CANON.format(c='raw')}, 3, '0')
        else {_CANON.format(c='raw')} end as padded,
      split_part(gene, '.', 1) as ensembl, regexp_replace(barcode, '-1$', '') as barcode from s""",
)
def identifier_cleanup(spark, sf):
    c = load(spark, sf, "customer")
    raw = F.concat(F.lit(" "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0"), F.lit(" "))
    return c.select(
        "c_custkey",
        T.canon_id(raw).alias("id"),
        T.zero_pad(T.canon_id(raw)).alias("padded"),
        T.without_version(F.concat(F.lit("ENSG"), F.col("c_custkey"), F.lit("."), F.col("c_nationkey"))).alias("ensembl"),
        T.strip_barcode(F.concat(F.col("c_name"), F.lit("-1"))).alias("barcode"),
    )


@query(
    "F4 F5 F6 F10",
    r"""with d as (select doc_id, lang || ' _' || source || '-A ' as raw, text from documents)
    select doc_id, nullif(lower(regexp_replace(raw, '\s+', '', 'g')), '') as cohort,
      coalesce(nullif(regexp_replace(trim(raw), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'sample') as token,
      array_to_string(list_sort(list_distinct([trim(raw), replace(trim(raw), ' ', ''), replace(trim(raw), '_', '-'),
        replace(trim(raw), '-', '_')])), '|') as variants,
      length(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) as n_squeezed from d""",
)
def name_cleanup(spark, sf):
    d = load(spark, sf, "documents")
    raw = F.concat(F.col("lang"), F.lit(" _"), F.col("source"), F.lit("-A "))
    return d.select(
        "doc_id",
        T.cohort_key(raw).alias("cohort"),
        T.file_token(raw).alias("token"),
        F.array_join(F.array_sort(T.name_variants(raw)), "|").alias("variants"),
        F.length(T.squeeze(F.col("text"))).cast("long").alias("n_squeezed"),
    )


_ENSG = r"""regexp_replace(regexp_replace(regexp_replace({c}, '(\||_|\()+ENSG[0-9]+(\.[0-9]+)?\)?$', ''), 'ENSG[0-9]+(\.[0-9]+)?$', ''), '\|.*$', '')"""


@query(
    "F7 F8 F9 F12 F13",
    rf"""with p as (select p_partkey, p_name, p_brand, p_name || '|ENSG' || p_partkey || '.2' as tagged,
      upper(left(p_name, 3)) || '.' || p_size || ' x' as sym,
      case when p_partkey % 3 = 0 then 'gene_expr_' || (p_partkey % 7) when p_partkey % 3 = 1 then (p_partkey % 7)::varchar
        else p_brand end as tok from part)
    select p_partkey, regexp_replace(upper(trim(p_brand)), '[^A-Z0-9_.-]', '', 'g') as symbol,
      upper(regexp_replace(split_part(trim(sym), '.', 1), '[^A-Za-z0-9-]', '', 'g')) as base,
      case when regexp_extract(sym, '^[A-Z0-9.\-]+') <> '' then regexp_extract(sym, '^[A-Z0-9.\-]+') else sym end as prefix,
      nullif(upper(trim({_ENSG.format(c='tagged')})), '') as clean,
      try_cast(regexp_replace(p_brand, '\D', '', 'g') as int) as idx,
      case when regexp_extract(tok, '^(gene_expr_)?(\d+)$', 2) = '' then tok
        else coalesce(map {{0: 'EGFR', 1: 'CD74', 2: 'CXCR4', 3: 'VEGFA', 4: 'NRP1'}}[try_cast(nullif(regexp_extract(tok, '^(gene_expr_)?(\d+)$', 2), '') as int)],
          upper(regexp_replace(split_part(tok, '.', 1), '[^A-Za-z0-9-]', '', 'g'))) end as mapped
    from p""",
)
def gene_symbol_cleanup(spark, sf):
    p = load(spark, sf, "part")
    sym = F.concat(F.upper(F.left("p_name", F.lit(3))), F.lit("."), F.col("p_size"), F.lit(" x"))
    tok = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("gene_expr_"), F.col("p_partkey") % 7))
        .when(F.col("p_partkey") % 3 == 1, (F.col("p_partkey") % 7).cast("string"))
        .otherwise(F.col("p_brand"))
    )
    panel = F.create_map(*[F.lit(v) for kv in enumerate(["EGFR", "CD74", "CXCR4", "VEGFA", "NRP1"]) for v in kv])
    return p.select(
        "p_partkey",
        T.gene_symbol(F.col("p_brand")).alias("symbol"),
        T.gene_symbol_base(sym).alias("base"),
        T.gene_prefix(sym).alias("prefix"),
        T.clean_gene(F.concat(F.col("p_name"), F.lit("|ENSG"), F.col("p_partkey"), F.lit(".2"))).alias("clean"),
        T.prototype_index(F.col("p_brand")).alias("idx"),
        T.mapped_gene(tok, panel).alias("mapped"),
    )


@query(
    "F8 W10",
    """with t as (select upper(replace(p_brand, '#', '')) as gene, p_partkey from part)
    select gene, min(p_partkey) as first_row from t where gene <> '' group by gene""",
)
def distinct_gene_list(spark, sf):
    p = load(spark, sf, "part").select(T.gene_symbol(F.col("p_brand")).alias("gene"), F.col("p_partkey").alias("first_row"))
    return O.first_per_key(p.where("gene <> ''"), ["gene"], ["first_row"])


@query(
    "F11 F15 F16 F19",
    r"""with e as (select event_id, 'pCR: ' || case event_type when 'view' then 'Yes' when 'click' then 'no; later' when 'error' then 'nonpCR'
        else event_type end as ph, event_type || '_' || user_id || '_' || event_id as stem,
        case event_type when 'view' then ' NA ' when 'click' then '' when 'error' then null else event_type end as ct from events),
      v as (select *, trim(regexp_replace(regexp_replace(lower(ph), '^pcr:\s*', ''), '[;|,].*$', '')) as w from e)
    select event_id, case when regexp_matches(w, '^(yes|y|pcr)$') then 'pCR'
        when regexp_matches(w, '^(no|n|nonpcr)$') then 'non_pCR' end as response,
      'Prototype' || regexp_extract(stem, '(\d+)', 1) as proto,
      split_part(stem, '_', 1) as sample, split_part(stem, '_', 2)::int as x, split_part(stem, '_', 3)::int as y,
      case when ct is null or trim(ct) in ('', 'nan', 'None', 'NA', 'N/A', 'NULL') then 'Unknown' else trim(ct) end as cell_type
    from v""",
)
def phenotype_labels(spark, sf):
    e = load(spark, sf, "events")
    kind = F.col("event_type")
    ph = F.concat(
        F.lit("pCR: "),
        F.when(kind == "view", "Yes").when(kind == "click", "no; later").when(kind == "error", "nonpCR").otherwise(kind),
    )
    stem = F.concat_ws("_", kind, "user_id", "event_id")
    ct = F.when(kind == "view", " NA ").when(kind == "click", "").when(kind == "error", F.lit(None)).otherwise(kind)
    parts = T.stem_parts(stem)
    return e.select(
        "event_id",
        T.response_label(ph).alias("response"),
        T.prototype_name(stem).alias("proto"),
        parts["sample"].alias("sample"),
        parts["x"].alias("x"),
        parts["y"].alias("y"),
        T.cell_type(ct).alias("cell_type"),
    )


def _label_values(e):
    return e.select(
        "event_id",
        T.label_value(F.col("event_type"), positives=["Purchase", "signup"]).alias("by_set"),
        T.label_value(F.col("event_type"), {"view": 2, "click": 3, "default": 9}).alias("by_map"),
        T.label_value(F.get_json_object("props", "$.k")).alias("by_number"),
    )


@query(
    "F3 P14",
    """select event_id, case when try_cast(event_type as double) is not null then try_cast(event_type as int)
        when lower(event_type) in ('purchase', 'signup') then 1 else 0 end as by_set,
      coalesce(map {'view': 2, 'click': 3, 'default': 9}[event_type], 9) as by_map,
      try_cast(try_cast(regexp_extract(props, '(\\d+)', 1) as double) as int) as by_number
    from events""",
)
def all_label_values(spark, sf):
    return _label_values(load(spark, sf, "events"))


@query(
    "F17",
    """select event_id, 'E' || event_id as gene_id, event_type as gene_name, user_id::varchar as level from events""",
)
def attribute_maps(spark, sf):
    e = load(spark, sf, "events")
    text = F.format_string('gene_id "E%d"; gene_name "old"; gene_name "%s";  level %d; novalue;', "event_id", "event_type", "user_id")
    m = T.attribute_map(text)
    return e.select("event_id", m["gene_id"].alias("gene_id"), m["gene_name"].alias("gene_name"), m["level"].alias("level"))


_MACRO_SQL = "case {c} " + " ".join(f"when '{n}' then '{m}'" for m, ns in T.MACRO_CLASS.items() for n in ns) + \
    " else case " + " ".join(f"when regexp_matches(lower({{c}}), '{p}') then '{m}'" for m, p in T.MACRO_KEYWORDS) + " else 'Unknown' end end"
_RAW_TYPES = ["Plasmablasts", "Cycling PVL", "ductal epithelium", "Cancer LumA SC", "Fibroblast", "apoptotic", "CD8 T cell", "other"]


@query(
    "F21 G50",
    f"""with t as (select vec_id, ({_RAW_TYPES})[(vec_id % 8 + 1)::int] as ct from embeddings)
    select ct, {_MACRO_SQL.format(c='ct')} as macro, count(*) as n from t group by all""",
)
def macro_classes(spark, sf):
    names = F.array(*[F.lit(n) for n in _RAW_TYPES])
    e = load(spark, sf, "embeddings").select(names[(F.col("vec_id") % 8).cast("int")].alias("ct"))
    typed = e.withColumn("macro", T.macro_class(F.col("ct")))
    return typed.groupBy("ct").agg(F.mode("macro", True).alias("macro"), F.count(F.lit(1)).alias("n"))


@query(
    "F20 F22",
    f"""with {CELLS} select node_idx, cell_type as back, list_position({CELL_TYPES}, cell_type)::int - 1 as idx from cells""",
)
def one_hot_round_trip(spark, sf):
    c = cells(spark, sf).withColumn("flags", A.one_hot(F.col("cell_type"), CELL_TYPES))
    return c.select("node_idx", A.from_one_hot(F.col("flags"), CELL_TYPES).alias("back"), A.argmax(F.col("flags")).alias("idx"))


_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::double * x::double)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


@query(
    "F23 F24",
    f"""with p as (select a.vec_id, a.embedding as u, b.embedding as v from embeddings a
        join embeddings b on b.vec_id = a.vec_id + 1),
      n as (select *, {_NORM.format(v='u')} as nu, {_NORM.format(v='v')} as nv, {_DOT.format(a='u', b='v')} as d,
        list_avg(u)::double as mu, list_avg(v)::double as mv from p)
    select vec_id, round(d, 6) as dot, round(d / ((nu + 1e-8) * (nv + 1e-8)), 6) as cosine,
      round(u[1]::double / (nu + 1e-8), 6) as first_unit,
      round((d - 64 * mu * mv) / sqrt((nu * nu - 64 * mu * mu) * (nv * nv - 64 * mv * mv)), 5) as pearson from n""",
)
def vector_similarity(spark, sf):
    e = load(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    u, v = F.col("embedding"), F.col("v")
    return e.join(nxt, "vec_id").select(
        "vec_id",
        F.round(A.dot(u, v), 6).alias("dot"),
        F.round(A.cosine(u, v, clip=True), 6).alias("cosine"),
        F.round(A.l2_normalize(u)[0], 6).alias("first_unit"),
        F.round(A.pearson(u, v), 5).alias("pearson"),
    )


@query(
    "F27 F28 F49 F34",
    f"""with {CELLS}, c as (select node_idx, list_transform(embedding[1:6], lambda x: greatest(x::double, 0)) as w, embedding as v, score from cells),
      t as (select *, list_sum(w) as t from c)
    select node_idx, round(case when t > 0 then -list_sum(list_transform(w, lambda x: case when x > 0 then x / t * ln(x / t) else 0 end)) else 0 end, 6) as entropy,
      list_position(v, list_max(v))::int - 1 as best,
      round(sign(score) * pow(abs(score) + 1e-8, 0.5), 6) as softened,
      round((score - (select min(score) from c)) / ((select max(score) from c) - (select min(score) from c)), 6) as scaled from t""",
)
def vector_summaries(spark, sf):
    c = O.group_minmax(cells(spark, sf), [], "score", "scaled", 0.5)
    return c.select(
        "node_idx",
        F.round(A.shannon(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))), 6).alias("entropy"),
        A.argmax(F.col("embedding")).alias("best"),
        F.round(S.soften(F.col("score"), 2.0), 6).alias("softened"),
        F.round("scaled", 6).alias("scaled"),
    )


_FREQ = [10000.0 ** (-(i - i % 2) / 4) for i in range(4)]


@query(
    "F40 F41 F42",
    f"""with {CELLS} select a.node_idx, round(b.pos_x - a.pos_x, 6) as dx, 0.0::double as pad,
      round(sin(a.pos_x), 5) as e0, round(cos(a.pos_x), 5) as e1, round(sin(a.pos_y * {_FREQ[2]}::double), 5) as e6,
      round(cos(a.pos_y * {_FREQ[2]}::double), 5) as e7, round(100 + a.pos_x * 4, 6) as x0,
      round(a.pos_x / 4)::bigint as level_x
    from cells a join cells b on b.node_idx = a.node_idx + 1""",
)
def position_features(spark, sf):
    c = cells(spark, sf)
    n = c.select((F.col("node_idx") - 1).alias("node_idx"), F.col("pos_x").alias("nx"), F.col("pos_y").alias("ny"))
    off = A.offset_feature(F.col("pos_x"), F.col("pos_y"), F.col("nx"), F.col("ny"), 4)
    enc = A.sinusoidal(F.col("pos_x"), F.col("pos_y"), 8)
    return c.join(n, "node_idx").select(
        "node_idx",
        F.round(off[0], 6).alias("dx"),
        off[3].alias("pad"),
        F.round(enc[0], 5).alias("e0"),
        F.round(enc[1], 5).alias("e1"),
        F.round(enc[6], 5).alias("e6"),
        F.round(enc[7], 5).alias("e7"),
        F.round(S.to_level0(F.col("pos_x"), 4, 100), 6).alias("x0"),
        S.from_level0(F.col("pos_x"), 4).alias("level_x"),
    )


@query(
    "F45 S9",
    f"""with {CELLS}, r as (select node_idx, pos_x as x1, pos_y as y1, pos_x + 10 + abs(score) * 20 as x2, pos_y as y2,
        pos_x + 5 as x3, pos_y + 8 + abs(score) * 10 as y3 from cells)
    select node_idx, round((x1 + x2 + x3) / 3, 4) as cx, round((y1 + y2 + y3) / 3, 4) as cy from r""",
)
def polygon_centroids(spark, sf):
    c = cells(spark, sf)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, s = F.col("pos_x"), F.col("pos_y"), F.abs("score")
    ring = F.array(point(x, y), point(x + 10 + s * 20, y), point(x + 5, y + 8 + s * 10))
    cen = A.polygon_centroid(ring)
    return c.select("node_idx", F.round(cen["x"], 4).alias("cx"), F.round(cen["y"], 4).alias("cy"))


@query(
    "F31 F46 F51 F52 F53 F55 L1",
    f"""with {MEASURES}, g as (select gene, avg(value) filter (layer = 'core') as core, avg(value) filter (layer = 'edge') as edge
      from measures group by gene), f as (select *, log2((core + 1e-6) / (edge + 1e-6)) as lfc from g)
    select gene, round(lfc, 6) as core_vs_edge, round(-lfc, 6) as edge_vs_core, round(least(core, edge), 6) as strength,
      case when lfc > 0 then 'Up_in_core' when lfc < 0 then 'Up_in_edge' end as direction,
      case when abs(lfc) < 0.001 then '***' when abs(lfc) < 0.01 then '**' when abs(lfc) < 0.05 then '*' else 'ns' end as stars,
      round(2 * (core / (core + edge)) - 1, 6) as biserial from f""",
)
def fold_change_labels(spark, sf):
    g = measures(spark, sf).groupBy("gene").agg(
        F.avg(F.when(F.col("layer") == "core", F.col("value"))).alias("core"),
        F.avg(F.when(F.col("layer") == "edge", F.col("value"))).alias("edge"),
    )
    g = g.withColumn("lfc", S.log2_fold(F.col("core"), F.col("edge"), 1e-6))
    return g.select(
        "gene",
        F.round("lfc", 6).alias("core_vs_edge"),
        F.round(-F.col("lfc"), 6).alias("edge_vs_core"),
        F.round(F.least("core", "edge"), 6).alias("strength"),
        S.direction(F.col("lfc"), "Up_in_core", "Up_in_edge").alias("direction"),
        S.stars(F.abs("lfc")).alias("stars"),
        F.round(S.rank_biserial(F.col("core") / (F.col("core") + F.col("edge"))), 6).alias("biserial"),
    ).orderBy("core_vs_edge")


_H = "list_transform(embedding[1:8], lambda v: 1.0::double / (1.0::double + exp(-v::double)))"


@query(
    "F47 W14",
    f"""with d as (select vec_id, {_H} as h, (vec_id * 37 % 2400)::double as t, (label % 2)::int as e from embeddings),
      b as (select *, greatest(least(len(list_filter([0.0, 200.0, 500.0, 900.0, 1300.0, 1700.0, 2000.0, 2200.0], lambda x: x < t)) - 1, 7), 0)::int as bin from d),
      l as (select *, list_transform(h, lambda x: ln(1 - x + 1e-7)) as s from b)
    select e, count(*) as n, min(bin) as first_bin, max(bin) as last_bin, round(-avg(case when e = 1 then coalesce(list_sum(s[1:bin]), 0) + ln(h[bin + 1] + 1e-7)
      else list_sum(s[1:bin + 1]) end), 6) as nll from l group by e""",
)
def discrete_time_likelihood(spark, sf):
    e = load(spark, sf, "embeddings")
    edges = F.array(*[F.lit(v) for v in (0.0, 200.0, 500.0, 900.0, 1300.0, 1700.0, 2000.0, 2200.0, 2500.0)])
    d = e.select(
        V.sigmoid(F.slice("embedding", 1, 8)).alias("h"),
        (F.col("vec_id") * 37 % 2400).cast("double").alias("t"),
        (F.col("label") % 2).cast("int").alias("e"),
    ).withColumn("bin", V.time_bin(F.col("t"), edges))
    d = d.withColumn("ll", V.log_likelihood(F.col("h"), F.col("bin"), F.col("e")))
    return d.groupBy("e").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("bin").alias("first_bin"),
        F.max("bin").alias("last_bin"),
        F.round(-F.avg("ll"), 6).alias("nll"),
    )


@query(
    "F48 E3 W6",
    f"""with h as (select vec_id, {_H} as h from embeddings),
      s as (select *, list_transform(range(1, 9), lambda i: list_product(list_transform(h[1:i], lambda x: 1 - x))) as s from h)
    select vec_id, round(1 - s[8], 6) as cuminc, round(list_sum(list_transform(h, lambda x: -ln(1 - x + 1e-6))), 6) as cumhaz,
      round(-list_sum(list_transform(range(2, 9), lambda i: h[i] * s[i - 1] * (i - 1))), 6) as exp_time from s""",
)
def hazard_risk(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", V.sigmoid(F.slice("embedding", 1, 8)).alias("h"))
    return e.select("vec_id", *[F.round(V.risk(F.col("h"), m), 6).alias(m) for m in V.RISK_MODES])


@query(
    "W13",
    f"""with {PATIENTS}, q as (select quantile_cont(t, {[i / 20 for i in range(21)]}) as e from patients)
    select distinct round(unnest(e), 6) as edge from q""",
)
def time_bin_edges(spark, sf):
    from tilewright.operators.survival import time_bins

    return time_bins(patients(spark, sf), "t", 20).select(F.explode("edges").alias("edge")).withColumns(r6("edge")).distinct()


@query(
    "F54",
    """with t as (select unnest(['a photo of CLASSNAME.', 'CLASSNAME tissue, CLASSNAME cells', 'an image showing CLASSNAME']) as template)
    select distinct replace(template, 'CLASSNAME', p_name) as prompt from part, t""",
)
def template_expansion(spark, sf):
    forms = F.array(*[F.lit(t) for t in ("a photo of CLASSNAME.", "CLASSNAME tissue, CLASSNAME cells", "an image showing CLASSNAME")])
    p = load(spark, sf, "part").select("p_name").distinct()
    return p.select(F.explode(T.expand_templates(F.array("p_name"), forms)).alias("prompt")).distinct()


@query(
    "F56",
    f"""with {MEASURES}, s as (select unit, prototype_id, avg(value) filter (layer = 'core') / 50 as c, avg(value) filter (layer = 'edge') / 50 as e
        from measures group by all),
      d as (select unit, prototype_id, coalesce(c, 0) - coalesce(e, 0) as d from s),
      b as (select unit, d, row_number() over (partition by unit order by abs(d) desc, prototype_id) as rn from d)
    select unit, case when abs(d) < 0.5 and abs(d) >= 0.25 then 'Interface' when d >= 0.5 then 'Core' when d <= -0.5 then 'Edge' else 'Other' end as label
    from b where rn = 1""",
)
def spatial_like_label(spark, sf):
    on = lambda layer: F.coalesce(F.avg(F.when(F.col("layer") == layer, F.col("value"))) / 50, F.lit(0.0))
    d = measures(spark, sf).groupBy("unit", "prototype_id").agg((on("core") - on("edge")).alias("d"))
    best = d.groupBy("unit").agg(F.max_by("d", F.struct(F.abs("d"), -F.col("prototype_id"))).alias("best"))
    return best.select("unit", S.spatial_label(F.col("best"), 0.5).alias("label"))
