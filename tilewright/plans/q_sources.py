"""Queries: sources and sinks, each a round trip of a table through files in the shared work folder."""

from pyspark.sql import functions as F

from tilewright.operators import neighbors as nb
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELL_TYPES, CELLS, GENES, MEASURES, PATIENTS, TILE_EXPR, cells, measures, patients, tile_expr
from tilewright.session import dealt, load, new_path
from tilewright.sources import readers as R
from tilewright.sources import writers as W


@query("S1 D10", "select 'cohort ' || s_name as name, 'csv' as label_format, case when s_nationkey % 5 = 0 then 'who' else 'patient' end as patient_column, 'pCR' as value_column, 4 as n_positive, (s_suppkey % 7)::int as pos_level from supplier")
def cohort_config(spark, sf):
    path = new_path(spark, "cohorts")
    n = load(spark, sf, "supplier")
    label = F.struct(F.lit("f.csv").alias("file"), F.when(F.col("s_nationkey") % 5 == 0, "who").alias("patient_column"))
    c = F.struct(F.concat(F.lit("cohort "), "s_name").alias("name"), (F.col("s_suppkey") % 7).alias("pos_level"), label.alias("label"))
    n.groupBy("s_nationkey").agg(F.collect_list(c).alias("cohorts")).select(F.lit("m").alias("model_path"), "cohorts").write.option("maxRecordsPerFile", 1).json(path)
    s = R.cohort_specs(spark, path)
    return s.select("name", "label_format", "patient_column", "value_column", F.size("positive_values").alias("n_positive"), "pos_level")


@query("S2 D11 W11 F3", "select trim(o_custkey::varchar) as patient_id, arg_max((o_orderpriority in ('1-URGENT', '2-HIGH'))::int, struct_pack(d := o_orderdate, k := o_orderkey)) as label from orders group by o_custkey")
def cohort_label_file(spark, sf):
    path = new_path(spark, "labels")
    o = load(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey")
    o.select(F.format_string(" %d ", "o_custkey").alias("patient"), F.col("o_orderpriority").alias("pCR")).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.cohort_labels(spark, path, positives=["1-urgent", "2-HIGH"])


@query("S3 D11", """select substr('PATIENT_' || lpad(o_custkey::varchar, 6, '0'), 1, 12) as patient_id,
      round(arg_min(o_orderkey / 365.0::double, o_orderkey) filter (o_orderstatus <> 'P'), 6) as t_years,
      arg_min((o_orderstatus = 'F')::int::double, o_orderkey) filter (o_orderstatus <> 'P') as e from orders group by 1""")
def survival_label_file(spark, sf):
    path = new_path(spark, "survival")
    o = load(spark, sf, "orders").orderBy("o_orderkey")
    o.select(
        F.concat(F.lit("PATIENT_"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("PatientID"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("T"),
        (F.col("o_orderstatus") == "F").cast("int").alias("E"),
    ).write.option("header", True).csv(path)
    return R.survival_labels(spark, path).select("patient_id", F.round("t", 6).alias("t_years"), "e")


@query("S4 D8 P15 F22", f"""with {CELLS} select node_idx as global_id, round(pos_x, 6) as x, cell_type, round(score, 6) as f0, 0.0::double as f1, (cell_type = 'Dead')::int::double as is_dead, 7 as width from cells""")
def nuclei_files(spark, sf):
    path = new_path(spark, "nuclei")
    cells(spark, sf).select(
        F.col("node_idx").alias("Global_Nuclei_ID"), F.col("cell_type").alias("type"), F.col("pos_x").alias("Identifier.CentoidX_Global"),
        F.col("pos_y").alias("Identifier.CentoidY_Global"), F.col("score").alias("Shape.Area"), F.lit("bad").alias("Shape.Broken"), F.lit(1.0).alias("Shape.HuMoments4"),
    ).write.option("header", True).csv(path)
    n = R.nuclei(spark, path)
    f = F.col("feats")
    return n.select("global_id", F.round("x", 6).alias("x"), "cell_type", F.round(f[0], 6).alias("f0"), f[1].alias("f1"), f[4].alias("is_dead"), F.size(f).alias("width"))


def _wide_tiles(spark, sf, key):
    t = tile_expr(spark, sf)
    row = key(F.col("tile_x").cast("long"), F.col("tile_y").cast("long"))
    return t.groupBy("sample_name", row.alias("spot")).pivot("gene", [f"G{i}" for i in range(GENES)]).agg(F.first("value"))


@query("S5 D6", f"with {CELLS}, {TILE_EXPR} select sample_name, tile_x as x, tile_y as y, gene, round(value, 6) as value from tile_expr")
def sample_expression_files(spark, sf):
    path = new_path(spark, "tiles")
    w = _wide_tiles(spark, sf, lambda x, y: F.concat_ws("_", x, y))
    w.write.partitionBy("sample_name").option("header", True).csv(path)
    return R.tile_expression(spark, path).withColumns(r6("value"))


@query("S6 D7 F16", f"with {CELLS}, {TILE_EXPR} select 'slide_' || sample_name as sample_name, tile_x::int as x, tile_y::int as y, gene, round(value, 6) as value from tile_expr")
def training_expression_files(spark, sf):
    path = new_path(spark, "train")
    w = _wide_tiles(spark, sf, lambda x, y: F.concat_ws("_", F.concat(F.lit("slide_"), "sample_name"), x, y)).drop("sample_name")
    w.write.option("header", True).csv(path)
    return R.training_expression(spark, path).withColumns(r6("value"))


FILES = 256  # that one task writes


def _files(writer):
    """Tasks put their files in place themselves; otherwise the driver would move one after the other."""
    return writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _folder(spark, sf):
    """One small text file per supplier below a folder per nation."""
    path = new_path(spark, "files")
    rows = dealt(load(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name"), ["s_suppkey"], FILES)
    _files(rows.drop("s_suppkey").write.partitionBy("s_nationkey").option("maxRecordsPerFile", 1)).text(path)
    return path


@query("S8", "select s_nationkey::int as r, count(*) as n from supplier group by 1")
def discovered_files(spark, sf):
    f = R.files(spark, _folder(spark, sf), ["TXT", ".svs"])
    return f.groupBy(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query("S32 F6 S20", "select s_name as sample_name, s_suppkey % 9 <> 3 as found from supplier")
def asset_status(spark, sf):
    n = load(spark, sf, "supplier")
    listed = n.where("s_suppkey % 9 <> 3").select(F.concat(F.lit("/data/slides/"), F.replace("s_name", F.lit("_"), F.lit("-")), F.lit("-01.svs")).alias("path"))
    return W.asset_report(n.select(F.col("s_name").alias("sample_name")), listed).select("sample_name", "found")


@query("S7 F16", "select 'supplier' as sample, s_suppkey * 10 as x, s_nationkey::bigint as y from supplier where s_suppkey % 7 <> 0")
def patch_index(spark, sf):
    from tilewright.functions.text import stem_parts

    path = new_path(spark, "patches")
    n = load(spark, sf, "supplier")
    stem = F.when(F.col("s_suppkey") % 7 == 0, "broken").otherwise(F.concat_ws("_", F.lit("supplier"), F.col("s_suppkey") * 10, "s_nationkey"))
    rows = dealt(n.select("s_suppkey", stem.alias("stem"), "s_name"), ["s_suppkey"], FILES)
    _files(rows.drop("s_suppkey").write.partitionBy("stem")).text(path)
    f = R.files(spark, path, [".txt"]).select(stem_parts(F.regexp_extract("path", r"stem=([^/]+)/", 1)).alias("p"))
    return f.select("p.sample", "p.x", "p.y").na.drop()


@query("S9 D9 J12", f"""with {CELLS} select node_idx as id, cell_type as class, round(pos_x * 2, 4) as x0, round(pos_y * 2, 4) as y0, 3 as points from cells""")
def geojson_polygons(spark, sf):
    path = new_path(spark, "geojson")
    point = lambda x, y: F.array(x, y)
    x, y = F.col("pos_x"), F.col("pos_y")
    poly = F.array(F.array(point(x, y), point(x + 1, y), point(x, y + 1)))
    multi = F.col("node_idx") % 2 == 0
    coords = F.when(multi, F.to_json(F.array(poly))).otherwise(F.to_json(poly))
    feature = F.format_string(
        '{"geometry":{"type":"%s","coordinates":%s},"classification":{"name":"%s|%d"},"properties":{"level":1}}',
        F.when(multi, "MultiPolygon").otherwise("Polygon"), coords, "cell_type", "node_idx",
    )
    # files of at most 200 features, several per sample
    part = F.floor(F.col("node_idx") / 200)
    one = cells(spark, sf).groupBy("sample_name", part.alias("part")).agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("doc"))
    one.write.partitionBy("sample_name", "part").option("maxRecordsPerFile", 1).text(path)
    p = R.polygons(spark, path)
    c = F.split("class", r"\|")
    return p.select(c[1].cast("long").alias("id"), c[0].alias("class"), F.round(F.col("ring")[0]["x"], 4).alias("x0"), F.round(F.col("ring")[0]["y"], 4).alias("y0"), F.size("ring").alias("points"))


def _gtf(spark, sf):
    path = new_path(spark, "gtf")
    p = load(spark, sf, "part").orderBy("p_partkey")
    kind = F.when(F.col("p_partkey") % 4 == 0, "gene").otherwise("exon")
    line = F.concat_ws(
        "\t", F.lit("chr1"), F.lit("src"), kind, F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."),
        F.format_string('gene_id "ENSG%d.7"; gene_name "%s"; level 2;', F.col("p_partkey") % 40, "p_name"),
    )
    p.select(F.when(F.col("p_partkey") == 0, "#header").otherwise(line)).write.text(path)
    return R.gtf(spark, path)


@query("S10 D13 F17 F18 W10", "select p_name as gene_name, 'ENSG' || (arg_min(p_partkey, p_partkey) % 40) as gene_id from part where p_partkey > 0 group by p_name")
def gtf_gene_names(spark, sf):
    return R.gene_names(_gtf(spark, sf))


@query("S10 G38", "select 'ENSG' || (p_partkey % 40) as gene_id, sum(p_size + 1)::bigint as length from part where p_partkey % 4 <> 0 group by 1")
def gtf_exon_lengths(spark, sf):
    return R.exon_lengths(_gtf(spark, sf))


@query("S11", "select row_number() over (order by p_name) - 1 as idx, 'GENE-' || replace(p_name, ' ', '-') as gene from (select distinct p_name from part) where p_name >= 'd'")
def gene_list_file(spark, sf):
    path = new_path(spark, "genes")
    p = load(spark, sf, "part").select("p_name").distinct().repartitionByRange("p_name").sortWithinPartitions("p_name")
    k, name = F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit("-"))
    p.select(F.when(k < "c", "  ").when(k < "d", "# note").otherwise(F.concat(F.lit("GENE-"), name, F.lit(", extra")))).write.text(path)
    return R.gene_list(spark, path)


@query("S13 S12 D12", "select row_number() over (order by c_custkey) - 1 as idx, c_name as symbol, 'ENSG' || c_custkey as ensembl from customer")
def gene_map_file(spark, sf):
    path = new_path(spark, "genemap")
    n = load(spark, sf, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    n.select("c_name", F.concat(F.lit("ENSG"), "c_custkey", F.lit(".3"))).write.option("sep", "\t").csv(path)
    return R.gene_map(spark, path)


@query("S12", "select p_brand as gene, max(p_size)::double as length from part group by 1")
def gene_length_file(spark, sf):
    path = new_path(spark, "lengths")
    p = load(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("Merged"))
    p.select(F.concat("p_brand", F.lit(".9")).alias("Gene_ID"), "Merged").write.option("header", True).option("sep", "\t").csv(path)
    return R.gene_lengths(spark, path)


@query("S14 D20", "select distinct p_brand as name, case when p_brand < 'Brand#2' then 'up' else 'two-sided' end as direction, p_name as gene from part")
def gene_set_file(spark, sf):
    path = new_path(spark, "sets")
    p = load(spark, sf, "part")
    s = p.groupBy("p_brand").agg(F.collect_set(F.concat("p_name", F.lit(" "))).alias("genes"))
    body = F.struct("genes", F.when(F.col("p_brand") < "Brand#2", "up").alias("direction"))
    s.select(F.to_json(F.create_map("p_brand", body))).write.text(path)
    files_ = spark.read.text(path)  # one object per line stands for one file
    files_.write.option("maxRecordsPerFile", 1).text(f"{path}-single")
    return R.gene_sets(spark, f"{path}-single")


@query("S15", f"""with {CELLS}, c as (select prototype_id, {', '.join(f"count(*) filter (cell_type = '{t}')::double as {t}" for t in CELL_TYPES)} from cells group by 1)
    select 'Prototype' || prototype_id as prototype, macro, round(v / ({' + '.join(CELL_TYPES)}), 6) as frac from c, lateral (select unnest({CELL_TYPES}) as macro, unnest([{', '.join(CELL_TYPES)}]) as v)
    union all select 'Prototype' || prototype_id, 'Unknown', 0.0 from c""")
def prior_composition_file(spark, sf):
    path = new_path(spark, "prior")
    c = cells(spark, sf).groupBy(F.concat(F.lit("P"), "prototype_id").alias("Prototype")).pivot("cell_type", CELL_TYPES).agg(F.count(F.lit(1)))
    c.write.option("header", True).csv(path)
    return R.prior_composition(spark, path, [*CELL_TYPES, "Unknown"]).withColumns(r6("frac"))


@query("S15", f"""with {CELLS} select 'Prototype' || prototype_id as prototype, cell_type as macro, round(count(*) / sum(count(*)) over (partition by prototype_id), 6) as frac from cells group by prototype_id, cell_type""")
def prior_composition_long_file(spark, sf):
    path = new_path(spark, "prior")
    c = cells(spark, sf).groupBy(F.concat(F.lit("P"), "prototype_id").alias("Prototype"), F.col("cell_type").alias("MacroClass")).agg(F.count(F.lit(1)).alias("fraction"))
    c.write.option("header", True).csv(path)
    return R.prior_composition(spark, path, CELL_TYPES).withColumns(r6("frac"))


def _mtx(spark, sf):
    path = new_path(spark, "mtx")
    p = F.format_string("%d %d %d", (F.col("l_partkey") + 1).cast("long"), (F.col("l_orderkey") + 1).cast("long"), F.col("l_quantity").cast("long"))
    li = load(spark, sf, "lineitem")
    body = li.select(p.alias("v"), F.lit(2).alias("o"))
    head = li.agg(F.format_string("%d %d %d", F.max("l_partkey") + 1, F.max("l_orderkey") + 1, F.count(F.lit(1))).alias("v")).withColumn("o", F.lit(1))
    note = head.select(F.lit("%%MatrixMarket matrix coordinate integer general").alias("v"), F.lit(0).alias("o"))
    note.unionByName(head).repartitionByRange(1, "o").sortWithinPartitions("o").select("v").write.text(path)  # two lines
    body.select("v").write.mode("append").text(path)
    return R.matrix_market(spark, path)


@query("S16 L9 G36 D16", """with c as (select l_orderkey + 1 as cell_idx, sum(l_quantity) as library from lineitem group by 1 having sum(l_quantity) >= 100), k as (select * from c order by library desc, cell_idx limit 120000)
    select (l_partkey + 1)::int as gene_idx, cell_idx::int as cell_idx, l_quantity as x from lineitem join k on cell_idx = l_orderkey + 1""")
def matrix_market_prefilter(spark, sf):
    return R.prefilter_cells(_mtx(spark, sf), 100, keep_top=120_000)


@query("S17 J21 F14", """select o_orderkey::int as cell_idx, 'BC' || o_custkey || case when o_orderkey % 2 = 0 then '-1' else '' end as barcode, case when o_custkey in (select c_custkey from customer where c_custkey % 3 <> 0) then c_mktsegment end as celltype, round(sum(l_quantity), 2) as total
    from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all""")
def sparse_counts_with_metadata(spark, sf):
    li, o, c = (load(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    counts = li.select(F.col("l_orderkey").cast("int").alias("cell_idx"), F.col("l_quantity").alias("x"))
    bc = o.select(F.col("o_orderkey").cast("int").alias("cell_idx"), F.concat(F.lit("BC"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "-1").otherwise("")).alias("barcode"))
    meta = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("BC"), "c_custkey").alias("barcode"), F.col("c_mktsegment").alias("celltype"))
    return R.attach_metadata(counts, bc, meta).groupBy("cell_idx", "barcode", "celltype").agg(F.round(F.sum("x"), 2).alias("total"))


@query("S18 D17 F15 U6", f"""with {MEASURES}, e as (select sample_name as sample, gene, avg(value) as value from measures group by all) select sample, gene, round(value, 6) as value, case when right(sample, 1) in ('0', '2', '4', '6', '8') then 'pCR' else 'non_pCR' end as response from e""")
def bulk_with_phenotype(spark, sf):
    path = new_path(spark, "bulk")
    e = measures(spark, sf).groupBy("sample_name", "gene").agg(F.avg("value").alias("value"))
    names = [f"N{i:02d}" for i in range(25)]
    e.groupBy("gene").pivot("sample_name", names).agg(F.first("value")).write.option("header", True).csv(f"{path}/expr")
    ph = e.select("sample_name").distinct().withColumn("r", F.when(F.right("sample_name", F.lit(1)).isin("0", "2", "4", "6", "8"), "pCR: Yes").otherwise("pCR: no; x"))
    ph.groupBy(F.lit("characteristics").alias("attr")).pivot("sample_name", names).agg(F.first("r")).write.option("header", True).csv(f"{path}/pheno")
    p = R.phenotype(spark, f"{path}/pheno", "characteristics")
    return R.bulk_matrix(spark, f"{path}/expr").join(p, "sample").select("sample", "gene", F.round("value", 6).alias("value"), "response")


@query("S19 D21 E5", f"""with {CELLS} select cohort as patient_id, sample_name as slide_id, count(*) as patches, (cohort = 'C1')::int + 10 as label from cells group by cohort, sample_name""")
def slide_bags(spark, sf):
    c = cells(spark, sf)
    patches = c.select(F.col("sample_name").alias("slide_id"), "embedding")
    slides = c.select(F.col("sample_name").alias("slide_id"), F.col("cohort").alias("patient_id")).distinct()
    labels = slides.select("patient_id", (F.col("patient_id") == "C1").cast("int").alias("label")).distinct()
    b = R.slide_bags(patches, slides, labels, target=lambda c: c + 10)
    return b.groupBy("patient_id", "slide_id").agg(F.count(F.lit(1)).alias("patches"), F.max("label").alias("label"))


@query("D22 F54", """with t as (select unnest(['CLASSNAME.', 'a slide of CLASSNAME']) as template)
    select distinct p_type as set, p_brand as class, replace(template, 'CLASSNAME', p_name) as prompt from part, t""")
def prompt_file(spark, sf):
    path = new_path(spark, "prompts")
    c = load(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.collect_set("p_name").alias("names"))
    s = c.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "names"))).alias("classnames"))
    forms = F.array(F.lit("CLASSNAME."), F.lit("a slide of CLASSNAME")).alias("templates")
    s.select(F.to_json(F.create_map("p_type", F.struct("classnames", forms)))).write.option("maxRecordsPerFile", 1).text(path)
    return R.prompts(spark, path)


@query("S20 P14", "select doc_id as id, '/tiles/' || source || '/' || doc_id as path, case lang when 'en' then 0 else 1 end as label from documents where lang in ('en', 'fr')")
def tile_image_index(spark, sf):
    return R.tile_index(load(spark, sf, "documents"), "/tiles", "doc_id", "source", "lang", {"en": 0, "fr": 1})


@query("S21 S24 O1 O2", f"with {CELLS} select node_idx, round(pos_x, 6) as pos_x from cells where sample_name = 'S4'")
def sample_pushdown(spark, sf):
    path = new_path(spark, "cells")
    W.write_parquet(cells(spark, sf), path)
    return R.sample_rows(spark, path, "S4", ["node_idx", "pos_x"]).withColumns(r6("pos_x"))


@query("U1", "select 'P' || (p_size % 3) as pair, p_brand as gene, p_partkey as k from part")
def tagged_result_files(spark, sf):
    path = new_path(spark, "results")
    p = load(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("s"))
    for s in range(3):
        p.where(F.col("s") == s).drop("s").write.option("header", True).csv(f"{path}/P{s}_DEGs")
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    tag = F.regexp_extract(F.col("_metadata.file_path"), r"/(P\d+)_DEGs/", 1)
    return raw.select(tag.alias("pair"), "gene", F.col("k").cast("long").alias("k"))


@query("S23 F9", "select upper(p_name) as gene, 'lfc' as \"column\", round(p_retailprice / 100, 4) as value from part")
def signature_file(spark, sf):
    path = new_path(spark, "sig")
    p = load(spark, sf, "part")
    p.select(F.concat("p_name", F.lit("|ENSG1.2")).alias("gene"), (F.col("p_retailprice") / 100).alias("lfc")).write.option("header", True).csv(path)
    return R.signature_table(spark, path).withColumn("value", F.round("value", 4))


@query("S25 D5 O3", f"with {CELLS} select sample_name, count(*) as rows from cells group by 1")
def per_sample_manifest(spark, sf):
    return W.write_per_sample(cells(spark, sf).drop("embedding"), new_path(spark, "persample")).select("sample_name", "rows")


_ALL = [f"G{i}" for i in range(GENES)]


@query("S26 F42", f"with {CELLS}, {TILE_EXPR} select sample_name, tile_x::bigint || '_' || tile_y::bigint as spot, {', '.join(f'''round(max(value) filter (gene = '{g}'), 6) as {g}''' for g in _ALL)} from tile_expr group by all")
def all_gene_prediction_files(spark, sf):
    t = tile_expr(spark, sf).withColumnsRenamed({"tile_x": "x", "tile_y": "y"})
    return W.write_predictions_wide(t, new_path(spark, "pred"), _ALL).withColumns(r6(*_ALL))


@query("S27 W12", f"""with {PATIENTS} select patient as sample_index, 'order ' || patient as sample_name, round(risk, 8) as risk_score, round(t / 365, 6) as time_years, e as event from patients""")
def survival_prediction_file(spark, sf):
    p = patients(spark, sf).select(
        F.col("patient").alias("sample_index"), F.concat(F.lit("order "), "patient").alias("sample_name"), F.round("risk", 8).alias("risk_score"),
        F.round(F.col("t") / 365, 6).alias("time_years"), F.col("e").alias("event"),
    )
    return W.write_survival_predictions(p, new_path(spark, "os"))


@query("S28", "select round(n_chars / (n_chars + 1000.0), 6) as prediction, quality as label from labels join documents using (doc_id)")
def response_prediction_file(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id")
    p = d.select(F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6).alias("prediction"), F.col("quality").alias("label"))
    return W.write_response_predictions(p, new_path(spark, "pcr"))


@query("S29", "select count(*) as rows, 'kmeans' as method, 5 as k, 6 as columns from orders")
def run_manifest(spark, sf):
    return W.write_manifest(load(spark, sf, "orders"), new_path(spark, "manifest"), method="kmeans", k=5)


@query("S30 X1", "select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def unfinished_units(spark, sf):
    o = load(spark, sf, "orders")
    done = W.write_parquet(o.where("o_orderstatus = 'F'").select("o_custkey").distinct(), new_path(spark, "done"))
    return W.unfinished(o.select("o_custkey").distinct(), done, ["o_custkey"])


@query("S31 O4", f"with {CELLS} select sample_name, count(*) as n from cells group by 1")
def cached_stage(spark, sf):
    root = new_path(spark, "cache")
    c = cells(spark, sf)
    build = lambda df: df.groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"))
    W.cached_stage(c, root, "sample_name", build, k=8)
    return W.cached_stage(c, root, "sample_name", build, k=8)
