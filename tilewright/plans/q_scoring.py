"""Queries: signatures, banks, set scores, calls, communication, weight search."""

from pyspark.sql import functions as F

from tilewright.functions.scores import LIGAND_RECEPTOR
from tilewright.operators import ordered as O
from tilewright.operators import prototypes as P
from tilewright.operators import scoring as Sc
from tilewright.operators import stats as S
from tilewright.plans import tail_sql as Q
from tilewright.plans.q_expression import _SPARSE, _MK, markers, sparse, sparse_cells
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, MEASURES, cells, measures, staged
from tilewright.session import cut_lineage, load, spread

_DUELS = [(0, 2), (0, 4), (2, 4)]
_SIG = f"""srow as (
      select prototype_id as prototype, null::int as other, 'core_vs_edge' as contrast, gene, (layer = 'core')::int as f, value from measures where prototype_id in (0, 2, 4) and layer <> 'interface'
      union all select prototype_id, null, 'pcr', gene, label, value from measures where prototype_id in (0, 2, 4)
      {' '.join(f"union all select {a}, {b}, 'pair_' || layer, gene, (prototype_id = {a})::int, value from measures where prototype_id in ({a}, {b}) and layer in ('core', 'edge')" for a, b in _DUELS)}),
    sm as (select prototype, other, contrast, gene, count(*) filter (f = 1) as n1, count(*) filter (f = 0) as n0, avg(value) filter (f = 1) as m1, avg(value) filter (f = 0) as m0, var_samp(value) filter (f = 1) as v1, var_samp(value) filter (f = 0) as v0 from srow group by all),
    st as (select *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) as t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) as df from sm),
    sig as (select prototype, other, contrast, gene, log2((m1 + 1e-6) / (m0 + 1e-6)) as log2fc, {Q.student('t', 'df')} as p from st)"""
_FOUND = """found as (select *, case contrast when 'core_vs_edge' then case when log2fc > 0 then 'Up_in_core' else 'Up_in_edge' end when 'pcr' then case when log2fc > 0 then 'Up_in_pCR' else 'Up_in_non_pCR' end
      else 'Up_in_P' || (case when log2fc > 0 then prototype else other end) || '_' || replace(contrast, 'pair_', '') end as direction from sig where p <= 0.2 and log2fc <> 0)"""
_BANK = """iu as (select distinct regexp_extract(direction, '^Up_in_P(\\d+)_', 1)::int as prototype, gene from found where contrast like 'pair_%'),
    idn as (select distinct a.prototype, b.gene from (select distinct prototype from iu) a join iu b on b.prototype <> a.prototype where not exists (select 1 from iu c where c.prototype = a.prototype and c.gene = b.gene)),
    bank as (select prototype, 'identity_up' as tag, gene from iu union all select prototype, 'identity_down', gene from idn union all
      select distinct prototype, case direction when 'Up_in_core' then 'core' when 'Up_in_edge' then 'edge' when 'Up_in_pCR' then 'pcr_up' else 'pcr_down' end, gene from found where contrast not like 'pair_%')"""


def signature(spark, sf):
    """Long signature table from Welch tests of every contrast."""

    def build():
        m = measures(spark, sf)
        p, layer = F.col("prototype_id"), F.col("layer")
        row = lambda ok, a, b, name, flag: F.when(
            ok, F.struct(F.lit(a).cast("int").alias("prototype") if not hasattr(a, "alias") else a.cast("int").alias("prototype"),
                         F.lit(b).cast("int").alias("other"), name.alias("contrast"), flag.cast("int").alias("f")))
        rows = [
            row(p.isin(0, 2, 4) & (layer != "interface"), p, None, F.lit("core_vs_edge"), layer == "core"),
            row(p.isin(0, 2, 4), p, None, F.lit("pcr"), F.col("label")),
            *[row(p.isin(a, b) & layer.isin("core", "edge"), a, b, F.concat(F.lit("pair_"), layer), p == a) for a, b in _DUELS],
        ]
        long = m.select("gene", "value", F.explode(F.array_compact(F.array(*rows))).alias("z")).select("gene", "value", "z.*")
        long = long.withColumn("other", F.coalesce("other", F.lit(-1)))
        w = S.welch(long, ["prototype", "other", "contrast", "gene"], "value", "f")
        return w.select(
            "prototype", F.nullif("other", F.lit(-1)).alias("other"), "contrast", "gene",
            F.log2((F.col("mean1") + 1e-6) / (F.col("mean0") + 1e-6)).alias("log2fc"), "p",
        )

    return staged(spark, ("signature", sf), build)


def bank(spark, sf):
    return staged(spark, ("bank", sf), lambda: Sc.marker_bank(Sc.discover(signature(spark, sf), p_max=0.2)))


@query("P18 F52 D18 S23", f"""with {MEASURES}, {_SIG}, {_FOUND} select prototype, other, contrast, gene, round(log2fc, 6) as log2fc, round(p, 5) as p, direction from found""")
def discovered_signatures(spark, sf):
    return Sc.discover(signature(spark, sf), p_max=0.2).withColumns(r6("log2fc")).withColumn("p", F.round("p", 5))


@query("P18", f"""with {MEASURES}, {_SIG} select prototype, other, contrast, gene, round(log2fc, 6) as log2fc from sig where abs(log2fc) >= 0.02""")
def discovered_by_effect(spark, sf):
    return Sc.discover(signature(spark, sf), by_p=False, min_lfc=0.02).select("prototype", "other", "contrast", "gene", F.round("log2fc", 6).alias("log2fc"))


@query("A45 D19 J15 U4 U5", f"""with {MEASURES}, {_SIG}, {_FOUND}, {_BANK} select * from bank""")
def marker_bank(spark, sf):
    return bank(spark, sf)


@query("L12 W4", f"""with {MEASURES}, {_SIG}, h as (select contrast, prototype, coalesce(other, -1) as other, gene, log2fc from sig)
    select contrast, prototype, other, gene, side, rank::int as rank, round(log2fc, 6) as log2fc from (
      select *, 'high' as side, row_number() over (partition by contrast, prototype, other order by log2fc desc, gene) as rank from h where log2fc > 0 union all
      select *, 'low', row_number() over (partition by contrast, prototype, other order by log2fc, gene) from h where log2fc < 0) where rank <= 25""")
def high_low_signatures(spark, sf):
    s = signature(spark, sf).withColumn("other", F.coalesce("other", F.lit(-1))).drop("p")
    return Sc.high_low_lists(s, ["contrast", "prototype", "other"], 25).withColumns(r6("log2fc"))


_PRIOR_SQL = "prior as (select p as prototype, m as macro, (1 + (p + length(m)) % 4) / 10.0::double as frac from (select unnest([0, 2, 4])::int as p), (select distinct c_mktsegment as m from customer))"


def prior(spark, sf):
    """Prior share of every prototype in a segment, by rule."""
    seg = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("macro")).distinct()
    p = seg.withColumn("prototype", F.explode(F.array(*[F.lit(k) for k in (0, 2, 4)])))
    return p.withColumn("frac", (1 + (F.col("prototype") + F.length("macro")) % 4) / 10.0)


_CORR = """seedsig as (select cl.unit, cl.cell_type, b.prototype, b.tag, sum(coalesce(cnt.value, 0)) / max(b.n) as signal from cl join (select *, count(*) over (partition by prototype, tag) as n from bank where tag in ('core', 'edge')) b on true
      left join cnt on cnt.unit = cl.unit and cnt.gene = b.gene group by all),
    corr_ as (select s.cell_type, s.prototype, s.tag, g.gene, corr(coalesce(cnt.value, 0), signal) as r from seedsig s, (select distinct gene from cnt) g left join cnt on cnt.unit = s.unit and cnt.gene = g.gene group by all)"""
_REFINE = """tagm as (select cell_type, target as prototype, gene, avg_log2fc, tag, abs(avg_log2fc) as score from mrk, (select unnest(['identity_up', 'identity_down', 'core', 'edge']) as tag) where case when tag = 'identity_down' then avg_log2fc < 0 else avg_log2fc > 0 end),
    topm as (select * from (select *, row_number() over (partition by cell_type, prototype, tag order by score desc, gene) as rank from tagm) where rank <= 120),
    scw as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0::double end as w from topm window w as (partition by cell_type, prototype, tag)),
    refined as (select prototype, tag, gene, sum(wt) as weight from (select s.prototype, s.tag, s.gene, w * coalesce(frac, 1) * (case when s.tag in ('core', 'edge') and (select count(*) from bank b where b.prototype = s.prototype and b.tag = s.tag) >= 3 then greatest(coalesce(r, 0), 0) else 1 end) as wt
      from scw s left join prior p on p.prototype = s.prototype and p.macro = s.cell_type left join corr_ c on c.cell_type = s.cell_type and c.prototype = s.prototype and c.tag = s.tag and c.gene = s.gene) where wt > 0 group by all)"""


def seed_correlation(spark, sf):
    """(cell_type, prototype, tag, gene, r): correlation of each gene with the mean of the seed genes over the cells of a type.

    From sparse sums: cells without an entry count as zeros through the number of cells. All of them follow from the sums of
    products of two genes of a cell, one of them a seed, which are added up in one pass.
    """
    x = sparse(spark, sf)
    b = bank(spark, sf).where("tag in ('core', 'edge')")
    size = b.groupBy("prototype", "tag").agg(F.count(F.lit(1)).alias("m"))
    seeds = b.join(size, ["prototype", "tag"]).select("prototype", "tag", F.col("gene").alias("seed"), "m")
    n = sparse_cells(spark, sf).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    # the genes of a cell, then every pair of them
    own = spread(x, ["unit"]).groupBy("unit", "cell_type").agg(F.collect_list(F.struct("gene", "value")).alias("_g"))
    pairs = own.select("cell_type", "_g", F.explode("_g").alias("a")).select("cell_type", "a", F.explode("_g").alias("b"))
    prod = pairs.groupBy("cell_type", F.col("a.gene").alias("seed"), F.col("b.gene").alias("gene")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("ab"))
    prod = cut_lineage(prod.join(b.select(F.col("gene").alias("seed")).distinct(), "seed", "left_semi"))
    xs = cut_lineage(x.groupBy("cell_type", "gene").agg(F.sum("value").alias("x1"), F.sum(F.col("value") * F.col("value")).alias("x2")))
    s1 = xs.withColumnRenamed("gene", "seed").join(seeds, "seed").groupBy("cell_type", "prototype", "tag").agg(F.sum(F.col("x1") / F.col("m")).alias("s1"))
    xy = prod.join(seeds, "seed").groupBy("cell_type", "prototype", "tag", "gene").agg(F.sum(F.col("ab") / F.col("m")).alias("xy"))
    inside = seeds.select("prototype", "tag", F.col("seed").alias("gene"), "m")
    s2 = xy.join(inside, ["prototype", "tag", "gene"]).groupBy("cell_type", "prototype", "tag").agg(F.sum(F.col("xy") / F.col("m")).alias("s2"))
    ss = s1.join(s2, ["cell_type", "prototype", "tag"])
    j = ss.join(xs, "cell_type").join(n, "cell_type").join(xy, ["cell_type", "prototype", "tag", "gene"], "left").fillna(0.0, ["xy"])
    cov = F.col("n") * F.col("xy") - F.col("s1") * F.col("x1")
    var = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) * (F.col("n") * F.col("x2") - F.col("x1") * F.col("x1"))
    return j.select("cell_type", "prototype", "tag", "gene", F.when(var > 0, cov / F.sqrt(var)).alias("r"))


def refined(spark, sf):
    def build():
        m = markers(spark, sf).select("cell_type", F.col("cell_type").alias("macro"), F.col("target").alias("prototype"), "gene", "avg_log2fc")
        return Sc.refine_weights(m, bank(spark, sf), prior(spark, sf), seed_correlation(spark, sf), 120)

    return staged(spark, ("refined", sf), build)


@query("A46 W4 W5 J13", f"""with {MEASURES}, {_SPARSE}, {_MK}, {_SIG}, {_FOUND}, {_BANK}, {_PRIOR_SQL}, {_CORR}, {_REFINE} select prototype, tag, gene, round(weight, 5) as weight from refined""")
def refined_bank_weights(spark, sf):
    return refined(spark, sf).withColumn("weight", F.round("weight", 5))


_FUSE = """fb as (select distinct prototype, tag, gene from (select prototype, tag, gene from bank union all select prototype, tag, gene from refined)),
    fw as (select prototype, tag, gene, weight from refined union all select f.prototype, f.tag, f.gene, 0.6 * (select median(weight) from refined) from fb f where tag = 'identity_up' and not exists (select 1 from refined r where r.prototype = f.prototype and r.tag = f.tag and r.gene = f.gene)),
    sc as (select w.prototype, w.gene, w.weight, weight * (case when exists (select 1 from fb where fb.prototype = w.prototype and fb.gene = w.gene and tag = 'pcr_up') then 1.6 else 1 end) * (case when exists (select 1 from fb where fb.prototype = w.prototype and fb.gene = w.gene and tag = 'pcr_down') then 0.5 else 1 end)
      * (case when exists (select 1 from fb where fb.prototype <> w.prototype and fb.gene = w.gene and tag = 'pcr_up') then 0.7 else 1 end) / (select count(*) from fw x where x.gene = w.gene) as score from fw w where tag = 'identity_up'),
    ki as (select * from (select *, row_number() over (partition by prototype order by score desc, gene) as rk from sc) where rk <= 200),
    outw as (select prototype, 'identity_up' as tag, gene, weight from ki union all select prototype, tag, gene, weight from fw where tag <> 'identity_up' union all select prototype, tag, gene, 1.0::double from fb where tag in ('pcr_up', 'pcr_down'))"""


def fused(spark, sf):
    return Sc.fuse_markers(bank(spark, sf), refined(spark, sf).select("prototype", "tag", "gene"), refined(spark, sf), top=200, least=60)


@query("A48", f"""with {MEASURES}, {_SPARSE}, {_MK}, {_SIG}, {_FOUND}, {_BANK}, {_PRIOR_SQL}, {_CORR}, {_REFINE}, {_FUSE} select prototype, tag, gene, round(weight, 5) as weight from outw""")
def fused_weights(spark, sf):
    return fused(spark, sf)[1].withColumn("weight", F.round("weight", 5))


@query("A48 U4 U5 U6", f"""with {MEASURES}, {_SPARSE}, {_MK}, {_SIG}, {_FOUND}, {_BANK}, {_PRIOR_SQL}, {_CORR}, {_REFINE}, {_FUSE},
    dn as (select distinct a.prototype, b.gene from (select distinct prototype from ki) a join ki b on a.prototype <> b.prototype where not exists (select 1 from ki c where c.prototype = a.prototype and c.gene = b.gene)),
    co as (select prototype, gene from fb where tag = 'core'), ca as (select k.prototype, k.gene, row_number() over (partition by k.prototype order by k.gene) as rk from ki k where not exists (select 1 from co where co.prototype = k.prototype and co.gene = k.gene)),
    core2 as (select * from co union all select prototype, gene from ca where rk <= 60 - (select count(*) from co where co.prototype = ca.prototype)),
    eo as (select prototype, gene from fb where tag = 'edge'), ea as (select k.prototype, k.gene, row_number() over (partition by k.prototype order by k.gene) as rk from ki k where not exists (select 1 from eo where eo.prototype = k.prototype and eo.gene = k.gene) and not exists (select 1 from core2 c where c.prototype = k.prototype and c.gene = k.gene)),
    edge2 as (select * from eo union all select prototype, gene from ea where rk <= 60 - (select count(*) from eo where eo.prototype = ea.prototype))
    select prototype, 'identity_up' as tag, gene from ki union all select prototype, 'identity_down', gene from dn union all select prototype, 'core', gene from core2 union all select prototype, 'edge', gene from edge2 union all select prototype, tag, gene from fb where tag in ('pcr_up', 'pcr_down')""")
def fused_bank(spark, sf):
    return fused(spark, sf)[0].select("prototype", "tag", "gene")


_SETS = """sets as (select 'set' || k as name, gene from (select distinct upper(replace(p_brand, '#', '')) as gene from part), (select unnest(range(0, 8)) as k)
      where ('0x' || substr(md5(k || ':' || gene), 1, 8))::bigint % (k + 2) = 0)"""


def gene_sets(spark, sf):
    """Eight overlapping sets, each a hashed share of the genes."""
    genes = load(spark, sf, "part").select(F.upper(F.regexp_replace("p_brand", "#", "")).alias("gene")).distinct()
    k = F.col("k")
    draw = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(":"), F.col("gene"))), 1, 8), 16, 10).cast("long")
    sets = genes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(draw % (k + 2) == 0)
    return sets.select(F.concat(F.lit("set"), k.cast("string")).alias("name"), "gene")


_UE = "ue as (select unit, gene, sum(value) as value from measures group by all)"


def unit_expr(spark, sf):
    return measures(spark, sf).groupBy("unit", "gene").agg(F.sum("value").alias("value"))


@query("A39", f"""with {MEASURES}, {_SETS}, {_UE}, r as (select *, least({Q.avg_rank('unit', '-value')}, 31) as rk from ue), n as (select name, count(*) as n from sets group by 1),
    h as (select unit, name, sum(rk) as s, count(*) as f from r join sets using (gene) group by all)
    select u.unit, n.name, round(greatest(1 - (coalesce(s, 0) + (n - coalesce(f, 0)) * 31 - n * (n + 1) / 2) / (n * 30), 0), 6) as score from (select distinct unit from ue) u join n on true left join h on h.unit = u.unit and h.name = n.name""")
def rank_signature_scores(spark, sf):
    return Sc.rank_score_everywhere(unit_expr(spark, sf), gene_sets(spark, sf), ["unit"], 30).withColumns(r6("score"))


@query("A40 W18", f"""with {MEASURES}, {_SETS}, se as (select sample_name, gene, avg(value) as value from measures group by all),
    r as (select *, row_number() over (partition by sample_name order by value desc, gene) as pos, count(*) over (partition by sample_name) as n from se),
    x as (select r.*, s.name, s4.gene is not null as hit from r join (select distinct name from sets) s on true left join sets s4 on s4.name = s.name and s4.gene = r.gene),
    c as (select *, sum(case when hit then pow(n - pos + 1, 0.25) else 0 end) over w / sum(case when hit then pow(n - pos + 1, 0.25) else 0 end) over p as pin, sum((not hit)::int) over w / nullif(sum((not hit)::int) over p, 0) as pout from x
      window w as (partition by sample_name, name order by pos), p as (partition by sample_name, name))
    select sample_name, name, round(sum(pin - pout), 5) as score from c group by all""")
def single_sample_enrichment(spark, sf):
    e = measures(spark, sf).groupBy("sample_name", "gene").agg(F.avg("value").alias("value"))
    return Sc.enrichment_score(e, gene_sets(spark, sf), ["sample_name"]).withColumn("score", F.round("score", 5))


_BW = "bw as (select prototype, tag, gene, (1 + length(gene) % 3) / 2.0::double as weight from bank where tag <> 'edge')"


def bank_weights(spark, sf):
    return bank(spark, sf).where("tag <> 'edge'").withColumn("weight", (1 + F.length("gene") % 3) / 2.0)


def _tracks(src, unit):
    return f"""ts as (select {unit}, b.prototype, b.tag, case when sum(coalesce(weight, 0)) > 0 then sum(coalesce(weight, 0) * value) / sum(coalesce(weight, 0)) else avg(value) end as s from {src} join bank b using (gene) left join bw w on w.prototype = b.prototype and w.tag = b.tag and w.gene = b.gene group by all),
    tr as (select {unit}, prototype, {', '.join(f"coalesce(max(s) filter (tag = '{u}'), 0) - coalesce(max(s) filter (tag = '{d}'), 0) as {n}" for n, u, d in Sc.TRACKS)} from ts group by all)"""


@query("A41", f"""with {MEASURES}, {_SIG}, {_FOUND}, {_BANK}, {_BW}, {_UE}, {_tracks('ue', 'unit')} select unit, prototype, round(identity, 6) as identity, round(spatial, 6) as spatial, round(functional, 6) as functional from tr""")
def weighted_bank_scores(spark, sf):
    return Sc.bank_scores(unit_expr(spark, sf), bank(spark, sf), bank_weights(spark, sf), ["unit"]).withColumns(r6("identity", "spatial", "functional"))


@query("A42 W2 D17", f"""with {MEASURES}, {_SIG}, {_FOUND}, {_BANK}, {_BW}, se as (select sample_name, gene, avg(value) as v from measures group by all),
    rr as (select sample_name, gene, ({Q.avg_rank('sample_name', 'v')} - 1) / (count(*) over (partition by sample_name) - 1) as value from se), {_tracks('rr', 'sample_name')}
    select sample_name, prototype, round(identity, 6) as identity, round(spatial, 6) as spatial, round(functional, 6) as functional from tr""")
def bulk_rank_scores(spark, sf):
    e = measures(spark, sf).groupBy("sample_name", "gene").agg(F.avg("value").alias("v"))
    r = O.unit_ranks(e, ["sample_name"], "v", "value")
    return Sc.bank_scores(r, bank(spark, sf), bank_weights(spark, sf), ["sample_name"]).withColumns(r6("identity", "spatial", "functional"))


@query("A43 W3 J13 J21", f"""with {MEASURES}, {_SIG}, {_FOUND}, {_BANK}, {_BW}, {_UE}, {_tracks('ue', 'unit')}, {_PRIOR_SQL}, mac as (select unit, any_value(cell_type) as macro from measures group by unit),
    s as (select unit, prototype, frac, (identity > 0)::int + (spatial > 0)::int + (functional > 0)::int as tracks, (identity + 0.5 * spatial + 0.5 * functional) * greatest(coalesce(frac, 1), 1e-6) as raw from tr join mac using (unit) left join prior using (prototype, macro)),
    z as (select s.*, (raw - mu) / (case when sd >= 1e-6 then sd else 1 end) as z from s join (select prototype, avg(raw) as mu, stddev_samp(raw) as sd from s group by 1) using (prototype)),
    k as (select *, row_number() over (partition by unit order by z desc, prototype) as rk, lead(z) over (partition by unit order by z desc, prototype) as z2 from z)
    select unit, prototype as best, round(z, 5) as top1, round(z2, 5) as top2, round(z - z2, 5) as margin, case when z - z2 >= 0.1 and tracks >= 2 and coalesce(frac, '-inf'::double) >= 0.15 then prototype end as called from k where rk = 1""")
def prototype_calls(spark, sf):
    sc = Sc.bank_scores(unit_expr(spark, sf), bank(spark, sf), bank_weights(spark, sf), ["unit"])
    mac = measures(spark, sf).groupBy("unit").agg(F.min("cell_type").alias("macro"))
    c = Sc.call_prototypes(sc, mac, prior(spark, sf), "unit", prior_gate=0.15)
    return c.withColumns(r6("top1", "top2", "margin", digits=5))


@query("A44 G51", f"""with recursive {CELLS}, o as (select 'Prototype' || prototype_id as name, cell_type as macro, count(*) / sum(count(*)) over (partition by prototype_id) as frac from cells group by prototype_id, cell_type),
    pr as (select 'Prior' || sample_name as name, cell_type as macro, count(*) / sum(count(*)) over (partition by sample_name) as frac from cells group by sample_name, cell_type),
    sim as (select o.name as s, p.name as t, sum(o.frac * p.frac) / ((select sqrt(sum(frac * frac)) from o o2 where o2.name = o.name) * (select sqrt(sum(frac * frac)) from pr p2 where p2.name = p.name)) as sim from o join pr p using (macro) group by o.name, p.name),
    ord as (select s, row_number() over (order by s) as rn from (select distinct s from sim)),
    g(rn, s, t, sim, used) as (select 0::bigint, '', '', 0.0::double, []::varchar[] union all
      select o.rn, o.s, b.t, b.sim, list_append(g.used, b.t) from g join ord o on o.rn = g.rn + 1 join lateral (select x.t, x.sim from sim x where x.s = o.s and not list_contains(g.used, x.t) order by x.sim desc, x.t limit 1) b on true)
    select s as source, t as target, round(sim, 6) as similarity from g where rn > 0""")
def prior_alignment(spark, sf):
    comp = lambda key, prefix: P.composition(cells(spark, sf), [key], "cell_type").select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("name"), F.col("cell_type").alias("macro"), F.col("share").alias("frac")
    )
    return Sc.align_by_similarity(comp("prototype_id", "Prototype"), comp("sample_name", "Prior")).withColumns(r6("similarity"))


@query("G56", f"""with {CELLS}, o as (select cell_type, prototype_id, count(*) as n, count(*) / sum(count(*)) over (partition by prototype_id) as s from cells group by cell_type, prototype_id)
    select cell_type, count(*) filter (s < 0.2) as low, count(*) > 1 as duplicated, (select count(*) from cells where cell_type = 'Unknown') as unlabelled from o group by cell_type""")
def alignment_quality(spark, sf):
    c = cells(spark, sf)
    o = P.composition(c, ["prototype_id"], "cell_type")
    q = o.groupBy("cell_type").agg(F.count_if(F.col("share") < 0.2).alias("low"), (F.count(F.lit(1)) > 1).alias("duplicated"))
    return q.withColumn("unlabelled", c.agg(F.count_if(F.col("cell_type") == "Unknown")).scalar())


@query("G45", f"""with {CELLS}, l as (select sample_name, node_idx, unnest(embedding)::double as s, generate_subscripts(embedding, 1) - 1 as cls from cells),
    t as (select sample_name, cls, avg(s) as score from (select *, row_number() over (partition by sample_name, cls order by s desc, node_idx) as rk from l) where rk <= 5 group by all)
    select sample_name, cls::int as cls, round(score, 6) as score, score = max(score) over (partition by sample_name) as best from t""")
def top_j_pooling(spark, sf):
    c = cells(spark, sf).withColumn("s", F.col("embedding"))
    t = Sc.top_j_pooling(c, "sample_name", ["node_idx"], "s", 5)
    best = t.groupBy("sample_name").agg(F.max_by("cls", "score").alias("b"))
    return t.join(best, "sample_name").select("sample_name", "cls", F.round("score", 6).alias("score"), (F.col("cls") == F.col("b")).alias("best"))


_LRG = sorted({g for ps in LIGAND_RECEPTOR.values() for p in ps for g in p})
_LRX = f"""lx as (select c_mktsegment as grp, 'N' || c_nationkey as sample_name, ({_LRG})[(p_partkey % {len(_LRG)} + 1)::int] as gene, l_quantity as value from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
    pt as (select * from (values {', '.join(f"('{a}', '{l}', '{r}')" for a, ps in LIGAND_RECEPTOR.items() for l, r in ps)}) v(axis, ligand, receptor))"""


def lr_expr(spark, sf, keys):
    li, o, c, p = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "part"))
    names = F.array(*[F.lit(g) for g in _LRG])
    x = (
        li.join(p.select("p_partkey"), li.l_partkey == p.p_partkey)
        .join(o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey", "c_mktsegment"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("c_mktsegment").alias("grp"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("sample_name"),
            names[(F.col("p_partkey") % len(_LRG)).cast("int")].alias("gene"),
            F.col("l_quantity").alias("value"),
        )
    )
    return x.groupBy(*keys, "gene").agg(F.avg("value").alias("value"))


@query("F50", f"""with {_LRX}, e as (select sample_name, gene, avg(value) as value from lx group by all), s as (select sample_name, gene, (value - min(value) over (partition by gene)) / (max(value) over (partition by gene) - min(value) over (partition by gene) + 1e-9) as v from e)
    select l.sample_name, axis, round(avg(sqrt(l.v * r.v)), 6) as score from pt join s l on l.gene = ligand join s r on r.gene = receptor and r.sample_name = l.sample_name group by all""")
def ligand_receptor_axes(spark, sf):
    return Sc.axis_scores(lr_expr(spark, sf, ["sample_name"]), ["sample_name"]).withColumns(r6("score"))


_COMM = f"""{_LRX}, m as (select grp, gene, avg(value) as value from lx group by all), cm as (select axis, ligand, receptor, l.grp as source, r.grp as target, l.value * r.value as prob from pt join m l on l.gene = ligand join m r on r.gene = receptor)"""


def comm(spark, sf):
    return Sc.communication(lr_expr(spark, sf, ["grp"]), Sc.pair_table(spark))


@query("A55", f"with {_COMM} select axis, source, target, round(sum(prob), 4) as prob from cm group by all")
def communication_by_axis(spark, sf):
    return comm(spark, sf).groupBy("axis", "source", "target").agg(F.round(F.sum("prob"), 4).alias("prob"))


@query("G47", f"with {_COMM} select grp, round(sent, 4) as sent, round(received, 4) as received from (select source as grp, sum(prob) as sent from cm group by 1) join (select target as grp, sum(prob) as received from cm group by 1) using (grp)")
def sender_receiver_strength(spark, sf):
    return Sc.sender_receiver(comm(spark, sf)).withColumns(r6("sent", "received", digits=4))


@query("G48", f"with {_COMM} select ligand, receptor, source, target, round(sum(prob), 4) as prob from cm group by all order by sum(prob) desc, ligand, receptor, source, target limit 20")
def top_ligand_receptor(spark, sf):
    c = comm(spark, sf).groupBy("ligand", "receptor", "source", "target").agg(F.sum("prob").alias("prob"))
    return c.orderBy(F.desc("prob"), "ligand", "receptor", "source", "target").limit(20).withColumns(r6("prob", digits=4))


