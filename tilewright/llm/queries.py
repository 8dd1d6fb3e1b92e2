"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, centroids, fill_middle, hmm, importance, lines, packing, rules, simhash, token_counts, topk, toxicity, warc
from tilewright.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under the function's name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


@query()
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_packing(load(spark, sf_dir, "documents"))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(load(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "ids"
    )
    decoded = byte_bpe.decode(digests)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query(rules.RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(load(spark, sf_dir, "documents")).withColumn("left_md5", F.md5("text")).drop("text")


@query()
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("row.doc_id", "log_weight", "gumbel_key", "kept")


@query("""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
where rank <= 5""")
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"))


@query(warc.ARCHIVE_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.shared_uri(spark, "archives")
    manifest = warc.archive(load(spark, sf_dir, "pages"), folder)
    back = warc.read_archives(manifest, folder)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(load(spark, sf_dir, "documents"))


@query(lines.LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(load(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_exact", "n_near", F.md5("text").alias("text_md5"))


@query(fill_middle.FILL_SQL)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query(centroids.clusters_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(load(spark, sf_dir, "embeddings"))


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
