"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import bpe, extract, langid, metric_join, minhash, packing, rabitq, shard, toxicity, url_filter
from chunkloom.llm._common import read


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(read(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.held_out()
    lexicon = toxicity.fit_lexicon(docs, read(spark, sf_dir, "labels").filter(~out))
    scored = toxicity.score_toxicity(docs.withColumn("held_out", out), lexicon, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.held_out()
    profiles = langid.fit_profiles(docs.filter(~out))
    return langid.predict_languages(docs.withColumn("held_out", out), profiles, keep=["doc_id", "held_out"])


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.metric_join(read(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = shard.external_shuffle(read(spark, sf_dir, "documents"))
    return shuffled.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_suffix_array": op1_host_suffix_array,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit": op4_best_fit,
    "op5_rabitq": op5_rabitq,
    "op6_language_id": op6_language_id,
    "op7_metric_join": op7_metric_join,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_external_shuffle": op10_external_shuffle,
}

VALID_SQL = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
REACH_SQL = """
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT e.b, r FROM reach JOIN both_ways e ON e.a = id),
comp AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
"""

ORACLES: dict[str, str] = {
    "op5_rabitq": f"""
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {VALID_SQL}),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_metric_join": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND {VALID_SQL}),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
{REACH_SQL}, n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(r, vec_id) AS component_id, vec_id = coalesce(r, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.id = vec_id""",
    "op8_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
"""
    + REACH_SQL
    + """
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id, d.doc_id = coalesce(r, d.doc_id) AS kept
FROM documents d LEFT JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_url_filter": url_filter.oracle(),
}
