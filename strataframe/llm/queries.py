"""The registered queries of this folder's operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@_query
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import read_documents, write_token_file

    return read_documents(spark, write_token_file(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents")).drop("spans")


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_words

    return repeated_words(_table(spark, sf_dir, "documents")).drop("spans")


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("row_key")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import NONE, mix

    docs = _table(spark, sf_dir, "documents")
    named = lambda c: F.coalesce(c, F.lit(NONE)).alias(c)
    return mix(docs).select("doc_id", named("source"), named("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


def _op2_sql() -> str:
    from .mixing import mix_sql

    return mix_sql()


ORACLES["op2_source_mixing"] = _op2_sql()


@_query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0)


def _op5_sql() -> str:
    from .exact_topk import exact_top_k_sql

    return exact_top_k_sql()


ORACLES["op5_exact_topk"] = _op5_sql()


@_query
def op9_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0)


#: exact results over whole tables; small ones only, since SQL holds every window as a string
ORACLES["op1_suffix_array_dedup"] = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, b[i:i + 199] AS k FROM d, unnest(range(1, octet_length(b) - 198)) AS t(i)),
m AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM r GROUP BY doc_id, k),
n AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, z AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM spans UNION ALL SELECT doc_id, 1, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(hex(b[x:coalesce(y, octet_length(b) + 1) - 1]), '' ORDER BY x) AS h FROM edges e JOIN d USING (doc_id) WHERE coalesce(y, octet_length(b) + 1) > x GROUP BY e.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n.doc_id IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
ORACLES["op3_substring_dedup"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s),
gone AS (SELECT DISTINCT doc_id, j FROM m, unnest(range(i, i + 50)) AS t(j) WHERE first < doc_id),
words AS (SELECT doc_id, w[j] AS word, j FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
ORACLES["op7_minhash_near_dedup"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN links ON r = x)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d"""
