"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .lm_scoring import backoff_scores
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .pii import find_personal_data
from .quality import quality_scores
from .recipes import MIX_SHARE, domain_of, source_weights
from .repeat_queries import op11_periodic_runs, op12_suffix_array_dedup, op13_phrase_collocations
from .threshold_topk import top_inner_products
from .tokens import default_tokenizer
from .token_files import read_token_files, write_token_files
from .url_rules import glob_rule, host_rule, judge_urls, rule_table, word_rule

#: Rules of the URL query: the fixed ones of host and path, then words and patterns of the method's own.
HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BLOCK_WORDS = [
    "adult", "bets", "betting", "casino", "escort", "gambling", "jackpot", "malware", "nude", "phishing", "poker", "porn",
    "sex", "slots", "spam", "viagra", "warez", "xxx",
]


BLOCK_GLOBS = ["*/wp-{admin,login,content}/*", "*/free-*-bonus/*", "*.casino.*/*", "*/{cgi-bin,phpmyadmin}/*.{php,cgi}", "track.*/click/*/out*"]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents`` as ``labels.quality`` marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``; the smallest doc_id of each is kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector of ``embeddings`` with all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(vectors, F.col("vec_id") % 100 == 0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of ``documents`` stay when equal texts are dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
             sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that mixing takes from ``documents`` in up to two epochs, by ids of the tokenizer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = domain_of(F.col("source")), F.col("lang"), F.col("source")
    mixed = mix(docs, source_weights(docs), *names, share=MIX_SHARE, max_epochs=2, tokenizer=default_tokenizer())
    return mixed.select("doc_id", F.col("mix_epoch").alias("epoch"), domain_of(F.col("source")).alias("domain"), "lang", "source")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all ``documents`` from counts over all of them."""
    return backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL of ``pages``."""
    rules = [host_rule(*r) for r in HOST_RULES] + [word_rule(w) for w in BLOCK_WORDS] + [glob_rule(g) for g in BLOCK_GLOBS]
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, rules))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as coded token ids and read back."""
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP8_SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, p.host, p.path,
         arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.action, length(r.host || r.path)) AS action
  FROM parts p LEFT JOIN (VALUES {", ".join(map(str, HOST_RULES))}) r(host, path, action)
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id, p.host, p.path)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({"|".join(BLOCK_WORDS)})([^a-z0-9]|$)')
                             OR regexp_matches(host || path, '{"|".join(glob_rule(g).pattern for g in BLOCK_GLOBS)}')
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_exact_topk": op4_exact_topk,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_mixing": op6_mixing,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_url_filters": op8_url_filters,
        "op9_pii": op9_pii,
        "op10_token_files": op10_token_files,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_suffix_array_dedup": op12_suffix_array_dedup,
        "op13_phrase_collocations": op13_phrase_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_url_filters": OP8_SQL}
