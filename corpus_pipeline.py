"""The corpus pipeline: quality, exact and near duplicates, mixing, packing.

Each stage reads all that the one before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm.exact_dedup import exact_dedup
from orbitweave.llm.mixing import mix
from orbitweave.llm.near_dedup import near_duplicates
from orbitweave.llm.packing import pack
from orbitweave.llm.quality import quality_scores
from orbitweave.llm.recipes import MIX_SHARE, domain_of, source_weights
from orbitweave.llm.shared import materialize
from orbitweave.llm.tokens import default_tokenizer

#: Least share of shingles, in a hundred of the union, that makes two documents near duplicates here.
NEAR_PERCENT = 80


#: Next to the id, what tells texts apart; a null text counts as an empty one.
TEXT_KEY = "text_key"


def _texts(docs: DataFrame) -> DataFrame:
    """Ids and texts alone, so that no other column can clash with an operator's."""
    return docs.select("doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text key): a whole row in one column, whatever its columns are called."""
    return docs.select(F.struct("*").alias("row"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias(TEXT_KEY))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left.doc_id.eqNullSafe(right.doc_id) & (left[TEXT_KEY] == right[TEXT_KEY])


def _rows_of(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose id, or missing id, and text are together among ``decided``'s."""
    wanted = decided.select("doc_id", TEXT_KEY).distinct()
    return keyed.join(wanted, _same(keyed, wanted), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A row follows its own text: rows that share an id, or have none, are judged one by one. Null texts are judged as
    empty ones. Equal rows stay or go together. Other columns pass unread. An empty table gives an empty one.
    """
    keyed = _keyed(docs)
    texts = keyed.select("doc_id", F.col("row.text").alias("text"), TEXT_KEY)
    scores = quality_scores(texts, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(TEXT_KEY,))
    return _rows_of(keyed, scores.where("predicted = 1")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id, and one row of it.

    A null text equals an empty one; a row without id stays only if no equal text has one. Of rows that have id and
    text in common, whatever their other columns, one stays. An empty table gives an empty one.
    """
    kept = exact_dedup(_texts(docs)).where("kept").select("doc_id", F.col("text_sha256").alias(TEXT_KEY))
    rows = _rows_of(_keyed(docs), kept)
    repeated = kept.groupBy("doc_id", TEXT_KEY).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return rows.select("row.*")
    twice = _rows_of(rows, repeated).dropDuplicates(["doc_id", TEXT_KEY])
    return rows.join(repeated, _same(rows, repeated), "left_anti").unionByName(twice).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; similarity is 0.8 or more.

    Where ids are missing or stand for several rows, numbers in the order of ids, missing ones last, take their
    place, so that every text is linked and kept for itself. Rows that have id and text in common stay or go together;
    null and empty texts are linked with nothing and all stay. Other columns pass unread. An empty table gives an
    empty one.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        decided = near_duplicates(_texts(docs), percent=NEAR_PERCENT).where("kept").select("doc_id")
        return docs.join(decided, "doc_id", "left_semi")
    keyed = _keyed(docs)
    order = keyed.select("doc_id", TEXT_KEY).distinct().orderBy(F.col("doc_id").asc_nulls_last(), TEXT_KEY)
    # Sorted partitions are numbered in their order; written once, the numbers stay.
    numbers = materialize(order.withColumn("place", F.monotonically_increasing_id()), "near-numbers")
    rows = materialize(keyed.join(numbers, _same(keyed, numbers)).select("row", "place"), "near-numbered")
    texts = rows.select("place", F.col("row.text").alias("text"))
    decided = near_duplicates(texts, id_col="place", percent=NEAR_PERCENT).where("kept").select("place")
    return rows.join(decided, "place", "left_semi").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that sources meet their target weights, in tokens, in one epoch.

    A null language or source is a name of its own. Rows that share an id, or have none, within a source stand or fall
    together, and so do documents whose places in the seeded order tie. Null and empty texts weigh nothing and go with
    the prefix they fall into, or with their source if it is taken whole. An empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    names = domain_of(F.col("source")), F.col("lang"), F.col("source")
    mixed = mix(rows, source_weights(rows), *names, share=MIX_SHARE, tokenizer=default_tokenizer())
    return mixed.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; repeated rows and rows without id are packed one by one, each with its
    own pieces. An empty table gives no sequence.
    """
    return pack(_texts(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: Classifier and tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
