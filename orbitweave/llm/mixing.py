"""Mixing sources to target weights by budgets on a tree of domains, languages and sources.

The budget of tokens is dealt from the root by weights. A node cannot take more than
its documents hold in ``max_epochs`` passes; what it cannot take goes to its
siblings, by weight, and only what all of them together cannot take was never dealt
to their parent. Each source then takes its tokens from a seeded order of its
documents, one whole pass after another, and of the last pass a prefix.

Budgets work on one row per source. A prefix is found without ordering a source as a
whole: tokens are counted in fine cells of the seeded order, and only documents of
the one cell where the prefix ends are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize
from .tokens import count_ids

LEVELS = ("domain", "lang", "source")
#: Each level cuts a cell of the seeded order into 64: after three, 262,144 cells a source.
CELL_LEVELS = 3
_PIECE_DOCS = 1024


def deal(children: DataFrame, budgets: DataFrame, parent: list[str]) -> DataFrame:
    """(columns of ``children``, budget) from ``children`` (parent columns, key, weight, room) and ``budgets``.

    Within a parent every child gets its share by weight or its room if that is less,
    and what rooms leave over goes to the others by weight. Sorted by room per weight,
    a child is full if that is at most what the budget left by those before it gives
    per weight of the rest; the first child that is not full sets the level of all
    others. Rows are nodes of the tree, never documents.
    """
    within = W.partitionBy(*parent)
    before = within.orderBy("ratio", "key").rowsBetween(W.unboundedPreceding, -1)
    rows = children.where("weight > 0").join(budgets, parent).withColumn("ratio", F.col("room") / F.col("weight"))
    rows = rows.withColumn("filled", F.coalesce(F.sum("room").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(within) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open"))
    is_full = F.col("ratio") <= F.col("level")
    level = F.max(F.when(~is_full, F.col("level"))).over(within)
    budget = F.when(is_full, F.col("room")).otherwise(F.greatest(level, F.lit(0.0)) * F.col("weight"))
    return rows.withColumn("budget", budget).select(*children.columns, "budget")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, total: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, weight, budget, leaf) from (domain, lang, source, tokens) and the leaves' weights.

    ``weights`` has a leaf's target weight; a leaf without one gets 0, and a null or
    negative weight counts as 0. A node's weight is the sum over its leaves.
    """
    key = _leaf(*(_named(c) for c in LEVELS))
    known = weights.select(key.alias("leaf"), F.greatest("weight", F.lit(0.0)).alias("weight")).groupBy("leaf").agg(F.sum("weight").alias("weight"))
    rows = leaves.select(*LEVELS, "tokens", key.alias("leaf")).join(known, "leaf", "left")
    rows = rows.select(*LEVELS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows = rows.withColumn("room", F.when(F.col("weight") > 0, F.col("tokens") * float(max_epochs)).otherwise(0.0))
    keys = [f"{c}_key" for c in LEVELS]
    for c, key in zip(LEVELS, keys, strict=True):
        rows = rows.withColumn(key, _named(c))
    rows = materialize(rows.withColumn("root", F.lit("")), "mix-leaves")
    budgets = rows.select("root").distinct().withColumn("budget", F.lit(float(total)))
    for depth in range(1, len(LEVELS) + 1):
        parent = ["root", *keys[: depth - 1]]
        nodes = rows.groupBy(*parent, F.col(keys[depth - 1]).alias("key")).agg(
            F.sum("weight").alias("weight"), F.sum("room").alias("room")
        )
        budgets = materialize(
            deal(nodes, budgets, parent).select(*parent, F.col("key").alias(keys[depth - 1]), "budget"), "mix-level"
        )
    budgets = budgets.drop("root")
    return rows.join(budgets, keys, "left").select(
        *LEVELS, "tokens", "weight", F.floor(F.coalesce("budget", F.lit(0.0))).alias("budget"), _leaf(*keys).alias("leaf")
    )


def _named(column: str) -> Column:
    """A name that tells a null from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _leaf(*names: str | Column) -> Column:
    return F.to_json(F.array(*names))


def word_count(text: Column) -> Column:
    """White-space separated words of a text; a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _counted(rows: DataFrame, tokenizer: str | None) -> DataFrame:
    """``rows`` with the column ``tokens`` in place of ``text``."""
    if tokenizer is None:
        return rows.withColumn("tokens", word_count(F.col("text"))).drop("text")
    names = [c for c in rows.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counted = batch.column("text"), []
            for at in range(0, len(batch), _PIECE_DOCS):
                counted += count_ids(texts.slice(at, _PIECE_DOCS).to_pylist(), tokenizer)
            counts = pa.array(counted, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), counts], [*names, "tokens"])

    bare = rows.withColumn("text", F.col("text").cast("binary"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return bare.mapInArrow(count, f"{kinds}, tokens long")


def mix(
    docs: DataFrame, weights: DataFrame, domain: Column, lang: Column, source: Column, share: float = 0.8,
    max_epochs: int = 1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
) -> DataFrame:
    """The chosen rows of ``docs`` with ``mix_epoch`` (from 0), a row per epoch that takes it.

    The budget is ``share`` of all tokens: ids of the ``tokenizer`` file, or words where
    none is named. A pass that the budget pays for takes the whole source, texts without
    tokens too, and a source of weight that has no tokens at all is taken whole once. Of
    a pass that it pays for in part, a document is in the prefix if the tokens ahead of
    it in its source's seeded order are fewer than what is left; so a source exceeds its
    budget by less than a document, and texts without tokens go with the prefix they fall
    into. Null names of domain, language or source are names of their own; rows that
    share an id, such as repeated ones or those with a null id, stand or fall together; a
    column ``mix_epoch`` of ``docs`` is replaced; an empty table stays empty.
    """
    parts = [domain.alias("domain"), lang.alias("lang"), source.alias("source")]
    leaf = _leaf(*(_named(c) for c in LEVELS))
    tagged = docs.select(*parts, F.xxhash64(F.lit(seed), F.col(id_col)).alias("base"), F.col(text_col).alias("text"))
    tagged = _counted(tagged, tokenizer).withColumnRenamed("tokens", "words")
    tagged = materialize(tagged.withColumn("leaf", leaf), "mix-words")
    leaves = tagged.groupBy(*LEVELS).agg(F.sum("words").cast("double").alias("tokens"))
    leaves = materialize(leaves, "mix-sources")
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0.0) * share
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    left = F.greatest(F.col("budget") - F.col("epoch") * F.col("tokens"), F.lit(0)).cast("double")
    budgets = leaf_budgets(leaves, weights, total, max_epochs).where("weight > 0").select("*", epochs)
    budgets = materialize(budgets.select("leaf", "epoch", "tokens", left.alias("left")), "mix-due")
    is_whole = (F.col("left") >= F.col("tokens")) & ((F.col("tokens") > 0) | (F.col("epoch") == 0))
    whole = budgets.where(is_whole).select("leaf", "epoch", F.lit((1 << 63) - 1).alias("end"))
    edge = budgets.where(~is_whole & (F.col("left") > 0)).select(
        "leaf", "epoch", F.col("left").alias("due"), F.lit(0.0).alias("ahead"), F.lit(0).cast("long").alias("prefix")
    )
    place = F.xxhash64("base", "epoch")
    seen = tagged.select("leaf", "words", "base")
    for depth in range(1, CELL_LEVELS + 1):
        # Rows in the cell that holds the end of the prefix so far, counted in its 64 parts.
        inside = _in_cell(seen, edge, place, depth - 1).groupBy("leaf", "epoch", _cell(F.col("place"), depth).alias("cell")).agg(
            F.sum("words").alias("words"), F.first("due").alias("due"), F.first("ahead").alias("base_ahead")
        )
        order = W.partitionBy("leaf", "epoch").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
        counted = inside.withColumn("ahead", F.col("base_ahead") + F.sum("words").over(order) - F.col("words"))
        edge = counted.where("ahead < due").groupBy("leaf", "epoch").agg(
            F.max("cell").alias("prefix"), F.max_by("ahead", "cell").alias("ahead"), F.first("due").alias("due")
        )
        edge = materialize(edge, "mix-edge")
    order = W.partitionBy("leaf", "epoch").orderBy("place")
    last = _in_cell(seen, edge, place, CELL_LEVELS).groupBy("leaf", "epoch", "place").agg(
        F.sum("words").alias("words"), F.first("due").alias("due"), F.first("ahead").alias("base_ahead")
    )
    last = last.withColumn("met", F.sum("words").over(order) - F.col("words")).where("base_ahead + met < due")
    ends = materialize(last.groupBy("leaf", "epoch").agg(F.max("place").alias("end")).unionByName(whole), "mix-ends")
    rows = docs.select(
        F.struct(*(c for c in docs.columns if c != "mix_epoch")).alias("row"), *parts, F.xxhash64(F.lit(seed), F.col(id_col)).alias("base")
    )
    chosen = rows.withColumn("leaf", leaf).join(ends, "leaf").where(place <= F.col("end"))
    return chosen.select("row.*", F.col("epoch").alias("mix_epoch"))


def _cell(place: Column, depth: int) -> Column:
    """The first 6 * ``depth`` bits of a place, in the order of places."""
    return F.shiftright(place, 64 - 6 * depth) if depth else F.lit(0).cast("long")


def _in_cell(rows: DataFrame, edge: DataFrame, place: Column, depth: int) -> DataFrame:
    joined = rows.join(edge, "leaf").withColumn("place", place)
    return joined.where(_cell(F.col("place"), depth) == F.col("prefix"))
