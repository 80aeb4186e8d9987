"""Exact deduplication over an extendible-hash index kept in shared files.

Every text has a 64-bit key. The index holds one entry per key, its newest document
and its number of rows. A bucket is a prefix of the key's bits: the directory doubles
until no bucket would hold more than ``capacity`` keys, and prefixes that fit as a
whole share one bucket. The directory tells every index entry and every document its
bucket, and owner tasks take contiguous ranges of buckets and keys: there an entry
meets the documents of its key, and each document is compared byte by byte with the
key's newest text. Those that differ form the key's next chain link, in the same
bucket, until every text has met an equal one.

Only DataFrame functions run. A key of more than ``split_rows`` documents is cut into
parts, each with a copy of its entry, so that no task holds all copies of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize

#: A directory of so many cells at most is sent to all tasks; a larger one is joined as a table.
SENT_CELLS = 1 << 21


def _cell(depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def bucket_directory(entries: DataFrame, capacity: int = 4096) -> tuple[int, DataFrame]:
    """The global depth, and (cell, depth, bucket) for each cell of that many bits that has keys.

    The directory starts from as many doublings as so many keys must cause and goes on
    doubling, four bits at a time, while a cell holds more than ``capacity`` keys. All
    cells below the shortest prefix that fits share its bucket, whose number is the
    prefix's first cell. Rows are cells, far fewer than keys.
    """
    keys, depth = entries.count(), 0
    while depth < 64 and keys > capacity << depth:
        depth += 1
    while True:
        cells = materialize(entries.groupBy(_cell(depth).alias("cell")).agg(F.count("*").alias("n")), "dedup-cells")
        if depth == 64 or cells.where(F.col("n") > capacity).isEmpty():
            break
        depth = min(64, depth + 4)
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    # A shift by 64 bits would shift by none, so the empty prefix is named on its own.
    low = F.lit(depth) - F.col("depth")
    bucket = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.call_function("shiftrightunsigned", "cell", low), low)
    )
    levels = levels.withColumn("bucket", bucket)
    fits = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == depth))
    leaves = levels.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("leaf"))
    return depth, materialize(leaves.select("cell", "leaf.depth", "leaf.bucket"), "dedup-directory")


def _met(base: DataFrame, entries: DataFrame, split_rows: int, link: int) -> DataFrame:
    """``base`` (id, h, bucket, text) with its key's keep and n, its hash, and whether its text is the newest one's.

    Documents and entries go to the owner of their range of (bucket, key, part) and are
    read in order there: the entry, then the documents from the newest on.
    """
    # No more rows than all rows by split_rows.
    hot = materialize(entries.where(F.col("n") > split_rows).select("h", F.ceil(F.col("n") / split_rows).cast("int").alias("parts")), "dedup-hot")
    newest = base.join(F.broadcast(hot), "h").join(entries.select("h", "keep"), "h").where(F.col("id").eqNullSafe(F.col("keep")))
    newest = newest.groupBy("h").agg(F.max("text").alias("text"))
    place = ("bucket", "h", "part")
    # The place in its file tells rows apart that share an id; a task that runs again reads them in the same order.
    apart = F.xxhash64("id", F.monotonically_increasing_id())
    docs = base.withColumn("apart", apart).join(F.broadcast(hot), "h", "left").select(
        "bucket", "h", F.pmod("apart", F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
        F.lit(1).alias("kind"), "id", "text", F.lit(None).cast(entries.schema["keep"].dataType).alias("keep"), F.lit(None).cast("long").alias("n"),
    )
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    rows = entries.join(F.broadcast(hot), "h", "left").select("bucket", "h", parts, "keep", "n").join(newest, "h", "left")
    index = rows.select(*place, F.lit(0).alias("kind"), F.lit(None).cast(base.schema["id"].dataType).alias("id"), "text", "keep", "n")
    owned = docs.unionByName(index).repartitionByRange(*place)
    order = W.partitionBy(*place).orderBy("kind", F.col("id").desc_nulls_last(), F.desc("text"))
    seen = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.col("text") == F.first("text", ignorenulls=True).over(seen)
    owned = owned.select("kind", "id", "h", "bucket", "text", F.first("keep").over(seen).alias("keep"), F.first("n").over(seen).alias("n"), same.alias("same"))
    return materialize(
        owned.where("kind = 1").select(
            "id", "h", "bucket", "keep", "n", F.sha2("text", 256).alias("sha"), "same", F.when(~F.col("same"), F.col("text")).alias("text")
        ),
        f"dedup-link{link}",
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Callable[[Column], Column] = F.xxhash64,
    capacity: int | None = None,
    split_rows: int | None = None,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, bucket, link.

    Of equal texts the row with the largest id is kept. A null text is an empty
    one; empty texts equal each other. Rows with a null id lose to any other id; a
    group that has only null ids keeps them all. A row repeated with its id counts
    in ``group_size`` and is kept wherever that id is. Other columns of ``docs``
    are ignored; an empty table gives an empty result. ``key`` maps a text to a
    BIGINT; a poor one costs time, not correctness. By default a bucket takes 4,096
    keys or a quarter of a task's share, and a key is split at an eighth of a task's
    share of rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key(text).alias("h"))
    found = materialize(rows.groupBy("h").agg(F.max("id").alias("keep"), F.count("*").alias("n")), "dedup-entries")
    keys, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth, directory = bucket_directory(found, capacity or max(4096, keys // (4 * tasks)))
    directory = directory.select("cell", "bucket")
    directory = F.broadcast(directory) if directory.count() <= SENT_CELLS else directory

    def in_buckets(keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("cell", _cell(depth)).join(directory, "cell").drop("cell")

    split_rows = split_rows or max(16, total // (8 * tasks))
    base, entries = in_buckets(rows), materialize(in_buckets(found).sortWithinPartitions("bucket", "h"), "dedup-index")
    parts, link = [], 1
    while True:
        met = _met(base, entries, split_rows, link)
        base = met.where("not same").select("id", "h", "bucket", "text")
        # The entries of the keys' next links: keys that two texts share.
        entries = materialize(base.groupBy("bucket", "h").agg(F.max("id").alias("keep"), F.count("*").alias("n")), "dedup-chain")
        same = met.where("same")
        if entries.isEmpty():
            parts.append(same.select("id", "keep", "n", "sha", "bucket", F.lit(link).alias("link")))
            break
        others = same.join(entries.select("h", F.col("n").alias("others")), "h", "left")
        parts.append(others.select("id", "keep", (F.col("n") - F.coalesce("others", F.lit(0))).alias("n"), "sha", "bucket", F.lit(link).alias("link")))
        link += 1
    return reduce(DataFrame.unionAll, parts).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "link",
    )
