"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates stay in their partitions, which tasks cut into blocks. A block keeps
one list of its vectors per dimension, sorted by component. For a query the lists
are read from the end that raises its score, some places at a time; every vector
met is scored in full, and the sum of the next entries of all lists bounds what
was not met. The block is done with the query once that bound is below its k-th
score so far; a tie with the bound reads on, as a smaller id could win. Scores of
earlier blocks of the task carry over, so later blocks often stop at once.

Queries come in blocks of bounded size. One block at a time is sent to the tasks, for
one pass over the candidates whose results are written before the next block is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize, shared_dir


class SortedLists:
    """The per-dimension sorted lists of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.entries = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(
        self, query: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray], step: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) among ``best`` and this block, by score, then smaller id."""
        scores, found = best
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        rising = query[used] > 0
        seen = np.zeros(n, bool)
        depth = 0
        while depth < n:
            place = np.where(rising, n - 1 - depth, depth)
            bound = query[used] @ self.entries[place, used]
            if len(scores) >= k and bound < scores[-1]:
                break
            to = min(n, depth + step) if len(used) else n
            up = self.order[n - to : n - depth][:, used[rising]]
            down = self.order[depth:to][:, used[~rising]]
            met = np.unique(np.concatenate([up.ravel(), down.ravel()])) if len(used) else np.arange(n)
            met = met[~seen[met]]
            seen[met] = True
            met = met[self.ids[met] != own]
            points = self.vectors[met] @ query
            if len(scores) >= k:
                good = points >= scores[-1]
                met, points = met[good], points[good]
            if len(met):
                scores, found = np.concatenate([scores, points]), np.concatenate([found, self.ids[met]])
                top = np.lexsort((found, -scores))[:k]
                scores, found = scores[top], found[top]
            depth, step = to, step * 2
        return scores, found


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    block_rows: int = 8192,
    query_rows: int = 4096,
    step: int = 4,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k best other rows by integer inner product.

    Components become floor(``scale`` * x). Rows with a null id, a null vector, or a
    null or non-finite component take no part; neither do pairs of unequal length.
    Ties go to the smaller id; a query with fewer partners gets them all. Rows of
    one id are no partners of each other, and repeated rows count as often as they
    occur. ``query_rows`` bounds what one pass broadcasts; any number of queries is
    answered. Sums are exact: a vector whose squares sum to 2 ** 53 or more, with which
    they might not be, is an error that names its id. Query rows of one id with
    different vectors share one list of k.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    # No sum of products, nor a part of one, exceeds the larger of both vectors' squares.
    squares = F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    large = F.raise_error(F.concat(F.lit("components are too large in the vector of "), F.col(id_col).cast("string"))).cast("array<long>")
    whole = F.when(squares < 2.0**53, whole).otherwise(large)
    usable = usable.select(F.col(id_col).alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    queries = materialize(usable.where("q").select("id", "v").distinct(), "topk-queries")
    total = queries.count()
    blocks = -(-2 * total // query_rows)  # hashed blocks of half the bound on average
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, blocks))).cast("int"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kind = vectors.schema[id_col].dataType.simpleString()

    def one_pass(block: int, folder: str) -> None:
        rows = queries.where(F.col("block") == block).select("id", "v").collect()  # below query_rows
        sent = spark.sparkContext.broadcast([(r["id"], np.array(r["v"], np.float64)) for r in rows])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            none = (np.zeros(0), np.zeros(0, np.int64))
            best = [none] * len(asked)
            for ids, flat, dims in _blocks(batches, block_rows):
                lists = SortedLists(ids, flat)
                for i, (own, query) in enumerate(asked):
                    if len(query) == dims:
                        best[i] = lists.top(query, own, k, best[i], step)
            for (own, _), (scores, found) in zip(asked, best, strict=True):
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own] * len(found), pa.int64()), pa.array(found), pa.array(scores.astype(np.int64))],
                        ["query_id", "id", "score"],
                    )

        found = usable.select("id", "v").mapInArrow(search, f"query_id long, id {kind}, score long")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.select("query_id", "id", "score").write.mode("append").parquet(folder)
        sent.destroy()

    folder = f"{shared_dir(spark)}/topk-found-{uuid.uuid4().hex}"
    none = usable.select(F.col("id").cast("long").alias("query_id"), "id", F.lit(0).cast("long").alias("score")).where("false")
    none.write.parquet(folder)
    for block in range(blocks):
        one_pass(block, folder)
    found = spark.read.schema(none.schema).parquet(folder)
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks of at most ``rows`` vectors of one length: (ids, matrix, length)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(), batch.column(1)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            for a in range(0, len(at), rows):
                part = at[a : a + rows]
                if size.get(dims, 0) + len(part) > rows and held.get(dims):
                    yield _joined(held.pop(dims), dims)
                    size[dims] = 0
                held.setdefault(dims, []).append((ids[part], flat[starts[part][:, None] + np.arange(dims)]))
                size[dims] = size.get(dims, 0) + len(part)
    for dims in list(held):
        yield _joined(held.pop(dims), dims)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]], dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), int(dims)
