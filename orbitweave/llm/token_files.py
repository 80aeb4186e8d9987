"""Documents as coded token-id segments in shared files, and back.

Documents are dealt by ranges of their id, so that ids ascend within a shard and
from shard to shard. A task encodes its shard's documents in order and closes a
segment once it has ``segment_ids`` ids; segments hold whole documents. A file is a
Parquet table of segments: any store that Spark can write holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .id_codec import read_segment, write_segment
from .shared import materialize
from .tokens import default_tokenizer, encode_words

#: Bytes of text whose words are looked up together.
_PIECE_BYTES = 4 << 20


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whole documents of about ``_PIECE_BYTES``, in order."""
    piece = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64) // _PIECE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def write_token_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = 1, segment_ids: int = 4_000_000, folder: str | None = None,
) -> DataFrame:
    """Write all documents with an integer id; returns the written table (shard, segment, before, n_ids, data).

    ``before`` counts the shard's ids ahead of the segment. A null or empty text is
    the end id alone; repeated rows are written as often as they occur; rows that
    share an id are in the order of a hash of their texts, so that one id may fill
    many shards; rows without an id come first. The files go to ``folder``, which must
    not exist yet, or else to the shared folder. Ids are 32-bit numbers at most.
    """
    path = tokenizer or default_tokenizer()
    names = ["shard", "segment", "before", "n_ids", "data"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.asarray([end_id], "<u4").tobytes()
        shard, segment, before, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[int, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            row = [[shard], [segment], [before], [size], [write_segment(held)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names
            )

        for batch in batches:
            for part in _pieces(batch):
                for doc, ids in zip(part.column(0).to_pylist(), encode_words(part.column(1).to_pylist(), path), strict=True):
                    held.append((doc, np.frombuffer(ids + tail, "<u4")))
                    size += len(held[-1][1])
                    if size >= segment_ids:
                        yield closed()
                        segment, before, size = segment + 1, before + size, 0
                        held.clear()
        if held:
            yield closed()

    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = (F.col("id").asc_nulls_first(), "h")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    schema = "shard int, segment int, before long, n_ids long, data binary"
    return materialize(ordered.mapInArrow(encode, schema), "token-files", folder)


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: id, start, n_tokens, ids_crc32[, ids as array].

    ``start`` counts the ids of all documents before it over all shards. Blocks are
    checked against their checksums; a damaged one fails the read.
    """
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # a row per shard
    first: dict[int, int] = {}
    total = 0
    for r in sorted(sums, key=lambda r: r["shard"]):
        first[r["shard"]] = total
        total += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "before", "data")]
            for shard, before, data in zip(*columns, strict=True):
                docs = read_segment(data)
                sizes = np.array([len(x) for _, x in docs], np.int64)
                starts = first[shard] + before + np.cumsum(sizes) - sizes
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs]
                out = [pa.array([doc for doc, _ in docs], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.array([x for _, x in docs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names)

    names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.mapInArrow(decode, schema)
