"""Packing documents into fixed windows of tokens by minimum bin slack.

Documents longer than a window are cut into full windows and a rest. How many rests
there are of each length is all that the plan needs: at most ``capacity`` numbers,
whatever the size of the corpus. The plan fills windows one pattern at a time:
around the longest remaining rest, a bitset holds every total that the remaining
lengths can reach, its highest bit gives the smallest slack, and walking back
through its layers gives the counts of the pattern, which is repeated while the
counts last. Each rest then finds its window from its rank among the rests of its
length by arithmetic, so no group of rests ever meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import default_tokenizer, encode_words

_PIECE_DOCS = 512


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest to ``room`` from below."""
    reach, whole = 1, (1 << (room + 1)) - 1
    layers: list[tuple[int, int]] = []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        layer = reach
        for _ in range(min(counts[length], room // length)):
            layer = (layer << length) & whole & ~reach
            if not layer:
                break
            reach |= layer
            layers.append((length, layer))
        if reach >> room & 1:
            break
    total, filling = reach.bit_length() - 1, {}
    for length, layer in reversed(layers):
        if layer >> total & 1:
            filling[length] = filling.get(length, 0) + 1
            total -= length
    return filling


@dataclass(frozen=True)
class Segment:
    """Ranks [first, first + copies * repeats) of a length: ``copies`` of them in each of ``repeats`` windows."""

    length: int
    first: int
    copies: int
    repeats: int
    sequence: int
    offset: int


def plan_windows(counts: dict[int, int], capacity: int) -> list[Segment]:
    """Windows for ``counts[length]`` pieces of each length up to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    segments, sequence = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_filling({n: c for n, c in rest.items() if c}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[n] // k for n, k in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            segments.append(Segment(length, used[length], copies, repeats, sequence, offset))
            offset += copies * length
            used[length] += copies * repeats
            left[length] -= copies * repeats
            if not left[length]:
                del left[length]
        sequence += repeats
    return segments


def document_pieces(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each document cut into full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), _PIECE_DOCS):
                part = batch.slice(at, _PIECE_DOCS)
                origin, start, length, crc, total, kept = [], [], [], [], [], []
                for k, ids in enumerate(encode_words(part.column(1).to_pylist(), tokenizer)):
                    ids += tail
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        piece = ids[4 * s : 4 * (s + capacity)]
                        origin.append(k)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        kept.append(piece)
                columns = [part.column(0).take(pa.array(origin, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, schema)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = 2, capacity: int = 4096, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A null or empty text is the end id alone. Repeated rows are packed as often as
    they occur, null ids like others; other columns are ignored; an empty table
    gives no piece. ``with_ids`` adds each piece's ids as little-endian unsigned
    32-bit binary, from which sequences are assembled by sequence_id and offset.
    """
    pieces = document_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id, capacity, with_ids)
    pieces = materialize(pieces, "pack-pieces")
    order = ["length", "id", "start"]
    ranked = materialize(
        pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()),
        "pack-ranked",
    )
    part, row = F.shiftright("mid", 33), F.col("mid").bitwiseAND((1 << 33) - 1)
    # A length spans neighbouring partitions, so this has a row per partition and per length at most.
    runs = ranked.groupBy(part.alias("part"), "length").agg(F.min(row).alias("low"), F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    shift: dict[tuple[int, int], int] = {}
    for r in sorted(runs, key=lambda r: (r["length"], r["part"])):
        shift[r["part"], r["length"]] = counts.get(r["length"], 0) - r["low"]
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    by_length: dict[int, list[Segment]] = {}
    for segment in plan_windows(counts, capacity):
        by_length.setdefault(segment.length, []).append(segment)
    tables = {
        n: np.array([(s.first, s.copies, s.sequence, s.offset) for s in found], np.int64) for n, found in by_length.items()
    }
    plan = docs.sparkSession.sparkContext.broadcast((shift, tables))  # bounded by lengths and partitions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, tables = plan.value
        for batch in batches:
            mid = batch.column("mid").to_numpy()
            length = batch.column("length").to_numpy()
            sequence, offset = np.empty_like(mid), np.empty_like(mid)
            marks = np.flatnonzero(np.diff(length, prepend=-1) | np.diff(mid >> 33, prepend=-1))
            for a, b in zip(marks, [*marks[1:], len(mid)], strict=True):
                n = int(length[a])
                rank = (mid[a:b] & ((1 << 33) - 1)) + shift[int(mid[a]) >> 33, n]
                first, copies, base, inside = tables[n][np.searchsorted(tables[n][:, 0], rank, side="right") - 1].T
                turn, within = np.divmod(rank - first, copies)
                sequence[a:b], offset[a:b] = base + turn, inside + within * n
            kept = [batch.column(c) for c in out_names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], out_names)

    out_names = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
