"""Removal of passages that occur more than once, by suffix arrays of shards.

A string of ``length`` bytes that occurs twice has the same least-hashed gram in it both
times, its anchor. Each text is cut into regions, one for each run of strings with one
anchor, so that every string starts in exactly one region.

1. Anchors that occur once are done with. Of the others equal regions are merged first:
   where a region occurs twice, all its strings do.
2. Regions that differ but share an anchor are fetched from their texts and dealt by anchor
   over shards. A shard's suffix array comes from induced sorting, its permuted common
   prefixes from the array; a string is repeated if it has ``length`` bytes in common
   with the one before it or after it in order.
3. An anchor with very many different regions, a frequent line say, would make a shard
   of unbounded size. Its regions are cut into pieces of a few strings, keyed by the bytes that
   these have in common, and equal pieces are merged like regions. Keys that are still too
   frequent are cut again, at last into single strings, of which those with one key are equal.
4. Repeated strings come back to their texts, whose bytes outside them stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .suffix_arrays import permuted_common_prefixes, suffix_array

#: Bytes of an anchor; bytes of text hashed at a time and of regions sorted at a time.
GRAM, HOLD_BYTES, SHARD_BYTES = 32, 4 << 20, 1 << 20
#: Different regions of one key that may lie in a shard; strings in the pieces of what is more frequent, each size a part of the one before.
WIDEST, PIECES = 256, (16, 4, 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_REGION = "anchor long, content long, k1 long, k2 long, start int, strings int, at int"
_PIECE = "shard long, content long, wide boolean, n long, k1 long, k2 long, start int, strings int, at int, bytes binary"
_MARK = "k1 long, k2 long, start int, strings int"


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each byte on."""
    padded = np.concatenate([raw, np.zeros(7, np.uint8)]).tobytes()
    grams, size = np.ndarray(len(raw), "<u8", padded, strides=(1,)) * _A, 8
    grams ^= grams >> np.uint64(29)
    while size < GRAM:
        grams = grams[:-size] * _B + grams[size:]
        grams ^= grams >> np.uint64(32)
        grams *= _A
        size *= 2
    grams ^= grams >> np.uint64(31)
    return grams


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    n = len(keys) - width + 1
    blocks = np.full((-(-len(keys) // width) + 1) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    upwards = np.minimum.accumulate(blocks, axis=1).ravel()
    downwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(downwards[:n], upwards[width - 1 : width - 1 + n])


def _regions(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, anchor hash, anchor's place, first string, number of strings) of the regions of texts laid end to end."""
    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if len(whole) < length:
        return whole, none, none, none, none
    grams = _gram_hashes(np.frombuffer(whole, np.uint8))[: len(whole) - GRAM + 1]
    at = (_least_of((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & ~_HIGH).astype(np.int64)
    # Strings that would cross the end of a text are none.
    inside = np.zeros(len(whole) + 1, np.int8)
    ends = np.cumsum(sizes)
    long = sizes >= length
    np.add.at(inside, ends[long] - sizes[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside, dtype=np.int32)[: len(at)])
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
    heads = np.flatnonzero(new)
    return whole, grams[at[heads]].view(np.int64), at[heads], starts[heads], np.diff(heads, append=len(starts))


def _held(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[bytes]]:
    """Texts, ``HOLD_BYTES`` at a time."""
    texts, size = [], 0
    for batch in batches:
        for value in batch.column(column):
            texts.append(value.as_py() or b"")
            size += len(texts[-1])
            if size >= HOLD_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def text_key(text: bytes) -> tuple[int, int]:
    """128 bits that stand for a text."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(text), "<i8").tolist())


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, n)."""
    for texts in _held(batches):
        anchors, n = np.unique(_regions(texts, length)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _occurrences(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_REGION``."""
    names = [c.split()[0] for c in _REGION.split(", ")]
    for texts in _held(batches):
        whole, anchors, at, first, strings = _regions(texts, length)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, first, "right")
        keys = np.array([text_key(t) if len(t) >= length else (0, 0) for t in texts], np.int64).reshape(-1, 2)[doc]
        begin = (ends - sizes)[doc]
        spans = zip(first.tolist(), (first + strings + length - 1).tolist(), strict=True)
        content = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in spans), np.uint64, len(first)).view(np.int64)
        columns = [anchors, content, keys[:, 0], keys[:, 1], *(x.astype(np.int32) for x in (first - begin, strings, at - begin))]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _packed(batches: Iterator[pa.RecordBatch], has_id: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id if any, k1, k2, text) with compressed texts."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        keys = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
        columns = [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(map(pack, texts), pa.binary())]
        ids = [batch.column("id")] if has_id else []
        yield pa.RecordBatch.from_arrays(ids + columns, ["id"] * len(ids) + ["k1", "k2", "text"])


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PIECE``, whole regions, from rows (k1, k2, text, regions)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, text, regions in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "regions")), strict=True):
            raw = unpack(text)
            for r in regions:
                own = raw[r["start"] : r["start"] + r["strings"] - 1 + length]
                rows.append((r["anchor"], 0, r["wide"], r["n"], k1, k2, r["start"], r["strings"], r["at"], own))
        yield _rows(rows)


def _cut(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PIECE``: pieces of ``size`` strings at fixed places before the anchor, keyed by the bytes that all their strings hold."""
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            first, last, at = r["start"], r["start"] + r["strings"] - 1, r["at"]
            for k in range((at - last) // size, (at - first) // size + 1):
                high = at - k * size
                low = high - size + 1
                a, b = max(low, first), min(high, last)
                shard = xxhash.xxh3_64_intdigest(r["bytes"][high - first : low - first + length], seed=k) - (1 << 63)
                own = r["bytes"][a - first : b - first + length]
                rows.append((shard, xxhash.xxh3_64_intdigest(own) - (1 << 63), True, r["n"], r["k1"], r["k2"], a, b - a + 1, at, own))
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [c.split()[0] for c in _PIECE.split(", ")])


_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def repeated_strings(pieces: list[bytes], length: int) -> np.ndarray:
    """For each byte of the pieces, each followed by one more, whether the ``length`` bytes from it on occur elsewhere in a piece."""
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    symbols = raw.astype(np.int64) + 1
    symbols[ends] = 0
    before, common = permuted_common_prefixes(raw, suffix_array(symbols), np.repeat(ends, np.diff(ends, prepend=-1)))
    found = common >= length
    repeated = found.copy()
    repeated[before[found]] = True
    return repeated


def _matched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_MARK``: repeated strings of regions that occur once, from rows of ``_PIECE`` sorted by shard."""
    pending: list[pa.RecordBatch] = []
    size = 0

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(pending)
        pieces = rows["bytes"].to_pylist()
        lengths = np.array([len(p) for p in pieces], np.int64)
        repeated = repeated_strings(pieces, length)
        repeated[np.repeat(rows["n"].to_numpy() > 1, lengths + 1)] = False
        edge = np.diff(repeated.astype(np.int8), prepend=0, append=0)
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum(lengths + 1)
        row = np.searchsorted(ends, low, "right")
        start = rows["start"].to_numpy()[row] + low - (ends - lengths - 1)[row]
        return pa.RecordBatch.from_arrays(
            [rows["k1"].combine_chunks().take(pa.array(row)), rows["k2"].combine_chunks().take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array((high - low).astype(np.int32))],
            [c.split()[0] for c in _MARK.split(", ")],
        )

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        heads = np.flatnonzero(np.diff(shard)) + 1
        for low, high in zip([0, *heads], [*heads, len(shard)], strict=True):
            if size >= SHARD_BYTES and shard[low] != pending[-1].column("shard")[-1].as_py():
                yield done()
                pending, size = [], 0
            if high > low:
                pending.append(batch.slice(low, high - low))
                size += pending[-1].column("bytes").nbytes
    if pending:
        yield done()


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_bytes, spans, kept) from rows (id, text, marks)."""
    unpack = zstandard.ZstdDecompressor().decompress
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            raw, spans, rest, at = unpack(text), [], [], 0
            for mark in sorted((m["start"], m["start"] + m["strings"] - 1 + length) for m in marks or ()):
                if spans and mark[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], mark[1])
                else:
                    spans.append([*mark])
            for a, b in spans:
                rest.append(raw[at:a])
                at = b
            sizes.append(len(raw))
            removed.append([{"start": a, "length": b - a} for a, b in spans])
            kept.append(b"".join([*rest, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def repeated_marks(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, marks) of ``texts`` (column text, binary): by text key, starts of its repeated strings and how many follow each other."""
    anchors = texts.mapInArrow(lambda b: _anchors(b, length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    # Written first, so that the join has two plain shuffles, of which Spark cuts a frequent anchor's part.
    anchors = materialize(anchors.select("anchor"), "passages-anchors")
    seen = texts.mapInArrow(lambda b: _occurrences(b, length), _REGION)
    seen = materialize(seen.join(anchors, "anchor"), "passages-seen")
    where = F.struct("k1", "k2", "start", "strings", "at")
    regions = seen.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(where).alias("one"))
    regions = materialize(regions, "passages-regions")
    copies = seen.join(regions.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select("k1", "k2", "start", "strings")

    # Of an anchor whose regions all occur twice, everything is known.
    unlike = regions.groupBy("anchor").agg(F.count("*").alias("variants"), F.min("n").alias("least")).where("variants > 1 and least = 1")
    unlike = materialize(unlike.select("anchor", (F.col("variants") > WIDEST).alias("wide")), "passages-unlike")
    asked = regions.join(unlike, "anchor").select("anchor", "n", "one.*", "wide")
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "n", "start", "strings", "at", "wide")).alias("regions"))
    distinct = texts.mapInArrow(lambda b: _packed(b, False), "k1 long, k2 long, text binary").dropDuplicates(["k1", "k2"])
    pieces = materialize(distinct.join(asked, ["k1", "k2"]).mapInArrow(lambda b: _fetched(b, length), _PIECE), "passages-pieces")

    columns = [c.split()[0] for c in _PIECE.split(", ")]
    shards, wide, marks = pieces.where("not wide"), pieces.where("wide"), copies
    for size in PIECES:
        cut = materialize(wide.mapInArrow(lambda b, size=size: _cut(b, length, size), _PIECE), f"passages-pieces-{size}")
        alike = cut.groupBy("shard", "content").agg(F.count("*").alias("copies"), F.max("n").alias("most"), F.min(F.struct("k1", "k2", "start")).alias("one"))
        alike = materialize(alike, f"passages-alike-{size}")
        variants = materialize(alike.groupBy("shard").agg(F.count("*").alias("variants")), f"passages-variants-{size}")
        known = cut.drop("n", "wide").join(alike, ["shard", "content"])
        marks = marks.union(known.where("copies > 1").select("k1", "k2", "start", "strings"))
        once = known.where(F.struct("k1", "k2", "start") == F.col("one")).withColumn("n", F.greatest("copies", "most"))
        sized = once.join(variants.where("variants > 1"), "shard").withColumn("wide", F.col("variants") > WIDEST).select(columns)
        sized = materialize(sized, f"passages-once-{size}")
        shards, wide = shards.union(sized.where("not wide")), sized.where("wide")

    matches = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda b: _matched(b, length), _MARK)
    return marks.union(matches).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "strings")).alias("marks"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per document: id, n_bytes, the removed spans (start, length, ascending) and the kept bytes.

    A byte goes if a string of ``length`` bytes (64 or more) over it also starts anywhere else, in the same text
    or another; strings are judged on whole texts as they came, in UTF-8, and never cross texts. All copies go, the
    first one too. Spans are as long as they can be, and may cut a character.

    Regions that are merged are told apart by 64 bits of their anchor and 64 of their content, texts by
    128. Null and empty texts have no bytes; of equal rows each loses what is repeated; null and repeated ids are
    rows like others; an empty table gives an empty one; other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings have {2 * GRAM} bytes at least")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    marks = materialize(repeated_marks(rows.select("text"), length), "passages-marks")
    packed = rows.mapInArrow(lambda b: _packed(b, True), f"id {kind}, k1 long, k2 long, text binary")
    found = packed.join(marks, ["k1", "k2"], "left").select("id", "text", "marks")
    kept = found.mapInArrow(lambda b: _kept(b, length), f"id {kind}, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")
    return kept.withColumnRenamed("id", id_col) if id_col != "id" else kept
