"""Near-duplicate documents by HyperMinHash banding and checks on full shingle sets.

1. Every text gives its set of five-word shingles. Documents with equal sets form
   one class at once, however many there are; from here on only the class's
   smallest document takes part.
2. A class's compressed registers (leading-zero count and mantissa bits of each
   bucket's smallest hash) are cut into bands. Sets of at most three shingles are
   similar by 0.8 only when equal, so they have no bands. Two sets of similarity 0.8
   miss each other in all 35 bands with probability 9e-7, of 0.85 with 1e-9.
3. Classes that share a band are compared in rounds, each followed by joining
   components: with the smallest centre of their bands, then with a centre of every
   band that still holds several components, drawn anew in each round, as long as the
   rounds link a fair part of what they compare. So a group of thousands of alike
   texts falls together without a list of its pairs.
4. What is left are bands of texts that are alike but mostly below the threshold.
   Their sets are joined by exact filters instead: with the rarest shingles first, two
   sets can reach the threshold only if they share one of the first ones, early enough
   for the rest to suffice, and if their parity sketches differ in no more bits than
   the sets may differ in members. The filters stand in the join itself and never
   refuse a link, so pairs come out of it that are linked or close to it, and not all
   pairs of a group; a shingle of very many sets is joined in blocks.
5. A pair is checked by its sketches, by its registers, corrected for chance agreement,
   with a wide margin, and then on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connect
from .shared import materialize
from .shingles import SKETCH_WORDS, band_keys, estimated_similarity, parity_sketch, shingle_sets, signatures

_PIECE_BYTES = 2_000_000
#: Counters that order shingles by frequency; a fixed size, whatever the corpus.
ORDER_SLOTS = 1 << 18
#: Sets of one shingle that are compared in one block of the last join.
BLOCK_SETS = 8192
#: Rounds go on while they link at least one in so many pairs.
ROUND_YIELD = 50


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of (id, text as binary), each of about ``_PIECE_BYTES`` of text."""
    sizes = batch.column(1).fill_null(b"")
    ends = np.cumsum(np.fromiter((len(x) for x in sizes.to_pylist()), np.int64, len(sizes)))
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _PIECE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pieces(batch):
            sets = shingle_sets(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([band_keys(signatures(s)) for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "n", "key", "bands"],
            )


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pieces(batch):
            sets = shingle_sets(part.column(1).to_pylist())
            signed = [[x if x is None else x.tobytes() for x in signatures(s)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array([s[k] for s in signed], pa.binary()) for k in range(3)),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "r0", "r1", "r2", "members", "sketch"],
            )


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ORDER_SLOTS, np.int64)
    for batch in batches:
        for members in batch.column(0).to_pylist():
            counts += np.bincount((np.frombuffer(members, np.uint64) % ORDER_SLOTS).astype(np.int64), minlength=ORDER_SLOTS)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])


def _prefixes(percent: int, counts):
    """Each set's first shingles in the order of the counts of their slots, then of the shingles themselves."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            out = [[], [], [], []]
            for k, members in enumerate(batch.column("members").to_pylist()):
                x = np.frombuffer(members, np.uint64)
                first = np.lexsort((x, table[(x % ORDER_SLOTS).astype(np.int64)]))[: len(x) * (100 - percent) // 100 + 1]
                for column, values in zip(out, (np.full(len(first), k), x[first], np.arange(len(first)), np.full(len(first), len(x))), strict=True):
                    column.append(values)
            if not out[0]:
                continue
            row, shingle, place, n = map(np.concatenate, out)
            row = pa.array(row)
            columns = [batch.column("id").take(row), batch.column("comp").take(row), pa.array(shingle.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(n)], ["id", "comp", "shingle", "place", "n"])

    return prefixes


def _check(percent: int, margin: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            good = []
            for i, (x, y) in enumerate(zip(col["a_members"], col["b_members"], strict=True)):
                n_a, n_b = len(x) // 8, len(y) // 8
                if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
                    continue
                guess = estimated_similarity(
                    [col[f"a_r{k}"][i] for k in range(3)], [col[f"b_r{k}"][i] for k in range(3)], n_a, n_b
                )
                if guess < margin:
                    continue
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if 100 * common >= percent * (n_a + n_b - common):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return check


def _can_reach(percent: int, n_a: Column, n_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """False only for two sets that differ in more members than similar ones of their sizes may."""
    apart = F.bit_count(sketch_a[0].bitwiseXOR(sketch_b[0]))
    for k in range(1, SKETCH_WORDS):
        apart = apart + F.bit_count(sketch_a[k].bitwiseXOR(sketch_b[k]))
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & ((100 + percent) * apart <= (100 - percent) * (n_a + n_b))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, margin: float | None = None
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked where their sets share at least ``percent`` in a hundred of
    their union (80 or more: bands and size classes are laid out for that).
    ``margin`` is the least estimate that is worth the full check; by default it is
    0.25 below the threshold, eight standard errors at 0.8. Null and empty texts have an empty set and are linked with
    nothing; a null id is in no component but its own and kept; repeated rows of an
    id share its component and are all kept if it is; other columns are ignored.
    """
    if percent < 80:
        raise ValueError("bands and size classes are laid out for a percentage of 80 or more")
    margin = percent / 100 - 0.25 if margin is None else margin
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = materialize(texts.mapInArrow(_sign, f"id {kind}, n long, key binary, bands array<long>"), "near-signatures")
    real = signed.where("n > 0 and id is not null")
    classes = materialize(real.groupBy("key").agg(F.min("id").alias("rep")), "near-classes")
    members = materialize(real.select("id", "n", "key").join(classes, "key").select("id", "n", "rep"), "near-members")

    reps = members.where("id = rep").select("id")
    banded = signed.where(F.size("bands") > 0).join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last")
    buckets = materialize(buckets.select("band", "centre"), "near-buckets")
    shared = materialize(banded.join(buckets, "band").select("band", "id", "centre").distinct(), "near-shared")
    wanted = materialize(shared.select("id").distinct(), "near-wanted")
    schema = f"id {kind}, r0 binary, r1 binary, r2 binary, members binary, sketch array<long>"
    full = materialize(texts.join(wanted, "id", "left_semi").mapInArrow(_full, schema), "near-sets")

    def side(name: str) -> DataFrame:
        return full.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in full.columns[1:]))

    def verified(pairs: DataFrame) -> DataFrame:
        held = pairs.join(side("a"), "a").join(side("b"), "b")
        sizes = [F.length(f"{x}_members") / 8 for x in "ab"]
        held = held.where(_can_reach(percent, *sizes, F.col("a_sketch"), F.col("b_sketch"))).drop("a_sketch", "b_sketch")
        return materialize(held.mapInArrow(_check(percent, margin), f"a {kind}, b {kind}"), "near-links")

    comps = wanted.select("id", F.col("id").alias("comp"))

    def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
        left = links.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
        both = left.join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        labels = connect(both.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return materialize(
            comps.join(labels, comps.comp == labels.v, "left").select("id", F.coalesce("label", "comp").alias("comp")),
            "near-components",
        )

    def mixed(comps: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Rows of ``shared`` with components, and the bands that still hold several, each with a centre."""
        rows = materialize(shared.select("band", "id").join(comps, "id"), "near-rows")
        drawn = F.xxhash64("band", "id", F.lit(turn)).alias("h")
        held = rows.groupBy("band").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.min(F.struct(drawn, F.col("id").alias("centre"), F.col("comp").alias("ccomp"))).alias("c"),
        )
        return rows, materialize(held.where("low < high").select("band", "c.centre", "c.ccomp"), "near-mixed")

    first = shared.groupBy("id").agg(F.min("centre").alias("b")).where("id <> b").select(F.col("id").alias("a"), "b")
    links = verified(first)
    comps = joined(comps, links) if not links.isEmpty() else comps
    turn = 0
    while True:
        rows, bands = mixed(comps, turn)
        if bands.isEmpty():
            break
        pairs = rows.join(bands, "band").where("comp <> ccomp").select(F.col("id").alias("a"), F.col("centre").alias("b"))
        pairs = materialize(pairs.distinct(), "near-pairs")
        links = verified(pairs)
        found, asked = links.count(), pairs.count()
        comps = joined(comps, links) if found else comps
        turn += 1
        if found * ROUND_YIELD < asked:
            rows, bands = mixed(comps, turn) if found else (rows, bands)
            break
    if not bands.isEmpty():
        left = materialize(rows.join(bands.select("band"), "band").select("id", "comp").distinct(), "near-left")
        sets = full.select("id", "members").join(left, "id")
        slots = sets.select("members").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        table = np.zeros(ORDER_SLOTS, np.int64)
        got = slots.toPandas()  # at most ORDER_SLOTS rows
        table[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
        counts = docs.sparkSession.sparkContext.broadcast(table)
        kinds = f"id {kind}, comp {kind}, shingle long, place long, n long"
        heads = materialize(sets.mapInArrow(_prefixes(percent, counts), kinds), "near-prefixes")
        met = heads.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("sets"))
        met = met.where("low < high").select("shingle", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("blocks"))
        heads = materialize(heads.join(met, "shingle"), "near-met").join(full.select("id", "sketch"), "id")
        a = heads.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("a")
        b = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
        rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
        enough = (100 + percent) * rest >= percent * (F.col("a.n") + F.col("b.n"))
        near = _can_reach(percent, F.col("a.n"), F.col("b.n"), F.col("a.sketch"), F.col("b.sketch"))
        same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.block") == F.col("b.block"))
        pairs = a.join(b, same & (F.col("a.comp") < F.col("b.comp")) & enough & near)
        links = verified(materialize(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "near-pairs"))
        comps = joined(comps, links) if not links.isEmpty() else comps

    found = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", "n", F.coalesce("comp", "rep").alias("comp")
    )
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("comp"))
    return found.unionAll(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("comp").alias("component_id"),
        F.col("id").eqNullSafe(F.col("comp")).alias("kept"),
    )
