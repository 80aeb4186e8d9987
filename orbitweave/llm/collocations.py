"""Collocations: phrases of two and three words that occur together more often than their parts apart.

Stripes pattern: every prefix keys an associative counter of the words that follow it.
Tasks count their texts into stripes; equal prefixes meet in a shuffle, and their
stripes are merged element by element. A merged stripe has a prefix's extensions and its
total; the maxima over extensions, to the right and to the left, are what shorter
phrases are held against.

Stripes are dealt by hash over parts, and a row carries all stripes that a task has for
a part, with a dictionary of their words. Parts grow in number with the corpus and never in
size. A prefix may be arbitrarily common: a table of fixed size, words counted by hash
bucket, says into how many segments the stripes of a bucket's words are cut, each dealt
on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Fixed separators: of words, and of pieces, which no phrase crosses.
SPACES, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(STOPS)] = 2
#: Hash buckets of words, words that a part and a segment of a stripe may stand for, bytes counted and merged at a time.
BUCKETS, PART_WORDS, HOLD_BYTES, MERGE_BYTES = 16_384, 1_000_000, 8 << 20, 4 << 20
#: Columns of a row of stripes, 32-bit numbers each: prefixes of one word and totals, extensions of one word and of two.
_PLANES = ("p1", "total", "p2", "q2", "n2", "p3", "q3", "r3", "n3")
_STRIPES = "part long, lang string, words binary, " + ", ".join(f"{c} binary" for c in _PLANES)
_COUNTS = "width int, lang string, w1 binary, w2 binary, w3 binary, n long"


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, number of its piece) of lower-cased texts."""
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    letters = np.ascontiguousarray(raw[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, ``HOLD_BYTES`` at a time, from rows (lang, text)."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            held.setdefault(lang, []).append(raw)
            size += len(raw)
            if size >= HOLD_BYTES:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n): words of a task by hash bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for held in _held(batches):
        for texts in held.values():
            words, codes, _ = _words(texts)
            total += np.bincount(_hashes(words) % BUCKETS, np.bincount(codes, minlength=len(words)), BUCKETS).astype(np.int64)
    filled = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])


def _planes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """32-bit numbers cut at ``ends``, as binary."""
    offsets = np.concatenate([[0], ends]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i4"))]).cast(pa.binary())


def _stripes_of(lang: str, texts: list[bytes], segments: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Stripes of texts of one language: prefixes of one word and of two, a row for each part."""
    words, codes, piece = _words(texts)
    v = len(words)
    if not v:
        return
    hashes = _hashes(words)
    cuts = segments[hashes % BUCKETS]
    pairs = np.flatnonzero(piece[1:] == piece[:-1])
    pair, pair_of, n2 = np.unique(codes[pairs] * v + codes[pairs + 1], return_inverse=True, return_counts=True)
    at = np.full(len(codes), -1, np.int64)
    at[pairs] = pair_of
    triples = np.flatnonzero(piece[2:] == piece[:-2]) if len(codes) > 2 else np.zeros(0, np.int64)
    triple, n3 = np.unique(at[triples] * v + codes[triples + 2], return_counts=True)
    middle, third = triple // v, triple % v
    one, two, three = np.arange(v), (pair // v, pair % v), (pair[middle] // v, pair[middle] % v, third)

    def part_of(first: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return ((hashes[first] + 1) * 2_654_435_761 + segment * 2_246_822_519) % 4_294_967_291 % parts

    dealt = [
        (part_of(one, np.zeros(v, np.int64)), [one], np.bincount(codes, minlength=v)),
        (part_of(two[0], hashes[two[1]] * 31 % cuts[two[0]]), two, n2),
        (part_of(three[0], (hashes[three[1]] * 31 + hashes[three[2]] * 17) % cuts[three[0]]), three, n3),
    ]
    # Each part's row has its own dictionary.
    used = np.unique(np.concatenate([part * v + c for part, columns, _ in dealt for c in columns]))
    rows, heads = np.unique(used // v, return_index=True)
    ends = np.append(heads[1:], len(used))
    columns = []
    for part, members, n in dealt:
        order = np.argsort(part, kind="stable")
        part = part[order]
        row = np.searchsorted(rows, part)
        until = np.searchsorted(part, rows, "right")
        columns += [_planes(np.searchsorted(used, part * v + c[order]) - heads[row], until) for c in members] + [_planes(n[order], until)]
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), words.take(pa.array(used % v)))
    joined = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
    whole = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([lang] * len(rows), pa.string()), joined, *columns], ["part", "lang", "words", *_PLANES])
    step = max(1, len(rows) * (2 << 20) // whole.nbytes)
    for k in range(0, len(rows), step):
        yield whole.slice(k, step)


def _merge(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of at least ``least`` from whole parts, and with width 0 their words by language."""
    lang = rows["lang"].combine_chunks().dictionary_encode()
    lists = pc.split_pattern(rows["words"].combine_chunks().cast(pa.large_binary()), pattern=" ")
    offsets = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    known, v = words.dictionary, len(words.dictionary)
    code, of_lang = words.indices.to_numpy().astype(np.int64), lang.indices.to_numpy().astype(np.int64)

    def plane(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all rows, and each one's row."""
        column = rows[name].combine_chunks()
        row = np.repeat(np.arange(len(rows)), pc.binary_length(column).to_numpy() // 4)
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64), row

    def coded(name: str) -> np.ndarray:
        local, row = plane(name)
        return code[local + offsets[row]]

    def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, place = np.unique(key, return_inverse=True)
        return key, np.bincount(place, n, len(key)).astype(np.int64)

    def out(width: int, key: np.ndarray, w2: np.ndarray | None, w3: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        """``key`` has language and first word."""
        taken = [pa.nulls(len(n), pa.binary()) if w is None else known.take(pa.array(w)).cast(pa.binary()) for w in (key % max(1, v), w2, w3)]
        columns = [pa.array(np.full(len(n), width, np.int32)), lang.dictionary.take(pa.array(key // max(1, v))), *taken, pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["width", "lang", "w1", "w2", "w3", "n"])

    total, row = plane("total")
    first, n = summed(of_lang[row] * v + coded("p1"), total)
    spoken, said = summed(first // max(1, v), n)
    yield out(0, spoken * v, None, None, said)
    yield out(1, first[n >= least], None, None, n[n >= least])
    count, row = plane("n2")
    prefix, place = np.unique(of_lang[row] * v + coded("p2"), return_inverse=True)
    stripe, n = summed(place * v + coded("q2"), count)
    stripe, n = stripe[n >= least], n[n >= least]
    yield out(2, prefix[stripe // max(1, v)], stripe % max(1, v), None, n)
    count, row = plane("n3")
    prefix, place = np.unique(of_lang[row] * v + coded("p3"), return_inverse=True)
    longer, place = np.unique(place * v + coded("q3"), return_inverse=True)
    stripe, n = summed(place * v + coded("r3"), count)
    stripe, n = stripe[n >= least], n[n >= least]
    pair = longer[stripe // max(1, v)]
    yield out(3, prefix[pair // max(1, v)], pair % max(1, v), stripe % max(1, v), n)


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merge stripes as they come, sorted by part; a part's rows are merged together."""
    pending: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        part = batch.column("part").to_numpy()
        heads = np.flatnonzero(np.diff(part)) + 1
        for low, high in zip([0, *heads], [*heads, len(part)], strict=True):
            if size >= MERGE_BYTES and part[low] != pending[-1].column("part")[-1].as_py():
                yield from _merge(pa.Table.from_batches(pending), least)
                pending, size = [], 0
                pa.default_memory_pool().release_unused()
            if high > low:
                pending.append(batch.slice(low, high - low))
                size += pending[-1].nbytes
    if pending:
        yield from _merge(pa.Table.from_batches(pending), least)


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(width, lang, w1, w2, w3, n): counts of at least ``least`` of words and phrases, and with width 0 each language's words."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    segments, total = np.ones(BUCKETS, np.int64), 0
    for r in rows.mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        segments[r["bucket"]], total = -(-r["n"] // PART_WORDS), total + r["n"]
    parts = -(-total // PART_WORDS) or 1

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for lang in list(held):
                yield from _stripes_of(lang, held.pop(lang), segments, parts)
            pa.default_memory_pool().release_unused()

    dealt = rows.mapInArrow(stripes, _STRIPES).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda batches: _merged(batches, least), _COUNTS)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, subsume_percent: int = 50, top: int | None = 2000
) -> DataFrame:
    """Best phrases of two and three words by language: lang, rank, phrase, a, l, r, n, score.

    Texts are split at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into
    words, A-Z in lower case. ``n`` is the language's number of words and ``a`` a phrase's
    number of occurrences, ``least`` or more. Cut after its first words, a phrase scores
    floor(1,000,000 * a * a / (l * r)) with the occurrences of both parts; the cut with the lowest
    score counts, of equal ones the first. A phrase goes if a longer one that holds it has
    ``subsume_percent`` of its occurrences or more. Ranks are by score, then occurrences, both
    descending, then phrase in byte order; ``top`` of them, or all.

    Arithmetic is in decimals of 38 digits, exact up to 10**16 occurrences. A null language is
    ``und``; null and empty texts have no words; repeated rows count each; an empty
    table gives an empty one; other columns are ignored.
    """
    counts = materialize(phrase_counts(docs, least, text_col, lang_col), "collocation-counts")
    words = counts.where("width = 1").groupBy("lang", "w1").agg(F.sum("n").alias("n"))
    size = counts.where("width = 0").groupBy("lang").agg(F.sum("n").alias("words"))
    two = counts.where("width = 2").select("lang", "w1", "w2", F.col("n").alias("a"))
    three = counts.where("width = 3").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    held = three.select("lang", "w1", "w2", "a").union(three.select("lang", "w2", "w3", "a"))
    longer = held.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))

    def count_of(column: str, name: str) -> DataFrame:
        return words.select("lang", F.col("w1").alias(column), F.col("n").alias(name))

    def pair_of(first: str, second: str, name: str) -> DataFrame:
        return two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(name))

    def score(left: str, right: str) -> Column:
        together = "cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))"
        return F.expr(f"{together} div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")

    phrase = lambda *names: F.concat_ws(" ", *(F.col(n).cast("string") for n in names)).alias("phrase")
    pairs = (
        two.join(longer, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {subsume_percent} * a")
        .join(count_of("w1", "l"), ["lang", "w1"]).join(count_of("w2", "r"), ["lang", "w2"])
        .select("lang", phrase("w1", "w2"), "a", "l", "r", score("l", "r").alias("score"))
    )
    cuts = (
        three.join(count_of("w1", "l1"), ["lang", "w1"]).join(pair_of("w2", "w3", "r1"), ["lang", "w2", "w3"])
        .join(pair_of("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(count_of("w3", "r2"), ["lang", "w3"])
        .withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    )
    best = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    triples = cuts.select("lang", phrase("w1", "w2", "w3"), "a", best("l1", "l2").alias("l"), best("r1", "r2").alias("r"), best("s1", "s2").alias("score"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    found = pairs.union(triples)
    if top is not None:
        # The best of each part first, so that a language's last window is of bounded size.
        part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        found = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(size, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
