"""Stupid-backoff language-model scores of all documents from counts over all documents.

1. Tasks cut their documents into batches of about ``batch_words`` words, kept as
   codes into the batch's own vocabulary.
2. A batch's n-grams (words, pairs of neighbours and so on, by 64-bit hash) are exploded,
   combined within the batch and dealt by hash over parts. Each part is one slice of
   the n-gram count table: it adds the batches' counts of its n-grams and answers
   every batch with the totals of the ones it asked for. An n-gram reaches its part
   once per batch, so a very common one is no hot key.
3. The answers join their batch, and scores are summed per document.

Rows that cross the network are slices of sorted hashes and counts rather than single
n-grams; single rows would carry several times the input over the network. A document
is scored without its own counts, as a text always knows its own n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .shingles import mix

_LEFT, _RIGHT, _SINGLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones, and so on: runs that compress on the way."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending hashes by their differences."""
    return _planes(np.diff(ascending, prepend=np.uint64(0)))


def _ascending(steps: bytes) -> np.ndarray:
    return np.cumsum(_values(steps, "<u8"), dtype=np.uint64)


def _batches(batches: Iterator[pa.RecordBatch], batch_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (batch, ids, lengths, vocabulary, codes, words) from (id, text as binary)."""
    task, number = TaskContext.get().partitionId(), 0
    ids, split, size = [], [], 0

    def closed() -> pa.RecordBatch:
        flat = list(chain.from_iterable(split))
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 32) | number], pa.int64()),
                pa.array([ids]),
                pa.array([[len(w) for w in split]], pa.list_(pa.int64())),
                pa.array([hashes.tobytes()], pa.binary()),
                pa.array([_planes(coded.indices.to_numpy().astype("<i4"))], pa.binary()),
                pa.array([len(flat)], pa.int64()),
            ],
            ["batch", "ids", "lengths", "vocabulary", "codes", "words"],
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            split.append((text or b"").lower().split())
            size += len(split[-1])
            if size >= batch_words or len(ids) >= batch_words:
                yield closed()
                number, ids, split, size = number + 1, [], [], 0
    if ids:
        yield closed()


def _ngrams(vocabulary: bytes, codes: bytes, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one word to ``order`` words: (hash of the n-gram at each word, places of those that lie in one document)."""
    words = np.frombuffer(vocabulary, np.uint64)[_values(codes, "<i4")]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    grams = [(mix(words * _SINGLE + _LEFT), np.arange(len(words)))]
    longer = words
    for k in range(1, order):
        longer = mix(longer[:-1] * _LEFT + words[k:] * _RIGHT) if len(longer) else longer
        grams.append((longer, np.flatnonzero(doc[: len(longer)] == doc[k:])))
    return grams


def _distinct(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, how often each occurs)."""
    return np.unique(np.concatenate([g[at] for g, at in grams]), return_counts=True)


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _asked(row_batches: Iterator[pa.RecordBatch], parts: int, order: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, batch, grams, counts): a batch's sorted distinct n-grams, cut by part."""
    for batch in row_batches:
        for row in batch.to_pylist():
            grams, counts = _distinct(_ngrams(row["vocabulary"], row["codes"], np.array(row["lengths"], np.int64), order))
            part = _part_of(grams, parts)  # ascends with the hash
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*cuts[1:], len(grams)]
            if len(cuts):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cuts]),
                        pa.array([row["batch"]] * len(cuts), pa.int64()),
                        pa.array([_steps(grams[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                        pa.array([_planes(counts[a:b].astype("<u4")) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    ],
                    ["part", "batch", "grams", "counts"],
                )


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Totals of a part's n-grams, in the order in which each batch asked."""
    grams = [_ascending(g) for g in asked["grams"]]
    table, place = np.unique(np.concatenate(grams), return_inverse=True)
    counts = np.concatenate([_values(c, "<u4") for c in asked["counts"]])
    totals = np.bincount(place, counts, len(table)).astype("<i8")[place]
    ends = np.cumsum([len(g) for g in grams])[:-1]
    return pd.DataFrame({"batch": asked["batch"], "part": asked["part"], "totals": [_planes(t) for t in np.split(totals, ends)]})


def _scores(held: pd.DataFrame, answers: pd.DataFrame, total: int, alpha: float, order: int) -> pd.DataFrame:
    """(id, n_words, score) of a batch's documents."""
    out: list[pd.DataFrame] = []
    for row in held.itertuples():
        lengths = np.array(row.lengths, np.int64)
        grams = _ngrams(row.vocabulary, row.codes, lengths, order)
        n = len(grams[0][0])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        known = _distinct(grams)[0]
        totals = [_values(t, "<i8") for t in answers.sort_values("part")["totals"]]
        counts = np.concatenate([np.zeros(0, np.int64), *totals])

        def elsewhere(grams: np.ndarray, of: np.ndarray, known: np.ndarray = known, counts: np.ndarray = counts) -> np.ndarray:
            """Count of each n-gram over all documents but its own."""
            place = np.searchsorted(known, grams)
            _, same, own = np.unique(of * np.int64(len(known)) + place, return_inverse=True, return_counts=True)
            return counts[place] - own[same]

        shorter = elsewhere(grams[0][0], doc) if n else np.zeros(0, np.int64)
        rest = np.maximum(total - lengths, 1)[doc]
        logs = np.where(shorter > 0, np.log(np.maximum(shorter, 1) / rest), np.log(alpha / (rest + 1.0)))
        for k in range(1, order):
            hashes, at = grams[k]
            if not len(at):
                break
            found = elsewhere(hashes[at], doc[at])
            # An n-gram that is known elsewhere has its context there too.
            logs[at + k] = np.where(
                found > 0, np.log(np.maximum(found, 1) / np.maximum(shorter[at], 1)), np.log(alpha) + logs[at + k]
            )
            shorter = np.zeros(n, np.int64)
            shorter[at] = found
        out.append(pd.DataFrame({"id": row.ids, "n_words": lengths, "score": np.bincount(doc, logs, len(lengths))}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "n_words": [], "score": []})


def backoff_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.4, order: int = 2,
    batch_words: int = 1_200_000, part_ngrams: int = 1_000_000,
) -> DataFrame:
    """One row per document: id, n_words, score (sum of natural logs), mean_score.

    Words are runs other than ASCII white space with A-Z in lower case. A word scores
    count(n-gram) / count(context) for the longest n-gram of at most ``order`` words
    that ends with it, if that occurs in other documents; else ``alpha`` times its
    score with a context that is one word shorter. Without context that is
    count(word) / words, or ``alpha`` / (words + 1) if no other document has the word.
    All counts exclude the document itself but include its copies. Null and empty texts
    score 0 with a null mean; repeated rows count as documents of their own; null ids
    are scored like others; an empty table gives an empty one.
    """
    if order < 1:
        raise ValueError("an n-gram has one word at least")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    held = texts.mapInArrow(
        lambda batches: _batches(batches, batch_words),
        f"batch long, ids array<{kind}>, lengths array<long>, vocabulary binary, codes binary, words long",
    )
    held = materialize(held, "lm-batches")
    total = held.agg(F.sum("words")).first()[0] or 0
    parts = max(1, order * total // part_ngrams)
    asked = held.select("batch", "lengths", "vocabulary", "codes").mapInArrow(
        lambda rows: _asked(rows, parts, order), "part long, batch long, grams binary, counts binary"
    )
    answers = asked.groupBy("part").applyInPandas(_answer, "batch long, part long, totals binary")
    scored = held.drop("words").groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        lambda h, a: _scores(h, a, total, alpha, order), f"id {kind}, n_words long, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score")
    )
