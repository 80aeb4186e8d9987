"""Periodic runs of words, found online by dyadic square catching.

Words are appended to a stream. Whenever a block of 2**k words is complete, a catcher
stands over it that waits for squares whose first half holds the block: squares with
periods from 2 * 2**k up to 4 * 2**k, period 1 aside. Each appended word completes one
suffix of every block length, and on each level only two catchers can still be waiting
for it, so that a word costs two comparisons a level. A suffix that equals a caught
block is a square's two halves meeting; it is extended to both sides and merged
into the run that has it. All words of an append are compared at once, in numpy.

Comparisons are of 64-bit hashes, which never miss an equality; what they report is
verified word by word before it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the odd hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), _BASE)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


class SquareCatchers:
    """Runs of a growing sequence of word codes.

    ``append`` takes codes of 0 or more; ``cut`` ends a text, so that no run crosses it.
    ``runs`` gives (start, end, period) of all maximal stretches of smallest period p
    with at least ``min_length`` words and ``min_exponent`` (2 or more) times p.
    """

    def __init__(self, min_length: int = 24, min_exponent: int = 3) -> None:
        if min_exponent < 2:
            raise ValueError("a run repeats its period")
        self.min_length, self.min_exponent = min_length, min_exponent
        self.words = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)  # of each word in its text
        self.sums = np.zeros(1, np.uint64)  # hashes of all prefixes
        self.found: dict[tuple[int, int], int] = {}  # (start, period): end
        self.open: set[tuple[int, int]] = set()  # what reaches the last word and may yet become a run
        self.cover = np.zeros(0, np.int64)  # period of a run over each word, 0 without
        self.cover_end = np.zeros(0, np.int64)
        self.cuts = 0

    def cut(self) -> None:
        """End a text."""
        self.cuts += 1
        self._take(np.array([-self.cuts]), np.array([-1]))

    def append(self, words: np.ndarray, texts: np.ndarray | None = None) -> None:
        """Add words, or many texts at once with their lengths in ``texts``, a cut after each."""
        words = np.asarray(words, np.int64)
        if texts is None:
            at = self.place[-1] + 1 if len(self.place) else 0
            self._take(words, at + np.arange(len(words)))
            return
        lengths = np.asarray(texts, np.int64)
        ends = np.cumsum(lengths)
        place = np.arange(len(words)) - np.repeat(ends - lengths, lengths)
        ids = -1 - self.cuts - np.arange(len(lengths))
        self.cuts += len(lengths)
        self._take(np.insert(words, ends, ids), np.insert(place, ends, -1))

    def runs(self) -> list[tuple[int, int, int]]:
        return sorted((s, e, p) for (s, p), e in self.found.items())

    def _take(self, words: np.ndarray, place: np.ndarray) -> None:
        first = len(self.words)
        self.words = np.concatenate([self.words, words])
        self.place = np.concatenate([self.place, place])
        power = _powers(len(self.words) + 1)
        grown = np.cumsum(mix(words.astype(np.uint64)) * power[first : len(self.words)]) + self.sums[-1]
        self.sums = np.concatenate([self.sums, grown])
        self.cover = np.concatenate([self.cover, np.zeros(len(words), np.int64)])
        self.cover_end = np.concatenate([self.cover_end, np.zeros(len(words), np.int64)])
        self._advance(first)
        longest, block = int(self.place[first:].max(initial=-1)) + 1, 1
        if longest >= 2:
            self._catch(first, 1, shortest=1)
        while 3 * block <= longest:
            self._catch(first, block, shortest=2 * block)
            block *= 2

    def _advance(self, first: int) -> None:
        """What reached the end goes on with the words from ``first`` on."""
        waiting, self.open = sorted(self.open, key=lambda x: x[1]), set()
        for start, period in waiting:
            later = self._forward(np.array([first - period]), np.array([first]))[0]
            self._judge(start, first + int(later), period)

    def _judge(self, start: int, end: int, period: int) -> None:
        if end == len(self.words):
            self.open.add((start, period))
        if end - start >= max(self.min_length, self.min_exponent * period):
            self._merge(start, end, period)

    def _catch(self, first: int, block: int, shortest: int) -> None:
        """Squares whose second half meets, with a word from ``first`` on, a block of the level."""
        last = first + np.flatnonzero(self.place[first:] >= shortest + block - 1)
        begin = last - block + 1
        suffix = self.sums[last + 1] - self.sums[begin]
        near = (begin - shortest) // block * block
        pairs = []
        for back in (0, block) if shortest > 1 else (0,):
            at = near - back
            inside = at >= begin - self.place[begin]
            apart, here, there = begin[inside] - at[inside], at[inside], suffix[inside]
            met = (self.sums[here + block] - self.sums[here]) * _powers(len(self.words) + 1)[apart] == there
            pairs.append((here[met], apart[met]))
        here, period = (np.concatenate(x) for x in zip(*pairs, strict=True))
        # Within a run whose period divides this one there is nothing new.
        known = self.cover[here]
        old = (known > 0) & (period % np.maximum(known, 1) == 0) & (here + period + block <= self.cover_end[here])
        here, period = here[~old], period[~old]
        order = np.lexsort((here, period))
        here, period = here[order], period[order]
        while len(here):
            # Neighbouring blocks that meet at one distance belong to one run: the first one finds it.
            head = np.ones(len(here), bool)
            head[1:] = (np.diff(here) != block) | (np.diff(period) != 0)
            u, q = here[head], period[head]
            start = u - self._backward(u, u + q)
            end = u + q + block + self._forward(u + block, u + q + block)
            for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
                self._judge(s, e, p)
            reach = end[np.cumsum(head) - 1]
            left = ~head & (here + period + block > reach)
            here, period = here[left], period[left]

    def _merge(self, start: int, end: int, period: int) -> None:
        """Verify the run and keep it, unless it is one of a smaller period."""
        if not np.array_equal(self.words[start : end - period], self.words[start + period : end]):
            for s, e in self._exactly(start, end, period):
                self._merge(s, e, period)
            return
        p = self.cover[start]
        if 0 < p < period and period % p == 0 and self.cover_end[start] >= end:
            return
        if any(period % p == 0 and self.found.get((start, p), 0) >= end for p in _divisors(period)):
            return
        self.found[start, period] = max(end, self.found.get((start, period), 0))
        self.cover[start:end], self.cover_end[start:end] = period, end

    def _exactly(self, start: int, end: int, period: int) -> list[tuple[int, int]]:
        """Stretches of the period from ``start`` to ``end`` without hashes, where those erred."""
        same = np.flatnonzero(self.words[start : end - period] == self.words[start + period : end]) + start
        parts = np.split(same, np.flatnonzero(np.diff(same) != 1) + 1)
        ranges = [(int(x[0]), int(x[-1]) + 1 + period) for x in parts if len(x)]
        return [(s, e) for s, e in ranges if e - s >= max(self.min_length, self.min_exponent * period)]

    def _same(self, u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[u + n] - self.sums[u]) * _powers(len(self.words) + 1)[v - u] == self.sums[v + n] - self.sums[v]

    def _forward(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Words that follow ``u`` and ``v`` (greater) alike."""
        return self._extent(len(self.words) - v, lambda of, n, by: self._same(u[of] + n, v[of] + n, by))

    def _backward(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Words before ``u`` and ``v`` (greater) alike."""
        return self._extent(u.copy(), lambda of, n, by: self._same(u[of] - n - by, v[of] - n - by, by))

    @staticmethod
    def _extent(room: np.ndarray, alike: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
        """Greatest extent within ``room``, by doubled and then halved steps."""
        n, active, by = np.zeros(len(room), np.int64), np.arange(len(room)), 1

        def stepped(of: np.ndarray, by: int) -> np.ndarray:
            of = of[n[of] + by <= room[of]]
            of = of[alike(of, n[of], by)]
            n[of] += by
            return of

        rises = []
        while len(active):
            rises.append(active)
            active, by = stepped(active, by), by * 2
        # Whoever failed a step of this size or a greater one tries the smaller ones.
        for k in range(len(rises) - 2, -1, -1):
            stepped(rises[k + 1], 1 << k)
        return n


def _divisors(period: int) -> list[int]:
    return [d for k in range(1, int(period**0.5) + 1) if period % k == 0 for d in {k, period // k} if d < period]


def _analyse(
    ids: list, split: list[list[bytes]], min_length: int, min_exponent: int, rewrite: Callable[[object, int], tuple[int, int] | None] | None
) -> list[pa.Array]:
    """Columns n_words, runs, collapsed of a batch of texts."""
    lengths = np.array([len(w) for w in split], np.int64)
    flat = list(chain.from_iterable(split))
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if flat else np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    if rewrite:
        for k, (doc, words) in enumerate(zip(ids, split, strict=True)):
            n = len(words)
            if n and (tail := rewrite(doc, n)):
                at, period = tail
                source = np.arange(n)
                source[at:] = at + (source[at:] - at) % period
                codes[starts[k] : starts[k] + n] = codes[starts[k] + source]
                split[k] = [words[i] for i in source.tolist()]
    catchers = SquareCatchers(min_length, min_exponent)
    catchers.append(codes, lengths)
    runs: list[list[dict]] = [[] for _ in split]
    first = starts + np.arange(len(split))  # a cut follows each text
    for start, end, period in catchers.runs():
        k = int(np.searchsorted(first, start, "right")) - 1
        runs[k].append({"start": start - int(first[k]), "length": end - start, "period": period})
    texts = []
    for words, own in zip(split, runs, strict=True):
        if own:
            own.sort(key=lambda r: (r["start"], r["period"]))
            kept = np.ones(len(words), bool)
            for r in own:
                kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
            words = [words[i] for i in np.flatnonzero(kept).tolist()]
        texts.append(b" ".join(words))
    return [pa.array(lengths), pa.array(runs, _RUNS), pa.array(texts, pa.binary())]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3,
    rewrite: Callable[[object, int], tuple[int, int] | None] | None = None, batch_words: int = 500_000,
) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period by start, then period) and the collapsed text.

    Words are runs other than ASCII white space, case counts. A run is a stretch of
    words with smallest period p, ``min_exponent`` times p and ``min_length`` words long at
    least, that cannot be made longer on either side. The collapsed text is the words,
    joined by one space, without those that some run has after its first p words.
    ``rewrite(id, n)`` may name a place a and a period p for a text of n words; its
    words from a on then repeat the p ones at a, before runs are looked for.

    Nothing is shuffled; a task holds ``batch_words`` words, or one text if that is longer.
    Null and empty texts have no word, no run and an empty collapsed text; rows with
    null or repeated ids are rows of their own; an empty table gives an empty one;
    other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "runs", "collapsed"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            plain, split, size, at = ids.to_pylist(), [], 0, 0
            for k in range(len(texts)):
                split.append((texts[k].as_py() or b"").split())
                size += len(split[-1])
                if size >= batch_words or k + 1 == len(texts):
                    columns = _analyse(plain[at : k + 1], split, min_length, min_exponent, rewrite)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(split)), *columns], names)
                    split, size, at = [], 0, k + 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(work, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
