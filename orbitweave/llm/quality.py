"""Document quality by a regularised quadratic discriminant.

Each document becomes a short vector of statistics of its whole text, brought to
a common scale by logarithms and square roots. Each class is a normal density
with a shrunken covariance; the score is the logistic of the difference of their
log densities, which two cached Cholesky factors turn into squared lengths.

The fit needs only sums per class, which Spark aggregates over all labelled rows
that are not held out; labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Fixed character classes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "marks": b"#$%&*@^~=_+<>{}[]\\/",
    "bang": b"!?",
    "pipe": b"|",
    "stop": b".",
    "comma": b",;:",
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
}
FEATURES = [
    "log_bytes", "log_words", "log_word_bytes", "sd_word_bytes", *CLASSES, "high", "distinct_words", "top_word",
    "repeated_next", "upper_words", "odd_endings", "distinct_lines", "bytes_a_line",
]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(CLASSES) + 1))
    for k, chars in enumerate(CLASSES.values()):
        table[list(chars), k] = 1
    table[128:, len(CLASSES)] = 1
    return table


_TABLE = _class_table()
_ODD = np.zeros(256)
_ODD[list(b"#$%&*!|^~=_+<>{}[]\\")] = 1


def text_statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of one text; a null or empty text has all shares 0."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / max(1, n)
    words = raw.split()
    w = len(words)
    sizes = np.fromiter(map(len, words), np.float64, w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = np.bincount(np.fromiter((x[-1] for x in words), np.uint8, w), minlength=256) @ _ODD if w else 0.0
    most = max(Counter(words).values()) if w else 0
    return [
        np.log1p(n),
        np.log1p(w),
        np.log1p(sizes.mean()) if w else 0.0,
        np.log1p(sizes.std()) if w else 0.0,
        *np.sqrt(shares),
        len(set(words)) / max(1, w),
        np.sqrt(most / max(1, w)),
        np.sqrt(sum(map(eq, words, words[1:])) / max(1, w - 1)),
        np.sqrt(sum(map(bytes.isupper, words)) / max(1, w)),
        np.sqrt(ends / max(1, w)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, f array<double>, columns of ``carry``) for every row; other columns are ignored."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], ["id", "f", *carry]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    carried = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(id_col).alias("id"), text_col, *carry).mapInArrow(measure, f"id {kind}, f array<double>{carried}")


@dataclass
class QuadraticDiscriminant:
    """Class means, inverse Cholesky factors of the covariances, and log terms; index 0 is label 0."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of ``x``."""
        logs = [
            self.offsets[c] - 0.5 * np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1) for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / self.temperature, -500, 500)))


def fit(
    statistics: DataFrame, labels: DataFrame, id_col: str, label_col: str,
    pooling: float = 0.6, ridge: float = 0.02, temperature: float = 4.0,
) -> QuadraticDiscriminant | None:
    """Fit on the labelled rows of ``statistics``; None if a class has fewer than two rows.

    ``pooling`` shrinks each covariance towards the pooled one and ``ridge`` towards
    a multiple of the identity in units of the pooled spread. The features of one
    text are not independent, so log-density differences are divided by
    ``temperature``. Only sums leave the executors.
    """
    d = len(FEATURES)
    wanted = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    f = [F.col("f")[i] for i in range(d)]
    sums = [F.sum(x) for x in f] + [F.sum(f[i] * f[j]) for i in range(d) for j in range(i + 1)]
    rows = statistics.join(wanted, "id").groupBy("y").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()
    got = {r["y"]: (r["n"], np.array(r["s"], dtype=float)) for r in rows}
    if len(got) < 2 or min(n for n, _ in got.values()) < 2:
        return None
    lower = np.tril_indices(d)
    means, scatters, counts = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for y, (n, s) in got.items():
        means[y], counts[y] = s[:d] / n, n
        scatters[y][lower] = s[d:] / n
        scatters[y] = scatters[y] + np.tril(scatters[y], -1).T - np.outer(means[y], means[y])
    pooled = np.tensordot(counts / counts.sum(), scatters, 1)
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, offsets = np.zeros((2, d, d)), np.zeros(2)
    for y in (0, 1):
        covariance = (1 - ridge) * ((1 - pooling) * scatters[y] + pooling * pooled) + ridge * spread
        root = np.linalg.cholesky(covariance)
        factors[y] = np.linalg.inv(root)
        offsets[y] = np.log(counts[y] / counts.sum()) - np.log(np.diag(root)).sum()
    return QuadraticDiscriminant(means, factors, offsets, temperature)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", threshold: float = 0.3, folds: int = 5, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, held_out, score, predicted, and the row's columns of ``carry``.

    Rows whose crc32(id as text) mod ``folds`` is 0 are held out of the fit. Null
    and empty texts are scored as empty; a null id is held out of the fit as it
    meets no label; repeated rows get equal scores; labels other than 0 and 1 are
    ignored. Where a class has fewer than two labelled rows every score is 0.5.
    """
    held = (F.crc32(F.col("id").cast("string").cast("binary")) % folds) == 0
    statistics = materialize(document_statistics(docs, id_col, text_col, carry), "quality-statistics")
    model = fit(statistics.where(~held), labels, id_col, label_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], ["id", "score", *carry])

    kind = statistics.schema["id"].dataType.simpleString()
    carried = "".join(f", {c} {statistics.schema[c].dataType.simpleString()}" for c in carry)
    return statistics.mapInArrow(judge, f"id {kind}, score double{carried}").select(
        F.col("id").alias(id_col),
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *carry,
    )
