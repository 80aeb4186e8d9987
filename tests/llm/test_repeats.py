"""Periodic runs, repeated passages and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from orbitweave.llm import collocations as collocations_module
from orbitweave.llm import passages as passages_module
from orbitweave.llm import periodic_runs as runs_module
from orbitweave.llm.collocations import collocations
from orbitweave.llm.passages import remove_repeats, repeated_strings
from orbitweave.llm.periodic_runs import SquareCatchers, periodic_runs
from orbitweave.llm.repeat_queries import op11_periodic_runs, op12_suffix_array_dedup, op13_phrase_collocations
from orbitweave.llm.suffix_arrays import permuted_common_prefixes, suffix_array

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, min_length=24, min_exponent=3):
    """All runs by comparing the words of each period."""
    found, stretches = [], set()
    for p in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= 2 * p and (start, length) not in stretches:
                stretches.add((start, length))
                if length >= max(min_length, min_exponent * p):
                    found.append((start, length, p))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample(rng):
    n, letters = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 6])
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        at, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        words = [words[i if i < at else at + (i - at) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (7, 3), (1, 4)])
def test_catchers_equal_brute_force_however_words_are_appended(limits):
    rng = random.Random(limits[0])
    for _ in range(150):
        words = sample(rng)
        want = [(s, s + n, p) for s, n, p in plain_runs(words, *limits)]
        whole, bit_by_bit, at = SquareCatchers(*limits), SquareCatchers(*limits), 0
        whole.append(np.array(words, np.int64))
        while at < len(words):
            step = rng.choice([1, 1, 2, 9])
            bit_by_bit.append(np.array(words[at : at + step], np.int64))
            at += step
        assert sorted(whole.runs(), key=lambda r: (r[0], r[2])) == want
        assert sorted(bit_by_bit.runs(), key=lambda r: (r[0], r[2])) == want


def test_runs_end_at_a_cut_and_hash_errors_change_nothing(monkeypatch):
    texts = [[1] * 30, [1] * 30, [], [1, 2] * 40, sample(random.Random(3))]
    for weak in (False, True):
        if weak:  # all hashes agree: only the words themselves tell
            monkeypatch.setattr(runs_module, "mix", lambda x: np.zeros(len(x), np.uint64))
        catchers = SquareCatchers()
        if weak:
            catchers.append(np.array([1, 2, 3] * 20, np.int64))
            assert catchers.runs() == [(0, 60, 3)]
            continue
        catchers.append(np.concatenate([np.array(t, np.int64) for t in texts]), np.array([len(t) for t in texts]))
        assert catchers.runs()[:3] == [(0, 30, 1), (31, 61, 1), (63, 143, 2)]


def test_runs_of_odd_rows(spark):
    long = " ".join(["x"] * 5000 + [str(i) for i in range(3000)] + ["a", "b", "c"] * 4000)
    rows = [(1, None, "u"), (1, "", "u"), (None, "A b " * 12, "u"), (2, "A b " * 12, "u"), (2, "a B " * 11, "u"), (3, long, "u"), (4, "\x0b \t\r\n", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    many = ("x " * 1 + " ".join(str(i) for i in range(3000)) + " a b c").strip()
    assert got == sorted(
        [(0, [], "")] * 3 + [(24, [(0, 24, 2)], "A b")] * 2 + [(22, [], ("a B " * 11).strip()), (20000, [(0, 5000, 1), (8000, 12000, 3)], many)]
    )
    assert periodic_runs(docs.where("false")).collect() == []


def expected_runs(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return (
        doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_op11_equals_brute_force_on_short_documents(spark, tmp_path):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' WHERE length(text) < 6000").fetchall()
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/documents.parquet' WHERE length(text) < 6000) TO '{tmp_path}/documents.parquet'")
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {d: expected_runs(d, t) for d, t in rows}
    assert sum(r[1] > 0 for r in got.values()) > 5


# --- collocations ------------------------------------------------------------------


def plain_collocations(rows, least=10, percent=50, top=2000):
    """Ranked phrases from dictionaries of all of them."""
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in good.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longest[q] = max(longest[q], a)
        ranked = []
        for p, a in good.items():
            if len(p) == 2 and 100 * longest[p] >= percent * a and longest[p]:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def test_collocations_of_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "THE", "of", "é", "x\u00a0y", "\0", "z" * 300, "b-c", "ÀB"]
    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " \x0b "]) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", None, "und", ""]), "q", 1) for _ in range(250)]
    rows += [(None, "en", "q", 1), ("", None, "q", 1), (" .,; ", "leer", "q", 1), ("the of " * 20_000, "en", "q", 1), ("New  York, New York", "fr", "q", 2)] + [("new york city hall", "de", "p", 3)] * 10
    docs = spark.createDataFrame(rows, "text string, lang string, phrase string, n int").repartition(5)
    want = plain_collocations([r[:2] for r in rows])
    assert len(want) > 100
    assert sorted(map(tuple, collocations(docs).collect())) == want
    # Small limits: segments of common prefixes, many merges, ranks by parts.
    for name, value in (("PART_WORDS", 50), ("HOLD_BYTES", 2000), ("MERGE_BYTES", 400)):
        monkeypatch.setattr(collocations_module, name, value)
    assert sorted(map(tuple, collocations(docs).collect())) == want
    assert sorted(map(tuple, collocations(docs, least=3, subsume_percent=90, top=7).collect())) == plain_collocations([r[:2] for r in rows], 3, 90, 7)
    assert collocations(docs.where("false")).collect() == []


def test_op13_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT text, lang FROM '{FOLDER}/documents.parquet'").fetchall()
    got = sorted(map(tuple, op13_phrase_collocations(spark, FOLDER).collect()))
    assert got == plain_collocations(rows) and len(got) > 100


# --- suffix arrays and repeated passages -------------------------------------------


def test_suffix_arrays_and_common_prefixes_equal_brute_force():
    rng = random.Random(2)
    for _ in range(600):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 8, 200])
        text = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.4:
            p = rng.randint(1, 9)
            text = [text[i % p] for i in range(n)]
        order = suffix_array(np.array(text, np.int64))
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        ends = sorted({n, *(rng.randint(1, max(1, n)) for _ in range(3))})
        until = np.array([next(e for e in ends if e > i) for i in range(n)], np.int64)
        before, common = permuted_common_prefixes(np.array(text, np.uint8), order, until)
        for rank, i in enumerate(order.tolist()):
            j = int(order[rank - 1]) if rank else -1
            k = 0
            while j >= 0 and k < min(until[i] - i, until[j] - j) and text[i + k] == text[j + k]:
                k += 1
            assert (before[i], common[i]) == (j, k)


def plain_removal(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each text by counting all its strings."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        out.append((len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


def test_repeated_strings_of_pieces():
    pieces = [b"x" * 90, b"ab" * 30 + b"\xff\0", b"", b"q" + b"ab" * 30, b"\0" * 70]
    got = np.split(repeated_strings(pieces, 50), np.cumsum([len(p) + 1 for p in pieces]))[:-1]
    seen = Counter(p[i : i + 50] for p in pieces for i in range(len(p) - 49))
    assert [g[:-1].tolist() for g in got] == [[len(p) >= i + 50 and seen[p[i : i + 50]] > 1 for i in range(len(p))] for p in pieces]


def removal_rows(docs, **options):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in remove_repeats(docs, **options).collect())


@pytest.mark.parametrize("limits", [(256, (16, 4, 1), 4 << 20, 1 << 20), (2, (16, 4, 1), 3000, 4000), (1, (6, 2, 1), 50_000, 200)])
def test_removal_of_odd_rows_and_frequent_lines(spark, monkeypatch, limits):
    """Limits of 1 and 2 regions a shard send frequent lines through pieces and single strings."""
    for name, value in zip(("WIDEST", "PIECES", "HOLD_BYTES", "SHARD_BYTES"), limits, strict=True):
        monkeypatch.setattr(passages_module, name, value)
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    line, passage, twin = fresh(120), fresh(450), fresh(700)
    texts = [None, "", "short", "x" * 199, "x" * 200, "é" * 300, twin, twin, twin[:500] + "!" + twin[500:], "ab" * 400, fresh(20_000)]
    texts += [fresh(rng.randint(0, 300)) + line + fresh(rng.randint(0, 300)) for _ in range(12)]
    texts += [fresh(150) + passage[k : k + 300] + fresh(k) for k in (0, 30, 90, 150)] + [passage + passage]
    texts += [fresh(rng.randint(0, 4)) + fresh(1) + line + twin[:95 - k] + fresh(60) for k in range(9)]
    docs = spark.createDataFrame([(None if i == 7 else i // 2, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, start int").repartition(3)
    raw = [(t or "").encode() for t in texts]
    want = sorted((i == 7, 0 if i == 7 else i // 2, *r) for i, r in enumerate(plain_removal(raw)))
    assert removal_rows(docs) == want
    assert removal_rows(docs.where("false")) == []


def test_op12_equals_brute_force(spark, tmp_path):
    source = f"SELECT * FROM '{FOLDER}/documents.parquet' WHERE length(text) < 30000"
    duckdb.sql(f"COPY ({source}) TO '{tmp_path}/documents.parquet'")
    rows = duckdb.sql(f"SELECT doc_id, text FROM ({source})").fetchall()
    want = plain_removal([(t or "").encode() for _, t in rows])
    got = {r.doc_id: tuple(r)[1:] for r in op12_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(rows, want, strict=True)}
    assert sum(g[1] > 0 for g in got.values()) > 10
