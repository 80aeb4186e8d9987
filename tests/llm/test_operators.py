"""Dealt operators on small tables: odd rows, and results against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitweave.llm import tokens
from orbitweave.llm.boosting import boost, calibrated_cut
from orbitweave.llm.exact_dedup import bucket_directory, exact_dedup
from orbitweave.llm import id_codec
from orbitweave.llm.id_codec import read_segment, write_segment
from orbitweave.llm.lm_scoring import backoff_scores
from orbitweave.llm.mixing import leaf_budgets, mix
from orbitweave.llm.near_dedup import near_duplicates
from orbitweave.llm.packing import best_filling, pack, plan_windows
from orbitweave.llm.pii import find_personal_data
from orbitweave.llm.quality import quality_scores, text_statistics
from orbitweave.llm.shingles import BAND_ROWS, BANDS, SIZE_CLASSES, band_keys, parity_sketch, shingle_sets, signatures
from orbitweave.llm.threshold_topk import top_inner_products
from orbitweave.llm.token_files import read_token_files, write_token_files
from orbitweave.llm.tokens import default_tokenizer, encode_words, load
from orbitweave.llm.url_rules import UrlRule, glob_rule, host_rule, judge_urls, rule_table, word_rule

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, h string, words string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t or ""), "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{k % 977} tail{k}" for k in range(30_000))
ODD = [None, "", " \t\n", "one", "one", "Tie tie TIE", LONG, LONG, "é😀 naïve ÀÉ", "one two three four five six seven"]


# --- exact dedup -------------------------------------------------------------------


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        known = [x for x in own if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", [F.xxhash64, lambda t: F.length(t).cast("long"), lambda t: F.lit(1).cast("long")])
@pytest.mark.parametrize("split_rows", [None, 2])
def test_exact_dedup_with_any_key(spark, key, split_rows):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "one"), (None, "one"), (None, "alone"), (None, "alone")]
    got = exact_dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows]), key=key, capacity=2, split_rows=split_rows)
    got = [tuple(r)[:5] for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == exact_expected(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_copies_of_a_hot_key_are_split_and_owned_by_its_bucket(spark):
    rows = [(i, "hot text") for i in range(400)] + [(None, "hot text")] * 50 + [(1000 + i, f"text {i % 90}") for i in range(200)]
    got = exact_dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), capacity=8, split_rows=20).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == exact_expected(rows)
    # Equal texts lie in one bucket, and no bucket holds more keys than it may.
    keys = Counter()
    for bucket, _ in {(r.bucket, r.text_sha256) for r in got}:
        keys[bucket] += 1
    assert len({r.text_sha256 for r in got}) == sum(keys.values()) == 91 and max(keys.values()) <= 8 and len(keys) > 10


def test_documents_find_their_entries_through_the_directory(spark, monkeypatch):
    """Without a cell of the directory its documents meet no owner."""
    from orbitweave.llm import exact_dedup as module

    whole = module.bucket_directory
    monkeypatch.setattr(module, "bucket_directory", lambda *a: (whole(*a)[0], whole(*a)[1].orderBy("cell").offset(1)))
    texts = frame(spark, [f"text {i % 50}" for i in range(100)])
    assert 0 < exact_dedup(texts, capacity=4).count() < 100


@pytest.mark.parametrize("low_bits", [False, True])
def test_directory_splits_overfull_buckets(spark, low_bits):
    """Also where keys differ in their lowest bits alone, at any depth."""
    entries = spark.range(3000).select((F.col("id") if low_bits else F.xxhash64("id")).alias("h"))
    depth, directory = bucket_directory(entries, capacity=100)
    bucket = {r["cell"]: (r["depth"], r["bucket"]) for r in directory.collect()}
    held = Counter((r.h & (1 << 64) - 1) >> 64 - depth for r in entries.collect())
    assert set(held) == {c & (1 << 64) - 1 for c in bucket}
    sizes = Counter()
    for cell, n in held.items():
        sizes[bucket[cell]] += n
    assert max(sizes.values()) <= 100 and sum(sizes.values()) == 3000
    for local, start in sizes:
        width = 1 << (depth - local + 1)
        first = (start & (1 << 64) - 1) // width * width
        assert sum(n for c, n in held.items() if first <= c < first + width) > 100


# --- near duplicates ------------------------------------------------------------------


def near_expected(rows, percent=85):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        n = len(words)
        sets[i] = {tuple(words[k : k + 5]) for k in range(n - 4)} if n >= 5 else ({tuple(words)} if n else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            common = len(sets[x] & sets[y])
            if x < y and common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for size in (7, 10, 30, 70, 76, 130, 600, 900):
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, size // 40])):
                words[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(map(tuple, got)) == near_expected(rows)


def test_near_duplicates_without_ids_or_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    same = "a b c d e f g h"
    got = near_duplicates(frame(spark, [same, same, same, same], [None, 3, 3, 5])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == [(3, 3, True), (3, 3, True), (5, 3, False), (None, None, True)]


def test_bands_meet_above_the_threshold():
    rng = np.random.default_rng(1)
    missed = 0
    for n in (6, 7, 63, 64, 75, 76, 511, 512, 602, 3000):
        for _ in range(30):
            common = rng.integers(0, 2**63, n, dtype=np.uint64)
            extra = rng.integers(0, 2**63, int(n / 0.85) - n, dtype=np.uint64)
            a, b = np.unique(common), np.unique(np.concatenate([common, extra]))
            missed += not set(band_keys(signatures(a)).tolist()) & set(band_keys(signatures(b)).tolist())
    assert missed == 0


def between_the_limits():
    """Pairs of texts with similarity from 0.80 to just under 0.85, at edges of the size classes and in them."""
    rows = [(0, "a b c d e f g h"), (1, "a b c d e f g h i")]  # 4 of 5 shingles
    for k, size in enumerate((14, 24, 70, 83, 84, 100, 400, 643, 644, 1500)):
        words = [f"p{k}w{j}" for j in range(size)]
        common = size - 4
        extra = next(x for x in range(1, size) if 100 * common < 85 * (common + x))
        rows += [(10 + 2 * k, " ".join(words)), (11 + 2 * k, " ".join([*words, *(f"p{k}x{j}" for j in range(extra))]))]
    words = [f"q{j}" for j in range(100)]
    return [*rows, (50, " ".join(words)), (51, " ".join(["new" if j in (30, 70) else w for j, w in enumerate(words)]))]  # 86 of 106


def test_near_duplicates_between_the_limits(spark):
    rows = between_the_limits()
    texts = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    sets = dict(zip([i for i, _ in rows], shingle_sets([t.encode() for _, t in rows]), strict=True))
    for low in [i for i in sets if i % 2 == 0]:
        common = len(np.intersect1d(sets[low], sets[low + 1]))
        assert 80 <= 100 * common / (len(sets[low]) + len(sets[low + 1]) - common) < 85
    got = {r.doc_id: r.component_id for r in near_duplicates(texts, percent=80).collect()}
    assert got == {i: i - i % 2 for i in sets}
    got = {r.doc_id: r.component_id for r in near_duplicates(texts, percent=85).collect()}
    assert got == {i: i for i in sets}


def test_near_duplicates_at_80_against_all_pairs(spark):
    rng = random.Random(6)
    texts = list(ODD)
    for size in (7, 10, 30, 80, 84, 130, 640, 900):
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, size // 45])):
                words[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows]), percent=80).collect()
    assert sorted(map(tuple, got)) == near_expected(rows, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_a_large_group_mostly_below_the_limit(spark, percent):
    """One family of texts with one to seven changed words: few of its pairs are linked, most are a little apart."""
    rng = random.Random(9)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 8)):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = near_duplicates(frame(spark, texts), percent=percent).collect()
    assert sorted(map(tuple, got)) == near_expected(list(enumerate(texts)), percent)


@settings(max_examples=60, deadline=None)
@example(set(), {1, 12842})
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_sketches_differ_in_no_more_bits_than_sets_in_members(a, b):
    # Unsigned, as numpy counts the bits of a signed number's absolute value; Spark's bit_count takes all 64 bits.
    sketches = [parity_sketch(np.array(sorted(x), np.uint64)).view(np.uint64) for x in (a, b, a | b)]
    for k, other in ((1, a ^ b), (2, b - a)):
        assert int(np.bitwise_count(sketches[0] ^ sketches[k]).sum()) <= len(other)


def test_size_classes_and_bands_reach_to_80():
    for n in range(4, 3000):
        other = n * 100 // 80
        assert any(low <= n < high and low <= other < high for _, low, high, _ in SIZE_CLASSES)
    assert (1 - 0.8**BAND_ROWS) ** BANDS < 1e-6


def test_short_texts_are_one_shingle():
    assert [len(s) for s in shingle_sets([None, b"", b" \n", b"a", b"a b c d", b"a b c d e", b"a b c d e f"])] == [0, 0, 0, 1, 1, 1, 2]


# --- tokens, packing, files -------------------------------------------------------------


def test_words_encode_like_whole_texts():
    texts = [t or "" for t in ODD] + ["Don't <|endoftext|> it's wide\xa0space \x1c é ΑΣ ΣΑΣ.", "a\x85b​c 12345 ½"]
    whole = load(default_tokenizer()).encode_batch(texts, add_special_tokens=False)
    got = [np.frombuffer(x, "<u4").tolist() for x in encode_words([t.encode() for t in texts], default_tokenizer())]
    assert got == [e.ids for e in whole]


def test_new_words_are_encoded_by_the_parts_they_share(monkeypatch):
    path, handed = default_tokenizer(), []
    real = load(path)

    class Counting:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **options):
            handed.extend(" ".join(texts).split())
            return real.encode_batch_fast(texts, **options)

    monkeypatch.setitem(tokens._LOADED, path, Counting())
    monkeypatch.setattr(tokens, "_WORDS", {})
    monkeypatch.setattr(tokens, "_PARTS", {}, raising=False)
    text = "Quorvex, quorvex. (QUORVEX) équorvex7 quorvex! 77"
    got = np.frombuffer(encode_words([text.encode()], path)[0], "<u4").tolist()
    assert got == real.encode(text, add_special_tokens=False).ids
    assert sorted(handed) == sorted(["quorvex", "équorvex", ",", ".", "(", ")", "!", "7"])
    rng = random.Random(3)
    odd = "abXYZßÀéÿÞ×÷µªº089.,;!'<|>/_-()½Σσİ\u0301\x85\xa0 s t"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(3000)]
    whole = [e.ids for e in real.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode_words([t.encode() for t in texts], path)] == whole
    assert encode_words([], path) == [] and encode_words([None, b""], path) == [b"", b""]


def test_words_are_kept_by_their_parts(monkeypatch):
    path = default_tokenizer()
    monkeypatch.setattr(tokens, "_WORDS", {})
    names = ["quor", "vexé", "thon", "blé"]
    text = " ".join(f"{a}{m}{b.upper()}" for a in names for m in ",.!?-" for b in names)
    got = np.frombuffer(encode_words([text.encode()], path)[0], "<u4").tolist()
    assert got == load(path).encode(text, add_special_tokens=False).ids
    assert sorted(tokens._WORDS[path][0]) == sorted(p.encode() for p in [*names, *",.!?-"])


def test_broken_utf8_is_encoded_as_its_replacement():
    rng = random.Random(8)
    some = [b"\xc3", b"\xc3\xa9", b"\xc3\x89", b"\x80", b"\xc3\x97", b"\xc3\xb7", b"\xe2\x80", b"a", b"Z", b"'", b" ", b"\n", b".", b"\xff"]
    texts = [b"\x80", b"\xc3", b"\xc3\xc3\xa9", b"\xa9 \xc3", *(b"".join(rng.choices(some, k=rng.randrange(12))) for _ in range(2000))]
    whole = load(default_tokenizer()).encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode_words(texts, default_tokenizer())] == [e.ids for e in whole]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_best_filling_is_the_best(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    found = best_filling(counts, room)
    assert sum(n * k for n, k in found.items()) == max(sums) and all(k <= counts[n] for n, k in found.items())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once(counts):
    windows, seen = {}, Counter()
    for s in plan_windows(counts, 64):
        for rank in range(s.copies * s.repeats):
            turn, within = divmod(rank, s.copies)
            windows.setdefault(s.sequence + turn, []).append((s.offset + within * s.length, s.length))
            seen[s.length, s.first + rank] += 1
    assert set(seen.values()) <= {1} and Counter(n for n, _ in seen) == Counter(counts)
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(windows) == list(range(len(windows)))


def ids_of(text, end):
    return np.array([*load(default_tokenizer()).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pack_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "one")]
    got = pack(frame(spark, [t for _, t in rows], [i for i, _ in rows]), with_ids=True).toPandas()
    got["doc_id"] = got["doc_id"].astype("Int64")
    for i, t in dict(rows).items():
        whole = ids_of(t, 2)
        own = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        own = own.drop_duplicates("start").sort_values("start")
        assert b"".join(own.ids) == whole.tobytes()
        assert (own.doc_tokens == len(whole)).all()
        assert [zlib.crc32(x) for x in own.ids] == own.ids_crc32.tolist()
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window.offset.tolist() == (window.length.cumsum() - window.length).tolist()
        assert window.length.sum() <= 4096
    assert pack(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    random.Random(1).shuffle(rows)
    files = write_token_files(frame(spark, [t for _, t in rows], [i for i, _ in rows]), segment_ids=500)
    assert files.count() > 2
    got = sorted(map(tuple, read_token_files(files).collect()))
    at, want = 0, []
    for i, t in sorted(rows):
        ids = ids_of(t, 1)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert [r.ids for r in read_token_files(files, with_ids=True).where("doc_id = 9").collect()] == [ids_of(ODD[9], 1).tolist()]
    assert read_token_files(write_token_files(frame(spark, []))).count() == 0


@given(st.lists(st.lists(st.integers(0, 65_535), max_size=700), max_size=5), st.integers(2, 60_000))
@settings(max_examples=40, deadline=None)
def test_segments_decode_to_what_was_coded(docs, span):
    docs = [(k - 2, np.array(d, np.int64) % span) for k, d in enumerate(docs)]
    back = read_segment(write_segment(docs))
    assert [(k, x.tolist()) for k, x in back] == [(k, x.tolist()) for k, x in docs]


def test_token_files_of_missing_and_repeated_ids(spark, tmp_path):
    texts = ["b", "a a", "c", "c", None, "x y z", "b"]
    ids = [5, 5, None, None, None, -(1 << 63), 5]
    docs = frame(spark, texts, ids)
    runs = [sorted(map(tuple, read_token_files(write_token_files(docs.repartition(n))).collect()), key=lambda r: r[1]) for n in (1, 4)]
    assert runs[0] == runs[1]
    assert [r[0] for r in runs[0]] == [None] * 3 + [-(1 << 63)] + [5] * 3
    sizes = [r[2] for r in runs[0]]
    assert [r[1] for r in runs[0]] == [sum(sizes[:k]) for k in range(7)]
    assert sorted(r[3] for r in runs[0]) == sorted(zlib.crc32(ids_of(t, 1).tobytes()) for t in texts)
    write_token_files(docs, folder=str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).agg(F.sum("n_ids")).first()[0] == sum(sizes)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=900))
@settings(max_examples=20, deadline=None)
def test_wide_ids_come_back(ids):
    docs = [(None, np.array(ids, np.int64)), (7, np.array([3], np.int64))]
    back = read_segment(write_segment(docs))
    assert [(k, x.tolist()) for k, x in back] == [(k, x.tolist()) for k, x in docs]


def test_ordinary_ids_take_less_than_16_bits(spark):
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 300_000), 40_000).astype(np.int64)
    assert len(write_segment([(1, ids)])) < 2 * len(ids) * 0.8


def test_blocks_share_the_frequencies_of_their_segment():
    """Each of these blocks is too short to learn 20,000 ids; their shares stand once in the segment."""
    ids = np.minimum(np.random.default_rng(4).zipf(1.3, 1_200_000), 20_000) * 3
    data = write_segment([(1, ids)])
    assert len(data) < 0.95 * len(ids)
    assert np.array_equal(read_segment(data)[0][1], ids)


def test_predictions_that_hold_and_break_come_back(monkeypatch):
    rng = np.random.default_rng(6)
    parts = [np.tile(rng.integers(0, 70_000, rng.integers(1, 4)), rng.integers(1, 300)) for _ in range(600)]
    ids = np.concatenate([np.append(p, rng.integers(0, 2**32, dtype=np.int64)) for p in parts])
    rare = np.zeros(70_000, np.int64)
    rare[rng.integers(0, 70_000, 40)] = rng.integers(1, 60_000, 40)
    for most in (1 << 20, 500):  # one stream; two of halves
        monkeypatch.setattr(id_codec, "_MOST", most)
        for x in (ids, rare, ids[:1], np.arange(300_000)):
            assert np.array_equal(read_segment(write_segment([(None, x)]))[0][1], x)


def test_a_damaged_table_of_shares_is_an_error():
    data = bytearray(write_segment([(1, np.arange(3000) % 7)]))
    data[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        read_segment(bytes(data))


def test_a_damaged_segment_is_an_error():
    data = bytearray(write_segment([(1, np.arange(3000))]))
    data[-40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        read_segment(bytes(data))
    with pytest.raises(ValueError, match="segment"):
        read_segment(b"\0" * 40)


# --- quality ------------------------------------------------------------------------------


def test_quality_learns_and_scores_odd_rows(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "river", "runs", "by", "stone", "walls."]) + rng.choice(["", "s"]) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY", "NOW", "WIN"]) + "!!" for _ in range(60)) for _ in range(120)]
    docs = frame(spark, [*good, *bad, *ODD], [*range(250 - len(ODD)), *range(250, 250 + len(ODD))])
    labels = spark.createDataFrame([(i, 1 if i < 120 else 0) for i in range(240)] + [(5, None), (6, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == 250
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(240) if got[i].held_out]
    assert sum(got[i].predicted == (i < 120) for i in held) >= 0.95 * len(held)
    few = quality_scores(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in few} == {0.5}


def test_quality_equals_a_plain_quadratic_discriminant(spark):
    """Overlapping classes, against densities from determinants and solved systems; rows that repeat or have no id too."""
    rng = random.Random(21)
    words = ["river", "Stone", "WIN", "now!!", "12", "a,b", "walls.", "the", "$$", "x|y"]

    def text(k):
        weights = [3, 2, 1, 1, 1, 1, 3, 4, 1, 1] if k % 2 else [1, 1, 3, 3, 2, 1, 1, 2, 2, 2]
        return " ".join(rng.choices(words, weights, k=rng.randint(5, 60))) + "\n" * (k % 4)

    texts = [text(k) for k in range(300)]
    docs = frame(spark, [*texts, texts[1], texts[2], None], [*range(300), 1, None, None])
    labels = spark.createDataFrame([(k, k % 2 if k % 13 else 1 - k % 2) for k in range(300)], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    x = np.array([text_statistics(t) for t in texts])
    y = np.array([k % 2 if k % 13 else 1 - k % 2 for k in range(300)])
    taught = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k in range(300)])
    taught_rows = np.append(np.flatnonzero(taught), [1] if taught[1] else [])  # a repeated row counts twice
    x_taught, y_taught = x[taught_rows], y[taught_rows]
    share = [np.mean(y_taught == c) for c in (0, 1)]
    scatter = [np.cov(x_taught[y_taught == c].T, bias=True) for c in (0, 1)]
    pooled = share[0] * scatter[0] + share[1] * scatter[1]
    logs = []
    for c in (0, 1):
        covariance = 0.98 * (0.4 * scatter[c] + 0.6 * pooled) + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        away = x - x_taught[y_taught == c].mean(axis=0)
        logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * np.einsum("ij,ij->i", away, np.linalg.solve(covariance, away.T).T))
    want = 1 / (1 + np.exp((logs[0] - logs[1]) / 4))
    assert 0.05 < want.min() < 0.3 < want.max() < 0.97 or want.std() > 0.1
    for r in rows:
        if r.doc_id is not None:
            assert abs(r.score - want[r.doc_id]) < 1e-6
    assert sorted(round(r.score, 9) for r in rows if r.doc_id is None)[0:2] and len(rows) == 303
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and not any(r.held_out for r in rows if r.doc_id is None)


# --- top-k --------------------------------------------------------------------------------


def test_topk_against_all_products(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.integers(-3, 4, 6).astype(float) / 1.5 for _ in range(700)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1100, [], 1), (1200, [1.0, None] + [0.0] * 4, 1), (1300, [float("nan")] * 6, 1), (1400, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1500, [0.0] * 6, 1), (1600, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(5)
    got = top_inner_products(df, F.col("vec_id") % 100 == 0, block_rows=64, query_rows=6).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_inner_products(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_refuses_sums_that_would_not_be_exact(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1e9, 0.0]), (3, [None, 1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large in the vector of 7"):
        top_inner_products(rows, F.col("vec_id") % 100 == 0).collect()
    assert top_inner_products(rows.where("vec_id <> 7"), F.col("vec_id") % 100 == 0).collect() == []


def test_topk_of_one_id_with_different_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score >> 20) for r in top_inner_products(rows, F.col("vec_id") % 100 == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 3), (2, 2, 2), (3, 1, 0)]


# --- mixing -------------------------------------------------------------------------------


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "1", 10.0), ("a", "x", "2", 1000.0), ("a", "y", "3", 1000.0), ("b", "x", "4", 100.0), (None, "x", None, 50.0)],
        "domain string, lang string, source string, tokens double",
    )
    weights = leaves.select("domain", "lang", "source", F.when(F.col("domain").isNull(), 0.0).otherwise(1.0).alias("weight"))
    got = {r.source: r.budget for r in leaf_budgets(leaves, weights, 800.0, 1).collect()}
    # b is full at 100 of its 200; a gets 700, two thirds of it for x, where source 1 is full at 10.
    assert got == {"1": 10, "2": 456, "3": 233, "4": 100, None: 0}


def test_mix_takes_prefixes_of_epochs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]), 1, "x", "y", "z", "w") for i in range(900)]
    docs = spark.createDataFrame([*rows, (None, None, "en", "s1", 0, "", "", "", ""), (1, "", "en", None, 0, "", "", "", "")], SCHEMA)
    names = F.lit("d"), F.col("lang"), F.col("source")
    weights = docs.select(F.lit("d").alias("domain"), "lang", "source", F.when(F.col("lang") == "de", 5.0).otherwise(1.0).alias("weight")).distinct()
    got = mix(docs, weights, *names, share=0.7, max_epochs=2)
    assert got.columns == [*docs.columns, "mix_epoch"]
    picked = got.collect()
    words = Counter()
    for r in picked:
        words[r.lang, r.source] += len((r.text or "").split())
    held = Counter()
    for r in rows:
        held[r[2], r[3]] += len(r[1].split())
    total = 0.7 * sum(held.values())
    # German sources are full; the third English source is empty, so its share goes to the other two.
    for (lang, source), n in held.items():
        share = total * {"de": 5.0, "en": 1.5, None: 1.0}[lang] / 15
        assert words[lang, source] <= 2 * n
        assert lang == "de" or share * 0.999 - 1 <= words[lang, source] <= 2 * n
    assert len(picked) == len({(r.doc_id, r.mix_epoch, r.lang, r.source) for r in picked})
    assert sorted(map(tuple, mix(docs, weights, *names, share=0.7, max_epochs=2).collect()), key=repr) == sorted(map(tuple, picked), key=repr)
    assert mix(docs.where("false"), weights, *names).count() == 0


def test_mix_matches_brute_force_prefix(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 3}", 1, "", "", "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = F.lit("d"), F.col("lang"), F.col("source")
    weights = docs.select(F.lit("d").alias("domain"), "lang", "source", F.lit(1.0).alias("weight")).distinct()
    got = {r.doc_id for r in mix(docs, weights, *names, share=0.5).collect()}
    places = {r.doc_id: r.p for r in docs.select("doc_id", F.xxhash64(F.xxhash64(F.lit(17), "doc_id"), F.lit(0)).alias("p")).collect()}
    total = 0.5 * sum(1 + i % 7 for i in range(300))
    want = set()
    for s in range(3):
        own = sorted((i for i in range(300) if i % 3 == s), key=places.get)
        budget, ahead = math.floor(total / 3), 0
        for i in own:
            if ahead < budget:
                want.add(i)
            ahead += 1 + i % 7
    assert got == want


def test_a_whole_pass_takes_texts_without_tokens(spark):
    rows = [(i, "w w" if i % 2 else None, "en", f"s{i % 3}", 1, "", "", "", "") for i in range(60)]
    rows += [(100 + i, t, "en", "blank", 1, "", "", "", "") for i, t in enumerate([None, "", "  "])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("mix_epoch", F.lit("mine"))
    names = F.lit("d"), F.col("lang"), F.col("source")
    weights = docs.select(F.lit("d").alias("domain"), "lang", "source", F.lit(1.0).alias("weight")).distinct()
    got = mix(docs, weights, *names, share=1.0)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows) and {r.mix_epoch for r in got.collect()} == {0}
    twice = mix(docs, weights, *names, share=2.0, max_epochs=2).collect()
    assert Counter(r.doc_id for r in twice) == {r[0]: 1 if r[0] >= 100 else 2 for r in rows}


def test_mix_counts_ids_of_a_tokenizer(spark):
    texts = [f"extraordinarily{k} unpronounceable words" if k % 2 else "a b c" for k in range(200)]
    rows = [(k, t, "en", f"s{k % 2}", 1, "", "", "", "") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = F.lit("d"), F.col("lang"), F.col("source")
    weights = docs.select(F.lit("d").alias("domain"), "lang", "source", F.lit(1.0).alias("weight")).distinct()
    got = {r.doc_id for r in mix(docs, weights, *names, share=0.3, tokenizer=default_tokenizer()).collect()}
    sizes = [len(x) // 4 for x in encode_words([t.encode() for t in texts], default_tokenizer())]
    places = {r.doc_id: r.p for r in docs.select("doc_id", F.xxhash64(F.xxhash64(F.lit(17), "doc_id"), F.lit(0)).alias("p")).collect()}
    held = [sum(sizes[k] for k in range(s, 200, 2)) for s in (0, 1)]
    first = min(held[0], 0.15 * sum(held))
    want = set()
    for s, budget in ((0, math.floor(first)), (1, math.floor(0.3 * sum(held) - first))):
        ahead = 0
        for k in sorted(range(s, 200, 2), key=places.get):
            want |= {k} if ahead < budget else set()
            ahead += sizes[k]
    assert got == want


# --- language model -----------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores_against_counts(spark, order):
    texts = [*ODD, "the cat sat on the mat", "the cat ran", "a dog sat on the mat", "the cat ran"]
    docs = frame(spark, texts).repartition(3)
    got = {r.doc_id: r for r in backoff_scores(docs, order=order, batch_words=40, part_ngrams=500).collect()}
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in enumerate(texts)}

    def grams(w):
        return Counter(tuple(w[j : j + n]) for n in range(1, order + 1) for j in range(len(w) - n + 1))

    all_grams = sum((grams(w) for w in words.values()), Counter())
    total = sum(map(len, words.values()))
    for i, w in words.items():
        own, score, rest = grams(w), 0.0, max(1, total - len(w))
        for end in range(1, len(w) + 1):
            for start in range(max(0, end - order), end):
                gram = tuple(w[start:end])
                if count := all_grams[gram] - own[gram]:
                    score += math.log(count / (all_grams[gram[:-1]] - own[gram[:-1]] if gram[:-1] else rest))
                    break
                score += math.log(0.4)
            else:
                score -= math.log(rest + 1)
        assert got[i].n_words == len(w) and math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[i].mean_score is None) == (not w)


def test_backoff_scores_of_odd_tables(spark):
    ids = [None, None, 7, 7, 7]
    got = backoff_scores(frame(spark, ["a b c", None, "a b c", "a b c", "z"], ids), order=3).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == [("7", 1), ("7", 3), ("7", 3), ("None", 0), ("None", 3)]
    assert len({round(r.score, 9) for r in got if r.n_words == 3}) == 1
    assert backoff_scores(frame(spark, [])).count() == 0
    assert {r.score for r in backoff_scores(frame(spark, [None, ""])).collect()} == {0.0}
    with pytest.raises(ValueError, match="one word"):
        backoff_scores(frame(spark, []), order=0)


# --- URLs ---------------------------------------------------------------------------------


def test_url_rules_against_every_rule(spark):
    urls = [None, "", "no scheme", "http://", "://x.org", "http://ORG/", "https://a.b.Example.org/en/1?x#y", "http://example.org/en/12", "http://example.org/EN/1",
            "http://notexample.org/en/1", "http://shop.casino.net/x", "http://casinos.net/", "http://a.net/play-CASINO/", "http://a.com#/de/", "http://a.com/de/",
            "http://a.com/de", "ftp://x.com?://y.org/", "http://free-bets.com/fr/", "http://a.net/\nporn/", "http://a.net/" + "x/" * 5000]
    hosts = [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("com", "/fr/", "allow")]
    rules = [host_rule(*r) for r in hosts] + [word_rule(w) for w in ("casino", "free-bets", "porn")] + [UrlRule("any", "allow", "^$", (), 1, reported=False)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls + urls[:9])], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    for i, u in enumerate(urls + urls[:9]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for h, p, a in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
        blocked = re.search(r"(?i)(^|[^a-z0-9])(casino|free-bets|porn)([^a-z0-9]|$)", host + path)
        rule, verdict = (max(fits)[1], max(fits)[2]) if fits else (None, "block" if blocked else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert judge_urls(pages, []).where("verdict <> 'allow'").count() == 0
    assert judge_urls(pages.where("false"), rules).count() == 0


def test_globs_are_found_by_their_rarest_token(spark):
    globs = ["*/wp-{admin,login}/*", "*/free-*-bonus/*", "track.*/click/*", "*xyz*", "*"]
    assert [glob_rule(g).tokens for g in globs] == [("wp",), ("free", "bonus"), ("track", "click"), (), ()]
    urls = ["http://a.org/wp-admin/x", "http://a.org/wp-other/x", "http://a.org/WP-Login/", "http://b.org/free-big-bonus/1", "http://b.org/freebonus/",
            "http://track.c.org/click/9", "http://d.org/axyzb", "http://e.org/\nwp-admin/ /wp-admin/", None, "http://f.org/"]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (0, urls[0])], "page_id long, url string")
    rules = rule_table(spark, [glob_rule(g) for g in globs[:4]] * 2)
    got = [(r.page_id, r.verdict) for r in judge_urls(pages, rules).collect()]
    want = [(k, "block" if k in (0, 2, 3, 5, 6, 7) else "allow") for k in range(len(urls))] + [(None, "block"), (0, "block")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.verdict for r in judge_urls(pages, [glob_rule(globs[4])]).collect()} == {"block"}


# --- personal data --------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
NAMES = ("email", "ip", "card", "phone")


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m.group())]
    return [f"{NAMES[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_spans_against_patterns(spark):
    rng = random.Random(6)
    texts = [*ODD, "a@b.c x@y.zz_foo@bar.com a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.1", "+1 (234) 555-6789 é 4111 1111-1111 1111", "a" * 20_000 + "@", "1" * 20_000, "a@b" + ".c" * 8000, "1 " * 8000]
    texts += ["".join(rng.choice("0123456789  .-+@ab(") for _ in range(rng.randrange(200))) for _ in range(150)]
    got = {r.doc_id: r for r in find_personal_data(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{n}"] for n in NAMES] == [sum(w.startswith(n) for w in want) for n in NAMES]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
    assert find_personal_data(frame(spark, [])).count() == 0


def test_proposals_that_look_like_base_spans_are_added(spark):
    good = [f"call +1 (200) 555-{k:04d} now" for k in range(400)]
    texts = [*good, "call (200) 555-0199 now", "see 12 of 34 and 5-6", "plain words only"]
    got = {r.doc_id: r for r in find_personal_data(frame(spark, texts), precision=0.9).collect()}
    assert got[401].n_added == got[402].n_added == 0
    assert all(got[k].n_phone == 1 for k in range(400))


def test_email_in_words_is_added_without_at_sign_or_dot(spark):
    texts = [*(f"mail jane.doe@example.com now {k}" for k in range(400)), "mail jane at example.com now"]
    got = {r.doc_id: r for r in find_personal_data(frame(spark, texts), precision=0.9).collect()}
    assert got[400].n_added == 1 and got[400].spans == "email:5:24" and got[400].n_email == 0
    assert all(got[k].n_added == 0 and got[k].n_email == 1 for k in range(400))


def test_data_written_past_the_patterns_is_added_and_look_alikes_are_not(spark):
    rng = random.Random(3)
    card = lambda: next(c for c in iter(lambda: f"4{rng.randrange(10**15):015d}", "") if luhn(c))
    plain = []
    for k in range(300):
        plain.append(f"write to name{k}.x@mail{k % 7}.example.org now, host 10.{k % 250}.3.{k % 99} is up")
        plain.append(f"card {card()} or call +1 (2{k % 90:02d}) 555-{k:04d} now")
    good = [
        ("write to {} now", "email", "jo.doe (at) mail.example.org"), ("write to {} now", "email", "jo.doe [at] mail [dot] example [dot] org"),
        ("mail: {}", "email", "jane at example dot com"), ("host {} ok", "ip", "10[.]20[.]30[.]40"),
        ("card {} x", "card", "4111/1111/1111/1111"), ("call {} now", "phone", "1 (243) 555-3824"),
    ]
    bad = ["met at home. Then we left at noon.", "777[.]1[.]2[.]3", "card 4111/1111/1111/1112 x", "on 2024-10-23 11 it", "sum 1.234.567.890 in all", "12 and 14", ""]
    texts = [*plain, *(around.format(piece) for around, _, piece in good), *bad]
    got = {r.doc_id: r for r in find_personal_data(frame(spark, texts)).collect()}
    for i, (around, kind, piece) in enumerate(good, len(plain)):
        start = around.index("{")
        assert f"{kind}:{start}:{start + len(piece)}" in got[i].spans.split(",") and got[i].n_added >= 1, piece
    for i in range(len(plain) + len(good), len(texts)):
        assert got[i].n_added == 0, texts[i]
    # Held-out precision of the plain texts: nothing is added to them.
    assert sum(got[i].n_added for i in range(len(plain))) == 0


PLAIN = [
    "We shop at amazon.com most weekends.", "Look at README.md before you start.", "He works at example.org in Berlin.", "They met at noon.The bus left.",
    "Read more at docs.python.org or ask.", "Contact us at example.org for help.", "His number is 123-45-6789 there.", "The server runs at mail.example.org now.",
]


def test_plain_sentences_stay_and_ways_around_the_pattern_do_not(spark):
    """Trees are taught by a corpus with plain mentions of hosts and dates, and by what they themselves write."""
    rng = random.Random(11)
    verbs, hosts = ("stay", "shopped", "works", "looked", "lives", "it is"), ("heise.de", "shop.example.com", "notes.txt", "blog.example.org")
    texts = [f"{'mail' if k % 2 else 'write to'} n{k}.x{k % 9}@mail{k % 7}.example.org or jane{'abcdef'[k % 6]}@site.org now, host 10.{k % 250}.3.{k % 99} is up" for k in range(300)]
    texts += [f"call +1 (2{k % 90:02d}) 555-{k:04d} or +49 30 {k:04d} 5566 now" for k in range(300)]
    texts += [f"we {rng.choice(verbs)} at {rng.choice(hosts)} since 20{k % 25:02d}-0{k % 9 + 1}-1{k % 9}" for k in range(200)]
    added = [("bob at foo dot com", 0), ("jo (at) foo.org", 0), ("mail jane at example.com now", 5), ("see jo.doe7 at foo.org", 4)]
    got = {r.doc_id: r for r in find_personal_data(frame(spark, [*texts, *PLAIN, *(t for t, _ in added)])).collect()}
    for i, text in enumerate(PLAIN, len(texts)):
        assert got[i].n_added == 0, (text, got[i].spans)
    for i, (text, start) in enumerate(added, len(texts) + len(PLAIN)):
        assert got[i].spans.startswith(f"email:{start}:"), (text, got[i].spans)
    assert sum(got[i].n_added for i in range(len(texts))) == 0


def test_few_held_out_spans_prove_nothing(spark):
    texts = [f"mail n{k}.x@site.org" for k in range(30)] + ["jo (at) foo.org"]
    assert [r.n_added for r in find_personal_data(frame(spark, texts)).collect()] == [0] * 31
    score, good = np.array([3.0, 2.0, 1.0]), np.array([60.0, 60.0, 10.0])
    bad = np.array([0.0, 1.0, 50.0])
    assert calibrated_cut(score, good, bad, 0.98) == 1.5
    assert calibrated_cut(score, good, bad, 0.98, 1.0) == 2.5
    assert calibrated_cut(score, good, bad, 0.98, 3.0) == float("inf")


def test_spans_at_the_end_of_long_texts_teach_too(spark):
    mails = " ".join(f"mail n{k}.x@site.org" for k in range(20))
    texts = [f"{mails} then " + " and ".join(f"call +1 (2{j:02d}) 555-{k:04d} now" for j in range(30)) for k in range(20)]
    got = {r.doc_id: r for r in find_personal_data(frame(spark, [*texts, "call 1 (243) 555-3824 now"])).collect()}
    assert [got[k].n_phone for k in range(20)] == [30] * 20
    assert got[20].spans == "phone:5:21"


def test_personal_data_of_repeated_and_missing_ids(spark):
    text = "call +1 (200) 555-0199 now"
    got = find_personal_data(frame(spark, [text, text, text, None], [None, 7, 7, 7])).collect()
    assert sorted((r.n_phone, r.doc_id) for r in got if r.doc_id) == [(0, 7), (1, 7), (1, 7)]
    assert [r.n_phone for r in got if r.doc_id is None] == [1]
    assert find_personal_data(frame(spark, [])).count() == 0


def test_trees_separate_and_cuts_keep_precision():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    positive = np.array([10.0 if a > 1 and b > 0 else 0.0 for a, b in x])
    negative = np.where(positive > 0, 0.0, 10.0)
    trees = boost(x, positive, negative)
    score = np.sum([t.value(x) for t in trees], axis=0)
    assert ((score > 0) == (positive > 0)).all()
    cut = calibrated_cut(score, positive, negative, 0.99)
    assert ((score >= cut) == (positive > 0)).all()
    assert calibrated_cut(score, np.zeros(16), negative, 0.5) == float("inf")
