"""The pipeline's stages against plain Python, and the registered queries."""

import importlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbitweave.llm import queries as registered
from orbitweave.llm.quality import quality_scores
from orbitweave.llm.recipes import MIX_SHARE, domain_of
from orbitweave.llm.tokens import default_tokenizer, encode_words, load

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "te", "ra") for b in ("n", "ro", "st", "vi", "del")]


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """80 good documents, 80 of junk, exact and near copies, rows without id, text, language or source."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(i), "en", f"src{i % 4}", 1) for i in range(80)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(i).split()), "de", "src1", 1) for i in range(80)]
    rows += [(200 + i, prose(i), "en", "src0", 1) for i in range(10)]
    rows += [(300 + i, prose(i, 80)[:-1] + " twist.", "fr", "src2", 1) for i in range(20, 30)]
    rows += [(None, prose(900), None, None, None), (400, None, "en", None, 0), (401, "", None, "src3", 0), (50, prose(50), "en", "src2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(100 + i, 0, 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    good = stages["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    rows = docs.collect()
    key = lambda rows: sorted(map(repr, rows))
    assert key(good.collect()) == key([r for r in rows if scores[r.doc_id] == 1])
    kept = {r.doc_id for r in good.collect()}
    assert set(range(80)) <= kept and not kept & set(range(100, 180))

    once = stages["exact_dedup"](spark, good, folder).collect()
    best = {}
    for r in good.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in once) == sorted(best.values())

    frame = spark.createDataFrame(once, docs.schema)
    near = {r.doc_id for r in stages["near_dedup"](spark, frame, folder).collect()}
    assert near == {r.doc_id for r in once} - set(range(320, 330))

    mixed = stages["mixing"](spark, frame, folder)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= len(once)


def test_near_dedup_stage_links_from_80(spark, folder):
    words = [f"q{j}" for j in range(100)]
    other = ["new" if j in (30, 70) else w for j, w in enumerate(words)]  # 86 of 106 shingles, 0.81
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(other), "en", "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, folder).collect()] == [1]


def test_rows_without_an_id_of_their_own_follow_their_own_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    junk = " ".join(w.upper() + "!!" for w in prose(950).split())
    rows = [
        (None, prose(951), "en", "a", 1), (None, junk, "en", "a", 1), (7, prose(7), "en", "a", 1), (7, junk, "en", "a", 1),
        (None, prose(0), "en", "a", 1), (None, prose(951), "en", "a", 1), (20, prose(952), "en", "a", 1), (21, prose(952), "en", "a", 1),
        (20, prose(953), "en", "a", 1), (None, prose(953)[:-1] + " twist.", "en", "a", 1), (501, None, "en", "a", 1), (501, "", "en", "a", 1),
    ]
    frame = docs.where("doc_id < 7 or doc_id between 8 and 19 or doc_id between 22 and 79 or doc_id between 100 and 179")
    frame = frame.where("doc_id <> 50").unionByName(spark.createDataFrame(rows, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    odd = lambda df: sorted(
        ((r.doc_id, r.text or "") for r in df.collect() if r.doc_id in (None, 0, 7, 20, 21, 501)), key=repr
    )
    good = stages["quality"](spark, frame, folder)
    assert good.where(F.col("text") == junk).isEmpty()
    assert good.where("doc_id is null").count() == 4 and good.where("doc_id = 7").count() == 1

    want = {(0, prose(0)), (7, prose(7)), (None, prose(951)), (21, prose(952)), (20, prose(953)), (None, prose(953)[:-1] + " twist.")}
    once = stages["exact_dedup"](spark, frame.where(F.col("text").isNull() | (F.col("text") != junk)), folder)
    assert odd(once) == sorted([*want, (501, "")], key=repr)
    some = spark.createDataFrame([r for r in once.collect() if r.doc_id in (None, 0, 7, 20, 21)], docs.schema)
    near = stages["near_dedup"](spark, some, folder)
    assert odd(near) == sorted(want - {(None, prose(953)[:-1] + " twist.")}, key=repr)


CLASHES = ["row", "row_number", "place", "text_key", "text_sha256", "id", "n", "kept", "tokens", "mix_epoch", "keep_id", "component_id", "score", "a.b"]


def test_columns_of_the_input_that_clash_pass_unchanged(spark, folder):
    """Every stage gives the rows that it gives without such columns, with their values."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.where("doc_id is null or doc_id < 60 or doc_id in (50, 200, 201, 320, 321, 400, 401) or doc_id between 100 and 130")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        for part in (docs, docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
            wide = part.select("*", *(F.concat_ws("-", F.lit(c), "doc_id", "source").alias(c) for c in CLASHES))
            got = stage(spark, wide, folder)
            assert got.columns == wide.columns, name
            rows = got.collect()
            assert all(r[c] == "-".join([c, *(str(x) for x in (r.doc_id, r.source) if x is not None)]) for r in rows for c in CLASHES), name
            assert sorted(repr(tuple(r)[: len(docs.columns)]) for r in rows) == sorted(repr(tuple(r)) for r in stage(spark, part, folder).collect()), name
    packed = corpus_pipeline.packing(spark, docs.withColumn("start", F.lit("x")).withColumn("length", F.lit(None)), folder)
    assert packed.agg(F.sum("length")).first()[0] == corpus_pipeline.packing(spark, docs, folder).agg(F.sum("length")).first()[0]


def shared_out(children, budget):
    """{name: budget} of {name: (weight, room)}: what a full child cannot take goes to its siblings by weight."""
    out, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, room) in open_.items() if room <= budget * w / total]
        if not full:
            return out | {k: budget * w / total for k, (w, _) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
            budget -= out[k]
    return out


def test_mixing_stage_against_a_tree_in_plain_python(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        source, lang = f"src{rng.integers(7)}", ["en", "de", "it", None][rng.integers(4)]
        rows.append((i, prose(i, int(rng.integers(0, 60))) if i % 17 else None, lang, source if i % 29 else None, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.mixture(spark, docs, "").collect()}

    sizes = {r[0]: len(x) // 4 for r, x in zip(rows, encode_words([(r[1] or "").encode() for r in rows], default_tokenizer()), strict=True)}
    place = F.xxhash64(F.xxhash64(F.lit(17), "doc_id"), F.lit(0)).alias("p")
    seen = {r.doc_id: (r.p, r.domain) for r in docs.select("doc_id", place, domain_of(F.col("source")).alias("domain")).collect()}
    leaves = {}
    for i, _, lang, source, _ in rows:
        leaves.setdefault((seen[i][1], lang, source), []).append(i)
    room = {k: sum(sizes[i] for i in own) for k, own in leaves.items()}
    weight = {k: {"en": 4.0, "de": 2.0}.get(k[1], 1.0) for k in leaves}
    budgets = {(): MIX_SHARE * sum(room.values())}
    for depth in (1, 2, 3):
        for parent in {k[: depth - 1] for k in leaves}:
            nodes = {k[:depth] for k in leaves if k[: depth - 1] == parent}
            sums = {n: tuple(sum(of[k] for k in leaves if k[:depth] == n) for of in (weight, room)) for n in nodes}
            budgets |= shared_out(sums, budgets[parent])
    want = set()
    for leaf, own in leaves.items():
        budget, ahead = int(budgets[leaf] + 1e-9), 0
        for i in sorted(own, key=lambda i: seen[i][0]):
            if ahead < budget or budget >= room[leaf]:
                want.add(i)
            ahead += sizes[i]
    assert got == want and 0 < len(got) < len(rows)


def test_packing_stage_against_the_ids_of_whole_texts(spark):
    texts = [prose(i, 40 * i) for i in range(60)] + [prose(999, 9000), "", None]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    ids = {i: load(default_tokenizer()).encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for i in ids:
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids[i]) and {r.doc_tokens for r in own} == {len(ids[i])}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    windows = {}
    for r in pieces:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(windows) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_run_gives_whole_documents(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    sums = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t")
    assert out.count() > 0 and sums.isEmpty()


def test_run_on_nothing(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_and_the_pipeline_are_registered():
    names = registered.queries()
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in names}
    entry = importlib.import_module("__spark_entry__")
    assert set(names) <= set(entry.queries()) and set(registered.oracle_sql()) <= set(entry.oracle_sql())
