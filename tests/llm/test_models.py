"""Learned operators by held-out accuracy, packing by its invariants, the pipeline stage by stage."""

import zlib
from itertools import pairwise
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from textloom.llm import language, packing, quality, queries, simhash

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@needs_data
def test_language_held_out(spark):
    rows = queries.op3_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


@needs_data
def test_quality_held_out(spark):
    rows = queries.op6_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93 and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = [(i, f"the and of with {w}", "en") for i, w in enumerate(["this", "that", "from", "have"] * 5)] + [(100 + i, f"der die und mit {w}", "de") for i, w in enumerate(["nicht", "auch"] * 8)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    odd = spark.createDataFrame([(1, None, None, 0.0), (2, "", "en", 0.0), (3, "12 !", "de", 0.0), (None, "the of", None, 0.0), (5, "und die " * 300_000, None, 0.0)], docs.schema)
    model = language.train(docs.unionByName(odd.where("doc_id < 4")))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True) and got[None][0] == "en" and got[5][0] == "de"
    assert {r.doc_id for r in language.accepted(odd, model).collect()} <= {None, 5}
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, "fine words here " * 9 if i % 2 else "a### b$$$ c%%% " * 9) for i in range(60)] + [(None, None), (70, ""), (70, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 60) and len(rows) == 63
    assert quality.good(docs, model).where("doc_id < 60").count() == 30
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_patterns_hold_every_item():
    rng = np.random.default_rng(2)
    for capacity, top in ((32, 31), (1024, 31), (10, 10)):
        demand = {c: int(n) for c, n in enumerate(rng.integers(0, 500, top + 1)) if c}
        plan = packing.plan_patterns(demand, capacity)
        held = {c: sum(times * pattern.get(c, 0) for times, pattern in plan) for c in demand}
        assert held == demand and all(sum(c * k for c, k in pattern.items()) <= capacity for _, pattern in plan)
        classes = np.array(sorted(demand))
        _, used = packing.column_generation(classes, np.array([demand[int(c)] for c in classes], float), capacity)
        assert used.sum() - 1e-6 <= sum(times for times, _ in plan) <= used.sum() + len(demand)
        assert used.sum() >= max(sum(c * n for c, n in demand.items()) / capacity, sum(n for c, n in demand.items() if 2 * c > capacity)) - 1e-6
    assert packing.plan_patterns({}, 8) == []


def test_packing(spark):
    texts = [None, "", "a", "a b " * 2000, "xyz " * 700] + [f"some words {i} " * (i % 90) for i in range(150)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (4, "again", 1)], "doc_id long, text string, length int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 0).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(b.offset == a.offset + a.length for a, b in pairwise(own)) and own[-1].offset + own[-1].length <= 1024
        total = sum(r.length for r in own)
        assert {r.padded_to for r in own} == {total if total & (total - 1) == 0 else 1024}
    for i, text in [*enumerate(texts), (None, "no id"), (4, "again")]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i, len(ids)], key=lambda r: r.start)
        assert own[0].start == 0 and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(docs.limit(0), path, 0).count() == 0


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        after = docs.count()
        assert docs.columns == columns and 0 < after <= before and docs.select("doc_id").distinct().count() == after
        if name == "near duplicates":
            prints = [simhash.fingerprint(r.text) for r in docs.collect()]
            assert len(set(prints)) == len(prints)
            assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 3
        if name == "decontamination":
            left = queries.op5_decontamination(spark, DATA).join(docs, "doc_id", "left_semi")
            assert left.where("contaminated").count() == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == before
