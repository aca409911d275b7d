"""The corpus pipeline on planted documents, and stage by stage against what it must keep."""

import random

import pytest
from helpers import empty, messy, words

import corpus_pipeline as cp

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def planted(spark):
    """The documents, and copies, a near copy, a shared passage, a toxic one and clean ones beside them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    civil = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id")
    some = [r.text for r in docs.join(civil, "doc_id").where("lang = 'en' and length(text) between 1500 and 3000").orderBy("doc_id").limit(60).collect()]
    vocabulary = [w for t in some for w in words(t) if w.isalpha()]

    def fresh(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    clean = {20_000 + i: " ".join(fresh(150)) for i in range(20)}
    near = words(clean[20_000])
    near[70] = "changed"
    passage = fresh(70)
    extra = {
        20_100: clean[20_001],
        20_101: " ".join(near),
        20_102: " ".join(fresh(80) + passage + fresh(80)),
        20_103: " ".join(fresh(60) + passage + fresh(90)),
        20_104: " ".join(fresh(40) + ["idiot", "the", "worthless"] + fresh(40)),
        20_105: "123 456 789",
    }
    rows = [(i, t, "en", "src1", len(t)) for i, t in (clean | extra).items()]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)), clean, passage


def test_stages_catch_what_is_planted(spark, planted):
    docs, clean, passage = planted
    left, texts = docs, {}
    for name, stage in cp.STAGES:
        left = stage(spark, left, SF).cache()
        if name != "best_fit_packing":
            assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString()
            texts[name] = dict(left.select("doc_id", "text").collect())
    assert 20_104 not in texts["toxicity"]
    lost = set(clean) - set(texts["toxicity"])
    assert not lost, "clean documents stay"
    assert 20_105 in texts["toxicity"] and 20_105 not in texts["language_id"] and set(clean) <= set(texts["language_id"])
    near = texts["minhash_near_dedup"]
    assert not {20_100, 20_101} & set(near) and set(clean) <= set(near)
    last = texts["substring_dedup"]
    assert " ".join(passage) in last[20_102] and " ".join(passage) not in last[20_103]
    assert len(words(last[20_103])) == 150
    pieces = left.select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    assert {r.doc_id for r in pieces} == set(last)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


@pytest.mark.parametrize("number", range(5))
def test_stages_on_rough_and_no_rows(spark, number):
    name, stage = cp.STAGES[number]
    for docs in (messy(spark), messy(spark, clashing=True), empty(spark)):
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        assert out.count() <= docs.count() + 100 and (docs.count() or not out.count())


def test_run_is_the_stages_in_order(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert rows
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert sum(n for _, n in parts) <= 2048
