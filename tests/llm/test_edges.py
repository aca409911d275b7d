"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from helpers import CLASHING, empty, messy, messy_rows, words
from pyspark.sql import functions as F

from palisade.llm import byte_bpe, host_rules, language_id, licenses, packing, records, toxicity
from palisade.llm.dart_minhash import near_duplicates
from palisade.llm.neighbours import linked_vectors
from palisade.llm.repeats import remove_repeats
from palisade.session import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language(docs):
    return language_id.predict(docs, language_id.fit(docs))


def toxic(docs):
    labels = docs.select("doc_id", (F.col("lang") == "de").cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


def encoded(docs):
    return byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)


ROW_BY_ROW = {
    "language": language,
    "toxic": toxic,
    "encoded": encoded,
    "repeats": remove_repeats,
    "measured": host_rules.measure,
    "hosts": lambda d: host_rules.host_verdicts(d.withColumn("host", F.col("source"))),
    "licenses": licenses.scan,
    "near": near_duplicates,
}


@pytest.mark.parametrize("name", sorted(ROW_BY_ROW))
def test_one_row_for_each_row(spark, name):
    docs = messy(spark)
    plain = ROW_BY_ROW[name](docs)
    assert plain.count() == docs.count()
    clashing = ROW_BY_ROW[name](messy(spark, clashing=True))
    results = [c for c in plain.columns if c not in docs.columns or c == "doc_id"]
    wanted = plain.select(results)
    assert clashing.select(results).exceptAll(wanted).count() == 0
    carried = [c for c in CLASHING if c in clashing.columns and c not in plain.columns]
    for c in carried:
        assert {r[0] for r in clashing.select(c).distinct().collect()} == {f"mine-{c}"}
    nothing = ROW_BY_ROW[name](empty(spark))
    assert nothing.columns == plain.columns and nothing.count() == 0


def test_defined_results(spark):
    docs = messy(spark)
    found = {r.doc_id: r for r in language(docs).where("doc_id is not null").collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5, 8))
    assert found[6].lang_pred in ("de", "en") and 0 <= found[6].score <= 1
    scores = toxic(docs).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scores)
    cut = {(r.doc_id, r.text): r for r in remove_repeats(docs).collect()}
    sentence = messy_rows()[0][1]
    assert cut[2, sentence].n_removed == cut[2, sentence].n_words == 180 and cut[2, sentence].kept_text == ""
    assert cut[1, sentence].n_removed == 0  # rows that share a doc_id do not remove from each other
    near = near_duplicates(docs).collect()
    assert {r.class_id for r in near if r.doc_id in (1, 2)} == {1}
    assert {r.class_id for r in near if r.doc_id in (9, 10)} == {9}
    assert all(r.class_id == r.doc_id for r in near if r.doc_id in (3, 4, 5, 6, 7, None))


def test_packing(spark):
    for docs, pieces in ((messy(spark), None), (empty(spark), 0)):
        packed = packing.packed_documents(docs, TOKENIZER)
        rows = packed.collect()
        assert pieces is None or len(rows) == pieces
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert sum(r.piece == 0 for r in rows) == docs.count()
        for s in packing.sequences(packed).collect():
            assert s.n_tokens <= 2048 and len(s.ids) == 4 * s.n_tokens


def test_records(spark):
    for number, docs in enumerate((messy(spark), empty(spark))):
        folder = f"{shared_folder(spark)}/edges-{number}-{id(docs)}"
        records.write_records(docs, folder, TOKENIZER)
        rows = records.read_records(spark, folder).orderBy("start").collect()
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0]), (None, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [3e38, 3e38]), (13, [1e-40, 1e-40]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("component", F.lit("mine"))
    found = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in linked_vectors(vectors).collect())
    assert found == [
        (0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8),
        (9, 0, 9), (10, 0, 10), (11, 0, 11), (12, 1, 12), (13, 1, 12),
    ]
    assert linked_vectors(vectors.limit(0)).count() == 0


def test_inheritance(spark):
    files = spark.createDataFrame(
        [
            ("a/LICENSE", "MIT", 0.9, True), ("a/b/c/x.py", None, 0.0, False), ("a/b/LICENSE", "GPL-3.0", 0.8, True),
            ("a/b/COPYING", "Apache-2.0", 0.8, True), ("a/y.py", None, 0.0, False), ("z/y.py", None, 0.0, False),
            ("z/own.py", "MIT", 1.0, False), ("top.py", None, 0.0, False), (None, None, 0.0, False), ("ab/y.py", None, 0.0, False),
            ("a/y.py", None, 0.0, False),
        ],
        "path string, license string, score double, is_license_file boolean",
    )
    found = [(r.path, r.effective_license, r.origin, r.license_dir) for r in licenses.inherit(files).collect()]
    assert len(found) == 11 and found.count(("a/y.py", "MIT", "inherited", "a")) == 2
    assert ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b") in found
    assert {(p, e) for p, e, o, _ in found if o is None} == {("z/y.py", None), ("top.py", None), (None, None), ("ab/y.py", None)}
    assert ("z/own.py", "MIT", "own", None) in found
    root = files.limit(0).union(spark.createDataFrame([("LICENSE", "MIT", 0.9, True), ("q/w/e.py", None, 0.0, False)], files.schema))
    assert {(r.path, r.license_dir) for r in licenses.inherit(root).collect()} == {("LICENSE", None), ("q/w/e.py", "")}


def test_word_counts(spark):
    docs = messy(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    for r in host_rules.measure(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w, text = words(r.text), r.text or ""
        lines = [x for x in text.split("\n") if words(x)]
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x in runs if runs.count(x) > 1} if len(runs) < 500 else None
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(text.count(c) for c in host_rules.SYMBOLS)
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))
        if twice is not None:
            assert r.n_repeat_words == len({i + k for i, x in enumerate(runs) if x in twice for k in range(5)})
