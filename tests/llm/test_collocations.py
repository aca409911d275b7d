"""Collocations against plain counting, in one trie and in many small ones."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, messy, messy_rows

from palisade.llm import collocations as co
from palisade.session import shared_folder

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, longest=4, within=80, first=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        inside = Counter()
        for q, n in found.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i : i + k]] = max(inside[q[i : i + k]], n)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= within * a and inside[p]:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "über", "ÄB", "x1", "東京", "the", "The", "q-q", "#", " ", "\x00z"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", ";", "?!"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", " new york city hall.", "NEW York"])))
    return rows + [("en", "aa " * 5000), ("en", None), (None, None), ("fr", ""), ("fr", "..!"), ("de", "solo")]


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'mine' as word", "1 as n", "2 as id", "3 as phrase")
    return sorted(tuple(r) for r in co.collocations(table.repartition(4), **options).collect())


@pytest.mark.parametrize("least", [5, 30])
def test_equals_plain_counting(spark, least):
    rows = texts_of(least, 300)
    assert found(spark, rows, least=least) == plain(rows, least)


def test_many_small_tries(spark, monkeypatch):
    """Lists and tries of a few entries each: sequences pass through one after the other."""
    rows = texts_of(3, 200)
    monkeypatch.setattr(co, "SHARD", 24)
    assert found(spark, rows, least=6) == plain(rows, 6)


def test_limits_and_lengths(spark):
    rows = texts_of(4, 200)
    for options in ({"longest": 2}, {"first": 3}, {"within": 50}, {"longest": 6}):
        assert found(spark, rows, least=8, **options) == plain(rows, 8, **options)


def test_messy_and_empty(spark):
    rows = [(r[2], r[1]) for r in messy_rows()]
    got = sorted(tuple(r) for r in co.collocations(messy(spark, clashing=True), least=4).collect())
    assert got == plain(rows, 4) and got
    nothing = co.collocations(empty(spark))
    assert nothing.collect() == [] and nothing.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(spark, [("en", "a b"), ("en", "c")], least=1000) == []


@pytest.mark.parametrize("wide", [1, 2, 90_000])
def test_trie_holds_its_edges_and_no_others(wide):
    """Also with labels of one and of several digits, and a node with very many edges."""
    rng = np.random.default_rng(7)
    edges = np.unique(rng.integers(1, 300, (4000, 2)).astype(np.int32), axis=0)
    edges = edges[(edges[:, 0] % 3 == 0) | (edges[:, 1] < 20)]
    edges = np.concatenate([edges, np.stack([np.full(wide, 310), np.arange(400, 400 + wide)], 1).astype(np.int32)])
    ids = np.arange(1, len(edges) + 1, dtype=np.int32)
    trie = co.build_trie(edges[:, 0], edges[:, 1], ids)
    known = {tuple(e): i for e, i in zip(edges.tolist(), ids.tolist())}
    states = np.concatenate([rng.integers(0, 320, 50_000), edges[-500:].ravel()]).astype(np.int32)
    slots = trie.step(states)
    got = np.where(slots >= 0, trie.target[slots], 0)
    assert got.tolist() == [known.get(p, 0) for p in zip(states[:-1].tolist(), states[1:].tolist())] + [0]


def test_tasks_hold_little_at_a_time(spark, monkeypatch):
    """Rows and batches have a bound, whatever a task reads, and passes leave no tables behind."""
    words = [f"w{i}" for i in range(50)]
    lists = SimpleNamespace(value={"en": (pa.array(words, pa.large_string()), np.arange(1, 51))})
    rng = np.random.default_rng(3)
    texts = [" ".join(words[i] + "." * (i == 7) for i in rng.integers(0, 50, 500).tolist()) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 1000), pa.array(texts), pa.nulls(1000, pa.binary())], names=["lang", "text", "states"])
    rows = [b.column(0)[0].as_py() for b in co._numbered_words(lists, True)(iter([batch]))]
    assert len(rows) > 10 and max(map(len, rows)) < 8 * co.ROW
    states = np.concatenate([np.frombuffer(r + bytes(4), np.int32) for r in rows])
    assert (states > 0).sum() == 500_000 and (states == 0).sum() >= 1000
    wide = np.arange(1, 600_000, dtype=np.int32)
    sent = list(co._neighbours(iter([pa.RecordBatch.from_arrays([pa.array([wide.tobytes()])], names=["states"])])))
    assert max(b.num_rows for b in sent) <= 1 << 17 and sum(b.num_rows for b in sent) == len(wide) - 1
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before, settings = set(folder.glob("table-*")), dict(spark.sparkContext.getConf().getAll())
    monkeypatch.setattr(co, "SHARD", 24)
    rows = texts_of(3, 100)
    assert found(spark, rows, least=6, longest=3) == plain(rows, 6, longest=3)
    new = [spark.read.parquet(str(f)).columns for f in set(folder.glob("table-*")) - before]
    assert new and sum("states" in c or "counts" in c for c in new) <= 1
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == settings.get("spark.sql.parquet.columnarReaderBatchSize", "4096")
