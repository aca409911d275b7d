"""Strings that any polynomial hash modulo a power of two takes for equal must be told apart everywhere."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import doc_table
from tokenizers import Tokenizer

from palisade.llm import host_rules, text
from palisade.llm.dart_minhash import near_duplicates
from palisade.llm.packing import packed_documents, sequences
from palisade.llm.records import read_records, write_records
from palisade.llm.repeats import remove_repeats
from palisade.session import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def pair(n):
    return thue_morse(n), thue_morse(n, "b", "a")


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_and_windows(n):
    words = text.words(pa.array([" ".join(pair(n))], pa.large_string()))
    for lane in (0, 1):
        a, b = words.hashes(lane)
        assert a != b
    # The same pattern of words, hashed as windows.
    x, y = (text.words(pa.array([" ".join(w)], pa.large_string())) for w in pair(n))
    for lane in (0, 1):
        assert text.windows(x.hashes(lane), n, lane)[0] != text.windows(y.hashes(lane), n, lane)[0]


def test_arithmetic_is_that_of_the_field():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, text.PRIME, 2000, dtype=np.uint64) for _ in range(2))
    edge = np.array([0, 1, text.PRIME - 1, (1 << 31) - 1, 1 << 31, 1 << 60], np.uint64)
    a, b = np.concatenate([a, np.repeat(edge, 6)]), np.concatenate([b, np.tile(edge, 6)])
    assert text._times(a, b).tolist() == [x * y % text.PRIME for x, y in zip(a.tolist(), b.tolist())]
    c = b % np.uint64(1 << 31)
    assert text._times(a, c, small=True).tolist() == [x * y % text.PRIME for x, y in zip(a.tolist(), c.tolist())]
    base = text.LANES[0].byte_base
    assert text._powers(base, 3000).tolist() == [pow(base, i, text.PRIME) for i in range(3000)]


def test_equal_runs_are_equal_wherever_they_stand():
    run = " ".join(f"wort{i % 7}" for i in range(60))
    words = text.words(pa.array([run, "davor " * 5000 + run], pa.large_string()))
    for lane in (0, 1):
        found = text.windows(words.hashes(lane), 60, lane)
        assert found[0] == found[-1]


def test_operators(spark):
    x, y = pair(1024)
    texts = {1: x, 2: y, 3: f"{x}\n{y}\nz", 4: " ".join(x + str(i) for i in range(60)), 5: " ".join(y + str(i) for i in range(60))}
    docs = doc_table(spark, texts)
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    folder = f"{shared_folder(spark)}/hashes-{id(docs)}"
    write_records(docs, folder, TOKENIZER, end_id=1)
    for r in read_records(spark, folder).collect():
        assert np.frombuffer(r.ids, np.uint32).tolist() == [*ids[r.doc_id], 1]
    packed = packed_documents(docs, TOKENIZER, end_id=0, capacity=2048)
    assert sum(s.n_tokens for s in sequences(packed).collect()) == sum(map(len, ids.values())) + len(ids)
    measured = {r.doc_id: r for r in host_rules.measure(docs).collect()}
    assert measured[3].n_dup_lines == 0
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == dict.fromkeys(texts, 0)
    assert all(r.class_id == r.doc_id for r in near_duplicates(docs).collect())
