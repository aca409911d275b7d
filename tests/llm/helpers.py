"""Small inputs and brute-force versions for the corpus operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their results or inside; inputs may have them too.
CLASHING = ("score", "kept", "n_words", "ids", "hashes", "copies", "copy", "letters", "text_", "component", "class_id")


def words(text):
    return WORD.findall(text or "")


def messy_rows():
    """Null in any column, empty, blank and very long texts, ties and repeated rows."""
    long = "lang" * 60_000
    sentence = " ".join(f"wort{i % 37} satz{i % 11}" for i in range(90))
    return [
        (1, sentence, "de", "a", 5),
        (1, sentence, "de", "a", 5),
        (2, sentence, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, long, "en", None, len(long)),
        (7, " ".join(["wieder"] * 30_000), "de", "b", 9),
        (8, "12345 !!! ###", None, "c", 13),
        (9, "ein kurzer text", "de", "c", 15),
        (10, "ein kurzer text", "de", "c", 15),
        (None, "ohne nummer aber mit text " * 20, "de", "c", 15),
        (None, None, None, None, None),
        (11, "<|endoftext|> 東京 😀 ſtraße\x00 İ é", "en", "c", 1),
    ]


def messy(spark, clashing=False):
    rows = spark.createDataFrame(messy_rows(), DOCUMENTS)
    if clashing:
        from pyspark.sql import functions as F

        rows = rows.withColumns({c: F.lit(f"mine-{c}") for c in CLASHING})
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def doc_table(spark, texts):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return spark.createDataFrame(list(texts.items()), schema)


def root_of(links, nodes):
    """Smallest node that links reach, for each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def mutated(rng: random.Random, base: list[str], changes: int) -> list[str]:
    out = list(base)
    for _ in range(changes):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice(([], [f"neu{rng.random()}"], [out[i], f"mehr{rng.random()}"]))
    return out
