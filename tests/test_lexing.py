"""The lexer against a character-by-character model, on random texts."""

import random
import time

from pyspark.sql import functions as F

from palisade.functions import lexing, values
from palisade.functions.dialect import java_pattern

ALPHABET = "ab/*'\"`\\\n/*'\n "


def model_state(text: str, offset: int) -> str:
    """Opener of the state at the offset, reading one character ahead."""
    state, i = "", 0
    while i < offset:
        ch, pair = text[i], text[i : i + 2]
        if state == "//":
            state = "" if ch == "\n" else state
        elif state == "/*":
            if pair == "*/":
                state, i = "", i + 1
        elif state:
            if ch == "\\":
                i += 1
            elif ch == state or (ch == "\n" and state != "`"):
                state = ""
        elif pair in ("//", "/*"):
            state, i = pair, i + 1
        elif ch in "'\"`":
            state = ch
        i += 1
    return state


def test_states_match_the_model(spark):
    rng = random.Random(7)
    rows = []
    for k in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        rows.append((k, text, rng.randint(0, len(text))))
    df = spark.createDataFrame(rows, "k int, text string, at int").repartition(8)
    got = df.select("k", "text", "at", lexing.lex_state(F.col("text"), F.col("at")).alias("s"))
    wrong = [(r.text, r.at, r.s) for r in got.collect() if r.s != model_state(r.text, r.at)]
    assert wrong == []


def test_line_states_match_the_model(spark):
    rng = random.Random(8)
    rows = [
        (k, "".join(rng.choice(ALPHABET + "\n\n") for _ in range(rng.randint(0, 60))))
        for k in range(3000)
    ]
    df = spark.createDataFrame(rows, "k int, text string").repartition(8)
    got = df.select("text", lexing.line_start_states(F.col("text")).alias("s")).collect()
    wrong = []
    for r in got:
        starts = [0] + [i + 1 for i, c in enumerate(r.text) if c == "\n"]
        # A line starts after its break, so nothing of the line is read ahead.
        expected = [model_state(r.text[:at], at) for at in starts]
        if r.s != expected:
            wrong.append((r.text, r.s, expected))
    assert wrong == []


def test_state_inside_a_line(spark):
    rng = random.Random(9)
    rows = []
    for k in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60)))
        lines = text.split("\n")
        i = rng.randrange(len(lines))
        col = rng.randint(0, len(lines[i]))
        rows.append((k, text, i, col, sum(len(x) + 1 for x in lines[:i]) + col))
    df = spark.createDataFrame(rows, "k int, text string, i int, col int, at int").repartition(8)
    line = F.get(F.split("text", "\n"), F.col("i"))
    start = F.get(lexing.line_start_states(F.col("text")), F.col("i"))
    got = df.select(
        "*", lexing.state_in_line(start, F.substring(line, F.lit(1), F.col("col")), line).alias("s"),
        lexing.match_offset(lexing.line_starts(F.split("text", "\n")), F.col("i"), F.col("col")).alias("offset"),
    ).collect()
    # The character after a line's end is its break, never part of a delimiter.
    wrong = [(r.text, r.at, r.s) for r in got if r.s != model_state(r.text, r.at)]
    assert wrong == []
    assert all(r.offset == r.at for r in got)


def test_large_file_is_linear(spark):
    """One pass over a five-megabyte file with a hundred thousand comment lines."""
    text = "/*\n" + "x '\n" * 1_200_000 + "*/\ncode"
    row = (
        spark.createDataFrame([(text,)], "text string")
        .select(lexing.line_start_states(F.col("text")).alias("s"))
        .select(F.size("s").alias("n"), F.element_at("s", -1).alias("last"), F.col("s")[5].alias("mid"))
        .first()
    )
    assert (row.n, row.last, row.mid) == (1_200_003, "", "/*")


def test_java_dialect():
    assert java_pattern("a$") == r"a\z"
    assert java_pattern(r"[[$\]]") == r"[\[$\]]"
    assert java_pattern(r"\bx") .startswith("(?:(?<=")
    assert "\\u00a0" in java_pattern(r"[^>\s]")


def test_values(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(values.shannon_entropy(F.lit("aabb"))) == 1.0
    assert one(values.shannon_entropy(F.lit("aé"))) == 1.0
    assert one(values.shannon_entropy(F.lit(""))) == 0.0
    assert one(values.secret_random_part(F.lit("sk_live_abcdefgh"))) == "abcdefgh"
    assert one(values.secret_random_part(F.lit("sk_live_abc"))) == "sk_live_abc"
    assert one(values.is_placeholder(F.lit("xxxxxx")))
    assert not one(values.is_placeholder(F.lit("xxxxx")))
    assert one(values.is_placeholder(F.lit("an example here")))
    assert not one(values.is_placeholder(F.lit("dcEXAMPLEKEY")))
    assert one(values.clean_version(F.lit(">=1.2.3 <2"))) == "1.2.3"


def test_version_order(spark):
    ordered = ["0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2",
               "1.0.0-beta.11", "1.0.0", "1.2", "1.2.3.4.1", "1.2.3.4.2", "1.10.0", "v2.0.0",
               "99999999999999999999999.0-1", "99999999999999999999999.0-100000000000000000000000", "100000000000000000000000"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string")
    got = rows.orderBy(values.version_key(F.col("v"))).collect()
    assert [r.i for r in got] == list(range(len(ordered)))


def test_equal_versions_and_what_is_none(spark):
    same = spark.createDataFrame([("1",), ("1.0",), ("v1.0.0.0.0",), ("01.00",)], "v string")
    assert same.select(values.version_key(F.col("v")).alias("k")).distinct().count() == 1
    none = spark.createDataFrame([("workspace:*",), ("github:u/r",), ("file:../a",), ("",), ("x",)], "v string")
    assert none.select(values.version_key(F.col("v")).alias("k")).where("k is not null").count() == 0


def test_line_starts_and_offsets(spark):
    rng = random.Random(4)
    texts = ["", "\n", "a\n\nb", "no break", "é😀\nx"] + [
        "\n".join("x" * rng.randrange(9) for _ in range(n)) for n in (63, 64, 65, 4096, 4097, 9000)
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    starts = lexing.line_starts(lexing.lines_of(F.col("text")))
    found = {r.id: r.s for r in table.select("id", starts.alias("s")).collect()}
    for i, text in enumerate(texts):
        lengths = [len(x) + 1 for x in text.split("\n")]
        assert found[i] == [sum(lengths[:k]) for k in range(len(lengths))] if len(lengths) < 100 else found[i][-1] == sum(lengths[:-1])
    at = lexing.match_offset(starts, F.lit(2), F.lit(1)).alias("at")
    assert [r["at"] for r in table.orderBy("id").limit(4).select(at).collect()] == [None, None, 4, None]


def test_line_starts_are_linear_in_the_lines(spark):
    def seconds(lines):
        table = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: i.cast("string")), "\n").alias("t"))
        began = time.time()
        assert table.select(F.array_size(lexing.line_starts(lexing.lines_of(F.col("t")))).alias("n")).first().n == lines
        return time.time() - began

    seconds(1000)
    # Adding up all lines before each would take 64 times as long, and minutes.
    assert seconds(160_000) < 2 + 24 * seconds(20_000)
