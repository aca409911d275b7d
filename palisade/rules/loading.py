"""Rule lists of the user's own: read from JSON, checked, and matched line by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import lexing
from palisade.functions.dialect import java_pattern
from palisade.rules.fixed_rules import Rule

RULE_SCHEMA = "id string, name string, pattern string, severity string, fix string, cwe string, breach string"
NEEDED = ("id", "name", "pattern", "severity")


def fault(spark: SparkSession, pattern: str) -> str | None:
    """Why the JVM cannot compile an ECMAScript pattern, or None."""
    try:
        spark.range(1).select(F.lit("").rlike(java_pattern(pattern, True))).first()
    except PySparkException as error:
        return str(error).splitlines()[0]
    return None


def load_rules(spark: SparkSession, path: str) -> tuple[list[Rule], list[tuple[str | None, str]]]:
    """(rules, skipped) from a JSON list of objects, one or more files at ``path``.

    A rule without an id, name, pattern or severity, one whose pattern does not compile, and a repeated id are
    skipped and reported with the reason; one bad rule never stops the others.  A rule list is written by
    hand, so it is small enough for the driver, whatever the size of the scanned tables.
    """
    rules, skipped, seen = [], [], set()
    rows = spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path).collect()
    for row in sorted(rows, key=lambda r: r["id"] or ""):
        missing = [c for c in NEEDED if not row[c]]
        reason = (
            f"no {missing[0]}" if missing
            else "repeated id" if row["id"] in seen
            else fault(spark, row["pattern"])
        )
        if reason:
            skipped.append((row["id"], reason))
            continue
        seen.add(row["id"])
        rules.append(Rule(*(row[c] if c != "fix" else row[c] or "" for c in Rule._fields)))
    return rules, skipped


def match_rules(texts: DataFrame, rules: Sequence[Rule], text: str = "content") -> DataFrame:
    """First matching line (1-based) of each rule in each row: the other columns, rule, severity, line.

    Case is ignored.  One narrow pass, without a shuffle.
    """
    others = [c for c in texts.columns if c != text]

    def first(pattern: str) -> Column:
        java = java_pattern(pattern, True)
        return F.array_position(F.transform("_lines", lambda line: line.rlike(java)), True)

    hits = [
        F.struct(
            F.lit(rule.id).alias("rule"),
            F.lit(rule.severity).alias("severity"),
            first(rule.pattern).alias("line"),
        )
        for rule in rules
    ]
    if not hits:
        return texts.select(*others, F.lit("").alias("rule"), F.lit("").alias("severity"), F.lit(0).cast("bigint").alias("line")).limit(0)
    return (
        texts.select(*others, lexing.lines_of(F.col(text)).alias("_lines"))
        .select(*others, F.inline(F.array(*hits)))
        .where("line > 0")
    )
