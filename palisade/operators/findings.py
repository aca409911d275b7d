"""Operators over findings: scores, grades, counts, order, prompts, de-duplication.

A repository may hold a third of all findings.  Sums, counts and sets are partial
aggregates; ranks that are cut off (top-k, first of a key) are filtered map-side by the
window group limit; running numbers are computed in two levels (``number_in_order``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palisade.model import ALL_SCANNERS, AUDIT_SCANNERS
from palisade.rules import report_texts as texts
from palisade.session import cut_lineage

PROMPT_ITEMS_PER_PART = 1000
#: Entries of a repository's fix list up to which one task sorts them.
LIST_ITEMS = 100_000


def is_actionable(severity: Column) -> Column:
    return severity.isin("critical", "warning")


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(is_actionable(F.col("severity")))


def scanner_order(scanner: Column) -> Column:
    """Position of a scanner in an audit."""
    return F.array_position(F.array(*[F.lit(s) for s in ALL_SCANNERS]), scanner).cast("int")


def scan_order() -> list[Column]:
    """Order of findings in an audit: scanner, file, line, id, then the texts."""
    return [
        scanner_order(F.col("scanner")),
        F.coalesce(F.col("file"), F.lit("")),
        F.coalesce(F.col("line"), F.lit(0)),
        F.col("id"),
        F.coalesce(F.col("message"), F.lit("")),
        F.coalesce(F.col("fix"), F.lit("")),
    ]


# ── score ───────────────────────────────────────────────────────────────────────


def base_penalty(id_: Column, category: Column, severity: Column) -> Column:
    """First matching penalty rule; else by severity."""

    def holds(ids: Sequence[str], prefixes: Sequence[str], categories: Sequence[str]) -> Column:
        tests = [id_.isin(*ids)] if ids else []
        tests += [id_.startswith(p) for p in prefixes]
        tests += [category.isin(*categories)] if categories else []
        return reduce(lambda a, b: a | b, tests)

    rules = texts.PENALTY_RULES
    chain = F.when(holds(*rules[0][:3]), rules[0][3])
    for ids, prefixes, categories, penalty in rules[1:]:
        chain = chain.when(holds(ids, prefixes, categories), penalty)
    return chain.when(severity == "critical", texts.PENALTY_CRITICAL).otherwise(
        texts.PENALTY_WARNING
    )


def finding_penalty() -> Column:
    """Points a finding costs, as an exact decimal so that sums do not depend on order."""
    severity = F.col("severity")
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)).cast("decimal(12,6)")
    scaled = base_penalty(F.col("id"), F.col("category"), severity) * confidence
    return (
        F.when(severity == "passed", F.lit(0))
        .when(severity == "info", F.lit(texts.PENALTY_INFO))
        .otherwise(scaled)
        .cast("decimal(18,6)")
    )


def penalties(findings: DataFrame) -> DataFrame:
    return findings.withColumn("penalty", finding_penalty())


def grade(score: Column) -> Column:
    chain = F.when(score >= texts.GRADES[0][0], texts.GRADES[0][1])
    for bound, name in texts.GRADES[1:-1]:
        chain = chain.when(score >= bound, name)
    return chain.otherwise(texts.GRADES[-1][1])


def grade_meaning(name: Column) -> Column:
    chain = None
    for key, meaning in texts.GRADE_MEANINGS.items():
        if key == "F":
            continue
        test = name == key
        chain = F.when(test, meaning) if chain is None else chain.when(test, meaning)
    return chain.otherwise(texts.GRADE_MEANINGS["F"])


def _count_columns() -> list[Column]:
    severity = F.col("severity")
    return [
        F.count_if(severity == name).alias(name)
        for name in ("critical", "warning", "info", "passed")
    ]


def summarize_findings(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(*_count_columns())


def penalty_sums(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, lost, critical, warning, info, passed): points and counts of the findings of each key."""
    return findings.groupBy(*keys).agg(F.sum(finding_penalty()).alias("lost"), *_count_columns())


def add_sums(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``penalty_sums`` added up by other keys."""
    lost = F.sum("lost").cast("decimal(28,6)").alias("lost")
    return sums.groupBy(*keys).agg(lost, *[F.sum(c).alias(c) for c in ("critical", "warning", "info", "passed")])


def audit_score(findings: DataFrame, repos: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(repo_id, score, grade, meaning, critical, warning, info, passed).

    100 minus the penalties, rounded half up, at least 0.  One shuffle of one partial row
    per repository and task; repositories without findings keep 100.  ``counted`` are sums by repository of
    further findings, which need not be listed for their score.
    """
    sums = penalty_sums(findings, "repo_id")
    if counted is not None:
        sums = add_sums(sums.unionByName(counted), "repo_id")
    return score_sums(sums, repos)


def score_sums(sums: DataFrame, repos: DataFrame) -> DataFrame:
    """Scores of ``audit_score`` from the sums of ``penalty_sums`` by repository."""
    lost = F.coalesce(F.col("lost"), F.lit(0).cast("decimal(28,6)"))
    score = F.greatest(F.lit(0), F.floor(F.lit(100) - lost + F.lit(0.5).cast("decimal(2,1)"))).cast("int")
    return (
        repos.select("repo_id")
        .join(sums, "repo_id", "left")
        .select(
            "repo_id",
            score.alias("score"),
            *[
                F.coalesce(F.col(c), F.lit(0)).alias(c)
                for c in ("critical", "warning", "info", "passed")
            ],
        )
        .withColumn("grade", grade(F.col("score")))
        .withColumn("meaning", grade_meaning(F.col("grade")))
    )


# ── order ───────────────────────────────────────────────────────────────────────


def running_total(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before, without one task per group.

    The rows are range-partitioned on (group, order), so a large group spreads over
    several partitions in order.  Partition sums per group (few rows) give each
    partition its start; inside it a plain window is enough.  The split is
    checkpointed: its partition ids are read twice and must not change if an executor
    is lost.
    """
    split = cut_lineage(
        rows.withColumn("_value", value)
        .repartitionByRange(*group, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        split.groupBy(*group, "_part")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        split.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, [*group, "_part"])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_start", "_inside", "_value", "_part")
    )


def number_in_order(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "number"
) -> DataFrame:
    """1-based running number per group, without one task per group."""
    return running_total(rows, group, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def numbered_findings(findings: DataFrame) -> DataFrame:
    """Critical findings first, then warnings, one running number per repository."""
    ranked = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return number_in_order(
        actionable(findings).withColumn(
            "consequence", finding_consequence()
        ),
        ["repo_id"],
        [ranked, *scan_order()],
    )


def _item(number: Column, title: Column, file: Column, line: Column, fix: Column) -> Column:
    """One numbered entry of a fix list."""
    at = F.concat(file, F.coalesce(F.concat(F.lit(":"), F.nullif(line, F.lit(0)).cast("string")), F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(number.cast("string"), F.lit(". "), title),
        F.when(file != "", F.concat(F.lit("   Where: "), at)),
        F.when(fix != "", F.concat(F.lit("   Suggested direction: "), fix)),
        F.lit(""),
    )


def _list_order() -> list[Column]:
    """Order of a fix list: that of the audit, and what is shown of findings equal in it."""
    return [*scan_order(), *(F.col(c) for c in ("title", "file", "line", "fix"))]


def _lists(findings: DataFrame) -> DataFrame:
    """Findings with their number, of repositories that one task sorts (it spills): a single exchange."""
    return findings.withColumn("number", F.row_number().over(W.partitionBy("repo_id").orderBy(*_list_order())).cast("bigint"))


def _long_lists(findings: DataFrame) -> DataFrame:
    """Findings with their number, of repositories with more than a task should sort: over a range split."""
    return number_in_order(findings, ["repo_id"], _list_order())


def _bodies(numbered: DataFrame, items_per_part: int) -> DataFrame:
    """(repo_id, part, body): the entries of each part, put together where the numbers are if a task holds all of them."""
    item = _item(*(F.col(c) for c in ("number", "title", "file", "line", "fix")))
    return (
        numbered.select(
            "repo_id",
            F.floor((F.col("number") - 1) / items_per_part).cast("int").alias("part"),
            F.struct("number", item.alias("text")).alias("item"),
        )
        .groupBy("repo_id", "part")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select(
            "repo_id",
            "part",
            F.array_join(F.transform("items", lambda i: i["text"]), "\n").alias("body"),
        )
    )


def fix_prompt(
    findings: DataFrame, repos: DataFrame, items_per_part: int = PROMPT_ITEMS_PER_PART, sums: DataFrame | None = None
) -> DataFrame:
    """(repo_id, part, parts, text): the numbered fix list of each repository.

    One string cannot hold the list of a repository with millions of findings, so a list
    is cut into parts of ``items_per_part`` entries.  Joined with line breaks in part
    order, the parts are the whole prompt; almost every repository has exactly one.
    Findings are counted first: a list of up to ``LIST_ITEMS`` entries is sorted by one task, after a single
    exchange of the columns it shows; only longer ones are split by range.  ``sums``, those of ``penalty_sums`` by repository,
    have the counts already.
    """
    shown = actionable(findings).select("repo_id", "scanner", "id", "title", "message", "file", "line", "fix")
    counted = (
        shown.groupBy("repo_id").agg(F.count("*").alias("n")) if sums is None
        else sums.select("repo_id", (F.col("critical") + F.col("warning")).alias("n")).where("n > 0")
    )
    # Findings of repositories that are not asked for would be numbered in vain.
    sizes = cut_lineage(
        counted.select("repo_id", F.ceil(F.col("n") / items_per_part).cast("int").alias("parts"), (F.col("n") > LIST_ITEMS).alias("long"))
        .join(repos.select("repo_id"), "repo_id", "left_semi")
    )
    some, many = sizes.where(~F.col("long")), sizes.where("long")
    sizes = sizes.drop("long")
    # The findings are the left side, which the adaptive skew join can split.
    bodies = _bodies(_lists(shown.join(some.select("repo_id"), "repo_id", "left_semi")), items_per_part)
    if not many.isEmpty():
        longer = shown.join(many.select("repo_id"), "repo_id", "left_semi")
        bodies = bodies.unionByName(_bodies(_long_lists(longer), items_per_part))
    head = F.lit("\n".join(texts.PROMPT_HEAD))
    full = bodies.join(sizes, "repo_id").select(
        "repo_id",
        "part",
        "parts",
        F.concat_ws(
            "\n",
            F.when(F.col("part") == 0, head),
            F.col("body"),
            F.when(F.col("part") == F.col("parts") - 1, F.lit(texts.PROMPT_TAIL)),
        ).alias("text"),
    )
    clean = repos.select("repo_id").join(sizes, "repo_id", "left_anti")
    return full.unionByName(
        clean.select("repo_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(texts.PROMPT_CLEAN).alias("text"))
    )


def top_findings(findings: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` findings of each repository and scanner, and how many stay hidden.

    The cut-off rank is applied map-side (window group limit); the totals are a separate
    partial count, because a count over the same window would need whole groups.
    """
    order = W.partitionBy("repo_id", "scanner").orderBy(*scan_order())
    top = findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    totals = findings.groupBy("repo_id", "scanner").agg(F.count("*").alias("total"))
    return top.join(totals, ["repo_id", "scanner"]).withColumn(
        "hidden", F.greatest(F.col("total") - k, F.lit(0))
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Actionable findings, first in scan order per (repo_id, file, line, id)."""
    key = W.partitionBy(
        "repo_id",
        F.coalesce(F.col("file"), F.lit("")),
        F.coalesce(F.col("line").cast("string"), F.lit("")),
        "id",
    ).orderBy(*scan_order())
    return (
        actionable(findings)
        .withColumn("_first", F.row_number().over(key))
        .where(F.col("_first") == 1)
        .drop("_first")
    )


def redacted_counts(findings: DataFrame) -> DataFrame:
    """Counts per severity and scanner without places or texts; passed is no issue."""
    severity = F.col("severity")
    return (
        findings.where(severity != "passed")
        .groupBy("repo_id", "scanner")
        .agg(
            F.count("*").alias("issues"),
            F.count_if(severity == "critical").alias("critical"),
            F.count_if(severity == "warning").alias("warning"),
            F.count_if(severity == "info").alias("info"),
        )
    )


def union_scans(scans: Sequence[DataFrame]) -> DataFrame:
    """Multiset union of scanner results in the finding schema."""
    return reduce(lambda a, b: a.unionByName(b), scans)


def first_per_rule(hits: DataFrame) -> DataFrame:
    """Smallest line per (repo_id, path, rule) of hits that were already vetted."""
    rest = [c for c in hits.columns if c not in ("repo_id", "path", "rule", "line")]
    return hits.groupBy("repo_id", "path", "rule").agg(
        F.min("line").alias("line"),
        *[F.min_by(c, "line").alias(c) for c in rest],
    )


# ── texts ───────────────────────────────────────────────────────────────────────


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def finding_consequence() -> Column:
    """Plain consequence: by finding id, else category, else scanner, else the title."""
    return F.coalesce(
        _lookup(texts.ID_CONSEQUENCES, F.col("id")),
        _lookup(texts.CATEGORY_CONSEQUENCES, F.col("category")),
        _lookup(texts.SCANNER_CONSEQUENCES, F.col("scanner")),
        F.col("title"),
    )


def passed_checks(
    findings: DataFrame, repos: DataFrame, scanners: Sequence[str] = AUDIT_SCANNERS
) -> DataFrame:
    """(repo_id, scanner, label) of scanners that ran and raised nothing actionable.

    The failing scanners of a repository are a set of at most 14 names, so a partial
    aggregate and an array difference replace an anti join over repositories x scanners.
    """
    labelled = [s for s in scanners if s in texts.PASSED_LABELS]
    raised = (
        actionable(findings)
        .groupBy("repo_id")
        .agg(F.collect_set("scanner").alias("raised"))
    )
    empty = F.array().cast("array<string>")
    return (
        repos.select("repo_id")
        .join(raised, "repo_id", "left")
        .select(
            "repo_id",
            F.explode(
                F.array_except(
                    F.array(*[F.lit(s) for s in labelled]), F.coalesce("raised", empty)
                )
            ).alias("scanner"),
        )
        .withColumn("label", _lookup(texts.PASSED_LABELS, F.col("scanner")))
    )
