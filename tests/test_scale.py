"""Behaviour on oversized repositories and plan shapes that have to hold at scale."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palisade.model import COMMIT_LINE_SCHEMA
from palisade.operators import findings as fo
from palisade.operators import packages
from palisade.plans import scanners as plans
from palisade.sources import files as src


@pytest.fixture(scope="module")
def skewed(spark):
    """Findings of which one repository holds a third."""
    n = F.col("id")
    return (
        spark.range(30000)
        .select(
            F.when(n % 3 == 0, 1).otherwise(n % 97 + 2).cast("bigint").alias("repo_id"),
            F.lit("check_cors").alias("scanner"),
            F.concat(F.lit("cors-"), (n % 5).cast("string")).alias("id"),
            F.when(n % 4 == 0, "critical").otherwise("warning").alias("severity"),
            F.lit("cors").alias("category"),
            F.lit("T").alias("title"),
            n.cast("string").alias("message"),
            F.concat(F.lit("f"), (n % 1000).cast("string")).alias("file"),
            (n % 7).cast("int").alias("line"),
            F.lit("F").alias("fix"),
            F.lit(None).cast("double").alias("confidence"),
        )
    )


def test_running_numbers_equal_a_plain_window(skewed):
    order = fo.scan_order()
    got = fo.number_in_order(skewed, ["repo_id"], order)
    plain = skewed.withColumn(
        "number", F.row_number().over(W.partitionBy("repo_id").orderBy(*order)).cast("bigint")
    )
    columns = ["repo_id", "message", "number"]
    assert got.select(columns).exceptAll(plain.select(columns)).count() == 0
    assert got.count() == 30000


def test_prompt_parts_are_bounded_and_whole(skewed):
    repos = skewed.select("repo_id").distinct()
    parts = fo.fix_prompt(skewed, repos, items_per_part=500).where("repo_id = 1").orderBy("part")
    rows = parts.collect()
    assert len(rows) == 20 and all(r.parts == 20 for r in rows)
    text = "\n".join(r.text for r in rows)
    assert text.count("   Where: ") == 10000
    assert "\n10000. T\n" in text and text.startswith("I ran") and text.rstrip().endswith("safer.")


def test_a_list_of_several_parts_needs_no_range_split(skewed, monkeypatch):
    """Only lists longer than one task should sort are numbered over a range split; both ways give the same."""
    repos = skewed.select("repo_id").distinct()

    def prompts():
        return sorted(tuple(r) for r in fo.fix_prompt(skewed, repos, items_per_part=300).collect())

    monkeypatch.setattr(fo, "LIST_ITEMS", 5000, raising=False)
    split = prompts()
    monkeypatch.setattr(fo, "LIST_ITEMS", 100_000, raising=False)
    monkeypatch.setattr(fo, "number_in_order", None)
    assert prompts() == split


def test_ranks_are_cut_before_the_shuffle(skewed):
    for df in (fo.top_findings(skewed), fo.dedup_findings(skewed)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_scan_is_narrow_and_single(spark, make_files, tmp_path):
    make_files({"a.ts": "eval(req.body.x)"}).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    plan = plan_of(plans.code_hits(files))
    assert "Exchange" not in plan
    assert plan.count("FileScan") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_cross_joins_without_broadcast(spark, make_files, tmp_path):
    """With automatic broadcasts off, only the fixed rule tables are broadcast."""
    make_files({"package.json": '{"dependencies": {"a": "1"}}'}).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        advisories = spark.createDataFrame([], packages.ADVISORY_SCHEMA)
        vulnerable = packages.vulnerable_dependencies(files, src.parse_manifests(files), advisories)
        for df in (vulnerable, src.filter_ignored(files.select("repo_id", "path"), files)):
            plan = plan_of(df)
            assert "Broadcast" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_advisory_intervals(spark):
    """Each introduced event lasts to the next fixed one, in version order; what is no version is in no range."""
    versions = ("1.0.0", "1.2.0", "1.9.5", "1.10.0", "2.1.0", "2.3.0", "workspace:*", "github:u/r", "file:../p", "0.1")
    manifests = spark.createDataFrame(
        [(i, True, "{}", {"p": v}) for i, v in enumerate(versions)],
        "repo_id bigint, valid boolean, raw string, dependencies map<string,string>",
    )
    two = [(None, "2.3.0"), ("0", None), (None, "1.2.0"), ("2.0.0", None)]
    ten = [("1.9.0", None), (None, "1.10.0")]
    advisories = spark.createDataFrame(
        [("A", "p", None, [], [([(two,)],)]), ("B", "p", None, [], [([(ten,)],)]), ("C", "p", None, [], [([([(None, "0.2")],)],)])],
        packages.ADVISORY_SCHEMA,
    )
    rows = packages.vulnerable_dependencies(manifests.select("repo_id"), manifests, advisories).collect()
    found = sorted((r.id[-1], versions[r.repo_id]) for r in rows)
    assert found == [("A", "0.1"), ("A", "1.0.0"), ("A", "2.1.0"), ("B", "1.9.5"), ("C", "0.1")]


def test_an_audit_reads_contents_once(spark, make_files, tmp_path):
    make_files({"a.ts": "eval(req.body.x)", "package.json": "{}", ".gitignore": ".env"}).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    lines = spark.createDataFrame([], COMMIT_LINE_SCHEMA)
    tracked = spark.createDataFrame([(0, "a.ts")], "repo_id bigint, path string")
    advisories = spark.createDataFrame([], packages.ADVISORY_SCHEMA)
    found = plans.all_findings(files, tracked, lines, advisories)
    assert str(tmp_path / "files") not in plan_of(found)  # only the written survey is left to read
    assert found.count() > 0
    hits, _ = plans.survey(files)
    assert [r.rule for r in hits.collect()] == ["injection-command-injection-eval"]


def test_popular_package_is_spread(spark):
    """A package in every manifest: results equal a plain join."""
    manifests = spark.range(3000).select(
        F.col("id").alias("repo_id"),
        F.lit(True).alias("valid"),
        F.lit("{}").alias("raw"),
        F.create_map(F.lit("hot"), F.lit("1.5.0")).alias("dependencies"),
    )
    advisories = spark.createDataFrame(
        [("A", "hot", None, [("CVSS", "9.8")], [([([("1.0.0", None), (None, "2.0.0")],)],)]),
         ("B", "hot", None, [], [([([("2.0.0", None)],)],)])],
        packages.ADVISORY_SCHEMA,
    )
    rows = packages.vulnerable_dependencies(
        manifests.select("repo_id"), manifests, advisories
    ).groupBy("id", "severity", "fix").count().collect()
    assert [tuple(r) for r in rows] == [
        ("dep-A", "critical", "Upgrade hot to 2.0.0: npm install hot@2.0.0", 3000)
    ]


def hot_version(spark, manifests: int, advisories: int):
    """Manifests that all have one version, and advisories that all hold it (and one that does not)."""
    having = spark.range(manifests).select(
        F.col("id").alias("repo_id"),
        F.lit(True).alias("valid"),
        F.lit("{}").alias("raw"),
        F.create_map(F.lit("hot"), F.lit("1.5.0")).alias("dependencies"),
    )
    scores = (["9.8"], ["5.0"], ["2.1"], [])
    listed = [
        (f"A{i}", "hot", None, [("CVSS", x) for x in scores[i % 4]], [([([("1.0.0", None), (None, "2.0.0")],)],)])
        for i in range(advisories)
    ]
    listed.append(("B", "hot", None, [], [([([("2.0.0", None)],)],)]))
    return having, spark.createDataFrame(listed, packages.ADVISORY_SCHEMA)


def test_many_advisories_of_a_popular_version_are_spread(spark, monkeypatch):
    """A product of manifests and advisories of one version is dealt to many tasks, each pair once."""
    monkeypatch.setattr(packages, "CELL", 64, raising=False)
    manifests, advisories = hot_version(spark, 400, 400)
    rows = packages.vulnerable_dependencies(manifests.select("repo_id"), manifests, advisories).where("id like 'dep-%'")
    assert rows.count() == 160_000 and rows.select("repo_id", "id").distinct().count() == 160_000
    tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 40_000


def test_scores_count_advisories_once_per_version(spark, make_files, monkeypatch):
    """Scores equal those of the listed findings, without a list of them by repository."""
    manifest = '{"dependencies": {"hot": "%s"}}'
    files = make_files(
        *({"package.json": manifest % ("1.5.0" if i % 3 else "3.0.0"), ".gitignore": ".env*\nnode_modules"} for i in range(9)),
        {"a.ts": "eval(req.body.x)"}, {"package.json": manifest % "workspace:*"},
    )
    advisories = hot_version(spark, 1, 7)[1]
    tracked = spark.createDataFrame([(i, "a") for i in range(11)], "repo_id bigint, path string")
    tables = (files, tracked, spark.createDataFrame([], COMMIT_LINE_SCHEMA), advisories)
    repos = files.select("repo_id").distinct()
    listed = {r.repo_id: r for r in fo.audit_score(plans.all_findings(*tables), repos).collect()}

    def never(*_):
        raise AssertionError("findings of advisories were listed")

    monkeypatch.setattr(packages, "deal_out", never, raising=False)
    assert {r.repo_id: r for r in plans.audit_scores(*tables, repos).collect()} == listed
    assert 0 < listed[1].critical + listed[1].warning < listed[1].critical + listed[1].warning + listed[1].info


def test_one_line_file_of_a_megabyte(make_files):
    """Minified code: one line, many hits, still one finding per rule."""
    body = "x=1;" * 100_000 + "eval(req.body.a);" * 2000 + "y='eval(req.body.b)';"
    rows = plans.scan_files(make_files({"min.js": body}), "scan_injection").collect()
    assert [(r.id, r.line) for r in rows] == [("injection-command-injection-eval", 1)]


def test_free_tier_limits(spark, make_files):
    names = ", ".join(f'"p{i}": "1.0.0"' for i in range(22))
    files = make_files({"package.json": '{"dependencies": {%s, "crossenv": "1.0.0"}}' % names})
    manifests = src.parse_manifests(files)
    free = {r.id for r in packages.supply_chain(files, manifests, free_tier=True).collect()}
    full = {r.id for r in packages.supply_chain(files, manifests).collect()}
    assert free == {"supply-chain-limit"}
    assert full == {"supply-chain-malicious-crossenv"}
