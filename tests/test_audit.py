"""Whole audits of small projects: prose must stay silent, live code must be reported."""

import pytest
from pyspark.sql import functions as F

from palisade.model import FINDING_SCHEMA
from palisade.operators import findings as fo
from palisade.operators import packages, repository
from palisade.plans import scanners as plans

# Put together at run time, so that no contiguous key is stored in this repository.
KEY = "sk_" + "live_" + "9fQ2mZ7pLx4VbT1nRk8WcYd3"

QUIET = {
    ".gitignore": "node_modules/\n.env*\n",
    "app/features.tsx": "\n".join(
        [
            "const cards = [",
            "  { desc: \"We notice cors({ origin: '*' }) before you ship\" },",
            f"  {{ desc: 'A leaked key such as {KEY} is reported' }},",
            "  { desc: 'Every /api/webhook of Stripe needs a signature' },",
            '  { text: "db.query(`SELECT ${x}`) style strings" },',
            "  { example: 'NEXT_PUBLIC_SERVICE_ROLE shows up in the bundle' },",
            "];",
            "const seo = <script type=\"application/ld+json\"",
            "  dangerouslySetInnerHTML={{ __html: JSON.stringify(data) }} />;",
            "export default () => <h1>rejectUnauthorized: false is a bad idea</h1>;",
        ]
    ),
    "docs/security.md": f"db.query(`SELECT ${{id}}`)\nkey = '{KEY}'\n",
    "lib/tls.ts": "// rejectUnauthorized: false would be wrong\nconst a = { rejectUnauthorized: true };",
    "tests/login.test.ts": f"const key = '{KEY}';\nusers.insert(req.body);",
}

OPEN = {
    "api/pay.ts": "\n".join(
        [
            "const router = express.Router();",
            f"const secret = '{KEY}';",
            "router.use(cors({ origin: '*' }));",
            "router.post('/api/charge', async (req, res) => {",
            "  const row = await db.query(`SELECT * FROM orders WHERE id = ${req.query.id}`);",
            "});",
        ]
    ),
    "api/hook.ts": "\n".join(
        [
            "const router = express.Router();",
            "router.post('/api/webhook', (req) => {",
            "  if (req.body.type === 'invoice.paid') unlock(); // stripe",
            "});",
        ]
    ),
    "api/proxy.ts": "\n".join(
        [
            "const page = await fetch(req.query.target);",
            "const file = await readFile(req.query.name);",
            "const t = jwt.sign({ id }, 'correct-horse-battery');",
            "const agent = new https.Agent({ rejectUnauthorized: false });",
        ]
    ),
}


@pytest.fixture(scope="module")
def audited(spark, make_files):
    files = make_files(QUIET, OPEN)
    tracked = spark.createDataFrame([(0, "a"), (1, "b")], "repo_id bigint, path string")
    commits = spark.createDataFrame(
        [],
        "repo_id bigint, commit string, ts timestamp, path string, op string, line string",
    )
    advisories = spark.createDataFrame([], packages.ADVISORY_SCHEMA)
    found = plans.all_findings(files, tracked, commits, advisories)
    return files, found.collect(), found


def ids(rows, repo, severity=None):
    return {r.id for r in rows if r.repo_id == repo and severity in (None, r.severity)}


def test_prose_raises_nothing(audited):
    _, rows, _ = audited
    assert ids(rows, 0, "critical") == set()
    assert ids(rows, 0, "warning") == set()
    assert not any(i.startswith(("webhook-", "secret-", "cors-")) for i in ids(rows, 0))


def test_json_ld_sink_is_information(audited):
    _, rows, _ = audited
    sinks = [r for r in rows if r.id == "injection-xss-dangerously-set"]
    assert [r.severity for r in sinks] == ["info"]


def test_live_code_is_critical(audited):
    _, rows, _ = audited
    expected = {
        "secret-stripe-sk-live",
        "cors-wildcard-origin",
        "injection-sql-template-literal",
        "injection-ssrf-user-url",
        "injection-path-traversal-user-input",
        "webhook-unverified-stripe",
        "webhook-missing-failure-handler",
        "auth-jwt-hardcoded-secret",
        "auth-tls-reject-unauthorized-false",
        "rate-limit-missing-payment",
    }
    assert expected <= ids(rows, 1, "critical")


def test_grades(audited):
    files, _, found = audited
    report = plans.audit_report(found, repository.repositories(files))
    rows = {r.repo_id: r for r in report.collect()}
    assert rows[0].score >= 80 and rows[0].grade in ("A+", "A", "B+", "B")
    assert rows[1].score < 60 and rows[1].grade == "F" and rows[1].critical > 0
    assert rows[0].fix_prompt.startswith("No fixes needed")
    assert "1. " in rows[1].fix_prompt and "   Where: api/" in rows[1].fix_prompt


def test_places_and_texts(audited):
    _, rows, _ = audited
    hit = next(r for r in rows if r.id == "injection-sql-template-literal")
    assert (hit.file, hit.line, hit.confidence) == ("api/pay.ts", 5, 1.0)
    assert hit.message == "SQL Injection via Template Literal detected in api/pay.ts:5"
    assert hit.cwe == "CWE-89" and hit.fix
    assert not any("%" + t in (r.message or "") for r in rows for t in ("X%", "FILE%", "LINE%", "AT%"))


def test_repository_without_findings_scores_100(spark):
    none = spark.createDataFrame([], FINDING_SCHEMA)
    repos = spark.range(2).withColumnRenamed("id", "repo_id")
    rows = fo.audit_score(none, repos).collect()
    assert {(r.score, r.grade) for r in rows} == {(100, "A+")}


def test_webhook_exec_is_reported_per_provider(make_files):
    files = make_files({"api/hooks.ts": "exec(cmd);\n// eval(webhook)\neval(y);"})
    rows = plans.scan_files(files, "scan_webhooks").where(F.col("id") == "webhook-command-injection").collect()
    assert sorted(r.line for r in rows) == [1] * 5 + [3] * 5


def test_env_file_globs(spark, make_files):
    files = make_files(
        {".gitignore": "node_modules/\n.env*\n", ".env.local": "A=1"},
        {".gitignore": "node_modules/\n", ".env.local": "A=1"},
    )
    tracked = spark.createDataFrame([], "repo_id bigint, path string")
    rows = repository.env_ignore_gaps(files, tracked).collect()
    assert [(r.repo_id, r.id) for r in rows] == [(1, "env-not-gitignored-.env.local")]


def test_report_does_not_write_findings_of_advisories(spark):
    """There are as many as manifests x advisories; sums and lists are the same as if all were written."""
    from pathlib import Path

    from palisade.session import shared_folder

    rows = [
        (repo, scanner, f"{scanner}-{i}", severity, "T", f"m{i}", "package.json", i, "fix")
        for repo in (1, 2, 3, None)
        for scanner in ("scan_secrets", "scan_dependencies", "scan_rules_files", None)
        for i, severity in enumerate(("critical", "warning", "info", "passed", None))
        if (repo, scanner) != (3, "scan_dependencies")
    ]
    some = spark.createDataFrame(
        rows, "repo_id bigint, scanner string, id string, severity string, title string, message string, file string, line int, fix string"
    )
    found = repository.as_findings(some, "x").withColumn("scanner", F.lit(None).cast("string")).limit(0).unionByName(
        some, allowMissingColumns=True
    )
    repos = spark.range(1, 5).select(F.col("id").alias("repo_id"))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    report = {r.repo_id: r for r in plans.audit_report(found, repos).collect()}
    new = [spark.read.parquet(str(f)) for f in set(folder.glob("table-*")) - before]
    assert [t.where("scanner = 'scan_dependencies'").count() for t in new if "scanner" in t.columns] == [0]
    assert sum(t.count() for t in new if "scanner" in t.columns) == sum(r[1] != "scan_dependencies" for r in rows)
    scores = {r.repo_id: r for r in fo.audit_score(found, repos).collect()}
    prompts = {r.repo_id: r for r in fo.fix_prompt(found, repos).collect()}
    assert set(report) == {1, 2, 3, 4} and report[1].critical == 4 and report[3].critical == 3
    for repo, row in report.items():
        assert row.fix_prompt == prompts[repo].text and row.parts == prompts[repo].parts
        assert all(row[c] == scores[repo][c] for c in ("score", "grade", "critical", "warning", "info", "passed"))
