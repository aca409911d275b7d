"""Registered queries: each operator over the given tables or data derived from them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived
from palisade.functions import classify, ignore, lexing, paths, values
from palisade.operators import (
    app_security,
    auth_config,
    code_rules,
    data_access,
    findings as fo,
    headers,
    packages,
    repository,
    rules_files,
    webhooks,
)
from palisade.operators.file_scan import scan
from palisade.plans import scanners as plans
from palisade.rules import loading
from palisade.rules.catalogue import attach_texts
from palisade.rules.secret_rules import SECRET_RULES, TOKEN_VALUE
from palisade.session import shared_folder
from palisade.sources import files as src
from palisade.sources.sinks import read_findings, write_findings
from palisade.streaming import changes as ch

Query = Callable[[SparkSession, str], DataFrame]
FINDING = ("repo_id", "id", "severity", "file", "line", "confidence")
REGISTRY: dict[str, Query] = {}
STORED: dict[tuple[str, str], str] = {}


def query(function: Callable[["Tables"], DataFrame]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Tables(spark, sf_dir))

    run.__name__ = function.__name__
    REGISTRY[function.__name__] = run
    return function


class Tables:
    """The given tables and the derived ones, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """More tasks for CPU-bound work on an input of few splits (the test tables are a
        single row group); inputs with enough splits are not shuffled."""
        tasks = 2 * self.spark.sparkContext.defaultParallelism
        return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def files(self) -> DataFrame:
        """The derived files as a stored table: written once per session and data set."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in STORED:
            folder = work_folder(self, "files")
            numbered = derived.files_sql().replace("SELECT ", "SELECT doc_id, ", 1)
            table = self.sql(numbered, documents=self.table("documents"))
            self.spread(table).write.mode("overwrite").parquet(folder)
            STORED[key] = folder
        return self.spark.read.parquet(STORED[key]).drop("doc_id")

    def tracked(self) -> DataFrame:
        return self.sql(derived.TRACKED_SQL, files=self.files())

    def commit_lines(self) -> DataFrame:
        return self.sql(derived.COMMIT_LINES_SQL, orders=self.table("orders"))

    def responses(self) -> DataFrame:
        return self.sql(derived.responses_sql(True), pages=self.table("pages"))

    def advisories(self) -> DataFrame:
        return self.spread(self.sql(derived.advisories_sql(True), part=self.table("part")))

    def manifests(self) -> DataFrame:
        return src.parse_manifests(self.files())

    def changes(self) -> DataFrame:
        self.files()
        numbered = self.spark.read.parquet(
            STORED[(self.spark.sparkContext.applicationId, self.sf_dir)]
        )
        return self.sql(derived.CHANGES_SQL, numbered_files=numbered, events=self.table("events"))

    def findings(self) -> DataFrame:
        return self.sql(derived.findings_sql(), events=self.table("events"))

    def finding_repos(self) -> DataFrame:
        return self.table("events").select(F.expr(derived.EVENT_REPO).alias("repo_id")).distinct()

    def walked(self, detector) -> DataFrame:
        """Findings of one detector over walked files."""
        return attach_texts(plans.walked_hits(self.files(), [detector])).select(*FINDING)


def brief(findings: DataFrame) -> DataFrame:
    return findings.select(*FINDING)


# ── sources and selection ───────────────────────────────────────────────────────


@query
def read_files(t: Tables) -> DataFrame:
    # In pieces: a file of a large table need not fit in a task, nor in a row.
    files = src.read_files(t.spark, t.sf_dir, repo_pattern=r"()([^/]*)$", piece_bytes=1 << 22)
    is_text = F.coalesce(F.bool_and(src.is_readable(F.col("content"))), F.lit(False))
    return files.groupBy("file", "path", "size").agg(is_text.alias("is_text")).drop("file")


@query
def filter_extension(t: Tables) -> DataFrame:
    return src.filter_extension(t.files()).select("repo_id", "path")


@query
def filter_skip_dirs(t: Tables) -> DataFrame:
    # Page addresses as paths, each once below a skipped and once below a plain folder.
    pages = t.table("pages").select(
        F.col("page_id"),
        F.explode(
            F.array(
                F.concat(F.lit("a/"), F.col("url")),
                F.concat(F.lit(".cache/"), F.col("url")),
                F.concat(F.lit("x/node_modules/"), F.col("url")),
                F.concat(F.lit(".env/"), F.col("url")),
            )
        ).alias("path"),
    )
    return src.filter_skip_dirs(pages)


@query
def filter_ignored(t: Tables) -> DataFrame:
    files = t.files()
    return src.filter_ignored(files.select("repo_id", "path"), files)


@query
def filter_readable(t: Tables) -> DataFrame:
    # A NUL in place of every space of a third of the texts, and at the end of another third.
    nul, text = F.chr(F.lit(0)), F.col("text")
    docs = t.table("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit(" "), nul))
        .when(F.col("doc_id") % 3 == 1, F.concat(text, nul))
        .otherwise(text)
        .alias("content"),
    )
    return src.filter_readable(docs).select("doc_id")


OWN_RULES = (
    ("warm", "Warm word", r"\b(hot|with)\b", "info"),
    ("pair", "Word pair", r"\bthe\s+of\b", "warning"),
    ("broken", "Broken pattern", "(unclosed", "critical"),
    ("long-word", "Long word", r"\b[a-z]{14,}\b", "critical"),
)


@query
def load_rules(t: Tables) -> DataFrame:
    """Rules from a JSON list, one of them with a broken pattern, over the documents."""
    folder = work_folder(t, "rules")
    names = "id string, name string, pattern string, severity string"
    listed = t.spark.createDataFrame(OWN_RULES, names).agg(F.to_json(F.collect_list(F.struct("*"))))
    listed.write.text(folder)
    rules, _ = loading.load_rules(t.spark, folder)
    return loading.match_rules(t.table("documents").select("doc_id", "text"), rules, "text")


@query
def parse_manifest(t: Tables) -> DataFrame:
    return t.manifests().select(
        "repo_id",
        "valid",
        F.size("dependencies").alias("n_dependencies"),
        F.size("devDependencies").alias("n_dev"),
        F.try_element_at("dependencies", F.lit("a4")).alias("a4"),
    )


@query
def select_rules_files(t: Tables) -> DataFrame:
    return src.select_rules_files(t.files()).select("repo_id", "path")


@query
def resolve_firebase_rules(t: Tables) -> DataFrame:
    return src.resolve_firebase_rules(t.files())


@query
def explode_lines(t: Tables) -> DataFrame:
    return src.explode_lines(t.table("documents").select("doc_id", "text"), "text")


def work_folder(t: Tables, name: str) -> str:
    """New folder beside the checkpoints, which every executor can reach."""
    return f"{shared_folder(t.spark)}/{name}-{os.urandom(6).hex()}"


@query
def write_findings_by_scanner(t: Tables) -> DataFrame:
    folder = work_folder(t, "findings")
    write_findings(t.findings(), folder)
    return read_findings(t.spark, folder).select("repo_id", "scanner", "id", "message")


# ── context functions ───────────────────────────────────────────────────────────


@query
def is_doc_file(t: Tables) -> DataFrame:
    path = F.col("path")
    return t.files().select("repo_id", "path", paths.is_doc_file(path).alias("is_doc"))


@query
def is_test_or_example(t: Tables) -> DataFrame:
    path = F.col("path")
    return t.files().select(
        "repo_id",
        "path",
        paths.is_test_or_example(path).alias("is_test"),
        paths.is_app_test_file(path).alias("is_app_test"),
    )


@query
def is_placeholder(t: Tables) -> DataFrame:
    return t.table("conversations").select(
        "conv_id", "turn", values.is_placeholder(F.col("text")).alias("placeholder")
    )


@query
def shannon_entropy(t: Tables) -> DataFrame:
    return t.spread(t.table("documents")).select(
        "doc_id", F.round(values.shannon_entropy(F.col("text")), 6).alias("entropy")
    )


@query
def secret_random_part(t: Tables) -> DataFrame:
    token = F.concat(
        F.element_at(
            F.array(*[F.lit(p) for p in ("sk_live_", "a-", "key_test_", "", "AB_")]),
            (F.col("doc_id") % 5 + 1).cast("int"),
        ),
        F.substring(F.md5(F.col("text")), F.lit(1), (F.col("doc_id") % 20 + 1).cast("int")),
    )
    return t.table("documents").select("doc_id", token.alias("token")).select(
        "doc_id",
        "token",
        values.secret_random_part(F.col("token")).alias("random_part"),
        values.looks_fake(F.col("token")).alias("fake"),
    )


@query
def lex_state(t: Tables) -> DataFrame:
    """State at places all over every derived file, and at its last character."""
    content = F.col("content")
    size = F.length(content)
    offsets = F.array(*(F.floor(size * k / 10) for k in derived.TENTHS), (size - 1).cast("bigint"))
    return (
        t.files()
        .where(content != "")
        .select("repo_id", "path", "content", F.explode(offsets).alias("pos"))
        .select(
            "repo_id", "path", "pos",
            lexing.lex_state(content, F.col("pos").cast("int")).alias("state"),
        )
    )


@query
def line_start_states(t: Tables) -> DataFrame:
    """State at the start of every line, by the one-pass method the scan uses."""
    states = lexing.line_start_states(F.col("content"))
    return t.files().select("repo_id", "path", F.posexplode(states).alias("i", "state"))


@query
def match_offset(t: Tables) -> DataFrame:
    """Offset of the third column of every line."""
    starts = lexing.line_starts(lexing.lines_of(F.col("text")))
    # Every row carries its own start, not the lines of its text.
    lines = t.table("documents").select("doc_id", F.posexplode(starts).alias("i", "start"))
    at = lexing.match_offset(F.array("start"), F.lit(0), F.lit(3))
    return lines.select("doc_id", F.col("i").cast("bigint").alias("i"), at.alias("pos"))


def _quoted_lines(t: Tables) -> DataFrame:
    """Lines of the derived files with the text before and after their middle."""
    lines = src.explode_lines(t.files())
    return lines.withColumn(
        "before", F.substring(F.col("line"), F.lit(1), F.floor(F.length("line") / 2).cast("int"))
    )


@query
def display_key_before(t: Tables) -> DataFrame:
    before = F.regexp_extract("line", r"^([^\"']*)[\"']", 1)
    return src.explode_lines(t.files()).select(
        "repo_id", "path", "i", values.display_key_before(before).alias("display")
    )


@query
def looks_like_prose(t: Tables) -> DataFrame:
    return src.explode_lines(t.files()).select(
        "repo_id", "path", "i", values.looks_like_prose(F.col("line")).alias("prose")
    )


@query
def enclosing_string(t: Tables) -> DataFrame:
    enclosed = lexing.enclosing_string(F.col("line"), F.col("before"))
    return (
        _quoted_lines(t)
        .select("repo_id", "path", "i", enclosed.alias("e"))
        .select("repo_id", "path", "i", "e.open_column", "e.value")
    )


@query
def is_jsx_text(t: Tables) -> DataFrame:
    return _quoted_lines(t).select(
        "repo_id", "path", "i",
        lexing.is_jsx_text(paths.extension(F.col("path")), F.col("line"), F.col("before")).alias("jsx"),
    )


def _classified(t: Tables, mode: str) -> DataFrame:
    """Every line classified at its middle; the match is the next eight characters."""
    path = F.col("path")
    staged = (
        t.files()
        .withColumn("states", lexing.line_start_states(F.col("content")))
        .withColumn("texts", lexing.lines_of(F.col("content")))
        .select("repo_id", "path", F.posexplode(F.arrays_zip("texts", "states")).alias("i", "z"))
        .select("repo_id", "path", "i", F.col("z.texts").alias("line"), F.col("z.states").alias("start"))
        .withColumn("before", F.substring("line", F.lit(1), F.floor(F.length("line") / 2).cast("int")))
        .withColumn("match", F.substring("line", F.length("before") + 1, F.lit(8)))
        .withColumn("state", lexing.state_in_line(F.col("start"), F.col("before"), F.col("line")))
    )
    c = classify.classify_match(
        is_doc=paths.is_doc_file(path),
        is_test=paths.is_test_or_example(path),
        extension=paths.extension(path),
        line=F.col("line"),
        before=F.col("before"),
        match=F.col("match"),
        state=F.col("state"),
        mode=mode,
    )
    return staged.select("repo_id", "path", "i", c.alias("c")).select(
        "repo_id", "path", "i", "c.kind", "c.is_prose", "c.is_likely_example", "c.confidence"
    )


@query
def classify_match(t: Tables) -> DataFrame:
    return _classified(t, classify.CODE)


@query
def classify_secret_match(t: Tables) -> DataFrame:
    return _classified(t, classify.SECRET)


@query
def calibrate(t: Tables) -> DataFrame:
    confidence = (F.col("event_id") % 101) / 100.0
    severity = F.element_at(
        F.array(*[F.lit(s) for s in ("critical", "warning", "info", "passed")]),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    return (
        t.table("events")
        .select("event_id", confidence.alias("c"), severity.alias("s"))
        .where(classify.emits(F.col("c")))
        .select(
            "event_id",
            classify.calibrated_severity(F.col("s"), F.col("c")).alias("severity"),
            classify.rounded_confidence(F.col("c")).alias("confidence"),
        )
    )


@query
def ignore_glob_to_regex(t: Tables) -> DataFrame:
    return (
        t.table("pages")
        .select("page_id", F.concat(F.lit("/"), F.col("url"), F.lit("*.[x]/")).alias("pattern"))
        .select("page_id", ignore.ignore_glob_to_regex(F.col("pattern")).alias("regex"))
    )


@query
def ignore_covers(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("./.env", ".env.local", "dist", "a/node_modules", "config")])
    return (
        t.files()
        .where(F.col("path") == ".gitignore")
        .select("repo_id", "content", F.explode(names).alias("name"))
        .select("repo_id", "name", ignore.ignore_covers(F.col("content"), F.col("name")).alias("covered"))
    )


@query
def is_route_file(t: Tables) -> DataFrame:
    return t.files().select(
        "repo_id", "path", paths.is_route_file(F.col("path"), F.col("content")).alias("route")
    )


@query
def is_server_handler(t: Tables) -> DataFrame:
    return t.files().select(
        "repo_id", "path", paths.is_server_handler(F.col("path"), F.col("content")).alias("handler")
    )


@query
def clean_version(t: Tables) -> DataFrame:
    return (
        t.manifests()
        .select("repo_id", F.explode("dependencies").alias("name", "spec"))
        .select("repo_id", "name", values.clean_version(F.col("spec")).alias("version"))
    )


# ── detectors ───────────────────────────────────────────────────────────────────


@query
def scan_secrets(t: Tables) -> DataFrame:
    return t.walked(code_rules.secrets)


@query
def secret_tokens_in_text(t: Tables) -> DataFrame:
    """Token assignments in prose, with the fake test on the quoted value."""
    rule = next(r for r in SECRET_RULES if r.id == "token-assignment")
    found = F.explode(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))
    value = F.regexp_extract("found", TOKEN_VALUE, 1)
    return (
        t.table("documents")
        .where(F.col("text").contains("token"))
        .select("doc_id", found.alias("found"))
        .select("doc_id", value.alias("value"))
        .where(~values.looks_fake(F.col("value")))
    )


@query
def env_public_secret(t: Tables) -> DataFrame:
    return t.walked(code_rules.env_names)


@query
def env_ignore_gaps(t: Tables) -> DataFrame:
    return brief(repository.env_ignore_gaps(t.files(), t.tracked()))


@query
def webhook_unverified(t: Tables) -> DataFrame:
    return t.walked(webhooks.unverified)


@query
def webhook_missing_failure(t: Tables) -> DataFrame:
    return t.walked(webhooks.missing_failure)


@query
def webhook_exec(t: Tables) -> DataFrame:
    return t.walked(webhooks.exec_calls)


@query
def scan_injection(t: Tables) -> DataFrame:
    return t.walked(code_rules.injection)


@query
def injection_messages(t: Tables) -> DataFrame:
    """All texts of the injection findings."""
    return attach_texts(plans.walked_hits(t.files(), [code_rules.injection])).select(
        "repo_id", "id", "title", "message", "fix", "cwe", "breach_precedent"
    )


@query
def controlled_html_sink(t: Tables) -> DataFrame:
    return t.walked(code_rules.injection).where(F.col("id") == "injection-xss-dangerously-set")


@query
def check_cors(t: Tables) -> DataFrame:
    return t.walked(code_rules.cors)


@query
def auth_session_rules(t: Tables) -> DataFrame:
    return t.walked(auth_config.session_rules)


@query
def password_reset_rules(t: Tables) -> DataFrame:
    return t.walked(auth_config.password_reset_rules)


@query
def auth_provider(t: Tables) -> DataFrame:
    return auth_config.auth_provider(t.files())


@query
def rate_limit_missing(t: Tables) -> DataFrame:
    return t.walked(app_security.rate_limit)


@query
def idor_scope(t: Tables) -> DataFrame:
    return t.walked(app_security.idor_scope)


@query
def plaintext_password_compare(t: Tables) -> DataFrame:
    return t.walked(app_security.password_compare)


@query
def upload_rules(t: Tables) -> DataFrame:
    return t.walked(app_security.uploads)


@query
def error_exposed(t: Tables) -> DataFrame:
    return t.walked(app_security.error_exposure)


@query
def sensitive_log(t: Tables) -> DataFrame:
    return t.walked(app_security.sensitive_log)


@query
def open_redirect(t: Tables) -> DataFrame:
    return t.walked(app_security.open_redirect)


@query
def auth_rules(t: Tables) -> DataFrame:
    return t.walked(app_security.auth_rule_list)


@query
def scan_app_security(t: Tables) -> DataFrame:
    return t.walked(app_security.app_security)


@query
def rls_missing(t: Tables) -> DataFrame:
    return t.walked(data_access.missing_rls)


@query
def rls_policy_lines(t: Tables) -> DataFrame:
    return t.walked(data_access.policy_lines)


@query
def rls_source_lines(t: Tables) -> DataFrame:
    return t.walked(data_access.source_lines)


@query
def check_firebase(t: Tables) -> DataFrame:
    return brief(plans.check_firebase(t.files()))


def _rules_findings(t: Tables, rule: str) -> DataFrame:
    return plans.scan_rules_files(t.files()).where(F.col("id") == rule).select(
        *FINDING, "message"
    )


@query
def rules_hidden_unicode(t: Tables) -> DataFrame:
    return _rules_findings(t, "rules-hidden-unicode")


@query
def rules_base64(t: Tables) -> DataFrame:
    return _rules_findings(t, "rules-base64-payload")


@query
def rules_unknown_url(t: Tables) -> DataFrame:
    return _rules_findings(t, "rules-suspicious-url")


@query
def rules_malicious_text(t: Tables) -> DataFrame:
    return _rules_findings(t, "rules-malicious-instruction")


# ── joins ───────────────────────────────────────────────────────────────────────


@query
def malicious_packages(t: Tables) -> DataFrame:
    return packages.malicious_packages(t.manifests()).select("repo_id", "id", "severity", "message", "fix")


@query
def typosquats(t: Tables) -> DataFrame:
    return packages.typosquats(t.manifests()).select("repo_id", "id", "severity", "message", "fix")


@query
def suspicious_scripts(t: Tables) -> DataFrame:
    return packages.suspicious_scripts(t.manifests()).select("repo_id", "id", "severity", "message")


@query
def vulnerable_dependencies(t: Tables) -> DataFrame:
    return packages.vulnerable_dependencies(t.files(), t.manifests(), t.advisories()).select(
        "repo_id", "id", "severity", "title", "message", "fix"
    )


@query
def advisory_severity_and_fix(t: Tables) -> DataFrame:
    return t.advisories().select(
        "id",
        packages.advisory_severity(F.col("severity")).alias("severity"),
        packages.advisory_fix(F.col("affected")).alias("fix_version"),
    )


@query
def missing_headers(t: Tables) -> DataFrame:
    return headers.missing_headers(t.responses()).select(
        "url", "id", "severity", "title", "message", "fix"
    )


@query
def git_ignore_gaps(t: Tables) -> DataFrame:
    known = repository.git_repositories(t.tracked())
    return repository.git_ignore_gaps(t.files(), known).select("repo_id", "id", "severity", "message")


@query
def git_tracked(t: Tables) -> DataFrame:
    return repository.git_tracked(t.tracked()).select("repo_id", "id", "severity", "message")


@query
def git_history_secrets(t: Tables) -> DataFrame:
    return repository.git_history_secrets(t.commit_lines()).select("repo_id", "id", "severity", "title")


@query
def git_history_commits(t: Tables) -> DataFrame:
    return repository.history_hits(t.commit_lines())


@query
def finding_consequence(t: Tables) -> DataFrame:
    return t.findings().select("repo_id", "message", fo.finding_consequence().alias("consequence"))


@query
def passed_checks(t: Tables) -> DataFrame:
    return fo.passed_checks(t.findings(), t.finding_repos())


# ── aggregates, order, sets ─────────────────────────────────────────────────────


@query
def finding_penalty(t: Tables) -> DataFrame:
    return fo.penalties(t.findings()).select(
        "repo_id", "message", F.col("penalty").cast("double").alias("penalty")
    )


@query
def audit_score(t: Tables) -> DataFrame:
    return fo.audit_score(t.findings(), t.finding_repos())


@query
def score_grades(t: Tables) -> DataFrame:
    score = F.col("event_id") % 101
    return t.table("events").select(
        "event_id",
        fo.grade(score).alias("grade"),
        fo.grade_meaning(fo.grade(score)).alias("meaning"),
    )


@query
def summarize_findings(t: Tables) -> DataFrame:
    return fo.summarize_findings(t.findings())


@query
def fix_prompt(t: Tables) -> DataFrame:
    return fo.fix_prompt(t.findings(), t.finding_repos(), items_per_part=60)


@query
def numbered_findings(t: Tables) -> DataFrame:
    return fo.numbered_findings(t.findings()).select(
        "repo_id", "number", "severity", "scanner", "id", "message", "consequence"
    )


@query
def top_findings(t: Tables) -> DataFrame:
    return fo.top_findings(t.findings()).select(
        "repo_id", "scanner", "rank", "id", "message", "total", "hidden"
    )


@query
def first_n_dependencies(t: Tables) -> DataFrame:
    return packages.first_n_dependencies(t.manifests())


@query
def dependency_limit_notice(t: Tables) -> DataFrame:
    return packages.dependency_limit_notice(t.manifests()).select("repo_id", "id", "title", "message")


@query
def redacted_counts(t: Tables) -> DataFrame:
    return fo.redacted_counts(t.findings())


@query
def union_scans(t: Tables) -> DataFrame:
    f = t.findings()
    parts = [f.where(F.col("scanner") == s) for s in ("check_cors", "check_env", "check_git")]
    return fo.union_scans(parts + parts[:1]).select("repo_id", "scanner", "id", "message")


@query
def dedup_findings(t: Tables) -> DataFrame:
    return fo.dedup_findings(t.findings()).select("repo_id", "file", "line", "id", "message")


@query
def actionable_filter(t: Tables) -> DataFrame:
    return fo.actionable(t.findings()).select("repo_id", "id", "message")


@query
def first_per_rule(t: Tables) -> DataFrame:
    hits = t.findings().where(F.col("line").isNotNull()).select(
        "repo_id", F.col("file").alias("path"), F.col("id").alias("rule"), "line"
    )
    return fo.first_per_rule(hits)


def _audit_findings(t: Tables) -> DataFrame:
    return plans.all_findings(t.files(), t.tracked(), t.commit_lines(), t.advisories())


@query
def code_findings(t: Tables) -> DataFrame:
    """Findings of all file-level scanners from the one shared scan."""
    files = t.files()
    return plans.code_findings(files).select(
        "repo_id", "scanner", "id", "severity", "file", "line"
    )


@query
def audit_scores(t: Tables) -> DataFrame:
    """Scores of all repositories from the findings of the 13 audit scanners."""
    files = t.files()
    scores = plans.audit_scores(files, t.tracked(), t.commit_lines(), t.advisories(), repository.repositories(files))
    return scores.drop("meaning")


@query
def audit_report(t: Tables) -> DataFrame:
    files = t.files()
    return plans.audit_report(_audit_findings(t), repository.repositories(files))


# ── changes ─────────────────────────────────────────────────────────────────────


@query
def route_change(t: Tables) -> DataFrame:
    return t.files().select(
        "repo_id", "path", F.explode(ch.route_change(F.col("path"))).alias("scanner")
    )


@query
def scan_changes(t: Tables) -> DataFrame:
    return ch.scan_changes(t.changes()).select("ts", *FINDING)


def _change_stream(t: Tables) -> tuple[DataFrame, str]:
    folder = work_folder(t, "changes")
    t.changes().write.parquet(f"{folder}/in")
    stream = (
        t.spark.readStream.schema("ts timestamp, repo_id bigint, path string, content string")
        .option("maxFilesPerTrigger", 8)
        .parquet(f"{folder}/in")
    )
    return stream, folder


@query
def scan_changes_stream(t: Tables) -> DataFrame:
    """The change stream through foreachBatch, with repository-level scanners."""
    stream, folder = _change_stream(t)
    running = ch.run_change_stream(
        stream, t.files(), t.tracked(), t.advisories(), f"{folder}/out", f"{folder}/state"
    )
    running.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select(
        "ts", "changed", "repo_id", "scanner", "id", "severity", "file", "line"
    )


@query
def stream_dedup(t: Tables) -> DataFrame:
    stream, folder = _change_stream(t)
    running = (
        ch.stream_dedup(ch.scan_changes(stream))
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("repo_id", "file", "line", "id")
