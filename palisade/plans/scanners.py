"""The scanners and the fleet audit as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import (
    app_security,
    auth_config,
    code_rules,
    data_access,
    findings as fo,
    packages,
    repository,
    rules_files,
    webhooks,
)
from palisade.operators.file_scan import Detector, scan, scan_rows
from palisade.rules.catalogue import attach_texts
from palisade.session import cut_lineage, stored
from palisade.sources.files import (
    IGNORE_FILE,
    decode_text,
    filter_ignored,
    filter_readable,
    is_readable,
    read_files,
    resolve_firebase_rules,
    rules_that_count,
    without_ignored,
)

# Scanners whose files come from the directory walk: the ignore file applies to them.
WALKED: dict[str, Detector] = {
    "scan_secrets": code_rules.secrets,
    "check_env": code_rules.env_names,
    "check_auth_config": auth_config.auth_config,
    "scan_webhooks": webhooks.webhooks,
    "scan_injection": code_rules.injection,
    "check_cors": code_rules.cors,
    "check_supabase_rls": data_access.rls,
    "scan_app_security": app_security.app_security,
}


def walked_hits(files: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """Hits of directory-walk detectors; the ignore file is applied to the hits' keys."""
    return filter_ignored(scan(filter_readable(files), detectors), files)


def scan_files(files: DataFrame, scanner: str) -> DataFrame:
    """File-level findings of one directory-walk scanner."""
    return attach_texts(walked_hits(files, [WALKED[scanner]]))


def scan_rules_files(files: DataFrame, **options) -> DataFrame:
    return attach_texts(scan(filter_readable(files), [rules_files.rules_files(**options)]))


def firebase_from_hits(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Keep rule hits of the file that counts; report projects without any rules file."""
    configs = files.where(F.col("path") == "firebase.json").select("repo_id").distinct()
    return _firebase(hits, resolve_firebase_rules(files), configs)


def _firebase(hits: DataFrame, resolved: DataFrame, configs: DataFrame) -> DataFrame:
    counted = hits.join(resolved.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    lone = (
        configs.join(resolved.select("repo_id"), "repo_id", "left_anti")
        .select(
            "repo_id",
            F.lit(None).cast("string").alias("path"),
            F.lit("firebase-no-rules-file").alias("rule"),
            F.lit(None).cast("int").alias("line"),
            F.lit(None).cast("string").alias("detail"),
            F.lit(None).cast("string").alias("severity"),
            F.lit(None).cast("double").alias("confidence"),
        )
    )
    return counted.select(*lone.columns).unionByName(lone)


def check_firebase(files: DataFrame) -> DataFrame:
    hits = scan(filter_readable(files), [data_access.firebase_lines])
    return attach_texts(firebase_from_hits(hits, files))


def check_env(files: DataFrame, tracked: DataFrame) -> DataFrame:
    return repository.env_ignore_gaps(files, tracked).unionByName(scan_files(files, "check_env"))


def check_git(
    files: DataFrame,
    tracked: DataFrame,
    commit_lines: DataFrame,
    git_repos: DataFrame | None = None,
) -> DataFrame:
    known = repository.git_repositories(tracked) if git_repos is None else git_repos
    return (
        repository.git_ignore_gaps(files, known)
        .unionByName(repository.git_tracked(tracked))
        .unionByName(repository.git_history_secrets(commit_lines))
    )


CODE_DETECTORS = (*WALKED.values(), data_access.firebase_lines, rules_files.rules_files())
# Root files whose contents repository-level checks read.
NAMED_FILES = ("package.json", IGNORE_FILE, "firebase.json")


def code_hits(files: DataFrame) -> DataFrame:
    """Hits of all file-level detectors in one narrow pass over the file contents."""
    return scan(filter_readable(files), CODE_DETECTORS)


def survey(
    files: DataFrame, detectors: Sequence[Detector] = CODE_DETECTORS
) -> tuple[DataFrame, DataFrame]:
    """(hits, outline) of all files from one pass over their contents, written once.

    The outline has a row per file, whether it is readable, and the contents of ``NAMED_FILES`` only; it
    takes the place of ``files`` in every check that looks at repositories.
    """
    path, content = F.col("path"), F.col("content")
    readable = F.coalesce(is_readable(content), F.lit(False))
    rows = files.select(
        "repo_id",
        "path",
        F.when(path.isin(*NAMED_FILES), content).alias("named"),
        readable.alias("readable"),
        F.when(readable, content).otherwise("").alias("content"),
    )
    kept = stored(scan_rows(rows, detectors, keep=["named", "readable"]))
    hits = kept.select("repo_id", "path", F.inline("_hits"))
    return hits, kept.select("repo_id", "path", F.col("named").alias("content"), "readable")


def repository_state(outline: DataFrame) -> DataFrame:
    """What the root files of each repository say, from the one exchange over the outline, written once."""
    return stored(repository.root_state(outline))


def findings_from_hits(hits: DataFrame, files: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Three families of hits part by rule: walked files (the ignore file applies), rule
    files (it does not) and Firebase rules (only the file that counts).

    With the ``state`` of the repositories, ``files`` are only asked for rules files."""
    rule = F.col("rule")
    of_firebase = hits.where(rule.startswith("firebase-"))
    rules = hits.where(rule.startswith("rules-"))
    others = hits.where(~rule.startswith("firebase-") & ~rule.startswith("rules-"))
    if state is None:
        firebase = firebase_from_hits(of_firebase, files)
        walked = filter_ignored(others, files)
    else:
        ignored = state.where("ignore_names is not null").select("repo_id", F.col("ignore_names").alias("_ignore_names"))
        counts = rules_that_count(files, state.select("repo_id", "firestore", "database"), ignored)
        firebase = _firebase(of_firebase, counts, state.where("has_config").select("repo_id"))
        walked = without_ignored(others, ignored)
    columns = firebase.columns
    return attach_texts(
        walked.select(*columns).unionByName(rules.select(*columns)).unionByName(firebase)
    )


def code_findings(files: DataFrame) -> DataFrame:
    """Findings of all file-level scanners; the contents are read once."""
    return findings_from_hits(*survey(files))


def all_findings(
    files: DataFrame,
    tracked: DataFrame,
    commit_lines: DataFrame,
    advisories: DataFrame,
    git_repos: DataFrame | None = None,
    surveyed: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Findings of the 13 audit scanners.

    ``surveyed`` may be the result of ``survey(files)``; by default it is computed, in one pass
    over the contents.  All repository-level checks read its narrow outline.
    """
    scans, state = _without_advisories(files, tracked, commit_lines, git_repos, surveyed)
    return fo.union_scans([*scans, packages.vulnerable_dependencies(None, state, advisories)])


def _without_advisories(
    files: DataFrame,
    tracked: DataFrame,
    commit_lines: DataFrame,
    git_repos: DataFrame | None,
    surveyed: tuple[DataFrame, DataFrame] | None,
) -> tuple[list[DataFrame], DataFrame]:
    """Findings of all audit scanners but ``scan_dependencies``, and the states of the repositories."""
    hits, outline = surveyed or survey(files)
    state = repository_state(outline)
    known = stored(repository.tracked_state(tracked))
    git = known if git_repos is None else git_repos.select("repo_id").distinct()
    scans = [
        *file_scans(hits, outline, state, known),
        repository.git_gaps_of(state, git),
        repository.git_tracked_of(known),
        repository.git_history_secrets(commit_lines),
    ]
    return scans, state


def file_scans(hits: DataFrame, outline: DataFrame, state: DataFrame, known: DataFrame) -> list[DataFrame]:
    """The same as ``outline_scans`` without the advisories."""
    return [
        findings_from_hits(hits, outline, state),
        repository.env_gaps_of(state, known),
        packages.supply_chain(None, state),
    ]


def outline_scans(
    hits: DataFrame, outline: DataFrame, state: DataFrame, known: DataFrame, advisories: DataFrame
) -> list[DataFrame]:
    """Findings of hits, environment files and manifests, from the states of the repositories and of what git tracks."""
    return [
        *file_scans(hits, outline, state, known),
        packages.vulnerable_dependencies(None, state, advisories),
    ]


def audit_scores(
    files: DataFrame,
    tracked: DataFrame,
    commit_lines: DataFrame,
    advisories: DataFrame,
    repos: DataFrame,
    git_repos: DataFrame | None = None,
    surveyed: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Scores by the findings of the 13 audit scanners, those of advisories counted once per version, not listed."""
    scans, state = _without_advisories(files, tracked, commit_lines, git_repos, surveyed)
    listed = fo.union_scans([*scans, packages.no_dependencies(None, state)])
    return fo.audit_score(listed, repos, packages.dependency_sums(state, advisories))


def tree_findings(
    spark: SparkSession, root: str, tracked: DataFrame, commit_lines: DataFrame, advisories: DataFrame, **options
) -> DataFrame:
    """Findings of the audit scanners for the repositories in a directory tree (options: of ``read_files``)."""
    files = decode_text(filter_readable(read_files(spark, root, **options))).drop("size")
    return all_findings(files, tracked, commit_lines, advisories)


# What scores and fix lists read of a finding.
REPORTED = (
    "repo_id", "scanner", "id", "severity", "category", "title", "message", "file", "line", "fix", "confidence",
)


def audit_report(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Score, grade, counts and the whole fix list; one row per repository, if its list is not over 1,000 entries.

    A longer list is cut into ``parts``, each with a row that repeats the score.  Findings are read twice, once for their sums
    and once for the lists, so they are written first; but not those of advisories, of which there are as many as
    manifests x advisories: they come out of a join of small written tables, and only the lists shuffle them.
    """
    rows = findings.select(*REPORTED)
    product = F.col("scanner").eqNullSafe(F.lit("scan_dependencies"))
    rows = stored(rows.where(~product)).unionByName(rows.where(product))
    sums = cut_lineage(fo.penalty_sums(rows, "repo_id"))
    scores = fo.score_sums(sums, repos)
    # The parts are the left side: the adaptive skew join can split a repository with very many.
    return fo.fix_prompt(rows, repos, sums=sums).withColumnRenamed("text", "fix_prompt").join(scores, "repo_id")
