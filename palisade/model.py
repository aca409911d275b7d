"""Schemas shared by the scanners."""

from __future__ import annotations

# One detector hit inside one file, before texts from the catalogue are attached.
HIT = (
    "struct<rule:string,line:int,detail:string,severity:string,confidence:double>"
)
HITS = f"array<{HIT}>"

FINDING_COLUMNS = (
    "repo_id", "scanner", "id", "severity", "category", "title", "message", "file", "line",
    "fix", "docs", "cwe", "breach_precedent", "confidence",
)
FINDING_SCHEMA = (
    "repo_id bigint, scanner string, id string, severity string, category string, title string, "
    "message string, file string, line int, fix string, docs string, cwe string, "
    "breach_precedent string, confidence double"
)

# Order in which an audit lists the scanners.
AUDIT_SCANNERS = (
    "scan_secrets", "check_env", "check_git", "check_auth_config", "scan_webhooks",
    "scan_injection", "check_cors", "check_supply_chain", "scan_dependencies",
    "check_supabase_rls", "check_firebase", "scan_app_security", "scan_rules_files",
)
ALL_SCANNERS = AUDIT_SCANNERS + ("check_headers",)

COMMIT_LINE_SCHEMA = (
    "repo_id bigint, commit string, ts timestamp, path string, op string, line string"
)
CHANGE_SCHEMA = "ts timestamp, repo_id bigint, path string, content string"
