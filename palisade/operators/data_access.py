"""Database access rules: row level security in migrations and source, Firebase rules."""

from __future__ import annotations

from palisade.functions.dialect import java_pattern
from palisade.functions.ignore import JS_TRIM
from palisade.functions.paths import SCRIPT_EXTENSIONS
from palisade.model import HITS
from palisade.operators.auth_config import GET_SESSION, ON_FRONTEND
from palisade.operators.file_scan import FileView, all_of, rlike, sql_text

# Patterns of the policy checks.
CREATE_TABLE = r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:public\.)?(\w+)"
USING_TRUE = r"USING\s*\(\s*true\s*\)"
ROLE_ONLY = r"""auth\.role\(\)\s*=\s*['"]authenticated['"]"""
UID_NOT_NULL = r"auth\.uid\(\)\s+IS\s+NOT\s+NULL"
SELECT_ALL = r"""\.from\s*\(['"`]\w+['"`]\)\s*\.select\s*\(['"`]\*['"`]\)"""
ALLOW_IF_TRUE = r"allow\s+(read|write|read,\s*write)\s*:\s*if\s+true"
CLIENT_USER_ID = r"request\.(query|data)\.userId\s*==\s*userId"
READ_IF_LOGGED_IN = r"allow\s+read\s*:\s*if\s+request\.auth\s*!=\s*null\s*;?\s*$"


_SQL_COMMENT = r"--[^\n\r\u2028\u2029]*(?=\n|\z)"


def missing_rls(view: FileView) -> None:
    """Every created table that the same file does not put under row level security."""
    gate = all_of(view.walks(".sql"), view.has("create"), view.has("table"))
    code = f"regexp_replace(content, {sql_text(_SQL_COMMENT)}, '')"
    tables = f"regexp_extract_all({code}, {sql_text(java_pattern(CREATE_TABLE, True))}, 1)"

    def enabled(schema: str) -> str:
        return (
            f"contains(upper_code, concat('ALTER TABLE {schema}', upper(t), "
            "' ENABLE ROW LEVEL SECURITY'))"
        )

    # The upper-cased text is bound once for all tables of the file.
    view.emit(
        f"if({gate}, cast(transform(array(upper({code})), upper_code -> transform("
        f"filter({tables}, t -> not {enabled('')} and not {enabled('PUBLIC.')}), "
        "t -> named_struct('rule', 'rls-missing-%X%', 'line', null, 'detail', t, "
        f"'severity', null, 'confidence', null)))[0] as {HITS}), cast(array() as {HITS}))"
    )


def policy_lines(view: FileView) -> None:
    sql = view.walks(".sql")
    view.emit(
        view.line_hits(
            "rls-using-true", sql, rlike(USING_TRUE, True), needs=(("using",), ("true",)),
            first=False,
        ),
        view.line_hits(
            "rls-auth-role-only", sql,
            all_of(rlike(ROLE_ONLY, True), "not contains(x.text, 'auth.uid()')"),
            needs=(("auth.role()",),), first=False,
        ),
        view.line_hits(
            "rls-uid-is-not-null", sql, rlike(UID_NOT_NULL, True), needs=(("auth.uid()",),),
            first=False,
        ),
    )


def source_lines(view: FileView) -> None:
    script = view.walks(*SCRIPT_EXTENSIONS)
    window = "array_join(transform(slice(_lines, x.i + 1, 5), y -> y.text), '\\n')"
    view.emit(
        view.line_hits(
            "rls-select-all-no-filter", script,
            all_of(
                rlike(SELECT_ALL),
                f"not contains({window}, '.eq(')",
                f"not contains({window}, 'user_id')",
            ),
            needs=((".from",), (".select",)), first=False,
        ),
        view.line_hits(
            "rls-getsession-frontend", all_of(script, ON_FRONTEND), rlike(GET_SESSION),
            needs=(("supabase.auth.getsession()",),), first=False,
        ),
    )


def rls(view: FileView) -> None:
    missing_rls(view)
    policy_lines(view)
    source_lines(view)


def firebase_lines(view: FileView) -> None:
    """Rule lines of any file; which file counts is decided per repository afterwards."""
    trimmed = f"regexp_replace(x.text, {sql_text(JS_TRIM)}, '')"
    view.emit(
        view.line_hits(
            "firebase-if-true", "true", rlike(ALLOW_IF_TRUE, True),
            needs=(("allow",), ("true",)), first=False,
        ),
        view.line_hits(
            "firebase-client-controlled-auth", "true",
            all_of(rlike(CLIENT_USER_ID, True), "not contains(x.text, 'request.auth')"),
            needs=(("request.query.userid", "request.data.userid"),), first=False,
        ),
        view.line_hits(
            "firebase-auth-not-null-only", "true", rlike(READ_IF_LOGGED_IN, True, of=trimmed),
            needs=(("allow",), ("request.auth",)), first=False,
        ),
    )
