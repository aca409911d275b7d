"""DuckDB SQL for the registered queries.

Written independently of the Spark plans: the lexer is a character-by-character fold
here, first lines are window functions, ranks are plain windows.  Only fixed values (rule
patterns, texts, lists) are shared.
"""

from __future__ import annotations

from checks import derived
from palisade.functions import paths, values
from palisade.operators import app_security as app
from palisade.operators import auth_config as auth
from palisade.operators import code_rules, data_access, headers, rules_files, webhooks
from palisade.rules import report_texts as texts
from palisade.rules.fixed_rules import (
    AUTH_RULES,
    INJECTION_RULES,
    KNOWN_MALICIOUS,
    SUSPICIOUS_SCRIPTS,
    TYPOSQUATS,
    WEBHOOK_PROVIDERS,
)
from palisade.rules.secret_rules import HISTORY_SHAPES, SECRET_RULES, TOKEN_VALUE


def q(text: str | None) -> str:
    if text is None:
        return "NULL"
    parts = text.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{parts[0]}'"


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def rx(text: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({text}, {q(pattern)}{', ' + q('i') if fold else ''})"


def has(text: str, *literals: str) -> str:
    return any_of(*[f"contains({text}, {q(x)})" for x in literals])


def base(path: str = "path") -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def ext(path: str = "path") -> str:
    return f"lower(regexp_extract({base(path)}, '(?s)^.+([.][^.]*)$', 1))"


def one_of(value: str, items) -> str:
    return f"({value} IN ({', '.join(q(i) for i in items)}))"


def skipped(path: str = "path") -> str:
    names = one_of("d", paths.SKIPPED_DIRECTORIES)
    return (
        f"(len(list_filter(string_split({path}, '/')[:-2], "
        f"lambda d: (starts_with(d, '.') AND d <> '.env') OR {names})) > 0)"
    )


def is_doc(path: str = "path") -> str:
    return any_of(one_of(ext(path), paths.DOC_EXTENSIONS), rx(f"lower({base(path)})", paths.DOC_NAME))


def is_test(path: str = "path") -> str:
    return any_of(rx(path, paths.TEST_SEGMENT, True), rx(base(path), paths.TEST_NAME, True))


def app_test(path: str = "path") -> str:
    return any_of(rx(path, paths.APP_TEST_NAME), has(path, "__tests__"))


# ── values ──────────────────────────────────────────────────────────────────────


def placeholder(v: str) -> str:
    tests = [rx(v, p, fold) for p, fold in values.PLACEHOLDERS if "\\1" not in p]
    repeats = (
        f"(len(list_filter(range(1, len({v}) - 4), "
        f"lambda k: substr({v}, k, 1) <> chr(10) AND substr({v}, k, 6) = repeat(substr({v}, k, 1), 6))) > 0)"
    )
    return any_of(*tests, repeats)


def entropy(v: str) -> str:
    return f"CASE WHEN {v} = '' THEN 0.0 ELSE list_aggregate(string_split({v}, ''), 'entropy') END"


def random_part(v: str) -> str:
    stripped = f"regexp_replace(regexp_replace({v}, '^[A-Za-z]+[-_]', ''), '^[A-Za-z]{{2,4}}_', '')"
    return f"CASE WHEN len({stripped}) >= 8 THEN {stripped} ELSE {v} END"


def fake(v: str) -> str:
    return any_of(placeholder(v), f"({entropy(f'({random_part(v)})')}) < 2.8")


def prose(v: str) -> str:
    return any_of(rx(v, values.PROSE[0]), rx(v, values.PROSE[1]))


QUOTES = "(chr(39), '\"', '`')"
BACKSLASH = "chr(92)"


def fold_state(text: str) -> str:
    """State machine over single characters; a state is the opener, with '/' for a pending
    slash, '/**' for a pending star and a trailing backslash for a pending escape."""
    return (
        f"list_reduce(string_split({text}, ''), lambda s, c: CASE "
        "WHEN s = '//' THEN CASE WHEN c = chr(10) THEN '' ELSE s END "
        "WHEN s = '/*' THEN CASE WHEN c = '*' THEN '/**' ELSE s END "
        "WHEN s = '/**' THEN CASE WHEN c = '/' THEN '' WHEN c = '*' THEN s ELSE '/*' END "
        f"WHEN s IN {QUOTES} THEN CASE WHEN c = {BACKSLASH} THEN s || c WHEN c = s THEN '' "
        "WHEN c = chr(10) AND s <> '`' THEN '' ELSE s END "
        f"WHEN len(s) = 2 THEN s[1] "
        "WHEN s = '/' AND c = '/' THEN '//' "
        "WHEN s = '/' AND c = '*' THEN '/*' "
        "WHEN c = '/' THEN '/' "
        f"WHEN c IN {QUOTES} THEN c ELSE '' END, '')"
    )


def state(text: str, following: str) -> str:
    """State after ``text``, looking one character ahead."""
    return (
        f"list_transform([{fold_state(text)}], lambda s: CASE "
        f"WHEN s = '/' AND {following} = '/' THEN '//' "
        f"WHEN s = '/' AND {following} = '*' THEN '/*' "
        f"WHEN s = '/**' AND {following} = '/' THEN '' "
        "WHEN s = '/' THEN '' WHEN s = '/**' THEN '/*' "
        f"WHEN len(s) = 2 AND s NOT IN ('//', '/*') THEN s[1] ELSE s END)[1]"
    )


def enclosed_tail(before: str) -> str:
    """The open literal up to the position, from its quote on; '' where none is open."""
    return (
        f"substr(list_reduce(string_split({before}, ''), lambda s, c: CASE "
        f"WHEN s = '' THEN CASE WHEN c IN {QUOTES} THEN 'n' || c ELSE '' END "
        f"WHEN s[1] = 'e' THEN 'n' || s[2:] || c "
        f"WHEN c = {BACKSLASH} THEN 'e' || s[2:] || c "
        "WHEN c = s[2] THEN '' ELSE s || c END, ''), 2)"
    )


def enclosed_rest(rest: str, quote: str) -> str:
    """Text after the position up to the closing quote."""
    return (
        f"substr(list_reduce(string_split({rest}, ''), lambda s, c: CASE "
        "WHEN s[1] = 'd' THEN s "
        "WHEN s[1] = 'e' THEN 'n' || s[2:] || c "
        f"WHEN c = {BACKSLASH} THEN 'e' || s[2:] || c "
        f"WHEN c = {quote} THEN 'd' || s[2:] ELSE s || c END, 'n'), 2)"
    )


def jsx(path: str, line: str, before: str) -> str:
    return (
        f"(coalesce({one_of(ext(path), ('.tsx', '.jsx'))}, false) AND regexp_matches({before}, '>[^<>]*$') "
        f"AND contains(substr({line}, len({before}) + 1), '<'))"
    )


def display(line: str, before: str) -> str:
    """Inside a literal that follows a display key or reads like a sentence."""
    tail = enclosed_tail(before)
    rest = f"substr({line}, len({before}) + 1)"
    # One-element list: binds the tail so that it is folded once.
    return (
        f"list_transform([{tail}], lambda tl: CASE WHEN tl = '' THEN false ELSE "
        f"{rx(f'left({line}, len({before}) - len(tl))', values.DISPLAY_KEYS, True)} "
        f"OR {prose('(substr(tl, 2) || ' + enclosed_rest(rest, 'tl[1]') + ')')} END)[1]"
    )


# ── files ───────────────────────────────────────────────────────────────────────

FILES = f"files AS MATERIALIZED ({derived.files_sql()})"
TRACKED = f"tracked AS MATERIALIZED ({derived.TRACKED_SQL})"
IGNORED = """
ignore_names AS (
  SELECT DISTINCT repo_id, regexp_replace(trim(l, chr(32) || chr(9) || chr(13)), '/$', '') AS name
  FROM (SELECT repo_id, unnest(string_split(content, chr(10))) AS l FROM files WHERE path = '.gitignore')
  WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#')),
ignored AS (
  SELECT DISTINCT f.repo_id, f.path FROM files f JOIN ignore_names n
  ON f.repo_id = n.repo_id AND (n.name = f.path OR list_contains(string_split(f.path, '/'), n.name)))
"""


WALK_ONLY = (
    f" AND NOT {skipped()} AND NOT EXISTS "
    "(SELECT 1 FROM ignored g WHERE g.repo_id = files.repo_id AND g.path = files.path)"
)


def walk(extensions) -> str:
    """CTE src: readable files the directory walk yields for the extensions."""
    return (
        f"WITH {FILES}, {IGNORED}, src AS (SELECT * FROM files WHERE content <> '' "
        f"AND ({one_of(ext(), extensions)} OR starts_with({base()}, '.env')){WALK_ONLY})"
    )


def lines(of: str = "src") -> str:
    return (
        "lines AS (SELECT repo_id, path, content, unnest(string_split(content, chr(10))) AS line, "
        f"unnest(range(len(string_split(content, chr(10))))) AS i FROM {of})"
    )


def values_list(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


RESULT = "repo_id, id, severity, path AS file, cast(line_no AS int) AS line, confidence"


def raw_hits(rules, gate: str = "true") -> str:
    """CTE hits: first match per (line, rule).  rules: (rule, severity, pattern, fold)."""
    rows = [
        (q(r), q(s), q(("(?i)" if fold else "") + p)) for r, s, p, fold in rules
    ]
    return f"""rules(id, severity, pat) AS (VALUES {values_list(rows)}),
hits AS (
  SELECT l.*, r.id, r.severity, pat, regexp_extract(line, '^((?s:.*?))(?:' || pat || ')', 1) AS before,
    regexp_extract(line, pat, 0) AS found
  FROM (SELECT * FROM lines WHERE {gate}) l, rules r WHERE regexp_matches(line, pat)),
staged AS (
  SELECT *, substr(line, len(before) + 1, 1) AS following,
    CASE WHEN i = 0 THEN before ELSE array_to_string(string_split(content, chr(10))[1:i], chr(10)) || chr(10) || before END AS upto
  FROM hits),
judged AS (SELECT *, {state('upto', 'following')} AS st FROM staged)"""


LIVE = f"st = '' AND NOT {jsx('path', 'line', 'before')} AND NOT {placeholder('found')} AND NOT {is_doc()} AND NOT {is_test()}"


def first_live(cte: str, extra: str = "") -> str:
    """Findings of vetted rules, first line per (repo, path, rule)."""
    return f"""{cte},
live AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, id ORDER BY i) AS rn FROM judged WHERE {LIVE})
SELECT repo_id, id, severity, path AS file, cast(i + 1 AS int) AS line, 1.0::DOUBLE AS confidence FROM live WHERE rn = 1 {extra}"""


def line_rule(id_: str, severity: str, condition: str, gate: str = "true", first: bool = True) -> str:
    """SELECT of a plain line rule over the CTE lines."""
    rank = "row_number() OVER (PARTITION BY repo_id, path ORDER BY i)" if first else "1"
    return (
        f"SELECT repo_id, {q(id_)} AS id, {q(severity)} AS severity, path AS file, cast(i + 1 AS int) AS line, "
        f"cast(NULL AS double) AS confidence FROM (SELECT *, {rank} AS rn FROM lines "
        f"WHERE ({gate}) AND ({condition})) WHERE rn = 1"
    )


def file_rule(id_: str, severity: str, condition: str, line: str = "NULL") -> str:
    return (
        f"SELECT repo_id, {q(id_)} AS id, {q(severity)} AS severity, path AS file, cast({line} AS int) AS line, "
        f"cast(NULL AS double) AS confidence FROM src WHERE {condition}"
    )


ORACLES: dict[str, str] = {}
O = ORACLES
SCRIPT, MODULE = paths.SCRIPT_EXTENSIONS, paths.MODULE_EXTENSIONS
SRC_SCRIPT = f"{walk(SCRIPT)}, {lines()}"
SRC_MODULE = f"{walk(MODULE)}, {lines()}"

# ── sources and selection ───────────────────────────────────────────────────────

O["filter_extension"] = (
    f"WITH {FILES} SELECT repo_id, path FROM files WHERE {one_of(ext(), paths.DEFAULT_EXTENSIONS)} "
    f"OR starts_with({base()}, '.env')"
)
O["filter_skip_dirs"] = (
    "SELECT page_id, path FROM (SELECT page_id, unnest(['a/' || url, '.cache/' || url, "
    f"'x/node_modules/' || url, '.env/' || url]) AS path FROM pages) WHERE NOT {skipped()}"
)
O["filter_ignored"] = (
    f"WITH {FILES}, {IGNORED} SELECT repo_id, path FROM files f WHERE NOT EXISTS "
    "(SELECT 1 FROM ignored g WHERE g.repo_id = f.repo_id AND g.path = f.path)"
)
O["filter_readable"] = (
    "SELECT doc_id FROM documents WHERE doc_id % 3 = 2 OR (doc_id % 3 = 0 AND NOT contains(text, ' '))"
)
O["load_rules"] = " UNION ALL ".join(
    f"SELECT doc_id, {q(rule)} AS rule, {q(severity)} AS severity, min(i) AS line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, "
    "unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) "
    f"WHERE regexp_matches(line, {q(pattern)}, 'i') GROUP BY doc_id"
    for rule, severity, pattern in (
        ("warm", "info", r"(^|[^A-Za-z0-9_])(hot|with)([^A-Za-z0-9_]|$)"),
        ("pair", "warning", r"(^|[^A-Za-z0-9_])the\s+of([^A-Za-z0-9_]|$)"),
        ("long-word", "critical", r"(^|[^A-Za-z0-9_])[a-z]{14,}([^A-Za-z0-9_]|$)"),
    )
)
MANIFESTS = (
    "manifest_files AS MATERIALIZED (SELECT repo_id, content FROM files WHERE path = 'package.json'), "
    "manifests AS MATERIALIZED (SELECT repo_id, content AS raw, json_valid(content) AS valid, "
    "json_extract(content, '$.dependencies') AS deps, json_extract(content, '$.devDependencies') AS dev "
    "FROM manifest_files)"
)
O["parse_manifest"] = (
    f"WITH {FILES}, {MANIFESTS} SELECT repo_id, valid, cast(len(json_keys(deps)) AS int) AS n_dependencies, "
    "cast(len(json_keys(dev)) AS int) AS n_dev, json_extract_string(deps, '$.a4') AS a4 FROM manifests"
)
IS_RULES = (
    f"(NOT contains(path, '/') AND ({one_of('path', rules_files.RULES_FILES)} "
    "OR ends_with(path, '.rules') OR ends_with(path, '.mcp.json')))"
)
O["select_rules_files"] = f"WITH {FILES} SELECT repo_id, path FROM files WHERE {IS_RULES}"
RESOLVED = f"""configs AS MATERIALIZED (SELECT repo_id, content FROM files WHERE path = 'firebase.json'),
candidates AS (
  SELECT repo_id, 1 AS priority, json_extract_string(content, '$.firestore.rules') AS path FROM configs
  UNION ALL SELECT repo_id, 2, json_extract_string(content, '$.database.rules') FROM configs
  UNION ALL SELECT repo_id, 3, path FROM files f WHERE {ext()} = '.rules' AND NOT {skipped()}
    AND NOT EXISTS (SELECT 1 FROM ignored g WHERE g.repo_id = f.repo_id AND g.path = f.path)
  UNION ALL SELECT repo_id, CASE path WHEN 'firestore.rules' THEN 4 WHEN 'database.rules' THEN 5 ELSE 6 END, path
    FROM files WHERE path IN ('firestore.rules', 'database.rules', 'storage.rules')),
resolved AS (SELECT repo_id, path, priority FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority, path) AS rn
  FROM candidates WHERE path IS NOT NULL AND path <> '') WHERE rn = 1)"""
O["resolve_firebase_rules"] = f"WITH {FILES}, {IGNORED}, {RESOLVED} SELECT * FROM resolved"
O["explode_lines"] = (
    "SELECT doc_id, cast(unnest(range(len(string_split(text, chr(10))))) AS int) AS i, "
    "unnest(string_split(text, chr(10))) AS line FROM documents"
)
FINDINGS = f"findings AS MATERIALIZED ({derived.findings_sql()})"
REPOS = f"repos AS (SELECT DISTINCT {derived.EVENT_REPO} AS repo_id FROM events)"
O["write_findings_by_scanner"] = f"WITH {FINDINGS} SELECT repo_id, scanner, id, message FROM findings"

# ── context functions ───────────────────────────────────────────────────────────

O["is_doc_file"] = f"WITH {FILES} SELECT repo_id, path, {is_doc()} AS is_doc FROM files"
O["is_test_or_example"] = (
    f"WITH {FILES} SELECT repo_id, path, {is_test()} AS is_test, {app_test()} AS is_app_test FROM files"
)
O["is_placeholder"] = f"SELECT conv_id, turn, {placeholder('text')} AS placeholder FROM conversations"
O["shannon_entropy"] = f"SELECT doc_id, round({entropy('text')}, 6) AS entropy FROM documents"
O["secret_random_part"] = (
    "SELECT doc_id, token, " + random_part("token") + " AS random_part, " + fake("token") + " AS fake FROM "
    "(SELECT doc_id, (['sk_live_', 'a-', 'key_test_', '', 'AB_'])[doc_id % 5 + 1] || substr(md5(text), 1, doc_id % 20 + 1) AS token FROM documents)"
)
TENTHS = ", ".join(f"cast(floor(len(content) * {k} / 10) AS bigint)" for k in derived.TENTHS)
O["lex_state"] = (
    f"WITH {FILES} SELECT repo_id, path, pos, {state('left(content, pos)', 'substr(content, pos + 1, 1)')} AS state "
    f"FROM (SELECT repo_id, path, content, unnest([{TENTHS}, len(content) - 1]) AS pos FROM files WHERE content <> '')"
)
# The state at a line start is folded from the file's first character, for every line.
O["line_start_states"] = (
    f"WITH {FILES}, {lines('files')} SELECT repo_id, path, cast(i AS int) AS i, CASE WHEN i = 0 THEN '' ELSE "
    + state("(array_to_string(string_split(content, chr(10))[1:i], chr(10)) || chr(10))", "'x'")
    + " END AS state FROM lines"
)
O["match_offset"] = (
    "SELECT doc_id, n AS i, cast(len(array_to_string(ls[1:n], chr(10))) + CASE WHEN n > 0 THEN 1 ELSE 0 END + 3 AS bigint) AS pos FROM "
    "(SELECT doc_id, ls, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
)
MIDDLE = (
    "middle AS (SELECT *, left(line, cast(floor(len(line) / 2) AS bigint)) AS before FROM lines)"
)
before_quote = "regexp_extract(line, '^([^\"'']*)[\"'']', 1)"
O["display_key_before"] = (
    f"WITH {FILES}, {lines('files')} SELECT repo_id, path, cast(i AS int) AS i, "
    f"{rx(before_quote, values.DISPLAY_KEYS, True)} AS display FROM lines"
)
O["looks_like_prose"] = (
    f"WITH {FILES}, {lines('files')} SELECT repo_id, path, cast(i AS int) AS i, {prose('line')} AS prose FROM lines"
)
O["enclosing_string"] = (
    f"WITH {FILES}, {lines('files')}, {MIDDLE}, t AS (SELECT *, {enclosed_tail('before')} AS tl FROM middle) "
    "SELECT repo_id, path, cast(i AS int) AS i, CASE WHEN tl <> '' THEN cast(len(before) - len(tl) AS int) END AS open_column, "
    f"CASE WHEN tl <> '' THEN substr(tl, 2) || {enclosed_rest('substr(line, len(before) + 1)', 'tl[1]')} END AS value FROM t"
)
O["is_jsx_text"] = (
    f"WITH {FILES}, {lines('files')}, {MIDDLE} SELECT repo_id, path, cast(i AS int) AS i, "
    f"{jsx('path', 'line', 'before')} AS jsx FROM middle"
)


def classified(secret: bool) -> str:
    in_string = f"st IN {QUOTES}"
    shown = "disp"
    arms = [
        (is_doc(), "doc-file", "true", True, 0.05),
        (is_test(), "test-fixture", "true", True, 0.05),
        ("st IN ('//', '/*')", "comment", "true", False, 0.1),
        (jsx("path", "line", "before"), "jsx-text", "true", True, 0.05),
    ]
    if secret:
        arms += [
            (f"{in_string} AND {shown}", "string-literal", "true", True, 0.05),
            (f"{in_string} AND {fake('found')}", "string-literal", "false", True, 0.1),
            (in_string, "string-literal", "false", False, 0.95),
        ]
    else:
        arms += [(in_string, "string-literal", shown, True, 0.1)]
    arms += [(placeholder("found"), "code", "false", True, 0.2)]
    if secret:
        arms += [(fake("found"), "code", "false", True, 0.2)]

    def column(index: int, otherwise: str) -> str:
        def text(arm) -> str:
            value = arm[index]
            if isinstance(value, bool):
                return str(value).lower()
            return str(value) if index != 1 else q(value)

        body = " ".join(f"WHEN {arm[0]} THEN {text(arm)}" for arm in arms)
        return f"CASE {body} ELSE {otherwise} END"

    return f"""WITH {FILES}, {lines('files')}, {MIDDLE},
staged AS (SELECT *, substr(line, len(before) + 1, 8) AS found, substr(line, len(before) + 1, 1) AS following,
  CASE WHEN i = 0 THEN before ELSE array_to_string(string_split(content, chr(10))[1:i], chr(10)) || chr(10) || before END AS upto FROM middle),
judged AS (SELECT *, {state('upto', 'following')} AS st, {display('line', 'before')} AS disp FROM staged)
SELECT repo_id, path, cast(i AS int) AS i, {column(1, q('code'))} AS kind, {column(2, 'false')} AS is_prose,
  {column(3, 'false')} AS is_likely_example, ({column(4, '1.0')})::DOUBLE AS confidence FROM judged"""


O["classify_match"] = classified(False)
O["classify_secret_match"] = classified(True)
O["calibrate"] = """
SELECT event_id, CASE WHEN step = 'warning' AND c < 0.5 THEN 'info' ELSE step END AS severity, floor(c * 100 + 0.5) / 100 AS confidence
FROM (SELECT event_id, c, CASE WHEN s = 'critical' AND c < 0.9 THEN 'warning' ELSE s END AS step FROM
  (SELECT event_id, cast(event_id % 101 AS double) / 100.0 AS c, (['critical', 'warning', 'info', 'passed'])[event_id % 4 + 1] AS s FROM events)
  WHERE c >= 0.35)"""


def glob_regex(p: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({p}), '/$', ''), '^/', '')"
    quoted = f"regexp_replace({bare}, '([.+^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"
    return f"'^' || replace(replace({quoted}, '*', '.*'), '?', '.') || '\\z'"


O["ignore_glob_to_regex"] = (
    f"SELECT page_id, {glob_regex(chr(39) + '/' + chr(39) + ' || url || ' + chr(39) + '*.[x]/' + chr(39))} AS regex FROM pages"
)


def covered(name: str) -> str:
    """Some glob line of ``content`` covers the name, by regular expression."""
    plain = f"regexp_replace({name}, '^[.]/', '')"
    return (
        "(len(list_filter(string_split(content, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '^[#!]') "
        f"AND (regexp_matches({plain}, {glob_regex('l')}) OR regexp_matches(regexp_extract({plain}, '[^/]*$'), {glob_regex('l')})))) > 0)"
    )


O["ignore_covers"] = (
    f"WITH {FILES} SELECT repo_id, name, {covered('name')} AS covered FROM "
    "(SELECT repo_id, content, unnest(['./.env', '.env.local', 'dist', 'a/node_modules', 'config']) AS name FROM files WHERE path = '.gitignore')"
)
ROUTE = any_of(
    has("('/' || lower(path))", *paths.ROUTE_FRAGMENTS), *[rx("content", p) for p in paths.ROUTE_CONTENT]
)
HANDLER = any_of(
    has("('/' || lower(path))", *paths.HANDLER_FRAGMENTS),
    rx("('/' || lower(path))", paths.HANDLER_NAME),
    *[rx("content", p) for p in paths.HANDLER_CONTENT],
)
O["is_route_file"] = f"WITH {FILES} SELECT repo_id, path, {ROUTE} AS route FROM files"
O["is_server_handler"] = f"WITH {FILES} SELECT repo_id, path, {HANDLER} AS handler FROM files"
CLEAN = "string_split(regexp_replace(spec, '^[\\^~>=<]+', ''), ' ')[1]"
DEPENDENCIES = (
    "deps AS (SELECT repo_id, name, json_extract_string(deps, '$.\"' || name || '\"') AS spec FROM "
    "(SELECT repo_id, deps, unnest(json_keys(deps)) AS name FROM manifests WHERE deps IS NOT NULL))"
)
O["clean_version"] = (
    f"WITH {FILES}, {MANIFESTS}, {DEPENDENCIES} SELECT repo_id, name, {CLEAN} AS version FROM deps"
)

# ── detectors with vetting ──────────────────────────────────────────────────────

O["scan_injection"] = first_live(
    f"{SRC_MODULE}, " + raw_hits([(f"injection-{r.id}", r.severity, r.pattern, True) for r in INJECTION_RULES])
)
STATIC = (
    "WHEN id = 'injection-xss-dangerously-set' AND ("
    + " OR ".join(
        [
            rx("array_to_string(string_split(content, chr(10))[i + 1:i + 3], chr(10))", code_rules.STATIC_HTML),
            rx("content", code_rules.JSON_LD, True),
            rx("array_to_string(string_split(content, chr(10))[i + 1:i + 3], chr(10))", code_rules.STATIC_HTML_TEMPLATE),
        ]
    )
    + ") THEN 'info'"
)
O["scan_injection"] = O["scan_injection"].replace(
    "SELECT repo_id, id, severity, path AS file",
    f"SELECT repo_id, id, CASE {STATIC} ELSE severity END AS severity, path AS file",
)
O["controlled_html_sink"] = O["scan_injection"] + " AND id = 'injection-xss-dangerously-set'"
O["injection_messages"] = (
    f"WITH found AS ({O['scan_injection']}), info(id, title, fix, cwe, breach_precedent) AS (VALUES "
    + values_list(
        [(q(f"injection-{r.id}"), q(r.name), q(r.fix), q(r.cwe), q(r.breach)) for r in INJECTION_RULES]
    )
    + ") SELECT repo_id, id, title, title || ' detected in ' || file || ':' || line AS message, fix, cwe, breach_precedent "
    "FROM found JOIN info USING (id)"
)
APP_GATE = f"NOT {is_doc()} AND NOT {is_test()} AND NOT {app_test()}"
O["auth_rules"] = first_live(
    f"{SRC_MODULE}, "
    + raw_hits([(f"auth-{r.id}", r.severity, r.pattern, True) for r in AUTH_RULES], APP_GATE)
)
HAS_AUTH = rx("content", code_rules.AUTH_PATHS, True)
O["check_cors"] = first_live(
    f"{walk(MODULE + ('.json',))}, {lines()}, "
    + raw_hits([(r, "warning", p, fold) for r, p, fold in code_rules.CORS_RULES])
).replace(
    "SELECT repo_id, id, severity, path AS file",
    f"SELECT repo_id, id, CASE WHEN id <> 'cors-no-options' AND {HAS_AUTH} THEN 'critical' ELSE severity END AS severity, path AS file",
)
ENV_NAME = "upper(regexp_extract(line, 'NEXT_PUBLIC_(\\w+)', 1))"
O["env_public_secret"] = (
    f"{walk(SCRIPT + ('.env',))}, {lines()}, "
    + raw_hits(
        [("env-next-public-secret", "critical", code_rules.PUBLIC_PREFIX, False)],
        has(ENV_NAME, *code_rules.SECRET_NAME_PARTS),
    )
    + f" SELECT repo_id, id, severity, path AS file, cast(i + 1 AS int) AS line, 1.0::DOUBLE AS confidence FROM judged WHERE {LIVE}"
)
SECRET_CONTEXT = " AND ".join(
    f"(id <> {q('secret-' + r.id)} OR {rx('content', r.context_required, True)})"
    for r in SECRET_RULES
    if r.context_required
)
O["scan_secrets"] = (
    f"{walk(paths.DEFAULT_EXTENSIONS)}, {lines()}, "
    + raw_hits([(f"secret-{r.id}", r.severity, r.pattern, False) for r in SECRET_RULES])
    + f""",
scored AS (SELECT *, CASE WHEN {is_doc()} OR {is_test()} OR st IN ('//', '/*') OR {jsx('path', 'line', 'before')} THEN 0.05
  WHEN st <> '' AND {display('line', 'before')} THEN 0.05 WHEN {fake('found')} THEN 0.1
  WHEN st <> '' THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence FROM judged WHERE {SECRET_CONTEXT})
SELECT repo_id, id, severity, path AS file, cast(i + 1 AS int) AS line, confidence FROM scored WHERE confidence >= 0.35"""
)
TOKEN = next(r.pattern for r in SECRET_RULES if r.id == "token-assignment")
O["secret_tokens_in_text"] = (
    f"SELECT doc_id, value FROM (SELECT doc_id, regexp_extract(found, {q(TOKEN_VALUE)}, 1) AS value FROM "
    f"(SELECT doc_id, unnest(regexp_extract_all(text, {q(TOKEN)})) AS found FROM documents)) WHERE NOT {fake('value')}"
)

# ── webhooks ────────────────────────────────────────────────────────────────────

ENDPOINTS = [
    (f"webhook-unverified-{w.provider}", w.severity, e, True)
    for w in WEBHOOK_PROVIDERS
    for e in w.endpoints
]
NO_COMMENTS = (
    "array_to_string(list_transform(string_split(content, chr(10)), lambda l: "
    "regexp_replace(regexp_replace(l, '//[^\\r]*$', ''), '/\\*[^\\r]*?\\*/', '', 'g')), chr(10))"
)
PROOF = " ".join(
    f"WHEN id = {q('webhook-unverified-' + w.provider)} THEN {has('code', *w.proofs)}" for w in WEBHOOK_PROVIDERS
)
O["webhook_unverified"] = (
    f"{SRC_MODULE}, "
    + raw_hits(ENDPOINTS, HANDLER)
    + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, id, pat ORDER BY i) AS rn FROM judged),
first_ones AS (SELECT *, {NO_COMMENTS} AS code FROM ranked WHERE rn = 1 AND NOT {is_doc()} AND NOT {is_test()}
  AND st NOT IN ('//', '/*') AND NOT {jsx('path', 'line', 'before')} AND NOT (st <> '' AND {display('line', 'before')}))
SELECT repo_id, id, severity, path AS file, cast(i + 1 AS int) AS line, 0.9::DOUBLE AS confidence
FROM first_ones WHERE NOT CASE {PROOF} END"""
)
SUCCESS = has("line", *webhooks.SUCCESS_EVENTS)
O["webhook_missing_failure"] = f"{SRC_MODULE} " + line_rule(
    "webhook-missing-failure-handler", "critical", SUCCESS,
    f"{HANDLER} AND contains(lower(content), 'stripe') AND (contains(lower(path), 'webhook') OR contains(lower(content), 'webhook')) "
    f"AND NOT {has('content', *webhooks.FAILURE_EVENTS)}",
)
O["webhook_exec"] = (
    f"{SRC_MODULE}, "
    + raw_hits(
        [("webhook-command-injection", "critical", webhooks.EXEC_CALL, False)],
        f"{HANDLER} AND contains(lower(content), 'webhook')",
    )
    + f""" SELECT repo_id, id, severity, path AS file, cast(i + 1 AS int) AS line, 1.0::DOUBLE AS confidence
FROM judged, range({len(WEBHOOK_PROVIDERS)}) WHERE {LIVE}"""
)

# ── authentication set-up ───────────────────────────────────────────────────────

FRONT = "NOT contains(path, 'server') AND NOT contains('/' || path, 'api/')"
LOGIN = line_rule(
    "auth-no-rate-limit", "warning",
    f"{rx('line', auth.LOGIN_PATH)} AND {rx('line', auth.LOGIN_METHOD)}",
    f"NOT {has('content', *auth.LIMITER_WORDS)}",
)
O["auth_session_rules"] = f"""{SRC_SCRIPT},
stops AS ({LOGIN}),
others AS ({line_rule('auth-getsession-frontend', 'critical', rx('line', auth.GET_SESSION), FRONT, False)}
  UNION ALL {line_rule('auth-localstorage-session', 'warning', rx('line', auth.STORED_SESSION, True), first=False)})
SELECT * FROM stops UNION ALL SELECT o.* FROM others o LEFT JOIN stops s ON o.repo_id = s.repo_id AND o.file = s.file
WHERE s.line IS NULL OR o.line <= s.line"""
RESET = any_of(rx("path", auth.RESET_PATH, True), rx("content", auth.RESET_TEXT, True))
O["password_reset_rules"] = f"{SRC_SCRIPT} " + " UNION ALL ".join(
    [
        line_rule(
            "auth-weak-reset-token", "critical", rx("line", auth.RANDOM_CALL),
            f"{RESET} AND {rx('content', auth.RANDOM_TOPIC, True)}", False,
        ),
        line_rule(
            "auth-reset-token-no-expiry", "warning", rx("line", auth.URL_TOKEN),
            f"{RESET} AND NOT {rx('content', auth.EXPIRY_WORDS, True)}", False,
        ),
        line_rule(
            "auth-reset-no-rate-limit", "warning", rx("line", auth.RESET_LINE, True),
            f"{RESET} AND {rx('content', auth.RESET_ROUTE, True)} AND NOT {rx('content', auth.RESET_LIMITER, True)}",
        ),
        file_rule(
            "auth-reset-token-reuse", "warning",
            f"{RESET} AND contains(content, 'token') AND {rx('content', auth.RESET_TOPIC, True)} "
            f"AND {rx('content', auth.TOKEN_LOOKUP, True)} AND NOT {rx('content', auth.TOKEN_INVALIDATED, True)}",
        ),
    ]
)
O["auth_provider"] = f"""WITH {FILES}, {IGNORED}, named AS (
  SELECT repo_id, path, CASE WHEN contains(content, '@clerk/') THEN 'clerk'
    WHEN contains(content, 'next-auth') OR contains(content, 'NextAuth') THEN 'nextauth'
    WHEN contains(content, 'supabase') AND contains(content, 'auth') THEN 'supabase'
    WHEN contains(content, 'firebase') AND contains(content, 'auth') THEN 'firebase' END AS provider
  FROM files WHERE ({one_of(ext(), SCRIPT + ('.json',))} OR starts_with({base()}, '.env')){WALK_ONLY})
SELECT repo_id, provider, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn
  FROM named WHERE provider IS NOT NULL) WHERE rn = 1"""

# ── application rules ───────────────────────────────────────────────────────────

PAYMENT = f"({rx('line', app.PAYMENT_PATH, True)} AND {rx('line', app.PAYMENT_METHOD)})"
POST = any_of(*[rx("line", p) for p in app.POST_ROUTE])
OPEN_ROUTE = (
    f"{APP_GATE} AND {ROUTE} AND NOT {rx('content', app.RATE_LIMIT_WORDS, True)} "
    f"AND NOT {rx('content', app.RATE_LIMIT_PACKAGES)}"
)
FIRST_MULTER = (
    f"list_position(list_transform(string_split(content, chr(10)), lambda l: {rx('l', app.UPLOAD_CALL)}), true)"
)
FIRST_PUBLIC = (
    f"list_position(list_transform(string_split(content, chr(10)), lambda l: {rx('l', app.UPLOAD_PUBLIC)}), true)"
)
UPLOAD = f"{APP_GATE} AND {rx('content', app.UPLOAD_WORDS, True)}"
APP_PARTS = {
    "rate_limit_missing": [
        line_rule("rate-limit-missing-payment", "critical", PAYMENT, OPEN_ROUTE),
        line_rule("rate-limit-missing-post", "warning", f"{POST} AND NOT {PAYMENT}", OPEN_ROUTE),
    ],
    "idor_scope": [
        line_rule(
            "idor-handler-scope", "critical", rx("line", app.OBJECT_ID),
            f"{APP_GATE} AND {rx('content', app.DATABASE_WORDS, True)} AND NOT {rx('content', app.CURRENT_USER)}",
        )
    ],
    "plaintext_password_compare": [
        line_rule(
            "password-plaintext-compare", "critical",
            any_of(*[rx("line", p) for p in app.PASSWORD_COMPARE]), APP_GATE,
        )
    ],
    "upload_rules": [
        file_rule(
            "upload-no-size-limit", "warning",
            f"{UPLOAD} AND NOT {rx('content', app.UPLOAD_LIMIT, True)} AND {rx('content', app.UPLOAD_CALL)}",
            FIRST_MULTER,
        ),
        file_rule(
            "upload-no-type-filter", "warning",
            f"{UPLOAD} AND NOT {rx('content', app.UPLOAD_FILTER)} AND {rx('content', app.UPLOAD_CALL)}",
            FIRST_MULTER,
        ),
        file_rule(
            "upload-public-dir", "critical", f"{UPLOAD} AND {rx('content', app.UPLOAD_PUBLIC)}", FIRST_PUBLIC
        ),
    ],
    "error_exposed": [
        line_rule(
            "error-stack-exposed", "warning", any_of(*[rx("line", p, f) for p, f in app.ERROR_REPLY]), APP_GATE
        )
    ],
    "sensitive_log": [
        line_rule("sensitive-log", "warning", rx("line", app.SENSITIVE_LOG, True), APP_GATE)
    ],
    "open_redirect": [
        line_rule(
            "open-redirect", "critical", any_of(*[rx("line", p, True) for p in app.OPEN_REDIRECTS]), APP_GATE
        )
    ],
}
for name, parts in APP_PARTS.items():
    O[name] = f"{SRC_MODULE} " + " UNION ALL ".join(parts)
O["scan_app_security"] = (
    f"SELECT * FROM ({O['auth_rules']}) UNION ALL SELECT * FROM ({SRC_MODULE} "
    + " UNION ALL ".join(p for parts in APP_PARTS.values() for p in parts)
    + ")"
)

# ── data access ─────────────────────────────────────────────────────────────────

O["rls_missing"] = f"""{walk(('.sql',))},
code AS (SELECT repo_id, path, array_to_string(list_transform(string_split(content, chr(10)),
  lambda l: trim(regexp_replace(l, '--[^\\r]*$', ''))), chr(10)) AS code FROM src),
tables AS (SELECT repo_id, path, upper(code) AS u, unnest(regexp_extract_all(code, {q(data_access.CREATE_TABLE)}, 1, 'i')) AS t FROM code)
SELECT repo_id, 'rls-missing-' || t AS id, 'critical' AS severity, path AS file, cast(NULL AS int) AS line, cast(NULL AS double) AS confidence
FROM tables WHERE NOT contains(u, 'ALTER TABLE ' || upper(t) || ' ENABLE ROW LEVEL SECURITY')
  AND NOT contains(u, 'ALTER TABLE PUBLIC.' || upper(t) || ' ENABLE ROW LEVEL SECURITY')"""
O["rls_policy_lines"] = f"{walk(('.sql',))}, {lines()} " + " UNION ALL ".join(
    [
        line_rule("rls-using-true", "critical", rx("line", data_access.USING_TRUE, True), first=False),
        line_rule(
            "rls-auth-role-only", "critical",
            f"{rx('line', data_access.ROLE_ONLY, True)} AND NOT contains(line, 'auth.uid()')", first=False,
        ),
        line_rule("rls-uid-is-not-null", "critical", rx("line", data_access.UID_NOT_NULL, True), first=False),
    ]
)
WINDOW = "array_to_string(string_split(content, chr(10))[i + 1:i + 5], chr(10))"
O["rls_source_lines"] = f"{SRC_SCRIPT} " + " UNION ALL ".join(
    [
        line_rule(
            "rls-select-all-no-filter", "critical",
            f"{rx('line', data_access.SELECT_ALL)} AND NOT contains({WINDOW}, '.eq(') AND NOT contains({WINDOW}, 'user_id')",
            first=False,
        ),
        line_rule("rls-getsession-frontend", "critical", rx("line", auth.GET_SESSION), FRONT, False),
    ]
)
O["check_firebase"] = f"""WITH {FILES}, {IGNORED}, {RESOLVED},
counted AS (SELECT f.* FROM files f JOIN resolved r ON f.repo_id = r.repo_id AND f.path = r.path), {lines('counted')},
found AS ({line_rule('firebase-if-true', 'critical', rx('line', data_access.ALLOW_IF_TRUE, True), first=False)}
  UNION ALL {line_rule('firebase-client-controlled-auth', 'critical', rx('line', data_access.CLIENT_USER_ID, True) + " AND NOT contains(line, 'request.auth')", first=False)}
  UNION ALL {line_rule('firebase-auth-not-null-only', 'critical', rx('trim(line)', data_access.READ_IF_LOGGED_IN, True), first=False)})
SELECT * FROM found UNION ALL
SELECT repo_id, 'firebase-no-rules-file', 'warning', NULL, NULL, NULL FROM files WHERE path = 'firebase.json'
  AND repo_id NOT IN (SELECT repo_id FROM resolved)"""

# ── rule files ──────────────────────────────────────────────────────────────────

RULE_LINES = f"WITH {FILES}, src AS (SELECT * FROM files WHERE {IS_RULES}), {lines()}"


def rules_rule(id_: str, severity: str, condition: str, message: str) -> str:
    return (
        f"{RULE_LINES} SELECT repo_id, {q(id_)} AS id, {q(severity)} AS severity, path AS file, cast(i + 1 AS int) AS line, "
        f"cast(NULL AS double) AS confidence, {message} AS message FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY repo_id, path ORDER BY i) AS rn FROM lines WHERE {condition}) WHERE rn = 1"
    )


AT = "path || ':' || (i + 1)"
HIDDEN_NAME = "CASE " + " ".join(
    f"WHEN contains(line, {q(c)}) THEN {q(f'{n} {u}')}" for c, n, u in rules_files.HIDDEN_CHARACTERS
) + " END"
O["rules_hidden_unicode"] = rules_rule(
    "rules-hidden-unicode", "critical", f"{HIDDEN_NAME} IS NOT NULL",
    f"'Your AI rules file contains hidden characters (' || {HIDDEN_NAME} || ') at ' || {AT} || ' that could be steering your AI coding assistant to write malicious or backdoored code without you knowing. This is a known attack called the Rules File Backdoor. Delete and recreate this file from a trusted source.'",
)
O["rules_base64"] = rules_rule(
    "rules-base64-payload", "critical", rx("line", rules_files.BASE64_RUN),
    f"'Your AI rules file contains a long base64-encoded string at ' || {AT} || '. This could contain hidden malicious instructions. Decode and inspect it before keeping this file.'",
)
UNTRUSTED = (
    f"list_filter(list_transform(regexp_extract_all(line, {q(rules_files.URL_HOST)}, 1), lambda h: lower(h)), "
    "lambda h: NOT "
    + any_of(*[f"h = {q(d)} OR ends_with(h, {q('.' + d)})" for d in rules_files.TRUSTED_HOSTS])
    + ")"
)
O["rules_unknown_url"] = rules_rule(
    "rules-suspicious-url", "warning", f"len({UNTRUSTED}) > 0",
    f"'Your AI rules file references an unknown domain (' || ({UNTRUSTED})[1] || ') at ' || {AT} || '. Verify this URL is legitimate and not a phishing or malware site.'",
)
O["rules_malicious_text"] = rules_rule(
    "rules-malicious-instruction", "critical",
    any_of(
        *[rx("line", p, True) for p in rules_files.INSTRUCTIONS],
        rx("line", r"(disable|ignore)\s+(the\s+)?(scanner|security\s+scanner)", True),
    ),
    f"'Your AI rules file contains an instruction to bypass security scanning at ' || {AT} || '. This is a red flag for a compromised rules file.'",
)

# ── packages ────────────────────────────────────────────────────────────────────

NAMES = (
    "names AS (SELECT DISTINCT repo_id, dep FROM (SELECT repo_id, unnest(json_keys(deps)) AS dep FROM manifests "
    "UNION ALL SELECT repo_id, unnest(json_keys(dev)) FROM manifests))"
)
O["malicious_packages"] = (
    f"WITH {FILES}, {MANIFESTS}, {NAMES}, bad(dep, reason) AS (VALUES "
    + values_list([(q(a), q(b)) for a, b in KNOWN_MALICIOUS])
    + ") SELECT repo_id, 'supply-chain-malicious-' || dep AS id, 'critical' AS severity, "
    "dep || ' is a known malicious package. Reason: ' || reason AS message, "
    "'Remove ' || dep || ' from your dependencies immediately: npm uninstall ' || dep AS fix FROM names JOIN bad USING (dep)"
)
O["typosquats"] = (
    f"WITH {FILES}, {MANIFESTS}, {NAMES}, bad(dep, legit) AS (VALUES "
    + values_list([(q(s), q(k)) for k, v in TYPOSQUATS.items() for s in v])
    + ") SELECT repo_id, 'supply-chain-typosquat-' || dep AS id, 'critical' AS severity, "
    "'\"' || dep || '\" looks like a typosquat of \"' || legit || '\". AI tools sometimes suggest non-existent packages that hackers register.' AS message, "
    "'Replace \"' || dep || '\" with \"' || legit || '\": npm uninstall ' || dep || ' && npm install ' || legit AS fix FROM names JOIN bad USING (dep)"
)
O["suspicious_scripts"] = (
    f"WITH {FILES}, {MANIFESTS} SELECT repo_id, 'supply-chain-suspicious-script' AS id, 'warning' AS severity, "
    "'package.json contains a suspicious pattern: ' || pattern || '. This could exfiltrate data during npm install.' AS message FROM "
    "(SELECT repo_id, CASE "
    + " ".join(f"WHEN {rx('raw', p, True)} THEN {q(p)}" for p in SUSPICIOUS_SCRIPTS)
    + " END AS pattern FROM manifests WHERE deps IS NOT NULL) WHERE pattern IS NOT NULL"
)
SCORE_SEVERITY = (
    "CASE WHEN score IS NULL OR score = '' THEN 'warning' WHEN try_cast(score AS double) >= 7 THEN 'critical' "
    "WHEN try_cast(score AS double) >= 4 THEN 'warning' ELSE 'info' END"
)
O["advisory_severity_and_fix"] = (
    f"SELECT id, {SCORE_SEVERITY} AS severity, fixed AS fix_version FROM ({derived.advisories_sql(False)})"
)


def version_order(v: str) -> str:
    """List key: numbers as (length, digits) without zeros behind, a release flag, the identifiers."""
    core = f"regexp_extract({v}, '^[vV]?([0-9]+([.][0-9]+)*)', 1)"
    pre = f"regexp_extract({v}, '^[vV]?[0-9]+(?:[.][0-9]+)*-([0-9A-Za-z.-]+)', 1)"
    bare = "regexp_replace(p, '^0+', '')"
    numbers = (
        f"list_transform(string_split(regexp_replace({core}, '([.]0+)+$', ''), '.'), lambda p: {{'n': length({bare}), 'd': {bare}}})"
    )
    ids = (
        f"list_transform(string_split({pre}, '.'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') "
        f"THEN {{'w': 0, 'n': length({bare}), 't': {bare}}} ELSE {{'w': 1, 'n': 0, 't': p}} END)"
    )
    return f"{{'n': {numbers}, 'r': CASE WHEN {pre} = '' THEN 1 ELSE 0 END, 'p': CASE WHEN {pre} = '' THEN [] ELSE {ids} END}}"


O["vulnerable_dependencies"] = f"""WITH {FILES}, {MANIFESTS}, {DEPENDENCIES},
versions AS (SELECT repo_id, name, version FROM (SELECT repo_id, name, {CLEAN} AS version FROM deps) WHERE version NOT IN ('', '*', 'latest')),
advisories AS ({derived.advisories_sql(False)})
SELECT repo_id, 'dep-' || id AS id, {SCORE_SEVERITY} AS severity, id || ' in ' || name || '@' || version AS title,
  coalesce(summary, 'Known vulnerability in ' || name || '@' || version) AS message,
  CASE WHEN fixed IS NULL THEN 'Check ' || id || ' for remediation.' ELSE 'Upgrade ' || name || ' to ' || fixed || ': npm install ' || name || '@' || fixed END AS fix
FROM versions JOIN advisories ON package = name
WHERE regexp_matches(version, '^[vV]?[0-9]') AND {version_order('version')} >= {version_order('introduced')} AND (fixed IS NULL OR {version_order('version')} < {version_order('fixed')})
UNION ALL SELECT repo_id, 'deps-no-package-json', 'info', 'No dependencies found', 'No package.json or no dependencies listed.', NULL
FROM (SELECT DISTINCT repo_id FROM files) WHERE repo_id NOT IN (SELECT repo_id FROM manifests WHERE deps IS NOT NULL)"""
O["first_n_dependencies"] = f"""WITH {FILES}, {MANIFESTS},
listed AS (SELECT repo_id, unnest(k) AS dep, unnest(range(len(k))) AS pos FROM
  (SELECT repo_id, coalesce(json_keys(deps), []) || coalesce(json_keys(dev), []) AS k FROM manifests)),
firsts AS (SELECT repo_id, dep, min(pos) AS pos FROM listed GROUP BY ALL)
SELECT repo_id, cast(rn - 1 AS int) AS position, dep FROM
  (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS rn FROM firsts) WHERE rn <= 20"""
O["dependency_limit_notice"] = (
    f"WITH {FILES}, {MANIFESTS}, {NAMES} SELECT repo_id, 'supply-chain-limit' AS id, 'Checked 20 of ' || n || ' dependencies' AS title, "
    "'Free tier checks the first 20 dependencies. Upgrade to Pro to check all ' || n || '.' AS message FROM "
    "(SELECT repo_id, count(*) AS n FROM names GROUP BY repo_id) WHERE n > 20"
)
HEADER_ROWS = [(q(h[0]), q(h[1]), q(h[2]), q(h[3])) for h in headers.REQUIRED_HEADERS]
O["missing_headers"] = f"""WITH responses AS ({derived.responses_sql(False)}), required(key, name, severity, fix) AS (VALUES {values_list(HEADER_ROWS)}),
given AS (SELECT page_id, lower(k) AS key, v FROM (SELECT page_id, unnest(map_keys(headers)) AS k, unnest(map_values(headers)) AS v FROM responses)),
missing AS (SELECT page_id, url, r.* FROM responses, required r WHERE error IS NULL AND NOT EXISTS
  (SELECT 1 FROM given g WHERE g.page_id = responses.page_id AND g.key = r.key AND g.v <> ''))
SELECT url, 'header-missing-' || key AS id, severity, 'Missing ' || name || ' header' AS title,
  'The deployed site at ' || url || ' is missing the ' || name || ' security header.' AS message, fix FROM missing
UNION ALL SELECT url, 'header-all-present', 'passed', 'All security headers present',
  'All 6 recommended security headers found on ' || url || '.', NULL FROM responses WHERE error IS NULL AND page_id NOT IN (SELECT page_id FROM missing)
UNION ALL SELECT url, 'header-check-failed', 'info', 'Header check failed', 'Could not reach ' || url || ': ' || error
  || '. Make sure the URL is correct and the site is deployed.', NULL FROM responses WHERE error IS NOT NULL"""

# ── repository state ────────────────────────────────────────────────────────────

ENV_NAMES = "('.env', '.env.local', '.env.production', '.env.development')"
O["env_ignore_gaps"] = f"""WITH {FILES}, {TRACKED}, present AS (SELECT repo_id, path FROM files WHERE path IN {ENV_NAMES}),
ignores AS (SELECT repo_id, content FROM files WHERE path = '.gitignore')
SELECT DISTINCT repo_id, 'env-no-gitignore' AS id, 'info' AS severity, '.gitignore' AS file, cast(NULL AS int) AS line, cast(NULL AS double) AS confidence
FROM files WHERE repo_id NOT IN (SELECT repo_id FROM ignores)
UNION ALL SELECT p.repo_id, 'env-not-gitignored-' || path, 'critical', '.gitignore', NULL, NULL FROM present p LEFT JOIN ignores g USING (repo_id)
WHERE content IS NULL OR NOT {covered('path')}
UNION ALL SELECT repo_id, 'env-tracked-by-git-' || path, 'critical', path, NULL, NULL FROM present p
WHERE EXISTS (SELECT 1 FROM tracked t WHERE t.repo_id = p.repo_id AND t.path = p.path)"""
O["git_ignore_gaps"] = f"""WITH {FILES}, {TRACKED}, repos AS (SELECT DISTINCT repo_id FROM files),
git AS (SELECT DISTINCT repo_id FROM tracked), ignores AS (SELECT repo_id, content FROM files WHERE path = '.gitignore'),
names(name) AS (VALUES ('.env'), ('.env.local'), ('.env.production'))
SELECT repo_id, 'git-not-a-repo' AS id, 'info' AS severity, 'This directory is not a git repository. Git-specific checks skipped.' AS message
FROM repos WHERE repo_id NOT IN (SELECT repo_id FROM git)
UNION ALL SELECT repo_id, 'git-no-gitignore', 'info', 'Project has no .gitignore. Secrets and build artifacts may be committed.'
FROM git WHERE repo_id NOT IN (SELECT repo_id FROM ignores)
UNION ALL SELECT repo_id, 'git-gitignore-missing-' || name, 'warning', name || ' is not listed in .gitignore. It may be committed with secrets.'
FROM ignores JOIN git USING (repo_id), names WHERE NOT {covered('name')}"""
O["git_tracked"] = f"""WITH {FILES}, {TRACKED}
SELECT DISTINCT repo_id, 'git-env-tracked' AS id, 'critical' AS severity, '.env has been committed to git. Even after adding to .gitignore, it persists in history.' AS message
FROM tracked WHERE path = '.env' OR starts_with(path, '.env/')
UNION ALL SELECT DISTINCT repo_id, 'git-node-modules-tracked', 'warning', 'node_modules is tracked by git. This bloats the repository and may contain sensitive files.'
FROM tracked WHERE path = 'node_modules' OR starts_with(path, 'node_modules/')"""
SHAPES = values_list([(q(label), q(p)) for label, p in HISTORY_SHAPES])
HISTORY = f"""WITH commit_lines AS ({derived.COMMIT_LINES_SQL}), shapes(label, pat) AS (VALUES {SHAPES}),
found AS (SELECT repo_id, label, commit, ts, row_number() OVER (PARTITION BY repo_id, label ORDER BY ts, commit) AS rn
  FROM commit_lines, shapes WHERE op IN ('+', '-') AND regexp_matches(line, pat))"""
O["git_history_secrets"] = (
    f"{HISTORY} SELECT repo_id, 'git-history-secret-' || regexp_replace(label, '[^a-zA-Z0-9]', '', 'g') AS id, "
    "'critical' AS severity, 'Secret found in git history: ' || label || '...' AS title FROM found WHERE rn = 1"
)
O["git_history_commits"] = f"{HISTORY} SELECT repo_id, label, commit, ts FROM found WHERE rn = 1"

# ── findings ────────────────────────────────────────────────────────────────────


def dim(name: str, table: dict[str, str]) -> str:
    return f"{name}(k, t) AS (VALUES {values_list([(q(a), q(b)) for a, b in table.items()])})"


CONSEQUENCES = ", ".join(
    [
        dim("by_id", texts.ID_CONSEQUENCES),
        dim("by_category", texts.CATEGORY_CONSEQUENCES),
        dim("by_scanner", texts.SCANNER_CONSEQUENCES),
    ]
)
CONSEQUENCE_JOINS = (
    "LEFT JOIN by_id a ON a.k = f.id LEFT JOIN by_category b ON b.k = f.category LEFT JOIN by_scanner c ON c.k = f.scanner"
)
O["finding_consequence"] = (
    f"WITH {FINDINGS}, {CONSEQUENCES} SELECT repo_id, message, coalesce(a.t, b.t, c.t, title) AS consequence FROM findings f {CONSEQUENCE_JOINS}"
)
LABELS = {k: v for k, v in texts.PASSED_LABELS.items() if k != "check_headers"}
O["passed_checks"] = f"""WITH {FINDINGS}, {REPOS}, {dim('labels', LABELS)}
SELECT repo_id, k AS scanner, t AS label FROM repos r, labels l WHERE NOT EXISTS
  (SELECT 1 FROM findings f WHERE f.repo_id = r.repo_id AND f.scanner = l.k AND severity IN ('critical', 'warning'))"""


def penalty_case() -> str:
    arms = []
    for ids, prefixes, categories, points in texts.PENALTY_RULES:
        tests = ([one_of("id", ids)] if ids else []) + [f"starts_with(id, {q(p)})" for p in prefixes]
        tests += [one_of("category", categories)] if categories else []
        arms.append(f"WHEN {any_of(*tests)} THEN {points}")
    return "CASE " + " ".join(arms) + " WHEN severity = 'critical' THEN 15 ELSE 5 END"


PENALTY = f"CASE severity WHEN 'passed' THEN 0 WHEN 'info' THEN 1 ELSE {penalty_case()} * coalesce(confidence, 1) END"
O["finding_penalty"] = f"WITH {FINDINGS} SELECT repo_id, message, cast({PENALTY} AS double) AS penalty FROM findings"


def grade_case(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN {q(g)}" for low, g in texts.GRADES) + " END"


def meaning_case(grade: str) -> str:
    return "CASE " + " ".join(f"WHEN {grade} = {q(g)} THEN {q(m)}" for g, m in texts.GRADE_MEANINGS.items()) + " END"


COUNTS = ", ".join(f"count(*) FILTER (severity = {q(s)}) AS {s}" for s in ("critical", "warning", "info", "passed"))
O["audit_score"] = f"""WITH {FINDINGS}, {REPOS}, sums AS (SELECT repo_id, sum(cast({PENALTY} AS decimal(18, 6))) AS lost, {COUNTS} FROM findings GROUP BY repo_id),
scored AS (SELECT repo_id, cast(greatest(0, floor(100 - coalesce(lost, 0) + 0.5)) AS int) AS score, coalesce(critical, 0) AS critical,
  coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(passed, 0) AS passed FROM repos LEFT JOIN sums USING (repo_id)),
graded AS (SELECT *, {grade_case('score')} AS grade FROM scored)
SELECT *, {meaning_case('grade')} AS meaning FROM graded"""
O["score_grades"] = (
    f"SELECT event_id, grade, {meaning_case('grade')} AS meaning FROM "
    f"(SELECT event_id, {grade_case('(event_id % 101)')} AS grade FROM events)"
)
O["summarize_findings"] = f"WITH {FINDINGS} SELECT repo_id, {COUNTS} FROM findings GROUP BY repo_id"
SCANNER_ORDER = "list_position([" + ", ".join(
    q(s)
    for s in (
        "scan_secrets", "check_env", "check_git", "check_auth_config", "scan_webhooks", "scan_injection",
        "check_cors", "check_supply_chain", "scan_dependencies", "check_supabase_rls", "check_firebase",
        "scan_app_security", "scan_rules_files", "check_headers",
    )
) + "], scanner)"
ORDER = f"{SCANNER_ORDER}, coalesce(file, ''), coalesce(line, 0), id, message"
ACTIONABLE = "severity IN ('critical', 'warning')"
O["numbered_findings"] = (
    f"WITH {FINDINGS}, {CONSEQUENCES} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, {ORDER}) AS number, "
    f"severity, scanner, id, message, coalesce(a.t, b.t, c.t, title) AS consequence FROM findings f {CONSEQUENCE_JOINS} WHERE {ACTIONABLE}"
)
HEAD = " || chr(10) || ".join(q(line) for line in texts.PROMPT_HEAD)
O["fix_prompt"] = f"""WITH {FINDINGS}, {REPOS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {ORDER}) AS n FROM findings WHERE {ACTIONABLE}),
items AS (SELECT repo_id, n, cast((n - 1) // 60 AS int) AS part, n || '. ' || title || chr(10)
  || CASE WHEN file IS NULL THEN '' ELSE '   Where: ' || file || CASE WHEN line IS NULL OR line = 0 THEN '' ELSE ':' || line END || chr(10) END
  || CASE WHEN fix IS NULL THEN '' ELSE '   Suggested direction: ' || fix || chr(10) END AS item FROM numbered),
bodies AS (SELECT repo_id, part, string_agg(item, chr(10) ORDER BY n) AS body FROM items GROUP BY ALL),
sizes AS (SELECT repo_id, max(part) + 1 AS parts FROM bodies GROUP BY repo_id)
SELECT repo_id, coalesce(part, 0) AS part, coalesce(parts, 1) AS parts, CASE WHEN part IS NULL THEN {q(texts.PROMPT_CLEAN)} ELSE
  CASE WHEN part = 0 THEN {HEAD} || chr(10) ELSE '' END || body || CASE WHEN part = parts - 1 THEN chr(10) || {q(texts.PROMPT_TAIL)} ELSE '' END END AS text
FROM repos LEFT JOIN sizes USING (repo_id) LEFT JOIN bodies USING (repo_id)"""
O["top_findings"] = (
    f"WITH {FINDINGS} SELECT repo_id, scanner, cast(rn AS int) AS rank, id, message, total, greatest(total - 3, 0) AS hidden FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY repo_id, scanner ORDER BY {ORDER}) AS rn, count(*) OVER (PARTITION BY repo_id, scanner) AS total FROM findings) WHERE rn <= 3"
)
O["redacted_counts"] = (
    f"WITH {FINDINGS} SELECT repo_id, scanner, count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, "
    "count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM findings WHERE severity <> 'passed' GROUP BY ALL"
)
O["union_scans"] = (
    f"WITH {FINDINGS} SELECT repo_id, scanner, id, message FROM findings WHERE scanner IN ('check_cors', 'check_env', 'check_git') "
    "UNION ALL SELECT repo_id, scanner, id, message FROM findings WHERE scanner = 'check_cors'"
)
O["dedup_findings"] = (
    f"WITH {FINDINGS} SELECT repo_id, file, line, id, message FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, coalesce(file, ''), "
    f"coalesce(cast(line AS varchar), ''), id ORDER BY {ORDER}) AS rn FROM findings WHERE {ACTIONABLE}) WHERE rn = 1"
)
O["actionable_filter"] = f"WITH {FINDINGS} SELECT repo_id, id, message FROM findings WHERE {ACTIONABLE}"
O["first_per_rule"] = (
    f"WITH {FINDINGS} SELECT repo_id, file AS path, id AS rule, min(line) AS line FROM findings WHERE line IS NOT NULL GROUP BY ALL"
)

# ── combined scans ──────────────────────────────────────────────────────────────

CODE_SCANNERS = {
    "scan_secrets": ("scan_secrets",),
    "check_env": ("env_public_secret",),
    "check_auth_config": ("auth_session_rules", "password_reset_rules"),
    "scan_webhooks": ("webhook_unverified", "webhook_missing_failure", "webhook_exec"),
    "scan_injection": ("scan_injection",),
    "check_cors": ("check_cors",),
    "check_supabase_rls": ("rls_missing", "rls_policy_lines", "rls_source_lines"),
    "check_firebase": ("check_firebase",),
    "scan_app_security": ("scan_app_security",),
    "scan_rules_files": (
        "rules_hidden_unicode", "rules_base64", "rules_unknown_url", "rules_malicious_text",
    ),
}
CODE_FINDINGS = " UNION ALL ".join(
    f"SELECT repo_id, {q(scanner)} AS scanner, id, severity, file, line, confidence FROM ({O[name]})"
    for scanner, names in CODE_SCANNERS.items()
    for name in names
)
O["code_findings"] = f"SELECT repo_id, scanner, id, severity, file, line FROM ({CODE_FINDINGS})"

SUPPLY = " UNION ALL ".join(
    f"SELECT repo_id, id, severity, NULL AS confidence FROM ({O[n]})"
    for n in ("malicious_packages", "typosquats", "suspicious_scripts", "vulnerable_dependencies",
              "env_ignore_gaps", "git_ignore_gaps", "git_tracked", "git_history_secrets")
)
O["audit_scores"] = f"""WITH findings AS MATERIALIZED (SELECT *, '' AS category FROM (
  SELECT repo_id, id, severity, confidence FROM ({CODE_FINDINGS}) UNION ALL {SUPPLY}
  UNION ALL SELECT repo_id, 'supply-chain-no-package-json', 'info', NULL FROM (WITH {FILES}, {MANIFESTS}
    SELECT DISTINCT repo_id FROM files WHERE repo_id NOT IN (SELECT repo_id FROM manifests WHERE valid)))),
repos AS (WITH {FILES} SELECT DISTINCT repo_id FROM files),
sums AS (SELECT repo_id, sum(cast({PENALTY} AS decimal(18, 6))) AS lost, {COUNTS} FROM findings GROUP BY repo_id),
scored AS (SELECT repo_id, cast(greatest(0, floor(100 - coalesce(lost, 0) + 0.5)) AS int) AS score, coalesce(critical, 0) AS critical,
  coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(passed, 0) AS passed FROM repos LEFT JOIN sums USING (repo_id))
SELECT *, {grade_case('score')} AS grade FROM scored"""

# ── changes ─────────────────────────────────────────────────────────────────────

NAME, EXT = f"lower({base()})", ext()
SOURCE = one_of(EXT, (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"))
O["route_change"] = f"""WITH {FILES} SELECT repo_id, path, scanner FROM (SELECT repo_id, path, unnest(list_filter([
  'scan_secrets', 'scan_injection', CASE WHEN {SOURCE} THEN 'scan_webhooks' END,
  CASE WHEN {SOURCE} OR {EXT} = '.sql' THEN 'check_supabase_rls' END,
  CASE WHEN starts_with({NAME}, '.env') OR {NAME} = '.gitignore' THEN 'check_env' END,
  CASE WHEN {NAME} IN ('package.json', 'package-lock.json') THEN 'check_supply_chain' END,
  CASE WHEN {NAME} IN ('package.json', 'package-lock.json') THEN 'scan_dependencies' END,
  CASE WHEN {NAME} = 'firebase.json' OR ends_with({NAME}, '.rules') THEN 'check_firebase' END,
  CASE WHEN {NAME} IN ('.cursorrules', '.windsurfrules', '.antigravityrules', 'claude.md', '.mcp.json') OR {EXT} = '.rules' THEN 'scan_rules_files' END
], lambda x: x IS NOT NULL)) AS scanner FROM files)"""


def single_file(sql: str) -> str:
    """The same scan with every file as its own target: only its name counts."""
    return sql.replace(WALK_ONLY, "").replace(is_test(), is_test(base()))


CHANGED = " UNION ALL ".join(
    f"SELECT {q(scanner)} AS scanner, repo_id, id, severity, file, line, confidence FROM ({single_file(O[name])})"
    for scanner in ("scan_secrets", "scan_injection", "scan_webhooks", "check_supabase_rls")
    for name in CODE_SCANNERS[scanner]
)
NUMBERED_FILES = derived.files_sql().replace("SELECT ", "SELECT doc_id, ", 1)
O["scan_changes"] = f"""WITH numbered_files AS MATERIALIZED ({NUMBERED_FILES}), changes AS ({derived.CHANGES_SQL}),
found AS ({CHANGED}), routes AS ({O['route_change']})
SELECT c.ts, f.repo_id, f.id, f.severity, f.file, f.line, f.confidence FROM found f
JOIN changes c ON c.repo_id = f.repo_id AND c.path = f.file
JOIN routes r ON r.repo_id = f.repo_id AND r.path = f.file AND r.scanner = f.scanner
WHERE f.severity IN ('critical', 'warning')"""
O["stream_dedup"] = f"SELECT DISTINCT repo_id, file, line, id FROM ({O['scan_changes']})"

RELATED = " UNION ALL ".join(
    f"SELECT {q(scanner)} AS scanner, repo_id, id, severity, {file} AS file, {line} AS line FROM ({O[name]})"
    for scanner, name, file, line in (
        ("check_env", "env_public_secret", "file", "line"),
        ("check_env", "env_ignore_gaps", "file", "line"),
        ("check_firebase", "check_firebase", "file", "line"),
        *[("scan_rules_files", name, "file", "line") for name in CODE_SCANNERS["scan_rules_files"]],
        *[("check_supply_chain", name, "'package.json'", "NULL") for name in ("malicious_packages", "typosquats", "suspicious_scripts")],
        ("scan_dependencies", "vulnerable_dependencies", "'package.json'", "NULL"),
    )
)
O["scan_changes_stream"] = f"""WITH numbered_files AS MATERIALIZED ({NUMBERED_FILES}), changes AS ({derived.CHANGES_SQL}),
own AS ({CHANGED}), related AS ({RELATED}), routes AS ({O['route_change']}),
routed AS (SELECT c.ts, c.repo_id, c.path AS changed, r.scanner FROM changes c JOIN routes r USING (repo_id, path)),
found AS (
  SELECT r.ts, r.changed, f.repo_id, f.scanner, f.id, f.severity, f.file, f.line FROM own f
  JOIN routed r ON r.repo_id = f.repo_id AND r.changed = f.file AND r.scanner = f.scanner
  UNION ALL
  SELECT r.ts, r.changed, f.repo_id, f.scanner, f.id, f.severity, f.file, f.line FROM related f
  JOIN routed r ON r.repo_id = f.repo_id AND r.scanner = f.scanner)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, changed, ts, coalesce(file, ''), coalesce(cast(line AS varchar), ''), id
    ORDER BY {SCANNER_ORDER}) AS rn
  FROM found WHERE severity IN ('critical', 'warning')) WHERE rn = 1"""
