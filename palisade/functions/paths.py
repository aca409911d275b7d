"""Column predicates over repository-relative paths (no content needed)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.dialect import java_pattern

# Directory names that are never entered, default extensions,
# documentation extensions, documentation names, test path patterns.
SKIPPED_DIRECTORIES = (
    "node_modules", ".next", "dist", "build", ".git", "coverage", ".turbo",
    ".vercel", ".output", "__pycache__", "venv", ".venv",
)
DEFAULT_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs",
    ".json", ".yaml", ".yml", ".toml",
    ".sql", ".graphql", ".gql",
    ".env", ".env.local", ".env.production", ".env.development",
    ".py", ".rb", ".go", ".java", ".cs",
    ".html", ".vue", ".svelte",
)
DOC_EXTENSIONS = (".md", ".mdx", ".markdown", ".txt", ".rst", ".adoc")
DOC_NAME = r"^(readme|changelog|contributing|license|notice|authors|code_of_conduct|security|history)\b"
TEST_SEGMENT = (
    r"(^|[\\/])(tests?|__tests__|__mocks__|fixtures?|examples?|samples?|mocks?|docs?"
    r"|stories|e2e|cypress|spec|demo|playground)([\\/]|$)"
)
TEST_NAME = r"\.(test|spec|stories|fixture|mock|sample|example|e2e)\.[cm]?[tj]sx?$"
APP_TEST_NAME = r"\.(test|spec)\.(t|j)sx?$"
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
MODULE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs")

_SKIPPED = "|".join(
    name.replace(".", r"\.") for name in SKIPPED_DIRECTORIES if not name.startswith(".")
)
# A directory segment that starts with a dot (".env" excepted) or is a listed name.
SKIPPED_SEGMENT = re.compile(rf"(?:^|/)(?:\.(?!env/)[^/]*|{_SKIPPED})/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)\z", 1))


def has_extension(path: Column, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> Column:
    """Extension in the list; names that start with ``.env`` always stay."""
    return base_name(path).startswith(".env") | extension(path).isin(*extensions)


def in_skipped_directory(path: Column) -> Column:
    return path.rlike(SKIPPED_SEGMENT.pattern)


def is_doc_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    return extension(path).isin(*DOC_EXTENSIONS) | name.rlike(java_pattern(DOC_NAME))


def is_test_or_example(path: Column) -> Column:
    return path.rlike(java_pattern(TEST_SEGMENT, True)) | base_name(path).rlike(
        java_pattern(TEST_NAME, True)
    )


def is_app_test_file(path: Column) -> Column:
    """Extra exclusion of the application-layer scanner."""
    return path.rlike(java_pattern(APP_TEST_NAME)) | path.contains("__tests__")


# Path fragments and content patterns of request-handling files.
ROUTE_FRAGMENTS = (
    "/api/", "/routes/", "/route.ts", "/route.js", "/handlers/", "/server/", "/controllers/",
)
ROUTE_CONTENT = (
    r"\b(app|router)\.(post|put|patch|delete|get)\s*\(",
    r"export\s+(async\s+)?function\s+(POST|PUT|PATCH|DELETE)\s*\(",
    r"export\s+const\s+(POST|PUT|PATCH|DELETE)\s*=",
)
HANDLER_FRAGMENTS = (
    "/api/", "/server/", "/routes/", "/handlers/", "/functions/", "/pages/api/",
)
HANDLER_NAME = r"route\.[cm]?[tj]s$"
HANDLER_CONTENT = (
    r"\b(app|router)\.(post|put|patch|get|delete|use)\s*\(",
    r"export\s+(async\s+)?function\s+(POST|PUT|PATCH|GET|DELETE)\s*\(",
    r"export\s+const\s+(POST|PUT|PATCH|GET|DELETE)\s*=",
    r"exports\.handler\b",
    r"""addEventListener\s*\(\s*['"`]fetch['"`]""",
    r"""\.on\s*\(\s*['"`]request['"`]""",
)


def _any(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out | column
    return out


def is_route_file(path: Column, content: Column) -> Column:
    """Path fragment (cheap, first) or an express / route-module marker in the text."""
    rooted = F.concat(F.lit("/"), F.lower(path))
    return _any(
        [rooted.contains(f) for f in ROUTE_FRAGMENTS]
        + [content.rlike(java_pattern(p)) for p in ROUTE_CONTENT]
    )


def is_server_handler(path: Column, content: Column) -> Column:
    rooted = F.concat(F.lit("/"), F.lower(path))
    return _any(
        [rooted.contains(f) for f in HANDLER_FRAGMENTS]
        + [rooted.rlike(java_pattern(HANDLER_NAME))]
        + [content.rlike(java_pattern(p)) for p in HANDLER_CONTENT]
    )
