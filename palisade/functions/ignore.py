"""Ignore-file entries as patterns, and which names they cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.lexing import lines_of


_SPACE = r"[\s\u00a0\u2000-\u200a\u2028\u2029\u3000\ufeff]+"
JS_TRIM = rf"^{_SPACE}|{_SPACE}\z"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, JS_TRIM, "")


def ignore_entries(content: Column) -> Column:
    """Exact names listed in an ignore file: trimmed, no comments, one final ``/`` cut."""
    trimmed = F.transform(lines_of(content), js_trim)
    kept = F.filter(trimmed, lambda t: (t != "") & ~t.startswith("#"))
    return F.array_distinct(F.transform(kept, lambda t: F.regexp_replace(t, r"/\z", "")))


def ignore_patterns(content: Column) -> Column:
    """Glob lines that can cover a name: comments, blanks and ``!`` lines are skipped."""
    trimmed = F.transform(lines_of(content), js_trim)
    return F.filter(trimmed, lambda t: (t != "") & ~t.rlike(r"^[#!]"))


def ignore_glob_to_regex(pattern: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(js_trim(pattern), r"/\z", ""), r"^/", "")
    quoted = F.regexp_replace(bare, r"[.+^${}()|\[\]\\]", r"\\$0")
    globbed = F.replace(
        F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")
    )
    return F.concat(F.lit("^"), globbed, F.lit(r"\z"))


def ignore_covers(content: Column, name: Column) -> Column:
    """Some pattern of the ignore file covers ``name`` or its base name.

    Evaluated inside the one row that holds the ignore file: no join, no shuffle.
    """
    plain = F.regexp_replace(name, r"^\./", "")
    base = F.substring_index(plain, "/", -1)
    return F.exists(
        ignore_patterns(content),
        lambda p: F.rlike(plain, ignore_glob_to_regex(p)) | F.rlike(base, ignore_glob_to_regex(p)),
    )
