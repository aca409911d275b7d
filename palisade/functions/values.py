"""Column functions over matched values: placeholders, entropy, versions, prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.dialect import java_pattern

# Texts that mark a value as a placeholder (pattern, ignoring case).
PLACEHOLDERS = (
    (r"YOUR[_-]?[A-Z0-9]*", True),
    (r"<[^>\s]{2,}>", False),
    (
        r"\b(example|placeholder|redacted|dummy|sample|changeme|change[_-]?me|fake|mock"
        r"|test[_-]?key|todo|tbd|lorem|ipsum|insert[_-]?your)\b",
        True,
    ),
    (r"\b(foo|bar|baz|qux)\b", True),
    (r"\.{3,}", False),
    (r"(.)\1{5,}", False),
    (r"(0123456|1234567|abcdefg|abcdef0)", True),
)
# Fixed value: smallest entropy (bits per character) of a real secret.
MIN_SECRET_ENTROPY = 2.8
# Object keys whose value is text for people.
DISPLAY_KEYS = (
    r"\b(desc|description|title|subtitle|heading|label|name|keywords?|text|content|caption"
    r"|alt|tooltip|summary|tagline|placeholder|message|copy|blurb|excerpt|body|examples?"
    r"|trigger|sample|hint|note)\s*:\s*$"
)
# Three words in a row, or punctuation between words.
PROSE = (r"[A-Za-z]{2,}\s+[A-Za-z]{2,}\s+[A-Za-z]{2,}", r"[A-Za-z]{3,}[.,;:!?]\s+[A-Za-z]")


def is_placeholder(value: Column) -> Column:
    out = F.lit(False)
    for pattern, fold in PLACEHOLDERS:
        out = out | value.rlike(java_pattern(pattern, fold))
    return out


def shannon_entropy(value: Column) -> Column:
    """Bits per character.

    One ``replace`` per distinct character counts it; the length is bound once (each
    ``length`` walks the whole UTF-8 text).  ASCII characters are looked up rather than
    split out, which would make one string object per character of the text.
    """
    ascii_present = F.filter(
        F.array(*[F.lit(chr(code)) for code in range(128)]), lambda c: F.contains(value, c)
    )
    others = F.array_distinct(F.split(F.regexp_replace(value, r"[\x00-\x7f]+", ""), ""))
    distinct = F.concat(ascii_present, F.filter(others, lambda c: c != ""))

    def of_length(size: Column) -> Column:
        counts = F.transform(
            distinct, lambda c: size - F.length(F.replace(value, c, F.lit("")))
        )
        return F.aggregate(
            F.transform(counts, lambda k: k / size),
            F.lit(0.0),
            lambda total, share: total - share * F.log2(share),
        )

    return F.when(value == "", F.lit(0.0)).otherwise(
        F.transform(F.array(F.length(value)), of_length)[0]
    )


def secret_random_part(value: Column) -> Column:
    """The value without a ``word-`` / ``sk_`` style prefix, if eight characters stay."""
    stripped = F.regexp_replace(
        F.regexp_replace(value, r"^[A-Za-z]+[-_]", ""), r"^[A-Za-z]{2,4}_", ""
    )
    return F.when(F.length(stripped) >= 8, stripped).otherwise(value)


def looks_fake(value: Column) -> Column:
    return is_placeholder(value) | (
        shannon_entropy(secret_random_part(value)) < MIN_SECRET_ENTROPY
    )


def looks_like_prose(value: Column) -> Column:
    return value.rlike(java_pattern(PROSE[0])) | value.rlike(java_pattern(PROSE[1]))


def display_key_before(text: Column) -> Column:
    """``text`` (everything before an opening quote) ends with a display key and a colon."""
    return text.rlike(java_pattern(DISPLAY_KEYS, True))


def clean_version(spec: Column) -> Column:
    return F.split_part(F.regexp_replace(spec, r"^[\^~>=<]+", ""), F.lit(" "), F.lit(1))


def _digits(text: Column) -> list[Column]:
    """Digits as something that orders like the number, of any length."""
    bare = F.regexp_replace(text, "^0+", "")
    return [F.length(bare).alias("n"), bare.alias("digits")]


def version_key(version: Column) -> Column:
    """Orderable key of a dotted version: numeric parts, then release over pre-release.

    ``struct(parts, release flag, pre-release identifiers)``.  Parts are as many as the version has, without
    zeros at the end; numbers of any length compare as numbers.  Numeric identifiers come before words, and
    fewer identifiers before more.  NULL for what does not start with a number.
    """
    bare = F.regexp_replace(version, r"^[vV]", "")
    core = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1)
    pre = F.regexp_extract(bare, r"^\d+(?:\.\d+)*-([0-9A-Za-z.-]+)", 1)
    parts = F.transform(
        F.split(F.regexp_replace(core, r"(\.0+)+$", ""), r"\."), lambda p: F.struct(*_digits(p))
    )
    numeric = r"^[0-9]+\z"
    identifiers = F.transform(
        F.split(pre, r"\."),
        lambda p: F.struct(
            F.when(p.rlike(numeric), 0).otherwise(1).alias("word"),
            F.when(p.rlike(numeric), _digits(p)[0]).otherwise(0).alias("n"),
            F.when(p.rlike(numeric), _digits(p)[1]).otherwise(p).alias("text"),
        ),
    )
    return F.when(
        core != "",
        F.struct(
            parts.alias("parts"),
            F.when(pre == "", 1).otherwise(0).alias("release"),
            F.when(pre == "", F.slice(identifiers, 1, 0)).otherwise(identifiers).alias("pre"),
        ),
    )
