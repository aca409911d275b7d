"""Is a match live code or prose?  Confidence, and the severity that follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.lexing import enclosing_string, is_jsx_text
from palisade.functions.values import (
    display_key_before,
    is_placeholder,
    looks_fake,
    looks_like_prose,
)

# Confidence thresholds.
KEEP_CRITICAL = 0.9
KEEP_WARNING = 0.5
EMIT_FLOOR = 0.35

CODE = "code-construct"
SECRET = "secret-value"


def _result(kind: str, prose: Column | bool, example: bool, confidence: float) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        (prose if isinstance(prose, Column) else F.lit(prose)).alias("is_prose"),
        F.lit(example).alias("is_likely_example"),
        F.lit(confidence).alias("confidence"),
    )


def is_display_copy(line: Column, before: Column) -> Column:
    """The literal around the position follows a display key or reads like a sentence."""
    enclosed = enclosing_string(line, before)
    return F.coalesce(
        display_key_before(F.substring(line, F.lit(1), enclosed["open_column"]))
        | looks_like_prose(enclosed["value"]),
        F.lit(False),
    )


def classify_match(
    *,
    is_doc: Column,
    is_test: Column,
    extension: Column,
    line: Column,
    before: Column,
    match: Column,
    state: Column,
    mode: str = CODE,
) -> Column:
    """Ordered gates from file to value; the first that holds decides.

    ``before`` is the text of the line left of the match, ``state`` the lexical state
    there (``lexing.state_in_line``).
    """
    in_string = state.isin("'", '"', "`")
    chain = (
        F.when(is_doc, _result("doc-file", True, True, 0.05))
        .when(is_test, _result("test-fixture", True, True, 0.05))
        .when(state.isin("//", "/*"), _result("comment", True, False, 0.1))
        .when(is_jsx_text(extension, line, before), _result("jsx-text", True, True, 0.05))
    )
    if mode == CODE:
        chain = chain.when(
            in_string, _result("string-literal", is_display_copy(line, before), True, 0.1)
        )
    else:
        chain = (
            chain.when(
                in_string & is_display_copy(line, before),
                _result("string-literal", True, True, 0.05),
            )
            .when(in_string & looks_fake(match), _result("string-literal", False, True, 0.1))
            .when(in_string, _result("string-literal", False, False, 0.95))
        )
    chain = chain.when(is_placeholder(match), _result("code", False, True, 0.2))
    if mode == SECRET:
        chain = chain.when(looks_fake(match), _result("code", False, True, 0.2))
    return chain.otherwise(_result("code", False, False, 1.0))


def emits(confidence: Column) -> Column:
    return confidence >= EMIT_FLOOR


def calibrated_severity(severity: Column, confidence: Column) -> Column:
    """Critical needs high confidence; a doubtful warning is only information."""
    stepped = F.when(
        (severity == "critical") & (confidence < KEEP_CRITICAL), F.lit("warning")
    ).otherwise(severity)
    return F.when(
        (stepped == "warning") & (confidence < KEEP_WARNING), F.lit("info")
    ).otherwise(stepped)


def rounded_confidence(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5) / 100
