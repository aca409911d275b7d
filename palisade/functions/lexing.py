"""Lexical state of a position in C-family source text, as Column expressions.

States are named by their opener: ``''`` code, ``//`` and ``/*`` comments, and the
quote character of a string.

Asking "is this hit inside a comment?" by lexing from the start of the file costs
(hits x file size).  Here a file is tokenised once: every line break inside a block
comment or a multi-line string gets a marker naming the opener, so that after
splitting each line knows the state it starts in.  A hit then only lexes its own line,
and a whole file costs one linear pass whatever the number of hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"

_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+"
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+'
_BACKTICK = r"`[^`\\]*+(?:\\.[^`\\]*+)*+"

# Complete tokens are consumed; only an unterminated last one fills group 1.
_OPEN_TOKEN = (
    rf"(?s)//[^\n]*+\n|{_BLOCK}|{_SINGLE}['\n]|{_DOUBLE}[\"\n]|{_BACKTICK}`"
    r"|(//|/\*|['\"`]).*+"
)
# Every piece of the text, so that the pieces join back to the text.  The line break
# that ends an unterminated quote is left to the next piece.
_PIECE = (
    rf"(?s)//[^\n]*+|{_BLOCK}|{_SINGLE}(?:'|(?=\n)|\\?\z)|{_DOUBLE}(?:\"|(?=\n)|\\?\z)"
    rf"|{_BACKTICK}(?:`|\\?\z)|/\*.*+|[^/'\"`]++|/"
)
_STRING_PIECE = (
    r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|"
    rf"{_BACKTICK}`|(['\"`].*+)"
)


def state_after(text: Column, next_char: Column) -> Column:
    """State right after ``text``.

    A two-character delimiter split by the position counts as read, so the next
    character joins the text when it completes ``//``, ``/*`` or ``*/``.
    """
    pair = F.concat(F.substring(text, -1, 1), next_char)
    whole = F.concat(text, F.when(pair.isin("//", "/*", "*/"), next_char).otherwise(""))
    return F.coalesce(
        F.try_element_at(F.regexp_extract_all(whole, F.lit(_OPEN_TOKEN), F.lit(1)), F.lit(-1)),
        F.lit(""),
    )


def lex_state(content: Column, offset: Column) -> Column:
    """State at a 0-based character offset of ``content``."""
    return state_after(
        F.substring(content, F.lit(1), offset), F.substring(content, offset + 1, F.lit(1))
    )


def state_in_line(line_state: Column, before: Column, line: Column) -> Column:
    """State at the column after ``before`` on a line that starts in ``line_state``."""
    following = F.substring(line, F.length(before) + 1, F.lit(1))
    pair = F.concat(F.substring(before, -1, 1), following)
    whole = F.concat(
        line_state, before, F.when(pair.isin("//", "/*", "*/"), following).otherwise("")
    )
    return F.coalesce(
        F.try_element_at(F.regexp_extract_all(whole, F.lit(_OPEN_TOKEN), F.lit(1)), F.lit(-1)),
        F.lit(""),
    )


def may_span_lines(content: Column) -> Column:
    """Some token could continue on a following line (otherwise every line starts in code)."""
    return content.contains("/*") | content.contains("`") | content.contains("\\\n")


def line_start_states(content: Column) -> Column:
    """Array with the state at the start of every line; linear in the text."""

    def mark(piece: Column) -> Column:
        head = F.substring(piece, 1, 1)
        opener = F.when(F.substring(piece, 1, 2) == "/*", F.lit("/*")).when(
            head.isin("'", '"', "`"), head
        )
        return F.when(
            opener.isNotNull() & piece.contains("\n"),
            F.replace(piece, F.lit("\n"), F.concat(F.lit("\n" + _MARK), opener)),
        ).otherwise(piece)

    neutral = F.when(content.contains(_MARK), F.translate(content, _MARK, " ")).otherwise(content)
    pieces = F.regexp_extract_all(neutral, F.lit(_PIECE), F.lit(0))
    marked = F.array_join(F.transform(pieces, mark), "")
    return F.transform(
        F.split(marked, "\n"),
        lambda text: F.regexp_extract(text, rf"^{_MARK}(/\*|['\"`])", 1),
    )


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


#: Numbers that one block of a running sum adds up, and levels of blocks of blocks above it.
_SUM_BLOCK, _SUM_LEVELS = 64, 3


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _sums_before(values: Column, levels: int = _SUM_LEVELS) -> Column:
    """Sum of the numbers before each number of an array, in time linear in its length.

    Sums of blocks are summed up the same way, and inside a block each number adds up to 63 others.
    """
    nothing = F.lit(0).cast("bigint")

    def total(part: Column) -> Column:
        return F.aggregate(part, nothing, lambda a, x: a + x)

    def inside(part: Column, start: Column) -> Column:
        return F.transform(part, lambda _, i: start + total(F.slice(part, F.lit(1), i)))

    def blocks(numbers: Column) -> Column:
        last = F.floor((F.array_size(numbers) - 1) / _SUM_BLOCK).cast("int")

        def block(b: Column) -> Column:
            return F.slice(numbers, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))

        sums = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: total(block(b)))
        before = _sums_before(sums, levels - 1) if levels else _bound(sums, lambda x: inside(x, nothing))
        return F.flatten(F.transform(before, lambda start, b: _bound(block(b), lambda part: inside(part, start))))

    return _bound(values, blocks)


def line_starts(lines: Column) -> Column:
    """Character offset at which each line starts, one for each line break before it; one pass over the lines."""
    return _sums_before(F.transform(lines, lambda text: (F.length(text) + 1).cast("bigint")))


def match_offset(starts: Column, line_index: Column, column: Column) -> Column:
    """Character offset of (0-based line, 0-based column), given the lines' starts."""
    return F.get(starts, line_index) + column


def enclosing_string(line: Column, before: Column) -> Column:
    """String literal around the position after ``before``, judged by this line alone.

    ``struct(open_column, value)``, or NULL where no literal is open.
    """
    tail = F.coalesce(
        F.try_element_at(
            F.regexp_extract_all(before, F.lit(_STRING_PIECE), F.lit(1)), F.lit(-1)
        ),
        F.lit(""),
    )
    rest = F.substring(line, F.length(before) + 1, F.length(line))
    head = F.substring(tail, 1, 1)
    closing = (
        F.when(head == "'", F.regexp_extract(rest, r"(?s)^([^'\\]*+(?:\\.[^'\\]*+)*+\\?)", 1))
        .when(head == '"', F.regexp_extract(rest, r'(?s)^([^"\\]*+(?:\\.[^"\\]*+)*+\\?)', 1))
        .otherwise(F.regexp_extract(rest, r"(?s)^([^`\\]*+(?:\\.[^`\\]*+)*+\\?)", 1))
    )
    return F.when(
        tail != "",
        F.struct(
            (F.length(before) - F.length(tail)).cast("int").alias("open_column"),
            F.concat(F.substring(tail, F.lit(2), F.length(tail)), closing).alias("value"),
        ),
    )


def is_jsx_text(extension: Column, line: Column, before: Column) -> Column:
    """Between a ``>`` and a ``<`` on a line of a ``.tsx`` / ``.jsx`` file."""
    rest = F.substring(line, F.length(before) + 1, F.length(line))
    return (
        extension.isin(".tsx", ".jsx")
        & before.rlike(r">[^<>]*\z")
        & rest.contains("<")
    )
