"""The shared scan: many detectors, one pass over the files, no shuffle.

All file-level detectors look at one file at a time, so a scan is a narrow projection:

1. path predicates and size / binary gates drop rows before any text work;
2. one ``contains`` per distinct literal decides which rules can match at all (a cheap
   byte search); a regular expression only runs on files, and then on lines, that hold
   the literals it needs;
3. only for files that passed some gate the text is split into lines and lexed, once;
4. each rule filters the line array with its own *literal* pattern (compiled once per
   task); live-code vetting and "first per rule" are array expressions on the hits.

The result is exploded once.  Nothing is keyed by repository here, so a repository that
holds a third of all files costs no more than its share.

Detectors describe their conditions as SQL text over the staged columns and over a line
``x`` (fields ``i``, ``text``, ``low``, ``state``).  There are about a hundred of them, and
building each from Column calls would take longer than scanning a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import classify, lexing, paths
from palisade.functions.dialect import java_pattern
from palisade.model import HITS

LINES = "array<struct<i:int,text:string,low:string,state:string>>"
RAWS = (
    "array<struct<rule:string,once:boolean,copies:int,line:int,detail:string,severity:string,"
    "text:string,start_state:string,before:string,found:string>>"
)
Needs = Sequence[Sequence[str]]  # all of (any of (literal, ...)), lower case
Detector = Callable[["FileView"], None]


# ── SQL text helpers ────────────────────────────────────────────────────────────


def sql_text(value: str) -> str:
    """SQL string literal of ``value``."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rlike(pattern: str, ignore_case: bool = False, of: str = "x.text") -> str:
    return f"{of} rlike {sql_text(java_pattern(pattern, ignore_case))}"


def any_rlike(patterns: Sequence[tuple[str, bool]], of: str = "x.text") -> str:
    return "(" + " or ".join(rlike(p, fold, of) for p, fold in patterns) + ")"


def contains_any(literals: Sequence[str], of: str = "x.text") -> str:
    return "(" + " or ".join(f"contains({of}, {sql_text(v)})" for v in literals) + ")"


def all_of(*conditions: str) -> str:
    return " and ".join(f"({c})" for c in conditions)


class FileView:
    """What the detectors ask to be staged, and the hits they describe.

    Literals, flags and gates become three columns, each computed once per file.
    """

    def __init__(self) -> None:
        self._literals: dict[str, int] = {}
        self._flags: dict[str, Column] = {}
        self._gates: dict[str, int] = {}
        self._hits: list[str] = []
        self._columns: list[Column] = []
        self._raws: dict[str, list[str]] = {classify.CODE: [], classify.SECRET: []}

    def has(self, literal: str) -> str:
        """The file contains ``literal``, ignoring case (a necessary condition only)."""
        index = self._literals.setdefault(literal.lower(), len(self._literals))
        return f"_literals[{index}]"

    def passes(self, needs: Needs) -> str:
        groups = ["(" + " or ".join(self.has(v) for v in group) + ")" for group in needs]
        return " and ".join(groups) if groups else "true"

    def flag(self, name: str, condition: Callable[[], Column]) -> str:
        """A named condition on the file, staged once for all detectors that use it."""
        if name not in self._flags:
            self._flags[name] = condition()
        return f"_flags.{name}"

    def walks(self, *extensions: str) -> str:
        """Walk rule: extension in the list or an ``.env*`` name, no skipped directory."""
        return self.flag(
            "walk" + "".join(extensions).replace(".", "_"), lambda: walked(extensions)
        )

    def real_code(self, *extensions: str) -> str:
        """The walk rule for files that are neither documentation nor tests."""
        return self.flag(
            "code" + "".join(extensions).replace(".", "_"),
            lambda: walked(extensions) & ~F.col("_doc") & ~F.col("_test"),
        )

    def gate(self, condition: str) -> str:
        """Stage a condition whose files need their lines; returns the staged gate."""
        return f"_gates[{self._gates.setdefault(condition, len(self._gates))}]"

    # ── hits ───────────────────────────────────────────────────────────────────

    def line_hits(
        self,
        rule: str,
        gate: str,
        condition: str,
        *,
        needs: Needs = (),
        first: bool = True,
        detail: str = "null",
    ) -> str:
        """SQL array of the lines that meet a condition (no vetting)."""
        staged = self.gate(all_of(gate, self.passes(needs)))
        found = f"filter(_lines, x -> {_line_has(needs)}{condition})"
        if first:
            found = f"slice({found}, 1, 1)"
        return (
            f"if({staged}, cast(transform({found}, x -> named_struct('rule', {sql_text(rule)}, "
            f"'line', x.i + 1, 'detail', {detail}, 'severity', null, 'confidence', null)) "
            f"as {HITS}), cast(array() as {HITS}))"
        )

    def file_hit(self, rule: str, condition: str, *, line: str = "null") -> str:
        """SQL array with at most one hit for a condition on the whole file."""
        return (
            f"if({self.gate(condition)}, cast(array(named_struct('rule', {sql_text(rule)}, "
            f"'line', {line}, 'detail', null, 'severity', null, 'confidence', null)) "
            f"as {HITS}), cast(array() as {HITS}))"
        )

    def raw_matches(
        self,
        rule: str,
        pattern: str,
        gate: str,
        *,
        needs: Needs = (),
        ignore_case: bool = True,
        once: bool = True,
        only_first_line: bool = False,
        copies: int = 1,
        also: str = "true",
        detail: str = "null",
        severity: str = "null",
    ) -> str:
        """SQL array of first matches per line, with the text left of each, not vetted."""
        staged = self.gate(all_of(gate, self.passes(needs)))
        compiled = java_pattern(pattern, ignore_case)
        matched, leading = sql_text(compiled), sql_text(f"^((?s:.*?))(?:{compiled})")
        found = f"filter(_lines, x -> {_line_has(needs)}x.text rlike {matched} and {also})"
        if only_first_line:
            found = f"slice({found}, 1, 1)"
        return (
            f"if({staged}, cast(transform({found}, x -> named_struct("
            f"'rule', {sql_text(rule)}, 'once', {str(once).lower()}, 'copies', {copies}, "
            f"'line', x.i, 'detail', {detail}, 'severity', {severity}, 'text', x.text, "
            f"'start_state', x.state, 'before', regexp_extract(x.text, {leading}, 1), "
            f"'found', regexp_extract(x.text, {matched}, 0))) as {RAWS}), "
            f"cast(array() as {RAWS}))"
        )

    def emit(self, *hits: str) -> None:
        self._hits += hits

    def emit_column(self, hits: Column) -> None:
        self._columns.append(hits)

    def vet(self, *raws: str, mode: str = classify.CODE) -> None:
        """Emit the raw matches that are live code (or real secrets)."""
        self._raws[mode] += raws

    # ── staged columns ─────────────────────────────────────────────────────────

    def literals(self) -> Column:
        """One test per literal; a longer one is only searched where a shorter one, that
        it contains, was found."""

        def test(literal: str) -> str:
            inner = [v for v in self._literals if v != literal and v in literal]
            chain = sorted(inner, key=len)[:1] + [literal]
            return " and ".join(f"contains(_lower, {sql_text(v)})" for v in chain)

        return F.expr(f"array({', '.join(map(test, self._literals)) or 'true'})")

    def flags(self) -> Column:
        """Flags use literals and path columns only, not other flags."""
        named = [built.alias(name) for name, built in self._flags.items()]
        return F.struct(*named) if named else F.struct(F.lit(True).alias("none"))

    def gates(self) -> Column:
        return F.expr(f"array({', '.join(self._gates) or 'false'})")

    def hits(self) -> Column:
        arrays = [F.expr(f"concat({', '.join(self._hits)})")] if self._hits else []
        arrays += self._columns
        arrays += [
            vetted(F.expr(f"concat({', '.join(raws)})"), mode)
            for mode, raws in self._raws.items()
            if raws
        ]
        return F.concat(*arrays)


def walked(extensions: Sequence[str]) -> Column:
    return (F.col("_base").startswith(".env") | F.col("_ext").isin(*extensions)) & ~F.col(
        "_in_skipped_dir"
    )


def _line_has(needs: Needs) -> str:
    """A line can only match where it holds the literals itself."""
    return "".join(contains_any(group, "x.low") + " and " for group in needs)


def vetted(raws: Column, mode: str) -> Column:
    """Drop prose matches, keep the first hit of rules marked ``once``, repeat copies.

    Hits of a rule are contiguous and in line order, so "first" needs only a look at
    the neighbour.
    """

    def judge(h: Column) -> Column:
        # Two steps so that the lexical state is evaluated once per hit.
        state = lexing.state_in_line(h["start_state"], h["before"], h["text"])
        return F.transform(
            F.array(state),
            lambda s: F.struct(
                h["rule"].alias("rule"),
                h["once"].alias("once"),
                h["copies"].alias("copies"),
                h["line"].alias("line"),
                h["detail"].alias("detail"),
                h["severity"].alias("severity"),
                classify.classify_match(
                    is_doc=F.col("_doc"),
                    is_test=F.col("_test"),
                    extension=F.col("_ext"),
                    line=h["text"],
                    before=h["before"],
                    match=h["found"],
                    state=s,
                    mode=mode,
                )["confidence"].alias("confidence"),
            ),
        )[0]

    judged = F.filter(F.transform(raws, judge), lambda h: classify.emits(h["confidence"]))
    # One-element transform: binds the array so that neighbours can be looked up.
    kept = F.transform(
        F.array(judged),
        lambda hs: F.filter(
            hs,
            lambda h, i: ~h["once"] | (i == 0) | (F.get(hs, i - 1)["rule"] != h["rule"]),
        ),
    )[0]
    return F.flatten(
        F.transform(
            kept,
            lambda h: F.array_repeat(
                F.struct(
                    h["rule"].alias("rule"),
                    (h["line"] + 1).alias("line"),
                    h["detail"].alias("detail"),
                    h["severity"].alias("severity"),
                    classify.rounded_confidence(h["confidence"]).alias("confidence"),
                ),
                h["copies"],
            ),
        )
    )


def scan(
    files: DataFrame,
    detectors: Sequence[Detector],
    keep: Sequence[str] = (),
    single_files: bool = False,
) -> DataFrame:
    """Run detectors over files(repo_id, path, content) -> one row per hit.

    ``keep`` names further columns of ``files`` to carry along (a change timestamp).
    With ``single_files`` every row is a target of its own: its directories neither skip
    it nor make it a test, only its name counts.
    Output: repo_id, path, *keep, rule, line, detail, severity, confidence.
    """
    rows = scan_rows(files.where(F.col("content") != ""), detectors, keep, single_files)
    # inline_outer: an inner explode would make the optimizer add a size(hits) > 0 filter
    # and evaluate all detectors twice.
    return rows.select("repo_id", "path", *keep, F.inline_outer("_hits")).where(F.col("rule").isNotNull())


def scan_rows(
    files: DataFrame,
    detectors: Sequence[Detector],
    keep: Sequence[str] = (),
    single_files: bool = False,
) -> DataFrame:
    """One row per file: repo_id, path, *keep and its hits as the array ``_hits``."""
    view = FileView()
    for detect in detectors:
        detect(view)
    hits = view.hits()
    path = F.col("path")
    staged = (
        files.withColumns(
            {
                "_base": paths.base_name(path),
                "_ext": paths.extension(path),
                "_doc": paths.is_doc_file(path),
                "_test": paths.is_test_or_example(
                    paths.base_name(path) if single_files else path
                ),
                "_in_skipped_dir": (
                    F.lit(False) if single_files else paths.in_skipped_directory(path)
                ),
                "_lower": F.lower(F.col("content")),
            }
        )
        .withColumn("_literals", view.literals())
        .withColumn("_flags", view.flags())
        .withColumn("_gates", view.gates())
        .withColumn("_wanted", F.array_contains("_gates", True))
        .withColumn("_texts", F.when(F.col("_wanted"), lexing.lines_of(F.col("content"))))
        .withColumn(
            "_states",
            F.when(
                F.col("_wanted") & lexing.may_span_lines(F.col("content")),
                lexing.line_start_states(F.col("content")),
            ).otherwise(F.array().cast("array<string>")),
        )
        .withColumn(
            # Zipped outside the lambda: the optimizer may inline _states, and inside the
            # lambda it would then be computed again for every line.
            "_lines",
            F.expr(
                "coalesce(transform(arrays_zip(_texts, _states), (z, i) -> named_struct("
                "'i', i, 'text', z._texts, 'low', lower(z._texts), 'state', coalesce(z._states, ''))), "
                f"cast(array() as {LINES}))"
            ),
        )
    )
    return staged.select("repo_id", "path", *keep, hits.alias("_hits"))
