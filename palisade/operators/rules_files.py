"""Assistant rule files: hidden characters, payloads, unknown hosts, bypass instructions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.operators.file_scan import (
    Detector,
    FileView,
    all_of,
    contains_any,
    rlike,
    sql_text,
)

# Rule file names and endings, trusted hosts, hidden characters, payload
# shape, URL shape and the instruction patterns.
RULES_FILES = (
    ".cursorrules", ".windsurfrules", "CLAUDE.md", ".antigravityrules", ".claude", "claude.md",
)
RULES_ENDINGS = (".rules", ".mcp.json")
TRUSTED_HOSTS = (
    "github.com", "npmjs.com", "supabase.com", "stripe.com", "vercel.com", "netlify.com",
    "cloudflare.com", "googleapis.com", "openai.com", "anthropic.com", "microsoft.com",
    "mozilla.org", "w3.org", "developer.mozilla.org", "stackoverflow.com", "docs.github.com",
    "nextjs.org", "reactjs.org", "nodejs.org", "typescriptlang.org",
)
HIDDEN_CHARACTERS = (
    ("\u200b", "Zero-width space", "U+200B"),
    ("\u200c", "Zero-width non-joiner", "U+200C"),
    ("\u200d", "Zero-width joiner", "U+200D"),
    ("\u200e", "Left-to-right mark", "U+200E"),
    ("\u200f", "Right-to-left mark", "U+200F"),
    ("\u202a", "Left-to-right embedding", "U+202A"),
    ("\u202b", "Right-to-left embedding", "U+202B"),
    ("\u202c", "Pop directional formatting", "U+202C"),
    ("\u202d", "Left-to-right override", "U+202D"),
    ("\u202e", "Right-to-left override", "U+202E"),
    ("\u00ad", "Soft hyphen", "U+00AD"),
    ("\ufeff", "Byte order mark", "U+FEFF"),
)
HIDDEN_CLASS = "[\u200b-\u200f\u202a-\u202e\u00ad\ufeff]"
BASE64_RUN = r"[A-Za-z0-9+/=]{50,}"
URL_HOST = r"https?:\/\/([a-zA-Z0-9.-]+)"
INSTRUCTIONS = (
    r"ignore\s+(all\s+)?security",
    r"skip\s+(all\s+)?security",
    r"bypass\s+security",
    r"don['']?t\s+scan",
    r"never\s+report",
    r"hide\s+(this|these)\s+from",
    r"do\s+not\s+flag",
    r"suppress\s+(all\s+)?warnings",
)
# Instructions against a named scanner: "disable <name>", "ignore <name>".
DEFAULT_SCANNER_NAMES = ("scanner", "security scanner")


def is_rules_file(path: Column) -> Column:
    """Root level only: a listed name, or a listed ending."""
    ending = path.endswith(RULES_ENDINGS[0]) | path.endswith(RULES_ENDINGS[1])
    return ~path.contains("/") & (path.isin(*RULES_FILES) | ending)


def rules_files(
    trusted_hosts: Sequence[str] = TRUSTED_HOSTS,
    scanner_names: Sequence[str] = DEFAULT_SCANNER_NAMES,
) -> Detector:
    """Detector over rule files.  Pass your own hosts and scanner names to extend it."""
    named = "|".join(name.replace(" ", r"\s+") for name in scanner_names)
    phrases = INSTRUCTIONS + (rf"(disable|ignore)\s+(the\s+)?({named})",)
    exact = ", ".join(sql_text(name) for name in trusted_hosts)
    below = " or ".join(f"endswith(h, {sql_text('.' + name)})" for name in trusted_hosts)
    unknown = (
        f"filter(transform(regexp_extract_all(x.text, {sql_text(URL_HOST)}, 1), "
        f"h -> lower(h)), h -> not (h in ({exact}) or {below}))"
    )
    hidden_name = " ".join(
        f"when contains(x.text, {sql_text(char)}) then {sql_text(f'{name} {code}')}"
        for char, name, code in HIDDEN_CHARACTERS
    )
    hidden = contains_any([char for char, _, _ in HIDDEN_CHARACTERS], of="content")

    def detect(view: FileView) -> None:
        is_rules = view.flag("rules_file", lambda: is_rules_file(F.col("path")))
        view.emit(
            view.line_hits(
                "rules-hidden-unicode", all_of(is_rules, hidden),
                f"x.text rlike {sql_text(HIDDEN_CLASS)}", detail=f"case {hidden_name} end",
            ),
            view.line_hits(
                "rules-base64-payload", all_of(is_rules, rlike(BASE64_RUN, of="content")),
                rlike(BASE64_RUN),
            ),
            view.line_hits(
                "rules-suspicious-url", is_rules, f"size({unknown}) > 0", needs=(("http",),),
                detail=f"get({unknown}, 0)",
            ),
            view.line_hits("rules-malicious-instruction", is_rules, rlike("|".join(phrases), True)),
        )

    return detect
