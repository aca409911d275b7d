"""Application-layer rules: rate limits, ownership, passwords, uploads, errors, logs,
redirects and the auth rule list."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.paths import MODULE_EXTENSIONS, is_app_test_file, is_route_file
from palisade.operators.code_rules import auth_rules
from palisade.operators.file_scan import FileView, all_of, any_rlike, rlike, walked

# Patterns of the application checks.
RATE_LIMIT_WORDS = (
    r"rateLimit|rate-limit|rateLimiter|express-rate-limit|@upstash\/ratelimit|Ratelimit|slowDown"
)
RATE_LIMIT_PACKAGES = r"next-rate-limit|nextjs-rate-limit"
PAYMENT_PATH = (
    r"\/(checkout|charge|payment|payments|pay|billing|subscribe|subscription|invoice|order"
    r"|orders|stripe|paystack|flutterwave|mpesa|m-pesa)\b"
)
PAYMENT_METHOD = r"(app|router)\.(post|put|patch)\s*\(|export\s+(async\s+)?function\s+POST\s*\("
POST_ROUTE = (
    r"(app|router)\.post\s*\(",
    r"export\s+(async\s+)?function\s+POST\s*\(",
    r"export\s+const\s+POST\s*=",
)
OBJECT_ID = r"req\.(params|query)\.(id|userId|orderId)"
DATABASE_WORDS = r"(prisma|supabase|db|sequelize|mongoose|knex)"
CURRENT_USER = (
    r"req\.user\b|req\.session\.userId|req\.auth\b|getCurrentUser\(|auth\.uid\(|locals\.user|ctx\.user"
)
PASSWORD_COMPARE = (
    r"(user|account)\.password\s*===\s*req\.body\.password",
    r"req\.body\.password\s*===\s*\w+\.password\b",
)
UPLOAD_WORDS = r"multer|formidable|busboy|@vercel\/blob|next-connect|multipart"
UPLOAD_LIMIT = r"limits\s*:\s*\{[^}]*fileSize"
UPLOAD_CALL = r"multer\s*\("
UPLOAD_FILTER = r"""fileFilter\s*:|mimetype|accept\s*=\s*["']"""
UPLOAD_PUBLIC = r"""(dest|destination)\s*:\s*['"`][^'"`]*\/?public\/"""
ERROR_REPLY = (
    (
        r"res\.(status\s*\(\s*5\d\d\s*\))?\s*\.?(json|send)\s*\(\s*\{[^}]*(error|stack|err)"
        r"\s*:\s*(err|error)\.(stack|message|toString)",
        True,
    ),
    (r"res\.(status\s*\(\s*5\d\d\s*\))?\s*\.?(json|send)\s*\(\s*(err|error)\.stack", True),
    (r"res\.(json|send)\s*\(\s*(err|error)\s*\)", False),
)
SENSITIVE_LOG = (
    r"console\.(log|info|warn|error|debug)\s*\([^)]*\b(password|passwd|secret|token|api[_-]?key"
    r"|authorization|jwt|credit[_-]?card|card[_-]?number|cvv|ssn|email|stripe[_-]?key)\b"
)
_TARGETS = (
    "(next|url|redirect|returnUrl|return_url|callback|goto|dest|destination|redir|continue)"
)
OPEN_REDIRECTS = (
    rf"res\.redirect\s*\(\s*req\.(query|body|params)\.{_TARGETS}",
    rf"""res\.redirect\s*\(\s*req\.(query|body|params)\[['"`]{_TARGETS}['"`]\]""",
    rf"""router\.push\s*\(\s*searchParams\.get\s*\(\s*['"`]{_TARGETS}['"`]\s*\)""",
    rf"""redirect\s*\(\s*searchParams\.get\s*\(\s*['"`]{_TARGETS}['"`]\s*\)""",
    r"window\.location\.(href|assign|replace)\s*=\s*searchParams\.get\s*\(",
    r"window\.location\.(href|assign|replace)\s*=\s*.*\.(query|search|hash)",
    r"""Location['"`]?\s*[,:]\s*req\.(query|body|params)\.""",
)



def _allowed(view: FileView) -> str:
    """Real code only: no documentation, tests, fixtures or examples."""
    return view.flag(
        "app_code",
        lambda: walked(MODULE_EXTENSIONS)
        & ~F.col("_doc")
        & ~F.col("_test")
        & ~is_app_test_file(F.col("path")),
    )


def rate_limit(view: FileView) -> None:
    named = view.passes((("post", ".put", ".patch"),))
    open_route = view.flag(
        "open_route",
        lambda: F.expr(named)
        & is_route_file(F.col("path"), F.col("content"))
        & F.expr(f"not {rlike(RATE_LIMIT_WORDS, True, of='content')}")
        & F.expr(f"not {rlike(RATE_LIMIT_PACKAGES, of='content')}"),
    )
    gate = all_of(_allowed(view), open_route)
    payment = all_of(rlike(PAYMENT_PATH, True), rlike(PAYMENT_METHOD))
    view.emit(
        view.line_hits(
            "rate-limit-missing-payment", gate, payment, needs=(("post", ".put", ".patch"),)
        ),
        view.line_hits(
            "rate-limit-missing-post", gate,
            f"{any_rlike([(p, False) for p in POST_ROUTE])} and not ({payment})",
            needs=(("post",),),
        ),
    )


def idor_scope(view: FileView) -> None:
    needs = (("req.params.", "req.query."),)
    gate = all_of(
        _allowed(view),
        view.passes(needs),
        rlike(OBJECT_ID, of="content"),
        rlike(DATABASE_WORDS, True, of="content"),
        f"not {rlike(CURRENT_USER, of='content')}",
    )
    view.emit(view.line_hits("idor-handler-scope", gate, rlike(OBJECT_ID), needs=needs))


def password_compare(view: FileView) -> None:
    view.emit(
        view.line_hits(
            "password-plaintext-compare", _allowed(view),
            any_rlike([(p, False) for p in PASSWORD_COMPARE]), needs=(("req.body.password",),),
        )
    )


def _first_line(pattern: str) -> str:
    """1-based number of the first matching line, NULL where no single line matches."""
    return f"get(filter(_lines, x -> {rlike(pattern)}), 0).i + 1"


def uploads(view: FileView) -> None:
    about = all_of(
        _allowed(view),
        view.passes(
            (("multer", "formidable", "busboy", "@vercel/blob", "next-connect", "multipart"),)
        ),
    )
    calls = all_of(about, view.has("multer"), rlike(UPLOAD_CALL, of="content"))
    view.emit(
        view.file_hit(
            "upload-no-size-limit",
            all_of(calls, f"not {rlike(UPLOAD_LIMIT, True, of='content')}"),
            line=_first_line(UPLOAD_CALL),
        ),
        view.file_hit(
            "upload-no-type-filter",
            all_of(calls, f"not {rlike(UPLOAD_FILTER, of='content')}"),
            line=_first_line(UPLOAD_CALL),
        ),
        view.file_hit(
            "upload-public-dir",
            all_of(about, view.has("public/"), rlike(UPLOAD_PUBLIC, of="content")),
            line=_first_line(UPLOAD_PUBLIC),
        ),
    )


def error_exposure(view: FileView) -> None:
    view.emit(
        view.line_hits(
            "error-stack-exposed", _allowed(view), any_rlike(ERROR_REPLY),
            needs=(("res.",), ("json", "send")),
        )
    )


def sensitive_log(view: FileView) -> None:
    view.emit(
        view.line_hits(
            "sensitive-log", _allowed(view), rlike(SENSITIVE_LOG, True), needs=(("console.",),)
        )
    )


def open_redirect(view: FileView) -> None:
    view.emit(
        view.line_hits(
            "open-redirect", _allowed(view), any_rlike([(p, True) for p in OPEN_REDIRECTS]),
            needs=(("redirect", "location", "router.push"),),
        )
    )


def auth_rule_list(view: FileView) -> None:
    auth_rules(view, _allowed(view))


def app_security(view: FileView) -> None:
    rate_limit(view)
    idor_scope(view)
    password_compare(view)
    uploads(view)
    error_exposure(view)
    sensitive_log(view)
    open_redirect(view)
    auth_rule_list(view)
