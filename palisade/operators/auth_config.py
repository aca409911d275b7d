"""Authentication set-up: sessions, login routes, password reset, provider in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import paths
from palisade.functions.paths import SCRIPT_EXTENSIONS
from palisade.operators.file_scan import FileView, all_of, contains_any, rlike
from palisade.sources.files import filter_ignored, is_readable

# Patterns of the session, login and reset checks.
GET_SESSION = r"supabase\.auth\.getSession\(\)"
STORED_SESSION = r"""localStorage\.setItem\s*\(\s*['"`](token|session|jwt|auth)"""
LOGIN_PATH = r"\/(login|signin|signup|register|auth)\b"
LOGIN_METHOD = r"\.(post|get|all)\s*\("
LIMITER_WORDS = ("rateLimit", "rate-limit", "rateLimiter")
RESET_PATH = r"reset|forgot|password"
RESET_TEXT = r"reset|forgot"
RANDOM_CALL = r"Math\.random\s*\(\s*\)"
RANDOM_TOPIC = r"token|reset|password"
URL_TOKEN = r"req\.(query|params)\.token"
EXPIRY_WORDS = r"expir|valid|timestamp|createdAt"
RESET_ROUTE = r"\/reset|\/forgot|password-reset|forgot-password"
RESET_LIMITER = r"rateLimit|rate-limit|rateLimiter"
RESET_LINE = r"""\.(post|get|all)\s*\(\s*['"`].*reset|forgot"""
RESET_TOPIC = r"reset|password"
TOKEN_LOOKUP = r"findOne|findUnique|where.*token"
TOKEN_INVALIDATED = r"delete|remove|invalidate|used\s*=\s*true|update.*used"


ON_FRONTEND = "not contains(path, 'server') and not contains(concat('/', path), 'api/')"


def session_rules(view: FileView) -> None:
    """Line rules; the first unlimited login route ends the file's line loop."""
    allowed = view.walks(*SCRIPT_EXTENSIONS)
    login = view.line_hits(
        "auth-no-rate-limit",
        f"{allowed} and not {contains_any(LIMITER_WORDS, of='content')}",
        all_of(rlike(LOGIN_PATH), rlike(LOGIN_METHOD)),
        needs=(
            ("/login", "/signin", "/signup", "/register", "/auth"),
            (".post", ".get", ".all"),
        ),
    )
    get_session = view.line_hits(
        "auth-getsession-frontend", all_of(allowed, ON_FRONTEND), rlike(GET_SESSION),
        needs=(("supabase.auth.getsession()",),), first=False,
    )
    stored = view.line_hits(
        "auth-localstorage-session", allowed, rlike(STORED_SESSION, True),
        needs=(("localstorage.setitem",),), first=False,
    )
    # Bind the login hit once, then keep what lies on or before its line.
    view.emit(
        f"transform(array({login}), stop -> concat(filter(concat({get_session}, {stored}), "
        "h -> size(stop) = 0 or h.line <= get(stop, 0).line), stop))[0]"
    )


def password_reset_rules(view: FileView) -> None:
    allowed = all_of(
        view.walks(*SCRIPT_EXTENSIONS),
        f"{rlike(RESET_PATH, True, of='path')} or {view.passes((('reset', 'forgot'),))}",
    )
    view.emit(
        view.line_hits(
            "auth-weak-reset-token",
            all_of(allowed, view.passes((("token", "reset", "password"),))),
            rlike(RANDOM_CALL), needs=(("math.random",),), first=False,
        ),
        view.line_hits(
            "auth-reset-token-no-expiry",
            all_of(
                allowed,
                view.passes((("req.query.token", "req.params.token"),)),
                f"not {rlike(EXPIRY_WORDS, True, of='content')}",
            ),
            rlike(URL_TOKEN), needs=(("req.query.token", "req.params.token"),), first=False,
        ),
        view.line_hits(
            "auth-reset-no-rate-limit",
            all_of(
                allowed,
                view.passes((("/reset", "/forgot", "password-reset", "forgot-password"),)),
                f"not {rlike(RESET_LIMITER, True, of='content')}",
            ),
            rlike(RESET_LINE, True), needs=(("reset", "forgot"),),
        ),
        view.file_hit(
            "auth-reset-token-reuse",
            all_of(
                allowed,
                "contains(content, 'token')",
                view.passes((("reset", "password"),)),
                rlike(TOKEN_LOOKUP, True, of="content"),
                f"not {rlike(TOKEN_INVALIDATED, True, of='content')}",
            ),
        ),
    )


def auth_config(view: FileView) -> None:
    password_reset_rules(view)
    session_rules(view)


def auth_provider(files: DataFrame) -> DataFrame:
    """First file (path order) of each repository that names an auth provider.

    A narrow projection, then a partial ``min_by``: one row per repository and task is
    shuffled, never file contents.
    """
    path, content = F.col("path"), F.col("content")
    provider = (
        F.when(content.contains("@clerk/"), "clerk")
        .when(content.contains("next-auth") | content.contains("NextAuth"), "nextauth")
        .when(content.contains("supabase") & content.contains("auth"), "supabase")
        .when(content.contains("firebase") & content.contains("auth"), "firebase")
    )
    named = (
        files.where(
            paths.has_extension(path, SCRIPT_EXTENSIONS + (".json",))
            & ~paths.in_skipped_directory(path)
            & is_readable(content)
        )
        .select("repo_id", "path", provider.alias("provider"))
        .where(F.col("provider").isNotNull())
    )
    return (
        filter_ignored(named, files)
        .groupBy("repo_id")
        .agg(F.min_by("provider", "path").alias("provider"), F.min("path").alias("path"))
    )
