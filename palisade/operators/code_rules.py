"""Rule-list detectors with live-code vetting: secrets, env names, injection, CORS, auth."""

from __future__ import annotations

from palisade.functions import classify
from palisade.functions.dialect import java_pattern
from palisade.functions.paths import DEFAULT_EXTENSIONS, MODULE_EXTENSIONS, SCRIPT_EXTENSIONS
from palisade.operators.file_scan import (
    FileView,
    Needs,
    contains_any,
    rlike,
    sql_text,
)
from palisade.rules.fixed_rules import AUTH_RULES, INJECTION_RULES
from palisade.rules.secret_rules import SECRET_RULES

# Literals without which a line cannot match a rule (lower case): all of (any of ...).
RULE_NEEDS: dict[str, Needs] = {
    "sql-template-literal": (("query", "execute"), ("${",)),
    "sql-string-concat": (("query", "execute"), ("select",)),
    "unsanitized-body-insert": (("req.body",), ("insert", "create", "update")),
    "command-injection-exec": (("req.",), ("exec",)),
    "command-injection-eval": (("req.",), ("eval",)),
    "nosql-injection": (("req.body",), ("find", "updateone", "deleteone")),
    "xss-innerhtml": (("innerhtml",),),
    "xss-dangerously-set": (("dangerouslysetinnerhtml",),),
    "idor-params-id": (("req.params.id", "req.query.id"),),
    "idor-prisma-where-id-only": (("req.",), ("where",)),
    "mass-assignment-spread": (("...req.body",),),
    "mass-assignment-object-assign": (("req.body",), ("object.assign",)),
    "ssrf-user-url": (("req.",),),
    "path-traversal-user-input": (
        ("req.",),
        ("readfile", "createreadstream", "writefile", "unlink", "sendfile", "download"),
    ),
    "code-injection-function-constructor": (("req.",), ("function",)),
    "sql-orm-raw-unsafe": (("${",), ("sequelize.query", "knex.raw", "rawunsafe")),
    "xss-innerhtml-location": (("innerhtml",),),
    "xss-document-write": (("document.write",),),
    "password-plaintext-insert": (("req.body.password",),),
    "password-md5": (("createhash",), ("password",)),
    "password-sha1": (("createhash",), ("password",)),
    "password-sha256-unsalted": (("createhash",), ("password",)),
    "bcrypt-low-cost": (("bcrypt.hash",),),
    "open-redirect-query": (("res.redirect",),),
    "open-redirect-window": (("window.location",),),
    "jwt-hardcoded-secret": (("jwt.sign",),),
    "jwt-alg-none": (("algorithm",),),
    "tls-reject-unauthorized-false": (("rejectunauthorized",),),
    "tls-node-reject-disabled": (("node_tls_reject_unauthorized",),),
    "cookie-not-httponly": (("httponly",),),
    "insecure-random-token": (("math.random",),),
}

# Environment names that must not reach the browser.
PUBLIC_PREFIX = r"NEXT_PUBLIC_(\w+)"
SECRET_NAME_PARTS = (
    "SECRET", "PRIVATE", "PASSWORD", "TOKEN", "API_KEY",
    "SERVICE_ROLE", "DATABASE_URL", "SUPABASE_SERVICE",
    "STRIPE_SECRET", "PAYSTACK_SECRET", "FLW_SECRET",
)
# CORS patterns (id, pattern, ignore case) and paths that need a login.
CORS_RULES = (
    ("cors-wildcard-origin", r"""cors\s*\(\s*\{[^}]*origin\s*:\s*['"`]\*['"`]""", True),
    ("cors-no-options", r"app\.use\s*\(\s*cors\s*\(\s*\)\s*\)", False),
    (
        "cors-manual-wildcard",
        r"""['"`]Access-Control-Allow-Origin['"`]\s*[,:]\s*['"`]\*['"`]""",
        False,
    ),
)
CORS_NEEDS: dict[str, Needs] = {
    "cors-wildcard-origin": (("cors",), ("origin",)),
    "cors-no-options": (("app.use",), ("cors",)),
    "cors-manual-wildcard": (("access-control-allow-origin",),),
}
AUTH_PATHS = r"\/(login|signin|signup|auth|api\/)"
CORS_AUTH_NOTE = " — this app has auth endpoints, making this dangerous."
# Controlled HTML sinks.
STATIC_HTML = r"__html\s*:\s*JSON\.stringify"
STATIC_HTML_TEMPLATE = r"__html\s*:\s*`?\s*\$\{?\s*JSON\.stringify"
JSON_LD = r"application\/ld\+json"


def secrets(view: FileView) -> None:
    """Known token shapes and quoted assignments, judged as secret values, every line."""
    for rule in SECRET_RULES:
        gate = view.real_code(*DEFAULT_EXTENSIONS)
        if rule.context_required:
            context = rlike(rule.context_required, True, of="content")
            gate = f"{gate} and {view.passes((rule.literals,))} and {context}"
        view.vet(
            view.raw_matches(
                f"secret-{rule.id}", rule.pattern, gate, needs=(rule.literals,),
                ignore_case=False, once=False, severity=sql_text(rule.severity),
            ),
            mode=classify.SECRET,
        )


def env_names(view: FileView) -> None:
    """Browser-exposed variables whose name says secret; first one of each line."""
    variable = f"regexp_extract(x.text, {sql_text(java_pattern(PUBLIC_PREFIX))}, 1)"
    view.vet(
        view.raw_matches(
            "env-next-public-secret", PUBLIC_PREFIX, view.walks(*SCRIPT_EXTENSIONS, ".env"),
            needs=(("next_public_",),), ignore_case=False, once=False,
            also=contains_any(SECRET_NAME_PARTS, of=f"upper({variable})"), detail=variable,
        )
    )


def controlled_html_sink() -> str:
    """SQL condition: the sink on line ``x`` is fed JSON.stringify on this line or the
    next two, or the file holds JSON-LD."""
    window = "array_join(transform(slice(_lines, x.i + 1, 3), y -> y.text), '\\n')"
    return (
        f"({rlike(STATIC_HTML, of=window)} or {rlike(JSON_LD, True, of='content')} "
        f"or {rlike(STATIC_HTML_TEMPLATE, of=window)})"
    )


def injection(view: FileView) -> None:
    for rule in INJECTION_RULES:
        severity = "null"
        if rule.id == "xss-dangerously-set":
            severity = f"if({controlled_html_sink()}, 'info', null)"
        view.vet(
            view.raw_matches(
                f"injection-{rule.id}", rule.pattern, view.real_code(*MODULE_EXTENSIONS),
                needs=RULE_NEEDS[rule.id], severity=severity,
            )
        )


def cors(view: FileView) -> None:
    has_auth = rlike(AUTH_PATHS, True, of="content")
    for rule, pattern, fold in CORS_RULES:
        severity = detail = "null"
        if rule != "cors-no-options":
            severity = f"if({has_auth}, 'critical', 'warning')"
        if rule == "cors-wildcard-origin":
            detail = f"if({has_auth}, {sql_text(CORS_AUTH_NOTE)}, '.')"
        view.vet(
            view.raw_matches(
                rule, pattern, view.real_code(*MODULE_EXTENSIONS, ".json"),
                needs=CORS_NEEDS[rule], ignore_case=fold, severity=severity, detail=detail,
            )
        )


def auth_rules(view: FileView, allowed: str) -> None:
    """The auth rule list of the application scanner."""
    for rule in AUTH_RULES:
        view.vet(
            view.raw_matches(
                f"auth-{rule.id}", rule.pattern, allowed, needs=RULE_NEEDS[rule.id]
            )
        )
