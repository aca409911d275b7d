"""Security headers of crawled responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Required headers (key, name, severity, advice, documentation).
REQUIRED_HEADERS = (
    (
        "content-security-policy", "Content-Security-Policy", "warning",
        "Add a Content-Security-Policy header. Start with: default-src 'self'; script-src 'self'",
        "https://developer.mozilla.org/en-US/docs/Web/HTTP/CSP",
    ),
    (
        "strict-transport-security", "Strict-Transport-Security", "warning",
        "Add: Strict-Transport-Security: max-age=31536000; includeSubDomains",
        "https://developer.mozilla.org/en-US/docs/Web/HTTP/Headers/Strict-Transport-Security",
    ),
    (
        "x-content-type-options", "X-Content-Type-Options", "warning",
        "Add: X-Content-Type-Options: nosniff",
        "https://developer.mozilla.org/en-US/docs/Web/HTTP/Headers/X-Content-Type-Options",
    ),
    (
        "x-frame-options", "X-Frame-Options", "warning",
        "Add: X-Frame-Options: DENY (or SAMEORIGIN if you need iframes)",
        "https://developer.mozilla.org/en-US/docs/Web/HTTP/Headers/X-Frame-Options",
    ),
    (
        "referrer-policy", "Referrer-Policy", "warning",
        "Add: Referrer-Policy: strict-origin-when-cross-origin",
        "https://developer.mozilla.org/en-US/docs/Web/HTTP/Headers/Referrer-Policy",
    ),
    (
        "permissions-policy", "Permissions-Policy", "info",
        "Add: Permissions-Policy: camera=(), microphone=(), geolocation=()",
        "https://developer.mozilla.org/en-US/docs/Web/HTTP/Headers/Permissions-Policy",
    ),
)


def missing_headers(responses: DataFrame) -> DataFrame:
    """responses(url, headers map, error) -> findings with ``url``; a narrow projection.

    The six headers are an array literal exploded inside the row, so there is no join.
    """
    url = F.col("url")

    def present(key):
        return F.coalesce(
            F.exists(
                F.map_entries("headers"),
                lambda e: (F.lower(e["key"]) == key) & (e["value"] != ""),
            ),
            F.lit(False),
        )

    nothing = F.lit(None).cast("string")

    def finding(id_, severity, title, message, fix=nothing, docs=nothing):
        return F.struct(
            id_.alias("id"), severity.alias("severity"), title.alias("title"),
            message.alias("message"), fix.alias("fix"), docs.alias("docs"),
        )

    def missing(key, name, severity, fix, docs):
        return F.when(
            ~present(key),
            finding(
                F.lit(f"header-missing-{key}"), F.lit(severity),
                F.lit(f"Missing {name} header"),
                F.concat(F.lit("The deployed site at "), url, F.lit(f" is missing the {name} security header.")),
                F.lit(fix), F.lit(docs),
            ),
        )

    absent = F.filter(F.array(*[missing(*h) for h in REQUIRED_HEADERS]), lambda f: f.isNotNull())
    failed = F.array(
        finding(
            F.lit("header-check-failed"), F.lit("info"), F.lit("Header check failed"),
            F.concat(
                F.lit("Could not reach "), url, F.lit(": "), F.col("error"),
                F.lit(". Make sure the URL is correct and the site is deployed."),
            ),
        )
    )
    passed = F.array(
        finding(
            F.lit("header-all-present"), F.lit("passed"), F.lit("All security headers present"),
            F.concat(
                F.lit(f"All {len(REQUIRED_HEADERS)} recommended security headers found on "), url, F.lit("."),
            ),
        )
    )
    return (
        responses.withColumn("_absent", F.when(F.col("error").isNull(), absent))
        .select(
            "url",
            F.inline_outer(
                F.when(F.col("error").isNotNull(), failed)
                .when(F.size("_absent") > 0, F.col("_absent"))
                .otherwise(passed)
            ),
        )
        .select(
            "url", "id", "severity", F.lit("header").alias("category"), "title", "message",
            "fix", "docs",
        )
    )
