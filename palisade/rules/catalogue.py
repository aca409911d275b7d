"""Texts of every finding that a file-level detector can emit.

``%X%`` stands for the hit's detail, ``%FILE%`` / ``%LINE%`` for its place and ``%AT%``
for ``:line`` where a line is known.  The id template is the key of an entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.classify import calibrated_severity
from palisade.rules.fixed_rules import AUTH_RULES, INJECTION_RULES, WEBHOOK_PROVIDERS
from palisade.rules.secret_rules import SECRET_RULES


class Entry(NamedTuple):
    rule: str
    scanner: str
    severity: str
    category: str
    title: str
    message: str
    fix: str | None = None
    cwe: str | None = None
    breach_precedent: str | None = None


# Identifiers, severities and texts of the findings.
FIXED_ENTRIES: tuple[Entry, ...] = (
    Entry(
        "env-next-public-secret", "check_env", "critical", "env",
        "Secret exposed via NEXT_PUBLIC_ prefix",
        "NEXT_PUBLIC_%X% in %FILE%:%LINE% — NEXT_PUBLIC_ vars are bundled into client-side code and visible to anyone.",
        "Remove the NEXT_PUBLIC_ prefix. Use a server-side API route to access this value.",
        "CWE-200",
        "v0 scanner blocked 17,000+ deployments where AI exposed secrets via NEXT_PUBLIC_ prefix.",
    ),
    Entry(
        "auth-weak-reset-token", "check_auth_config", "critical", "auth",
        "Weak password reset token (Math.random)",
        "Your password reset flow uses Math.random() at %FILE%:%LINE%. This is predictable and attackers can guess reset tokens. Use crypto.randomBytes() instead.",
        "Use crypto.randomBytes(32).toString('hex') for secure token generation.",
        "CWE-330",
        "Predictable reset tokens allow account takeover by guessing the token.",
    ),
    Entry(
        "auth-reset-token-no-expiry", "check_auth_config", "warning", "auth",
        "Password reset token without expiry check",
        "Password reset token read from URL at %FILE%:%LINE% but no expiry validation found. Old tokens should expire after 1 hour.",
        "Store token creation time and reject tokens older than 1 hour. Also invalidate after use.",
        "CWE-640",
    ),
    Entry(
        "auth-reset-no-rate-limit", "check_auth_config", "warning", "auth",
        "No rate limiting on password reset",
        "Password reset endpoint at %FILE%:%LINE% has no rate limiting. Attackers can spam reset emails to harass users or enumerate accounts.",
        "Add rate limiting: max 3 reset requests per email per hour.",
        "CWE-307",
    ),
    Entry(
        "auth-reset-token-reuse", "check_auth_config", "warning", "auth",
        "Password reset token may be reusable",
        "Password reset flow in %FILE% validates tokens but may not invalidate them after use. Tokens should be single-use.",
        "Delete or mark the token as used immediately after successful password reset.",
        "CWE-640",
    ),
    Entry(
        "auth-getsession-frontend", "check_auth_config", "critical", "auth",
        "getSession() used on frontend (can be spoofed)",
        "supabase.auth.getSession() in %FILE%:%LINE% — this reads from localStorage and can be tampered with. Use getUser() for server-validated auth.",
        "Replace supabase.auth.getSession() with supabase.auth.getUser() which validates the JWT server-side.",
        "CWE-287",
        "Cursor research showed getSession() can be spoofed, leading to auth bypass.",
    ),
    Entry(
        "auth-localstorage-session", "check_auth_config", "warning", "auth",
        "Session token stored in localStorage",
        "Session/token stored in localStorage at %FILE%:%LINE%. XSS attacks can steal it.",
        "Use httpOnly cookies for session storage. They cannot be accessed by JavaScript.",
        "CWE-922",
    ),
    Entry(
        "auth-no-rate-limit", "check_auth_config", "warning", "auth",
        "No rate limiting on auth endpoint",
        "Auth endpoint at %FILE%:%LINE% has no rate limiting. Brute force attacks are possible.",
        "Add rate limiting: npm install express-rate-limit, then apply to auth routes.",
        "CWE-307",
    ),
    Entry(
        "webhook-missing-failure-handler", "scan_webhooks", "critical", "webhook",
        "Missing payment failure handlers",
        "Your app unlocks access when payment succeeds but never locks it again when payment fails or a subscription is cancelled. Users can keep your product for free after their card is declined or they cancel. This is an ongoing silent revenue leak. Found in %FILE%:%LINE%",
        "Add handlers for invoice.payment_failed, customer.subscription.deleted, and charge.dispute.created to revoke access when payments fail.",
        "CWE-840",
        "Silent revenue leak: SaaS apps lose thousands monthly when cancelled users retain access.",
    ),
    Entry(
        "webhook-command-injection", "scan_webhooks", "critical", "webhook",
        "Command injection in webhook handler",
        "exec/eval called inside webhook handler at %FILE%:%LINE%. Attackers can inject commands via webhook payload.",
        "Never pass webhook payload data to exec/eval. Use a whitelist of allowed actions.",
        "CWE-78",
        "CurXecute-style attacks: unverified webhooks allow arbitrary command execution.",
    ),
    Entry(
        "cors-wildcard-origin", "check_cors", "critical", "cors",
        "CORS wildcard origin",
        "cors({ origin: '*' }) in %FILE%:%LINE%%X%",
        "Replace with specific origin: cors({ origin: 'https://yourapp.com' })",
        "CWE-942",
    ),
    Entry(
        "cors-no-options", "check_cors", "warning", "cors",
        "CORS with no options (defaults to *)",
        "cors() called without options in %FILE%:%LINE% — Express cors middleware defaults to origin: '*'.",
        "Add explicit origin: cors({ origin: 'https://yourapp.com' })",
        "CWE-942",
    ),
    Entry(
        "cors-manual-wildcard", "check_cors", "critical", "cors",
        "Manual CORS wildcard header",
        "Access-Control-Allow-Origin: * set manually in %FILE%:%LINE%.",
        "Replace * with your specific domain.",
        "CWE-942",
    ),
    Entry(
        "rls-missing-%X%", "check_supabase_rls", "critical", "rls",
        'Missing RLS on "%X%" table',
        'Table "%X%" created in %FILE% without ENABLE ROW LEVEL SECURITY. Anyone with the anon key can read/write all rows.',
        'ALTER TABLE public.%X% ENABLE ROW LEVEL SECURITY;\nCREATE POLICY "Users access own data" ON public.%X%\n  FOR ALL USING (auth.uid() = user_id);',
        "CWE-862",
        "Lovable CVE-2025-48757: missing RLS exposed 170+ production apps.",
    ),
    Entry(
        "rls-using-true", "check_supabase_rls", "critical", "rls",
        "RLS policy with USING (true)",
        "USING (true) at %FILE%:%LINE% — this policy allows unrestricted access. Equivalent to no RLS.",
        "Replace USING (true) with USING (auth.uid() = user_id)",
        "CWE-862",
    ),
    Entry(
        "rls-auth-role-only", "check_supabase_rls", "critical", "rls",
        "RLS uses auth.role() without auth.uid()",
        "Policy at %FILE%:%LINE% checks auth.role()='authenticated' but not auth.uid(). Any logged-in user can access ALL rows.",
        "Replace auth.role() = 'authenticated' with auth.uid() = user_id",
        "CWE-862",
        "Wiz research: this pattern found across 20% of vibe-coded apps.",
    ),
    Entry(
        "rls-uid-is-not-null", "check_supabase_rls", "critical", "rls",
        "Logical RLS bypass: auth.uid() IS NOT NULL",
        'Policy at %FILE%:%LINE% uses USING (auth.uid() IS NOT NULL). This passes naive "is RLS on?" checks but lets ANY logged-in user see ALL data.',
        "Replace USING (auth.uid() IS NOT NULL) with USING (auth.uid() = user_id)",
        "CWE-862",
        "Flagged by Wiz research — this is the sneakiest RLS bypass pattern.",
    ),
    Entry(
        "rls-select-all-no-filter", "check_supabase_rls", "critical", "rls",
        "select('*') without user filter",
        "Unfiltered select('*') at %FILE%:%LINE%. Without RLS or .eq('user_id'), this returns ALL rows for ALL users.",
        "Add .eq('user_id', user.id) to filter by authenticated user, or ensure RLS is enabled on this table.",
        "CWE-862",
        "Moltbook breach: select(*) without filter exposed 1.5M tokens.",
    ),
    Entry(
        "rls-getsession-frontend", "check_supabase_rls", "critical", "rls",
        "getSession() on frontend (spoofable)",
        "supabase.auth.getSession() at %FILE%:%LINE%. This reads from localStorage and can be tampered with.",
        "Use supabase.auth.getUser() instead — it validates the JWT server-side.",
        "CWE-287",
    ),
    Entry(
        "firebase-if-true", "check_firebase", "critical", "firebase",
        "Firebase rule: allow if true",
        '"allow ... if true" at %FILE%:%LINE% — completely open to anyone on the internet.',
        "Replace with: allow read, write: if request.auth != null && request.auth.uid == resource.data.userId;",
        "CWE-862",
    ),
    Entry(
        "firebase-client-controlled-auth", "check_firebase", "critical", "firebase",
        "Firebase rule: client-controlled auth check",
        "Rule at %FILE%:%LINE% uses request.query.userId or request.data.userId — client can set any value.",
        "Use request.auth.uid == userId instead of request.query.userId.",
        "CWE-287",
    ),
    Entry(
        "firebase-auth-not-null-only", "check_firebase", "critical", "firebase",
        "Firebase rule: any logged-in user reads everything",
        "Rule at %FILE%:%LINE% only checks if user is authenticated, not if they own the data.",
        "Add ownership check: allow read: if request.auth != null && request.auth.uid == resource.data.userId;",
        "CWE-862",
    ),
    Entry(
        "firebase-no-rules-file", "check_firebase", "warning", "firebase",
        "No Firebase rules file found",
        "firebase.json exists but no rules file was found. Firebase may be using default rules which could be open.",
        "Create firestore.rules or database.rules with proper access controls.",
    ),
    Entry(
        "rate-limit-missing-payment", "scan_app_security", "critical", "rate-limit",
        "No rate limiting on payment endpoint",
        "Payment endpoint at %FILE%:%LINE% has no rate limiting. Attackers can spam it.",
        "Add rate limiting (express-rate-limit, @upstash/ratelimit, or middleware) on payment / checkout routes.",
        "CWE-770",
        "Unlimited payment endpoints are abused for card-testing attacks costing thousands in Stripe fees overnight.",
    ),
    Entry(
        "rate-limit-missing-post", "scan_app_security", "warning", "rate-limit",
        "No rate limiting on POST route",
        "POST route at %FILE%:%LINE% has no rate limiting in this file.",
        "Add a rate limiter (express-rate-limit or @upstash/ratelimit) to mutating routes.",
        "CWE-770",
    ),
    Entry(
        "idor-handler-scope", "scan_app_security", "critical", "idor",
        "Likely IDOR — handler uses req.params.id but never checks the current user",
        "Handler in %FILE%:%LINE% reads req.params.id and queries a database, but the file never references req.user / session / auth context.",
        "Pull the authenticated user (req.user.id) and include it in your WHERE clause or check ownership before responding.",
        "CWE-639",
        "Optus 2022: 9.8M records exfiltrated via /api/users/:id with no ownership check.",
    ),
    Entry(
        "password-plaintext-compare", "scan_app_security", "critical", "auth",
        "Plain-text password comparison",
        "Password compared with === at %FILE%:%LINE%. Stored passwords should be hashed and compared with bcrypt.compare / argon2.verify.",
        "Hash passwords with bcrypt (cost >= 12) and compare via await bcrypt.compare(input, hash).",
        "CWE-256",
    ),
    Entry(
        "upload-no-size-limit", "scan_app_security", "warning", "upload",
        "File upload has no size limit",
        "multer() configured in %FILE%%AT% without a fileSize limit. Attackers can fill disk and crash the server.",
        "Add limits: { fileSize: 5 * 1024 * 1024 } (or similar) to your multer config.",
        "CWE-400",
    ),
    Entry(
        "upload-no-type-filter", "scan_app_security", "warning", "upload",
        "File upload has no MIME / extension filter",
        "multer() in %FILE% accepts any file type. Attackers can upload .html, .svg, or executable payloads.",
        "Provide a fileFilter that whitelists allowed mimetypes (e.g. image/png, image/jpeg).",
        "CWE-434",
    ),
    Entry(
        "upload-public-dir", "scan_app_security", "critical", "upload",
        "User uploads stored in a public directory",
        "Uploads land in a publicly served folder (%FILE%:%LINE%). Anyone who guesses the URL can fetch them.",
        "Store uploads outside the public/ directory (e.g. S3, R2, or a private uploads/ folder) and serve through an authenticated route.",
        "CWE-552",
    ),
    Entry(
        "error-stack-exposed", "scan_app_security", "warning", "error-exposure",
        "Stack trace / error object returned to client",
        "Raw error returned to the client at %FILE%:%LINE%. Leaks file paths, stack frames, library internals.",
        'Return a generic message ({ error: "Internal server error" }) and log the full error server-side only.',
        "CWE-209",
    ),
    Entry(
        "sensitive-log", "scan_app_security", "warning", "logging",
        "Sensitive data printed to logs",
        "%FILE%:%LINE% logs sensitive data. Logs are searchable and end up in third-party log services.",
        "Never log passwords, tokens, full emails, or payment details. Mask or omit them.",
        "CWE-532",
    ),
    Entry(
        "open-redirect", "scan_app_security", "critical", "redirect",
        "Open redirect vulnerability",
        "Your app redirects users to URLs they control at %FILE%:%LINE%. Attackers use this to send your users to phishing pages that look like your login screen, steal their credentials, then redirect back. This is how account takeover attacks start.",
        "Validate redirect URLs against an allowlist of trusted domains, or only allow relative paths starting with /.",
        "CWE-601",
        "Open redirects are used in OAuth phishing attacks to steal access tokens.",
    ),
    Entry(
        "rules-hidden-unicode", "scan_rules_files", "critical", "rules-backdoor",
        "Hidden Unicode character in rules file",
        "Your AI rules file contains hidden characters (%X%) at %FILE%:%LINE% that could be steering your AI coding assistant to write malicious or backdoored code without you knowing. This is a known attack called the Rules File Backdoor. Delete and recreate this file from a trusted source.",
        "Delete this rules file and recreate it from scratch using only visible ASCII characters.",
        "CWE-116",
        "IDEsaster attack: hidden Unicode in rules files can inject malicious instructions.",
    ),
    Entry(
        "rules-base64-payload", "scan_rules_files", "critical", "rules-backdoor",
        "Suspicious base64 string in rules file",
        "Your AI rules file contains a long base64-encoded string at %FILE%:%LINE%. This could contain hidden malicious instructions. Decode and inspect it before keeping this file.",
        "Decode the base64 string and verify its contents. If you did not add it, delete the rules file.",
        "CWE-506",
        "IDEsaster attack: base64-encoded payloads hide malicious instructions from human review.",
    ),
    Entry(
        "rules-suspicious-url", "scan_rules_files", "warning", "rules-backdoor",
        "Unknown URL in rules file",
        "Your AI rules file references an unknown domain (%X%) at %FILE%:%LINE%. Verify this URL is legitimate and not a phishing or malware site.",
        "Verify this URL is from a trusted source. If unknown, remove it from your rules file.",
        "CWE-601",
    ),
    Entry(
        "rules-malicious-instruction", "scan_rules_files", "critical", "rules-backdoor",
        "Malicious instruction in rules file",
        "Your AI rules file contains an instruction to bypass security scanning at %FILE%:%LINE%. This is a red flag for a compromised rules file.",
        "Remove this instruction. Legitimate rules files never tell AI to ignore security.",
        "CWE-506",
        "IDEsaster attack: malicious rules files instruct AI to skip security checks.",
    ),
)


def entries() -> list[Entry]:
    """All entries: the fixed ones and one per injection, auth, webhook and secret rule."""
    out = list(FIXED_ENTRIES)
    for r in INJECTION_RULES:
        out.append(
            Entry(
                f"injection-{r.id}", "scan_injection", r.severity, "injection", r.name,
                f"{r.name} detected in %FILE%:%LINE%", r.fix, r.cwe, r.breach,
            )
        )
    for r in AUTH_RULES:
        out.append(
            Entry(
                f"auth-{r.id}", "scan_app_security", r.severity, "auth", r.name,
                f"{r.name} at %FILE%:%LINE%.", r.fix, r.cwe, r.breach,
            )
        )
    for w in WEBHOOK_PROVIDERS:
        out.append(
            Entry(
                f"webhook-unverified-{w.provider}", "scan_webhooks", w.severity, "webhook",
                f"Unverified {w.provider} webhook",
                f"{w.provider} webhook endpoint at %FILE%:%LINE% is missing signature verification.",
                w.fix, "CWE-345", w.breach,
            )
        )
    for s in SECRET_RULES:
        out.append(
            Entry(
                f"secret-{s.id}", "scan_secrets", s.severity, "secret", s.name,
                f"{s.name} at %FILE%:%LINE%.", s.fix, s.cwe, s.breach,
            )
        )
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """The entries as a DataFrame.  Its size is fixed by this module (about 100 rows),
    so joins may broadcast it."""
    return spark.createDataFrame(
        entries(),
        "rule string, scanner string, severity string, category string, title string, "
        "message string, fix string, cwe string, breach_precedent string",
    )


def attach_texts(hits: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """hits(repo_id, path, rule, line, detail, severity, confidence, *keep) -> findings.

    ``severity`` NULL means the entry's own.
    """
    dim = F.broadcast(
        catalogue(hits.sparkSession).withColumnRenamed("severity", "_base_severity")
    )
    x = F.coalesce(F.col("detail"), F.lit(""))
    line_text = F.coalesce(F.col("line").cast("string"), F.lit("0"))
    at = F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit(""))

    def fill(name: str):
        out = F.replace(F.col(name), F.lit("%X%"), x)
        out = F.replace(out, F.lit("%LINE%"), line_text)
        out = F.replace(out, F.lit("%AT%"), at)
        return F.replace(out, F.lit("%FILE%"), F.coalesce(F.col("path"), F.lit("")))

    return hits.join(dim, "rule").select(
        "repo_id",
        "scanner",
        fill("rule").alias("id"),
        calibrated_severity(
            F.coalesce(F.col("severity"), F.col("_base_severity")),
            F.coalesce(F.col("confidence"), F.lit(1.0)),
        ).alias("severity"),
        "category",
        fill("title").alias("title"),
        fill("message").alias("message"),
        F.col("path").alias("file"),
        "line",
        fill("fix").alias("fix"),
        F.lit(None).cast("string").alias("docs"),
        "cwe",
        "breach_precedent",
        "confidence",
        *keep,
    )
