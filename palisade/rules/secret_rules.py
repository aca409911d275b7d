"""Secret token formats.

The first five shapes are fixed values (they also drive the history check).  The others
are this project's own choice of public token formats for the same providers, plus the
quoted ``token = "..."`` assignment.
"""

from __future__ import annotations

from typing import NamedTuple


class SecretRule(NamedTuple):
    id: str
    name: str
    pattern: str
    severity: str
    fix: str
    literals: tuple[str, ...]  # lower-cased texts, one of which every match contains
    context_required: str | None = None  # pattern the same file has to hold
    cwe: str = "CWE-798"
    breach: str | None = None


# Full token shapes looked for in commit history (label, pattern).
HISTORY_SHAPES: tuple[tuple[str, str], ...] = (
    ("sk_live_", r"sk_live_[A-Za-z0-9]{20,}"),
    ("sk_test_", r"sk_test_[A-Za-z0-9]{20,}"),
    ("AKIA (AWS key)", r"AKIA[0-9A-Z]{16}"),
    ("FLWSECK", r"FLWSECK[_-][A-Za-z0-9]{12,}"),
    ("Supabase JWT", r"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9\.[A-Za-z0-9_-]{30,}"),
)

_ROTATE = "Move the value to an environment variable on the server and rotate the key."

SECRET_RULES: tuple[SecretRule, ...] = (
    SecretRule("stripe-sk-live", "Stripe live secret key", HISTORY_SHAPES[0][1], "critical", _ROTATE, ("sk_live_",)),
    SecretRule("stripe-sk-test", "Stripe test secret key", HISTORY_SHAPES[1][1], "warning", _ROTATE, ("sk_test_",)),
    SecretRule("aws-access-key", "AWS access key", HISTORY_SHAPES[2][1], "critical", _ROTATE, ("akia",)),
    SecretRule("flutterwave-secret", "Flutterwave secret key", HISTORY_SHAPES[3][1], "critical", _ROTATE, ("flwseck",)),
    SecretRule(
        "service-role-frontend", "Supabase service role key in source code", HISTORY_SHAPES[4][1],
        "critical", _ROTATE, ("eyjhbgcioijiuzi1niisinr5cci6ikpxvcj9.",),
        r"service_?role",
    ),
    SecretRule("stripe-restricted", "Stripe restricted key", r"rk_live_[A-Za-z0-9]{20,}", "critical", _ROTATE, ("rk_live_",)),
    SecretRule("openai-key", "OpenAI API key", r"sk-proj-[A-Za-z0-9_-]{20,}", "critical", _ROTATE, ("sk-proj-",)),
    SecretRule("anthropic-key", "Anthropic API key", r"sk-ant-[A-Za-z0-9_-]{20,}", "critical", _ROTATE, ("sk-ant-",)),
    SecretRule("github-token", "GitHub token", r"gh[pousr]_[A-Za-z0-9]{36,}", "critical", _ROTATE, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("sendgrid-key", "SendGrid API key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "critical", _ROTATE, ("sg.",)),
    SecretRule("twilio-key", "Twilio API key", r"SK[0-9a-f]{32}", "critical", _ROTATE, ("sk",)),
    SecretRule("resend-key", "Resend API key", r"re_[A-Za-z0-9]{8,}_[A-Za-z0-9]{16,}", "critical", _ROTATE, ("re_",)),
    SecretRule(
        "token-assignment", "Token assigned as a literal",
        r"""token\s*=\s*['"][A-Za-z0-9_-]{20,}['"]""", "critical", _ROTATE, ("token",),
    ),
)
# Part of a token-assignment match that is the secret itself.
TOKEN_VALUE = r"""['"]([A-Za-z0-9_-]{20,})['"]"""
