"""Webhook handlers: missing signature checks, missing failure handling, exec calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import lexing
from palisade.functions.classify import is_display_copy
from palisade.functions.paths import MODULE_EXTENSIONS, is_server_handler
from palisade.model import HITS
from palisade.operators.file_scan import (
    FileView,
    all_of,
    contains_any,
    rlike,
    sql_text,
    walked,
)
from palisade.rules.fixed_rules import WEBHOOK_PROVIDERS

# Payment events and the calls that run a command.
SUCCESS_EVENTS = (
    "charge.succeeded",
    "payment_intent.succeeded",
    "checkout.session.completed",
    "invoice.paid",
    "invoice.payment_succeeded",
)
FAILURE_EVENTS = (
    "invoice.payment_failed",
    "customer.subscription.deleted",
    "charge.dispute.created",
    "charge.failed",
    "payment_intent.payment_failed",
)
EXEC_CALL = r"\b(exec|execSync|eval)\s*\("
UNVERIFIED_CONFIDENCE = 0.9

# A literal of each provider's endpoint patterns, lower case.
_ENDPOINT_LITERALS = {
    "stripe": ("stripe", "/api/webhook"),
    "paystack": ("paystack",),
    "mpesa": ("mpesa",),
    "github": ("github",),
    "flutterwave": ("flutterwave", "rave"),
}


# Line comments, then block comments that close on their line.
_LINE_COMMENT = r"//[^\n\r\u2028\u2029]*(?=\n|\z)"
_BLOCK_COMMENT = r"/\*[^\n\r\u2028\u2029]*?\*/"
WITHOUT_COMMENTS = (
    f"regexp_replace(regexp_replace(content, {sql_text(_LINE_COMMENT)}, ''), "
    f"{sql_text(_BLOCK_COMMENT)}, '')"
)


def is_handler_file(view: FileView) -> str:
    """Handler file with a word some webhook rule needs (the cheap test comes first)."""
    words = tuple(w for group in _ENDPOINT_LITERALS.values() for w in group) + ("webhook",)
    named = view.passes((words,))
    return view.flag(
        "handler",
        lambda: walked(MODULE_EXTENSIONS)
        & F.expr(named)
        & is_server_handler(F.col("path"), F.col("content")),
    )


def unverified(view: FileView) -> None:
    """Per endpoint pattern the first matching line decides; a file can fire once each.

    A match counts in code or in a plain string (a route path), not in prose.
    """
    raws = []
    for provider in WEBHOOK_PROVIDERS:
        words = _ENDPOINT_LITERALS[provider.provider]
        gate = all_of(
            "not _doc and not _test",
            is_handler_file(view),
            view.passes((words,)),
            f"not {contains_any(provider.proofs, WITHOUT_COMMENTS)}",
        )
        raws += [
            view.raw_matches(
                f"webhook-unverified-{provider.provider}", pattern, gate,
                needs=(words,), once=False, only_first_line=True,
            )
            for pattern in provider.endpoints
        ]

    def is_real(h):
        state = lexing.state_in_line(h["start_state"], h["before"], h["text"])
        return F.transform(
            F.array(state),
            lambda s: ~s.isin("//", "/*")
            & ~lexing.is_jsx_text(F.col("_ext"), h["text"], h["before"])
            & ~(s.isin("'", '"', "`") & is_display_copy(h["text"], h["before"])),
        )[0]

    view.emit_column(
        F.transform(
            F.filter(F.expr(f"concat({', '.join(raws)})"), is_real),
            lambda h: F.struct(
                h["rule"].alias("rule"),
                (h["line"] + 1).alias("line"),
                h["detail"].alias("detail"),
                h["severity"].alias("severity"),
                F.lit(UNVERIFIED_CONFIDENCE).alias("confidence"),
            ),
        ).cast(HITS)
    )


def missing_failure(view: FileView) -> None:
    gate = all_of(
        view.has("stripe"),
        f"{view.has('webhook')} or {rlike('webhook', True, of='path')}",
        is_handler_file(view),
        contains_any(SUCCESS_EVENTS, of="content"),
        f"not {contains_any(FAILURE_EVENTS, of='content')}",
    )
    view.emit(
        view.line_hits("webhook-missing-failure-handler", gate, contains_any(SUCCESS_EVENTS))
    )


def exec_calls(view: FileView) -> None:
    """Every exec / eval line of a webhook handler, once for each provider rule."""
    view.vet(
        view.raw_matches(
            "webhook-command-injection", EXEC_CALL,
            all_of(view.has("webhook"), is_handler_file(view)),
            needs=(("exec", "eval"),), ignore_case=False, once=False,
            copies=len(WEBHOOK_PROVIDERS),
        )
    )


def webhooks(view: FileView) -> None:
    missing_failure(view)
    unverified(view)
    exec_calls(view)
