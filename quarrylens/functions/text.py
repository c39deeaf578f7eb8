"""Free-text rules: scrubbing, hit counts, secret redaction and word matches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Personal-data patterns and their replacements, in scrubbing order.
SCRUB_PATTERNS = {
    "email": (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]"),
    "phone": (
        r"\b(?:\+?\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b",
        "[REDACTED_PHONE]",
    ),
    "card": (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[REDACTED_CARD]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
}
KEY_PATTERN = r"key=[a-zA-Z0-9_\-]+"

WORD_CHARACTER = r"[\p{L}\p{N}_]"


def _may_hold(kind: str, text: Column) -> Column:
    """Cheap necessary condition, so that most texts skip the pattern."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike(r"\d{4}")


def scrubbed(text: Column) -> Column:
    """Replace personal data in the fixed order, e-mail first.

    No replacement text holds an at sign or a digit, so both conditions can
    be read off the original text.
    """
    pattern, label = SCRUB_PATTERNS["email"]
    no_email = F.when(_may_hold("email", text), F.regexp_replace(text, pattern, label)).otherwise(text)
    no_numbers = no_email
    for kind in ("phone", "card", "ssn"):
        pattern, label = SCRUB_PATTERNS[kind]
        no_numbers = F.regexp_replace(no_numbers, pattern, label)
    return F.when(_may_hold("phone", text), no_numbers).otherwise(no_email)


def hit_count(text: Column, kind: str) -> Column:
    """How often one pattern occurs in the text as given; null text has none."""
    count = F.regexp_count(text, F.lit(SCRUB_PATTERNS[kind][0]))
    return F.when(_may_hold(kind, text), count).otherwise(0)


def redacted_secrets(message: Column, secrets: Iterable[str] = ()) -> Column:
    """Hide known secrets and `key=` values; an absent message reads as empty."""
    hidden = F.coalesce(message, F.lit(""))
    for secret in secrets:
        if secret:
            hidden = F.replace(hidden, F.lit(secret), F.lit("[REDACTED_API_KEY]"))
    return F.regexp_replace(hidden, KEY_PATTERN, "key=[REDACTED]")


def whole_word(token: str) -> str:
    """Pattern of a word token standing by itself."""
    return rf"(?<!{WORD_CHARACTER}){token}(?!{WORD_CHARACTER})"
