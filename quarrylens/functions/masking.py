"""Personal-data flags on column names and value masks chosen by column name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.functions.values import quoted

# Name parts that mark a column as personal data.
PII_NAME_PARTS = (
    "email", "phone", "mobile", "address", "ssn", "salary", "income", "card",
    "credit", "password", "secret", "birth", "dob", "zip", "postal", "account",
    "transaction", "tax", "passport", "license",
)

# Name parts whose columns are masked in query results.
RESULT_NAME_PARTS = (
    "email", "phone", "mobile", "address", "card", "salary", "ssn", "password",
)

# What counts as surrounding white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

WHOLLY_MASKED = "[MASKED_PII_DATA]"
PII_LABEL = "Sensitive PII (Masked)"
NON_PII_LABEL = "Non-PII (Standard)"


def is_pii_name(name: str) -> bool:
    lowered = name.lower()
    return any(part in lowered for part in PII_NAME_PARTS)


def pii_name_flag(name: Column) -> Column:
    """The same rule for a catalog column holding column names."""
    return F.lower(name).rlike("|".join(PII_NAME_PARTS))


def pii_label(is_pii: Column) -> Column:
    return F.when(is_pii, PII_LABEL).otherwise(NON_PII_LABEL)


def _last_four(text: Column, lead: str, short: str) -> Column:
    return F.when(F.length(text) >= 4, F.concat(F.lit(lead), F.right(text, F.lit(4)))).otherwise(short)


def _masked_email(text: Column) -> Column:
    parts = F.split(text, "@", -1)
    user = parts[0]
    hidden = F.when(
        F.length(user) > 1,
        F.concat(F.left(user, F.lit(1)), F.repeat(F.lit("*"), F.length(user) - 1)),
    ).otherwise("*")
    return F.when(F.size(parts) == 2, F.concat(hidden, F.lit("@"), parts[1])).otherwise(
        "****@example.com"
    )


def masked(value: Column, name: str) -> Column:
    """Mask a value by its column's name. Null stays null, blank stays blank."""
    text = F.btrim(value.cast("string"), F.lit(WHITE_SPACE))
    lowered = name.lower()
    if "email" in lowered:
        hidden = _masked_email(text)
    elif "phone" in lowered or "mobile" in lowered:
        hidden = _last_four(text, "****-****-", "*" * 10)
    elif "card" in lowered:
        hidden = _last_four(text, "****-****-****-", "*" * 16)
    elif "password" in lowered or "secret" in lowered:
        hidden = F.lit("********")
    elif "salary" in lowered or "income" in lowered or "tax" in lowered:
        hidden = F.lit("$XX,XXX")
    else:
        hidden = F.lit(WHOLLY_MASKED)
    return F.when(text.isNull() | (text == ""), text).otherwise(hidden)


def mask_columns(df: DataFrame, name_parts: Iterable[str] = RESULT_NAME_PARTS) -> DataFrame:
    """Mask every column whose name contains one of the parts; keep the others."""
    parts = tuple(name_parts)
    return df.select(
        *[
            masked(quoted(c), c).alias(c) if any(p in c.lower() for p in parts) else quoted(c)
            for c in df.columns
        ]
    )
