"""Numbers written as text: patterns, classification and conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import dates
from plumbline.functions.text import strip

# --- fixed values -----------------------------------------------------------
INT = r"^[+-]?\d+$"
INT_GROUPED = r"^[+-]?\d{1,3}(?:,\d{3})+$"
DECIMAL = r"^[+-]?(?:\d+\.\d*|\.\d+|\d{1,3}(?:,\d{3})+\.\d+)$"
SCIENTIFIC = r"^[+-]?\d+(?:\.\d+)?[eE][+-]?\d+$"
PERCENT = r"^[+-]?\d+(?:\.\d+)?\s*%$"
CURRENCY = (
    r"^[+-]?[$£€¥₹₩]\s*\d{1,3}(?:[,\s]?\d{3})*(?:\.\d+)?$"
    r"|^\d{1,3}(?:[,\s]?\d{3})*(?:\.\d+)?\s*"
    r"(?:USD|EUR|GBP|INR|JPY|AUD|CAD|\$|£|€|₹)$"
)
PAREN_NEGATIVE = r"^\(\s*[$£€₹]?[\d,]+(?:\.\d+)?\s*\)$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
URL = r"(?i)^(?:https?://|www\.)\S+$"
PHONE = r"^[+(]?[\d][\d\s().\-]{6,}\d$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CURRENCY_MARKER = r"[$£€¥₹₩]|\b(?:USD|EUR|GBP|INR|JPY|AUD|CAD)\b"
CURRENCY_CODE_TAIL = r"(?i)(?:USD|EUR|GBP|INR|JPY|AUD|CAD)$"
STRIP_NUMERIC = "$£€¥₹₩,%\xa0 "

CLEAN_INTEGER = r"\A[+-]?\d+\z"
CLEAN_NUMBER = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"

UPLOAD_CURRENCY = (
    r"^\s*[$€£¥₹₩]\s*[+-]?\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\s*$"
    r"|^\s*[+-]?\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\s*[$€£¥₹₩]\s*$"
)
UPLOAD_PERCENT = r"^\s*[+-]?\d+(?:\.\d+)?\s*%\s*$"
UPLOAD_GROUPED = r"^\s*[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*$"

# The order in which a value's type tag is decided.
TYPE_TAGS = ("uuid", "email", "url", "percent", "currency", "date",
             "integer", "decimal", "phone", "text")
# --- end of fixed values ----------------------------------------------------


def parse_double(c: Column) -> Column:
    """Decimal or scientific text to double; anything else is null."""
    return F.when(c.rlike(CLEAN_NUMBER), c.try_cast("double"))


def looks_numeric(c: Column) -> Column:
    v = strip(c)
    bare = F.translate(v, STRIP_NUMERIC, "")
    return v.rlike(PAREN_NEGATIVE) | (
        (bare != "") & (bare.rlike(INT) | bare.rlike(DECIMAL) | bare.rlike(SCIENTIFIC)))


def to_number(c: Column) -> Column:
    """Best-effort number from text: symbols, grouping, percent sign and
    currency codes dropped, parentheses read as a minus."""
    v = strip(c)
    negative = v.rlike(PAREN_NEGATIVE)
    inner = F.when(negative, strip(F.translate(v, "()", ""))).otherwise(v)
    bare = F.regexp_replace(F.translate(inner, STRIP_NUMERIC, ""),
                            CURRENCY_CODE_TAIL, "")
    number = parse_double(bare)
    return F.when(negative, -number).otherwise(number)


def classify_value(c: Column, date_test: Column | None = None, trimmed: bool = False) -> Column:
    """One type tag per text value; the first pattern that fits wins.

    ``date_test`` lets a caller that has already parsed dates pass the answer,
    ``trimmed`` one whose text is trimmed already spare every pattern a second trim.
    """
    v = c if trimmed else strip(c)
    is_date = dates.is_date(v) if date_test is None else date_test
    return (
        F.when(v == "", "blank")
        .when(v.rlike(UUID), "uuid")
        .when(v.rlike(EMAIL), "email")
        .when(v.rlike(URL), "url")
        .when(v.rlike(PERCENT), "percent")
        .when(v.rlike(CURRENCY) | v.rlike(PAREN_NEGATIVE), "currency")
        .when(is_date, "date")
        .when(v.rlike(SCIENTIFIC), "decimal")
        .when(v.rlike(INT) | v.rlike(INT_GROUPED), "integer")
        .when(v.rlike(DECIMAL), "decimal")
        .when(v.rlike(PHONE), "phone")
        .otherwise("text")
    )


def currency_marker(c: Column) -> Column:
    """The first currency symbol or code in the text, or null."""
    return F.nullif(F.regexp_extract(c, "(" + CURRENCY_MARKER + ")", 1), F.lit(""))
