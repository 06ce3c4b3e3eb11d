"""Amounts as Column expressions: reading tokens in any style of separators, and telling them from dates, phones and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import AMOUNT, DATE_LIKE, LONG_NUMBER, PHONE_LIKE, PLAIN_NUMBER
from quillstone.functions.text import let, strip


def amount_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0))


def normalize_token(token: Column) -> Column:
    """'1234.50' for a token that reads as an amount, else null.

    Of two kinds of separators the later one is the decimal; one kind twice or more is decimal only before two last digits; a
    single separator is decimal before one or two digits. More than two decimals are rounded half up; long numbers stay exact, and those of over 36 digits are null.
    """
    return let(F.trim(token), normalize_trimmed)


def normalize_trimmed(t: Column) -> Column:
    """As normalize_token, of a token without spaces at its ends; t is named more than once."""
    return F.when(t.rlike(r"^[1-9]\d{0,17}\.\d{2}$"), t).when(t.rlike(r"^[1-9]\d{0,17}$"), F.concat(t, F.lit(".00"))).otherwise(_any_token(t))


def _any_token(token: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(token, r"(?i)\b(?:rm|usd|eur|aed)\b", ""), r"[^0-9,.\-+]", "")
    return let(cleaned, lambda c: F.concat(F.when(F.startswith(c, F.lit("-")), "-").otherwise(""), let(let(F.regexp_replace(c, r"^[+-]", ""), _plain), _two_places)))


def _plain(b: Column) -> Column:
    """Digits with at most one dot, if the separators make sense."""
    separators, bare = F.regexp_count(b, F.lit("[,.]")), F.regexp_replace(b, "[,.]", "")
    both = F.contains(b, F.lit(",")) & F.contains(b, F.lit("."))
    mark_last = F.replace(F.regexp_replace(F.regexp_replace(b, r"[,.]([^,.]{2})$", "|$1"), "[,.]", ""), F.lit("|"), F.lit("."))
    plain = (
        F.when(both & b.rlike(r"\.[^,]*$"), F.replace(b, F.lit(","), F.lit("")))
        .when(both, F.replace(F.replace(b, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((separators > 1) & b.rlike(r"[,.][^,.]{2}$"), mark_last)
        .when((separators == 1) & b.rlike(r"[,.][^,.]{1,2}$"), F.replace(b, F.lit(","), F.lit(".")))
        .when(separators > 0, bare)
        .otherwise(b)
    )
    return F.regexp_replace(plain, r"^\.", "0.")


def _two_places(p: Column) -> Column:
    return F.when(p.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), p.try_cast("decimal(38,2)").cast("string"))


def normalize_amount(c: Column) -> Column:
    """The token's reading, or else the text itself, stripped."""
    return F.coalesce(normalize_token(c), strip(c))


def parse_amount(c: Column) -> Column:
    return normalize_token(c).try_cast("double")


def looks_like_date(token: Column) -> Column:
    return (F.contains(token, F.lit("/")) | F.contains(token, F.lit("-"))) & token.rlike(DATE_LIKE)


def _long_plain(token: Column) -> Column:
    t = strip(token)
    return ~(F.contains(token, F.lit(".")) | F.contains(token, F.lit(","))) & (F.char_length(F.regexp_replace(t, r"\D", "")) >= 7)


def looks_like_phone(token: Column) -> Column:
    return _long_plain(token) & strip(token).rlike(PHONE_LIKE)


def looks_like_invoice(token: Column) -> Column:
    return _long_plain(token) & token.rlike(LONG_NUMBER)


def plain_tokens(c: Column) -> Column:
    """Distinct numbers in a text for the consistency test: commas as dots, without zeros in front."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(PLAIN_NUMBER), F.lit(0)), without_zeros))


def without_zeros(token: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.replace(token, F.lit(","), F.lit(".")), "^0+", ""), F.lit("")), F.lit("0"))


def amount_variants(amount: Column) -> Column:
    """An amount with two, one and no decimals, as plain_tokens has them; rounded half up but for whole numbers, half even."""
    whole = F.rint(amount).cast("decimal(28,0)").cast("string")
    two, one = (amount.cast(f"decimal(28,{k})").cast("string") for k in (2, 1))
    return F.when(amount > 0, F.array(*[without_zeros(x) for x in (two, one, whole)])).otherwise(F.array().cast("array<string>"))
