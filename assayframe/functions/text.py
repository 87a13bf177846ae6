"""Column builders for text: rendering, folding, keyword and marker extraction."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def money2(amount: Column) -> Column:
    """An amount with two decimals and no grouping."""
    return F.replace(F.format_number(amount, 2), F.lit(","), F.lit(""))


def digit_fold(text: Column) -> Column:
    """All ASCII digits of a text read as one number modulo 2^64 (as a signed long); null if there are none or all are zero.

    Digits are taken 18 at a time, so texts of any length have a value.
    """
    whole = lambda x: x.cast("decimal(38,0)")
    digits = F.regexp_replace(text, "[^0-9]", "")
    pieces = F.regexp_extract_all(digits, F.lit("[0-9]{1,18}"), F.lit(0))
    power = lambda piece: whole(F.rpad(F.lit("1"), F.length(piece) + 1, F.lit("0")))
    n = F.aggregate(pieces, whole(F.lit(0)), lambda acc, piece: whole((whole(acc * power(piece)) + whole(piece)) % F.lit(Decimal(2**64))))
    signed = F.when(n >= F.lit(Decimal(2**63)), n - F.lit(Decimal(2**64))).otherwise(n)
    return F.nullif(F.when(F.length(digits) <= 18, digits.try_cast("long")).otherwise(signed.cast("long")), F.lit(0).cast("long"))


def keyword_hits(text: Column, words: tuple[str, ...], fold: bool = True) -> Column:
    """The ``words`` that a text contains, in their own order (substring match; ``fold``: on the lowered text)."""
    low = F.lower(text) if fold else text
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def csv_list(text: Column) -> Column:
    """A comma-separated list as a sorted array: items trimmed, empty ones dropped, repeats removed."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def drop_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"[ \t\r\n]+", " ")


def csv_quoted(text: Column) -> Column:
    """A text as an always-quoted CSV field."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def pdf_escaped(text: Column) -> Column:
    for c in "\\()":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def claim_markers(text: Column) -> Column:
    """Claim ids between ``<!-- CLAIM:`` and ``-->``, trimmed, those that start with C."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?s)<!-- CLAIM:(.*?)-->"), F.lit(1)), lambda x: F.trim(x)), lambda x: x.startswith("C"))
