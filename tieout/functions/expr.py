"""Column builders shared by the operators: money, identifiers, instants, signatures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest amount that counts as money at all, in major units.
LIVE = 0.005


def signed(credit: Column, debit: Column) -> Column:
    """Credit less debit, an absent side counting as zero."""
    return F.coalesce(credit, F.lit(0)) - F.coalesce(debit, F.lit(0))


def minor(amount: Column) -> Column:
    """Integer minor units (hundredths), half away from zero; null counts as 0."""
    return F.round(F.coalesce(amount, F.lit(0)) * 100).cast("bigint")


def numeric_text(text: Column) -> Column:
    """Whether a trimmed string is made of number characters only."""
    return F.trim(text).rlike("^[0-9.eE+-]+$")


def number(text: Column) -> Column:
    """The number a string holds, thousands separators dropped; null where there is none."""
    return F.regexp_replace(F.trim(text.cast("string")), ",", "").try_cast("double")


def money_characters(text: Column) -> Column:
    """The digits, separators, signs and brackets of a string."""
    return F.regexp_replace(text.cast("string"), r"[^0-9.,+\-()]", "")


def minor_of_characters(kept: Column, also: Column | None = None) -> Column:
    """Exact minor units from ``money_characters``, or null; ``also`` is a condition on top. Cheapest where ``kept`` is a plain column."""
    inside = kept.startswith("(") & kept.endswith(")")
    bare = F.translate(kept, "(),", "")
    ok = bare.rlike(r"^[+-]?\d+(\.\d+)?$")
    whole = hundredths(bare)
    return F.when(ok if also is None else ok & also, F.when(inside, -F.abs(whole)).otherwise(whole))


def hundredths(value: Column) -> Column:
    """A number, or the text of one, in whole hundredths, half away from zero; null beyond 64 bits."""
    return F.round((value.try_cast("decimal(38,10)") * 100).try_cast("decimal(38,6)"), 0).try_cast("bigint")


def money_minor(text: Column, strict: bool = False) -> Column:
    """Exact minor units of a money string, or null.

    Every character but digits, separators, signs and brackets is dropped, a
    value in brackets is negative. The lenient form thus reads digits out of
    identifiers as well; ``strict`` takes only strings that are money as they stand.
    A value beyond 64 bits is null.
    """
    plain = F.trim(text.cast("string")).rlike(r"^\(?\s*[^\w\s]?\s*[+-]?[\d,]+(\.\d+)?\s*\)?$") if strict else None
    return minor_of_characters(money_characters(text), plain)


def exact_number(kind: str) -> bool:
    """Whether a type's name is that of whole or decimal numbers."""
    return kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint")


def signature(text: Column, length: int = 40) -> Column:
    """The shape of a value: digits as 9, capitals as A, other letters as a, runs of three or more cut to three."""
    cut = F.substring(text.cast("string"), 1, length)
    classed = reduce(lambda c, by: F.regexp_replace(c, *by), [(r"\p{Nd}", "9"), (r"\p{Lu}", "A"), (r"(?!A)\p{Ll}", "a")], cut)
    return F.regexp_replace(classed, r"(.)\1{2,}", "$1$1$1")


def slug(name: str) -> str:
    """A name as lower-case letters, digits and single underscores."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "x"


def iso_instant(text: Column) -> Column:
    """The instant of an ISO date or timestamp string; null for any other string."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.try_to_timestamp(text))


def instant_micros(text: Column) -> Column:
    return F.unix_micros(iso_instant(text))


def largest(rank: list[Column], value: Column) -> Column:
    """Aggregate: ``value`` of the row with the largest rank; ranks are compared in order, so ties must be ended by the last."""
    return F.max_by(value, F.struct(*rank))
