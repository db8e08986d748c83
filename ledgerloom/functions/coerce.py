"""Lenient coercions of text to typed columns; anything unreadable becomes null, never an error (also under ANSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.?)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def _float(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT) | text.rlike(_SPECIAL), F.replace(F.trim(text), F.lit("_"), F.lit(""))).try_cast("double")


def round_cents(value: Column) -> Column:
    """Two decimals, halves to even after scaling (1.005 is 1.0); exact ties such as 2.675 may differ by a cent from
    rounding the binary value."""
    return F.when(F.abs(value) < 1e13, F.rint(value * 100) / 100).otherwise(value)


def to_money(text: Column) -> Column:
    """Double rounded to cents; dollar signs and commas are dropped, JSON ``true``/``false`` count as 1 and 0."""
    bare = F.regexp_replace(F.trim(text), "[$,]", "")
    return round_cents(F.when(bare == "true", 1.0).when(bare == "false", 0.0).otherwise(_float(bare)))


def to_int(text: Column) -> Column:
    """Whole number, truncated towards zero; commas are dropped, infinities are null."""
    number = _float(F.replace(text, F.lit(","), F.lit("")))
    return F.when(F.abs(number) < 9.2e18, number).try_cast("bigint")


def to_date(text: Column) -> Column:
    """Date of an ISO start, else of the first word read as m/d/y, d/m/y (if the month would exceed 12) or y/m/d."""
    s = F.trim(text)
    iso, head = F.substring(s, 1, 10), F.regexp_extract(s, r"^(\S+)", 1)
    slashed = head.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.coalesce(
        F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd")),
        F.when(iso.rlike(r"^\d{8}$"), F.try_to_date(iso, "yyyyMMdd")),
        F.when(slashed, F.try_to_date(head, "M/d/yyyy")),
        F.when(slashed, F.try_to_date(head, "d/M/yyyy")),
        F.when(head.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(head, "yyyy/M/d")),
    )


def to_datetime(text: Column) -> Column:
    """ISO date-time text, or the date alone where there is no time of day; kept as text to preserve the zone as written."""
    s = F.trim(text)
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
    good = s.rlike(iso) & F.try_to_timestamp(F.regexp_replace(s, " ", "T")).isNotNull()
    with_t = F.regexp_replace(F.regexp_replace(s, "^(.{10}) ", "$1T"), "Z$", "+00:00")
    with_s = F.regexp_replace(with_t, r"^(.{16})($|[+-])", "$1:00$2")
    return F.when(good, with_s).otherwise(F.date_format(to_date(text), "yyyy-MM-dd"))


def to_text(text: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


COERCIONS = {"money": to_money, "int": to_int, "date": to_date, "datetime": to_datetime, "text": to_text}
