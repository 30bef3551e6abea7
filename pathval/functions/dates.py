"""Dates, spans and the engine's year fraction, on the driver and as columns."""

from __future__ import annotations

import datetime as dt
import math
import re

from dateutil.parser import parse as parse_date
from dateutil.relativedelta import relativedelta
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathval.errors import DslSyntaxError

SPAN = re.compile(r"(\d+)([dmy])\Z")


def as_date(value: object) -> dt.date:
    """A calendar day from a day, a moment or a string such as 2011-1-31."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str) and re.fullmatch(r"\s*\d{4}-\d{1,2}-\d{1,2}([T ].*)?", value):
        try:
            return parse_date(value).date()
        except (ValueError, OverflowError):
            pass
    raise DslSyntaxError("invalid date", repr(value))


def as_span(value: str) -> relativedelta:
    """A span of days, months or years, such as 3m."""
    m = SPAN.match(value) if isinstance(value, str) else None
    if not m:
        raise DslSyntaxError("invalid time delta", repr(value))
    return relativedelta(**{{"d": "days", "m": "months", "y": "years"}[m[2]]: int(m[1])})


def year_fraction(start: dt.date, end: dt.date) -> float:
    """Whole years and months from start to end, and the days left as parts of 365."""
    gap = relativedelta(end, start)
    return gap.years + gap.months / 12.0 + gap.days / 365.0


def discount_factor(start: dt.date, end: dt.date, rate: float) -> float:
    """What a unit paid at ``end`` is worth at ``start``; ``rate`` in percent, compounded continuously."""
    return math.exp(-(rate / 100.0) * year_fraction(start, end))


def year_fraction_column(start: Column, end: Column) -> Column:
    """:func:`year_fraction` of two date columns: months are counted whole first, clipped at month ends."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    reached = F.add_months(start, months)
    whole = F.when((start <= end) & (reached > end), months - 1).when((start > end) & (reached < end), months + 1).otherwise(months)
    years = F.when(whole >= 0, F.floor(whole / 12)).otherwise(F.ceil(whole / 12))
    return years.cast("double") + (whole - years * 12) / F.lit(12.0) + F.datediff(end, F.add_months(start, whole.cast("int"))) / F.lit(365.0)


def discount_column(value: Column, start: Column, end: Column, rate: float) -> Column:
    return value * F.exp(F.lit(-rate / 100.0) * year_fraction_column(start, end))


def contract_symbol(root: Column, day: Column) -> Column:
    """Futures symbol: the root, the letter of the month, the year."""
    letters = F.array(*[F.lit(x) for x in MONTH_LETTERS])
    return F.concat(root, F.element_at(letters, F.month(day)), F.year(day).cast("string"))


#: Delivery month letters of futures, January first.
MONTH_LETTERS = "FGHJKMNQUVXZ"


def perturbation_name(market: str, delivery: dt.date, periodisation: str | None) -> str | None:
    """The name of the period that a price belongs to."""
    if not periodisation:
        return None
    parts = {"al": (), "ye": (delivery.year,), "mo": (delivery.year, delivery.month), "da": (delivery.year, delivery.month, delivery.day)}
    found = parts.get(periodisation[:2])
    if found is None:
        raise ValueError(f"periodisation {periodisation!r} is none of alltime, yearly, monthly, daily")
    return "-".join([market, *map(str, found)])
