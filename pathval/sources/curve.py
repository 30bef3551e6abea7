"""Forward curves: the price of a delivery date is the last one quoted on or before it."""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathval.functions.dates import as_date


class ForwardCurve:
    """Quotes of one market, looked up on the driver."""

    def __init__(self, name: str, quotes: Iterable[tuple[object, float]]):
        pairs = sorted((as_date(d), float(p)) for d, p in quotes)
        self.name, self.days, self.prices = name, [d for d, _ in pairs], [p for _, p in pairs]

    def price(self, day: object) -> float:
        day = as_date(day)
        k = bisect.bisect_right(self.days, day)
        if not k:
            raise KeyError(f"curve {self.name!r} has no quote by {day.isoformat()}")
        return self.prices[k - 1]


def as_of(wanted: DataFrame, quotes: DataFrame, by: str, day: str, price: str) -> DataFrame:
    """``wanted`` with ``price`` of the last quote of its ``by`` on or before its ``day``, null before the first.

    ``quotes`` has one price for a ``by`` and ``day``.  Both sides meet in one shuffle by key and
    month; the last quote of earlier months is carried in by a small table of a row a key and
    month, so that one key with many rows spreads over its months.
    """
    month = F.trunc(day, "month")
    at = F.struct(F.col(day), F.col(price))
    ends = quotes.groupBy(by, month.alias("pv_month")).agg(F.max(at).alias("pv_end"))
    months = wanted.select(by, month.alias("pv_month")).distinct()
    line = ends.unionByName(months.withColumn("pv_end", F.lit(None).cast(ends.schema["pv_end"].dataType)))
    line = line.groupBy(by, "pv_month").agg(F.max("pv_end").alias("pv_end"))
    before = W.partitionBy(by).orderBy("pv_month").rowsBetween(W.unboundedPreceding, -1)
    carried = line.select(by, "pv_month", F.last(f"pv_end.{price}", ignorenulls=True).over(before).alias("pv_carried"))
    q = quotes.select(by, month.alias("pv_month"), F.col(day).alias("pv_day"), F.lit(0).alias("pv_late"), F.col(price).alias("pv_price"), F.lit(None).alias("pv_row"))
    w = wanted.select(by, month.alias("pv_month"), F.col(day).alias("pv_day"), F.lit(1).alias("pv_late"), F.lit(None).cast("double").alias("pv_price"), F.struct(*wanted.columns).alias("pv_row"))
    both = q.withColumn("pv_row", F.lit(None).cast(w.schema["pv_row"].dataType)).unionByName(w)
    seen = W.partitionBy(by, "pv_month").orderBy("pv_day", "pv_late").rowsBetween(W.unboundedPreceding, 0)
    told = both.withColumn("pv_seen", F.last("pv_price", ignorenulls=True).over(seen)).where("pv_late = 1")
    found = told.join(carried, [by, "pv_month"], "left")
    return found.select("pv_row.*", F.coalesce("pv_seen", "pv_carried").alias(price))
