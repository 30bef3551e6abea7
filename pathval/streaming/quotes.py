"""Quotes as a stream: last price of each market and window, late ones within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathval.sources import calibrate


def last_prices(stream: DataFrame, window: str = "1 day", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """Last price of each market in each window of (market, ts, price)."""
    w = F.window(ts, window)
    found = stream.withWatermark(ts, late).groupBy(w, "market").agg(F.max_by("price", ts).alias("price"))
    return found.select("market", F.col("window.start").alias("start"), "price")


def recalibrate(stream: DataFrame, history: str, done: Callable[[DataFrame, int], None]):
    """Starts a query that adds each batch's closed windows to ``history`` and hands on new volatilities.

    A batch that is run again overwrites its own part of the history, so none counts twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.select("market", F.col("start").cast("date").alias("date"), "price").write.mode("overwrite").parquet(f"{history}/batch={number}")
        known = rows.sparkSession.read.schema("market string, date date, price double").option("recursiveFileLookup", True).parquet(history)
        done(calibrate.historical_volatility(known, ["market"]), number)

    return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{history}-checkpoint").start()
