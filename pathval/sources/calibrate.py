"""Calibration from quotes: volatilities, last prices, correlations, forward curves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathval.functions.dates import contract_symbol

#: Trading days of a year.
DAYS_A_YEAR = 252


def last_quotes(quotes: DataFrame, limit: int, by: list[str], day: str = "date") -> DataFrame:
    """The latest ``limit`` rows of each group."""
    latest = W.partitionBy(*by).orderBy(F.desc(day))
    return quotes.withColumn("pv_n", F.row_number().over(latest)).where(F.col("pv_n") <= limit).drop("pv_n")


def log_returns(quotes: DataFrame, by: list[str], day: str = "date", price: str = "price") -> DataFrame:
    before = F.lag(price).over(W.partitionBy(*by).orderBy(day))
    return quotes.withColumn("log_return", F.log(F.col(price) / before))


def historical_volatility(quotes: DataFrame, by: list[str], day: str = "date", price: str = "price") -> DataFrame:
    """Yearly volatility of each group's daily logarithmic returns (sample variance)."""
    var = F.var_samp("log_return") * DAYS_A_YEAR
    return log_returns(quotes, by, day, price).groupBy(*by).agg(F.sqrt(var).alias("volatility"))


def last_price(quotes: DataFrame, by: list[str], day: str = "date", price: str = "price") -> DataFrame:
    return quotes.groupBy(*by).agg(F.max_by(price, day).alias("last_price"))


def correlations(quotes: DataFrame, market: str = "market", day: str = "date", price: str = "price") -> DataFrame:
    """Correlation of each pair of markets' returns on the days both have one; 1 with itself."""
    r = log_returns(quotes, [market], day, price).where("log_return is not null")
    a = r.select(F.col(market).alias("market_a"), F.col(day).alias("pv_day"), F.col("log_return").alias("pv_a"))
    b = r.select(F.col(market).alias("market_b"), F.col(day).alias("pv_day"), F.col("log_return").alias("pv_b"))
    pairs = a.join(b, "pv_day").groupBy("market_a", "market_b").agg(F.corr("pv_a", "pv_b").alias("rho"))
    return pairs.withColumn("rho", F.when(F.col("market_a") == F.col("market_b"), F.lit(1.0)).otherwise(F.col("rho")))


def monthly(quotes: DataFrame, market: str = "market", day: str = "date", price: str = "price") -> DataFrame:
    """Volatility and last price of each market's quotes of each month, with the contract's symbol."""
    q = quotes.withColumn("month", F.trunc(day, "month").cast("date"))
    by = [market, "month"]
    found = historical_volatility(q, by, day, price).join(last_price(q, by, day, price), by)
    return found.withColumn("symbol", contract_symbol(F.col(market), F.col("month")))


def sigmas(by_month: DataFrame, market: str = "market") -> DataFrame:
    """Median of each market's monthly volatilities."""
    return by_month.groupBy(market).agg(F.median("volatility").alias("sigma"))


def params(quotes: DataFrame, start: dt.date, end: dt.date, markets: list[str], limit: int | None = None) -> dict:
    """What a price process takes, from ``quotes`` (market, date, price) of the months start to end.

    The markets are named, so the tables collected have a row a market, pair or month.
    """
    mine: Column = F.col("market").isin(markets) & F.col("date").between(F.lit(start), F.last_day(F.lit(end)))
    q = quotes.where(mine)
    if limit is not None:
        q = last_quotes(q.withColumn("pv_m", F.trunc("date", "month")), limit, ["market", "pv_m"]).drop("pv_m")
    by_month = monthly(q).persist()
    sigma = {r["market"]: r["sigma"] for r in sigmas(by_month).collect()}
    curve: dict[str, list] = {m: [] for m in markets}
    for r in by_month.orderBy("market", "month").collect():
        curve[r["market"]].append((r["month"].isoformat(), r["last_price"]))
    rho = {(r[0], r[1]): r[2] for r in correlations(q).collect()}
    by_month.unpersist()
    return {"market": markets, "sigma": [sigma[m] for m in markets], "rho": [[1.0 if a == b else rho.get((a, b), 0.0) for b in markets] for a in markets], "curve": curve}
