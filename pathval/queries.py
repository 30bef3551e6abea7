"""Queries over the verification tables, one for each operator, with SQL that gives the same rows.

Table rows serve as paths: draws come from ``embeddings``, quotes from ``events`` and
``orders``, cash flows from ``lineitem``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathval.functions import dates
from pathval.operators import scenarios
from pathval.plans.program import PriceKey
from pathval.sources import calibrate, curve, quotes
from pathval.sources.gbm import BlackScholes, Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS = dt.date(2011, 1, 1)
D1, D2 = dt.date(2011, 6, 1), dt.date(2012, 1, 1)
#: Two correlated markets of flat curves, and the rate of the contracts valued on draws.
MODEL = {"market": ["A", "B"], "sigma": [0.5, 0.4], "rho": [[1.0, 0.4], [0.4, 1.0]], "curve": {"A": [("2011-1-1", 10.0)], "B": [("2011-1-1", 11.0)]}}
RATE, BUMP = 2.5, 0.01


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = 6):
    return F.round(c, digits)


def on_rows(df: DataFrame, source: str, columns: dict[str, str], at: dt.date = OBS) -> DataFrame:
    """``v``: a contract of no later date, its markets read from columns."""
    prices = {(m, at, at): c for m, c in columns.items()}
    return scenarios.value(df, prices, scenarios.contract(source, at))


def simulated(spark: SparkSession, sf_dir: str, keys: list[PriceKey], model: dict = MODEL) -> tuple[DataFrame, dict[PriceKey, str]]:
    """Prices on the draws of ``embeddings``: step t of market m takes number 2 t + m, times 8."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path_id"), "embedding")
    process = BlackScholes(Market.from_params(model), OBS, sorted(keys))
    draws = {(t, m): F.col("embedding")[2 * t + m].cast("double") * 8 for t in range(len(process.steps)) for m in range(len(process.names))}
    df, named = process.columns(e, draws=draws)
    return df.drop("embedding"), named


def valued(spark: SparkSession, sf_dir: str, source: str, periodisation: str | None = None, double_sided: bool = True) -> tuple[DataFrame, dict, object]:
    program = scenarios.contract(source, OBS, periodisation)
    df, named = simulated(spark, sf_dir, sorted(program.prices))
    return scenarios.value(df, named, program, RATE, BUMP, double_sided), named, program


def plain(spark: SparkSession, source: str, day: dt.date):
    """The value of a contract that needs no prices, seen on a day."""
    from pathval.api import Engine

    engine = Engine(spark)
    return engine.evaluate(engine.compile(source, day)).fair_value


def by_blocks(spark: SparkSession, sf_dir: str, source: str, periodisation: str | None = None):
    """What the block engine makes of a contract on the prices of :func:`simulated`."""
    from pathval.api import Engine

    engine = Engine(spark)
    compiled = engine.compile(source, OBS)
    scenarios = simulated(spark, sf_dir, sorted(compiled.program(periodisation).prices))
    return engine.evaluate(compiled, interest_rate=RATE, periodisation=periodisation, scenarios=scenarios)


def stats(df: DataFrame, col: str = "v") -> DataFrame:
    err = F.stddev_pop(col) / F.sqrt(F.count(col))
    return df.agg(rounded(F.avg(col)).alias("fair_value"), rounded(err).alias("std_error"), F.count(col).alias("paths"))


# --- arithmetic and predicates -------------------------------------------------------------


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount) / l_quantity - (-l_tax), 9) AS v FROM lineitem")
def arith_spread(spark, sf_dir):
    """Sums, products, quotients and signs of prices."""
    df = on_rows(table(spark, sf_dir, "lineitem"), "Market('P') * (1 - Market('D')) / Market('Q') - (-Market('T'))", {"P": "l_extendedprice", "D": "l_discount", "Q": "l_quantity", "T": "l_tax"})
    return df.select("l_orderkey", rounded("v", 9).alias("v"))


@query("""SELECT c_custkey, round(c_acctbal - 7.5 * floor(c_acctbal / 7.5), 4) AS modulo, floor(c_acctbal / 7.5) AS quotient,
 round(c_acctbal - -7.5 * floor(c_acctbal / -7.5), 4) AS modulo_negative, round(power(c_acctbal, 2), 2) AS square FROM customer""")
def python_mod_floordiv(spark, sf_dir):
    """Floor division and modulo with the divisor's sign; powers."""
    df = table(spark, sf_dir, "customer")
    for name, source in {"modulo": "Market('X') % 7.5", "quotient": "Market('X') // 7.5", "modulo_negative": "Market('X') % -7.5", "square": "Market('X') ** 2"}.items():
        df = on_rows(df, source, {"X": "c_acctbal"}).withColumnRenamed("v", name)
    return df.select("c_custkey", rounded("modulo", 4).alias("modulo"), "quotient", rounded("modulo_negative", 4).alias("modulo_negative"), rounded("square", 2).alias("square"))


@query("""SELECT l_orderkey, CASE WHEN l_discount = 0.05 THEN CASE WHEN l_tax = 0.02 THEN 'NaN' WHEN l_tax > 0.02 THEN 'inf' ELSE '-inf' END ELSE 'finite' END AS kind
 FROM lineitem""")
def divide_by_zero(spark, sf_dir):
    """Quotients of random variables by zero are infinite or no number, never errors."""
    df = table(spark, sf_dir, "lineitem").withColumns({"n": F.col("l_tax") - 0.02, "d": F.when(F.col("l_discount") == 0.05, 0.0).otherwise(F.col("l_discount") + 1)})
    v = on_rows(df.withColumn("n", F.when(F.col("l_tax") == 0.02, 0.0).otherwise(F.col("n"))), "Market('N') / Market('D')", {"N": "n", "D": "d"})
    kind = F.when(F.isnan("v"), "NaN").when(F.col("v") == float("inf"), "inf").when(F.col("v") == float("-inf"), "-inf").otherwise("finite")
    return v.select("l_orderkey", kind.alias("kind"))


@query("SELECT l_orderkey, round(greatest(l_extendedprice - 30000, 0) - least(l_extendedprice, l_quantity * 1000), 4) AS v FROM lineitem")
def max_min_payoff(spark, sf_dir):
    """Greater and lesser of random variables."""
    df = on_rows(table(spark, sf_dir, "lineitem"), "Max(Market('P') - 30000, 0) - Min(Market('P'), Market('Q') * 1000)", {"P": "l_extendedprice", "Q": "l_quantity"})
    return df.select("l_orderkey", rounded("v", 4).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND day(o_orderdate) = 1 THEN 'first' WHEN o_totalprice <= 1000 OR o_totalprice >= 400000 THEN 'edge' ELSE 'other' END AS class FROM orders""")
def compare_bool(spark, sf_dir):
    """Comparisons and logic in a contract's conditions, for the least price between two bounds on each day of a month."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.dayofmonth("o_orderdate").alias("d"), F.col("o_orderdate").cast("date").alias("day"))
    o = o.withColumn("band", F.when(F.col("p") <= 1000, 0).when(F.col("p") <= 100000, 1).when(F.col("p") < 400000, 2).otherwise(3))
    source = "1 if {p!r} > 100000 and IsDayOfMonth(1) else 2 if {p!r} <= 1000 or {p!r} >= 400000 else 3"
    cases = o.groupBy("d", "band").agg(F.min("p").alias("p"), F.min("day").alias("day")).collect()  # at most 124
    told = [(r["d"], r["band"], ("first", "edge", "other")[int(plain(spark, source.format(p=float(r["p"])), r["day"])) - 1]) for r in cases]
    return o.join(F.broadcast(spark.createDataFrame(told, "d int, band int, class string")), ["d", "band"]).select("o_orderkey", "class")


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) FILTER (day(o_orderdate) = 1)::BIGINT AS firsts, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def is_day_of_month(spark, sf_dir):
    """Rows on the first of each month, as a contract's condition tells for each day of the calendar."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    days = [r[0] for r in o.distinct().collect()]  # the calendar's days, some thousand at most
    firsts = spark.createDataFrame([(d, int(plain(spark, "1 if IsDayOfMonth(1) else 0", d))) for d in days], "day date, first long")
    return o.join(F.broadcast(firsts), "day").groupBy(F.trunc("day", "month").cast("string").alias("month")).agg(F.sum("first").alias("firsts"), F.count("*").alias("n"))


#: The year fraction of dates a and b, spelt out.
YEARS = """(CASE WHEN m >= 0 THEN floor(m / 12.0) ELSE ceil(m / 12.0) END + (m - 12 * CASE WHEN m >= 0 THEN floor(m / 12.0) ELSE ceil(m / 12.0) END) / 12.0
 + date_diff('day', (a + to_months(m::INT))::DATE, b) / 365.0)"""
MONTHS = """SELECT *, CASE WHEN a <= b AND (a + to_months(m0::INT))::DATE > b THEN m0 - 1 WHEN a > b AND (a + to_months(m0::INT))::DATE < b THEN m0 + 1 ELSE m0 END AS m
 FROM (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) AS m0 FROM pairs)"""


@query(f"""WITH pairs AS (SELECT o_orderkey, l_shipdate, o_orderdate::DATE AS a, l_shipdate::DATE AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), x AS ({MONTHS})
 SELECT o_orderkey, b::VARCHAR AS ship, round({YEARS}, 9) AS years FROM x""")
def year_fraction(spark, sf_dir):
    """Whole months first, then days as parts of 365, between order and shipping."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("ship"))
    return o.join(li, "o_orderkey").select("o_orderkey", F.col("ship").cast("string").alias("ship"), rounded(dates.year_fraction_column(F.col("a"), F.col("ship")), 9).alias("years"))


@query(f"""WITH pairs AS (SELECT l_returnflag, l_extendedprice, DATE '1995-01-01' AS a, l_shipdate::DATE AS b FROM lineitem), x AS ({MONTHS})
 SELECT l_returnflag, year(b)::INT AS year, round(sum(l_extendedprice * exp(-0.025 * {YEARS})), 2) AS present_value, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""")
def settlement_pv(spark, sf_dir):
    """Cash flows discounted to one day, summed by year and flag."""
    day = F.col("l_shipdate").cast("date")
    pv = dates.discount_column(F.col("l_extendedprice"), F.lit(dt.date(1995, 1, 1)), day, RATE)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.year(day).alias("year")).agg(rounded(F.sum(pv), 2).alias("present_value"), F.count("*").alias("n"))


@query("""WITH RECURSIVE s AS (SELECT 0 AS k, DATE '2011-01-01' AS day, 10.0::DOUBLE AS paid UNION ALL SELECT k + 1, (day + INTERVAL 1 MONTH)::DATE, 10.0::DOUBLE FROM s WHERE k < 11)
 SELECT 12::BIGINT AS installments, round(sum(paid * exp(-0.1 * k / 12.0)), 6) AS present_value FROM s""")
def schedule_installments(spark, sf_dir):
    """A recursive contract of twelve monthly payments, unfolded and valued."""
    source = """
def Installments(payments, sum):
    if payments == 0:
        0
    else:
        Settlement(ObservationDate() + TimeDelta('1m') * (12 - payments), sum) + Installments(payments - 1, sum)
Installments(12, 10)
"""
    from pathval.api import Engine

    engine = Engine(spark)
    found = engine.evaluate(engine.compile(source, OBS), interest_rate=10.0).fair_value
    return spark.range(1).select(F.lit(12).cast("long").alias("installments"), rounded(F.lit(float(found))).alias("present_value"))


@query("""WITH RECURSIVE f AS (SELECT 0 AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60)
 SELECT a AS value, 62::BIGINT AS nodes FROM f WHERE n = 60""")
def fib(spark, sf_dir):
    """A doubly recursive function in as many nodes as it has arguments."""
    from pathval.api import Engine

    engine = Engine(spark)
    compiled = engine.compile("def fib(n): return fib(n - 1) + fib(n - 2) if n > 1 else n\nfib(60)")
    return spark.range(1).select(F.lit(engine.evaluate(compiled).fair_value).cast("long").alias("value"), F.lit(compiled.call_count).cast("long").alias("nodes"))


# --- sources and calibration ---------------------------------------------------------------


@query("""WITH q AS (SELECT o_orderpriority AS market, o_orderdate::DATE AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2),
 w AS (SELECT o_orderpriority AS market, l_shipdate::DATE AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
 SELECT w.market, w.day::VARCHAR AS day, round(q.price, 4) AS price, count(*)::BIGINT AS n FROM w ASOF LEFT JOIN q ON w.market = q.market AND w.day >= q.day GROUP BY 1, 2, 3""")
def curve_zoh(spark, sf_dir):
    """The last quote on or before each day: an as-of join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("market"), F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    q = o.groupBy("market", "day").agg(F.avg("o_totalprice").alias("price"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("day"))
    w = li.join(o.select("o_orderkey", "market"), "o_orderkey").groupBy("market", "day").agg(F.count("*").alias("n"))
    return curve.as_of(w, q, "market", "day", "price").select("market", F.col("day").cast("string").alias("day"), rounded("price", 4).alias("price"), "n")


@query("SELECT o_orderkey, concat('X', substr('FGHJKMNQUVXZ', month(o_orderdate)::INT, 1), year(o_orderdate)::VARCHAR) AS symbol, concat_ws('-', 'X', year(o_orderdate), month(o_orderdate)) AS period FROM orders")
def symbols(spark, sf_dir):
    """Futures symbols and period names."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.contract_symbol(F.lit("X"), d).alias("symbol"), F.concat_ws("-", F.lit("X"), F.year(d), F.month(d)).alias("period"))


DAILY = "daily AS (SELECT event_type AS market, ts::DATE AS date, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1, 2)"
RETURNS = "r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY market ORDER BY date)) AS ret FROM daily)"


def daily_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type and day as a quote."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("market"), F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))


@query(f"WITH {DAILY}, {RETURNS} SELECT market, round(sqrt(252 * var_samp(ret)), 6) AS volatility FROM r GROUP BY 1")
def hist_vol(spark, sf_dir):
    """Yearly volatility of daily logarithmic returns."""
    return calibrate.historical_volatility(daily_quotes(spark, sf_dir), ["market"]).select("market", rounded("volatility").alias("volatility"))


@query(f"WITH {DAILY} SELECT market, arg_max(price, date) AS last_price FROM daily GROUP BY 1")
def last_price(spark, sf_dir):
    """The last quote of each market."""
    return calibrate.last_price(daily_quotes(spark, sf_dir), ["market"])


@query(f"""WITH {DAILY}, w AS (SELECT market, date_trunc('week', date)::DATE AS week, date, price FROM daily),
 r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY market, week ORDER BY date)) AS ret FROM w), v AS (SELECT market, week, sqrt(252 * var_samp(ret)) AS vol FROM r GROUP BY 1, 2)
 SELECT market, round(median(vol), 6) AS sigma FROM v GROUP BY 1""")
def median_sigma(spark, sf_dir):
    """Median of volatilities of short spans."""
    q = daily_quotes(spark, sf_dir).withColumn("week", F.date_trunc("week", "date").cast("date"))
    return calibrate.sigmas(calibrate.historical_volatility(q, ["market", "week"])).select("market", rounded("sigma").alias("sigma"))


@query(f"""WITH {DAILY}, {RETURNS} SELECT a.market AS market_a, b.market AS market_b, round(CASE WHEN a.market = b.market THEN 1.0 ELSE corr(a.ret, b.ret) END, 6) AS rho
 FROM r a JOIN r b ON a.date = b.date AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""")
def corr_matrix(spark, sf_dir):
    """Correlations of all pairs of markets."""
    return calibrate.correlations(daily_quotes(spark, sf_dir)).select("market_a", "market_b", rounded("rho").alias("rho"))


@query(f"WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS k FROM daily) SELECT market, date::VARCHAR AS date, price FROM n WHERE k <= 5")
def last_quotes(spark, sf_dir):
    """The latest five quotes of each market."""
    return calibrate.last_quotes(daily_quotes(spark, sf_dir), 5, ["market"]).withColumn("date", F.col("date").cast("string"))


# --- simulation on given draws ---------------------------------------------------------------

Z = "8 * embedding[{}]::DOUBLE"
T1, T2 = dates.year_fraction(OBS, D1), dates.year_fraction(D1, D2)
#: Prices of both markets at both dates, in SQL.
PATHS = f"""w AS (SELECT vec_id AS path_id, sqrt({T1!r}) * {Z.format(1)} AS a1, sqrt({T1!r}) * (0.4 * {Z.format(1)} + sqrt(1 - 0.16) * {Z.format(2)}) AS b1,
 sqrt({T2!r}) * {Z.format(3)} AS a2, sqrt({T2!r}) * (0.4 * {Z.format(3)} + sqrt(1 - 0.16) * {Z.format(4)}) AS b2 FROM embeddings),
 p AS (SELECT path_id, 10 * exp(0.5 * a1 - 0.125 * {T1!r}) AS pa1, 11 * exp(0.4 * b1 - 0.08 * {T1!r}) AS pb1,
 10 * exp(0.5 * (a1 + a2) - 0.125 * {dates.year_fraction(OBS, D2)!r}) AS pa2, 11 * exp(0.4 * (b1 + b2) - 0.08 * {dates.year_fraction(OBS, D2)!r}) AS pb2 FROM w)"""
#: The same for market A alone, which takes numbers 1 and 3 whether or not B is drawn.
ALONE = PATHS
DF1, DF2 = dates.discount_factor(OBS, D1, RATE), dates.discount_factor(D1, D2, RATE)
DF02 = dates.discount_factor(OBS, D2, RATE)


@query(f"WITH {PATHS} SELECT path_id, round(a1, 6) AS a1, round(b1, 6) AS b1, round(a1 + a2, 6) AS a2, round(b1 + b2, 6) AS b2 FROM w")
def brownian(spark, sf_dir):
    """Correlated Brownian motions at two dates, recovered from the prices they drive."""
    df, named = simulated(spark, sf_dir, [(m, d, d) for m in "AB" for d in (D1, D2)])
    sigma, forward = {"A": 0.5, "B": 0.4}, {"A": 10.0, "B": 11.0}
    motion = lambda m, d: (F.log(F.col(named[m, d, d]) / forward[m]) + sigma[m] ** 2 / 2 * dates.year_fraction(OBS, d)) / sigma[m]
    return df.select("path_id", *[rounded(motion(m, d)).alias(f"{m.lower()}{k}") for m in "AB" for k, d in ((1, D1), (2, D2))])


@query(f"WITH {PATHS} SELECT path_id, 'A' AS market, '{D1}' AS fixing_date, round(pa1, 6) AS price FROM p UNION ALL SELECT path_id, 'A', '{D2}', round(pa2, 6) FROM p UNION ALL SELECT path_id, 'B', '{D1}', round(pb1, 6) FROM p UNION ALL SELECT path_id, 'B', '{D2}', round(pb2, 6) FROM p")
def gbm_price(spark, sf_dir):
    """Prices as rows."""
    df, named = simulated(spark, sf_dir, [(m, d, d) for m in "AB" for d in (D1, D2)])
    return quotes.tall(df, named).select("path_id", "market", F.col("fixing_date").cast("string").alias("fixing_date"), rounded("price").alias("price"))


@query(f"WITH {PATHS} SELECT round(avg(pa2), 6) AS mean_a, round(avg(pb2), 6) AS mean_b, round(corr(ln(pa2), ln(pb2)), 6) AS rho FROM p")
def gbm_correlated(spark, sf_dir):
    """Means and correlation of two markets."""
    df, named = simulated(spark, sf_dir, [(m, d, d) for m in "AB" for d in (D1, D2)])
    a, b = named["A", D2, D2], named["B", D2, D2]
    return df.agg(rounded(F.avg(a)).alias("mean_a"), rounded(F.avg(b)).alias("mean_b"), rounded(F.corr(F.log(a), F.log(b))).alias("rho"))


@query(f"WITH {PATHS} SELECT round(avg(pa1 * {dates.discount_factor(OBS, D2, RATE) / 1!r}), 6) AS fair_value, round(stddev_pop(pa1 * {DF02!r}) / sqrt(count(*)), 6) AS std_error, count(*)::BIGINT AS paths FROM p")
def forward_market(spark, sf_dir):
    """A price fixed now for delivery later, settled at delivery."""
    source = f"Settlement('{D2}', On('{D1}', ForwardMarket('{D2}', 'A') + 0 * Market('B')))"
    return stats(valued(spark, sf_dir, source)[0])


# --- choices -----------------------------------------------------------------------------------


def regression(y: str, x: str, rows: str) -> str:
    """SQL: three coefficients of ``y`` on 1, u, u^2 with u the standardised ``x``, by determinants."""
    return f"""m AS (SELECT avg({x}) AS mu, stddev_pop({x}) AS sd FROM {rows}), u AS (SELECT *, ({x} - mu) / sd AS u, {y} AS y FROM {rows}, m),
 s AS (SELECT count(*)::DOUBLE AS n, sum(u) AS s1, sum(u^2) AS s2, sum(u^3) AS s3, sum(u^4) AS s4, sum(y) AS t0, sum(y * u) AS t1, sum(y * u^2) AS t2 FROM u),
 c AS (SELECT n * (s2*s4 - s3*s3) - s1 * (s1*s4 - s2*s3) + s2 * (s1*s3 - s2*s2) AS d, t0 * (s2*s4 - s3*s3) - s1 * (t1*s4 - s3*t2) + s2 * (t1*s3 - s2*t2) AS d0,
 n * (t1*s4 - t2*s3) - t0 * (s1*s4 - s2*s3) + s2 * (s1*t2 - s2*t1) AS d1, n * (s2*t2 - s3*t1) - s1 * (s1*t2 - t1*s2) + t0 * (s1*s3 - s2*s2) AS d2 FROM s),
 fit AS (SELECT u.*, (d0 + d1 * u + d2 * u^2) / d AS fitted FROM u, c)"""


#: Market A with one draw a step, no other market in the contract.
ONE = f"""w AS (SELECT vec_id AS path_id, sqrt({T1!r}) * {Z.format(1)} AS a1, sqrt({T2!r}) * {Z.format(3)} AS a2 FROM embeddings),
 p AS (SELECT path_id, 10 * exp(0.5 * a1 - 0.125 * {T1!r}) AS pa1, 10 * exp(0.5 * (a1 + a2) - 0.125 * {dates.year_fraction(OBS, D2)!r}) AS pa2 FROM w)"""
#: One draw over the whole time.
WHOLE = f"p AS (SELECT vec_id AS path_id, 10 * exp(0.5 * {Z.format(1)} - 0.125) AS pa2 FROM embeddings)"
EUROPEAN = f"Wait('{D2}', Choice(Market('A') - 9, 0))"
BERMUDAN = f"Wait('{D1}', Choice(Market('A') - 9, Wait('{D2}', Choice(Market('A') - 9, 0))))"


@query(f"WITH {WHOLE} SELECT round(avg(v), 6) AS fair_value, round(stddev_pop(v) / sqrt(count(*)), 6) AS std_error, count(*)::BIGINT AS paths FROM (SELECT {DF02!r} * greatest(pa2 - 9, 0) AS v FROM p)")
def european_choice(spark, sf_dir):
    """A choice at one date: the regression of a linear payoff is exact."""
    return stats(valued(spark, sf_dir, EUROPEAN)[0])


BERMUDAN_SQL = f"""WITH {ONE}, x AS (SELECT *, {DF2!r} * greatest(pa2 - 9, 0) AS hold FROM p), {regression("hold", "pa1", "x")},
 v AS (SELECT path_id, {DF1!r} * CASE WHEN pa1 - 9 >= fitted THEN pa1 - 9 ELSE hold END AS v FROM fit)"""


@query(BERMUDAN_SQL + " SELECT round(avg(v), 6) AS fair_value, round(stddev_pop(v) / sqrt(count(*)), 6) AS std_error, count(*)::BIGINT AS paths FROM v")
def bermudan_choice(spark, sf_dir):
    """Choices at two dates: the first regresses what holding on is worth."""
    return stats(valued(spark, sf_dir, BERMUDAN)[0])


@query(BERMUDAN_SQL + " SELECT path_id, round(v, 6) AS v FROM v")
def bermudan_paths(spark, sf_dir):
    """The value on every path."""
    return valued(spark, sf_dir, BERMUDAN)[0].select("path_id", rounded("v").alias("v"))


@query(f"""WITH {ONE}, x AS (SELECT *, {DF2!r} * greatest(pa2 - 9, 0) AS hold FROM p), {regression("hold", "pa1", "x")}
 SELECT round(avg({DF1!r} * CASE WHEN pa1 - 9 >= fitted AND pa1 - 9 >= 1.5 THEN pa1 - 9 WHEN fitted >= 1.5 THEN hold ELSE 1.5 END), 6) AS fair_value FROM fit""")
def choice_three_way(spark, sf_dir):
    """Three alternatives: now, later, or a fixed sum."""
    source = f"Wait('{D1}', Choice(Market('A') - 9, Wait('{D2}', Choice(Market('A') - 9, 0)), 1.5))"
    return stats(valued(spark, sf_dir, source)[0]).select("fair_value")


@query(BERMUDAN_SQL + f", g AS (SELECT path_id, {DF1!r} * greatest(pa1 - 9, {DF2!r} * greatest(pa2 - 9, 0)) AS g FROM p) SELECT round(avg(g) - avg(v), 6) AS foresight, count(*) FILTER (g < v - 1e-9)::BIGINT AS below FROM v JOIN g USING (path_id)")
def choice_vs_max(spark, sf_dir):
    """What knowing the future of each path would add to choosing by expectation."""
    best = BERMUDAN.replace("Choice", "Max")
    v = valued(spark, sf_dir, BERMUDAN)[0].select("path_id", "v")
    g = valued(spark, sf_dir, best)[0].select("path_id", F.col("v").alias("g"))
    both = v.join(g, "path_id")
    return both.agg(rounded(F.avg("g") - F.avg("v")).alias("foresight"), F.sum((F.col("g") < F.col("v") - 1e-9).cast("long")).alias("below"))


@query(f"""WITH {PATHS} SELECT round(avg({DF02!r} * CASE WHEN pa2 >= pb2 THEN pa2 ELSE pb2 END), 6) AS fair_value FROM p""")
def exchange_choice(spark, sf_dir):
    """A choice between two markets, regressed on both and their product."""
    source = f"Wait('{D2}', Choice(Market('A'), Market('B'))) + 0 * Wait('{D1}', Market('A') * Market('B'))"
    return stats(valued(spark, sf_dir, source)[0]).select("fair_value")


# --- bumps, hedges, cash -------------------------------------------------------------------------


@query(f"WITH {WHOLE} SELECT 'A' AS perturbation_name, round(avg({DF02!r} * (greatest(1.01 * pa2 - 9, 0) - greatest(0.99 * pa2 - 9, 0)) / (0.02 * 10)), 6) AS delta FROM p")
def delta_double(spark, sf_dir):
    """Delta from bumps up and down."""
    v, named, program = valued(spark, sf_dir, EUROPEAN, "alltime")
    return scenarios.deltas(v, named, program, RATE, BUMP).groupBy("perturbation_name").agg(rounded(F.avg("delta")).alias("delta"))


@query(f"WITH {WHOLE} SELECT 'A' AS perturbation_name, round(avg({DF02!r} * (greatest(1.01 * pa2 - 9, 0) - greatest(pa2 - 9, 0)) / (0.01 * 10)), 6) AS delta FROM p")
def delta_single(spark, sf_dir):
    """Delta from a bump up alone."""
    v, named, program = valued(spark, sf_dir, EUROPEAN, "alltime", False)
    return scenarios.deltas(v, named, program, RATE, BUMP, False).groupBy("perturbation_name").agg(rounded(F.avg("delta")).alias("delta"))


SPREAD = f"Wait('{D1}', Market('A') * 2 - Market('B')) + Wait('{D2}', Max(Market('A') - Market('B'), 0))"
#: Hedges of SPREAD by period, a row a path.
HEDGES = f"""WITH {PATHS}, h AS (
 SELECT path_id, 'A' AS market_name, DATE '{D1}' AS delivery_date, 2 * {DF1!r} AS delta, pa1 AS price, {DF1!r} AS df FROM p UNION ALL
 SELECT path_id, 'B', DATE '{D1}', -1 * {DF1!r}, pb1, {DF1!r} FROM p UNION ALL
 SELECT path_id, 'A', DATE '{D2}', {DF02!r} * (greatest(1.01 * pa2 - pb2, 0) - greatest(0.99 * pa2 - pb2, 0)) / (0.02 * pa2), pa2, {DF02!r} FROM p UNION ALL
 SELECT path_id, 'B', DATE '{D2}', {DF02!r} * (greatest(pa2 - 1.01 * pb2, 0) - greatest(pa2 - 0.99 * pb2, 0)) / (0.02 * pb2), pb2, {DF02!r} FROM p)"""


def hedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, named, program = valued(spark, sf_dir, SPREAD, "monthly")
    return scenarios.deltas(v, named, program, RATE, BUMP).withColumn("delivery_date", F.col("delivery_date").cast("string"))


@query(HEDGES + " SELECT concat_ws('-', market_name, year(delivery_date), month(delivery_date)) AS perturbation_name, round(avg(delta), 6) AS delta FROM h GROUP BY 1")
def delta_monthly(spark, sf_dir):
    """Deltas by month of delivery."""
    return hedges(spark, sf_dir).groupBy("perturbation_name").agg(rounded(F.avg("delta")).alias("delta"))


@query(HEDGES + """ SELECT market_name, delivery_date::VARCHAR AS delivery_date, round(avg(price), 6) AS price, round(avg(price * df), 6) AS price_discounted, round(avg(-delta / df), 6) AS hedge_units,
 round(avg(-delta * price), 6) AS hedge_cost, round(stddev_pop(delta * price) / sqrt(count(*)), 6) AS cash_error FROM h GROUP BY 1, 2""")
def hedge_report(spark, sf_dir):
    """Units, cost and cash of each period's hedge."""
    err = F.stddev_pop("cash") / F.sqrt(F.count("cash"))
    return hedges(spark, sf_dir).groupBy("market_name", "delivery_date").agg(rounded(F.avg("price_simulated")).alias("price"), rounded(F.avg("price_discounted")).alias("price_discounted"), rounded(F.avg("hedge_units")).alias("hedge_units"), rounded(F.avg("hedge_cost")).alias("hedge_cost"), rounded(err).alias("cash_error"))


@query(HEDGES + """ , d AS (SELECT path_id, delivery_date, sum(delta * price) AS cash FROM h GROUP BY 1, 2), c AS (SELECT path_id, delivery_date, sum(cash) OVER (PARTITION BY path_id ORDER BY delivery_date) AS cash FROM d)
 SELECT delivery_date::VARCHAR AS delivery_date, round(avg(cash), 6) AS cash FROM c GROUP BY 1""")
def cash_cumulative(spark, sf_dir):
    """Cash so far, by date."""
    daily = hedges(spark, sf_dir).groupBy("path_id", "delivery_date").agg(F.sum("cash").alias("cash"))
    run = daily.withColumn("cash", F.sum("cash").over(W.partitionBy("path_id").orderBy("delivery_date")))
    return run.groupBy("delivery_date").agg(rounded(F.avg("cash")).alias("cash"))


@query(HEDGES + " SELECT delivery_date::VARCHAR AS delivery_date, round(avg(price) FILTER (market_name = 'A'), 6) AS A, round(avg(price) FILTER (market_name = 'B'), 6) AS B FROM h GROUP BY 1")
def pivot_prices(spark, sf_dir):
    """Mean prices, dates by markets."""
    p = hedges(spark, sf_dir).groupBy("delivery_date").pivot("market_name", ["A", "B"]).agg(F.avg("price_simulated"))
    return p.select("delivery_date", rounded("A").alias("A"), rounded("B").alias("B"))


@query(HEDGES + ", s AS (SELECT path_id, market_name, sum(-delta / df) AS units, sum(delta * price) AS cash FROM h GROUP BY 1, 2) SELECT market_name, round(sum(units) / count(DISTINCT path_id), 6) AS units, round(sum(cash) / count(DISTINCT path_id), 6) AS cash FROM s GROUP BY ROLLUP (market_name)")
def net_positions(spark, sf_dir):
    """Units and cash by market and overall."""
    per = hedges(spark, sf_dir).groupBy("path_id", "market_name").agg(F.sum("hedge_units").alias("units"), F.sum("cash").alias("cash"))
    n = F.countDistinct("path_id")
    return per.rollup("market_name").agg(rounded(F.sum("units") / n).alias("units"), rounded(F.sum("cash") / n).alias("cash"))


@query(f"WITH {WHOLE}, v AS (SELECT {DF02!r} * greatest(pa2 - 9, 0) AS v FROM p) SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(stddev_pop(v) / sqrt(count(*)), 6) AS std_error FROM v")
def fair_value_stats(spark, sf_dir):
    """Mean, population deviation and standard error."""
    v = valued(spark, sf_dir, EUROPEAN)[0]
    return v.agg(rounded(F.avg("v")).alias("mean"), rounded(F.stddev_pop("v")).alias("std"), rounded(F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("std_error"))


@query(HEDGES + " SELECT market_name, delivery_date::VARCHAR AS delivery_date, round(avg(price) - quantile_cont(price, 0.025), 6) AS below, round(quantile_cont(price, 0.975) - avg(price), 6) AS above FROM h GROUP BY 1, 2")
def confidence_bounds(spark, sf_dir):
    """Distances of percentiles from the mean."""
    x = F.col("price_simulated")
    return hedges(spark, sf_dir).groupBy("market_name", "delivery_date").agg(rounded(F.avg(x) - F.percentile(x, 0.025)).alias("below"), rounded(F.percentile(x, 0.975) - F.avg(x)).alias("above"))


# --- graphs ----------------------------------------------------------------------------------------

LATTICE = """
def f(x, t):
    if t <= 0:
        x
    else:
        if x <= 0:
            Max(f(x, t - 1), f(x + 1, t - 1))
        else:
            Max(f(x - 1, t - 1), f(x, t - 1))
"""


@query("""WITH RECURSIVE calls AS (SELECT 0 AS x, 12 AS t UNION SELECT unnest(CASE WHEN x <= 0 THEN [x, x + 1] ELSE [x - 1, x] END), t - 1 FROM calls WHERE t > 0)
 SELECT 12 AS steps, count(*)::BIGINT + 1 AS nodes FROM calls""")
def call_cache_counts(spark, sf_dir):
    """Recombining calls share nodes: the graph grows in proportion to its steps."""
    from pathval.api import Engine

    return spark.createDataFrame([(12, Engine(spark).compile(LATTICE + "f(0, 12)").call_count)], "steps int, nodes long")


@query("""WITH RECURSIVE calls AS (SELECT 0 AS x, 6 AS t UNION SELECT unnest(CASE WHEN x <= 0 THEN [x, x + 1] ELSE [x - 1, x] END), t - 1 FROM calls WHERE t > 0)
 SELECT t::INT AS level, count(*)::BIGINT AS nodes FROM calls GROUP BY 1 UNION ALL SELECT 7, 1""")
def graph_levels(spark, sf_dir):
    """Nodes by level: one more than the highest of what they need."""
    program = scenarios.contract(LATTICE + "f(0, 6)", OBS)
    return quotes.graph_tables(spark, program)["graph_nodes"].groupBy("level").agg(F.count("*").alias("nodes"))


@query("SELECT * FROM (VALUES ('A-2011-6', 3::BIGINT), ('A-2012-1', 2::BIGINT), ('B-2012-1', 2::BIGINT)) t(perturbation, nodes)")
def perturbation_closure(spark, sf_dir):
    """Nodes that each bump touches, through what they need."""
    source = f"""
def Late(d):
    Wait(d, Market('A') - Market('B'))
def Early(d):
    Wait(d, Market('A'))
def Both(d, e):
    Early(d) + Early(d) * 2
Late('{D2}') + Both('{D1}', '{D2}')
"""
    return quotes.graph_tables(spark, scenarios.contract(source, OBS, "monthly"))["perturbation_requirements"].groupBy("perturbation").agg(F.count("*").alias("nodes"))


@query("SELECT * FROM (VALUES (0::BIGINT, 12::BIGINT), (1, 324)) t(node_id, cost)")
def node_costs(spark, sf_dir):
    """What evaluating each node costs, by its elements."""
    source = f"def f(d): return Wait(d, Choice(Market('A') - 9, 0))\n2 * f('{D2}')"
    program = scenarios.contract(source, OBS)
    return quotes.graph_tables(spark, program)["graph_nodes"].select("node_id", "cost")


@query(f"""SELECT * FROM (VALUES ('A', '{D1}', '{D2}'), ('A', '{D2}', '{D2}'), ('A', '{D1}', '{D1}'), ('B', '{D1}', '{D1}')) t(market, fixing_date, delivery_date)""")
def price_requirements(spark, sf_dir):
    """Prices that a choice between a forward and a spot price needs: regressors and deliveries too."""
    source = f"Wait('{D1}', Choice(ForwardMarket('{D2}', 'A'), Market('B')))"
    rows = quotes.graph_tables(spark, scenarios.contract(source, OBS, "monthly"))["price_requirements"]
    return rows.select("market", F.col("fixing_date").cast("string").alias("fixing_date"), F.col("delivery_date").cast("string").alias("delivery_date"))


@query("SELECT * FROM (VALUES ('gas storage', 92::BIGINT, 844::BIGINT, 468::BIGINT)) t(contract, nodes, double_sided, single_sided)")
def evaluation_counts(spark, sf_dir):
    """Nodes of a year of gas storage, and how often they are valued with monthly bumps."""
    source = """
from pathval.models.storage import GasStorage
GasStorage(Date('2011-4-1'), Date('2012-4-1'), 'GAS', 0, 50000, TimeDelta('1m'))
"""
    p = scenarios.contract(source, OBS, "monthly")
    return spark.createDataFrame([("gas storage", p.count, p.evaluations(), p.evaluations(False))], "contract string, nodes long, double_sided long, single_sided long")


@query(HEDGES + " SELECT concat_ws('-', market_name, year(delivery_date)) AS perturbation_name, round(avg(delta), 6) AS delta FROM h GROUP BY 1")
def delta_yearly(spark, sf_dir):
    """Deltas by year of delivery."""
    v, named, program = valued(spark, sf_dir, SPREAD, "yearly")
    return scenarios.deltas(v, named, program, RATE, BUMP).groupBy("perturbation_name").agg(rounded(F.avg("delta")).alias("delta"))


@query(HEDGES + " SELECT concat_ws('-', market_name, year(delivery_date), month(delivery_date), day(delivery_date)) AS perturbation_name, round(avg(-delta / df), 6) AS hedge_units FROM h GROUP BY 1")
def delta_daily(spark, sf_dir):
    """Hedges by day of delivery."""
    v, named, program = valued(spark, sf_dir, SPREAD, "daily")
    return scenarios.deltas(v, named, program, RATE, BUMP).groupBy("perturbation_name").agg(rounded(F.avg("hedge_units")).alias("hedge_units"))


@query("SELECT l_orderkey, round(CASE WHEN l_extendedprice > 50000 THEN 50000 + (l_extendedprice - 50000) / 2 ELSE l_extendedprice END, 4) AS v FROM lineitem")
def own_element(spark, sf_dir):
    """An element of one's own, as columns."""
    from pathval.api import Element

    capped = Element(1, 1, lambda x: F.when(x > 50000, 50000 + (x - 50000) / 2).otherwise(x))
    program = scenarios.contract("Capped(Market('P'))", OBS, elements={"Capped": capped})
    df = scenarios.value(table(spark, sf_dir, "lineitem"), {("P", OBS, OBS): "l_extendedprice"}, program, elements={"Capped": capped})
    return df.select("l_orderkey", rounded("v", 4).alias("v"))


@query(f"WITH {DAILY} SELECT market, date::VARCHAR AS date, price FROM daily")
def csv_text(spark, sf_dir):
    """Each market's series to CSV text and back."""
    from functools import reduce

    q = daily_quotes(spark, sf_dir).persist()
    markets = [r[0] for r in q.select("market").distinct().orderBy("market").collect()]
    back = [quotes.from_csv_text(spark, quotes.to_csv_text(q.where(F.col("market") == m))).withColumn("market", F.lit(m)) for m in markets]
    q.unpersist()
    return reduce(DataFrame.unionByName, back).select("market", F.col("date").cast("string").alias("date"), "price")


@query(f"WITH {PATHS} SELECT path_id, round(pa1, 6) AS near, round(pa2, 6) AS far FROM p")
def scenario_table(spark, sf_dir):
    """Simulated prices as rows, and back to a column a price."""
    keys = [("A", D1, D1), ("A", D2, D2)]
    df, named = simulated(spark, sf_dir, [(m, d, d) for m in "AB" for d in (D1, D2)])
    back, cols = quotes.wide(quotes.tall(df, named), keys)
    return back.select("path_id", rounded(cols[keys[0]]).alias("near"), rounded(cols[keys[1]]).alias("far"))


# --- lattices on known prices ------------------------------------------------------------------------


def monthly_curve(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """Mean order value of each month, in thousands: a row a month of the calendar."""
    rows = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("p")).orderBy("m").collect()
    return [(r["m"].isoformat(), r["p"]) for r in rows]


def intrinsic(spark: SparkSession, sf_dir: str, source: str) -> float:
    """A contract's value on the curve without randomness: one path, from the first month to past the last."""
    from pathval.api import Engine

    curve = monthly_curve(spark, sf_dir)
    start, last = dt.date.fromisoformat(curve[0][0]), dt.date.fromisoformat(curve[-1][0])
    end = (last.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    engine = Engine(spark)
    model = {"market": ["A"], "sigma": [0.0], "curve": {"A": curve}}
    return engine.evaluate(engine.compile(source.format(start=start, end=end), start), model, path_count=1).fair_value_mean


CURVE = "c AS (SELECT row_number() OVER (ORDER BY m) AS m, p FROM (SELECT date_trunc('month', o_orderdate) AS m, round(avg(o_totalprice) / 1000, 3) AS p FROM orders GROUP BY 1))"


@query(f"""WITH RECURSIVE {CURVE}, plans AS (SELECT 1::BIGINT AS m, 0 AS q, 0.0::DOUBLE AS v UNION ALL
 SELECT m, q, v FROM (SELECT plans.m + 1 AS m, q + a AS q, v - a * p AS v, row_number() OVER (PARTITION BY q + a ORDER BY v - a * p DESC) AS k FROM plans JOIN c USING (m), (VALUES (-1), (0), (1)) t(a) WHERE q + a BETWEEN 0 AND 2) WHERE k = 1)
 SELECT round(max(v), 6) AS fair_value FROM plans WHERE m = (SELECT max(m) + 1 FROM c)""")
def storage_intrinsic(spark, sf_dir):
    """Gas storage of two units over all months of a known curve."""
    source = """
from pathval.models.storage import GasStorage
GasStorage(Date('{start}'), Date('{end}'), 'A', 0, 2, TimeDelta('1m'))
"""
    return spark.range(1).select(rounded(F.lit(intrinsic(spark, sf_dir, source))).alias("fair_value"))


@query(f"WITH {CURVE} SELECT round(sum(p), 6) AS fair_value FROM (SELECT p FROM c ORDER BY p DESC LIMIT 5)")
def swing_intrinsic(spark, sf_dir):
    """The best five of all months."""
    source = """
def Swing(start, end, underlying, quantity):
    if quantity == 0 or start >= end:
        0
    else:
        Wait(start, Choice(Swing(start + TimeDelta('1m'), end, underlying, quantity - 1) + underlying, Swing(start + TimeDelta('1m'), end, underlying, quantity)))
Swing(Date('{start}'), Date('{end}'), Market('A'), 5)
"""
    return spark.range(1).select(rounded(F.lit(intrinsic(spark, sf_dir, source))).alias("fair_value"))


# --- the block engine on the same prices --------------------------------------------------------------


@query(SQL["bermudan_paths"])
def block_bermudan_paths(spark, sf_dir):
    """The value on every path, by blocks of a scenario table."""
    return by_blocks(spark, sf_dir, BERMUDAN).fair_value.select("path_id", rounded("value").alias("v"))


@query(SQL["bermudan_choice"])
def block_bermudan(spark, sf_dir):
    """Mean and error of choices at two dates, summed by block."""
    r = by_blocks(spark, sf_dir, BERMUDAN)
    return spark.createDataFrame([(round(r.fair_value_mean, 6), round(r.fair_value_error, 6), int(r.summary["n"].iloc[0]))], "fair_value double, std_error double, paths long")


@query(SQL["choice_three_way"])
def block_three_way(spark, sf_dir):
    """Three alternatives, by blocks."""
    source = f"Wait('{D1}', Choice(Market('A') - 9, Wait('{D2}', Choice(Market('A') - 9, 0)), 1.5))"
    return spark.createDataFrame([(round(by_blocks(spark, sf_dir, source).fair_value_mean, 6),)], "fair_value double")


@query(SQL["exchange_choice"])
def block_exchange(spark, sf_dir):
    """A choice between two markets, by blocks."""
    source = f"Wait('{D2}', Choice(Market('A'), Market('B'))) + 0 * Wait('{D1}', Market('A') * Market('B'))"
    return spark.createDataFrame([(round(by_blocks(spark, sf_dir, source).fair_value_mean, 6),)], "fair_value double")


@query(SQL["delta_monthly"])
def block_delta_monthly(spark, sf_dir):
    """Deltas by month of delivery, summed by block."""
    r = by_blocks(spark, sf_dir, SPREAD, "monthly")
    return spark.createDataFrame([(n, round(float(d), 6)) for n, d in r.deltas.items()], "perturbation_name string, delta double")


@query(SQL["hedge_report"])
def block_hedges(spark, sf_dir):
    """Units, cost and cash of each period's hedge, from the rows that blocks give of every path."""
    rows = by_blocks(spark, sf_dir, SPREAD, "monthly").paths.where("perturbation_name is not null").withColumn("delivery_date", F.col("delivery_date").cast("string"))
    err = F.stddev_pop("cash") / F.sqrt(F.count("cash"))
    return rows.groupBy("market_name", "delivery_date").agg(rounded(F.avg("price_simulated")).alias("price"), rounded(F.avg("price_discounted")).alias("price_discounted"), rounded(F.avg("hedge_units")).alias("hedge_units"), rounded(F.avg("hedge_cost")).alias("hedge_cost"), rounded(err).alias("cash_error"))


@query(SQL["cash_cumulative"])
def block_cash(spark, sf_dir):
    """Cash so far, by date, of the report."""
    found = by_blocks(spark, sf_dir, SPREAD, "monthly").cash_paths().groupBy(F.col("delivery_date").cast("string").alias("delivery_date"))
    return found.agg(rounded(F.avg("cash")).alias("cash"))


# --- times, all-time hedges, periods of several days ---------------------------------------------------


@query(f"WITH {PATHS} SELECT round(avg({DF1!r} * (pa1 + 2 * pb1)) + avg({DF02!r} * pa2 * pb2 / 10), 6) AS fair_value FROM p")
def fixing_times(spark, sf_dir):
    """Prices fixed at two dates; what is fixed is discounted to its own date's present."""
    source = f"Settlement('{D1}', Fixing('{D1}', Market('A') + 2 * Market('B'))) + Settlement('{D2}', Fixing('{D2}', Market('A') * Market('B') / 10))"
    return stats(valued(spark, sf_dir, source)[0]).select("fair_value")


@query(f"WITH {PATHS} SELECT round(avg({DF1!r} * 3 * pa1 + {DF02!r} * 5 * pb2), 6) AS fair_value FROM p")
def present_time(spark, sf_dir):
    """What the present time is, where it is asked for."""
    source = f"""
def Paid(name):
    (3 if PresentTime() == Date('{D1}') else 5) * Market(name)
Wait('{D1}', Paid('A')) + Wait('{D2}', Paid('B'))
"""
    return stats(valued(spark, sf_dir, source)[0]).select("fair_value")


@query(f"""WITH {PATHS} SELECT 'A' AS perturbation_name, 10.0::DOUBLE AS price, round(avg({DF1!r} * 2 * pa1 / 10 + {DF02!r} * (greatest(1.01 * pa2 - pb2, 0) - greatest(0.99 * pa2 - pb2, 0)) / 0.2), 6) AS delta FROM p
 UNION ALL SELECT 'B', 11.0::DOUBLE, round(avg(-{DF1!r} * pb1 / 11 + {DF02!r} * (greatest(pa2 - 1.01 * pb2, 0) - greatest(pa2 - 0.99 * pb2, 0)) / 0.22), 6) FROM p""")
def hedge_alltime(spark, sf_dir):
    """Hedges over all time, at today's prices."""
    v, named, program = valued(spark, sf_dir, SPREAD, "alltime")
    found = scenarios.deltas(v, named, program, RATE, BUMP).groupBy("perturbation_name")
    return found.agg(rounded(F.avg("price_simulated")).alias("price"), rounded(F.avg("delta")).alias("delta"))


E1, E2 = dt.date(2011, 6, 1), dt.date(2011, 6, 16)
U1, U2, U12 = dates.year_fraction(OBS, E1), dates.year_fraction(E1, E2), dates.year_fraction(OBS, E2)
DE1, DE2 = dates.discount_factor(OBS, E1, RATE), dates.discount_factor(OBS, E2, RATE)
#: Market A at two days of one month.
SAME_MONTH = f"""w AS (SELECT vec_id AS path_id, sqrt({U1!r}) * {Z.format(1)} AS a1, sqrt({U2!r}) * {Z.format(3)} AS a2 FROM embeddings),
 p AS (SELECT path_id, 10 * exp(0.5 * a1 - 0.125 * {U1!r}) AS pa1, 10 * exp(0.5 * (a1 + a2) - 0.125 * {U12!r}) AS pa2 FROM w)"""


@query(f"""WITH {SAME_MONTH}, h AS (SELECT (pa1 + pa2) / 2 AS price, ({DE1!r} * 0.02 * pa1 + {DE2!r} * (greatest(1.01 * pa2 - 9, 0) - greatest(0.99 * pa2 - 9, 0))) / (0.02 * (pa1 + pa2) / 2) AS delta FROM p)
 SELECT 'A-2011-6' AS perturbation_name, round(avg(price), 6) AS price, round(avg(delta), 6) AS delta, round(avg(delta * price), 6) AS cash FROM h""")
def hedge_of_two_days(spark, sf_dir):
    """A month with two days of delivery is hedged at their mean price."""
    v, named, program = valued(spark, sf_dir, f"Wait('{E1}', Market('A')) + Wait('{E2}', Max(Market('A') - 9, 0))", "monthly")
    found = scenarios.deltas(v, named, program, RATE, BUMP).groupBy("perturbation_name")
    return found.agg(rounded(F.avg("price_simulated")).alias("price"), rounded(F.avg("delta")).alias("delta"), rounded(F.avg("cash")).alias("cash"))


# --- streams and simulated valuations: no SQL form ---------------------------------------------------


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS closed FROM events)
 SELECT event_type AS market, ts::DATE::VARCHAR AS day, arg_max(value, ts) AS price FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= closed GROUP BY 1, 2""")
def stream_last_prices(spark, sf_dir):
    """Last prices of all windows that the watermark has closed, from a stream that is read to its end and appended to files."""
    import uuid

    from pathval.folders import shared_folder
    from pathval.streaming.quotes import last_prices

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    found = last_prices(rows)
    run = found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows").select("market", F.col("start").cast("date").cast("string").alias("day"), "price")


@query()
def gas_storage_simulated(spark, sf_dir):
    """A year of gas storage on simulated prices, with monthly hedges."""
    from pathval.bench_contracts import gas_storage

    r = gas_storage(spark)
    return spark.createDataFrame(r.periods[["market_name", "delivery_date", "perturbation_name", "delta", "hedge_units", "price_simulated", "cash"]])
