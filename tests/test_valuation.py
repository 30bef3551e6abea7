"""Contracts valued on simulated paths, against closed forms and published values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pathval.api import Element, Engine, calc
from pathval.errors import CallLimitError, DslError
from pathval.operators import scenarios
from pathval.sources import calibrate, curve, quotes
from pathval.sources.gbm import BlackScholes, Market

OBS = dt.date(2011, 1, 1)
NAMES = ["#1", "#2", "NBP", "TTF", "SPARKSPREAD"]


def model(sigma=(0.5, 0.5, 0.5, 0.4, 0.4)):
    rho = [[float(a == b) or (0.4 if {a, b} == {"NBP", "TTF"} else 0.0) for b in NAMES] for a in NAMES]
    return {"market": NAMES, "sigma": list(sigma), "rho": rho, "curve": {m: [("2011-1-1", p)] for m, p in zip(NAMES, (10, 10, 10, 11, 1), strict=True)}}


@pytest.fixture
def run(spark):
    def go(text, periodisation=None, **kw):
        kw = {"price_process": model(), "interest_rate": 2.5, "path_count": 20_000} | kw
        return calc(text, OBS, periodisation=periodisation, spark=spark, **kw)

    return go


def near(result, value, scale=4.0):
    assert abs(result.fair_value_mean - value) <= max(0.01, scale * math.sqrt(2) * result.fair_value_error), (result.fair_value_mean, result.fair_value_error)


@pytest.mark.parametrize(
    ("text", "value", "deltas", "periodisation"),
    [
        ("Market('NBP') * 2", 20, {"NBP": 2}, "alltime"),
        ("Market('NBP') * 2", 20, {"NBP-2011-1": 2}, "monthly"),
        ("Market('NBP') + 2 * Market('TTF')", 32, {"NBP-2011-1": 1, "TTF-2011-1": 2}, "monthly"),
        ("Market('#1') * Market('#2')", 100, {"#1-2011": 10}, "yearly"),
        ("Settlement(Date('2012-01-01'), Market('NBP'))", 9.7531, {"NBP-2011-1-1": 0.97531}, "daily"),
    ],
)
@pytest.mark.parametrize("both", [True, False])
def test_exact_values(run, text, value, deltas, periodisation, both):
    r = run(text, periodisation, path_count=1500, is_double_sided_deltas=both)
    assert r.fair_value_mean == pytest.approx(value, abs=1e-4)
    assert r.fair_value_error == pytest.approx(0, abs=1e-9)
    for name, delta in deltas.items():
        assert r.deltas[name] == pytest.approx(delta, abs=1e-4)


def test_without_volatility(run):
    still = {"price_process": model([0.0] * 5), "path_count": 100}
    r = run("Wait('2022-1-1', Market('#1'))", "alltime", **still)
    assert (r.fair_value_mean, r.deltas["#1"]) == (pytest.approx(7.596, abs=1e-3), pytest.approx(0.7596, abs=1e-4))
    assert run("Wait('2012-1-1', Choice(Market('#1') - 9, 0))", **still).fair_value_mean == pytest.approx(0.9753, abs=1e-4)


EUROPEAN = "Wait(Date('2012-01-01'), Choice(Market('NBP') - 9, 0))"
BERMUDAN = "Fixing('2011-06-01', Choice(Market('NBP') - 9, Fixing('2012-01-01', Choice(Market('NBP') - 9, 0))))"


def black_scholes(spot, strike, sigma, years, rate):
    n = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    d = (math.log(spot / strike) + sigma**2 / 2 * years) / (sigma * math.sqrt(years))
    return math.exp(-rate * years) * (spot * n(d) - strike * n(d - sigma * math.sqrt(years)))


def test_european_has_its_closed_form(run):
    r = run(EUROPEAN, "alltime", path_count=50_000)
    near(r, black_scholes(10, 9, 0.5, 1, 0.025))
    assert r.deltas["NBP"] == pytest.approx(0.6687, abs=0.02)


def test_bermudan(run):
    r = run(BERMUDAN, "monthly")
    near(r, 2.393)
    p = r.periods.set_index("perturbation_name")
    for name, delta in {"NBP-2011-6": 0.0197, "NBP-2012-1": 0.0589}.items():
        assert abs(p["delta"][name] - delta) < 5 * math.sqrt(2) * p["delta_err"][name]
    assert run(BERMUDAN, "alltime").deltas["NBP"] == pytest.approx(0.671, abs=0.02)


def test_two_markets(run):
    near(run("Fixing('2012-01-01', Max(Market('#1'), Market('#2')))"), 12.752)
    near(run("Max(Fixing('2012-01-01', Market('TTF')) * Fixing('2012-01-01', Market('NBP')) / 10.0, 0.0) - Max(Fixing('2013-01-01', Market('TTF')), 0)"), 0.954)


@pytest.mark.parametrize(("both", "delta"), [(True, 0.8008), (False, 0.811)])
def test_american(run, both, delta):
    """Daily exercise through January, on all paths."""
    text = """
from pathval.models.options import American
American(Date('2011-01-01'), Date('2011-02-01'), 9, Market('NBP'), TimeDelta('1d'))
"""
    r = run(text, "alltime", is_double_sided_deltas=both)
    near(r, 1.1805)
    assert r.deltas["NBP"] == pytest.approx(delta, abs=0.04)


def test_options_to_import(run):
    near(run("from pathval.models.options import European\nEuropean(Date('2012-01-11'), 9, Market('NBP'))"), 2.397)
    near(run("from pathval.models.options import American\nAmerican(Date('2012-01-01'), Date('2012-01-11'), 5, Market('NBP'), TimeDelta('1d'))"), 5.0356)
    put = run("from pathval.models.options import EuropeanPut\nEuropeanPut(Date('2012-01-01'), 9, Market('NBP'))")
    call = run("from pathval.models.options import European\nEuropean(Date('2012-01-01'), 9, Market('NBP'))")
    assert call.fair_value_mean - put.fair_value_mean == pytest.approx(math.exp(-0.025), abs=0.1)
    later = run("from pathval.models.options import AmericanPut\nAmericanPut(Date('2011-07-01'), Date('2012-01-01'), 9, Market('NBP'), TimeDelta('3m'))")
    assert later.fair_value_mean >= put.fair_value_mean - 0.05


STOCK = """
def Option(date, strike, x, y):
    Wait(date, Choice(x - strike, y))
def European(date, strike, underlying):
    Option(date, strike, underlying, 0)
def EuropeanStock(start, end, strike, name):
    European(end, strike, Settlement(start, 1) * ForwardMarket(start, name))
EuropeanStock(Date('2011-01-01'), Date('2012-01-01'), 9, 'NBP')
"""


def test_european_stock(run):
    r = run(STOCK, "alltime")
    near(r, 2.54659)
    assert r.program.count == 4 and r.deltas["NBP"] == pytest.approx(0.7017, abs=0.02)


def test_swing_on_forwards(run):
    text = """
def Swing(day, end, left):
    if left == 0 or day >= end:
        0
    else:
        Wait(day, Choice(
            Swing(day + TimeDelta('1m'), end, left - 1) + ForwardMarket(day + TimeDelta('1m'), 'NBP'),
            Swing(day + TimeDelta('1m'), end, left)))
Swing(Date('2011-2-1'), Date('2011-5-1'), 30)
"""
    r = run(text, "monthly")
    near(r, 29.872)
    assert r.program.count == 11
    p = r.periods.set_index("perturbation_name")
    for name, delta in {"NBP-2011-3": 1.019, "NBP-2011-4": 1.020, "NBP-2011-5": 1.014}.items():
        assert abs(p["delta"][name] - delta) < max(0.03, 5 * math.sqrt(2) * p["delta_err"][name])


def test_two_swings(run):
    text = """
def Swing(day, end, underlying, left):
    if left == 0 or day >= end:
        0
    else:
        Choice(Later(day, end, underlying, left - 1) + Fixing(day, underlying), Later(day, end, underlying, left))
@inline
def Later(day, end, underlying, left):
    Swing(day + TimeDelta('1d'), end, underlying, left)
Swing(Date('2011-1-1'), Date('2011-1-4'), Market('#1'), 2) * 1 + Swing(Date('2011-1-1'), Date('2011-1-4'), Market('#2'), 2) * 2
"""
    r = run(text, "alltime")
    assert r.fair_value_mean == pytest.approx(60.0, abs=0.2) and r.program.count == 19
    assert r.deltas["#1"] == pytest.approx(2.0, abs=0.02) and r.deltas["#2"] == pytest.approx(4.0, abs=0.04)


def plant(end):
    """Runs at the price of the day, at 0.9 and 0.8 of it after one and more idle days (fixed values)."""
    return f"""
def Plant(day, end, price, idle):
    Wait(day, Choice(
        Plant(day + TimeDelta('1d'), end, price, 0) + (1.0 - 0.1 * idle) * Fixing(day, price),
        Plant(day + TimeDelta('1d'), end, price, Min(2, idle + 1)))) if day < end else 0
Plant(Date('2012-01-01'), Date('{end}'), Market('SPARKSPREAD'), 0)
"""


@pytest.mark.parametrize("both", [True, False])
def test_plant_on_the_spread(run, both):
    r = run(plant("2012-01-13"), "monthly", is_double_sided_deltas=both)
    near(r, 11.719)
    assert r.program.count == 37 and r.deltas["SPARKSPREAD-2012-1"] == pytest.approx(11.699, abs=0.25)


def test_plants_grow_by_three_nodes_a_day():
    counts = [scenarios.contract(plant(f"2012-01-{d}"), OBS).count for d in (5, 13, 14, 15, 16)]
    assert counts == [13, 37, 40, 43, 46]


def test_plant_on_forwards_of_two_markets(run):
    text = """
from pathval.models.powerplant import PowerPlant
PowerPlant(Date('2012-1-1'), Date('2012-1-13'), 'TTF', 'NBP', 2, TimeDelta('1d'))
"""
    r = run(text)
    near(r, 24.77555)
    assert r.program.count == 37


@pytest.mark.parametrize(
    ("start", "end", "quantity", "limit", "sigma", "value", "nodes"),
    [
        ("2011-1-1", "2011-3-1", 0, 0, 0.5, 0.0, 2),
        ("2011-1-1", "2011-3-1", 0, 10, 0.5, 0.0, 7),
        ("2013-1-1", "2013-3-1", 0, 10, 0.5, -0.001, 7),
        ("2011-1-1", "2011-3-1", 2, 2, 0.5, 19.982, 7),
        ("2011-1-1", "2011-3-1", 2, 2, 0.0, 19.979, 7),
        ("2021-1-1", "2021-3-1", 2, 2, 0.5, 15.971, 7),
        ("2021-1-1", "2021-3-1", 0, 2, 0.5, 0.0024, 7),
        ("2011-1-1", "2011-4-1", 0, 3, 0.5, None, 11),
        ("2011-1-1", "2011-5-1", 0, 3, 0.5, None, 15),
        ("2011-1-1", "2011-6-1", 0, 3, 0.5, None, 19),
    ],
)
def test_storage_grid(run, start, end, quantity, limit, sigma, value, nodes):
    text = f"""
from pathval.models.storage import GasStorage
GasStorage(Date('{start}'), Date('{end}'), 'NBP', {quantity}, {limit}, TimeDelta('1m'))
"""
    assert scenarios.contract(text, OBS).count == nodes
    if value is not None:
        r = run(text, price_process=model([sigma] * 5))
        assert abs(r.fair_value_mean - value) <= max(0.01, 4 * math.sqrt(2) * r.fair_value_error)


@pytest.mark.parametrize(("periodisation", "value", "periods"), [("monthly", 8.7977, 6), ("alltime", 8.749, 1), (None, 8.6359, 0)])
def test_storage_to_a_target(spark, periodisation, value, periods):
    from pathval.bench_contracts import GAS_BY_MONTH

    text = """
from pathval.models.storage import GasStorageToTarget
GasStorageToTarget(Date('2011-6-1'), Date('2011-12-1'), 'GAS', 0, 0, 50000, TimeDelta('1m'), 1)
"""
    r = calc(text, OBS, 2.5, periodisation=periodisation, price_process={"market": ["GAS"], "sigma": [0.5], "curve": {"GAS": GAS_BY_MONTH}}, spark=spark)
    assert r.fair_value_mean == pytest.approx(value, abs=0.5) and len(r.periods) == periods


def test_a_missed_target_is_a_breach(run):
    text = "from pathval.models.storage import GasStorageToTarget\nGasStorageToTarget(Date('2011-1-1'), Date('2011-1-2'), 'NBP', 0, {}, 9, TimeDelta('1d'), 2)"
    assert run(text.format(5), path_count=100).fair_value_mean < -1e15
    assert run(text.format(2), path_count=100).fair_value_mean == pytest.approx(-20)


def test_swing(run):
    text = """
def Swing(start, end, underlying, quantity):
    if quantity == 0 or start >= end:
        0
    else:
        Wait(start, Choice(
            Swing(start + TimeDelta('1d'), end, underlying, quantity - 1) + underlying,
            Swing(start + TimeDelta('1d'), end, underlying, quantity)))
Swing(Date('2011-01-01'), Date('2011-01-05'), Market('NBP'), 3)
"""
    r = run(text, "alltime")
    assert r.program.count == 15
    assert r.fair_value_mean == pytest.approx(30.0, abs=0.05)
    assert r.deltas["NBP"] == pytest.approx(3.0, abs=0.01)


def test_paths_do_not_depend_on_partitions(spark):
    from pathval.api import Engine
    from pathval.operators.blocks import BlockRunner

    engine = Engine(spark)
    contract = engine.compile(BERMUDAN, OBS)
    one = engine.evaluate(contract, model(), path_count=3300).fair_value.orderBy("path_id").toPandas()
    was = BlockRunner.__init__

    def single(self, *a, **k):
        was(self, *a, **k)
        self.parts, self.chunks_a_block, self.blocks = 1, 4, 1

    BlockRunner.__init__ = single
    try:
        other = engine.evaluate(contract, model(), path_count=3300).fair_value.orderBy("path_id").toPandas()
    finally:
        BlockRunner.__init__ = was
    assert len(one) == 3300 and (one["path_id"] == range(3300)).all()
    assert abs(one["value"] - other["value"]).max() < 1e-9


def test_columns_agree_with_blocks(spark):
    """Prices from hashed draws and sums of products, for the same contract."""
    program = scenarios.contract(BERMUDAN, OBS, "alltime")
    process = BlackScholes(Market.from_params(model()), OBS, sorted(program.prices), seed=3)
    df, named = process.columns(spark.range(20_000).withColumnRenamed("id", "path_id"))
    valued = scenarios.value(df, named, program, 2.5)
    mean, err = valued.agg(F.avg("v"), F.stddev_pop("v") / F.sqrt(F.count("v"))).first()
    assert abs(mean - 2.393) < 6 * err
    mean, err = scenarios.deltas(valued, named, program, 2.5).agg(F.avg("delta"), F.stddev_pop("delta") / F.sqrt(F.count("delta"))).first()
    assert abs(mean - 0.671) < 6 * err


def test_draws_are_normal_and_independent_of_partitions(spark):
    from pathval.sources.gbm import normal_draw

    df = spark.range(0, 40_000, 1, 7).select("id", normal_draw(F.col("id"), 1, 0).alias("a"), normal_draw(F.col("id"), 1, 1).alias("b"))
    m, s, k, c = df.agg(F.avg("a"), F.stddev("a"), F.kurtosis("a"), F.corr("a", "b")).first()
    assert abs(m) < 0.02 and abs(s - 1) < 0.02 and abs(k) < 0.15 and abs(c) < 0.02
    again = spark.range(0, 40_000, 1, 3).select("id", normal_draw(F.col("id"), 1, 0).alias("x"))
    assert df.join(again, "id").where("a <> x").count() == 0


def test_report(run):
    r = run("Wait('2011-3-1', Market('NBP') - Market('TTF')) + Wait('2011-5-1', Market('NBP'))", "monthly", path_count=2000)
    p = r.periods
    assert list(p["perturbation_name"]) == ["NBP-2011-3", "TTF-2011-3", "NBP-2011-5"]
    assert p["hedge_units"].tolist() == pytest.approx([-1, 1, -1])
    assert (p["cash"] + p["hedge_cost"]).abs().max() < 1e-9
    assert r.prices_mean.shape == r.hedges_mean.shape == (2, 2)
    units, cash = r.net
    assert units["NBP"][0] == pytest.approx(-2)
    assert cash[0] == pytest.approx(r.fair_value_mean)
    assert r.cash_mean["cash"].iloc[-1] == pytest.approx(cash[0])
    bounds = r.bounds("price_simulated", 90)
    assert (bounds["below"] > 0).all() and (bounds["above"] > 0).all()
    assert len(r.deviations("cash")) == 3 and len(r.plot_frame()) == 3
    assert "Fair value" in str(r) and "Net hedge NBP" in str(r)


def test_plain_results_need_no_paths(spark):
    r = calc("2 + 3", spark=spark)
    assert r.fair_value_mean == 5 and r.deltas == {} and "5" in str(r)
    with pytest.raises(ValueError):
        r.plot_frame()


def test_own_element_on_paths(run):
    r = run("Twice(Market('NBP')) + 1", dsl_classes={"Twice": Element(1, 1, lambda x: 2 * x)}, path_count=100)
    assert r.fair_value_mean == pytest.approx(21)


def test_vector_division_by_zero(run):
    assert run("Market('NBP') / (0 * Market('NBP'))", path_count=100).paths.where("value = double('infinity')").count() == 100


def test_limits_and_errors(run):
    with pytest.raises(CallLimitError):
        run("def f(n): return f(n + 1)\nf(0)", max_dependency_graph_size=10)
    with pytest.raises(DslError):
        run("Market('NBP')", price_process={})
    with pytest.raises(DslError):
        run("Market('NOPE')")
    with pytest.raises(DslError):
        run("Market('NBP')", price_process=model() | {"name": "no.such.Process"})


def test_timeout(run):
    days = "".join(f" + Wait('2011-{m}-{d}', Choice(Market('NBP') - 9, 0))" for m in range(2, 5) for d in range(1, 25))
    with pytest.raises(SystemExit):
        run("0" + days, "daily", path_count=60_000, timeout=0.2)


def test_plot_needs_periods(run):
    with pytest.raises(ValueError, match="no periods"):
        run("Market('NBP')", path_count=100).plot()
    plt = pytest.importorskip("matplotlib.pyplot")
    plt.switch_backend("Agg")
    assert len(run(BERMUDAN, "monthly", path_count=500).plot(pause=0.01).axes) == 3


def test_progress_and_time_left():
    from pathval import watch

    class Jobs:
        def __init__(self):
            self.seen = []

        def __getattr__(self, name):
            return lambda tag: self.seen.append(name)

    now, jobs = [0.0], Jobs()
    w = watch.Watch(lambda: jobs, timeout=100.0, clock=lambda: now[0])
    with pytest.raises(TimeoutError, match="left"), w:
        w.start()
        now[0] = 10.0
        w.step(1, 100)  # too early to believe in 990 s left
        now[0] = 20.0
        w.step(30, 100)  # 47 s left
        now[0] = 60.0
        w.step(31, 100)
    assert jobs.seen == ["addTag", "interruptTag", "removeTag"]


@pytest.mark.parametrize("name", ["SIGINT", "SIGTERM"])
def test_signals_stop_a_valuation(run, capsys, name):
    import os
    import signal
    import threading

    number, before = getattr(signal, name), signal.getsignal(getattr(signal, name))
    days = "".join(f" + Wait('2011-{m}-{d}', Choice(Market('NBP') - 9, 0))" for m in range(2, 5) for d in range(1, 25))
    timer = threading.Timer(1.0, os.kill, [os.getpid(), number])
    timer.start()
    with pytest.raises(SystemExit):
        run("0" + days, "daily", path_count=60_000, verbose=True)
    timer.join()
    assert signal.getsignal(number) == before and f"stopped by {name}" in capsys.readouterr().out
    assert run("Market('NBP')", path_count=100).fair_value_mean == pytest.approx(10)


def test_verbose_tells_progress(run, capsys):
    run(BERMUDAN, "monthly", path_count=500, verbose=True)
    said = capsys.readouterr().out
    assert "nodes, compiled" in said and "% " not in said.split("evaluations in")[-1] and "s left" in said


def test_published_contracts(spark):
    """The two published runs: values, hedges by period, sizes of the graphs."""
    from pathval.bench_contracts import gas_storage, power_plant

    gas, power = gas_storage(spark), power_plant(spark)
    near(gas, 20.78)
    assert len(gas.periods) == 12 and gas.program.count == 92 and gas.program.evaluations() == 844
    near(power, 12.82)
    assert len(power.periods) == 8 and power.program.count == 13
    # Published deltas.
    wanted = {"GAS-2012-1-2": -0.05, "POWER-2012-1-2": 0.02, "GAS-2012-1-3": -0.98, "POWER-2012-1-3": 0.32, "GAS-2012-1-4": -0.98, "POWER-2012-1-4": 0.98, "GAS-2012-1-5": -0.49, "POWER-2012-1-5": 0.49}
    assert set(power.deltas) == set(wanted) and all(power.deltas[n] == pytest.approx(d, abs=0.02) for n, d in wanted.items())
    power.close()


def test_summary_equals_the_paths(run):
    r = run(BERMUDAN, "monthly", path_count=3500)
    rows = r.paths.toPandas()
    for _, s in r.summary.iterrows():
        mine = rows[rows["perturbation_name"].isna() if s["perturbation_name"] is None or s["perturbation_name"] != s["perturbation_name"] else rows["perturbation_name"] == s["perturbation_name"]]
        for m in ("value", "delta", "cash", "price_simulated"):
            x = mine[m].dropna()
            if len(x):
                assert s[m] == pytest.approx(x.mean(), rel=1e-12) and s[f"{m}_err"] == pytest.approx(x.std(ddof=0) / math.sqrt(len(x)), rel=1e-9, abs=1e-12)
            else:
                assert math.isnan(s[m]) and math.isnan(s[f"{m}_err"])


def test_blocks_of_a_scenario_table(spark):
    """The block engine on a table of prices gives what the column engine gives, path by path."""
    program = scenarios.contract(BERMUDAN, OBS, "monthly")
    process = BlackScholes(Market.from_params(model()), OBS, sorted(program.prices))
    table, named = process.columns(spark.range(0, 9000, 1, 3).select((F.col("id") * 7).alias("path_id")))
    want = {r["path_id"]: r["v"] for r in scenarios.value(table, named, program, 2.5).select("path_id", "v").collect()}
    engine = Engine(spark)
    got = engine.evaluate(engine.compile(BERMUDAN, OBS), interest_rate=2.5, periodisation="monthly", scenarios=(table, named))
    rows = {r["path_id"]: r["value"] for r in got.fair_value.collect()}
    assert set(rows) == set(want)
    assert sum(abs(rows[k] - v) > 1e-9 for k, v in want.items()) <= 2  # paths on the very edge of a choice
    with pytest.raises(DslError):
        engine.evaluate(engine.compile(BERMUDAN, OBS), scenarios=(table, {}))


class Doubling:
    """A price process of one's own: prices double each year, on every path."""

    def __init__(self, market, observation, keys, seed):
        self.observation, self.keys = observation, keys

    def scale(self, key):
        return 2.0 ** (key[2].year - self.observation.year), 0.0

    def chunk(self, number, size):
        import numpy as np

        return {k: np.full(size, self.scale(k)[0]) for k in self.keys}


def test_own_price_process(run, monkeypatch):
    from pathval import api

    monkeypatch.setitem(api.PROCESSES, "doubling", Doubling)
    r = run("Fixing('2013-1-1', Choice(Market('NBP') - 1, 0))", price_process=model() | {"name": "doubling"}, path_count=10)
    assert r.fair_value_mean == 3


# --- sources -------------------------------------------------------------------------------


def test_as_of(spark):
    q = spark.createDataFrame([("a", dt.date(2011, 1, 1), 1.0), ("a", dt.date(2011, 1, 3), 3.0), ("a", dt.date(2011, 4, 2), 4.0)], "m string, day date, price double")
    days = [(2010, 12, 31), (2011, 1, 1), (2011, 1, 2), (2011, 1, 3), (2011, 3, 9), (2011, 4, 1), (2011, 4, 2), (2012, 1, 1)]
    w = spark.createDataFrame([("a", dt.date(*d)) for d in days] + [("b", dt.date(2011, 1, 1))], "m string, day date")
    got = {(r["m"], r["day"]): r["price"] for r in curve.as_of(w, q, "m", "day", "price").collect()}
    assert [got["a", dt.date(*d)] for d in days] == [None, 1.0, 1.0, 3.0, 3.0, 3.0, 4.0, 4.0]
    assert got["b", dt.date(2011, 1, 1)] is None
    assert curve.as_of(w.limit(0), q, "m", "day", "price").count() == 0
    assert curve.as_of(w, q.limit(0), "m", "day", "price").where("price is not null").count() == 0


def test_calibration_feeds_a_price_process(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.standard_normal((120, 2)) @ np.linalg.cholesky([[1, 0.7], [0.7, 1]]).T
    path = 100 * np.exp(np.cumsum(z * [0.02, 0.01], axis=0))
    rows = [(m, dt.date(2011, 1, 3) + dt.timedelta(days=k), float(path[k, j])) for k in range(120) for j, m in enumerate("AB")]
    df = spark.createDataFrame(rows, "market string, date date, price double")
    p = calibrate.params(df, dt.date(2011, 1, 1), dt.date(2011, 4, 1), ["A", "B"])
    assert p["sigma"][0] == pytest.approx(0.02 * math.sqrt(252), rel=0.25)
    assert p["rho"][0][1] == pytest.approx(0.7, abs=0.15)
    assert [d for d, _ in p["curve"]["B"]] == ["2011-01-01", "2011-02-01", "2011-03-01", "2011-04-01"]
    assert calc("Market('A') - Market('B')", "2011-4-1", price_process=p, spark=spark, path_count=100).fair_value_mean == pytest.approx(p["curve"]["A"][-1][1] - p["curve"]["B"][-1][1])
    returns = np.diff(np.log(path[:, 0]))
    assert calibrate.historical_volatility(df, ["market"]).where("market = 'A'").first()["volatility"] == pytest.approx(math.sqrt(252 * returns.var(ddof=1)))


def test_quotes_to_files_and_back(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2011, 1, d), float(d)) for d in range(1, 6)], quotes.SCHEMA)
    for form in ("parquet", "csv", "json", "orc"):
        quotes.write_quotes(df, str(tmp_path / form), form)
        assert sorted(quotes.read_quotes(spark, str(tmp_path / form), form).collect()) == sorted(df.collect())
    text = quotes.to_csv_text(df)
    assert quotes.to_csv_text(quotes.from_csv_text(spark, text)) == text


def test_tall_and_wide(spark):
    keys = [("A", OBS, OBS), ("B", OBS, dt.date(2012, 1, 1))]
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "path_id long, p0 double, p1 double")
    rows = quotes.tall(df, dict(zip(keys, ["p0", "p1"], strict=True)))
    assert rows.count() == 4
    back, named = quotes.wide(rows, keys)
    assert sorted(back.collect()) == sorted(df.collect()) and list(named) == keys


def test_stream_recalibrates(spark, tmp_path):
    from pathval.streaming.quotes import last_prices, recalibrate

    source, seen = str(tmp_path / "in"), []
    rows = [("A", dt.datetime(2024, 1, d, h), float(d + h / 24)) for d in range(1, 20) for h in (3, 9, 20)]
    spark.createDataFrame(rows, "market string, ts timestamp, price double").write.parquet(source)
    stream = spark.readStream.schema("market string, ts timestamp, price double").parquet(source)
    q = recalibrate(last_prices(stream), str(tmp_path / "history"), lambda df, n: seen.append(df.collect()))
    q.processAllAvailable()
    q.stop()
    assert any(r and r[0]["market"] == "A" and r[0]["volatility"] > 0 for r in seen)


def test_late_quotes_do_not_count(spark, tmp_path):
    """Rows behind the watermark are left out, windows come once they are closed."""
    from pathval.streaming.quotes import last_prices

    day = lambda d, h=0: dt.datetime(2020, 1, d, h)
    batches = [[("A", day(1, 1), 1.0), ("A", day(1, 5), 2.0), ("B", day(1, 2), 7.0)], [("A", day(9), 3.0), ("A", day(1, 4), 1.5)], [("A", day(1, 23), 9.0), ("A", day(20), 4.0)]]
    schema = "market string, ts timestamp, price double"
    for rows in batches:  # a batch a file
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = last_prices(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r["market"], r["start"].day, r["price"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("A", 1, 2.0), ("B", 1, 7.0), ("A", 9, 3.0)}


def test_shared_folder_of_a_cluster_must_be_named():
    from pathval.folders import shared_folder

    class Session:
        def __init__(self, **known):
            self.conf = {k.replace("_", "."): v for k, v in known.items()}

    assert shared_folder(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session(spark_master=master))
    assert shared_folder(Session(spark_master="local[4]")) == shared_folder(Session(spark_master="local"))


def test_command_line(spark, tmp_path, capsys):
    import json

    from pathval.cli import main

    (tmp_path / "c.py").write_text("Wait('2011-2-1', Market('A'))")
    (tmp_path / "m.json").write_text(json.dumps({"market": ["A"], "sigma": [0.1], "curve": {"A": [["2011-1-1", 10]]}}))
    main([str(tmp_path / "c.py"), "--model", str(tmp_path / "m.json"), "--observation-date", "2011-1-1", "--periodisation", "monthly", "--path-count", "500"])
    assert "Fair value" in capsys.readouterr().out
