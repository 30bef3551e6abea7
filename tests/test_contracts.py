"""Parsing, unfolding and scheduling, without Spark."""

import datetime as dt

import pytest
from dateutil.relativedelta import relativedelta
from hypothesis import given
from hypothesis import strategies as st

from pathval import errors
from pathval.api import Engine
from pathval.functions.dates import as_date, as_span, discount_factor, perturbation_name, year_fraction
from pathval.operators.regression import least_squares, solve
from pathval.plans.ir import source
from pathval.plans.parse import Parser
from pathval.plans.program import build, execution_order
from pathval.sources.curve import ForwardCurve
from pathval.sources.gbm import BlackScholes, Market

OBS = dt.date(2011, 1, 1)


def value(text, **kw):
    engine = Engine(limit=kw.pop("limit", 10_000), elements=kw.pop("elements", None))
    return engine.evaluate(engine.compile(text, kw.pop("obs", OBS)), **kw).fair_value


def count(text, limit=10_000):
    return Engine(limit=limit).compile(text, OBS).call_count


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("5 / 2", 2.5),
        ("5 // 2", 2),
        ("5 ** 2", 25),
        ("5 % 2", 1),
        ("7 % -3", -2),
        ("-7 // 2", -4),
        ("1 < 2 < 3", True),
        ("1 <= 2 >= 3", False),
        ("-Max(-4 - 4, -9)", 8),
        ("Add(2, Mult(3, 4))", 14),
        ("Min(2, 3) + Max(2, 3)", 5),
        ("1 == 1 and 2 > 1", True),
        ("1 > 2 or 3 > 2 or 1 > 0", True),
        ("3 if 1 > 2 else 4", 4),
        ("Date('2014-12-29') + TimeDelta('1m')", dt.date(2015, 1, 29)),
        ("Date('2011-1-31') + TimeDelta('1m')", dt.date(2011, 2, 28)),
        ("Date('2011-1-3') - TimeDelta('2d')", dt.date(2011, 1, 1)),
        ("2 * TimeDelta('1y')", relativedelta(years=2)),
        ("TimeDelta('2d') / 2", relativedelta(days=1)),
        ("Date('2012-1-1') - Date('2011-1-1')", relativedelta(years=1)),
        ("Max(Date('2012-1-1'), Date('2011-1-1'))", dt.date(2012, 1, 1)),
        ("ObservationDate()", OBS),
        ("PresentTime()", OBS),
        ("Fixing('2011-2-1', PresentTime())", dt.date(2011, 2, 1)),
        ("IsDayOfMonth(1)", True),
        ("Choice(3, 5, 5)", 5),
        ("'a' == 'a'", True),
    ],
)
def test_plain_values(text, expected):
    assert value(text) == expected


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("1 << 2", errors.DslSyntaxError),
        ("~1", errors.DslSyntaxError),
        ("not 1", errors.DslSyntaxError),
        ("+1", errors.DslSyntaxError),
        ("1 in 2", errors.DslSyntaxError),
        ("pass", errors.DslSyntaxError),
        ("x = 1", errors.DslSyntaxError),
        ("", errors.DslSyntaxError),
        ("1\n2", errors.DslSyntaxError),
        ("(", errors.DslSyntaxError),
        ("True", errors.DslSyntaxError),
        ("Market('a', 'b')", errors.DslSyntaxError),
        ("Market('a-b')", errors.DslSyntaxError),
        ("Choice(1)", errors.DslSyntaxError),
        ("TimeDelta('1j')", errors.DslSyntaxError),
        ("Date('1')", errors.DslSyntaxError),
        ("def f(x): return x\nf(x=1)", errors.DslSyntaxError),
        ("def f(*x): return 1\nf(1)", errors.DslSyntaxError),
        ("def f(x): return x\nf(1, 2)", errors.DslSyntaxError),
        ("def f(x):\n    if x > 1:\n        x\nf(1)", errors.DslSyntaxError),
        ("def f(x):\n    x\n    x\nf(1)", errors.DslSyntaxError),
        ("f(1)", errors.DslNameError),
        ("x + 1", errors.DslNameError),
        ("TimeDelta('1d') > 1", errors.DslCompareArgsError),
        ("TimeDelta('1d') + 1", errors.DslBinOpArgsError),
        ("1 / 0", ZeroDivisionError),
        ("1 if Market('A') > 1 else 2", errors.DslTestExpressionCannotBeEvaluated),
        ("def f(x): return 1 if x > 0 else 0\nf(Market('A'))", errors.DslTestExpressionCannotBeEvaluated),
        ("from no_such_module_at_all import f\nf(1)", errors.DslSyntaxError),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        value(text)


def test_source_must_be_text():
    with pytest.raises(errors.DslSyntaxError):
        Parser().parse(5)


def test_present_time_needs_a_date():
    with pytest.raises(errors.DslPresentTimeNotInScope):
        value("PresentTime()", obs=None)


@pytest.mark.parametrize("text", ["a - (b - c)", "a ** -b ** c", "(a + b) * c / d // e", "-(a + b)", "a - b - c", "f(a, Max(b, 1)) if a < b <= c else 'x'", "a and (b or c)", "(a ** b) ** c", "Wait('2011-01-01', Market('A') - 1.5)"])
def test_source_round_trip(text):
    first = Parser().parse(text).expressions[0]
    assert Parser().parse(source(first)).expressions[0] == first


def test_expressions_travel():
    import pickle

    e = Parser().parse("Wait('2011-1-1', Choice(Market('A') - 9, x))").expressions[0]
    hash(e)
    again = pickle.loads(pickle.dumps(e))
    assert again == e and again._hash == e._hash and pickle.loads(pickle.dumps({e: 1}))[e] == 1


FIB = "def fib(n): return fib(n - 1) + fib(n - 2) if n > 1 else n\n"


@pytest.mark.parametrize(("n", "result", "nodes"), [(0, 0, 2), (1, 1, 2), (2, 1, 4), (3, 2, 5), (7, 13, 9), (60, 1548008755920, 62)])
def test_fibonacci(n, result, nodes):
    assert (value(FIB + f"fib({n})"), count(FIB + f"fib({n})")) == (result, nodes)


def test_factorial_is_unbounded():
    text = "def fac(n): return n * fac(n - 1) if n > 1 else 1\nfac({})"
    assert (value(text.format(10)), count(text.format(10))) == (3628800, 11)
    assert value(text.format(30)) == 265252859812191058636308480000000


def test_calls_share_nodes():
    assert count("def f(x): return x\nf(1) + f(1)") == 2
    assert count("def f(x): return x\nf(f(f(1)))") == 2
    assert count("@inline\ndef f(x): return x\nf(f(f(1))) + f(1)") == 1


LATTICE = """
def walk(x, y, t):
    if t <= 0:
        x + y
    elif x <= 0:
        Max(walk(x, y, t - 1), walk(x + 1, y, t - 1))
    else:
        Max(walk(x - 1, y, t - 1), walk(x, y, t - 1))
{mark}
def same(x):
    x
walk(0, {arg}, {t})
"""


@pytest.mark.parametrize("mark", ["", "@inline"])
@pytest.mark.parametrize(("t", "result"), [(0, 1), (1, 2), (2, 2), (3, 2), (4, 2)])
def test_recombining_calls(mark, t, result):
    text = LATTICE.format(mark=mark, arg="same(1)", t=t)
    assert (value(text), count(text)) == (result, 2 * t + 2)


def test_functions_are_values():
    text = """
def apply(f, x): return f(x)
@inline
def twice(x): return 2 * x
apply(twice, 4)
"""
    assert value(text) == 8


@pytest.mark.parametrize(("t", "nodes"), [(0, 2), (1, 4), (2, 7), (3, 11), (4, 16)])
def test_inlined_step(t, nodes):
    text = "def g(t, x): return x if t <= 0 else Max(1 + g(before(t), x), g(before(t), x + 1))\n@inline\ndef before(t): return t - 1\n"
    assert (value(text + f"g({t}, 1)"), count(text + f"g({t}, 1)")) == (t + 1, nodes if t else 2)


AMERICAN = """
{0}def Exercise(date, strike, underlying, alternative):
    Wait(date, Choice(underlying - strike, alternative))
def American(start, end, strike, underlying):
    if start <= end:
        Exercise(start, strike, underlying, American(start + TimeDelta('1d'), end, strike, underlying))
    else:
        0
{1}def Stock(start, name):
    Settlement(start, ForwardMarket(start, name))
American(Date('2011-01-01'), Date('{2}'), 9, {3})
"""


@pytest.mark.parametrize(
    ("exercise", "stock", "end", "underlying", "nodes"),
    [
        ("", "", "2011-02-01", "Market('NBP')", 66),
        ("", "", "2011-04-01", "Stock('2011-01-01', 'NBP')", 275),
        ("", "@inline\n", "2011-04-01", "Stock('2011-01-01', 'NBP')", 184),
        ("@inline\n", "", "2011-04-01", "Stock('2011-01-01', 'NBP')", 184),
        ("@inline\n", "@inline\n", "2011-04-01", "Stock('2011-01-01', 'NBP')", 93),
    ],
)
def test_american_node_counts(exercise, stock, end, underlying, nodes):
    assert count(AMERICAN.format(exercise, stock, end, underlying)) == nodes


def test_limits():
    with pytest.raises(errors.CallLimitError):
        count("def f(n): return f(n + 1)\nf(0)", 500)
    with pytest.raises(errors.RecursionDepthError):
        count("@inline\ndef f(n): return f(n + 1)\nf(0)")
    with pytest.raises(errors.CallLimitError):
        count("def f(n): return n\nf(0)", 1)


def test_arguments_by_name_take_the_callees_time():
    text = "def later(x): return Fixing('2011-3-1', x)\nlater(Market('A'))"
    program = build(Engine().compile(text, OBS).nodes, OBS)
    assert program.prices == {("A", dt.date(2011, 3, 1), dt.date(2011, 3, 1))}


def test_calls_differ_by_present_time():
    text = "def f(x): return Market('A') * x\nf(1) + Fixing('2011-2-1', f(1))"
    assert count(text) == 3


def test_requirements_of_choices_and_forwards():
    text = "Wait('2011-2-1', Choice(ForwardMarket('2011-5-1', 'A'), Market('B')))"
    program = build(Engine().compile(text, OBS).nodes, OBS, "alltime")
    feb, may = dt.date(2011, 2, 1), dt.date(2011, 5, 1)
    assert program.prices == {("A", feb, may), ("A", may, may), ("A", feb, feb), ("B", feb, feb), ("A", OBS, OBS), ("B", OBS, OBS)}
    assert program.bumps[0] == {"A", "B"}


def test_execution_order():
    assert execution_order({1: (2, 3), 3: (2,), 2: ()}) == [2, 3, 1]
    with pytest.raises(errors.DslSystemError):
        execution_order({1: (2,), 2: (1,)})


def test_own_elements():
    from pathval.api import Element

    assert value("Half(9) + 1", elements={"Half": Element(1, 1, lambda x: x / 2, stochastic=False)}) == 5.5


def test_curve():
    curve = ForwardCurve("A", [("2011-1-1", 1), ("2011-1-3", 3)])
    assert [curve.price(f"2011-1-{d}") for d in (1, 2, 3, 4)] == [1, 1, 3, 3]
    with pytest.raises(KeyError):
        curve.price("2010-12-31")
    with pytest.raises(KeyError):
        ForwardCurve("A", []).price("2011-1-1")


def test_dates():
    assert as_date("2011-1-5") == as_date(dt.datetime(2011, 1, 5, 3)) == dt.date(2011, 1, 5)
    assert as_span("3m") == relativedelta(months=3)
    assert year_fraction(dt.date(2011, 1, 1), dt.date(2012, 1, 1)) == 1
    assert year_fraction(dt.date(2011, 1, 1), dt.date(2011, 2, 1)) == 1 / 12
    assert discount_factor(dt.date(2011, 1, 1), dt.date(2111, 1, 1), 2.5) == pytest.approx(0.0820849986)
    assert [perturbation_name("A", OBS, p) for p in ("alltime", "yearly", "monthly", "daily", None)] == ["A", "A-2011", "A-2011-1", "A-2011-1-1", None]


@pytest.mark.parametrize("y", [[1.0, 1.0, 1.0], [0.0, 1.0, 2.0]])
def test_least_squares_of_few_rows_is_exact(y):
    import numpy as np

    fitted = least_squares([np.array([0.0, 1, 2]), np.array([3.0, 4, 5])], np.array(y))
    np.testing.assert_allclose(fitted, y, atol=1e-12)
    with pytest.raises(ValueError):
        least_squares([np.ones(2)], np.ones(3))


@given(st.lists(st.floats(-5, 5), min_size=8, max_size=40), st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_solve_finds_the_polynomial(xs, coef):
    import numpy as np

    x = np.array(xs)
    basis = np.stack([np.ones_like(x), x, x * x], axis=1)
    y = basis @ np.array(coef)
    got = basis @ solve(basis.T @ basis, (basis.T @ y)[:, None])[:, 0]
    np.testing.assert_allclose(got, y, atol=1e-3 * (1 + abs(y).max()))


def test_price_process():
    import numpy as np

    days = [dt.date(2011, 1, 1), dt.date(2012, 1, 1), dt.date(2013, 1, 1)]
    market = Market.from_params({"market": ["A", "B"], "sigma": [0.5, 0.3], "rho": [[1, 0.5], [0.5, 1]], "curve": {"A": [("2011-1-1", 10), ("2012-6-1", 15)], "B": [("2011-1-1", 20)]}, "alpha": 1})
    process = BlackScholes(market, OBS, [(m, d, d) for m in "AB" for d in days])
    chunks = [process.chunk(k, 1000) for k in range(40)]
    at = lambda m, d: np.concatenate([c[m, d, d] for c in chunks])
    assert np.all(at("A", days[0]) == 10)
    assert at("A", days[1]).mean() == pytest.approx(10, abs=0.15)
    assert at("A", days[2]).mean() == pytest.approx(15, abs=0.35)
    returns = np.corrcoef(np.log(at("A", days[1])), np.log(at("B", days[1])))
    assert returns[0, 1] == pytest.approx(0.5, abs=0.02)
    assert np.log(at("A", days[1])).std() == pytest.approx(0.5, abs=0.01)


def test_price_process_errors():
    one = {"market": ["A"], "sigma": [0.1], "curve": {"A": [("2011-1-1", 10)]}}
    with pytest.raises(errors.DslError):
        Market.from_params({"market": ["A", "B"], "sigma": [1, 1], "curve": {"A": [], "B": []}})
    with pytest.raises(errors.DslError):
        Market.from_params({k: v for k, v in one.items() if k != "sigma"})
    with pytest.raises(errors.DslError):
        BlackScholes(Market.from_params(one), OBS, [("A", dt.date(2010, 1, 1), dt.date(2010, 1, 1))])
    bad = {"market": ["A", "B"], "sigma": [1, 1], "rho": [[1, 2], [2, 1]], "curve": {"A": [("2011-1-1", 1)], "B": [("2011-1-1", 1)]}}
    with pytest.raises(errors.DslError):
        Market.from_params(bad).mixing(["A", "B"])


@pytest.mark.parametrize("module", ["os", "sys", "zipimport", "no.such", "math", "encodings.idna.nothing"])
def test_modules_without_contracts(module):
    from pathval.errors import DslSyntaxError

    with pytest.raises(DslSyntaxError):
        Parser().parse(f"from {module} import path_of_nothing")
