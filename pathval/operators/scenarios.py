"""Valuation on scenario tables: a row a path, a column a price, all in DataFrame functions.

Choices of a level share one aggregate job that sums the products of their regressors and
alternatives; fitted values then enter a CASE over the alternatives.  Meant for tables of any
number of rows and contracts of few choices; blocks of paths serve contracts of many.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathval.errors import DslError
from pathval.functions.dates import discount_factor
from pathval.operators.blocks import Setting, bumps_of
from pathval.operators.evaluate import Columns, Evaluator
from pathval.operators.regression import solve
from pathval.plans.parse import Parser
from pathval.plans.program import PriceKey, Program, build
from pathval.plans.unfold import Unfolder


def contract(source: str, observation: dt.date, periodisation: str | None = None, elements: Mapping | None = None) -> Program:
    """A contract's schedule; ``elements`` are those of one's own, by name."""
    found = dict(elements or {})
    module = Parser({n: (e.least, e.most) for n, e in found.items()}).parse(source)
    random = frozenset(n for n, e in found.items() if e.stochastic)
    return build(Unfolder(module, observation, stochastic=random).nodes(), observation, periodisation)


def products(xs: list[Column]) -> list[Column]:
    """The regression basis as columns: 1, x, x^2, products of different x."""
    return [F.lit(1.0), *xs, *(x * x for x in xs), *(xs[i] * xs[j] for i in range(len(xs)) for j in range(i + 1, len(xs)))]


def value(paths: DataFrame, prices: Mapping[PriceKey, str], program: Program, rate: float = 0.0, factor: float = 0.01, double_sided: bool = True, elements: Mapping | None = None) -> DataFrame:
    """``paths`` with ``v``, the contract's value, and ``v__<bump>`` for each bump that touches it."""
    setting = Setting(rate, factor, double_sided, {n: e.apply for n, e in (elements or {}).items()})
    missing = sorted(set(program.final_prices).union(*(c.prices for c in program.choices)) - set(prices))
    if missing:
        raise DslError("scenarios lack a price", repr(missing[0]))
    held: dict[tuple[int, str], Column] = {}
    df, names = paths, list(paths.columns)

    def evaluator() -> Evaluator:
        return Evaluator(program, Columns, lambda key: F.col(prices[key]), lambda n, b: held[n, b], rate, factor, setting.custom)

    column = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else x
    for level in range(1, max((c.level for c in program.choices), default=0) + 1):
        ev = evaluator()
        cases = [c for c in program.choices if c.level == level]
        alternatives = {(c.number, b): [column(ev.value(e, c.present, b)) for e in c.expr.args] for c in cases for b in bumps_of(program, setting, c.bumps)}
        flat = [(key, k) for key, found in alternatives.items() for k in range(len(found))]
        named = {slot: f"pv_a{level}_{n}" for n, slot in enumerate(flat)}
        df = df.select("*", *[alternatives[key][k].alias(named[key, k]) for key, k in flat])
        spots = sorted({(m, c.present, c.present) for c in cases for m in program.markets})
        stats = df.agg(*[f(prices[s]).alias(f"{t}{n}") for n, s in enumerate(spots) for t, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        scaled = {s: (F.col(prices[s]) - stats[f"m{n}"]) / (stats[f"d{n}"] or 1.0) for n, s in enumerate(spots)}
        sums, at = [], {}
        for c in cases:
            x = products([scaled[m, c.present, c.present] for m in program.markets if stats[f"d{spots.index((m, c.present, c.present))}"]])
            ys = [named[(c.number, b), k] for b in bumps_of(program, setting, c.bumps) for k in range(len(c.expr.args))]
            at[c.number] = (len(sums), x, ys)
            sums += [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))] + [xi * F.col(y) for y in ys for xi in x]
        total = df.agg(*[F.sum(s).alias(f"s{n}") for n, s in enumerate(sums)]).first()
        chosen = []
        for c in cases:
            begin, x, ys = at[c.number]
            k = len(x)
            gram = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    gram[i, j] = gram[j, i] = total[begin]
                    begin += 1
            fits = solve(gram, np.array([[total[begin + n * k + i] or 0.0 for n in range(len(ys))] for i in range(k)]))
            fitted = {y: sum((F.lit(float(w)) * xi for w, xi in zip(fits[1:, n], x[1:], strict=True)), F.lit(float(fits[0, n]))) for n, y in enumerate(ys)}
            for j, b in enumerate(bumps_of(program, setting, c.bumps)):
                mine = ys[j * len(c.expr.args) : (j + 1) * len(c.expr.args)]
                out = F.col(mine[-1])
                for n in range(len(mine) - 2, -1, -1):  # the first of the best wins
                    ahead = fitted[mine[n]] >= fitted[mine[n + 1]]
                    for other in mine[n + 2 :]:
                        ahead = ahead & (fitted[mine[n]] >= fitted[other])
                    out = F.when(ahead, F.col(mine[n])).otherwise(out)
                held[c.number, b] = F.col(f"pv_c{c.number}_{j}")
                chosen.append(out.alias(f"pv_c{c.number}_{j}"))
        kept = [x for x in df.columns if not x.startswith("pv_a")]
        df = df.select(*kept, *chosen)
    ev = evaluator()
    bumps = bumps_of(program, setting, program.bumps[0])
    return df.select(*names, *[column(ev.node(0, b)).alias("v" if not b else f"v__{b}") for b in bumps])


def deltas(valued: DataFrame, prices: Mapping[PriceKey, str], program: Program, rate: float = 0.0, factor: float = 0.01, double_sided: bool = True) -> DataFrame:
    """A row a path and bumped period: delta, hedge and cash, as columns of the ``path_id`` of ``valued``."""
    from pathval.report import period_of

    rows = []
    for name in sorted(program.bumps[0]):
        market, day = period_of(name)
        depth = name.count("-")
        if day is None:
            price = F.col(prices[market, program.observation, program.observation])
        else:
            near = [k for k in prices if k[0] == market and k[1] == k[2] and (k[1].year, k[1].month, k[1].day)[:depth] == (day.year, day.month, day.day)[:depth]]
            price = sum((F.col(prices[k]) for k in near[1:]), F.col(prices[near[0]])) / F.lit(float(len(near)))
        up, down = F.col(f"`v__{name}`"), F.col(f"`v__-{name}`") if double_sided else F.col("v")
        df = 1.0 if day is None else discount_factor(program.observation, day, rate)
        delta = (up - down) / (F.lit((2 if double_sided else 1) * factor) * price)
        rows.append(F.struct(F.lit(market).alias("market_name"), F.lit(day).cast("date").alias("delivery_date"), F.lit(name).alias("perturbation_name"), delta.alias("delta"), (-delta / df).alias("hedge_units"), price.alias("price_simulated"), (price * df).alias("price_discounted"), (-delta * price).alias("hedge_cost"), (delta * price).alias("cash")))
    return valued.select("path_id", F.explode(F.array(*rows)).alias("r")).select("path_id", "r.*")
