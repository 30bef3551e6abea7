"""What a valuation says: value, deltas, hedges and cash, with errors and bounds, per period."""

from __future__ import annotations

import datetime as dt
import statistics
from collections.abc import Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathval.functions.dates import discount_factor
from pathval.operators.blocks import PATH
from pathval.plans.program import Program

#: Rows that a finished block gives: one with the value, and one a path and period.
SCHEMA = "path_id long, market_name string, delivery_date date, perturbation_name string, value double, delta double, hedge_units double, price_simulated double, price_discounted double, hedge_cost double, cash double"
SHARES = "perturbation_name string, market_name string, delivery_date date, n long, " + ", ".join(f"{m}_n long, {m}_mean double, {m}_off double" for m in ("value", "delta", "hedge_units", "price_simulated", "price_discounted", "hedge_cost", "cash"))
MEASURES = ["delta", "hedge_units", "price_simulated", "price_discounted", "hedge_cost", "cash"]
#: Percent of paths between the bounds of a measure, unless said otherwise.
CONFIDENCE = 95


def period_of(name: str) -> tuple[str, dt.date | None]:
    """Market and first day of a perturbation's period; no day for all time."""
    market, *parts = name.split("-")
    numbers = [int(x) for x in parts] + [1] * (3 - len(parts))
    return market, dt.date(*numbers) if parts else None


class Finish:
    """Makes a finished block's rows."""

    def __init__(self, program: Program, rate: float, factor: float, double_sided: bool):
        self.program, self.rate, self.factor, self.double_sided = program, rate, factor, double_sided
        self.periods = sorted(program.bumps[0], key=lambda n: (period_of(n)[1] or dt.date.min, period_of(n)[0]))

    def price(self, name: str, held: dict) -> Any:
        """The period's spot price: today's for all time, else the mean over its days at hand."""
        market, day = period_of(name)
        if day is None:
            return held[market, self.program.observation, self.program.observation]
        depth = name.count("-")
        near = [k for k in held if isinstance(k[0], str) and k[0] == market and k[1] == k[2] and (k[1].year, k[1].month, k[1].day)[:depth] == (day.year, day.month, day.day)[:depth]]
        return sum(held[k] for k in near) / len(near)

    def measures(self, held: dict, ev, size: int) -> Iterator[tuple[str | None, str | None, dt.date | None, dict[str, np.ndarray]]]:
        """The block's values, then the measures of each period: its name, market and day."""
        full = lambda x: np.broadcast_to(np.asarray(x, float), (size,))
        base = full(ev.node(0))
        yield None, None, None, {"value": base}
        for name in self.periods:
            market, day = period_of(name)
            price = self.price(name, held)
            up = full(ev.node(0, name))
            down = full(ev.node(0, "-" + name)) if self.double_sided else base
            with np.errstate(all="ignore"):
                delta = (up - down) / ((2 if self.double_sided else 1) * self.factor * price)
            df = 1.0 if day is None else discount_factor(self.program.observation, day, self.rate)
            units = -delta / df
            cost = units * price * df
            yield name, market, day, dict(zip(MEASURES, (delta, units, price, price * df, cost, -cost), strict=True))

    def __call__(self, held: dict, ev, first: int, size: int) -> pd.DataFrame:
        """A row a path and period."""
        ids = held[PATH].astype(np.int64) if PATH in held else np.arange(first, first + size)
        frames = [pd.DataFrame({"path_id": ids, "market_name": market, "delivery_date": day, "perturbation_name": name, **{m: found.get(m, np.full(size, np.nan)) for m in ["value", *MEASURES]}}) for name, market, day, found in self.measures(held, ev, size)]
        return pd.concat(frames, ignore_index=True)

    def shares(self, held: dict, ev, first: int, size: int) -> pd.DataFrame:
        """A row a period: of each measure the number that are no NaN, their mean, and their squares' distance from it."""
        rows = []
        for name, market, day, found in self.measures(held, ev, size):
            row = {"perturbation_name": name, "market_name": market, "delivery_date": day, "n": size}
            for m in ["value", *MEASURES]:
                x = found.get(m, np.empty(0))
                x = x[~np.isnan(x)]
                mean = float(x.mean()) if len(x) else 0.0
                row |= {f"{m}_n": len(x), f"{m}_mean": mean, f"{m}_off": float(((x - mean) ** 2).sum())}
            rows.append(row)
        return pd.DataFrame(rows)


class Results:
    """Result of a valuation.  ``paths`` has a row a path and period (see ``SCHEMA``), or is None for a plain value."""

    def __init__(self, fair_value: Any, paths: DataFrame | None, program: Program, double_sided: bool, timings: dict[str, float], shares: DataFrame | None = None, state: DataFrame | None = None):
        self.scalar, self.paths, self.program, self.double_sided, self.timings = fair_value, paths, program, double_sided, timings
        self._shares, self._state = shares, state

    def close(self) -> None:
        """Gives back what executors keep of the valuation; what was read stays, paths would be made anew."""
        if self._state is not None:
            self._state.unpersist()

    @cached_property
    def summary(self) -> pd.DataFrame:
        """Mean, standard error and number of paths of each measure by period; the value has no period.

        Blocks send a row a period, so no more than that is gathered however many paths there are.
        """
        if self.paths is None:
            return pd.DataFrame()
        by = ["perturbation_name", "market_name", "delivery_date"]
        shares = self._shares.persist()
        names = ["value", *MEASURES]
        sums = [F.sum("n").alias("n")] + [F.sum(f"{m}_n").alias(f"{m}_count") for m in names] + [(F.sum(F.col(f"{m}_n") * F.col(f"{m}_mean")) / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(m) for m in names]
        whole = shares.groupBy(*by).agg(*sums)
        off = shares.withColumnRenamed("n", "size").alias("s").join(F.broadcast(whole.alias("w")), F.expr("s.perturbation_name <=> w.perturbation_name"))
        spread = off.groupBy(F.col("s.perturbation_name").alias("perturbation_name")).agg(*[(F.sqrt(F.sum(F.col(f"{m}_off") + F.col(f"{m}_n") * (F.col(f"{m}_mean") - F.col(m)) ** 2)) / F.first(f"{m}_count")).alias(f"{m}_err") for m in names])
        found = {r["perturbation_name"]: r for r in spread.collect()}
        out = whole.toPandas()
        shares.unpersist()
        for m in names:
            out[f"{m}_err"] = [found[n][f"{m}_err"] if out[m].notna().iloc[k] else np.nan for k, n in enumerate(out["perturbation_name"].where(out["perturbation_name"].notna(), None))]
        return out[[*by, "n", *(c for m in names for c in (m, f"{m}_err"))]]

    @property
    def fair_value(self) -> Any:
        """The value itself if it is one number or date, else a frame (path_id, value)."""
        return self.scalar if self.paths is None else self.paths.where("perturbation_name is null").select("path_id", "value")

    @property
    def fair_value_mean(self) -> Any:
        return self.scalar if self.paths is None else float(self._value_row["value"])

    @property
    def fair_value_error(self) -> float:
        return 0.0 if self.paths is None else float(self._value_row["value_err"])

    @property
    def _value_row(self) -> pd.Series:
        return self.summary[self.summary["perturbation_name"].isna()].iloc[0]

    @property
    def periods(self) -> pd.DataFrame:
        """A row a period, by date and market."""
        s = self.summary
        return s[s["perturbation_name"].notna()].sort_values(["delivery_date", "market_name"], na_position="first").drop(columns=["value", "value_err"]).reset_index(drop=True) if len(s) else s

    @property
    def deltas(self) -> dict[str, float]:
        return dict(zip(self.periods["perturbation_name"], self.periods["delta"], strict=True)) if len(self.periods) else {}

    def _pivot(self, measure: str) -> pd.DataFrame:
        return self.periods.pivot_table(index="delivery_date", columns="market_name", values=measure, dropna=False)

    @property
    def prices_mean(self) -> pd.DataFrame:
        return self._pivot("price_simulated")

    @property
    def hedges_mean(self) -> pd.DataFrame:
        return self._pivot("hedge_units")

    def cash_paths(self) -> DataFrame:
        """Cash summed over markets and up to each date, a row a path and date."""
        daily = self.paths.where("delivery_date is not null").groupBy("path_id", "delivery_date").agg(F.sum("cash").alias("cash"))
        return daily.withColumn("cash", F.sum("cash").over(W.partitionBy("path_id").orderBy("delivery_date")))

    @property
    def cash_mean(self) -> pd.DataFrame:
        return self.cash_paths().groupBy("delivery_date").agg(F.avg("cash").alias("cash")).orderBy("delivery_date").toPandas()

    def bounds(self, measure: str, confidence: float = CONFIDENCE) -> pd.DataFrame:
        """Distances of a measure's percentiles from its mean, by period; NaN counts as absent."""
        x = F.nanvl(F.col(measure), F.lit(None).cast("double"))
        low, high = (100 - confidence) / 200, (100 + confidence) / 200
        by = self.paths.where("perturbation_name is not null").groupBy("market_name", "delivery_date")
        out = by.agg(F.avg(x).alias("mean"), F.percentile(x, low).alias("p"), F.percentile(x, high).alias("q"))
        return out.select("market_name", "delivery_date", "mean", (F.col("mean") - F.col("p")).alias("below"), (F.col("q") - F.col("mean")).alias("above")).orderBy("delivery_date", "market_name").toPandas()

    def deviations(self, measure: str) -> pd.DataFrame:
        """Population standard deviations of a measure by period."""
        return self.paths.where("perturbation_name is not null").groupBy("market_name", "delivery_date").agg(F.stddev_pop(measure).alias("std")).orderBy("delivery_date", "market_name").toPandas()

    @cached_property
    def net(self) -> tuple[dict[str, tuple[float, float]], tuple[float, float]]:
        """Units held by market, and cash overall, each with its standard error; sums are by path."""
        rows = self.paths.where("perturbation_name is not null")
        by_path = rows.groupBy("path_id", "market_name").agg(F.sum("hedge_units").alias("units"), F.sum("cash").alias("cash"))
        err = lambda c: F.stddev_pop(c) / F.sqrt(F.count(c))
        units = {r[0]: (r[1], r[2]) for r in by_path.groupBy("market_name").agg(F.avg("units"), err("units")).collect()}
        cash = by_path.groupBy("path_id").agg(F.sum("cash").alias("cash")).agg(F.avg("cash"), err("cash")).first()
        return units, (cash[0], cash[1])

    def plot_frame(self) -> pd.DataFrame:
        """Prices, hedges and cash by date and market: what three bar panels show."""
        if not len(self.periods):
            raise ValueError("no periods to plot")
        return self.periods[["delivery_date", "market_name", "price_simulated", "price_simulated_err", "hedge_units", "hedge_units_err", "cash", "cash_err"]]

    def plot(self, title: str = "", confidence: float = CONFIDENCE, block: bool = False, pause: float = 0, figsize: tuple[float, float] | None = None) -> Any:
        """Three panels of bars by date: market prices, hedges, cash so far; whiskers span ``confidence`` percent of a mean's error.

        Needs matplotlib, which the engine does not depend on otherwise.  Gives the figure.
        """
        rows = self.plot_frame()
        import matplotlib.pyplot as plt

        wide = statistics.NormalDist().inv_cdf(0.5 + confidence / 200)
        pivot = lambda c: rows.pivot_table(index="delivery_date", columns="market_name", values=c, dropna=False)
        cash = rows.groupby("delivery_date")["cash"].sum().cumsum()
        off = (rows["cash_err"] ** 2).groupby(rows["delivery_date"]).sum().cumsum() ** 0.5 * wide
        fig, (top, middle, bottom) = plt.subplots(3, 1, sharex=True, figsize=figsize)
        fig.suptitle(title or f"{self.program.observation}, bounds {confidence} %")
        pivot("price_simulated").plot(ax=top, kind="bar", yerr=pivot("price_simulated_err") * wide, title="Market prices")
        pivot("hedge_units").plot(ax=middle, kind="bar", yerr=pivot("hedge_units_err") * wide, title="Hedges")
        cash.plot(ax=bottom, kind="bar", yerr=off, title="Cash", color="g")
        for ax in (middle, bottom):
            ax.axhline(0, color="0.5")
        fig.autofmt_xdate(rotation=30)
        if pause and not block:
            plt.pause(pause)
        else:
            plt.show(block=block)
        return fig

    def __str__(self) -> str:
        lines = []
        for _, p in self.periods.iterrows():
            when = "all time" if pd.isna(p["delivery_date"]) else str(p["delivery_date"])
            lines += [f"{when} {p['market_name']}", f"  Price: {p['price_simulated']: .2f}", f"  Delta: {p['delta']: .2f}", f"  Hedge: {p['hedge_units']: .2f} +- {p['hedge_units_err']:.2f}", f"  Cash:  {p['cash']: .2f} +- {3 * p['cash_err']:.2f}", ""]
        if len(self.periods):
            units, cash = self.net
            if self.periods["delivery_date"].nunique() > 1:
                lines += [f"Net hedge {m}: {u: .2f} +- {3 * e:.2f}" for m, (u, e) in sorted(units.items())]
            lines += [f"Net hedge cash: {cash[0]: .2f} +- {3 * cash[1]:.2f}", ""]
        value = self.fair_value_mean
        lines.append(f"Fair value: {value: .2f} +- {3 * self.fair_value_error:.2f}" if isinstance(value, float) else f"Fair value: {value}")
        return "\n".join(lines)
