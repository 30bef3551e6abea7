"""Correlated geometric Brownian motion, as blocks of paths or as columns."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathval.errors import DslError
from pathval.functions.dates import year_fraction
from pathval.plans.program import PriceKey
from pathval.sources.curve import ForwardCurve

#: Paths that are drawn together; what a path draws depends on its chunk and the seed alone.
CHUNK = 1000


@dataclass
class Market:
    """What a price process knows: volatilities, correlations and curves of named markets."""

    names: list[str]
    sigma: dict[str, float]
    curves: dict[str, ForwardCurve]
    corr: np.ndarray

    @classmethod
    def from_params(cls, params: Mapping) -> Market:
        """From ``market``, ``sigma``, ``rho`` (needed for two markets or more) and ``curve``; others are ignored."""
        try:
            names = list(params["market"])
            sigma = dict(zip(names, map(float, params["sigma"]), strict=True))
            curves = {m: ForwardCurve(m, params["curve"][m]) for m in names}
        except (KeyError, ValueError) as e:
            raise DslError("calibration params lack or mismatch", str(e)) from None
        corr = np.eye(len(names))
        if len(names) > 1:
            rho = params.get("rho")
            if rho is None or np.shape(rho) != (len(names), len(names)):
                raise DslError("calibration params need a correlation for each pair of markets", "rho")
            corr = np.array(rho, float)
        return cls(names, sigma, curves, corr)

    def mixing(self, names: list[str]) -> np.ndarray:
        """Lower factor of the correlation of ``names``: its product with independent draws correlates them."""
        missing = [m for m in names if m not in self.sigma]
        if missing:
            raise DslError("market is not calibrated", ", ".join(missing))
        at = [self.names.index(m) for m in names]
        try:
            return np.linalg.cholesky(self.corr[np.ix_(at, at)])
        except np.linalg.LinAlgError:
            raise DslError("correlation matrix is not positive definite", str(self.corr.tolist())) from None


@dataclass
class BlackScholes:
    """Prices F(delivery) * exp(sigma * W(fixing) - sigma^2 / 2 * T(fixing)) at the keys required."""

    market: Market
    observation: dt.date
    keys: list[PriceKey]
    seed: int = 0
    names: list[str] = field(init=False)
    days: list[dt.date] = field(init=False)

    def __post_init__(self) -> None:
        self.names = sorted({k[0] for k in self.keys})
        self.days = sorted({k[1] for k in self.keys} | {self.observation})
        if self.days[0] < self.observation:
            raise DslError("a price is fixed before the observation date", self.days[0].isoformat())
        self.mix = self.market.mixing(self.names)
        self.steps = [math.sqrt(year_fraction(a, b)) for a, b in zip(self.days, self.days[1:], strict=False)]

    def scale(self, key: PriceKey) -> tuple[float, float]:
        """A price's forward and the exponent's drift."""
        market, fixing, delivery = key
        return self.market.curves[market].price(delivery), -0.5 * self.market.sigma[market] ** 2 * year_fraction(self.observation, fixing)

    def chunk(self, number: int, size: int) -> dict[PriceKey, np.ndarray]:
        """Prices of the first ``size`` paths of a chunk."""
        rng = np.random.Generator(np.random.Philox(key=np.array([self.seed, number], np.uint64)))
        z = rng.standard_normal((len(self.steps), len(self.names), CHUNK))
        w = np.zeros((len(self.days), len(self.names), CHUNK))
        np.cumsum(np.einsum("ij,tjp->tip", self.mix, z) * np.array(self.steps)[:, None, None], axis=0, out=w[1:])
        day, name = {d: k for k, d in enumerate(self.days)}, {m: k for k, m in enumerate(self.names)}
        out = {}
        for key in self.keys:
            forward, drift = self.scale(key)
            out[key] = (forward * np.exp(self.market.sigma[key[0]] * w[day[key[1]], name[key[0]]] + drift))[:size]
        return out

    def columns(self, paths: DataFrame, path_id: Column | None = None, draws: Mapping[tuple[int, int], Column] | None = None) -> tuple[DataFrame, dict[PriceKey, str]]:
        """``paths`` with a column for each key, and their names.

        Draws are counter-based hashes of ``path_id`` and the seed, equal however the rows are
        dealt out, or columns given for (step, market).
        """
        if draws is None:
            draws = {(t, m): normal_draw(path_id if path_id is not None else F.col("path_id"), self.seed, t * len(self.names) + m) for t in range(len(self.steps)) for m in range(len(self.names))}
        before = list(paths.columns)
        df = paths.select("*", *[c.alias(f"pv_z{t}_{m}") for (t, m), c in draws.items()])
        for t, step in enumerate(self.steps):
            new = {}
            for k in range(len(self.names)):
                mixed = F.lit(0.0)
                for j in range(k + 1):
                    if self.mix[k, j]:
                        mixed = mixed + F.lit(float(self.mix[k, j])) * F.col(f"pv_z{t}_{j}")
                last = F.col(f"pv_w{t}_{k}") if t else F.lit(0.0)
                new[f"pv_w{t + 1}_{k}"] = last + F.lit(step) * mixed
            df = df.withColumns(new)
        named = {key: f"p{n}" for n, key in enumerate(self.keys)}
        day = {d: k for k, d in enumerate(self.days)}
        prices = []
        for key, name in named.items():
            forward, drift = self.scale(key)
            t, k = day[key[1]], self.names.index(key[0])
            w = F.col(f"pv_w{t}_{k}") if t else F.lit(0.0)
            prices.append((F.lit(forward) * F.exp(F.lit(self.market.sigma[key[0]]) * w + F.lit(drift))).alias(name))
        return df.select(*before, *prices), named


def normal_draw(path_id: Column, seed: int, stream: int) -> Column:
    """A standard normal number for each path, from two hashed uniform ones."""

    def uniform(salt: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(path_id, F.lit(seed), F.lit(stream), F.lit(salt)), 11)
        return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))

    return F.sqrt(-2.0 * F.log(uniform(0))) * F.cos(F.lit(2 * math.pi) * uniform(1))

