"""The two contracts that throughput is measured on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from pathval.api import calc
from pathval.report import Results

# The published curves of both contracts, by day of delivery.
GAS_BY_MONTH = [
    ("2011-1-1", 13.5),
    ("2011-2-1", 11.0),
    ("2011-3-1", 10.0),
    ("2011-4-1", 9.0),
    ("2011-5-1", 7.5),
    ("2011-6-1", 7.0),
    ("2011-7-1", 6.5),
    ("2011-8-1", 7.5),
    ("2011-9-1", 8.5),
    ("2011-10-1", 10.0),
    ("2011-11-1", 11.5),
    ("2011-12-1", 12.0),
    ("2012-1-1", 13.5),
    ("2012-2-1", 11.0),
    ("2012-3-1", 10.0),
    ("2012-4-1", 9.0),
    ("2012-5-1", 7.5),
    ("2012-6-1", 7.0),
    ("2012-7-1", 6.5),
    ("2012-8-1", 7.5),
    ("2012-9-1", 8.5),
    ("2012-10-1", 10.0),
    ("2012-11-1", 11.5),
    ("2012-12-1", 12.0),
]
GAS_BY_DAY = [("2012-1-1", 11.0), ("2012-1-2", 11.0), ("2012-1-3", 1.0), ("2012-1-4", 1.0), ("2012-1-5", 11.0)]
POWER_BY_DAY = [("2012-1-1", 1.0), ("2012-1-2", 1.0), ("2012-1-3", 11.0), ("2012-1-4", 11.0), ("2012-1-5", 11.0)]


def gas_storage(spark: SparkSession, paths: int = 20_000, seed: int = 0) -> Results:
    """Storage over twelve months, one market, deltas by month."""
    source = """
from pathval.models.storage import GasStorage
GasStorage(Date('2011-4-1'), Date('2012-4-1'), 'GAS', 0, 50000, TimeDelta('1m'))
"""
    model = {"market": ["GAS"], "sigma": [0.3], "curve": {"GAS": GAS_BY_MONTH}}
    return calc(source, dt.date(2011, 1, 1), 2.5, paths, price_process=model, periodisation="monthly", spark=spark, seed=seed)


def power_plant(spark: SparkSession, paths: int = 20_000, seed: int = 0) -> Results:
    """Four days of a power plant that starts cold, two correlated markets, deltas by day."""
    source = """
from pathval.models.powerplant import PowerPlant
PowerPlant(Date('2012-1-1'), Date('2012-1-5'), 'POWER', 'GAS', 2, TimeDelta('1d'))
"""
    model = {"market": ["GAS", "POWER"], "sigma": [0.3, 0.3], "rho": [[1.0, 0.8], [0.8, 1.0]], "curve": {"GAS": GAS_BY_DAY, "POWER": POWER_BY_DAY}}
    return calc(source, dt.date(2011, 1, 1), 2.5, paths, price_process=model, periodisation="daily", spark=spark, seed=seed)
