"""Entry points: ``calc`` for a whole valuation, ``Engine`` for its steps."""

from __future__ import annotations

import datetime as dt
import importlib
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.errors import DslError, InterruptSignalReceived
from pathval.functions.dates import as_date
from pathval.operators.blocks import BlockRunner, Setting, scenario_blocks
from pathval.operators.evaluate import Arrays, Evaluator
from pathval.plans.parse import Parser
from pathval.plans.program import PriceKey, Program, build, required_prices
from pathval.plans.unfold import Node, Unfolder
from pathval.report import SCHEMA, SHARES, Finish, Results
from pathval.sources.gbm import BlackScholes, Market
from pathval.watch import Watch

PATHS, FACTOR, LIMIT = 20_000, 0.01, 10_000
BLACK_SCHOLES = "black-scholes"


@dataclass(frozen=True)
class Element:
    """An element of one's own: its least and greatest number of arguments and what it does to values."""

    least: int
    most: int | None
    apply: Callable
    stochastic: bool = True


@dataclass
class Contract:
    source: str
    observation: dt.date | None
    nodes: list[Node]
    custom: dict[str, Element]

    def program(self, periodisation: str | None = None) -> Program:
        return build(self.nodes, self.observation, periodisation)

    @property
    def call_count(self) -> int:
        return len(self.nodes)


#: Price processes by name: classes with the fields and methods of BlackScholes.
PROCESSES: dict[str, type] = {BLACK_SCHOLES: BlackScholes}


def process_class(name: str) -> type:
    """A registered price process, or the class of a dotted name."""
    if name in PROCESSES:
        return PROCESSES[name]
    module, _, cls = name.rpartition(".")
    try:
        found = getattr(importlib.import_module(module), cls)
    except (ImportError, AttributeError, ValueError):
        raise DslError("no such price process", name) from None
    if not callable(getattr(found, "chunk", None)):
        raise DslError("a price process makes chunks of paths", name)
    return found


class Engine:
    """Compiles, simulates and evaluates contracts on a Spark session."""

    def __init__(self, spark: SparkSession | None = None, elements: Mapping[str, Element] | None = None, limit: int = LIMIT):
        self._spark, self.elements, self.limit = spark, dict(elements or {}), limit

    @property
    def spark(self) -> SparkSession:
        self._spark = self._spark or SparkSession.builder.getOrCreate()
        return self._spark

    def compile(self, source: str, observation_date: object = None) -> Contract:
        day = None if observation_date is None else as_date(observation_date)
        module = Parser({n: (e.least, e.most) for n, e in self.elements.items()}).parse(source)
        random = frozenset(n for n, e in self.elements.items() if e.stochastic)
        return Contract(source, day, Unfolder(module, day, self.limit, random).nodes(), self.elements)

    def evaluate(self, contract: Contract, price_process: Mapping | None = None, *, interest_rate: float = 0.0, path_count: int = PATHS, perturbation_factor: float = FACTOR, periodisation: str | None = None, is_double_sided_deltas: bool = True, seed: int = 0, scenarios: tuple[DataFrame, Mapping[PriceKey, str]] | None = None, watch: Watch | None = None) -> Results:
        """The contract's value, lazily: jobs run for the choices, the rest when results are read.

        ``scenarios``, a table with a ``path_id`` and a column for each price, stands in for a price process.
        """
        began = time.time()
        program = contract.program(periodisation)
        setting = Setting(float(interest_rate), perturbation_factor, is_double_sided_deltas, {n: e.apply for n, e in contract.custom.items()})
        if not program.markets:
            ev = Evaluator(program, Arrays, _no_price, _no_price, setting.rate, setting.factor, setting.custom)
            for n in program.order:
                ev.node(n)
            return Results(ev.node(0), None, program, is_double_sided_deltas, {"evaluate": time.time() - began})
        if watch is not None:
            watch.start()
        finish = Finish(program, setting.rate, setting.factor, is_double_sided_deltas)
        spots = {(m, c.present, c.present) for c in program.choices for m in program.markets}
        if scenarios is not None:
            table, prices = scenarios
            if missing := sorted(program.prices - set(prices)):
                raise DslError("scenarios lack a price", repr(missing[0]))
            found = table.agg(*[F.avg(f"`{prices[s]}`") for s in sorted(spots)]).first() if spots else ()
            means = {(m, day): mean or 1.0 for (m, day, _), mean in zip(sorted(spots), found, strict=True)}
            runner = BlockRunner(self.spark, program, setting, None, 0, *scenario_blocks(table, {k: prices[k] for k in program.prices}))
        else:
            params = dict(price_process or {})
            cls = process_class(params.pop("name", BLACK_SCHOLES))
            process = cls(Market.from_params(params), program.observation, required_prices(program), seed)
            means = {(m, day): process.scale((m, day, day))[0] or 1.0 for m, day, _ in spots}
            runner = BlockRunner(self.spark, program, setting, process.chunk, path_count)
        paths, shares = runner.run([(finish, SCHEMA), (finish.shares, SHARES)], means, watch)
        return Results(None, paths, program, is_double_sided_deltas, {"levels": time.time() - began}, shares, runner.state)


def _no_price(*key: object) -> Any:
    raise DslError("no price is simulated", repr(key))


def calc(source_code: str, observation_date: object = None, interest_rate: float = 0.0, path_count: int = PATHS, perturbation_factor: float = FACTOR, price_process: Mapping | None = None, periodisation: str | None = None, dsl_classes: Mapping[str, Element] | None = None, max_dependency_graph_size: int = LIMIT, timeout: float | None = None, is_double_sided_deltas: bool = True, verbose: bool = False, spark: SparkSession | None = None, seed: int = 0) -> Results:
    """Value a contract.

    ``timeout`` in seconds, SIGINT and SIGTERM stop its jobs and exit; it exits early when the time
    left goes beyond the timeout.  ``verbose`` prints progress.  ``seed`` fixes the paths.
    """
    engine = Engine(spark, dsl_classes, max_dependency_graph_size)
    try:
        with Watch(lambda: engine.spark, timeout, verbose) as watch:
            began = time.time()
            contract = engine.compile(source_code, observation_date)
            compiled = time.time()
            if verbose:
                print(f"{contract.call_count} nodes, compiled in {compiled - began:.3f} s", flush=True)
            results = engine.evaluate(contract, price_process, interest_rate=interest_rate, path_count=path_count, perturbation_factor=perturbation_factor, periodisation=periodisation, is_double_sided_deltas=is_double_sided_deltas, seed=seed, watch=watch)
            results.summary  # noqa: B018  runs the last job while it is watched
            if results.paths is not None:
                whole = results.program.evaluations(is_double_sided_deltas)
                watch.step(whole, whole)
    except (TimeoutError, InterruptSignalReceived) as e:
        print(e, flush=True)
        raise SystemExit(1) from None
    results.timings |= {"compile": compiled - began, "evaluate": time.time() - compiled}
    if verbose:
        n = results.program.evaluations(is_double_sided_deltas)
        print(f"{n} evaluations in {results.timings['evaluate']:.3f} s", flush=True)
    return results
