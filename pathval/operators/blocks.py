"""Valuation of large path sets: rows are blocks of paths, a job for each level of choices.

A block holds what later levels still read, as one binary matrix: prices, choices made, and
the alternatives of the level in hand.  A level's job adds its share of the normal equations;
shares are summed on the executors before the driver solves them, and the next job chooses and
goes on.  Paths that fit in one block need one task only.  Blocks are functions of their number and the seed, or rows of a scenario table, so
lost ones are made again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.operators.evaluate import Arrays, Evaluator
from pathval.operators.regression import basis, solve
from pathval.plans.program import PriceKey, Program
from pathval.sources.gbm import CHUNK
from pathval.watch import Watch

STATE = "block long, size int, data binary"
#: Stands among a block's prices for the numbers of its paths, where these are not a run of numbers.
PATH: PriceKey = ("", dt.date.min, dt.date.min)
#: Levels after which the lineage is cut, where a checkpoint folder is set.
CUT = 16


@dataclass
class Setting:
    """What a valuation is told besides its contract."""

    rate: float
    factor: float
    double_sided: bool
    custom: dict[str, Callable] = field(default_factory=dict)


def bumps_of(program: Program, setting: Setting, names: frozenset[str]) -> list[str]:
    """The plain run and the bumped ones, in a fixed order."""
    out = [""]
    for name in sorted(names):
        out += [name, "-" + name] if setting.double_sided else [name]
    return out


def packed(found: dict, keys: list) -> bytes:
    return np.stack([found[k] for k in keys]).tobytes() if keys else b""


def unpacked(data: bytes, size: int, keys: list) -> dict:
    rows = np.frombuffer(data, np.float64).reshape(len(keys), size) if keys else []
    return dict(zip(keys, rows, strict=True))


def scenario_blocks(scenarios: DataFrame, prices: Mapping[PriceKey, str], path_id: str = "path_id") -> tuple[DataFrame, list[PriceKey]]:
    """A scenario table (a row a path, a column a price) as blocks, and the order of their rows."""
    keys = [PATH, *sorted(prices)]
    columns = [path_id, *(prices[k] for k in keys[1:])]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        for rows in batches:
            for k in range(0, len(rows), 8 * CHUNK):
                part = rows.iloc[k : k + 8 * CHUNK].to_numpy(np.float64)
                yield pd.DataFrame({"block": [number], "size": [len(part)], "data": [np.ascontiguousarray(part.T).tobytes()]})
                number += 1

    return scenarios.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInPandas(pack, STATE), keys


class BlockRunner:
    """Values a program; ``chunk(number, size)`` makes the prices of a chunk of paths, or ``blocks`` has them by ``keys``."""

    def __init__(self, spark: SparkSession, program: Program, setting: Setting, chunk: Callable[[int, int], dict] | None, paths: int, blocks: DataFrame | None = None, keys: list[PriceKey] = ()):
        self.spark, self.program, self.setting, self.chunk, self.paths = spark, program, setting, chunk, paths
        self.given, self.given_keys = blocks, list(keys)
        chunks = -(-paths // CHUNK)
        self.parts = max(1, min(chunks, max(spark.sparkContext.defaultParallelism, chunks // 16)))
        self.chunks_a_block = max(1, min(8, -(-chunks // self.parts)))
        self.blocks = -(-chunks // self.chunks_a_block)
        self.depth = max((c.level for c in program.choices), default=0)
        self.jobs, self.state = 0, None

    def levels(self, number: int) -> list:
        return [c for c in self.program.choices if c.level == number]

    def wanted(self, level: int) -> list:
        """Prices and choices made that are read at ``level`` or later, or by the report."""
        later = [c for c in self.program.choices if c.level >= level]
        prices = set(self.report_prices()) | {k for k in self.given_keys if k == PATH}.union(*(c.prices for c in later))
        reads = set(self.program.final_reads).union(*(c.reads for c in later))
        chosen = [(n, b) for n in sorted(reads) if self.program.choices[n].level < level for b in bumps_of(self.program, self.setting, self.program.choices[n].bumps)]
        return sorted(prices) + chosen

    def report_prices(self) -> set:
        p = self.program
        out = set(p.final_prices)
        if p.periodisation:
            out |= {k for k in p.prices if k[1] == k[2]}
        return out

    def _targets(self, level: int) -> list:
        return [(c.number, b, k) for c in self.levels(level) for b in bumps_of(self.program, self.setting, c.bumps) for k in range(len(c.expr.args))]

    def _evaluator(self, held: dict) -> Evaluator:
        s = self.setting
        return Evaluator(self.program, Arrays, lambda key: held[key], lambda n, b: held[n, b], s.rate, s.factor, s.custom)

    def _regressors(self, c, held: dict, size: int) -> np.ndarray:
        return basis([held[m, c.present, c.present] / self.means[m, c.present] - 1.0 for m in self.program.markets], size)

    def _alternatives(self, level: int, held: dict, size: int) -> tuple[dict, bytes]:
        """The level's alternatives on every path, and their share of the normal equations."""
        ev = self._evaluator(held)
        out = {}
        sums = []
        for c in self.levels(level):
            x = self._regressors(c, held, size)
            y = []
            for b in bumps_of(self.program, self.setting, c.bumps):
                for k, e in enumerate(c.expr.args):
                    v = np.broadcast_to(np.asarray(ev.value(e, c.present, b), float), (size,))
                    out[c.number, b, k] = v
                    y.append(v)
            sums += [(x.T @ x).ravel(), (x.T @ np.stack(y, axis=1)).ravel()]
        return out, np.concatenate(sums).tobytes()

    def _choose(self, level: int, held: dict, size: int, fits: dict) -> dict:
        made = {}
        for c in self.levels(level):
            x = self._regressors(c, held, size)
            for b in bumps_of(self.program, self.setting, c.bumps):
                ys = np.stack([held[c.number, b, k] for k in range(len(c.expr.args))])
                best = np.argmax((x @ fits[c.number, b]).T, axis=0)
                made[c.number, b] = ys[best, np.arange(size)]
        return made

    def run(self, finishes: list[tuple[Callable[[dict, Evaluator, int, int], pd.DataFrame], str]], means: dict, watch: Watch | None = None) -> list[DataFrame]:
        """For each of ``finishes`` the rows that it makes of (held, evaluator, first path, size) of each finished block, by its schema."""
        self.means = means
        spark = self.spark
        state, keys, fits = None, [], {}
        runner = self._remote()

        def start(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, dict]]:
            for rows in batches:
                if runner.given_keys:
                    yield from ((int(b), int(n), unpacked(d, n, runner.given_keys)) for b, n, d in zip(rows["block"], rows["size"], rows["data"], strict=True))
                    continue
                for block in rows["id"]:
                    yield int(block), *runner.prices(int(block))

        alone = self.given is None and self.blocks == 1

        def only(batches: Iterator[pd.DataFrame], finish: Callable) -> Iterator[pd.DataFrame]:
            for block, size, held in start(batches):
                held = runner._alone(held, size)
                yield finish(held, runner._evaluator(held), 0, size)

        if alone:  # one task does all of it: no job a level
            one = spark.range(0, 1, 1, 1)
            return [one.mapInPandas(lambda batches, finish=finish: only(batches, finish), schema) for finish, schema in finishes]
        source = self.given if self.given is not None else spark.range(0, self.blocks, 1, min(self.parts, self.blocks))
        for level in range(1, self.depth + 1):
            state, keys, fits = self._step(runner, source if state is None else state, start if level == 1 else None, level, keys, fits)
            if watch is not None:
                work = [len(self._targets(k)) for k in range(1, self.depth + 1)]
                watch.step(sum(work[:level]), sum(work) + len(bumps_of(self.program, self.setting, self.program.bumps[0])))
        last = runner

        def end(batches: Iterator[pd.DataFrame], finish: Callable, keys=tuple(keys), fits=fits, depth=self.depth) -> Iterator[pd.DataFrame]:
            blocks = start(batches) if not depth else ((int(b), int(n), unpacked(d, n, list(keys))) for rows in batches for b, n, d in zip(rows["block"], rows["size"], rows["data"], strict=True))
            for block, size, held in blocks:
                if depth:
                    held |= last._choose(depth, held, size, fits)
                yield finish(held, last._evaluator(held), block * last.chunks_a_block * CHUNK, size)

        self.state = state
        left = source if state is None else state.select("block", "size", "data")
        return [left.mapInPandas(lambda batches, finish=finish: end(batches, finish), schema) for finish, schema in finishes]

    def _step(self, runner: BlockRunner, before: DataFrame, start: Callable | None, level: int, keys: list, fits: dict) -> tuple:
        keep = runner.wanted(level)
        out_keys = keep + runner._targets(level)

        def step(batches: Iterator[pd.DataFrame], keys=tuple(keys), fits=fits) -> Iterator[pd.DataFrame]:
            blocks = start(batches) if start else ((int(b), int(n), unpacked(d, n, list(keys))) for rows in batches for b, n, d in zip(rows["block"], rows["size"], rows["data"], strict=True))
            for block, size, held in blocks:
                if level > 1:
                    held |= runner._choose(level - 1, held, size, fits)
                found, sums = runner._alternatives(level, held, size)
                held |= found
                yield pd.DataFrame({"block": [block], "size": [size], "data": [packed(held, out_keys)], "sums": [sums]})

        state = before.mapInPandas(step, STATE + ", sums binary").persist()
        if level % CUT == 0 and (folder := self.spark.conf.get("spark.checkpoint.dir", None)):
            if not self.spark.sparkContext.getCheckpointDir():
                self.spark.sparkContext.setCheckpointDir(folder)
            state = state.checkpoint()
        total = self._summed(state)
        self.jobs += 1
        fits = self._fitted(level, total)
        if level > 1:
            before.unpersist()
        return state, out_keys, fits

    def _fitted(self, level: int, total: np.ndarray) -> dict:
        """Coefficients of a level's alternatives, from the sums over all blocks."""
        fits, at, k = {}, 0, 1 + 2 * len(self.program.markets) + len(self.program.markets) * (len(self.program.markets) - 1) // 2
        for c in self.levels(level):
            bumps, n = bumps_of(self.program, self.setting, c.bumps), len(c.expr.args)
            gram = total[at : at + k * k].reshape(k, k)
            at += k * k
            moments = total[at : at + k * n * len(bumps)].reshape(k, n * len(bumps))
            at += moments.size
            solved = solve(gram, moments)
            for j, b in enumerate(bumps):
                fits[c.number, b] = solved[:, j * n : (j + 1) * n]
        return fits

    def _alone(self, held: dict, size: int) -> dict:
        """All levels of a block that is the only one: its sums are those of all paths."""
        for level in range(1, self.depth + 1):
            found, sums = self._alternatives(level, held, size)
            made = self._choose(level, held | found, size, self._fitted(level, np.frombuffer(sums)))
            held |= made
            held = {k: held[k] for k in self.wanted(level + 1)}
        return held

    def _summed(self, state: DataFrame) -> np.ndarray:
        """The blocks' shares added up, on the executors while there are many."""

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum([np.frombuffer(s, np.float64) for s in rows["sums"]], axis=0).tobytes()]})

        shares = state.select("block", "sums")
        if self.blocks > 256 or self.given is not None:
            shares = shares.groupBy(F.pmod("block", F.lit(64))).applyInPandas(lambda rows: add(rows), "sums binary")
        return np.sum([np.frombuffer(r["sums"], np.float64) for r in shares.select("sums").collect()], axis=0)

    def prices(self, block: int) -> tuple[int, dict]:
        first = block * self.chunks_a_block
        parts = []
        for k in range(first, min(first + self.chunks_a_block, -(-self.paths // CHUNK))):
            parts.append(self.chunk(k, min(CHUNK, self.paths - k * CHUNK)))
        held = {key: np.concatenate([p[key] for p in parts]) for key in parts[0]} if parts and parts[0] else {}
        return min(self.chunks_a_block * CHUNK, self.paths - first * CHUNK), held

    def _remote(self) -> BlockRunner:
        """This runner without its session, to be sent to executors."""
        other = object.__new__(BlockRunner)
        other.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("spark", "given", "state")}
        return other
