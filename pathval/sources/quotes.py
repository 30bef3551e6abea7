"""Quotes and scenarios from files, and results to files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.plans.program import PriceKey, Program

SCHEMA = "market string, date date, price double"


def read_quotes(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Quotes (market, date, price) from parquet, orc, json or csv with a header."""
    reader = spark.read.schema(SCHEMA)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def write_quotes(quotes: DataFrame, path: str, form: str = "parquet") -> None:
    writer = quotes.select("market", "date", "price").write
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def from_csv_text(spark: SparkSession, text: str) -> DataFrame:
    """Lines of date,price after a header, as (date, price)."""
    rows = [(x,) for x in text.strip().splitlines()[1:]]
    parsed = F.from_csv("line", "date date, price double")
    return spark.createDataFrame(rows, "line string").select(parsed.alias("q")).select("q.date", "q.price")


def to_csv_text(quotes: DataFrame) -> str:
    """The text that :func:`from_csv_text` reads; for series that fit on the driver."""
    return "date,price\n" + "".join(f"{r[0]},{r[1]!r}\n" for r in quotes.select("date", "price").orderBy("date").toLocalIterator())


def tall(paths: DataFrame, prices: dict[PriceKey, str]) -> DataFrame:
    """Simulated prices as rows: path, market, fixing date, delivery date, price."""
    cells = [F.struct(F.lit(m).alias("market"), F.lit(f).alias("fixing_date"), F.lit(d).alias("delivery_date"), F.col(c).alias("price")) for (m, f, d), c in prices.items()]
    return paths.select("path_id", F.explode(F.array(*cells)).alias("c")).select("path_id", "c.*")


def wide(rows: DataFrame, keys: list[PriceKey]) -> tuple[DataFrame, dict[PriceKey, str]]:
    """A scenario table of tall rows: a row a path, a column for each of ``keys``."""
    named = {k: f"p{n}" for n, k in enumerate(keys)}

    def is_key(m: str, f: dt.date, d: dt.date):
        return (F.col("market") == m) & (F.col("fixing_date") == F.lit(f)) & (F.col("delivery_date") == F.lit(d))

    return rows.groupBy("path_id").agg(*[F.max(F.when(is_key(*k), F.col("price"))).alias(c) for k, c in named.items()]), named


def graph_tables(spark: SparkSession, program: Program) -> dict[str, DataFrame]:
    """A program's nodes, edges, price requirements and perturbations as tables, to keep or query."""
    nodes = [(n, program.levels[n], program.nodes[n].present, program.costs()[n], repr(program.nodes[n].expr)) for n in program.order]
    edges = [(n, d) for n in program.order for d in program.nodes[n].needs]
    bumps = [(n, b) for n in program.order for b in sorted(program.bumps[n])]
    return {
        "graph_nodes": spark.createDataFrame(nodes, "node_id long, level int, present_time date, cost long, dsl_source string"),
        "graph_edges": spark.createDataFrame(edges, "node_id long, depends_on long"),
        "price_requirements": spark.createDataFrame(sorted(program.prices), "market string, fixing_date date, delivery_date date"),
        "perturbation_requirements": spark.createDataFrame(bumps, "node_id long, perturbation string"),
    }
