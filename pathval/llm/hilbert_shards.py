"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut at approximate quantiles into 2^bits steps; the steps of a row are a
cell of a hypercube, and rows are sorted by the cell's place on the Hilbert curve.  Runs of
the sorted rows become shards, so that a shard's rows lie near each other in every dimension
and files can be skipped by the minima and maxima of any of them.  Rows of equal texts stand
together, at the place of the first of them.  Shards follow the law ``rows``: their numbers of
rows differ by one at most, so a group of equal texts is cut only where a shard ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathval.llm.common import looked_up, staged

#: Rows that one sorted partition holds, about.
ROWS_A_PARTITION = 500_000


def hilbert(steps: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``steps`` (integers under 2^bits, a column a dimension).

    Works from the highest bit down: the bits of a level name an orthant; its place in the
    level's Gray-code walk is emitted, and the walk is then entered anew, mirrored where the
    orthant asks for it and with the axes turned.
    """
    rows, dims = steps.shape
    entry = np.zeros(rows, np.int64)  # the corner where the walk of this level begins
    turn = np.zeros(rows, np.int64)  # the axis along which it leaves
    place = np.zeros(rows, np.int64)
    full = (1 << dims) - 1
    for level in range(bits - 1, -1, -1):
        orthant = np.zeros(rows, np.int64)
        for d in range(dims):
            orthant |= ((steps[:, d] >> level) & 1) << d
        by = (turn + 1) % dims
        mirrored = orthant ^ entry
        corner = ((mirrored >> by) | (mirrored << (dims - by))) & full
        rank = corner.copy()
        for shift in (1, 2, 4, 8, 16):
            rank ^= rank >> shift
        place = (place << dims) | rank
        before = np.where(rank > 0, 2 * ((rank - 1) // 2), 0)
        begin = before ^ (before >> 1)
        odd = np.where(rank == 0, 0, np.where(rank % 2 == 0, rank - 1, rank))
        ones, axis = odd.copy(), np.zeros(rows, np.int64)
        for _ in range(dims):
            more = (ones & 1) == 1
            axis += more
            ones = np.where(more, ones >> 1, 0)
        entry ^= ((begin << by) | (begin >> (dims - by))) & full
        turn = (turn + (axis % dims) + 1) % dims
    return place


def ordinal(col: str, kind: T.DataType) -> Column:
    """A number that orders as the column does: numbers as they are, of strings the first 7 bytes."""
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(col).cast("double")


def sharded(docs: DataFrame, dims: list[str], shards: int = 40, bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard``, ``slot``, ``size`` and ``text_crc32`` for each row's id.

    Rows are ordered by the least place on the curve that a row of their text has, then by the
    text's digests, then id.  A null in a dimension counts as its lowest step; null texts are
    equal, have size 16 and digest 0; a null id sorts first.  Repeated rows are rows like
    others, of very long texts only digests are kept.  Without rows the result is empty.  Any
    other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text_col, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text_col).alias("same"),
        *[ordinal(d, kinds[d]).alias(f"v{k}") for k, d in enumerate(dims)],
    )
    slim = staged(slim)
    fractions = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = slim.agg(F.count("*").alias("n"), *[F.percentile_approx(f"v{k}", fractions, 10_000).alias(f"c{k}") for k in range(len(dims))]).first()
    cuts = [np.unique(np.array(found[f"c{k}"] or [], float)) for k in range(len(dims))]
    n = found["n"]

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        steps = [np.where(np.isnan(v), 0, np.searchsorted(c, v, side="right")) for v, c in zip((x.to_numpy(float, na_value=np.nan) for x in values), cuts, strict=True)]
        return pd.Series(hilbert(np.stack(steps, axis=1).astype(np.int64), bits))

    keys = ["curve", "text_crc32", "same", "size", "doc_id"]
    parts = max(1, -(-n // ROWS_A_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 10_000 else 1)
    placed = staged(slim.select("doc_id", "size", "text_crc32", "same", curve(*[f"v{k}" for k in range(len(dims))]).alias("own")))
    groups = placed.groupBy("same").agg(F.min("own").alias("curve"), F.count("*").alias("pv_many"))
    ranked = looked_up(placed, groups, "same", F.xxhash64("doc_id", "own"), n).select(*keys)
    ranked = ranked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the partition and the row's place in it, fixed by writing them
    ranked = staged(ranked.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = {r[0]: r[1] for r in ranked.groupBy(part.alias("p")).count().collect()}  # a row a partition
    start, ahead = {}, 0
    for p in sorted(sizes):
        start[p], ahead = ahead, ahead + sizes[p]
    starts = spark.createDataFrame([(p, s) for p, s in start.items()], "p long, ahead long")
    small, more = divmod(n, shards)
    row = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    edge = more * (small + 1)
    over = F.floor((F.col("row") - edge) / max(small, 1))
    shard = F.when(F.col("row") < edge, F.floor(F.col("row") / (small + 1))).otherwise(more + over).cast("int")
    slot = F.when(F.col("row") < edge, F.col("row") % (small + 1)).otherwise((F.col("row") - edge) % max(small, 1))
    return (
        ranked.withColumn("p", part)
        .join(F.broadcast(starts), "p")
        .select("doc_id", "size", "text_crc32", row.alias("row"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
