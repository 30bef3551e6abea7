"""What several text operators share: folders for intermediate tables, words, counts."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.folders import remove, shared_folder

#: ASCII white space, the only characters that part words: space and \t \n \v \f \r.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

#: So many rows one task takes whatever their keys are.
FEW = 10_000


def looked_up(rows: DataFrame, found: DataFrame, key: str, spread: Column, total: int | None = None, hot: int = 1000) -> DataFrame:
    """``rows`` (staged) joined with ``found``, which has one row for each ``key`` and in ``pv_many`` about how many rows have it.

    A key with over one in ``hot`` of all rows is dealt to several tasks by ``spread``, its row
    of ``found`` to each of them.  There are fewer than ``hot`` such keys, so their list is sent
    to every executor.  Rows whose key is not found drop out.  ``total`` is the number of rows, if
    known; up to ``FEW`` need no such care.
    """
    total = rows.count() if total is None else total
    if total <= FEW:
        return rows.join(found, key)
    most = max(100, total // hot)
    pieces = F.ceil(F.col("pv_many") / most).cast("int")
    large = found.where(F.col("pv_many") > most).select(key, pieces.alias("pv_pieces"))
    piece = F.when(F.col("pv_pieces").isNull(), 0).otherwise(F.pmod(spread, F.col("pv_pieces")).cast("int"))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("pv_piece", piece).drop("pv_pieces")
    shares = F.when(F.col("pv_many") > most, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(found.withColumn("pv_piece", F.explode(shares)), [key, "pv_piece"]).drop("pv_piece")


#: Folders of intermediate tables that this process has written and not removed.
made: list[str] = []


def staged(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    made.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession, since: int = 0) -> None:
    """Removes intermediate tables, those before place ``since`` of ``made`` excepted.

    To be called when what was made of them is written; nothing that reads them may be used then.
    """
    while len(made) > since:
        remove(spark, made.pop())


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns]).alias("pv_row")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written in decimal, modulo ``parts``; a null id gives null."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def raw(text: pa.Scalar) -> bytes:
    """The UTF-8 bytes of a string in an Arrow array; null is empty."""
    found = text.as_buffer()
    return found.to_pybytes() if found is not None else b""


def give_back() -> None:
    """Memory that this worker no longer needs goes back to the machine, not only to its own pools."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(text: str | None) -> bytes:
    """The text's bytes; null is empty, lone surrogates pass through."""
    return (text or "").encode("utf-8", "surrogatepass")
