"""Line dedup by content-defined chunks of lines, in DataFrame functions alone.

Each line with a word is hashed.  A rolling hash over the hashes of each line and the next one
(one rotates, the other is mixed in) decides where the text is cut: two lines hold together
if their rolled hash stands at another place of the corpus too, elsewhere there is a boundary.
So boundaries hang on the lines alone; lines put in or taken out shift none.  What holds
together is the chunk of two lines, of which a longer repeated passage is a chain; a single
line of ``LONG`` words or more is a chunk by itself.

Chunks that are met again by hash are compared as bytes and removed wherever they stand but
first.  The first place of every line stays, so no line is lost to the corpus: a line goes
only as part of a chunk that stands earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathval.llm.common import looked_up, staged, whole_row

#: Words that make a single line a chunk.
LONG = 50
BLANK = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def told(text: Column) -> Column:
    """The text's lines with a word: number ``k``, hash ``h``, code points ``n``."""
    each = F.transform(lines_of(text), lambda x, k: F.struct(k.alias("k"), F.when(F.btrim(x, F.lit(BLANK)) != "", F.xxhash64(x)).alias("h"), F.length(x).alias("n")))
    return F.filter(each, lambda x: x.h.isNotNull())


def chunks(lines: Column) -> Column:
    """Of what :func:`told` gives: chunks from line ``pos`` to ``end`` and their rolled hashes ``r``."""
    ahead = F.slice(lines, F.lit(2), F.size(lines))
    behind = F.slice(lines, F.lit(1), F.size(ahead))
    rolled = lambda a, b: F.shiftleft(a.h, 1).bitwiseOR(F.shiftrightunsigned(a.h, 63)).bitwiseXOR(b.h)
    pairs = F.zip_with(behind, ahead, lambda a, b: F.struct(a.k.alias("pos"), b.k.alias("end"), rolled(a, b).alias("r")))
    alone = F.filter(lines, lambda x: x.n >= 2 * LONG - 1)  # fewer code points are fewer words
    return F.concat(pairs, F.transform(alone, lambda x: F.struct(x.k.alias("pos"), x.k.alias("end"), F.bitwise_not(x.h).alias("r"))))


def written(text: Column, pos: Column, end: Column) -> Column:
    """A chunk's lines with a word."""
    lines = lines_of(text)
    return F.when(pos == end, lines[pos]).otherwise(F.concat(lines[pos], F.lit("\n"), lines[end]))


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("pv_doc"), F.xxhash64(text_col).alias("pv_key")]


def repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Places of all chunks but their first ones: ``pv_doc``, ``pv_key``, ``pos``, ``end``.

    Places go by hash alone; texts are fetched once, for documents with a chunk met again.
    """
    texts = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("pv_text"))
    places = texts.select("pv_doc", "pv_key", told(F.col("pv_text")).alias("pv_told")).select("pv_doc", "pv_key", F.inline(chunks(F.col("pv_told"))))
    places = staged(places)
    met = places.groupBy("r").agg(F.count("*").alias("pv_many")).where("pv_many > 1")
    places = staged(looked_up(places, met, "r", F.xxhash64("pv_doc", "pos")).select(*places.columns))
    spot = F.struct("pv_doc", "pos", "pv_key")
    marks = places.groupBy("pv_doc", "pv_key").agg(F.collect_set(F.struct("pos", "end", "r")).alias("pv_marks"))
    found = texts.join(marks, ["pv_doc", "pv_key"]).select("pv_doc", "pv_key", "pv_text", F.inline("pv_marks"))
    found = found.withColumn("pv_bytes", written(F.col("pv_text"), F.col("pos"), F.col("end")))
    found = found.where((F.col("pos") < F.col("end")) | (F.regexp_count("pv_bytes", F.lit(WORD)) >= LONG))
    # equal bytes throughout: the least are the greatest; a hash of different chunks removes none
    first = found.groupBy("r").agg(F.min(spot).alias("pv_first"), F.min("pv_bytes").alias("low"), F.max("pv_bytes").alias("high"), F.count("*").alias("pv_many"))
    first = staged(first.where("low = high").select("r", "pv_first", "pv_many"))
    again = looked_up(places, first, "r", F.xxhash64("pv_doc", "pos"))
    return again.where(spot != F.col("pv_first")).select("pv_doc", "pv_key", "pos", "end")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of its texts, and their lines' numbers in ``removed_col`` if named.

    The first place is that of the least id, then the earliest in the text; a null id comes
    first.  Lines without a word are no part of a chunk, but those between two lines of a
    removed one go with it.  Null and empty texts have no chunks and stay; a text that has no word
    left when lines were taken out keeps its row, unless ``drop_emptied``.  Rows equal in id and text count as one and change
    alike.  All other columns stay as they are, whatever their names; no rows give no rows.
    Very long texts are read by line and hash as all others are.
    """
    drop = repeated(docs, id_col, text_col).groupBy("pv_doc", "pv_key").agg(F.collect_set(F.struct("pos", "end")).alias("pv_drop"))
    # the row stands in a struct, so that none of its columns meets a name used here
    keyed = docs.select(whole_row(docs), *_keys(id_col, text_col))
    joined = keyed.join(drop, ["pv_doc", "pv_key"], "left").select("pv_row", F.array_distinct(F.flatten(F.transform("pv_drop", lambda c: F.sequence(c.pos, c.end)))).alias("pv_gone"))
    text = F.col("pv_row")[text_col]
    joined = joined.select("pv_row", "pv_gone", F.when(F.col("pv_gone").isNotNull(), lines_of(text)).alias("pv_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("pv_lines") - 1), F.col("pv_gone"))
    clean = F.when(F.col("pv_gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda k: F.col("pv_lines")[k]), "\n"))
    if drop_emptied:
        joined = joined.where(F.col("pv_gone").isNull() | (F.btrim(F.array_join(F.transform(kept, lambda k: F.col("pv_lines")[k]), "\n"), F.lit(BLANK)) != ""))
    removed = [] if removed_col is None else [F.sort_array("pv_gone").alias(removed_col)]
    return joined.select(*[clean.alias(c) if c == text_col else F.col("pv_row")[c].alias(c) for c in docs.columns], *removed)


def report(docs: DataFrame) -> DataFrame:
    """For each row its cleaned text and how many lines were removed."""
    out = deduplicated(docs.select("doc_id", "text"), removed_col="removed")
    return out.select("doc_id", "text", F.coalesce(F.when(F.col("removed").isNotNull(), F.size("removed")), F.lit(0)).cast("long").alias("n_removed"))
