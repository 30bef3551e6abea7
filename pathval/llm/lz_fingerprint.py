"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed as LZ78 does: each phrase is the shortest one that is not in the
dictionary yet, and enters it.  Every phrase is hashed once; the hashes are dealt to the bins
of a signature by their high bits and the least of each bin is kept (one-permutation minimum
hashing, empty bins filled from the next full one).  Texts that compress each other well share
phrases, and the share of equal bins estimates how many.

A text and an edit of its end have a common parse as far as they agree; the dictionary is
rolled back to there and the other end parsed on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathval.llm.common import give_back, raw

BINS = 64
#: Rows that one sorted partition holds, about, while there are no more than ``PARTS`` of them; keys sampled for each.
ROWS_A_PARTITION, PARTS, KEYS = 10_000, 20_000, 40
#: An id and a hash of the text.
KEY = np.dtype([("a", np.int64), ("b", np.int64)])


def phrases(data: bytes, begin: int = 0, known: set[bytes] | None = None) -> tuple[list[bytes], list[int]]:
    """Phrases of ``data`` from ``begin`` on and where each ends; ``known`` grows by them.

    A dictionary holds every head of each of its phrases, so the length of the longest known
    one at a place is searched up or down from the last phrase's.  The rest at the end of the
    text is a phrase even if known.
    """
    known = set() if known is None else known
    out, ends, end, n = [], [], len(data), 1
    add = known.add
    while begin < end:
        part = data[begin : begin + n]
        if part in known:
            while True:
                n += 1
                part = data[begin : begin + n]
                if part not in known:
                    break
                if begin + n >= end:
                    break
        else:
            while n > 1:
                less = data[begin : begin + n - 1]
                if less in known:
                    break
                part, n = less, n - 1
        add(part)
        out.append(part)
        begin += len(part)
        ends.append(begin)
    return out, ends


def signature(parsed: list[bytes], bins: int = BINS) -> np.ndarray:
    """The least hash of each bin, 16 bits of it; all zero for no phrase."""
    if not parsed:
        return np.zeros(bins, np.uint16)
    h = np.fromiter(map(zlib.crc32, parsed), np.uint64, len(parsed)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h.sort()
    at = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    full, first = np.unique(at, return_index=True)
    place = np.searchsorted(full, np.arange(bins))
    turned = place == len(full)  # past the last full bin the first one serves
    place[turned] = 0
    least = h[first[place]]
    # a borrowed value is mixed with its distance, else neighbours would agree too easily
    away = (full[place] - np.arange(bins)) % bins
    return ((least + away.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(8)).astype(np.uint16)


def written(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins, 0 to 1."""
    return float((a == b).mean())


def both(text: str, other: str, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of ``text`` and of its edit, and the edit.

    The edit's last quarter of code points, rounded down, gives way to as many of the first
    ones of ``other``, or all if it has fewer.
    """
    away = len(text) // 4
    head = text[: len(text) - away]
    edited = head + other[:away]
    data, edit = text.encode("utf-8", "surrogatepass"), edited.encode("utf-8", "surrogatepass")
    known: set[bytes] = set()
    parsed, ends = phrases(data, 0, known)
    own = signature(parsed, bins)
    if not away:
        return own, own, edited
    # phrases that end before both texts' common head does are common too
    common = int(np.searchsorted(ends, min(len(head.encode("utf-8", "surrogatepass")), len(edit) - 1), side="right"))
    shared = parsed[:common]
    if common == len(parsed) and len(data) == len(edit):
        common, shared = common - 1, parsed[:-1]
    known.difference_update(parsed[common:])
    known.update(shared)
    rest, _ = phrases(edit, ends[common - 1] if common else 0, known)
    return own, signature(shared + rest, bins), edited


def begins(keyed: DataFrame, count: int) -> np.ndarray:
    """Keys of rows at which partitions begin, in order, the first of all rows among them.

    They come from a sample of keys by their hash, about ``KEYS`` for each of up to ``PARTS``
    partitions; they say where rows are worked on, not what comes of them.
    """
    parts = min(PARTS, max(1, -(-count // ROWS_A_PARTITION)))
    chance = F.pmod(F.xxhash64("pv_order", "pv_tie", F.lit(1)), F.lit(max(1, count // (KEYS * parts))))
    least = keyed.agg(F.min(F.struct("pv_order", "pv_tie")).alias("k")).select("k.*")
    some = keyed.where(chance == 0).select("pv_order", "pv_tie")
    found = np.unique(np.array([(r[0], r[1]) for r in some.unionByName(least.dropna()).collect()], KEY))
    if not len(found):
        return found
    return found[np.unique(np.arange(parts) * len(found) // parts)]


def fingerprints(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The next document is the one after in ascending doc_id (ties by a hash of the text), after
    the last the first; of a single document itself.  A null id comes first; a null text counts
    as empty.  Repeated rows are documents like others; equal texts have equal fingerprints.
    Documents are dealt to ranges of keys, each range also gets the first row of the next one,
    and each is read once in order, a text at a time.  No rows give no rows; other columns are
    ignored.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("pv_order")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order, F.xxhash64("text").alias("pv_tie"))
    first_keys = begins(keyed, docs.count())
    number = max(1, len(first_keys))
    sent = docs.sparkSession.sparkContext.broadcast(first_keys)

    @F.arrow_udf("part int, first boolean")
    def place(order: pa.Array, tie: pa.Array) -> pa.Array:
        keys = np.empty(len(order), KEY)
        keys["a"], keys["b"] = order.to_numpy(), tie.to_numpy()
        part = np.searchsorted(sent.value, keys, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(sent.value[part] == keys)], names=["part", "first"])

    at = F.col("pv_at")
    # the rows of a partition's first key also go to the partition before, behind its own rows
    own_copy = F.struct(at["part"].alias("part"), F.lit(0).alias("late"))
    early_copy = F.struct(F.pmod(at["part"] - 1, F.lit(number)).alias("part"), F.lit(1).alias("late"))
    copies = F.when(at["first"], F.array(own_copy, early_copy)).otherwise(F.array(own_copy))
    dealt = keyed.withColumn("pv_at", place("pv_order", "pv_tie")).withColumn("pv_copy", F.explode(copies))
    dealt = dealt.select("doc_id", "text", "pv_order", "pv_tie", "pv_copy.part", "pv_copy.late")
    dealt = dealt.repartitionById(number, "part").sortWithinPartitions("part", "late", "pv_order", "pv_tie")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each row's id and text, the next row's text, and whether that is of the next partition."""
        held = None
        for batch in batches:
            for doc, text, part, late in zip(*(batch.column(c) for c in ("doc_id", "text", "part", "late")), strict=True):
                text, part, late = raw(text).decode(), part.as_py(), late.as_py()
                if held is not None and held[2] == part:
                    yield held[0], held[1], text, late
                held = None if late else (doc.as_py(), text, part)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = None  # a row whose next one's fingerprint is to come
        for doc, text, after, late in neighbours(batches):
            own, edit, edited = both(text, after, bins)
            if waiting is not None:
                out.append((*waiting, own))
            waiting = (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, edit)
            if late:
                out.append((*waiting, signature(phrases(after.encode("utf-8", "surrogatepass"))[0], bins)))
                waiting = None
            if len(out) >= 1000:
                yield table(out)
                out = []
        yield table(out)
        give_back()

    def table(rows: list) -> pa.RecordBatch:
        made = [(d, n, sha, written(own), written(edit), likeness(own, edit), likeness(own, after)) for d, n, sha, own, edit, after in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "part", "late").mapInArrow(read, schema)
