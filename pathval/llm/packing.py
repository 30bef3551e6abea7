"""Best-fit packing of token sequences with certified bin counts.

Texts become ids, ids become pieces of at most a sequence's length, and pieces are packed by
best-fit decreasing in partitions of bounded size, dealt by a hash.  Dual feasible functions
give each partition a lower bound on its number of sequences; one that meets its bound is
certified.  Then neighbouring partitions are taken together: a pool whose sequences are as
many as the bound of all its pieces is left alone.  In one with a gap sequences are released,
the loosest first and those of partitions that are not certified before all others, and packed
anew, then the next ones, until the bound is met or all that have space were tried.  Pools grow
from round to round by the same factor in partitions, not in the rows packed at once, until one
spans them all; no sequence with space is closed before.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathval.llm.common import give_back, raw, staged

#: What the pre-tokenizer of the word vocabulary cuts out of lower-case text (a fixed value).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level vocabularies write printable bytes as themselves and the others as signs from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}


class Words:
    """Ids of texts by a tokenizer that never joins over ASCII white space.

    Each run of other characters is encoded once and its ids kept as bytes.  Of printable Latin
    text, where normalising is lower-casing alone, a run is cut into parts as the tokenizer
    does and each part given to its model once; other runs, and those with a special token's
    string, go through the whole tokenizer.  Past ``most`` bytes what is kept becomes the old
    part and the old part of before is forgotten, except for what is met again meanwhile; long
    runs are never kept.  So memory is bounded whatever texts hold, within a text too, and common
    runs stay.
    """

    #: Runs of a text that are looked up at once, bytes of the longest run kept, bytes of an entry besides what it says.
    BATCH, LONG, ENTRY = 50_000, 64, 170

    def __init__(self, path: str, most: int = 30_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cut = self.tokenizer.model, regex.compile(PARTS).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(x.isalpha() for x in self.special):
            raise ValueError("a special token of letters alone is not told from a word")
        self.most, self.size = most, 0
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, part: str, key: bytes) -> bytes:
        """Ids of a lower-case part, whose bytes are ``key``; a part is a run whose ids are its own."""
        ids = self.known.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                signs = part if part.isascii() else key.decode("latin-1").translate(BYTE_SIGNS)
                ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
            if len(key) <= self.LONG:
                self.known[key] = ids
                self.size += len(key) + len(ids) + self.ENTRY
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain, low = text.isascii() or max(text) < "\u0250", text.lower()
        if plain and low.isalpha():  # most words, cut without the pattern; no special token is letters alone
            return self._ids(low, low.encode())
        if not plain or not text.isprintable() or any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if low[-1] in ".," and low[:-1].isalpha():
            return self._ids(low[:-1], low[:-1].encode()) + self._ids(low[-1], low[-1].encode())
        return b"".join([self._ids(part, part.encode()) for part in self.cut(low)])

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian unsigned 32-bit numbers."""
        words, out = text.split(), []
        for k in range(0, len(words), self.BATCH):
            some = words[k : k + self.BATCH] if len(words) > self.BATCH else words
            if self.size > self.most:
                self.old, self.known, self.size = self.known, {}, 0
            known, old, long = self.known, self.old, {}
            for w in set(some):
                if w in known:
                    continue
                ids = old.get(w)
                if ids is None:
                    ids = self._word(w)
                if len(w) > self.LONG:
                    long[w] = ids
                elif w not in known:
                    known[w] = ids
                    self.size += len(w) + len(ids) + self.ENTRY
            out.append(b"".join([long[w] if len(w) > self.LONG else known[w] for w in some] if long else map(known.__getitem__, some)))
        return b"".join(out) if len(out) != 1 else out[0]


_words: dict[str, Words] = {}


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): its ids and ``end_id``, cut every ``capacity``.

    Null and empty texts are the end id alone; a very long text gives as many pieces as it
    takes.  Ids may repeat or be null; each row gives its own pieces; no rows give none.  Other
    columns are ignored.  A special token's string in a text is that token, as the library has
    it.  ``with_ids`` adds the ids themselves.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(path)
        words = _words[path]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.encode(raw(text)) + end
                doc = doc.as_py()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else ())))
                    if with_ids and len(out) >= 1000:
                        yield table(out)
                        out = []
            yield table(out)
        give_back()

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Fewest sequences that the lengths (each so many ``times``) can need, by the best of a family of dual feasible functions.

    One kind rounds a length near the capacity up to it and drops those too short to matter;
    the other (Fekete and Schepers) rounds to multiples of a k-th of the capacity.
    """
    if not len(lengths):
        return 0
    held = np.bincount(lengths, weights=times, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    weight = np.concatenate([[0], np.cumsum(held * x)])
    count = np.concatenate([[0], np.cumsum(held)])
    cut_at = np.arange(capacity // 2 + 1)
    middle = weight[capacity - cut_at + 1] - weight[cut_at]
    large = count[capacity + 1] - count[capacity - cut_at + 1]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):
        rounded = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((held * rounded).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length by best-fit decreasing, and the number of bins.

    Open bins stand in lists by what they have left; a number with a bit for each amount that
    is on hand finds the least sufficient one.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    on_hand, opened = 0, 0
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        enough = on_hand >> n
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            at = left[room].pop()
            if not left[room]:
                on_hand ^= 1 << room
        else:
            room, at, opened = capacity, opened, opened + 1
        bins[k], offsets[k] = at, capacity - room
        room -= n
        if room:
            if not left[room]:
                on_hand |= 1 << room
            left[room].append(at)
    return bins, offsets, opened


def pack(pieces: DataFrame, capacity: int = 2048, rows: int = 50_000, pool: int = 8, released: int = 6_000) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to capacity) with ``sequence_id``, ``offset``, ``bound`` and ``certified``.

    ``rows`` is the size of a partition, ``pool`` how many are taken together in a round, and
    ``released`` the rows that a pool packs anew for each member at first; while its bound is
    not met it goes on with twice as many, up to ``rows`` at once.  A piece's partition follows
    from a hash of its columns and, for equal rows, from chance, so that a hot document spreads.
    ``bound`` is the lower bound of the group of pieces that the sequence was packed with, the
    partition's or the released ones', and ``certified`` tells that this group met it.  Columns
    of any other names are carried; repeated rows are pieces each; no pieces give no rows.
    """
    own = [f"c{k}" for k in range(len(pieces.columns))]  # so that no column meets a name used here
    at = own[pieces.columns.index("length")]
    carried = pieces.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in zip(pieces.columns, own, strict=True)])
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(own, pieces.schema.fields, strict=True))
    schema += ", part long, seq long, place long, free long, tried long, bound long, cert boolean"

    def packed(group: tuple, rows: pd.DataFrame, turn: int, width: int) -> pd.DataFrame:
        lengths = rows[at].to_numpy(np.int64)
        bins, offsets, opened = best_fit(lengths, capacity)
        if turn and rows["seq"].nunique() <= opened:  # keep the packing that was there unless this one is shorter
            out = rows[[*own, "part", "seq", "place", "free", "tried", "bound", "cert"]].copy()
            out["tried"] = width
            return out
        out = rows[[*own, "part"]].copy()
        free = capacity - np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
        out["seq"], out["place"], out["free"], out["tried"] = (turn * parts + int(group[0])) * (1 << 24) + bins, offsets, free[bins], 0
        out["bound"] = least = lower_bound(lengths, capacity)
        out["cert"] = opened == least
        return out

    def asked(group: tuple, found: pd.DataFrame, most: int) -> pd.DataFrame:
        """Of a pool above its bound: the rank from which sequences are released, and the share of those with just that."""
        held, space = found[found["x"] > 0], found[found["x"] < 0].sort_values("x")
        gap = int(held["heads"].sum()) > lower_bound(held["x"].to_numpy(np.int64), capacity, held["n"].to_numpy(np.int64))
        if not gap or space.empty:
            return pd.DataFrame({"pool": [], "least": [], "share": []})
        total = space["n"].cumsum().to_numpy()
        k = min(int(np.searchsorted(total, most)), len(space) - 1)
        share = min(1.0, (most - (total[k - 1] if k else 0)) / int(space["n"].iloc[k]))
        return pd.DataFrame({"pool": [int(group[0])], "least": [-int(space["x"].iloc[k])], "share": [share]})

    total = pieces.count()
    parts = max(1, -(-total // rows))
    hashed = F.pmod(F.xxhash64(*[n for n, c in zip(own, pieces.columns, strict=True) if c != "ids"], F.monotonically_increasing_id() % 64), F.lit(parts))
    now = staged(carried.withColumn("part", hashed).groupBy("part").applyInPandas(lambda g, r: packed(g, r, 0, 0), schema))
    turn, width = 0, 1
    rank = F.col("free") + F.when(F.col("cert"), 0).otherwise(capacity)  # the order of release
    while width < parts:
        before, width, most = width, width * pool, released * pool
        of_one = (-(-parts // before) - 1) // pool if (-(-parts // before)) % pool == 1 else -1  # the pool of a single member waits
        while True:
            pooled = now.withColumn("pool", F.floor(F.col("part") / width)).where(F.col("pool") != of_one)
            held = pooled.groupBy("pool", F.col(at).cast("long").alias("x")).agg(F.count("*").alias("n"), F.sum((F.col("place") == 0).cast("long")).alias("heads"))
            untried = pooled.where((F.col("free") > 0) & (F.col("tried") != width))
            space = untried.groupBy("pool", (-rank).alias("x")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("heads"))
            gaps = held.unionByName(space).groupBy("pool").applyInPandas(lambda g, r: asked(g, r, most), "pool long, least long, share double").collect()
            if not gaps:
                break
            turn += 1
            chosen = now.sparkSession.createDataFrame(gaps, "pool long, least long, share double")
            tagged = now.withColumn("pool", F.floor(F.col("part") / width)).join(F.broadcast(chosen), "pool", "left")
            chance = F.pmod(F.xxhash64("seq", F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
            wanted = (rank > F.col("least")) | (rank == F.col("least")) & (chance < F.col("share"))
            again = F.coalesce(wanted & (F.col("free") > 0) & (F.col("tried") != width), F.lit(False))
            anew = tagged.where(again).groupBy("pool").applyInPandas(lambda g, r: packed(g, r, turn, width), schema)
            now = staged(tagged.where(~again).select(anew.columns).unionByName(anew))
            most = min(2 * most, max(most, rows))
    told = [F.col(n).alias(c) for n, c in zip(own, pieces.columns, strict=True)]
    return now.select(*told, F.col("seq").alias("sequence_id"), F.col("place").alias("offset"), "bound", F.col("cert").alias("certified"))


def production(docs: DataFrame) -> DataFrame:
    """All documents in sequences of 2048 tokens of the 49k word vocabulary."""
    import public_tokenizers

    pieces = staged(cut(docs, public_tokenizers.path("word_bpe_49k.json")))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bound", "certified")
