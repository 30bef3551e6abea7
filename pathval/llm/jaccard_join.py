"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct five-word shingles, as hashes of 56 bits.  Documents of
equal sets are one node, told by 128 bits.  One text of each node is gathered, copies met within
a task counting once; nodes get numbers, and all their hashes are dealt out by value to find
those that stand in two nodes or more.  A pair that links
must share a shingle among the rarest floor(n/4) + 1 of either set, so nodes meet in the block
of the least node that shares such a shingle with them; links of nodes that differ lie within
blocks, none is lost.  Shingles that stand in one node alone cannot be shared, so blocks carry
the others only, and set sizes.

In a block, shingles are hashed into groups and the group counts of a node are a point.
Points are bulk-loaded into an R-tree; the summed coordinate minima of a query and of a box's
upper corner bound the overlap with all points inside.  Pairs that pass the bound are
compared exactly.  A pair that earlier links connect already is skipped, so a block gives at
most one link a member.  Components grow by star contraction over staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathval.llm.common import give_back, looked_up, raw, staged, whole_row
from pathval.llm.quality_rules import word_hashes

WORDS = 5
#: Groups that shingles are hashed into, points in a leaf, and boxes in an inner node.
GROUPS, FANOUT = 64, 32
#: Members of a block that one task takes and the shingles they may bring; larger blocks are cut into tiles.
TILE, TILE_SHINGLES = 20_000, 2_000_000
#: Shingles that one task of the deal takes, about, and that are packed at once.
DEAL, FLUSH = 4_000_000, 500_000
#: Shingles that a task of the deal sorts at once; the rest waits as it was sent.
SORTED = 1_000_000
#: Bytes of a hash, and those of them that are sent on; the target it is dealt to tells the rest.
BYTES, SENT = 7, 6
#: Nodes, about, whose shingles tell the common ones, and how many of them must have a shingle for that.
SAMPLE, OFTEN = 4_000, 8
#: Stands for the number of nodes that have a common shingle.
MANY = 1 << 40


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words the whole sequence is one."""
    h, _ = word_hashes(data.lower())  # of bytes: A-Z only
    n = len(h)
    if not n:
        return h
    k = min(n, WORDS)
    out = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : n - k + 1 + j]
    out ^= out >> np.uint64(33)
    return np.unique((out * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 8 * BYTES))


def digest(found: np.ndarray) -> bytes:
    """A name for a set."""
    return xxhash.xxh3_128_digest(found.tobytes())


def cut(values: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of numbers, a row each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def whole(low: np.ndarray) -> np.ndarray:
    """Numbers of their low bytes."""
    out = np.zeros((len(low), 8), np.uint8)
    out[:, : low.shape[1]] = low
    return out.view("<u8")[:, 0]


def keyed(docs: DataFrame) -> DataFrame:
    """``text`` and 128 bits, ``key`` and ``key2``, by which it is told."""
    return docs.withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64(F.lit(1), "text")})


def nodes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``key2``, ``n_shingles``, ``node`` (a set's name, null without words) of each row."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for text in batch.column(3):
                s = shingles(raw(text))
                sizes.append(len(s))
                names.append(digest(s) if len(s) else None)
            made = [*(batch.column(k) for k in range(3)), pa.array(sizes, pa.int64()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "key", "key2", "n_shingles", "node"])
        give_back()

    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "key", "key2", "text")
    return rows.mapInArrow(named, "doc_id long, key long, key2 long, n_shingles long, node binary")


def common_shingles(docs: DataFrame, nodes: int) -> np.ndarray:
    """Shingles that about one node of ``SAMPLE / OFTEN`` or more has, judged by a sample of texts.

    They are only dealt and ranked in another way, so that no task takes all places of one; what
    links does not depend on which they are.  There are at most ``SAMPLE / OFTEN`` for each shingle
    of a set of mean size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for text in batch.column(0):
                s = shingles(raw(text))
                found[digest(s)] = s
        values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found.values()]), return_counts=True)
        for k in range(0, len(values), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(values[k : k + 100_000].astype(np.int64)), pa.array(n[k : k + 100_000])], names=["v", "n"])
        give_back()

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, nodes // SAMPLE))) == 0)
    often = some.mapInArrow(counted, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).select("v")
    return np.sort(np.array([r[0] for r in often.collect()], np.uint64))


def shared(docs: DataFrame, chosen: DataFrame, total: int, nodes: int) -> DataFrame:
    """``node``, ``shingle``, ``held``, ``name``: shingles that ``held`` >= 2 nodes have, for each of them.

    ``chosen`` has ``key`` and ``key2`` of one text of each node, ``total`` counts their shingles.
    Nodes are numbered within the tasks of the deal in the order of these keys, so that a task
    that runs again gives the same numbers.  For each node one more row has its name, and as
    ``held`` its size below zero.  A shingle is told by 48 bits of its hash and the target that
    its upper half deals it to.
    """
    parts = max(1, -(-total // DEAL), docs.sparkSession.sparkContext.defaultParallelism if total > 1_000_000 else 1)
    # no shingle has more places than there are nodes: up to FLUSH of them are no burden to one task
    often = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, nodes) if nodes > FLUSH else np.empty(0, np.uint64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        names: list[bytes] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(raw(text)))
                names.append(digest(held[-1]))
                size += len(held[-1])
                if size > FLUSH or len(held) == 1 << 16:
                    yield packed(base, names, held)
                    base, names, held, size = base + len(held), [], [], 0
        if held:
            yield packed(base, names, held)
        give_back()

    def packed(base: int, names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        """A row a target: hashes by node and, of each hash, how far its node is from the last one's; common
        shingles apart, dealt by place; one row of the nodes' names and sizes."""
        sizes = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.searchsorted(often.value, values)
        usual = np.ones(len(values), bool)
        if len(often.value):
            usual = often.value[np.minimum(at, len(often.value) - 1)] != values
        target = (((values >> np.uint64(8 * BYTES - 32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        target = np.where(usual, target, parts + (owner + base) % parts)
        order = np.argsort(target, kind="stable")
        bounds = np.searchsorted(target[order], np.arange(2 * parts + 1))
        rows = [(base % parts, 0, base, np.frombuffer(b"".join(names), np.uint8).tobytes(), sizes.astype("<u4").tobytes())]
        for p in range(2 * parts):
            mine = order[bounds[p] : bounds[p + 1]]
            if len(mine):
                kind, bytes_of = (1, SENT) if p < parts else (2, BYTES)
                gaps = np.diff(owner[mine], prepend=0).astype("<u2")
                rows.append((p % parts, kind, base, cut(values[mine], bytes_of).tobytes(), gaps.view(np.uint8).reshape(-1, 2).T.tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "kind", "base", "data", "more"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                to, kind, base = (batch.column(c)[k].as_py() for c in range(3))
                data, more = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in (3, 4))
                if kind == 0:
                    size = more.view("<u4").astype(np.int64)
                    yield rows_of(base + np.arange(len(size)), np.zeros(len(size), np.int64), -size, data.tobytes())
                    continue
                owner = np.cumsum(np.ascontiguousarray(more.reshape(2, -1).T).view("<u2")[:, 0], dtype=np.int64)
                if kind == 2:
                    yield rows_of(base + owner, named(0, whole(data.reshape(-1, BYTES))), np.full(len(owner), MANY))
                    continue
                if to != part:
                    yield from several(part, held)
                    part, held = to, []
                held.append((data.reshape(-1, SENT).copy(), base, owner.astype(np.uint16)))
            del batch
        yield from several(part, held)
        give_back()

    def named(part: int, low: np.ndarray) -> np.ndarray:
        """One number for a shingle of a target; target 0 has the common ones too, whole."""
        with np.errstate(over="ignore"):
            return (low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)

    def several(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of a target's shingles that several nodes have, a range of them at a time."""
        rounds = min(256, -(-sum(len(h[0]) for h in held) // SORTED))
        for turn in range(rounds):  # a range of the highest byte sent
            values, owners = [], []
            for hashes, base, owner in held:
                mine = np.flatnonzero((hashes[:, SENT - 1].astype(np.int32) * rounds) >> 8 == turn)
                values.append(whole(hashes[mine]))
                owners.append(base + owner[mine].astype(np.int64))
            v, o = np.concatenate(values), np.concatenate(owners)
            del values, owners
            order = np.argsort(v, kind="stable")
            v, o = v[order], o[order]
            begins = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
            count = np.diff(begins, append=len(v))
            use = np.repeat(count > 1, count)
            v, o, count = v[use], o[use], np.repeat(count, count)[use]
            for k in range(0, len(v), 100_000):
                yield rows_of(o[k : k + 100_000], named(part + 1, v[k : k + 100_000]), count[k : k + 100_000])

    def rows_of(node: np.ndarray, shingle: np.ndarray, held: np.ndarray, names: bytes | None = None) -> pa.RecordBatch:
        told = pa.array([names[k : k + 16] for k in range(0, len(names), 16)], pa.binary()) if names else pa.nulls(len(node), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(shingle), pa.array(held, pa.int64()), told], names=["node", "shingle", "held", "name"])

    texts = keyed(docs.select("text").where("text is not null")).groupBy("key", "key2").agg(F.first("text").alias("text"))
    texts = texts.join(chosen, ["key", "key2"], "left_semi").sortWithinPartitions("key", "key2").select("text")
    blobs = texts.mapInArrow(deal, "part int, kind int, base long, data binary, more binary")
    return blobs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(met, "node long, shingle long, held long, name binary")


class Tree:
    """An R-tree over points with a size each, bulk-loaded by halving along the widest dimension."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.concatenate(list(self._tiles(np.arange(len(points)), points))) if len(points) else np.empty(0, np.int64)
        level = (points[self.order], sizes[self.order])
        self.levels = [level]  # upper corners and least sizes, leaves' points first
        while len(level[0]) > FANOUT:
            starts = np.arange(0, len(level[0]), FANOUT)
            level = (np.maximum.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts))
            self.levels.append(level)

    @staticmethod
    def _tiles(at: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
        left = [at]
        while left:
            part = left.pop()
            if len(part) <= FANOUT:
                yield part
                continue
            mine = points[part]
            widest = int(np.argmax(mine.max(axis=0).astype(np.int64) - mine.min(axis=0)))
            half = max(FANOUT, len(part) // 2 // FANOUT * FANOUT)
            ranked = part[np.argsort(mine[:, widest], kind="stable")]
            left += [ranked[half:], ranked[:half]]

    def search(self, point: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Points, as leaves of their numbers, whose overlap may reach three quarters of the union."""
        left = [(len(self.levels) - 1, np.arange(len(self.levels[-1][0])))]
        while left:
            depth, at = left.pop()
            corners, least = self.levels[depth]
            good = at[7 * np.minimum(corners[at], point).sum(axis=1, dtype=np.int64) >= 3 * (size + least[at])]
            if not len(good):
                continue
            if depth == 0:
                yield self.order[good]
            elif depth == 1:  # leaves of up to 16 boxes at once
                for k in range(0, len(good), 16):
                    below = (good[k : k + 16, None] * FANOUT + np.arange(FANOUT)).ravel()
                    left.append((0, below[below < len(self.levels[0][0])]))
            else:
                for g in good[::-1]:
                    left.append((depth - 1, np.arange(g * FANOUT, min((g + 1) * FANOUT, len(self.levels[depth - 1][0])))))


def linked(sizes: np.ndarray, sets: list[np.ndarray], known: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """For each member of a block the least member that links connect it with.

    ``sets`` hold what may be shared, ``sizes`` count whole sets.  Members of equal ``known``
    are connected already; if ``asked`` is given, only pairs with one of these are looked at.
    """
    m = len(sets)
    lengths = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), lengths)
    group = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)
    points = np.bincount(row * GROUPS + group[column], minlength=m * GROUPS).reshape(m, GROUPS).astype(np.int32)
    bits = None
    if m * len(values) <= 1 << 28:  # 32 MB
        width = -(-len(values) // 64)
        bits = np.zeros(m * width, np.uint64)
        np.bitwise_or.at(bits, row * width + column // 64, np.uint64(1) << (column % 64).astype(np.uint64))
        bits = bits.reshape(m, width)
    tree, label = Tree(points, sizes), np.arange(m)
    if known is not None:
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        label = first[group]
    for x in range(m) if asked is None else np.flatnonzero(asked):
        for leaf in tree.search(points[x], int(sizes[x])):
            if asked is None:
                leaf = leaf[leaf < x]
            while True:
                leaf = leaf[label[leaf] != label[x]]
                if not len(leaf):
                    break
                part = leaf[:64]
                if bits is not None:
                    common = np.bitwise_count(bits[part] & bits[x]).sum(axis=1, dtype=np.int64)
                else:
                    common = np.array([len(np.intersect1d(sets[y], sets[x], assume_unique=True)) for y in part])
                hits = part[7 * common >= 3 * (sizes[part] + sizes[x])]
                for other in np.unique(label[hits]):
                    a, b = sorted((int(other), int(label[x])))
                    label[label == b] = a
                leaf = leaf[64:]
    return label


def held_sets(found: DataFrame) -> DataFrame:
    """Of :func:`shared`: ``node``, its ``name`` and size ``n``, the ``shared`` shingles and the ``keys`` by which it can link; none of either if it cannot."""
    several = F.when(F.col("name").isNull(), F.struct("held", "shingle"))
    # dealt as plain rows: partial lists would be larger than what they list
    by = found.repartition("node").groupBy("node").agg(F.sort_array(F.collect_list(several)).alias("s"), F.max("name").alias("name"), (-F.min("held")).alias("n"))
    by = by.withColumn("few", F.expr("cast(greatest(0L, floor(n / 4) + 1 - (n - size(s))) as int)"))
    some = F.when(F.col("few") > 0, F.col("s")).otherwise(F.slice("s", 1, 0))
    keys = F.transform(F.slice("s", F.lit(1), F.col("few")), lambda k: k.shingle)
    return staged(by.select("node", "name", "n", F.transform(some, lambda k: k.shingle).alias("shared"), keys.alias("keys")))


def links(sets: DataFrame) -> DataFrame:
    """``a``, ``b``: links between the nodes of :func:`held_sets` that, with what they imply, are all there are."""
    bare = sets.select("node", "n", "shared").where(F.size("shared") > 0)
    met = staged(sets.select("node", F.size("shared").alias("size"), F.explode("keys").alias("key")))
    least = met.groupBy("key").agg(F.min("node").alias("block"), F.count("*").alias("pv_many")).where("pv_many > 1")
    member = staged(looked_up(met, least, "key", F.xxhash64("node")).select("block", "node", "size").distinct())
    slices = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_SHINGLES)).cast("int")
    blocks = member.groupBy("block").agg(F.count("*").alias("pv_many"), slices.alias("slices")).where("pv_many > 1")
    placed = looked_up(member, blocks, "block", F.xxhash64("node")).withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    placed = staged(placed.select("block", "slice", "node", "slices"))
    found = compared(placed, bare, anchors=True)
    large = placed.where("slices > 1")
    if large.isEmpty():
        return found
    # a large block: what its slices and their common anchors leave apart meets every slice
    found = staged(found)
    group = components(found)
    large = staged(large.join(group, "node", "left").withColumn("label", F.coalesce("least", "node")).select("block", "slice", "node", "slices", "label"))
    main = large.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("pv_many"))
    apart = staged(looked_up(large, main, "block", F.xxhash64("node")).where("label <> main").select("block", "node", "slices", "label"))
    chunks = apart.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"), F.max("slices").alias("slices"), F.count("*").alias("pv_many"))
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int").alias("chunk")
    chunked = looked_up(apart.drop("slices"), chunks, "block", F.xxhash64("node")).select("block", "node", "slices", "label", chunk)
    wide = chunks.select("block", "chunks", (F.col("slices") * TILE).alias("pv_many"))
    every = looked_up(large, wide, "block", F.xxhash64("node")).select("block", "slice", "node", "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asked"))
    spread = chunked.select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "node", "label", "chunk", F.lit(True).alias("asked"))
    tiles = every.unionByName(spread).groupBy("block", "slice", "chunk", "node").agg(F.first("label").alias("label"), F.max("asked").alias("asked"))
    return found.unionByName(compared(tiles, bare, ["block", "slice", "chunk"]))


#: Members of a large block that stand in each of its slices.
ANCHORS = 32


def compared(placed: DataFrame, sets: DataFrame, by: list[str] | None = None, anchors: bool = False) -> DataFrame:
    """Links within each tile of ``placed``; with ``anchors`` the same few members join all slices of a block."""
    by = by or ["block", "slice"]
    if anchors:
        turn = F.xxhash64("node", F.lit(2))
        few = placed.where((F.col("slices") > 1) & (F.pmod(turn, F.col("slices") * (TILE // ANCHORS or 1)) == 0))
        few = few.select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "node")
        placed = placed.select("block", "slice", "node").unionByName(few).distinct()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        names = rows["node"].to_numpy(np.int64)
        known = rows["label"].to_numpy(np.int64) if "label" in rows else None
        asked = rows["asked"].to_numpy(bool) if "asked" in rows else None
        label = linked(rows["n"].to_numpy(np.int64), [np.asarray(s, np.int64) for s in rows["shared"]], known, asked)
        use = label != np.arange(len(label))
        if len(rows) > TILE // 10:
            give_back()
        return pd.DataFrame({"a": names[label[use]], "b": names[use]})

    return placed.join(sets, "node").groupBy(*by).applyInPandas(lambda rows: compare(rows), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``least`` of its component, for nodes with an edge, by alternating star contraction.

    Each turn links every node's larger neighbours, then its smaller ones, to the least around
    it; degrees may be of any size, since minima are taken before anything is gathered.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    number, before = edges.count(), None
    while number:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("pv_many")).select("a", F.least("a", "m").alias("m"), "pv_many")
        large = staged(looked_up(edges, low, "a", F.xxhash64("b"), number).select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("pv_many"))
        small = looked_up(large, low, "b", F.xxhash64("a"), number).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        number, before = now[0], now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("least"))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's ``doc_id``, ``key``, ``n_shingles``, ``node``; for each node its ``least`` one of the component, the number ``copies`` of its rows, their least id and row."""
    docs = docs.select("doc_id", "text")
    named = staged(nodes(docs))
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    firsts = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min(row).alias("row"), F.min(F.struct("key", "key2")).alias("text"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    firsts = staged(firsts)
    total, count = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sets = held_sets(shared(docs, firsts.select("text.*"), total, count))
    group = components(links(sets))
    placed = sets.select("node", "name").join(group, "node", "left").select(F.col("name").alias("node"), F.coalesce("least", "node").alias("least"))
    return named, staged(placed.join(firsts.drop("n", "text"), "node"))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles and link with nothing; their component
    is their own id.  Rows of one id are documents each for itself.  Null ids never name a
    component unless it has no other.  No rows give no rows; other columns are ignored.  A very
    long text is one set like others.
    """
    named, placed = _labelled(docs)
    first = placed.groupBy("least").agg(F.min("first").alias("component_id"), F.count("*").alias("pv_many"))
    of = looked_up(placed.drop("first", "row"), first, "least", F.xxhash64("node")).select("node", "component_id", F.col("copies").alias("pv_many"))
    full = looked_up(named.where("node is not null"), staged(of), "node", F.xxhash64("doc_id", "key")).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(named.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; rows without words all stay.

    Of rows with equal id and text one stays.  A null id stays only if its component has no other.
    """
    _, placed = _labelled(docs)
    kept = placed.groupBy("least").agg(F.min("row").alias("k")).select(_id(F.col("k.doc_id")), F.col("k.key").alias("pv_key"))
    words = F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""
    # the row stands in a struct, so that none of its columns meets a name used here
    tagged = docs.select(whole_row(docs), _id(F.col("doc_id").cast("long")), F.xxhash64("text").alias("pv_key"), F.coalesce(words, F.lit(False)).alias("pv_words"))
    full = tagged.where("pv_words").join(kept, ["pv_id", "pv_key"], "left_semi").dropDuplicates(["pv_id", "pv_key"])
    both = full.unionByName(tagged.where("not pv_words"))
    return both.select(*[F.col("pv_row")[c].alias(c) for c in docs.columns])


def _id(col: Column) -> Column:
    return F.coalesce(col, F.lit(-(1 << 63))).alias("pv_id")
