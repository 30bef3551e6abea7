"""Operators over the corpus: shards, packing, near-duplicates, line chunks, the pipeline."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pathval.llm import common, hilbert_shards, jaccard_join, line_dedup, packing
from pathval.llm.common import shared_folder, staged
from tests.llm.test_text import LONG, ODD, SCHEMA


@pytest.fixture(scope="module")
def odd(spark):
    ids = [1, 2, 3, 4, 5, 6, None, 8, 9, 9]
    return spark.createDataFrame([(i, t, "x", 1, "y", 0, "d", None) for i, t in zip(ids, ODD, strict=True)], SCHEMA)


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert staged(spark.range(5)).count() == 5


def test_intermediate_tables_are_removed(spark):
    import os

    before = len(common.made)
    kept = staged(spark.range(7))
    here = len(common.made)
    staged(spark.range(5))
    gone = common.made[here]
    common.remove_staged(spark, here)
    assert kept.count() == 7 and not os.path.exists(gone.removeprefix("file:")) and len(common.made) == before + 1


def test_pipeline_leaves_its_result_alone(spark):
    import os

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and os.listdir(f"{folder}/{left.pop()}") == ["4"] and out.count() > 0


# --- shards -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2), (5, 1)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = hilbert_shards.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rows", [3, 500_000])
def test_shards_follow_the_law(spark, odd, monkeypatch, rows):
    monkeypatch.setattr(hilbert_shards, "ROWS_A_PARTITION", rows)
    docs = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))
    out = hilbert_shards.sharded(docs, ["lang", "n_words", "n_chars"], shards=4).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == len(ODD) and set(counts.index) == {0, 1, 2, 3} and counts.max() - counts.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    sizes = {(None if i != i else i): s for i, s in zip(out["doc_id"], out["size"], strict=True)}
    assert sizes[1] == 16 and sizes[8] == 16 + len(LONG)
    assert set(out["text_crc32"]) == {zlib.crc32((t or "").encode()) for t in ODD}
    assert hilbert_shards.sharded(docs.limit(0), ["lang"], shards=4).count() == 0


def test_shards_of_clashing_names(odd):
    names = ["size", "shard", "at", "slot", "law", "same", "own", "curve", "pv_many", "v0", "p", "ahead", "row"]
    docs = odd.select("doc_id", "text", *[F.length("text").alias(n) for n in names])
    plainly = hilbert_shards.sharded(odd.select("doc_id", "text", F.length("text").alias("size")), ["size"], shards=4)
    assert sorted(map(tuple, hilbert_shards.sharded(docs, ["size"], shards=4).collect()), key=repr) == sorted(map(tuple, plainly.collect()), key=repr)
    two = hilbert_shards.sharded(docs, ["shard", "curve"], shards=4)
    assert two.count() == len(ODD) and two.columns == plainly.columns


def test_more_shards_than_rows(odd):
    out = hilbert_shards.sharded(odd, ["n_words"], shards=40).toPandas()
    assert sorted(out["shard"]) == list(range(len(ODD))) and (out["slot"] == 0).all()


def test_shards_are_narrow_in_every_dimension(spark):
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    out = hilbert_shards.sharded(docs, ["x", "y"], shards=16).join(docs, "doc_id")
    span = out.groupBy("shard").agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy")).toPandas()
    assert span["dx"].mean() < 24 and span["dy"].mean() < 24


def test_whole_query_equals_a_sort_in_memory(spark):
    """Quantiles, curve, groups of equal texts, runs: by pandas over all documents."""
    from pathval.llm.queries import op4_hilbert_shards

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = op4_hilbert_shards(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    steps = []
    for col in ("lang", "source", "n_chars"):
        values = docs[col]
        if col != "n_chars":
            values = values.map(lambda x: float(int((x or "").encode()[:7].hex().ljust(14, "0"), 16)) if x is not None else np.nan)
        values = values.to_numpy(float)
        known = np.sort(values[~np.isnan(values)])
        cuts = np.unique([known[max(0, -(-k * len(known) // 64) - 1)] for k in range(1, 64)])  # a percentile is a value that is there
        steps.append(np.where(np.isnan(values), 0, np.searchsorted(cuts, values, side="right")))
    docs["own"] = hilbert_shards.hilbert(np.stack(steps, axis=1).astype(np.int64), 6)
    docs["crc"] = [zlib.crc32((t or "").encode()) if t is not None else 0 for t in docs["text"]]
    docs["curve"] = docs.groupby(docs["text"].fillna("\x00null"))["own"].transform("min")
    ranked = docs.sort_values(["curve", "crc", "doc_id"]).reset_index(drop=True)
    ranked["shard"] = np.arange(len(ranked)) * 40 // len(ranked)
    want = ranked.sort_values("doc_id").reset_index(drop=True)
    assert (got["doc_id"] == want["doc_id"]).all() and (got["text_crc32"] == want["crc"]).all()
    assert (got["shard"] == want["shard"]).all()
    parted = got.groupby("text_crc32")["shard"].nunique()
    assert (parted > 1).sum() <= 39


# --- packing ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_best_fit_and_bound(lengths):
    n = np.array(lengths)
    bins, offsets, opened = packing.best_fit(n, 20)
    check_packing(bins, offsets, n, 20)
    assert packing.lower_bound(n, 20) <= opened == bins.max() + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=7))
def test_bound_never_exceeds_the_best(lengths):
    def fewest(rest, loads):
        if not rest:
            return len(loads)
        best = fewest(rest[1:], [*loads, rest[0]])
        for k, load in enumerate(loads):
            if load + rest[0] <= 10:
                best = min(best, fewest(rest[1:], [*loads[:k], load + rest[0], *loads[k + 1 :]]))
        return best

    assert packing.lower_bound(np.array(lengths), 10) <= fewest(lengths, [])


def check_packing(bins, offsets, lengths, capacity):
    for b in set(bins.tolist()):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (offsets[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()
        assert lengths[mine].sum() <= capacity


def test_bound_of_large_items():
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3
    assert packing.lower_bound(np.array([7] * 6), 20) == 3
    assert packing.lower_bound(np.array([], int), 20) == 0


TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def library_ids(text):
    return np.array([*TOKENS.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aAbE'sStT.,!\n 09éÉßİıΣς½ª́ẞ漢🙂​\x1c\x85\xad<|>", max_size=30)))
def test_ids_are_those_of_the_library(text):
    words = test_ids_are_those_of_the_library.__dict__.setdefault("words", packing.Words(public_tokenizers.path("word_bpe_49k.json")))
    assert words.encode(text.encode("utf-8", "replace")) == library_ids(text.encode("utf-8", "replace").decode())[:-1].tobytes()


@pytest.mark.parametrize("most", [0, 2_000, 24_000_000])
def test_ids_of_special_strings_and_long_runs(most):
    """Special tokens' strings are those tokens, and little memory changes no id."""
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"), most)
    words.BATCH = 40
    texts = ["a<|endoftext|>b <|startoftext|>", "x <|EndOfText|> <|endof text|> é<|endoftext|>'s", "ab" * 5000, "漢" * 500, LONG[:4000], "Don't stop, it's 2024. " * 30]
    for text in texts:
        assert words.encode(text.encode()) == library_ids(text)[:-1].tobytes(), text[:40]


def test_pieces_of_clashing_names(odd):
    names = ["piece", "length", "start", "sequence_id", "offset", "part", "seq", "bound", "cert", "pool"]
    out = packing.production(odd.select("doc_id", "text", *[F.lit("x").alias(n) for n in names]))
    assert out.count() == packing.production(odd).count()


def test_certified_partitions_exchange_nothing(spark):
    """Pieces of over half a sequence need one each: every partition meets its bound at once."""
    lengths = np.random.default_rng(3).integers(1030, 1300, 800)
    pieces = staged(spark.createDataFrame([(k, int(n), "s") for k, n in enumerate(lengths)], "seq long, length long, part string"))
    out = packing.pack(pieces, 2048, 100, 8, 10)
    assert out.columns == ["seq", "length", "part", "sequence_id", "offset", "bound", "certified"]
    got = out.toPandas()
    assert got["certified"].all() and got["sequence_id"].nunique() == 800 and (got["sequence_id"] < 8 << 24).all()
    sizes = got.groupby(got["sequence_id"] // (1 << 24))
    assert (sizes["bound"].first() == sizes.size()).all()


def test_bounds_and_certificates_of_groups(spark):
    lengths = np.random.default_rng(4).integers(1, 1500, 700)
    pieces = staged(spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "doc_id long, length long"))
    got = packing.pack(pieces, 2048, 100, 3, 20).toPandas()
    assert (got.groupby("sequence_id")[["bound", "certified"]].nunique() == 1).all().all()
    assert got["sequence_id"].nunique() >= packing.lower_bound(lengths, 2048)
    first = packing.pack(pieces, 2048, 1000, 3, 20).toPandas()  # one partition
    assert set(first["bound"]) == {packing.lower_bound(lengths, 2048)} and set(first["certified"]) == {first["sequence_id"].nunique() == packing.lower_bound(lengths, 2048)}


def test_pieces_are_the_documents(spark, odd):
    out = packing.production(odd.select("doc_id", "text")).toPandas()
    want = []
    for doc, text in zip([1, 2, 3, 4, 5, 6, -1, 8, 9, 9], ODD, strict=True):
        ids = library_ids(text)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((doc, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    out["doc_id"] = out["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    check_packing(out["sequence_id"].to_numpy(), out["offset"].to_numpy(), out["length"].to_numpy(), 2048)
    assert packing.production(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("rows", "pool", "released"), [(40, 2, 10), (100, 3, 30), (1000, 8, 6000)])
def test_partitions_exchange(spark, rows, pool, released):
    rng = np.random.default_rng(rows)
    lengths = np.concatenate([rng.integers(600, 1400, 300), rng.integers(1, 400, 300)]).tolist()
    pieces = staged(spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long"))
    out = packing.pack(pieces, 2048, rows, pool, released).toPandas()
    assert sorted(out["doc_id"]) == list(range(600))
    check_packing(out["sequence_id"].to_numpy(), out["offset"].to_numpy(), out["length"].to_numpy(), 2048)
    whole = packing.best_fit(np.array(lengths), 2048)[2]
    assert out["sequence_id"].nunique() <= whole * 1.1 + 2


def test_partitions_of_few_released_rows_come_near_the_bound(spark):
    """A pool of eight and a ninth partition alone, of which few rows are released at a time."""
    lengths = np.random.default_rng(9).integers(1, 300, 880)
    pieces = staged(spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "doc_id long, length long"))
    out = packing.pack(pieces, 2048, 100, 8, 10).toPandas()
    assert sorted(out["doc_id"]) == list(range(880))
    check_packing(out["sequence_id"].to_numpy(), out["offset"].to_numpy(), out["length"].to_numpy(), 2048)
    assert out["sequence_id"].nunique() <= packing.lower_bound(lengths, 2048) + 1


# --- near-duplicates ---------------------------------------------------------------------------------


def brute_classes(rows):
    """Components over all pairs of shingle sets, as strings."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted((doc, len(sets[k]), least[find(k)] if sets[k] else doc) for k, (doc, _) in enumerate(rows))


def near_copies(seed, groups=6, size=14, words=60):
    """Chains of edits: neighbours in a chain agree, its ends may not; all share a common passage."""
    rng = np.random.default_rng(seed)
    common = [f"c{k}" for k in range(25)]
    rows = []
    for g in range(groups):
        text = [f"g{g}w{k}" for k in range(words)] + common * (g % 2)
        for _ in range(size):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.integers(0, 3)):
                text = list(text)
                text[rng.integers(0, len(text))] = f"n{rng.integers(1 << 30)}"
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "Ab c", "aB C", "ab c d", rows[0][1].upper(), rows[3][1], "x " * 40])]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_classes(rows)


@pytest.mark.parametrize("tile", [5, 9, 30])
def test_slices_lose_no_link(spark, monkeypatch, tile):
    rows = near_copies(tile, groups=3, size=40)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "ANCHORS", 2)
    monkeypatch.setattr(jaccard_join, "SORTED", 300)
    monkeypatch.setattr(jaccard_join, "DEAL", 500)
    monkeypatch.setattr(jaccard_join, "FLUSH", 20)  # so that common shingles are dealt by place
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_classes(rows)


def test_tree_finds_all_that_may_overlap():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 6, (700, 64)).astype(np.int32)
    points[350:] = np.maximum(points[:350] + rng.integers(-1, 2, (350, 64)), 0)
    sizes = points.sum(axis=1)
    tree = jaccard_join.Tree(points, sizes)
    for q in range(0, 700, 41):
        got = set(np.concatenate([*tree.search(points[q], int(sizes[q])), np.empty(0, np.int64)]).astype(int).tolist())
        want = set(np.flatnonzero(7 * np.minimum(points, points[q]).sum(axis=1) >= 3 * (sizes + sizes[q])).tolist())
        assert got == want


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    got = {r["node"]: r["least"] for r in jaccard_join.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 301)) and got[1002] == got[1001] == 1000


def test_classes_of_odd_rows(spark, odd):
    got = jaccard_join.classes(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["n_shingles"] for k in (1, 2, 3, 4)] == [0, 0, 0, 1] and by_id[1]["component_id"] == 1
    assert jaccard_join.classes(odd.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.classes(nulls).collect()} == {4}
    assert {r["component_id"] for r in jaccard_join.classes(nulls.where("doc_id is null")).collect()} == {None}


def test_one_of_each(spark, odd):
    rows = near_copies(1)
    docs = spark.createDataFrame([(k, t, 1, "b", "n") for k, t in rows], "doc_id long, text string, pv_id int, node string, of string")
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in brute_classes(rows)})
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 2 and kept.where("doc_id = 9").count() == 1


# --- line chunks ------------------------------------------------------------------------------------------


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_chunks(text):
    """First line, last line and bytes of each chunk: two lines with words, or one of many words."""
    lines = text.split("\n")
    worded = [k for k, x in enumerate(lines) if WORD.search(x)]
    pairs = [(a, b, (2, lines[a] + "\n" + lines[b])) for a, b in itertools.pairwise(worded)]
    return sorted(pairs + [(a, a, (1, lines[a])) for a in worded if len(WORD.findall(lines[a])) >= line_dedup.LONG])


def brute_dedup(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        gone = set()
        for a, b, chunk in brute_chunks(text):
            if chunk in seen:
                gone.update(range(a, b + 1))
            seen.add(chunk)
        out[doc] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_chunk_expression_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    long = " ".join(["w"] * 50)
    texts = ["\n".join(rng.choice(["a", "b c", "", " ", "\t\x0b", long, long[2:], "é" * 99], rng.integers(1, 30))) for _ in range(200)] + ["", "\n", "\n\n", "x"]
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.told(F.col("t")).alias("l")).select("t", F.inline(line_dedup.chunks(F.col("l"))))
    got = {t: set() for t in texts}
    hashes = {}
    for r in cut.select("t", "pos", "end", "r", line_dedup.written(F.col("t"), F.col("pos"), F.col("end")).alias("bytes")).collect():
        several = r["pos"] < r["end"]
        if several or len(WORD.findall(r["bytes"])) >= line_dedup.LONG:
            got[r["t"]].add((r["pos"], r["end"], (1 + several, r["bytes"])))
        assert hashes.setdefault(r["r"], (several, r["bytes"])) == (several, r["bytes"])
    assert all(got[t] == set(brute_chunks(t)) for t in texts)


@pytest.mark.parametrize("lines", range(1, 6))
def test_repeated_passages_go_whole(spark, lines):
    """Passages of over 50 words in several documents, each time between other lines."""
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(60 // lines + 1 if lines > 1 else 51)) for k in range(lines))
    rows = [(d, f"own {d} a\n{passage}\nown {d} b\nown {d} c") for d in range(8)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {d: t if d == 0 else f"own {d} a\nown {d} b\nown {d} c" for d, t in rows}


def test_a_hot_chunk_is_dealt_to_several_tasks(spark):
    """A passage that each document has, and blank lines between its lines."""
    rows = [(d, f"own {d}\nsame\n{' ' * (d % 2)}\nagain") for d in range(700)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == brute_dedup(rows) and left[5] == "own 5"


@pytest.mark.parametrize("seed", range(3))
def test_dedup_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [[f"p{p} line {k} of a passage" for k in range(8)] for p in range(4)]
    rows = []
    for k in range(60):
        own = [f"own {k} {j}" for j in range(rng.integers(1, 8))]
        at = rng.integers(0, len(own) + 1)
        rows.append((k, "\n".join(own[:at] + passages[rng.integers(0, 4)] + own[at:])))
    rows += [(k + 100, rows[k][1]) for k in range(10)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, pv_key string")
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_dedup(rows)


def test_dedup_of_odd_rows(spark, odd):
    out = line_dedup.report(odd).collect()
    assert sorted((r["text"] or "", r["n_removed"]) for r in out) == sorted((t or "", 0) for t in ODD)
    many = "\n".join(f"line {k}" for k in range(30))
    rows = spark.createDataFrame([(None, many), (3, many), (3, many), (2, "x\n" + many)], "doc_id long, text string")
    got = line_dedup.report(rows).collect()
    assert [r["text"] for r in got if r["doc_id"] is None] == [many]
    assert [r["text"] for r in got if r["doc_id"] == 3] == ["", ""] and [r["text"] for r in got if r["doc_id"] == 2] == ["x"]
    assert line_dedup.report(odd.limit(0)).count() == 0
    left = line_dedup.deduplicated(rows.unionByName(spark.createDataFrame([(7, ""), (8, None), (9, " \n")], rows.schema)), drop_emptied=True).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left if r["text"] is not None) == [(0, many), (2, "x"), (7, ""), (9, " \n")] and len(left) == 5



def test_dedup_runs_without_python(spark, odd):
    plan = line_dedup.report(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    """Each stage against the brute-force form of its operator, on what the one before kept."""
    from tests.llm.test_text import brute_measures

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("clash"))
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        if k < 4:
            assert docs.columns == before.columns
            left = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 0:
            bad = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
            good = {r[0] for r in bad.collect()}
            assert len(good & set(left)) > 0.97 * len(good & set(rows)) and len(left) < len(rows)
        elif k == 1:
            assert all(brute_measures(t)["n_words"] >= 50 for t in left.values()) and len(left) < len(rows)
        elif k == 2:
            assert left == {d: t for d, t in brute_dedup(list(rows.items())).items() if WORD.search(t) or not WORD.search(rows[d])}
        elif k == 3:
            assert set(left) == {c for _, _, c in brute_classes(sorted(rows.items()))}
        else:
            pieces = docs.toPandas()
            assert set(pieces["doc_id"]) == set(rows)
            check_packing(pieces["sequence_id"].to_numpy(), pieces["offset"].to_numpy(), pieces["length"].to_numpy(), 2048)
            assert pieces["sequence_id"].nunique() <= packing.lower_bound(pieces["length"].to_numpy(), 2048) + 1
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    docs, sf = odd, "/root/testdata/sf0.001"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"a{k}"))
        docs = spark.read.parquet(str(tmp_path / f"a{k}"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0
