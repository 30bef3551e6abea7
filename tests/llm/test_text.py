"""Operators on single texts: rules, tokens, extraction, language, quality, fingerprints."""

import hashlib
import html
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathval.llm import bpe_transducer, html_density, language_id, lz_fingerprint, quality_model, quality_rules
from pathval.llm.ftrl import Leader, activate

LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(60_000))
ODD = [None, "", " \n\t ", "one", "ÄÖ ü", "a\x1cb c", "x y", LONG, "same same same " * 40, "same same same " * 40]
SCHEMA = "doc_id long, text string, n_words string, m int, score string, kept int, d string, l string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, a repeated and a null id, columns with clashing names."""
    ids = [1, 2, 3, 4, 5, 6, None, 8, 9, 9]
    return spark.createDataFrame([(i, t, "x", 1, "y", 0, "d", None) for i, t in zip(ids, ODD, strict=True)], SCHEMA)


# --- quality rules ---------------------------------------------------------------------------


def brute_measures(text, limits=quality_rules.Limits()):
    """The same measures by lists and dictionaries of words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>")}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for k, x in enumerate(lines) if x in lines[:k]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(dup), "dup_line_chars": sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in dup)}

    def grams(n):
        places = {}
        for k in range(len(words) - n + 1):
            places.setdefault(tuple(words[k : k + n]), []).append(k)
        return places

    out["n_repeat_words"] = len({k + j for p in grams(3).values() if len(p) > 1 for k in p for j in range(3)})
    for n in limits.top:
        out[f"top_{n}_chars"] = max(((len(p) - 1) * sum(map(len, g)) for g, p in grams(n).items()), default=0)
    for n in limits.repeated:
        out[f"repeated_{n}_chars"] = sum(len(words[i]) for i in {k + j for p in grams(n).values() for k in p[1:] for j in range(n)})
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\x1c#|", max_size=120))
def test_measures_equal_brute_force(text):
    got = quality_rules.measure(text)
    assert {k: got[k] for k in brute_measures(text)} == brute_measures(text)


def test_measures_of_texts_like_language():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "of", "an", "house", "ä", "|"], rng.integers(0, 300)))
        got = quality_rules.measure(text)
        assert {k: got[k] for k in brute_measures(text)} == brute_measures(text)


def test_verdicts():
    clean = " ".join(f"w{k}" for k in range(80))
    assert quality_rules.measure(clean)["kept"]
    assert not quality_rules.measure(" ".join(["tic"] * 80))["kept"]
    lines = "\n".join(f"w{k} v{k}" for k in range(60))
    assert quality_rules.measure(lines)["kept"]
    copied = quality_rules.measure(lines + "\n" + "\n".join(f"w{k} v{k}" for k in range(0, 56, 3)))
    assert not copied["base_failed"] and not copied["kept"]
    assert quality_rules.measure("short")["base_failed"]


def test_rules_as_column(odd):
    rows = odd.select("doc_id", quality_rules.repetition(F.col("text")).alias("q")).select("doc_id", "q.*").collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[3]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[8]["n_words"] == 60_000
    assert odd.limit(0).select(quality_rules.repetition(F.col("text"))).count() == 0


# --- byte-level BPE ----------------------------------------------------------------------------

RANKS = bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="thein rsaod,.'lé\n", max_size=80)))
def test_ids_are_those_of_the_library(text):
    ids = OURS.encode(text)
    assert ids == KNOWN.encode_ordinary(text)
    assert "".join(OURS.decode(ids, block=3)) == text


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_pieces_of_any_bytes(piece):
    assert list(OURS.fst.encode(piece)) == KNOWN._encode_single_piece(piece)
    assert OURS.fst.merged(piece) == KNOWN._encode_single_piece(piece) or piece in RANKS


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 7))
def test_incremental_utf8(data, step):
    state = bpe_transducer.Utf8()
    got = "".join(state.feed(data[k : k + step]) for k in range(0, len(data), step)) + state.finish()
    assert got == data.decode("utf-8", "replace")


def test_little_memory_gives_the_same_ids():
    small = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN, most_pieces=5)
    small.fst.most_states = 20
    text = "Counting the reasons, one by one; thereafter rest. " * 3 + LONG[:3000]
    assert small.encode(text) == KNOWN.encode_ordinary(text)
    assert OURS.encode("a" * 20_000) == KNOWN.encode_ordinary("a" * 20_000)


def test_states_stay_bounded_within_a_long_run():
    rng = np.random.default_rng(5)
    small = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN)
    small.fst.most_states = 2000
    run = "".join(rng.choice(list("etaoinshrdlu"), 30_000))
    assert small.encode(run) == KNOWN.encode_ordinary(run)
    assert len(small.fst._states) <= 2001 and len(small.fst._number) <= 2001


def test_round_trip_as_query(spark, odd):
    rows = bpe_transducer.production(spark, odd).collect()
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in ODD)
    assert sorted(r["decoded_sha256"] for r in rows) == texts
    r = next(r for r in rows if r["doc_id"] == 8)
    ids = KNOWN.encode_ordinary(LONG)
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe_transducer.production(spark, odd.limit(0)).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = odd.select("text", bpe_transducer.encode(F.col("text"), path, public_tokenizers.PATTERN).alias("ids"))
    back = both.select("text", bpe_transducer.decode(F.col("ids"), path, public_tokenizers.PATTERN).alias("back"))
    assert back.where("coalesce(text, '') <> back").count() == 0


# --- extraction ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href=/a>Home</a></li></ul></nav></header><div id="cookie-notice">We use cookies <button>OK</button></div>
<div class=wrap><div id=content><h1>Head &amp; line</h1><!-- ad --><div class="ad">Buy now</div><p>First  paragraph with a <a href=x>link</a> and<br>more &#228; text in it.
<p><b>Second one<br>is <i>here</i>.<blockquote>Quoted words of someone.</blockquote><ul><li>one item<li>two items</ul>
<table><tr><td>a<td>b<tr><td>c</table><form>Name <input> <select><option>x</select></form></div><div class="sidebar">Side <a href=y>more</a></div></div>
<section id=comments><article class=comment><p>A very long comment by a reader, longer than all the rest of the page put together, again and again and again.</article></section>
<footer>&copy; 2020</footer></body></html>"""


def test_extraction():
    assert html_density.extract(PAGE) == "Head & line\nFirst paragraph with a link and more ä text in it.\nSecond one is here.\nQuoted words of someone.\none item\ntwo items\na b\nc"


@pytest.mark.parametrize("cut", range(0, len(PAGE), 37))
def test_extraction_of_cut_pages_never_fails(cut):
    html_density.extract(PAGE[:cut])
    html_density.extract(PAGE[cut:])


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>one</p><p>two</p>", "one\ntwo"), ("<nav>menu</nav>", ""), ("<article><h1>A</h1><p>B c.</p></article><footer>f</footer>", "A\nB c."), ("<p>a &lt;b&gt; &amp;amp; c", "a <b> &amp; c"), ("<p>x</b></i></p>y", "x\ny"), ("<script>never ends", "")],
)
def test_extraction_of_odd_pages(page, text):
    assert html_density.extract(page) == text


def test_menus_of_links_are_left_out_unnamed():
    body = "".join(f"<p>Paragraph number {k} has a good many words in it, as articles do.</p>" for k in range(5))
    menu = "<div>" + "".join(f"<a href=/{k}>Link {k}</a> " for k in range(20)) + "</div>"
    text = html_density.extract(f"<body>{menu}<div><h1>Title</h1>{body}{menu}</div>{menu}</body>")
    assert text.startswith("Title\nParagraph number 0") and text.endswith("as articles do.")


def paragraphs(name, n):
    return [f"{name}{k} " + "words " * 99 + "end." for k in range(n)]


def test_articles_in_two_unnamed_containers_stay_whole():
    a, b = paragraphs("A", 6), paragraphs("B", 5)
    first, second = ("<div>" + "".join(f"<p>{x}</p>" for x in part) + "</div>" for part in (a, b))
    assert html_density.extract(f"<body><div>{first}{second}</div></body>") == "\n".join(a + b)


def test_bare_text_beside_the_best_block_stays():
    a = paragraphs("A", 6)
    inner = "<div>" + "".join(f"<p>{x}</p>" for x in a) + "</div>"
    page = f"<body><div>Bare <i>words</i> first.<br>Then more.{inner}A last line.</div><a href=/>Home</a> | <a href=/b>About us</a></body>"
    assert html_density.extract(page) == "\n".join(["Bare words first. Then more.", *a, "A last line."])


def test_deep_pages():
    assert html_density.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "<p>x" * n, lambda n: "<div>" * n + "<p>x" * n, lambda n: "<ul><li>" * n + "</b>" * n, lambda n: "<a href=x>" * n + "y", lambda n: "<header>" * n + "<h1>t"])
def test_time_follows_the_length(page):
    def took(n):
        began = time.process_time()
        html_density.extract(page(n))
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.05)  # a square would be 16


def brute_densities(node, body):
    """Definitions, by recursion: density, density sum and what they are made of, of a node and all below it."""
    below, chars, tags, link_chars, links = [], 0, 0, 0, 0
    for c in node.children:
        if isinstance(c, str):
            chars += len(re.sub(r"\s", "", c))
        else:
            got = brute_densities(c, body)
            below += got
            _, n, t, lc, k, _, _ = got[-1]
            chars, tags, link_chars, links = chars + n, tags + t + 1, link_chars + lc, links + k + (c.tag == "a")
    if node.tag == "a":
        link_chars = chars
    share = body[0] / body[1] if body[1] else 0
    own = 0.0
    if chars:
        lc, t, k = max(1, link_chars), max(1, tags), max(1, links)
        own = chars / t * math.log(chars / lc * t / k, math.log(chars / max(1, chars - link_chars) * lc + share * chars + math.e))
    near = {id(c): next(b for b in below if b[0] is c) for c in node.children if not isinstance(c, str)}
    total = sum(near[id(c)][5] if c.tag in html_density.BLOCK else near[id(c)][6] for c in node.children if not isinstance(c, str))
    return [*below, (node, chars, tags, link_chars, links, own, total)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<b>", "</b>", "some words of text ", "ä b ", "<section>", "</section>", "<li>"]), max_size=40))
def test_densities_equal_brute_force(parts):
    root = html_density.parse("<body>" + "".join(parts))
    html_density.clean(root)
    html_density.weigh(root)
    body = root.children[0]
    nodes = brute_densities(root, (body.link_chars, body.chars))
    for node, chars, tags, link_chars, links, own, total in nodes:
        assert (node.chars, node.tags, node.link_chars, node.links) == (chars, tags, link_chars, links)
        assert node.density == pytest.approx(own) and node.total == pytest.approx(total)
    best = max((n.total for n in html_density.preorder(body) if n is body or n.tag in html_density.BLOCK), default=0)
    chosen, threshold = html_density.chosen(root)
    inside = [m for n in chosen for m in html_density.preorder(n)]
    assert not chosen or best == 0 or any(n.total == best for n in inside) or body.total == best
    assert threshold <= body.density


def test_density_alone_finds_the_articles(spark):
    """With names and tags of menus and the like unasked, on all pages."""
    for r in table(spark, "pages").select("html").collect():
        assert html_density.extract(r["html"], named=False) == html_density.extract(r["html"]) == gold(r["html"])


def test_pages_of_clashing_names(spark):
    rows = [(k, page, "t", 1.0, "c") for k, page in enumerate([None, "", PAGE, PAGE, "plain"])]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars double, density string")
    got = pages.select("page_id", "text", html_density.main_text(F.col("html")).alias("found")).collect()
    assert [r["found"] for r in sorted(got)] == ["", "", html_density.extract(PAGE), html_density.extract(PAGE), "plain"]


def gold(page):
    """The article's text between its tags, as the pages of the table have it."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", found)]
    return "\n".join(x for x in parts if x)


def test_pages_of_the_table(spark):
    """Brute force over whole pages."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", html_density.main_text(F.col("html")).alias("text")).collect():
        assert r["text"] == gold(r["html"])
    assert pages.limit(0).select(html_density.main_text(F.col("html"))).count() == 0


# --- classifiers -----------------------------------------------------------------------------------


def test_ftrl_separates_and_keeps_zeros():
    rng = np.random.default_rng(1)
    model = Leader(50, 1, rate=0.5, l1=1.0)
    at = np.arange(50)
    for _ in range(600):
        x = rng.standard_normal(50)
        model.learn(at, x, np.array([float(x[0] - x[1] > 0)]))
    w = model.weights()[:, 0]
    assert w[0] > 0.3 and w[1] < -0.3 and (w[2:] == 0).sum() > 10
    assert activate(np.array([[1.0, 1.0, 1.0]])) == pytest.approx(1 / 3)


class BruteLeader:
    """FTRL-proximal, a number at a time."""

    def __init__(self, outputs, rate, beta, l1, l2):
        self.z, self.n, self.outputs = {}, {}, outputs
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weight(self, i, k):
        z, n = self.z.get((i, k), 0.0), self.n.get((i, k), 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return (math.copysign(self.l1, z) - z) / ((self.beta + math.sqrt(n)) / self.rate + self.l2)

    def raw(self, row):
        return [sum(x * self.weight(i, k) for i, x in row.items()) for k in range(self.outputs)]

    def learn(self, row, wanted, bias=0.0):
        w = {(i, k): self.weight(i, k) for i in row for k in range(self.outputs)}
        p = brute_softmax([r + bias for r in self.raw(row)])
        for i, x in row.items():
            for k in range(self.outputs):
                g = (p[k] - wanted[k]) * x
                n = self.n.get((i, k), 0.0)
                self.z[i, k] = self.z.get((i, k), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.rate * w[i, k]
                self.n[i, k] = n + g * g


def brute_softmax(raw):
    if len(raw) == 1:
        return [1 / (1 + math.exp(-raw[0]))]
    e = [math.exp(r - max(raw)) for r in raw]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("outputs", [1, 3])
def test_ftrl_equals_brute_force(outputs):
    rng = np.random.default_rng(outputs)
    ours, brute = Leader(30, outputs, 0.7, 1.3, 0.05, 0.1), BruteLeader(outputs, 0.7, 1.3, 0.05, 0.1)
    for _ in range(120):
        at = np.sort(rng.choice(30, 6, replace=False))
        x, wanted = rng.standard_normal(6), rng.dirichlet(np.ones(outputs)) if outputs > 1 else rng.integers(0, 2, 1).astype(float)
        ours.learn(at, x, wanted, 0.2)
        brute.learn(dict(zip(at.tolist(), x.tolist(), strict=True)), wanted, 0.2)
    got = ours.weights()
    assert all(got[i, k] == pytest.approx(brute.weight(i, k), abs=1e-9) for i in range(30) for k in range(outputs)) and (got == 0).any()


def brute_grams(text, s=quality_model.Settings()):
    """Counts of hashed word n-grams, by whole numbers."""
    top, found = 1 << 64, {}
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    h = [zlib.crc32(w) for w in words]
    grams = [*h, *((a * 0x9E3779B97F4A7C15 + b) % top for a, b in zip(h, h[1:], strict=False)), *(g for g in (1, 2) for a, b in zip(h, h[g:], strict=False) if a == b)]
    for g in grams:
        at = g * 0xD6E8FEB86659FD93 % top >> (64 - s.bits)
        found[at] = found.get(at, 0) + 1
    return found


def brute_row(text):
    found = brute_grams(text)
    norm = math.sqrt(sum(n * n for n in found.values())) or 1.0
    return {i: n / norm for i, n in found.items()}


def test_quality_query_equals_brute_force(spark):
    """The whole query: grams, sample, updates, scores."""
    from pathval.llm.queries import op5_quality_classifier

    sf, s = "/root/testdata/sf0.001", quality_model.Settings()
    docs = table(spark, "documents", "sf0.001")
    rows = docs.join(table(spark, "labels", "sf0.001"), "doc_id").where("quality in (0, 1)").select("doc_id", "text", "quality", F.xxhash64("text", F.col("quality")).alias("turn")).collect()
    use = sorted((r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5), key=lambda r: r["turn"])
    good = sum(r["quality"] for r in use)
    bias, brute = math.log((good + 1) / (len(use) - good + 1)), BruteLeader(1, s.rate, 1.0, s.l1, s.l2)
    grams = [brute_row(r["text"] or "") for r in use]
    for _ in range(s.epochs):
        for r, row in zip(use, grams, strict=True):
            brute.learn(row, [r["quality"]], bias)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = op5_quality_classifier(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        score = brute_softmax([brute.raw(brute_row(texts[r["doc_id"]] or ""))[0] + bias])[0]
        assert r["score"] == pytest.approx(score, abs=2e-4) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def brute_tfidf(text, seen, s):
    """Sublinear counts of hashed character n-grams by inverse document frequency, of length 1."""
    found = {}
    for i in brute_characters(text, s):
        found[i] = found.get(i, 0) + 1
    x = {i: (1 + math.log(n)) * (math.log((1 + seen["all"]) / (1 + seen.get(i, 0))) + 1) for i, n in found.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {i: v / norm for i, v in x.items()}


def brute_characters(text, s):
    points, top = [ord(c) for c in text.lower()], 1 << 32
    for n in range(1, s.order + 1):
        for k in range(len(points) - n + 1):
            g = points[k] + 1
            for p in points[k + 1 : k + n]:
                g = (g * 0x01000193 + p) % top
            yield g * 0x9E3779B1 % top >> (32 - s.bits)


def test_language_model_equals_brute_force():
    """Frequencies, weights, elastic net, temperature and predictions."""
    rng = np.random.default_rng(8)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["lo", "mi", "tu"], "cc": ["tu", "ré", "ka"]}
    rows = [(" ".join("".join(rng.choice(sounds[x], 3)) for _ in range(5)), x) for x in sounds for _ in range(12)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    s = language_id.Settings(bits=9)
    texts, langs = [t for t, _ in rows], [x for _, x in rows]
    seen = {"all": len(texts)}
    for t in texts:
        for i in set(brute_characters(t, s)):
            seen[i] = seen.get(i, 0) + 1
    made = [(brute_tfidf(t, seen, s), [float(x == y) for y in sorted(sounds)]) for t, x in rows]
    brute = BruteLeader(3, s.rate, 1.0, s.l1, s.l2)
    for _ in range(s.epochs):
        for k, (row, wanted) in enumerate(made):
            if k % 10 >= s.held_back:
                brute.learn(row, wanted)
    back = [(brute.raw(row), wanted) for k, (row, wanted) in enumerate(made) if k % 10 < s.held_back]
    loss = lambda t: -sum(math.log(max(1e-12, sum(p * w for p, w in zip(brute_softmax([r / t for r in raw]), wanted, strict=True)))) for raw, wanted in back)
    best = min(np.geomspace(0.05, 20, 241).tolist(), key=loss)
    m = language_id.train(texts, langs, s)
    assert m.languages == tuple(sorted(sounds)) and m.temperature == pytest.approx(best)
    for t in [*texts, "kalo", "tu ré", "Zzz"]:
        p = brute_softmax([r / best for r in brute.raw(brute_tfidf(t, seen, s))])
        lang, score = language_id.predict(t, m, s)
        assert score == pytest.approx(max(p), abs=1e-6) and lang == sorted(sounds)[p.index(max(p))]


def table(spark, name, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_quality_on_held_out_rows(spark):
    from pathval.llm.queries import op5_quality_classifier

    out = op5_quality_classifier(spark, "/root/testdata/sf0.1").join(table(spark, "labels", "sf0.1"), "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    assert (out["quality"] == out["predicted"]).mean() > 0.97
    assert (out[out["quality"] == 1]["predicted"] == 1).mean() > 0.98
    assert out["score"].between(0, 1).all()


def test_quality_learns_nothing_from_held_out_rows(spark):
    from pathval.llm.queries import quality_weights

    docs, labels = table(spark, "documents"), table(spark, "labels")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_weights(docs, labels) == quality_weights(docs, other)).all()


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(8, 1), (9, 0), (None, 1), (4, None), (4, 1)], "doc_id long, label int")
    w = quality_model.fit(quality_model.sampled(odd, labels))
    out = odd.select(quality_model.score(F.col("text"), w, spark).alias("s")).collect()
    assert len(out) == len(ODD) and all(0 <= r["s"] <= 1 for r in out)
    none = quality_model.fit(quality_model.sampled(odd, labels.limit(0)))
    assert {r["s"] for r in odd.select(quality_model.score(F.col("text"), none, spark).alias("s")).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    from pathval.llm.queries import op6_language_id

    out = op6_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_language_sample_keeps_every_language_and_counts_all_rows(spark):
    rows = [(f"word{k} of {lang}", lang) for lang in ("aa", "bb", "cc", "dd", "ee") for k in range(200)] + [("one text again", "zz")] * 200
    s = language_id.Settings(bits=8, sample=100, most=120)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    got = {r["lang"]: r["count"] for r in language_id.sampled(docs, s).groupBy("lang").count().collect()}
    assert set(got) == {"aa", "bb", "cc", "dd", "ee", "zz"} and all(5 < n < 45 for n in got.values())
    m = language_id.fit(docs, s)
    seen = language_id.frequencies([t for t, _ in rows], s)
    assert set(m.languages) == set(got) and np.allclose(m.idf, np.log(1201 / (1 + seen[:-1])) + 1, atol=1e-5)


def test_language_of_odd_rows(spark, odd):
    docs = spark.createDataFrame([("the house and the man", "en"), ("das haus und der mann", "de"), (None, "en"), ("x", None), ("123", "fr")] * 6, "text string, lang string")
    m = language_id.fit(docs)
    assert m.languages == ("de", "en")
    got = [r["l"] for r in odd.select(language_id.language(F.col("text"), m, spark).alias("l")).collect()]
    assert [g["lang_pred"] for g in got[:3]] == ["und"] * 3 and all(0 <= g["score"] <= 1 for g in got)
    assert language_id.predict("und der mann", m)[0] == "de" and language_id.predict("12 34", m) == ("und", 0.0)
    empty = language_id.fit(docs.limit(0))
    assert language_id.predict("the house", empty) == ("und", 0.0)
    alone = language_id.fit(docs.where("lang = 'en'"))
    assert language_id.predict("anything", alone) == ("en", 1.0)


# --- fingerprints -------------------------------------------------------------------------------------


def brute_phrases(data):
    known, out, part = set(), [], b""
    for k in range(len(data)):
        part += data[k : k + 1]
        if part not in known:
            known.add(part)
            out.append(part)
            part = b""
    return [*out, part] if part else out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé", max_size=60), st.text(alphabet="abc", max_size=30))
def test_parses_equal_brute_force(text, other):
    assert lz_fingerprint.phrases(text.encode())[0] == brute_phrases(text.encode())
    own, edit, edited = lz_fingerprint.both(text, other)
    n = len(text) // 4
    assert edited == text[: len(text) - n] + other[:n]
    assert (own == lz_fingerprint.signature(brute_phrases(text.encode()))).all()
    assert (edit == lz_fingerprint.signature(brute_phrases(edited.encode()))).all()


@pytest.mark.parametrize("rows", [1, 3, 7, 10_000])
def test_fingerprints_of_odd_rows(monkeypatch, odd, rows):
    """Partitions of any size give the neighbours that one sorted list has."""
    monkeypatch.setattr(lz_fingerprint, "ROWS_A_PARTITION", rows)
    got = lz_fingerprint.fingerprints(odd).toPandas()
    ids = [1, 2, 3, 4, 5, 6, None, 8, 9, 9]
    order = sorted(zip(ids, [t or "" for t in ODD], strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        own, edit, edited = lz_fingerprint.both(text, after)
        nxt = lz_fingerprint.signature(brute_phrases(after.encode()))
        want.append((doc or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.written(own), lz_fingerprint.likeness(own, edit), lz_fingerprint.likeness(own, nxt)))
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next"]
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(want)
    assert lz_fingerprint.fingerprints(odd.limit(0)).count() == 0


def test_fingerprints_of_clashing_names(spark):
    names = ["part", "key", "fingerprint", "pv_order", "pv_tie", "late", "first"]
    rows = [(k, t, *names) for k, t in enumerate(["one text", None, "", "one text", "ä" * 50])]
    got = lz_fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))).toPandas()
    assert sorted(got["doc_id"]) == list(range(5)) and got.set_index("doc_id")["fingerprint"][0] == got.set_index("doc_id")["fingerprint"][3]


def test_fingerprints_tell_edits_from_neighbours(spark):
    out = lz_fingerprint.fingerprints(table(spark, "documents")).toPandas()
    assert (out["near_edited"] > out["near_next"]).mean() > 0.98
    assert zlib.crc32(b"a") == 3904355907  # the phrase hash does not depend on the process
