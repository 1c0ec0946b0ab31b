"""Each operator on a small table of odd rows, on empty tables, and against brute force."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, fingerprints, hmm_scoring, html_extraction, jaccard_join, language_id, sharding, token_counts, warc
from lodestone.llm.ragged import TimeMajor, forward_backward

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, rid long, node string, label string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_rows():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "über", "naïve", "the", "of", "und", "der"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(3000)
    base = text(60)
    near = base.rsplit(" ", 2)[0]
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "123 ... !!", "en", "a"), (5, base, "en", "a"), (6, base.upper(), "en", "b"), (7, near, "en", "a"), (8, long, "de", "a"), (8, long, "de", "a"), (9, "one", "en", None), (10, "one two three four", "en", "b"), (None, base, None, "a"), (11, "x" * 5000, "en", "a"), (12, "日本 語 \U0001f600 é", "de", "a"), (13, text(200), "de", "b"), (14, text(90), "en", "b")]
    return [(i, t, y, s, 0, "clash", 5, "clash", "clash") for i, t, y, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


PAGES = "page_id long, url string, html string, payload binary, sha256 string"


def test_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    pages = spark.createDataFrame([], PAGES)
    for got in (
        decontamination.op1_decontamination(none, items),
        hmm_scoring.op2_hmm_scores(none),
        html_extraction.op3_html_extraction(pages),
        sharding.op4_sharding(none),
        language_id.op5_language_id(none),
        token_counts.op6_token_counts(none),
        fingerprints.op7_imatch_fingerprints(none),
        byte_bpe.op8_bpe_round_trip(none),
        jaccard_join.op9_jaccard_join(none),
        warc.op10_warc_archive(pages),
    ):
        assert got.count() == 0
    no_items = items.filter("false")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontamination.op1_decontamination(docs, no_items).first()["contaminated"] is False


# 1


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in found}:
                if tuple(w[i : i + n]) in found and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    ids |= found[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("filter_words", [50_000, 2])
def test_decontamination(spark, odd, filter_words, monkeypatch):
    monkeypatch.setattr(decontamination, "FILTER_WORDS", filter_words)  # 2: the bitmap takes over
    texts = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "one"), (2, texts[4][1][30:200]), (3, None), (4, "..."), (5, "no such words here"), (None, "日本 語"), (10, "One, TWO"), (10, "One, TWO"), (6, " ".join(texts[7][1].split()[100:140]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontamination.op1_decontamination(odd, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == brute_contamination(texts, items)


# 2


def test_forward_backward_brute_force():
    rng = np.random.default_rng(0)
    k = 3
    first, trans, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(5), k)
    seqs = [[0, 1, 2], [3], [4, 4, 1, 0]]
    tm = TimeMajor(np.array([len(s) for s in seqs]))
    gamma, pairs, scale = forward_backward(first, trans, emit.T[tm.lay(np.concatenate(seqs))].copy(), tm)
    want_pairs, want_gamma = np.zeros((k, k)), []
    for total, s in zip(tm.sums(np.log(scale)), seqs, strict=True):
        p_all, g, x = 0.0, np.zeros((len(s), k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=len(s)):
            p = first[path[0]] * emit[path[0], s[0]]
            for i in range(1, len(s)):
                p *= trans[path[i - 1], path[i]] * emit[path[i], s[i]]
            p_all += p
            for i, j in enumerate(path):
                g[i, j] += p
            for a, b in itertools.pairwise(path):
                x[a, b] += p
        assert np.isclose(total, np.log(p_all))
        want_pairs += x / p_all
        want_gamma.append(g / p_all)
    assert np.allclose(pairs, want_pairs) and np.allclose(gamma[tm.place], np.concatenate(want_gamma))


def test_hmm_counts_are_those_of_uncut_texts(monkeypatch):
    rng = np.random.default_rng(1)
    model = hmm_scoring.start(rng.integers(1, 50, 30).astype(float))
    model.first = rng.dirichlet(np.ones(hmm_scoring.STATES))
    model.trans = rng.dirichlet(np.ones(hmm_scoring.STATES), hmm_scoring.STATES)
    seqs = [rng.integers(0, 30, n).astype(np.int16) for n in (1, 7, 8, 9, 50, 16, 3, 17, 200)]
    monkeypatch.setattr(hmm_scoring, "BLOCK", 1000)
    whole = hmm_scoring.expected_counts(seqs, model)
    for block in (1, 2, 8):
        monkeypatch.setattr(hmm_scoring, "BLOCK", block)
        for a, b in zip(whole, hmm_scoring.expected_counts(seqs, model), strict=True):
            assert np.allclose(a, b, atol=2e-3)
    assert np.isclose(whole[0].sum(), len(seqs), atol=1e-3) and np.isclose(whole[1].sum(), sum(len(s) - 1 for s in seqs), atol=1e-2)


def test_hmm_scores(odd, monkeypatch):
    monkeypatch.setattr(hmm_scoring, "LEXICON", 5)  # other words go through the join
    monkeypatch.setattr(hmm_scoring, "ROUNDS", 2)
    rows = odd_rows()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    got = hmm_scoring.op2_hmm_scores(odd).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], held(r[0]), len(words(r[1])), sum(w in counts for w in words(r[1])), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r[1])), 4)) for r in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_hmm_model_is_a_distribution(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = hmm_scoring.op2_hmm_scores(docs).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]  # latent states tell more than frequencies
    model = hmm_scoring.start(np.arange(1.0, 20.0))
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.trans.sum(1), 1)
    seqs = [np.array([1, 2, 3, 4], np.int16), np.array([5], np.int16)]
    once = hmm_scoring.sequence_scores(seqs, model)
    assert np.allclose(once, [hmm_scoring.sequence_scores([s], model)[0] for s in seqs])


def test_hmm_shared_classes_hold_all_their_words(spark):
    counts = [(b"", 1)] + [(f"w{i}".encode(), 10_000 - i) for i in range(hmm_scoring.OWN_CLASSES + 30)]
    found = hmm_scoring.lexicon_of(spark.createDataFrame(counts, "word binary, c long"))
    classes = found.arrays()[0][: len(found.words)]
    for k in set(classes[classes >= hmm_scoring.OWN_CLASSES].tolist()):
        assert found.class_tokens[k] == found.counts[classes == k].sum() and found.class_words[k] == (classes == k).sum()


# 3


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><a href=/>Home page name</a></header>
<div id="cookie-notice">We use cookies here please accept</div><nav><ul><li><a>a b c</a></ul></nav><main><div class="post">
<h1>Head&nbsp;line &amp; more</h1><p>First para of <em>text</em>ual things with many words in it</p><div class="ad-box">buy now cheap</div>
<p>Second<br>para has words too<form><input><label>Email</label></form><p>third &lt;x&gt; <script>if(a<b){}</script>end</div>
<section class="comments"><article class=comment><p>Great post! i really liked it very much and so on</article></section></main>
<aside>Side bar text is here</aside><footer>(c)</footer>"""
UNMARKED = "<html><body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><h2>Title of it</h2><p>Some long paragraph of words that goes on and on for a while.</p><p>Another one with yet more words inside.</p></div><div><a href=1>x</a> | <a href=2>y</a></div></body>"


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", UNMARKED), (3, None, None), (4, "u", ""), (5, "u", "<p"), (6, "u", "a < b"), (None, "u", "<article>x <b>y</article><p>z"), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, None, "clash") for r in rows], PAGES)
    got = html_extraction.op3_html_extraction(pages).collect()
    text = {(r["page_id"]): r["text"] for r in got}
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == "Head line & more First para of textual things with many words in it Second para has words too third <x> end"
    assert text[2] == "Title of it Some long paragraph of words that goes on and on for a while. Another one with yet more words inside."
    assert (text[3], text[4], text[5], text[6], text[None]) == ("", "", "", "a < b", "x y")


def best_text_by_brute_force(page, weights):
    """The text of the region of greatest sum among all regions."""
    pieces = html_extraction.pieces_of(page, weights)
    marked = html_extraction.is_marked(pieces)
    scores = [html_extraction.score(p, marked, weights) for p in pieces]
    best, at = 0.0, (0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best + 1e-9:
                best, at = sum(scores[i:j]), (i, j)
    return " ".join("".join((" " if p.block else "") if p.tag else " " if p.boiler else p.text for p in pieces[slice(*at)]).split())


def test_html_by_brute_force():
    rng = random.Random(8)
    tags = ["p", "div", "a", "li", "b", "article", "nav", "form", "h2", "section class=comments", "div class=ad"]
    for _ in range(60):
        page = "".join(rng.choice(["one two three ", "word ", f"<{(t := rng.choice(tags))}>", f"</{t.split()[0]}>", "&amp;"]) for _ in range(rng.randint(0, 30)))
        weights = {f"words none text {w}": rng.uniform(-1, 2) for w in ("p", "div", "li", "")}
        assert html_extraction.main_text(page, weights) == best_text_by_brute_force(page, weights), page


@pytest.mark.parametrize(
    "frame",
    [
        '<div class="layout with-sidebar"><article>{}</article></div>',
        '<article class="post has-comments">{}</article>',
        '<article class="post ad-free">{}</article>',
        '<div class="page-container no-banner"><main>{}</main></div>',
        '<article class="search-result">{}</article>',
        "<form action=/x><article>{}</article></form>",
        '<div class="layout with-sidebar"><article class="has-comments">{}<section class="comments"><p>I liked it a lot too</p></section></article></div>',
        '<div class="page-container no-banner"><div class="share-wrap">{}</div></div>',
    ],
)
def test_html_wrappers_that_call_themselves_something(frame):
    words = [f"word{i}" for i in range(60)]
    body = "".join(f"<p>{' '.join(words[i : i + 20])}</p>" for i in range(0, 60, 20))
    page = f"<html><body><header>Site name</header><nav><a>Menu</a></nav>{frame.format(body)}<div class=cookie-notice>We use cookies</div><footer>End</footer></body></html>"
    assert html_extraction.main_text(page, {}) == " ".join(words)


SENTENCES = [" ".join(f"{w}{i}" for i in range(20)) for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta")]


@pytest.mark.parametrize("name", ["related-work", "share-price", "social-impact", "login-howto", "cookie-recipe", "menu-of-the-day", "notice-of-motion", "comment-on-ruling", "banner-image", "ad-2020", "promo-free"])
def test_html_sections_of_an_article_are_content_whatever_their_names_remind_of(name):
    first, second = ("".join(f"<p>{x}</p>" for x in part) for part in (SENTENCES[:3], SENTENCES[3:]))
    page = f"<body><nav><a>Menu</a></nav><article>{first}<section class={name}>{second}</section></article><footer>End</footer></body>"
    assert html_extraction.main_text(page, {}) == " ".join(SENTENCES)


@pytest.mark.parametrize("name", ["discussion", "responses", "comments", "comment-list", "reader-comments comments", "ad-300x250", "ad-1", "cookie-notice", "share-bar", "related-links"])
@pytest.mark.parametrize("frame", ["<div>{}</div>{}", "<main>{}{}</main>", "<article>{}</article>{}"])
def test_html_comments_adverts_and_notices_are_left_out(name, frame):
    body = "".join(f"<p>{x}</p>" for x in SENTENCES)
    readers = f'<div class="{name}">' + "".join(f"<div><b>Ann</b><p>{' '.join(f'said{i}' for i in range(40))}</p></div>" for _ in range(2)) + "</div>"
    page = f"<body><header>Site</header>{frame.format(body, readers)}<footer>End</footer></body>"
    assert html_extraction.main_text(page, {}) == " ".join(SENTENCES)


def test_html_names_are_learned(spark):
    """A name that labelled pages show outside articles only lowers its words where no article is marked; one that they show on content stays content though it reads like boilerplate."""
    body = "".join(f"<p>{x}</p>" for x in SENTENCES)
    strip = "<div class=zzstrip>" + " ".join(f"strip{i}" for i in range(60)) + "</div>"
    labelled = [(i, "u", f'<body>{strip}<article><div class="thread">{body}</div></article>{strip}</body>') for i in range(20)]
    unmarked = [(100, "u", f"<body><div class=own>{body}</div>{strip}</body>"), (101, "u", f'<body><article><p>{SENTENCES[0]}</p><div class="thread">{SENTENCES[1]}</div><p>{SENTENCES[2]}</p></article></body>')]
    pages = spark.createDataFrame([(*r, None, "x") for r in labelled + unmarked], PAGES)
    weights = html_extraction.learned_weights(pages)
    assert weights["name zzstrip"] < -1 < 1 < weights["name thread"]
    text = {r["page_id"]: r["text"] for r in html_extraction.op3_html_extraction(pages).collect()}
    assert text[100] == " ".join(SENTENCES) and text[101] == " ".join(SENTENCES[:3]) and all(text[i] == " ".join(SENTENCES) for i in range(20))


def test_html_pages_without_article(spark, sf):
    """Pages of the driver's with their article as a plain element, and a menu and footer as plain ones too: learned from the marked ones, the same text comes out."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    plain = lambda h: h.replace("<article>", '<div id="story">').replace("</article>", "</div>")
    marked = {r["page_id"]: r for r in pages.collect()}
    both = spark.createDataFrame([(k, r["url"], r["html"]) for k, r in marked.items()] + [(10_000 + k, r["url"], plain(r["html"])) for k, r in marked.items()], "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_extraction.extracted(both).collect()}
    assert all(text[k] == text[10_000 + k] for k in marked)


@pytest.mark.parametrize("unit", [".", "- ", "=", "<", "&", "&amp;", "<<a ", '<a "', "\u3000"])
def test_html_punctuation_takes_linear_time(unit):
    import time

    page = "<body><p>" + unit * (1_000_000 // len(unit)) + "</p><p>word</p></body>"
    began = time.process_time()
    html_extraction.main_text(page, {})
    assert time.process_time() - began < 3


def test_html_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<article>" + "<span>" * n + "<div class=x><p>" * n + "some words " * n + "</i>" * n + "</span>" * n + "</article>"
        began = time.process_time()
        assert html_extraction.main_text(page, {}) == "some words " * (n - 1) + "some words"
        return time.process_time() - began

    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_html_on_articles(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_extraction.op3_html_extraction(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_best_region():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.choice([-2, -1, 1, 2]) for _ in range(rng.randint(0, 8))]
        best = max([0.0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))])
        a, b = html_extraction.best_region(s)
        assert sum(s[a:b]) == best


# 4


def test_sharding(spark, odd, sf):
    got = sharding.op4_sharding(odd).collect()
    assert len(got) == len(odd_rows())
    by_shard = Counter(r["shard"] for r in got)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and set(by_shard) == set(range(8))
    for k, n in by_shard.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.op4_sharding(docs, 4).collect()
    for source, n in Counter(r["source"] for r in rows).items():
        for k in range(4):
            assert abs(sum(r["source"] == source and r["shard"] == k for r in rows) - n / 4) <= 1
    assert [sharding.hash_digits(n) for n in (0, 8000, 8001, 10**6, 10**12)] == [1, 1, 2, 3, 5]
    path = sharding.write_shards(docs, 4)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4


# 5


def test_language_id(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op5_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert got.filter("score < 0 OR score > 1").isEmpty()
    rows = {r["doc_id"]: r for r in language_id.op5_language_id(odd).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert rows[12]["lang_pred"] in ("de", "en")
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in language_id.op5_language_id(unlabelled).select("lang_pred").collect()} == {"und"}


def test_language_of_long_texts_only(spark):
    words = {"aa": ["kal", "tolu", "marni", "sepa"], "bb": ["ghurt", "wexl", "zhyk", "prrt"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[y]) for _ in range(3000)), y) for i in range(20) for y in words]
    got = language_id.op5_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter((i, y) for i, _, y in rows)


def test_language_by_brute_force(spark):
    """Each text's distribution by summing over all labellings of its words."""
    rng = random.Random(5)
    words = {"aa": ["kal", "tolu", "marni"], "bb": ["ghurt", "wexl", "tolu"], "cc": ["sepa", "wexl", "prrt"]}
    train = [(" ".join(rng.choice(words[y]) for _ in range(30)).encode(), y) for _ in range(20) for y in words]
    model = language_id.train(train, epochs=4)
    texts = [" ".join(rng.choice(sum(words.values(), [])) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.encode("text", "UTF-8"))
    got = {r["doc_id"]: r for r in language_id.predicted(docs, model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        emission = model.scores(language_id.words_of(text.encode())).astype(float)
        n, mass, total = len(emission), np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=n):
            weight = math.exp(model.start[path[0]] + sum(emission[k, y] for k, y in enumerate(path)) + sum(model.trans[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for y in path:
                mass[y] += weight / n
        mass /= total
        assert abs(got[i]["score"] - mass.max()) < 1e-3 and abs(mass[model.labels.index(got[i]["lang_pred"])] - mass.max()) < 1e-3


def test_language_pieces_cover_long_texts(spark):
    text = "".join(f"word{i} " for i in range(5000)) + "... " * 3000 + "end"
    docs = spark.createDataFrame([(1, text, "x"), (2, "!!!", "x"), (3, "é" * 9000, "y"), (4, None, "x"), (5, "z", None)], "doc_id long, text string, lang string")
    got = language_id.pieces(docs.select("doc_id", "lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))).collect()
    found = Counter(r["lang"] for r in got)
    cut = [text[i : i + language_id.PIECE_CHARS] for i in range(0, len(text), language_id.PIECE_CHARS)]
    assert found == {"x": sum(any(c.isalpha() for c in p) for p in cut), "y": 3} and found["x"] < len(cut)


def test_language_ties_and_very_long_words(spark):
    rows = [(0, "ab cd", "x"), (3, "ab cd", "y"), (6, "ab cd", "x"), (1, "ab cd", None), (4, "zz" * 40_000, None)]
    got = {r["doc_id"]: r for r in language_id.op5_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(0 < r["score"] <= 1 and r["lang_pred"] in ("x", "y") for r in got.values())


def test_code_switch(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train([(r["text"].encode(), r["lang"]) for r in docs.collect()])
    pick = lambda y: next(r["text"] for r in docs.filter(F.col("lang") == y).collect() if len(r["text"].split()) > 60).split()[:30]
    words = language_id.words_of(" ".join(pick("en") + pick("de")).encode())
    tm = TimeMajor(np.array([len(words)]))
    gamma, _ = language_id.posteriors(model, tm_scores := model.scores(words)[tm.lay(np.arange(len(words)))], tm)
    labels = [model.labels[i] for i in gamma.argmax(1)]
    assert labels[:20].count("en") > 15 and labels[-20:].count("de") > 15 and len(tm_scores) == len(words)


# 6 and 8


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("block", [3, 1 << 21])
def test_token_counts(odd, encoding, block):
    got = token_counts.count_tokens(odd, RANKS, public_tokenizers.PATTERN, 50_256, block)
    assert Counter(map(tuple, got.collect())) == Counter((r[0], len(encoding.encode_ordinary(r[1] or ""))) for r in odd_rows())


def test_foreign_token_file(spark, tmp_path):
    np.array([7, 7, 9, 9, 1], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    got = token_counts.count_file_tokens(spark, [f"file://{tmp_path}/{x}.bin" for x in "ab"], 9).collect()
    assert sorted((r["file"][-5], r["number"], r["n_tokens"]) for r in got) == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0)]


def test_bpe(odd, encoding):
    got = Counter(map(tuple, byte_bpe.op8_bpe_round_trip(odd).collect()))
    want = Counter()
    for r in odd_rows():
        ids = encoding.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in odd_rows())


def test_bpe_random(encoding):
    bpe, rng = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), random.Random(1)
    parts = ["a", "th", "e", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "23", "é", "中", "😀", "'s", "'ll", "—", "​", "٣", "-", "...", "\r\n", "ing", "Ω", "के"]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = bpe.encode(s)
        assert ids == encoding.encode_ordinary(s) and "".join(bpe.decode_stream(ids)) == s
    for n in (1, 2, 3, 500, 9000):  # longer than a window
        piece = bytes(rng.randrange(256) for _ in range(n))
        assert [bpe.transducer.bytes_of[i] for i in bpe.transducer.encode(piece)] == byte_bpe.merge_pairs(piece, bpe.transducer.ranks)
    runs = "=" * 9001 + " " * 5003 + "ab" * 4000 + "\n" * 300 + "the" * 2000
    assert bpe.encode(runs) == encoding.encode_ordinary(runs)


def test_bpe_drops_and_makes_states_again(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_STATES", 5)
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_PAIRS", 3)
    monkeypatch.setattr(byte_bpe, "WINDOW", 3)
    monkeypatch.setattr(byte_bpe, "DECODED", 2)
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    text = "Überraschenderweise anananas unbelievably 日本語 tokenisation =====------ 12345678 \U0001f600\U0001f600 x"
    ids = bpe.encode(text)
    assert ids == encoding.encode_ordinary(text) and "".join(bpe.decode_stream(ids)) == text


def test_bpe_all_characters(encoding):
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    characters = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for before, after in (("", " "), ("a", "1"), (" ", "'s")):
        for i in range(0, len(characters), 5000):
            text = "".join(f"{before}{c}{after}" for c in characters[i : i + 5000])
            assert bpe.encode(text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("junk", [b"\xff\xfea", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc3\x28", b"\xf5\x80", "aé中😀".encode()])
def test_utf8_machine(junk):
    for step in (1, 2, 3):
        machine = byte_bpe.Utf8Stream()
        assert "".join(machine.feed(junk[i : i + step]) for i in range(0, len(junk), step)) + machine.end() == junk.decode("utf-8", "replace")


# 7


def test_fingerprints(spark, odd, sf):
    rows = fingerprints.op7_imatch_fingerprints(odd).collect()
    assert len(rows) == len(odd_rows())
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    for i, r in enumerate(order):
        t, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[r[0], len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = fingerprints.op7_imatch_fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in found]) > 5 * np.mean([r["near_next"] for r in found])


def test_fingerprints_take_every_term_of_the_band(spark):
    # Each text has one term of the band, and only the row after it has that one too.
    rows = [(i, f"term{i // 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints.lexicon_of(docs.select(F.col("text").alias("t"))).count() == 100
    found = fingerprints.op7_imatch_fingerprints(docs).collect()
    assert all(r["fingerprint"].strip(".") for r in found) and len({r["fingerprint"] for r in found}) == 100
    assert all(r["near_next"] == (1.0 if r["doc_id"] % 2 == 0 else 0.0) for r in found)


def brute_fingerprints(rows):
    """Fingerprints by their definition, from Spark's hash of single values: the band, the subsets of each term, the hash of each subset's set."""
    from pyspark.sql import SparkSession

    terms_of = lambda t: set(re.split(r"\s+", t.lower(), flags=re.ASCII))
    n = len(rows)
    counted = Counter(w for t in rows for w in terms_of(t))
    band = {w for w, c in counted.items() if max(2, math.ceil(n * fingerprints.LEAST_SHARE)) <= c <= max(2, int(n * fingerprints.MOST_SHARE))}
    spark = SparkSession.getActiveSession()
    words = sorted({w for t in rows for w in terms_of(t)}) or [""]
    most = max(fingerprints.RATES)
    hashes = {r["w"]: [x & (2**64 - 1) for x in r["h"]] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"transform(sequence(0, {most}), k -> xxhash64(xxhash64(w), k)) AS h").collect()}
    whole = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in {*rows}], "t string").selectExpr("t", "lower(hex(xxhash64(t))) AS h").collect()}

    def of(text):
        own = terms_of(text) & band
        if not own:
            return "=" + whole[text]
        out = []
        for i, bits in enumerate(fingerprints.RATES):
            for j in range(fingerprints.SUBSETS):
                place = i * fingerprints.SUBSETS + j
                value = 0
                for w in own:
                    if all(hashes[w][k] >> place & 1 for k in range(1, bits + 1)):
                        value ^= hashes[w][0]
                out.append(f"{value:x}".zfill(6)[-6:] if value else "......")
        return "".join(out)

    def like(a, b):
        if a == b:
            return 1.0
        if "=" in (a[0], b[0]):
            return 0.0
        shares = []
        for i in range(len(fingerprints.RATES)):
            pairs = [(a[p : p + 6], b[p : p + 6]) for p in range(i * 96, i * 96 + 96, 6)]
            met = [(x, y) for x, y in pairs if x != "......" or y != "......"]
            shares.append((len(met), sum(x == y for x, y in met)))
        good = [s for s in shares if s[0] >= fingerprints.EVIDENCE] or [s for s in shares if s[0]]
        return max((s / e for e, s in good), default=0.0)

    return of, like


def test_fingerprints_by_definition(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += [texts[0], "!!!", "!!!", "", "zzz qqq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of, like = brute_fingerprints(texts)
    edited = {}
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited[i] = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
    want = {}
    from_all, _ = brute_fingerprints(texts)
    got = {r["doc_id"]: r for r in fingerprints.op7_imatch_fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        want[i] = from_all(t)
        assert got[i]["fingerprint"] == want[i], t
    for i in range(len(texts)):
        assert abs(got[i]["near_next"] - like(want[i], want[(i + 1) % len(texts)])) < 1e-12
        assert abs(got[i]["near_edited"] - like(want[i], got[i]["edited_fingerprint"])) < 1e-12
    assert got[121]["near_next"] == 1.0 and got[123]["near_next"] == 0.0  # equal texts without a term of the band; unlike ones


def test_fingerprints_of_null_and_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    rng = random.Random(13)
    rows = [(None, f"null {rng.random()}") for _ in range(300)] + [(i, f"low {i}") for i in range(300)] + [(10**15, "far"), (10**15 + 3, "farther"), (-(2**62), "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = fingerprints.bucketed(docs.select("doc_id", F.col("text").alias("t"))).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 40 and buckets.count() > 60
    got = fingerprints.op7_imatch_fingerprints(docs).filter("doc_id IS NOT NULL").collect()
    order = sorted(r for r in rows if r[0] is not None)
    edited = {r["doc_id"]: r["edited_sha256"] for r in got}
    for (i, t), (_, after) in zip(order, order[1:]):
        assert edited[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


# 9


def brute_components(rows, shingle=4, percent=85):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = {k: new if v == old else v for k, v in label.items()}
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in sets if label[k] == label[i] and rows[k][0] is not None]
        out[doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id] += 1
    return out


def test_jaccard(spark, odd, monkeypatch):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert Counter(map(tuple, jaccard_join.op9_jaccard_join(odd).collect())) == brute_components(rows)


@pytest.mark.parametrize(("small", "shingle", "percent"), [(8, 4, 85), (2, 4, 85), (2, 5, 80), (1, 1, 60)])
def test_jaccard_clusters(spark, monkeypatch, small, shingle, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # groups of several blocks
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "SLICE", 2000)
    rng = random.Random(4)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    for base in range(8):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 120]))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(words[:30] + [rng.choice(vocabulary) for _ in range(60)])))
    for n in (3, 10, 30, 60, 100):  # a passage that many share
        for _ in range(6):
            rows.append((len(rows), " ".join(passage + [rng.choice(vocabulary) for _ in range(n + rng.randrange(4))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.similarity_components(docs, shingle, percent).collect())) == brute_components(rows, shingle, percent)


def test_jaccard_signs_each_node_once(spark, monkeypatch):
    """2,000 copies of one text, near copies of it and a text of 4,000 words in 50 copies: signatures are those of different sets."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    long = " ".join(rng.choice(words) + str(i % 900) for i in range(4000))
    rows = [(i, " ".join(words)) for i in range(2000)] + [(2000 + i, " ".join(words[: 60 - i])) for i in range(6)] + [(3000 + i, long) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(docs).collect()}
    assert got == {i: (len({tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)}), 3000 if i >= 3000 else 0) for i, t in rows}
    t = docs.select("doc_id", F.encode("text", "UTF-8").alias("t"))
    texts = jaccard_join.described(t, 4, 85)
    for bits in (24, 7):  # a filter that nearly all nodes pass changes nothing
        monkeypatch.setattr(jaccard_join, "COPIED_BITS", bits)
        once, copied = jaccard_join.copied_once(t, texts, 4)
        met = jaccard_join.shared_signatures(t, once, copied, 4, 85)
        assert once.count() == once.select("node").distinct().count() <= 7
        assert met.count() == met.distinct().count() and met.agg(F.max("of_sig")).first()[0] <= 6


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_partenum_shares_a_signature(percent):
    rng = np.random.default_rng(5)
    for _ in range(500):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, n * (100 - percent) // 90) + 1))):
            b = np.delete(b, rng.integers(len(b))) if len(b) > 1 and rng.random() < 0.5 else np.union1d(b, rng.integers(0, 2**63, 1).astype(np.uint64))
        if len(b) != len(a) or (a != b).any():
            keys, owners, slack = jaccard_join.signatures([a, b], percent)
            first, second = keys[owners == 0], keys[owners == 1]
            shared = np.intersect1d(first, second)
            if jaccard_join.similar(a, b, percent):
                # More are shared in a band than either's slack there.
                assert any((shared & 1 == odd).sum() > slack[:, odd].max() >= -1 and (shared & 1 == odd).any() for odd in (0, 1))
            alone = jaccard_join.signatures([b], percent)
            assert (np.sort(alone[0]) == np.sort(second)).all() and (alone[2][0] == slack[1]).all()


def test_word_hashes():
    texts = ["", " a", "A b\x0bc\x0c", "x" * 5000 + " y", "\xa0 é\x1cz\t", "longerthaneightbytes longerthaneightbytez", "a a"]
    hashes, counts = jaccard_join.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().lower().split()]
    assert counts.sum() == len(words) and counts.tolist() == [len(t.encode().split()) for t in texts]
    assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))


# 10


def test_warc(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u\r\nv", "é"), (None, "u", "x"), (1, "u", "x"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, None, "clash") for r in rows], PAGES)
    got = warc.op10_warc_archive(pages).collect()
    assert len(got) == len(rows)
    sha1 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((t or "").encode()), sha1(t)) for i, _, t in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == sha1("x"))
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (2, "revisit", 1): 1, (None, "revisit", 1): 1}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 0} == {(3, "response", None), (4, "revisit", 3)}
    headers, payloads = warc.write_archive(pages)
    assert payloads.count() == 4 and headers.count() == len(rows)
    broken = payloads.withColumn("payload", F.lit(zlib.compress(b"other")))
    with pytest.raises(Exception, match="other bytes"):
        warc.read_archive(headers, broken).collect()


def test_hmm_batches_are_of_like_lengths():
    """Whole sequences, each once; a batch takes as many steps as its longest has tokens."""
    lengths = [1, 900, 2, 3, 800, 1, 700, 2] * 3
    seqs = [np.full(n, i, np.int16) for i, n in enumerate(lengths)]
    batches = list(hmm_scoring.batches_of(hmm_scoring.by_length(iter(seqs), 10**6), 1000))
    assert sorted(int(c[0]) for b in batches for c in b) == list(range(len(seqs))) and all(len(c) == lengths[c[0]] for b in batches for c in b)
    plain = list(hmm_scoring.batches_of(seqs, 1000))
    assert sum(max(map(len, b)) for b in batches) < sum(max(map(len, b)) for b in plain)
    assert [len(x) for x in hmm_scoring.by_length(iter(seqs[:4]), 3)] == [1, 900, 2, 3]
