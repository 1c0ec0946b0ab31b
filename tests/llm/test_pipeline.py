"""The pipeline against a brute-force version of its stages."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from lodestone.llm import byte_bpe
from lodestone.llm.common import table, without

from .test_operators import brute_components, brute_contamination


def test_pipeline(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "byte_level_bpe"]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    firsts = {i for i, _, c in brute_components(kept, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT) if i == c}
    kept = [(i, t) for i, t in kept if i in firsts]
    clean = {r[0] for r in brute_contamination(kept, items) if not r[5]}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {(i, len(ids := encoding.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in kept if i in clean}
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", "a", 1), (3, "some words here", None, "a", 1), (3, "some words here", None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == list(corpus_pipeline.COLUMNS) and stage(spark, docs.filter("false"), sf).count() == 0
        docs = out
    assert sorted(str(r["doc_id"]) for r in docs.collect()) in (["3"], [])


def test_jaccard_stage_takes_five_words_and_four_fifths(spark, sf):
    words = [f"w{i}" for i in range(44)]
    # Of 40 shingles of five words 33, 32 and 31 are left; of 41 of four words 34, 33 and 32, all under 0.85.
    for cut, kept in ((7, [1]), (8, [1]), (9, [1, 2])):
        rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(words[:-cut]), "en", "a", 0)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, sf).collect()) == kept


def test_stages_decide_on_rows(spark, sf):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    item = table(spark, sf, "benchmark").first()["text"]
    rows = [(1, long, "en", "a", 0), (1, other, "en", "a", 0), (2, other, "en", "a", 0), (None, long + " end", "en", "a", 0), (4, None, "en", "a", 0), (4, None, "en", "a", 0), (1, item, "en", "a", 0), (None, item, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.jaccard_stage(spark, docs, sf).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("1", long), ("1", other), ("4", ""), ("4", ""), ("1", item)])
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean) == sorted((str(r[0]), r[1] or "") for r in rows if r[1] != item)


def test_without_drops_exactly_the_keys(spark):
    rows = spark.range(300).selectExpr("id AS k", "concat('text ', id) AS text").union(spark.sql("SELECT 7L, 'again' UNION ALL SELECT 8L, 'again'"))
    even = spark.range(0, 300, 2).selectExpr("id AS k")
    for bits in (6, 26):  # a full filter, and one with room
        left = without(rows, even, "k", bits)
        assert left.columns == ["k", "text"]
        assert sorted(r["k"] for r in left.collect()) == sorted([*range(1, 300, 2), 7])
        assert without(rows, even.filter("false"), "k", bits).count() == 302 and without(rows.filter("false"), even, "k", bits).count() == 0
