"""Spans of which few are kept are scored and ranked as arrays of a few texts and never become rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import grids
from lodestone.operators import relations
from lodestone.operators.spans import grid


def plan_of(name, spark, sf):
    return queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rel_pairs_topk", "rel_threshold", "rel_canonical", "rel_exact_dedup", "rel_semantic_dedup", "rel_deduplicated"])
def test_arguments_are_no_rows(spark, sf, name):
    plan = plan_of(name, spark, sf)
    assert "explode(sequence" not in plan and "Join" not in plan


SCORES = (-40.0, -1.0, -0.5, 0.25, 2.0, 16.0, 38.0, 39.0, 39.5)


@pytest.mark.parametrize("places", [7, grids.PLACES])
def test_pairs_in_row_as_of_rows(spark, monkeypatch, places):
    """Many equal scores and equal probabilities of unlike scores, texts longer than what is scored at once."""
    monkeypatch.setattr(grids, "PLACES", places)
    docs = spark.createDataFrame([(d, n) for d, n in enumerate((0, 1, 5, 40, 0, 13, 2))], "doc_id long, n_words int")
    number = lambda d, s, e, q: (d * 7 + s * s * 5 + e * 3 + q) % len(SCORES)
    scores = lambda d, s, e, q: np.array(SCORES)[number(d, s, e, q)]
    sides = {"a": (0, 1), "b": (2, 2)}
    spans = grid(docs, width=3).withColumn("q", F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(side).alias("side"), F.lit(q).alias("query")) for r, qs in sides.items() for side, q in zip(("head", "tail"), qs))))).select("doc_id", "start", "end", "q.*")
    logit = F.element_at(F.array(*map(F.lit, SCORES)), (F.expr(f"(doc_id * 7 + start * start * 5 + end * 3 + query) % {len(SCORES)} + 1")).cast("int"))
    rows = spans.select("doc_id", "relation", "side", "start", "end", logit.alias("logit"), F.lit(0).alias("seq"))
    got = relations.propose_in_row(docs, sides, 3, scores, 6, 4, 9, {"b"})
    want = relations.propose_pairs(rows, 6, 4, 9, {"b"})
    columns = ["doc_id", "relation", "pair", "head_start", "head_end", "tail_start", "tail_end"]
    order = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert order(got) == order(want) and len(order(got)) > 50


def test_scores_that_are_not_finite():
    with pytest.raises(ValueError, match="doc_id 9 query_id 3"):
        grids.best_spans(np.array([8, 9]), np.array([2, 3]), 2, 3, lambda d, s, e, q: np.where(d == 9, np.nan, 0.5) + 0 * s + 0 * e, 4, 0.2)


def test_one_pass_as_each_step(spark):
    """Edges that are held, repeated and dominated, by all steps at once and one by one."""
    rng = random.Random(11)
    words = ["Red", "red", "straße", "STRASSE", "a", "b"]

    def mention():
        s = rng.randrange(6)
        e = s + rng.randint(1, 3)
        return (2 * s, 2 * e, s, e, " ".join(words[(s * 5 + k) % 6] for k in range(e - s)))

    rows = [(d, r, mention(), mention(), rng.choice([0.5, 0.75, 0.9]), i) for d in range(40) for r in "xy" for i in range(rng.randrange(14))]
    side = "struct<start:int,end:int,char_start:int,char_end:int,text:string>"
    edges = spark.createDataFrame(rows, f"doc_id long, relation string, head {side}, tail {side}, score double, seq int")
    each = relations.undominated(relations.semantic_distinct(relations.exact_distinct(relations.canonical_edges(edges).drop("alone"))))
    columns = ["doc_id", "relation", "head", "tail", "score"]
    order = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert order(relations.deduplicate_edges(edges)) == order(each) and len(order(each)) > 150


def test_words_are_encoded_once(monkeypatch):
    import pyarrow as pa
    import public_tokenizers

    from lodestone.functions import subwords

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(subwords, "_known", {})
    monkeypatch.setattr(subwords, "KEPT", 6)
    texts = [["red", "Straße", "", " ", "red"], None, [], ["x" * 40, "red", "漢字", "\U0001f600"], ["blue", "red"], ["one", "two", "red"]]
    rows = pa.array(texts, pa.list_(pa.string()))
    asked = []
    add = subwords.Known.add
    monkeypatch.setattr(subwords.Known, "add", lambda self, words: (asked.append(words), add(self, words)))
    for part in (rows, rows.slice(2, 3), rows.slice(3), rows):
        got = subwords.encode_lists(part, path).to_pylist()
        assert got == [None if w is None else subwords.encode_words(w, path) for w in part.to_pylist()]
    assert all(len(set(words)) == len(words) for words in asked) and sum(map(len, asked)) < 28  # of 14 words, three times over and in part


@pytest.mark.parametrize("name", ["shared_candidates", "engine_entities", "engine_fields", "engine_edges", "rec_choice_values", "rec_formatted", "engine_extract", "struct_instances"])
def test_words_are_not_shuffled_and_places_are_no_rows(spark, sf, name):
    """Texts are dealt without their words, the pool in arrays; neither boundaries nor spans of all a text's words become rows."""
    plan = plan_of(name, spark, sf)
    assert "char_start" not in "".join(x for x in plan.splitlines() if "Exchange" in x) and "token:" not in plan
    assert "sequence(0, n_words" not in plan


@pytest.mark.parametrize("prefix", [0, 3])
def test_pool_in_row_as_of_rows(spark, monkeypatch, prefix):
    from lodestone.operators import pool
    from lodestone.plans.prompts import Query
    from lodestone.providers.hashing import HashingProvider

    monkeypatch.setattr(grids, "PLACES", 11)
    docs = spark.createDataFrame([(d, n + prefix, prefix) for d, n in enumerate((0, 1, 5, 70, 0, 13, 2))], "doc_id long, n_words int, prefix_words int")
    queries, config = [Query(i, "entity", "entities", str(i), None) for i in (2, 5, 7)], pool.PoolConfig(6, 9, 2)
    got = pool.candidates_in_row(docs, F.col("prefix_words"), [2, 5, 7], HashingProvider().boundary_array, config).select("doc_id", F.inline("_k"))
    want = pool.candidate_pool(HashingProvider().boundary_logits(docs, queries), config).select("doc_id", "slot", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30


@pytest.mark.parametrize("architecture", ["span", "boundary"])
def test_providers_of_rows_give_the_same(spark, architecture):
    """The engine with a provider that reads words and has no arrays, and with one that scores arrays."""
    from lodestone.engine import Engine
    from lodestone.plans.schema import SchemaBuilder
    from lodestone.providers.base import FAMILIES, Provider
    from lodestone.providers.hashing import HashingProvider
    from lodestone.sources.config import ModelConfig

    class Rows(Provider):
        def __init__(self):
            for f in FAMILIES:
                setattr(self, f, getattr(HashingProvider(3), f))

    rng = random.Random(2)
    words = ["a　b", "x@y.org", "naïve", "漢字", "c \x1c d", "red.", "BLUE", "www.q", "é"]
    docs = spark.createDataFrame([(d, None if d == 3 else " ".join(rng.choice(words) for _ in range(n))) for d, n in enumerate((0, 1, 5, 3, 40, 13, 2, 25))], "doc_id long, text string")
    schema = SchemaBuilder().structure("event", ["who::str", "kind::[red|blue]"]).entities("person").relation("knows").build()
    config = ModelConfig(architecture=architecture, max_len=20) if architecture == "boundary" else ModelConfig()
    told = [sorted(map(str, Engine(p, config).extract(docs, schema, 0.6, True, True).collect())) for p in (Rows(), HashingProvider(3))]
    assert told[0] == told[1] and sum("confidence" in x for x in told[0]) > 4
