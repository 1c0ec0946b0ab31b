import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import choices as C
from lodestone.operators import classify, pool, records, relations, spans
from lodestone.operators.assignment import assign
from lodestone.plans.schema import CompiledField
from lodestone.providers.base import MissingFamily, Provider
from lodestone.providers.table import TableProvider


def test_thresholds_are_inclusive_and_abstention_is_strict(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1, 0.0), (1, 1, 0, 1, 0.0)], "doc_id long, query_id int, start int, end int, logit double")
    assert spans.above_threshold(rows, 0.5).count() == 2
    nulls = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.1)], "doc_id long, query_id int, null_logit double")
    assert [r["query_id"] for r in spans.not_abstaining(rows, nulls, 0.5).collect()] == [0]


def test_bad_live_span_fails(spark):
    rows = spark.createDataFrame([(1, 3, 2, True, 5), (1, 9, 99, False, 5)], "doc_id long, start int, end int, mask boolean, n_words int")
    with pytest.raises(Exception, match="outside the text"):
        spans.unmasked(rows).collect()
    assert spans.unmasked(rows.filter("NOT mask")).count() == 0


def test_grid(spark):
    rows = spark.createDataFrame([(1, 3), (2, 0)], "doc_id long, n_words int")
    assert sorted((r["start"], r["end"]) for r in spans.grid(rows, width=2).collect()) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]


def test_assignment_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        r, c = rng.randint(1, 4), rng.randint(1, 5)
        cost = np.array([[rng.choice([-2.0, 0.0, 1.0, 2.5, 3.0]) for _ in range(c)] for _ in range(r)])
        got = assign(cost)
        n = min(r, c)
        want = min(sum(cost[a, b] for a, b in zip(p, q, strict=True)) for p in itertools.combinations(range(r), n) for q in itertools.permutations(range(c), n))
        assert len(got) == n and np.isclose(sum(cost[a, b] for a, b in got), want)
    assert assign(np.zeros((0, 3))) == []
    assert assign(np.array([[1, 2, 3], [np.inf] * 3, [3, 1, 2]])) == [(0, 0), (1, 2), (2, 1)]
    with pytest.raises(ValueError):
        assign(np.array([[np.nan]]))


def test_classification(spark):
    logits = spark.createDataFrame([(1, "t", i, label, x) for i, (label, x) in enumerate([("a", 2.0), ("b", 2.0), ("c", -3.0)])], "doc_id long, task string, label_idx int, label string, logit double")
    p = {r["label"]: r["probability"] for r in classify.distribution(logits).collect()}
    assert np.isclose(sum(p.values()), 1)
    scores = classify.distribution(logits, multi_label=True)
    assert classify.best_label(scores).first()["label"] == "a" and classify.best_label(scores, last_on_tie=True).first()["label"] == "b"
    assert classify.formatted(classify.select_labels(scores, 0.99), True, False).first()["result"] == ["a"]
    assert classify.formatted(classify.select_labels(scores, 0.99, by_probability=True), True, False).first()["result"] == ["b"]
    with pytest.raises(Exception, match="finite"):
        classify.distribution(logits.withColumn("logit", F.lit(float("nan")))).collect()


def test_pool(spark):
    # Two places that start or end well, a quota that saves the second query's best pair.
    rows = [(1, q, p, s, e, True, True) for q, p, s, e in [(0, 0, 5.0, -5.0), (0, 1, -5.0, 5.0), (0, 2, -5.0, -5.0), (1, 0, -6.0, -6.0), (1, 1, 1.0, -6.0), (1, 2, -6.0, 1.0)]]
    b = spark.createDataFrame(rows, "doc_id long, query_id int, pos int, start_logit double, end_logit double, mask boolean, query_mask boolean")
    got = pool.candidate_pool(b, pool.PoolConfig(3, 2, 1)).orderBy("slot").collect()
    assert [(r["slot"], r["start"], r["end"]) for r in got] == [(0, 0, 1), (1, 1, 2)]
    none = b.withColumn("query_mask", F.lit(False))
    assert pool.candidate_pool(none, pool.PoolConfig(3, 2, 1)).count() == 0


def mention(start, end, text):
    return (start, end, start, end, text)


EDGE = "doc_id long, relation string, head struct<start:int,end:int,char_start:int,char_end:int,text:string>, tail struct<start:int,end:int,char_start:int,char_end:int,text:string>, score double, seq int"


def test_relation_dedup(spark):
    text = "New York City is near New York and Albany"
    full, part, again, tail = mention(0, 13, "New York City"), mention(0, 8, "New York"), mention(22, 30, "New York"), mention(35, 41, "Albany")
    rows = spark.createDataFrame([(1, "r", part, tail, 0.9, 1), (1, "r", full, tail, 0.8, 2), (1, "r", again, tail, 0.7, 3)], EDGE)
    got = relations.deduplicate_edges(rows).collect()
    # The part is held by the full name, whose edge keeps the better score; the other mention's words are among its words.
    assert [(r["head"]["text"], r["score"]) for r in got] == [("New York City", 0.9)] and text[0:13] == "New York City"
    alone = spark.createDataFrame([(1, "r", part, tail, 0.9, 1)], EDGE)
    assert relations.deduplicate_edges(alone).first()["head"]["text"] == "New York"
    same = spark.createDataFrame([(1, "r", mention(0, 2, "AB"), tail, 0.5, 1), (1, "r", mention(30, 32, "ab"), tail, 0.5, 2)], EDGE)
    assert relations.deduplicate_edges(same).first()["head"]["start"] == 30  # closer to the tail


def test_choices():
    found = C.literal_mentions("Red, reddish RED é red", ["red", "x"])
    assert [(m["char_start"], m["start"]) for m in found] == [(0, 0), (13, 13), (19, 20)]
    assert C.present_choices(["Red", "Red", "blue"], ["(", "RED", "red"]) == [("Red", 1)]
    assert C.containing_tokens(["red"], ["red|", "x"]) == [("red", 0)]
    assert C.choice_of_surface("STRASSE", ["straße", "Strasse"]) == "Strasse"
    assert C.selected_choices([("a", 0.7), ("b", 0.7)], "str", 0.7) == [("a", 0.7)]
    assert C.span_choice([("a", 0.1)], 0) == "a" and C.span_choice([("a", 0.1)], 0.2) is None
    assert C.record_choice(["a"], "str", [("a", 0.9)], [], 0.5, True, True, []) == []
    assert C.record_choice(["a"], "str", [("a", 0.9)], [], 0.5, True, False, []) == [{"text": "a", "confidence": 0.9}]


def test_owned_mentions(spark):
    m = spark.createDataFrame([(1, c, 0, s, s + 1, s, s + 1) for c, s in [("a", 0), ("a", 12), ("b", 25), ("a", 27)]], "doc_id long, choice string, choice_idx int, start int, end int, char_start int, char_end int")
    anchors = spark.createDataFrame([(1, 0, 10, 10, 11), (1, 1, 20, 20, 21)], "doc_id long, record int, start int, anchor_char_start int, anchor_char_end int")
    owned = C.owned_mentions(m, anchors)
    assert sorted((r["record"], r["choice"], r["start"]) for r in owned.collect()) == [(0, "a", 0), (1, "a", 27), (1, "b", 25)]
    assert {r["record"]: (r["choice"], r["gap"]) for r in C.nearest_mentions(owned, anchors).collect()} == {0: ("a", 9), 1: ("b", 4)}


def test_exclusive_assignment(spark):
    logits = np.array([[0.0, 5.0, 4.0], [0.0, 5.0, -5.0]])
    # Both want the first candidate; together they do best if the first takes its second choice.
    assert [(r, c) for r, c, _ in records.exclusive_choice(logits, True, 0.0)] == [(0, 2), (1, 1)]
    rows = [(1, "s", "f", i, c, float(logits[i, c]), c - 1, c, i + 1) for i in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, structure string, field string, instance int, col int, logit double, start int, end int, order int")
    assert sorted((r["instance"], r["col"]) for r in records.exclusive_single_values(df, True, 0.0).collect()) == [(0, 2), (1, 1)]


def test_records(spark):
    objects = spark.createDataFrame([(1, "s", 0, 1.0, 5, 6), (1, "s", 1, 2.0, 2, 3), (1, "s", 2, -9.0, 0, 1)], "doc_id long, structure string, instance int, logit double, seed_start int, seed_end int")
    assigns = spark.createDataFrame([(1, "s", "v", i, c, x, c, c + 1) for i in range(3) for c, x in [(0, -5.0), (1, 3.0)]], "doc_id long, structure string, field string, instance int, col int, logit double, start int, end int")
    fields = [CompiledField(0, "a", "required_one", True), CompiledField(1, "v", "zero_or_more", False)]
    natural = records.decode_records(objects, assigns, fields, "natural", "a").collect()
    assert sorted({(r["record"], r["anchor_start"]) for r in natural}) == [(0, 2), (1, 5)]
    latent = records.decode_records(objects, assigns, fields[1:], "latent").collect()
    assert len(latent) == 1 and np.isclose(latent[0]["object_score"], 1 / (1 + np.exp(-2)))


def test_providers(spark):
    with pytest.raises(MissingFamily):
        Provider().span_logits(None, [])
    table = spark.createDataFrame([(1, 0, 0, 1, 0.5), (2, 0, 0, 1, 0.5)], "doc_id long, query_id int, start int, end int, logit double")
    given = TableProvider(span_logits=table).span_logits(spark.createDataFrame([(1,)], "doc_id long"), [])
    assert given.count() == 1
    with pytest.raises(ValueError):
        TableProvider(other=table)
