"""Words are split once and spans are told in the row of their text: nothing but texts is shuffled, nothing is joined."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions.text import with_offsets, with_places
from lodestone.functions.unicode import UNICODE_SPACES, ascii_lower
from lodestone.operators import overlap, spans
from lodestone.sources.readers import documents

PIECES = ["a", "Zo", "é", "ß_", "-", "--", "_", ".", "@", "@me", "x@y.org", "www.", "WWW.q", "http://", "HTTPS://a.b", "7", "\u0663", "\u6f22\u5b57", "e\u0301", "\U0001d4b3", "\U0001f600", " ", " ", " ", "\x0b", "\x1d", "\n", "\u00a0", "\u2003", "\u2028"]
ODD = [None, "", " ", "\n", "-", "a-b", "-a-", "a--b", "a- b", "a_b-c", "é-", "\U0001d4b3-\U0001d4b3", "a\x00b", "\u00a0a\u00a0"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = ODD + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1).cache()


def test_places_are_those_of_words(texts):
    both = with_places(with_offsets(texts.withColumn("text", F.coalesce("text", F.lit("")))))
    sides = ("start", "end", "char_start", "char_end")
    for r in both.collect():
        assert [tuple(t[s] for s in sides) for t in r["tokens"]] == list(zip(*(r["places"][s] for s in sides))), r["text"]


def test_placed_as_located(spark, texts):
    told = spans.with_places(texts)
    some = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 1), (1, 4), (2, 2), (3, 1), (5, 40), (-1, 1), (7, 9))))
    each = lambda docs: docs.withColumn("x", F.explode(some)).select("*", "x.*").drop("x")
    columns = ["doc_id", "start", "end", "byte_start", "byte_end", "char_start", "char_end", "surface"]
    got = spans.placed(each(told)).select(*columns).collect()
    want = spans.located(each(texts.select("doc_id")), documents(texts)).select(*columns).collect()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want) and sum(r["surface"] is None for r in got) > 900


def test_first_look_at_logits_drops_nothing(spark):
    rows = spark.range(4000).select(((F.col("id") - 2000) / 400).alias("logit")).union(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "logit double"))
    for limit in (0.0, 0.3, 0.5, 0.99, 1.0):
        for temperature in (1.0, 1.7):
            few = spans.above_threshold(rows, limit, temperature).count()
            assert few == spans.above_threshold(rows, limit, temperature, F.lit(limit)).count()


def test_longest_of_equal_coordinates(spark):
    rows = [(1, 0.5, 0, 2, "b"), (1, 0.9, 0, 2, "c"), (1, 0.9, 0, 2, "a"), (1, 0.99, 1, 2, "d"), (1, 0.1, 1, 4, "e"), (2, 0.1, 1, 2, "f")]
    got = overlap.resolve(spark.createDataFrame(rows, "doc_id long, confidence double, start int, end int, at string"), "longest", ["doc_id"], ["at"])
    assert sorted(r["at"] for r in got.collect()) == ["a", "e", "f"]


def test_unicode_helpers(spark):
    assert all(c.isspace() for c in UNICODE_SPACES)
    got = spark.createDataFrame([("AbÉ",), ("İA",), ("aZ[",), ("",), (None,)], "t string").select(ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abÉ", "İa", "az[", "", None]


@pytest.mark.parametrize("name", ["ner_surfaces", "ner_dedup_surface", "ner_scalar_first", "ner_format_spans"])
def test_texts_are_split_once_and_not_joined(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan and "regexp" not in plan
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("REPARTITION_BY_NUM") == 1
    # One look at the logit comes before the exponentials.
    assert ">= 4.595" in plan
