import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.unicode import casefold, python_trim, semantic_text, unicode_trim
from lodestone.functions.validators import accepts
from lodestone.plans.schema import Validator

# Text, splitter, cap, prefix; words; offsets in the original with coverage.
CASES = [
    ("", "whitespace", None, (), ["."], [(0, 0, "synthetic_only")]),
    ("visit https://example.com/path", "whitespace", None, (), ["visit", "https://example.com/path."], [(0, 5, "original"), (6, 30, "original_with_synthetic_suffix")]),
    ("one two three", "whitespace", 2, ("(", "kind:", "Red", ")"), ["one", "two"], [(0, 3, "original"), (4, 7, "original")]),
    ("Alpha βeta!", "whitespace", None, (), ["alpha", "βeta", "!"], [(0, 5, "original"), (6, 11, "original"), (11, 12, "original")]),
    ("a@b.co,x", "char", None, (), ["a@b.co", ",", "x."], [(0, 6, "original"), (6, 7, "original"), (7, 8, "original_with_synthetic_suffix")]),
    ("mail Me@Example.COM and @handle ", "whitespace", None, (), ["mail", "me@example.com", "and", "@handle", "."], [(0, 4, "original"), (5, 19, "original"), (20, 23, "original"), (24, 31, "original"), (32, 32, "synthetic_only")]),
]


@pytest.mark.parametrize("text, splitter, cap, prefix, words, offsets", CASES)
def test_prepared(text, splitter, cap, prefix, words, offsets):
    got = T.prepared(text, splitter, cap, prefix)
    assert got["words"] == words and got["offsets"] == offsets and got["tokens"] == [*prefix, *words]


def test_words_and_offsets_agree(spark):
    texts = ["", "Well-known snake_case 12_3 x", "€5, naïve—café", "http://a.b/c?d www.x.org me@x.org @me", "a\tb\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for splitter in ("whitespace", "char"):
        rows = T.with_offsets(df, splitter=splitter).withColumn("w", T.words("text", splitter)).collect()
        for r in rows:
            assert [t["token"] for t in r["tokens"]] == list(r["w"])
            for t in r["tokens"]:
                assert r["text"].encode()[t["start"] : t["end"]].decode() == t["token"] == r["text"][t["char_start"] : t["char_end"]]
    assert T.with_offsets(spark.createDataFrame([(None,)], "text string")).collect()[0]["tokens"] is None


def test_punctuation(spark):
    df = spark.createDataFrame([("a",), ("a.",), ("a. ",), ("",), ("a?\n",)], "text string")
    assert [r[0] for r in df.select(T.punctuated("text")).collect()] == ["a.", "a.", "a. .", ".", "a?\n."]


def test_unicode(spark):
    df = spark.createDataFrame([("\x1c Straße  DER x ",)], "t string")
    r = df.select(casefold(F.col("t")), semantic_text(F.col("t")), unicode_trim(F.col("t")), python_trim(F.col("t"))).collect()[0]
    assert r[1] == "strasse der x" and r[2].startswith("\x1c") and r[3] == "Straße  DER x"


def test_validators(spark):
    df = spark.createDataFrame([("ab",), ("a",), ("",), ("xaby",)], "t string")
    check = lambda v: [r[0] for r in df.select(accepts(F.col("t"), v)).collect()]
    assert check(Validator("a|ab")) == [False, True, False, False]
    assert check(Validator("A|AB", "partial")) == [True, True, False, True]
    assert check(Validator("a*")) == [False, True, True, False]
    assert check(Validator("b", "partial", exclude=True)) == [False, True, True, False]
    assert check(Validator("A", case_insensitive=False)) == [False] * 4
