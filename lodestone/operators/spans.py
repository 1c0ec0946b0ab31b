"""Candidate spans and the gates they pass: grid, thresholds, abstention, masks, mapping to text.

Long form: (doc_id, query_id, start, end, logit), half-open word coordinates.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import probability
from ..functions.unicode import unicode_trim

SPAN_WIDTH = 8
#: How many parts of documents there are for each of the session's shuffle partitions: a text becomes thousands of spans after it.
PARTS = 4


def by_document(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs dealt by document into parts whose number grows with the session's shuffle partitions.

    Rows made of a document's row stay in its part, though Spark forgets that once a Python function has run: words are found before. All that is decided by document, or by more than the document, meets
    there, so that texts are shuffled before they are split into spans and the spans never. Frames that are dealt alike
    are joined in place by the document alone; a join by more columns would deal both anew.
    """
    return docs.repartition(PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def grid(docs: DataFrame, n_words: str = "n_words", width: int = SPAN_WIDTH, keep: list[str] | None = None) -> DataFrame:
    """All spans of at most ``width`` words: (kept columns, start, end). A document without words has none."""
    keep = keep or ["doc_id"]
    starts = docs.filter(F.col(n_words) > 0).select(*keep, n_words, F.explode(F.sequence(F.lit(0), F.col(n_words) - 1)).alias("start"))
    last = F.least(F.col("start") + width, F.col(n_words))
    return starts.select(*keep, "start", F.explode(F.sequence(F.col("start") + 1, last)).alias("end"))


def for_queries(spans: DataFrame, queries: list[tuple[int, str, float | None]]) -> DataFrame:
    """Each span with each query (id, name, threshold); the queries are the schema's, not data."""
    rows = F.array(*(F.struct(F.lit(i).alias("query_id"), F.lit(n).alias("label"), F.lit(t).cast("double").alias("query_threshold")) for i, n, t in queries))
    return spans.withColumn("q", F.explode(rows)).select(*spans.columns, "q.query_id", "q.label", "q.query_threshold")


def above_threshold(scored: DataFrame, default: float, temperature: float = 1.0, threshold: Column | None = None, least: float | None = None) -> DataFrame:
    """Adds confidence and keeps rows at or above the query's threshold, or the default where it has none.

    least: what no threshold is below, if known. Most logits are then too small for any, which is seen without an exponential.
    """
    least = default if threshold is None else least
    if least is not None and 1e-6 <= least <= 1 - 1e-6 and temperature > 0:
        # Rounding moves a confidence by far less than the margin moves the logit.
        scored = scored.filter(F.col("logit") >= (log(least / (1 - least)) - 1e-6) * temperature)
    limit = F.coalesce(threshold, F.lit(float(default))) if threshold is not None else F.lit(float(default))
    return scored.withColumn("confidence", probability(F.col("logit"), temperature)).filter(F.col("confidence") >= limit)


def not_abstaining(spans: DataFrame, nulls: DataFrame, threshold: float = 0.5, temperature: float = 1.0) -> DataFrame:
    """Drops all spans of queries whose null probability is strictly above the threshold. nulls: doc_id, query_id, null_logit."""
    silent = nulls.filter(probability(F.col("null_logit"), temperature) > threshold).groupBy("doc_id").agg(F.collect_set("query_id").alias("_q"))
    told = spans.join(silent.hint("shuffle_hash"), "doc_id", "left")  # a short list for each document
    return told.filter(F.col("_q").isNull() | ~F.array_contains("_q", F.col("query_id"))).drop("_q")


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def checked(rows: DataFrame, columns: list[str], what: str, keys: list[str], spans: bool = False) -> DataFrame:
    """rows, every one of which is looked at before a filter on ``mask`` or on coordinates can drop it: a score that isn't
    finite, and with ``spans`` a live row that is no span, is an error that names the row."""
    named = F.concat(*(x for k in keys for x in (F.lit(f" {k} "), F.coalesce(F.col(k).cast("string"), F.lit("null")))))
    error = lambda reason: F.raise_error(F.concat(F.lit(f"{what}:"), named, F.lit(f": {reason}")))
    live = F.col("mask") if "mask" in rows.columns else F.lit(True)
    scores = finite(F.col(columns[0]).cast("double"))
    for c in columns[1:]:
        scores = scores & finite(F.col(c).cast("double"))
    fine = ~live | ((F.col("start") >= 0) & (F.col("start") < F.col("end"))) if spans else F.lit(True)
    # One condition that drops nothing: in the columns themselves it would be repeated wherever they are used.
    return rows.filter(F.when(~scores, error("a score isn't finite")).when(~fine, error("a span is malformed")).otherwise(True))


def unmasked(spans: DataFrame, n_words: str = "n_words") -> DataFrame:
    """Drops rows whose mask is false; a live span outside the text is an error."""
    live = spans.filter("mask")
    fine = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col(n_words))
    return live.withColumn("start", F.when(fine, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("span outside the text of document "), F.col("doc_id").cast("string")))))


def prefixed(docs: DataFrame, prefix: list[str]) -> DataFrame:
    """Documents as a model reads them, with the words of a prefix before their own: n_words counts both, tokens are the text's."""
    return docs.withColumns({"prefix": F.array(*map(F.lit, prefix)).cast("array<string>"), "prefix_words": F.lit(len(prefix)), "n_words": F.col("n_words") + len(prefix)})


def origin(rows: DataFrame) -> Column:
    """Where the text's own words begin in the model's coordinates."""
    return F.col("prefix_words") if "prefix_words" in rows.columns else F.lit(0)


def outside_prefix(spans: DataFrame, prefix_words: int, n_words: str = "n_words") -> DataFrame:
    """Drops spans that touch the prefix or end past the text's own words, and counts from the first of these."""
    start, end = F.col("start") - prefix_words, F.col("end") - prefix_words
    return spans.filter((start >= 0) & (end <= F.col(n_words))).withColumns({"start": start, "end": end})


def located(spans: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Adds byte and code-point offsets and the trimmed surface; nulls where a span begins in the prefix or ends past the text's words.

    docs: doc_id, text and words with offsets, or n_words alone: texts are split then where spans of theirs are asked for.
    A text's spans are gathered before they meet its words, so that texts and word lists are never copied for each span, nor broadcast.
    """
    if tokens not in docs.columns:
        return _located_later(spans, docs)
    own = docs.select("doc_id", F.col("text").cast("binary").alias("_t"), F.col(tokens).alias("_w"), origin(docs).alias("_o")).hint("merge")
    kept = [c for c in spans.columns if c != "doc_id"]
    gathered = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*kept)).alias("_s")).join(own, "doc_id")

    def placed(x: Column) -> Column:
        start, end = x["start"] - F.col("_o"), x["end"] - F.col("_o")
        inside = (start >= 0) & (start < end) & (end <= F.size("_w"))
        first, last = F.when(inside, F.get("_w", start)), F.when(inside, F.get("_w", end - 1))
        surface = F.substring("_t", first["start"] + 1, last["end"] - first["start"]).cast("string")
        told = {"byte_start": first["start"], "byte_end": last["end"], "char_start": first["char_start"], "char_end": last["char_end"], "surface": unicode_trim(surface)}
        return F.struct(*(x[c].alias(c) for c in kept), *(v.alias(k) for k, v in told.items()))

    return gathered.select("doc_id", F.explode(F.transform("_s", placed)).alias("_x")).select("doc_id", "_x.*")


def gathered(rows: DataFrame, docs: DataFrame, asked) -> DataFrame:
    """(doc_id, _s, _w): rows of a text in an array, and where the spans that are asked for stand, with their texts. asked: of the
    array and the place of the text's first word an array of (start, end) in words."""
    own = docs.select("doc_id", "text", origin(docs).alias("_o"), F.col("n_words").alias("_n")).hint("merge")
    item = F.struct(*(c for c in rows.columns if c != "doc_id"))
    lists = rows.groupBy("doc_id").agg(F.collect_list(item).alias("_s")).join(own, "doc_id")
    told = text.with_places_of(lists, "text", asked(F.col("_s"), F.col("_o")), F.col("_n") - F.col("_o"), "_w")
    return told.select("doc_id", "_s", "_w")


def _located_later(spans: DataFrame, docs: DataFrame) -> DataFrame:
    kept = [c for c in spans.columns if c != "doc_id"]
    span = lambda o: lambda x: F.struct((x["start"] - o).cast("int").alias("start"), (x["end"] - o).cast("int").alias("end"))
    lists = gathered(spans, docs, lambda rows, o: F.transform(rows, span(o)))

    def placed(x: Column, i: Column) -> Column:
        at = F.get("_w", i)
        told = {"byte_start": "start", "byte_end": "end", "char_start": "char_start", "char_end": "char_end", "surface": "text"}
        return F.struct(*(x[c].alias(c) for c in kept), *(at[v].alias(k) for k, v in told.items()))

    return lists.select("doc_id", F.inline(F.transform("_s", placed)))


#: A text as bytes, and an array for each side of its words, in bytes and code points.
PLACES = ("_t", "_start", "_end", "_char_start", "_char_end")


def places(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and PLACES, in the row of the text."""
    words = text.with_places(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    sides = [F.col("places")[c[1:]].alias(c) for c in PLACES[1:]]
    return words.select("doc_id", F.col("text").cast("binary").alias("_t"), *sides, F.size("places.start").alias("n_words"))


def with_places(docs: DataFrame) -> DataFrame:
    """The same, dealt by document; sides that nothing asks for aren't shuffled."""
    return by_document(places(docs))


def placed(spans: DataFrame) -> DataFrame:
    """As located(), of rows that bring along their text in PLACES: as bytes, and where its words are.

    For spans that were made of a document's row and haven't been shuffled or sorted since: the text is then one for all.
    Words of with_places() neither begin nor end with white space, so surfaces need no trimming.
    """
    at = lambda side, word: F.get(f"_{side}", word)
    first, last = F.col("start") - origin(spans), F.col("end") - origin(spans) - 1
    inside = (first >= 0) & (first <= last) & (last < F.size("_end"))
    start, end = at("start", first), at("end", last)
    told = {"byte_start": start, "byte_end": end, "char_start": at("char_start", first), "char_end": at("char_end", last), "surface": F.substring("_t", start + 1, end - start).cast("string")}
    return spans.select(*(c for c in spans.columns if c not in PLACES), *(F.when(inside, v).alias(k) for k, v in told.items()))


def in_text(spans: DataFrame) -> DataFrame:
    """Drops located spans that have no surface: those of the prefix, and those of white space alone."""
    return spans.filter("surface <> ''")


def mapped(spans: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The located spans that are in the text."""
    return in_text(located(spans, docs, tokens))
