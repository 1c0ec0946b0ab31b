"""I-Match fingerprints, with DataFrame functions only.

Terms are the distinct lower-case words of a text. The lexicon holds terms whose document
frequency over all texts lies in a band: between ``LEAST_SHARE`` and ``MOST_SHARE`` of them, and at
least 2. So it is bounded, whatever the number of texts: the terms in a share of at least s of all
texts are no more than 1/s times the mean number of terms in a text. Every term of the band takes
part. From the lexicon ``SUBSETS`` random subsets are drawn for each of several rates. A text's
distinct terms in a subset are hashed as a set, by the exclusive or of their own hashes, in which sorting
them would change nothing; the hashes of all subsets make up the fingerprint ("......" where a subset has
no term of the text). A text without any term of the lexicon is named by a hash of all of it instead. Large
subsets tell long texts with small changes from others, small ones tell how much two texts share; those
of half the lexicon are for texts with few of its terms.

Likeness of two fingerprints: 1 if they are equal; else for each rate, of the subsets in which at least
one of the texts has a term, the share of those with equal hashes; the largest of these shares over the
rates with at least ``EVIDENCE`` such subsets, or over all if no rate has so many; 0 if there is none.

The next text is that of the next row by doc_id. Rows are dealt into buckets of neighbouring ids
(quantiles of the ids, and quantiles within each of these; null ids by the hash of their text), each with
a copy of the first row of the bucket after it; so one exchange brings neighbours together, and all that
follows works within its partitions. The lexicon is a table of bounded size that is broadcast.

Nulls: a null text is empty; null ids come before all others. Rows with equal ids follow each other by the hash of their text; repeated rows are
each answered. Very long texts are taken whole. An only row is its own next; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_SHARE = 0.001
MOST_SHARE = 0.05
#: Bits of the rates: a subset holds one in 2**bits of the lexicon's terms.
RATES = (1, 3, 5, 7)
#: No more than 64 for all rates: a term's subsets are bits of a long.
SUBSETS = 16
EVIDENCE = 4
DIGITS = 6
BUCKET_ROWS = 200
MOST_BUCKETS = 65_536


def terms_of(text: str) -> str:
    """SQL for the hashes of a text's terms, with repetitions."""
    return f"transform(split(lower({text}), '[\\\\s]+'), w -> xxhash64(w))"


def lexicon_of(docs: DataFrame) -> DataFrame:
    """h: the hashes of the terms in the band of document frequency, over all rows of column ``t``."""
    total = docs.count()
    least, most = max(2, int(math.ceil(total * LEAST_SHARE))), int(total * MOST_SHARE)
    terms = docs.select(F.explode(F.expr(f"array_distinct({terms_of('t')})")).alias("h"))
    return stored(terms.groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df").between(least, max(most, 2))).select("h"), "lexicon")


def lane(i: int) -> int:
    """The bits of the subsets of a rate, as a signed long."""
    bits = ((1 << SUBSETS) - 1) << (i * SUBSETS)
    return bits - (1 << 64) if bits >> 63 else bits


def subsets_of(h: str) -> str:
    """SQL for the subsets that hold a term, as bits: a rate's are set in each of as many hashes as the rate has bits."""
    spared = [sum(lane(i) for i, bits in enumerate(RATES) if bits < k) for k in range(1, max(RATES) + 1)]
    return " & ".join(f"(xxhash64({h}, {k}) | {x}L)" for k, x in enumerate(spared, 1))


def with_fingerprint(rows: DataFrame, keys: list[str], text: str, lexicon: DataFrame, name: str) -> DataFrame:
    """The keys, which tell rows apart, and the fingerprint of a text column.

    A text's distinct terms become rows, and an empty one that stands for the text; those of the lexicon (at most 1 / LEAST_SHARE times the mean number of terms of
    a text) are told by a broadcast join, and the rows are summed up again by the keys, without an
    exchange if they are already dealt out by one of them.
    """
    empty = "." * DIGITS
    terms = rows.select(*keys, F.expr(f"xxhash64({text})").alias("whole"), F.explode(F.expr(f"array_append(array_distinct({terms_of(text)}), NULL)")).alias("h"))
    known = terms.join(F.broadcast(lexicon.withColumn("listed", F.lit(True))), "h", "left").filter("listed OR h IS NULL")
    marked = known.select(*keys, "whole", F.expr("xxhash64(h, 0)").alias("x"), F.expr(f"if(listed IS NULL, 0L, {subsets_of('h')})").alias("m"), "listed")
    n = SUBSETS * len(RATES)
    hashed = marked.groupBy(*keys).agg(*(F.expr(f"bit_xor(if((m & shiftleft(1L, {r})) = 0L, 0L, x))").alias(f"s{r}") for r in range(n)), F.first("whole").alias("whole"), F.max("listed").alias("listed"))
    shown = [F.expr(f"if(s{r} = 0L, '{empty}', right(concat('{'0' * DIGITS}', lower(hex(s{r}))), {DIGITS}))") for r in range(n)]
    named = F.expr("concat('=', lower(hex(whole)))")
    return hashed.select(*keys, F.when(F.col("listed"), F.concat(*shown)).otherwise(named).alias(name))


def likeness(a: str, b: str) -> str:
    """SQL for the likeness of two fingerprint columns."""
    empty = "." * DIGITS

    def counted(first: int, last: int) -> str:
        at = f"substr({{}}, (r * {DIGITS} + 1), {DIGITS})"
        x, y = at.format(a), at.format(b)
        either = f"aggregate(sequence({first}, {last}), 0, (n, r) -> n + if({x} <> '{empty}' OR {y} <> '{empty}', 1, 0))"
        equal = f"aggregate(sequence({first}, {last}), 0, (n, r) -> n + if({x} = {y} AND {x} <> '{empty}', 1, 0))"
        return f"named_struct('e', {either}, 's', {equal})"

    n = len(RATES)
    rates = f"array({', '.join(counted(i * SUBSETS, (i + 1) * SUBSETS - 1) for i in range(n))})"
    pick = f"if(exists(c, x -> x.e >= {EVIDENCE}), filter(c, x -> x.e >= {EVIDENCE}), filter(c, x -> x.e > 0))"
    share = f"transform(array({rates}), c -> coalesce(array_max(transform({pick}, x -> x.s / x.e)), 0.0D))[0]"
    return f"CASE WHEN {a} = {b} THEN 1.0D WHEN left({a}, 1) = '=' OR left({b}, 1) = '=' THEN 0.0D ELSE {share} END"


def quantiles(column: str, parts: int):
    """An expression for the distinct cuts that deal a column into so many parts of about equal size."""
    return F.sort_array(F.array_distinct(F.percentile_approx(column, [i / parts for i in range(1, max(2, parts))], 10_000)))


def bucketed(docs: DataFrame) -> DataFrame:
    """Adds b, a bucket of neighbouring rows in the order of ids: null ids first, by the hash of their text, then quantiles of quantiles of the ids. Rows of one id stay together."""
    total, without = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    each = max(1, min(256, math.isqrt(min(MOST_BUCKETS, total // BUCKET_ROWS))))
    nulls = max(1, min(MOST_BUCKETS, without // BUCKET_ROWS))
    of_null = F.least(F.lit(nulls - 1), F.floor((F.xxhash64("t") / 2.0**64 + 0.5) * nulls))
    known = docs.filter("doc_id IS NOT NULL").select("doc_id")
    cuts = known.agg(quantiles("doc_id", each)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda x: x <= F.col("doc_id")))
    within = known.withColumn("k", part).groupBy("k").agg(quantiles("doc_id", each).alias("cuts"))  # at most 256 rows of 255 cuts
    parts = docs.withColumn("k", F.when(F.col("doc_id").isNotNull(), part)).join(F.broadcast(within), "k", "left")
    inner = F.size(F.filter("cuts", lambda x: x <= F.col("doc_id")))
    return parts.withColumn("b", F.when(F.col("doc_id").isNull(), of_null).otherwise(nulls + F.col("k") * (each + 1) + inner).cast("int")).drop("k", "cuts")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_t of the row that follows by doc_id (after the last comes the first) and n, the row's number in its bucket, for docs (doc_id, b, t). A copy of the row that follows a bucket ends it, with ``copy`` 1."""
    key = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("t"))
    heads = sorted((r[0], r[1]) for r in docs.groupBy("b").agg(F.min(key).alias("k")).collect())  # at most some 2 x MOST_BUCKETS rows
    copies = [(*heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    spark = docs.sparkSession
    told = F.broadcast(spark.createDataFrame([tuple(c) for c in copies], "has_id boolean, id long, h long, into int"))
    rows = docs.withColumns({"has_id": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64("t")})
    added = rows.drop("b").join(told, ["has_id", "id", "h"]).withColumnRenamed("into", "b").withColumn("copy", F.lit(1))
    both = rows.withColumn("copy", F.lit(0)).unionByName(added)
    order = Window.partitionBy("b").orderBy("copy", "has_id", "id", "h")
    return both.select("doc_id", "b", "t", "copy", F.row_number().over(order).alias("n"), F.lead("t").over(order).alias("next_t"))


def op7_imatch_fingerprints(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lexicon = lexicon_of(docs.select("t"))
    rows = with_next(bucketed(docs)).withColumn("n_chars", F.length("t").cast("long"))
    rows = rows.withColumn("e", F.expr("concat(substr(t, 1, int(n_chars - n_chars div 2)), substr(next_t, 1, int(n_chars div 2)))"))
    # A bucket's texts and edited texts in turn: after each text its edited one, then the next text.
    sides = F.expr("if(copy = 1, array(named_struct('edited', 0, 's', t)), array(named_struct('edited', 0, 's', t), named_struct('edited', 1, 's', e)))")
    texts = rows.select("doc_id", "b", "n", "copy", "n_chars", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), F.explode(sides).alias("side"))
    texts = texts.select("*", F.col("side.edited").alias("edited"), F.col("side.s").alias("s"))
    found = with_fingerprint(texts, ["b", "n", "edited", "copy", "doc_id", "n_chars", "edited_sha256"], "s", lexicon, "fingerprint")
    order = Window.partitionBy("b").orderBy("n", "edited")
    led = found.withColumns({"edited_fingerprint": F.lead("fingerprint", 1).over(order), "next_fingerprint": F.lead("fingerprint", 2).over(order)})
    return led.filter("copy = 0 AND edited = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.expr(likeness("fingerprint", "edited_fingerprint")).alias("near_edited"), F.expr(likeness("fingerprint", "next_fingerprint")).alias("near_next")
    )
