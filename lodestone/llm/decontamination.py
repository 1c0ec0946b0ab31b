"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one
window). A text contains a window only if it contains all of its shingles of ``SHINGLE`` words, so
one shingle of each window is enough to find it: the rarest one, by the shingles' counts in all
texts. These prefix shingles are joined with the shingles of the texts. The length bound drops
windows longer than the text and the positional bound those that would begin before it or end
after it; what is left is compared word by word.

The filter that texts are read with holds the first words of shingles, as a set while they are at
most ``FILTER_WORDS`` and as a bitmap of fixed size beyond that; it only saves work, as the join
and the comparison decide. Windows and their items are joined, not broadcast by force.

Nulls: a null text has no words, is not contaminated and has n_words 0; items with a null text or
without words have no windows; a null item_id isn't listed but its windows mark words. Repeated
rows of texts are answered each; items with equal text count each by its id. Other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_ids, stored, utf8

WINDOW = 10
SHINGLE = 3
#: Distinct first words up to which the filter is an exact set, and the bits of the bitmap beyond.
FILTER_WORDS = 50_000
FILTER_BITS = 1 << 23
#: Shingles that a task counts before it passes the counts on.
COUNTED = 200_000

#: Digits, a-z and all bytes of characters beyond ASCII are word bytes; A-Z becomes a-z.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, n) of each distinct window of each item; words joined by one space."""

    def run(batches):
        for batch in batches:
            items, found, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    found.append(b" ".join(words[i : i + window]))
                    sizes.append(min(window, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string()), pa.array(sizes, pa.int32())], ["item_id", "words", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("t"))
    return items.mapInArrow(run, "item_id string, words string, n int").distinct()


def shingles_of(windows: DataFrame) -> DataFrame:
    """(words, n, shingle, at) for each shingle of each distinct window."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for joined, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = joined.split(" ")
                k = min(SHINGLE, n)
                for i in range(n - k + 1):
                    for column, value in zip(out, (joined, n, " ".join(words[i : i + k]), i), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["words", "n", "shingle", "at"])

    return windows.select("words", "n").distinct().mapInArrow(run, "words string, n int, shingle string, at int")


class Membership:
    """Whether a word or shingle is one of the given ones: exact while they are few, else by a bitmap that may say yes wrongly."""

    def __init__(self, keys: DataFrame):
        keys = keys.toDF("w").distinct()
        some = keys.limit(FILTER_WORDS + 1).collect()
        self.exact = {r[0].encode() for r in some} if len(some) <= FILTER_WORDS else None
        self.bits = b""
        if self.exact is None:
            rows = keys.selectExpr(f"pmod(crc32(encode(w, 'UTF-8')), {FILTER_BITS}) AS h").selectExpr("h div 8 AS b", "shiftleft(1, cast(h % 8 AS int)) AS m").groupBy("b").agg(F.bit_or("m").alias("m")).toArrow()
            bits = np.zeros(FILTER_BITS // 8, np.uint8)
            bits[rows["b"].to_numpy()] = rows["m"].to_numpy()
            self.bits = bits.tobytes()

    def __contains__(self, key: bytes) -> bool:
        if self.exact is not None:
            return key in self.exact
        h = zlib.crc32(key) & (FILTER_BITS - 1)
        return bool(self.bits[h >> 3] >> (h & 7) & 1)


class Filter:
    """Finds the places of wanted shingles among the words of a text."""

    def __init__(self, shingles: DataFrame):
        self.lengths = sorted(r[0] for r in shingles.selectExpr(f"least(n, {SHINGLE}) AS k").distinct().collect())
        self.first = Membership(shingles.selectExpr("substring_index(shingle, ' ', 1)"))
        self.whole = Membership(shingles.select("shingle"))

    def hits(self, words: list[bytes]) -> list[tuple[int, bytes]]:
        first, whole = (m.exact if m.exact is not None else m for m in (self.first, self.whole))
        out = []
        for i in [i for i, w in enumerate(words) if w in first]:
            for k in self.lengths:
                s = b" ".join(words[i : i + k])
                if s in whole and i + k <= len(words):
                    out.append((i, s))
        return out


def shingle_counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(shingle, c long): how often all texts hold each wanted shingle, and perhaps a few others."""
    wanted = docs.sparkSession.sparkContext.broadcast(Filter(shingles))

    def run(batches):
        filter_ = wanted.value
        found: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["shingle", "c"])

        for batch in batches:
            for text in batch.column(0):
                for _, s in filter_.hits(words_of(text.as_py())):
                    found[s] = found.get(s, 0) + 1
                if len(found) > COUNTED:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select("t").mapInArrow(run, "shingle string, c long").groupBy("shingle").agg(F.sum("c").alias("c"))


def prefixes_of(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(words, n, shingle, at): the rarest shingle of each window."""
    shingles = stored(shingles_of(windows), "decontamination-shingles")
    counts = shingle_counts(docs, shingles)
    order = Window.partitionBy("words").orderBy(F.coalesce("c", F.lit(0)), "shingle", "at")
    ranked = shingles.join(counts, "shingle", "left").withColumn("r", F.row_number().over(order))
    return stored(ranked.filter("r = 1").select("words", "n", "shingle", "at"), "decontamination-prefixes")


CANDIDATES = "rid long, doc_id long, n_words long, shingle string, place long, before array<string>, after array<string>"


def candidates(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """For each text a row with n_words, and a row for each prefix shingle in it with the words around."""
    wanted = docs.sparkSession.sparkContext.broadcast(Filter(prefixes))
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        filter_, ids = wanted.value, row_ids()

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, rid = words_of(text.as_py()), next(ids)
                rows.append((rid, doc_id, len(words), None, None, None, None))
                for i, s in filter_.hits(words):
                    rows.append((rid, doc_id, len(words), s, i, words[max(0, i - window + 1) : i], words[i : i + window]))
                    if len(rows) > 20_000:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return docs.select("doc_id", "t").mapInArrow(run, CANDIDATES)


def occurrences(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(rid, start, n, words): windows that texts hold, after both bounds and the comparison of all words."""
    start = F.col("place") - F.col("at")
    fits = (start >= 0) & (F.col("n") <= F.col("n_words")) & (start + F.col("n") <= F.col("n_words")) & (F.size("before") >= F.col("at"))
    around = F.expr("array_join(concat(slice(before, greatest(1, size(before) - at + 1), at), slice(after, 1, n - at)), ' ')")
    return found.filter("shingle IS NOT NULL").join(prefixes, "shingle").filter(fits & (around == F.col("words"))).select("rid", start.alias("start"), "n", "words")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array) for each row of docs (doc_id, text) against benchmark (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t"))
    windows = stored(windows_of(benchmark, window), "decontamination-windows")
    prefixes = prefixes_of(docs, windows)
    found = stored(candidates(docs, prefixes, window), "decontamination-candidates")
    hits = stored(occurrences(found, prefixes), "decontamination-hits")
    end = F.col("start") + F.col("n")
    before = F.max(end).over(Window.partitionBy("rid").orderBy("start", "n", "words").rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.select("rid", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))).alias("new"))
    covered = marked.groupBy("rid").agg(F.sum("new").alias("n_hit"))
    items = hits.select("rid", "words").distinct().join(windows.filter("item_id IS NOT NULL").select("item_id", "words"), "words").groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    texts = found.filter("shingle IS NULL").select("rid", "doc_id", "n_words")
    return texts.join(covered, "rid", "left").join(items, "rid", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op1_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (SELECT p.doc_id, p.i, s.n, win.item_id
        FROM pos p JOIN sizes s ON p.i + s.n - 1 <= len(p.w)
        JOIN win ON win.n = s.n AND win.words = array_to_string(p.w[p.i : p.i + s.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
