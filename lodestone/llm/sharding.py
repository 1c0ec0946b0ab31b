"""Shards by proportional stratified interleaving.

Rows of each source are put in a seeded order and ranked; row i of n has the fractional rank
(i - 1/2) / n. Sorted by it, rows of every source are spread evenly, so any contiguous cut has the
mixture of the whole. Cuts are at equal counts: law ``rows``.

No task orders a whole source or the whole table: rows fall into buckets by the first digits of
their seeded hash (then of their fractional rank), ranks are counted within buckets, and the
counts of buckets, whose number follows the rows, are summed up to give offsets.

Nulls: a null source is a source of its own; a null text has no bytes; a null id hashes as its
text's checksum. Very long texts count by their bytes and never move. Repeated rows are ordered by hash, id, checksum and size; among rows equal in all of
these the order doesn't show. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh_path, stored

SEED = "interleave-1"
#: Most digits of the hash that pick a bucket within a source: 16 to this power buckets.
HASH_DIGITS = 5
#: Rows of a bucket, on average, and the most buckets of fractional ranks.
BUCKET_ROWS = 500
MOST_BUCKETS = 16_384


def hash_digits(rows: int) -> int:
    """So many digits that a source with all rows has about BUCKET_ROWS in a bucket."""
    digits = 1
    while digits < HASH_DIGITS and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def interleaved(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32 and position (from 0) of each row in the interleaved order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.crc32(F.encode(text, "UTF-8"))))).cast("binary")).alias("h"),
    )
    slim = stored(slim.withColumn("b", F.conv(F.substring("h", 1, hash_digits(docs.count())), 16, 10).cast("int")), "shard-rows")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source joins too
    slim = slim.withColumn("s", key)
    counts = slim.groupBy("s", "b").agg(F.count("*").alias("c"))
    by_source = Window.partitionBy("s")
    offsets = stored(counts.select("s", "b", (F.sum("c").over(by_source.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(by_source).alias("n_source")), "shard-offsets")
    place = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = slim.withColumn("r", place).join(offsets, ["s", "b"]).withColumn("f", (F.col("before") + F.col("r") - 0.5) / F.col("n_source"))
    ranked = stored(ranked.select("doc_id", "source", "s", "size", "text_crc32", "h", "f"), "shard-ranks")
    forget(slim, offsets)

    total = ranked.count()
    buckets = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))
    ranked = ranked.withColumn("q", F.least(F.lit(buckets - 1), F.floor(F.col("f") * buckets)).cast("int"))
    at, before = 0, []
    for row in ranked.groupBy("q").count().orderBy("q").collect():  # at most MOST_BUCKETS rows
        before.append((row[0], at))
        at += row[1]
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(before, "q int, before long"))
    order = Window.partitionBy("q").orderBy("f", "s", "h", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("r", F.row_number().over(order)).join(starts, "q")
    return placed.select("doc_id", "source", "size", "text_crc32", (F.col("before") + F.col("r") - 1).alias("position"), F.lit(total).cast("long").alias("total"))


def sharded(docs: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """Adds shard and slot: shard k takes positions from ceil(k * total / shards) on."""
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return interleaved(docs, seed).withColumn("shard", F.expr(f"cast((position * {shards}) div total AS int)")).withColumn("slot", F.col("position") - first)


def write_shards(docs: DataFrame, shards: int, path: str | None = None, seed: str = SEED) -> str:
    """Writes whole rows of docs by shard (folders shard=k) and gives the path. Ids must be unique here."""
    path = path or fresh_path(docs.sparkSession, "shards")
    places = sharded(docs.select("doc_id", "text", "source"), shards, seed).select(F.col("doc_id").alias("_id"), "shard", "slot")
    docs.join(places, docs["doc_id"] == places["_id"]).drop("_id").write.partitionBy("shard").parquet(path)
    return path


def op4_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    return sharded(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: CRC-32 by its rule, bit by bit, over the bytes of a text.
_CRC = """(
  WITH RECURSIVE t(n, c, k) AS (SELECT n, n::BIGINT, 0 FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8)
  SELECT list(c ORDER BY n) AS tab FROM t WHERE k = 8)"""

ORACLE = f"""
WITH crc AS {_CRC},
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
sums AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(hex(encode(text)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
                  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM texts, crc),
d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, octet_length(encode(sums.text)) + 1 AS size, sums.crc AS text_crc32,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '~' || sums.crc)) AS h
      FROM documents JOIN sums ON sums.text = coalesce(documents.text, '')),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id, text_crc32, size) - 1 AS position, count(*) OVER () AS total FROM f),
g AS (SELECT *, position * 8 // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, position - (shard * total + 7) // 8 AS slot, CAST(NULL AS INT) AS grown_shard, source FROM g
"""
