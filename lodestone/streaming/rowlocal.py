"""Decoding inside a row, for streams: arrays of scored spans in, arrays of kept spans out.

Windows other than those of time aren't allowed on streams, so everything here stays within a row
and needs neither shuffle nor state. Results equal those of the long form.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import probability
from ..functions.slices import ROWS
from ..functions.text import words
from ..operators.overlap import fold_arrays, policy_of
from ..plans.prompts import Query
from ..providers.base import RowProvider
from ..providers.hashing import HashingProvider

SPANS = "array<struct<confidence:double,start:int,end:int>>"


def decode(docs: DataFrame, query: Query | int, provider: RowProvider | int, threshold: float, policy: str, temperature: float = 1.0) -> DataFrame:
    """(doc_id, spans) of rows of doc_id and text, batch or stream, by a provider that scores within a row. A number stands for a query of that number, or for the hashing provider of that width."""
    query = Query(query, "entity", "entities", "") if isinstance(query, int) else query
    provider = HashingProvider(provider) if isinstance(provider, int) else provider
    counted = docs.withColumn("n_words", F.size(words(F.coalesce("text", F.lit("")))))
    scored = F.transform(provider.row_spans(query), lambda x: F.struct(probability(x["logit"], temperature).alias("confidence"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    kept = F.coalesce(F.filter(scored, lambda x: x["confidence"] >= threshold), F.array()).cast(SPANS)
    policy = policy_of(policy)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), fold_arrays(part.column(1), policy)], ["doc_id", "spans"])

    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), kept.alias("spans")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def decode_stream(stream: DataFrame, sink: str, checkpoint: str, query: Query | int = 0, provider: RowProvider | int = 4, threshold: float = 0.99, policy: str = "greedy"):
    """Starts a stream of texts into a Parquet sink; all that is there is taken, then it ends."""
    return decode(stream, query, provider, threshold, policy).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_batch(path: str, run):
    """What writes a micro-batch: the rows that run(batch) makes of it go to the folder of its number, in place of what is there, so that a batch that is run again leaves no row twice."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def decode_each_batch(stream: DataFrame, run, checkpoint: str, path: str | None = None):
    """Runs a long-form decoder on each micro-batch: with a path run(batch) gives rows, which are written by batch; else run(batch, number) does as it likes."""
    return stream.writeStream.foreachBatch(by_batch(path, run) if path else run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
