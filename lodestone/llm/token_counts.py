"""Token counts by scanning flat token files for end-of-document identifiers.

A token file is a flat run of little-endian 16-bit identifiers without an index: the tokens of a
document, its end-of-document identifier, the next document, and so on. Files are read in blocks
of fixed size by any task. A block is searched at once by comparing all of its identifiers; it
gives the places of its ends, its number of tokens, and nothing else. A prefix scan over the
blocks of a file then carries the number of ends and the place of the last end into each block,
which turns places into document numbers and lengths, whether or not a document spans blocks.

Files are written to the shared folder by name of task and attempt; only those that a finished
attempt reports are read, so a lost executor leaves nothing that counts.

Nulls: a null text is empty and has no tokens; a null id is passed on. Repeated rows are counted
each. A file that doesn't end with an end identifier has a last document of the tokens after it,
if there are any. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

TOKEN = np.dtype("<u2")
BLOCK_TOKENS = 1 << 21
#: Tokens after which a task begins another file.
FILE_TOKENS = 1 << 26


def opened(path: str, write: bool = False):
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_file(inner)


_encodings: dict = {}


def encoding_of(path: str, pattern: str):
    """One encoder of the tokenizer library for a worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        from .byte_bpe import read_ranks

        _encodings[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path, pattern]


def write_token_files(docs: DataFrame, ranks: str, pattern: str, end_id: int) -> DataFrame:
    """Writes the texts' tokens as flat files; gives (file, tokens, ids): each file's path, its size and its documents' ids in order."""
    folder = fresh_path(docs.sparkSession, "tokens")

    def run(batches):
        encoding, context = encoding_of(ranks, pattern), TaskContext.get()
        end = np.array([end_id], TOKEN).tobytes()
        part, out, path, ids, total = 0, None, "", [], 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "tokens", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    path = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{part}.bin"
                    out, ids, total, part = opened(path, write=True), [], 0, part + 1
                tokens = encoding.encode_ordinary(text or "")
                out.write(np.array(tokens, TOKEN).tobytes())
                out.write(end)
                ids.append(doc_id)
                total += len(tokens) + 1
                if total >= FILE_TOKENS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "file string, tokens long, ids array<long>"), "token-files")


def ends_of(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, first, n, ends): for each block of each file (file, tokens) its first place, its size and the places of its ends."""

    def run(batches):
        for batch in batches:
            for file, block, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = block * block_tokens
                n = min(block_tokens, tokens - first)
                with opened(file) as f:
                    f.seek(first * TOKEN.itemsize)
                    found = np.frombuffer(f.read(n * TOKEN.itemsize), TOKEN)
                if len(found) != n:
                    raise ValueError(f"{file} ends early")
                ends = np.flatnonzero(found == end_id) + first
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "first", "n", "ends"])

    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block_tokens}"))).alias("block"), "tokens").filter("tokens > 0")
    return blocks.repartition(F.col("file"), F.col("block")).mapInArrow(run, "file string, block long, first long, n long, ends array<long>")


def document_lengths(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, number, n_tokens) of each document of the files, numbered from 0 within its file."""
    found = stored(ends_of(files, end_id, block_tokens), "token-ends")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.array_max("ends")).over(earlier), F.lit(-1)).alias("last"),
        F.when(F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(), F.col("first") + F.col("n")).alias("over"),
    )
    # A last document without its end ends where the file does.
    stops = F.when(F.col("over") - 1 > F.coalesce(F.array_max("ends"), "last"), F.concat("ends", F.array("over"))).otherwise(F.col("ends"))
    placed = carried.withColumn("ends", stops).select("file", "before", "last", "ends", F.posexplode("ends").alias("i", "stop"))
    return placed.select("file", (F.col("before") + F.col("i")).alias("number"), (F.col("stop") - 1 - F.expr("if(i = 0, last, ends[i - 1])")).alias("n_tokens"))


def count_tokens(docs: DataFrame, ranks: str, pattern: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of each row of docs (doc_id, text), by way of flat token files."""
    files = write_token_files(docs, ranks, pattern, end_id)
    lengths = document_lengths(files.select("file", "tokens"), end_id, block_tokens)
    ids = files.select("file", F.posexplode("ids").alias("number", "doc_id")).withColumn("number", F.col("number").cast("long"))
    # Both sides have a row for each document, which their small files don't tell the planner: neither may be broadcast.
    return ids.join(lengths.hint("merge"), ["file", "number"]).select("doc_id", "n_tokens")


def op6_token_counts(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50_256)


def count_file_tokens(spark: SparkSession, paths: list[str], end_id: int) -> DataFrame:
    """(file, number, n_tokens) for flat files that others have written."""
    sizes = []
    for path in paths:
        with opened(path) as f:
            sizes.append((path, f.size() // TOKEN.itemsize))
    return document_lengths(spark.createDataFrame(sizes, "file string, tokens long"), end_id)
