"""What the training-data operators share: tables, the shared folder, row ids."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row id that number the rows of one task.
ROW_BITS = 36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """docs, stored, with a number of its own for each row in ``_row``: decisions on rows don't hang on ids, which may be null or repeated."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), label)


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing will read again, and lets the driver find the shuffles that nothing refers to."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # Spark deletes a shuffle's files once its object is collected


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on, and the stages after may need that memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices_of(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts as bytes, some at a time: where they begin and the texts, of about most_bytes in all or a single one."""
    texts = texts.cast(pa.binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield at, texts.slice(at, to - at).to_pylist()
        done = int(ends[to - 1])
        at = to


def utf8(column) -> F.Column:
    """Text as bytes, so that Python gets it without decoding. Nulls are empty."""
    return F.coalesce(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8"), F.lit(b""))


def crc_of_id(column: str = "doc_id") -> F.Column:
    """crc32 of an id as text; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def row_ids() -> Iterator[int]:
    """Ids that no other task gives and that a repeated task gives again."""
    base = TaskContext.get().partitionId() << ROW_BITS
    while True:
        yield base
        base += 1


def bitmap_of(keys: DataFrame, column: str, bits_log2: int = 24) -> bytes:
    """A bitmap of 2**bits_log2 bits with two bits set for each long key; its size doesn't depend on the data."""
    words = 1 << (bits_log2 - 6)
    bits = keys.select(F.explode(F.array(F.col(column), F.expr(f"shiftrightunsigned({column}, 32)"))).alias("h"))
    rows = bits.selectExpr(f"pmod(h, {words}) AS w", f"shiftleft(1L, cast(pmod(shiftrightunsigned(h, {bits_log2 - 6}), 64) AS int)) AS m").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return out.tobytes()


def bitmap_has(bitmap: bytes, keys) -> "np.ndarray":  # noqa: F821
    """For each key whether its bits are set: never no wrongly, yes wrongly now and then."""
    words = np.frombuffer(bitmap, np.uint64)
    shift = np.uint64(len(words).bit_length() - 1)
    found = np.ones(len(keys), bool)
    keys = np.asarray(keys).view(np.uint64)
    for h in (keys, keys >> np.uint64(32)):
        found &= (words[h & np.uint64(len(words) - 1)] >> ((h >> shift) & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def without(rows: DataFrame, dropped: DataFrame, column: str, bits_log2: int = 26) -> DataFrame:
    """The rows whose key (long, no nulls) isn't among the dropped ones; repeated keys go or stay together.

    Whole texts aren't shuffled for it: rows that a filter of the dropped keys doesn't hold stay where they are, and
    only those that it holds are joined. The filter has a fixed size; where it is full, all rows are joined.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bitmap_of(dropped.select(F.xxhash64(column).alias("h")), "h", bits_log2))

    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(bitmap_has(shared.value, keys.to_numpy()))

    perhaps = F.pandas_udf(held, "boolean")(F.xxhash64(column))
    return rows.filter(~perhaps).unionByName(rows.filter(perhaps).join(dropped.select(column).hint("merge"), column, "left_anti").select(*rows.columns))
