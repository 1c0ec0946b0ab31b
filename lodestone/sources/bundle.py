"""Validation of model bundles: a folder of files and a manifest of their sizes and digests.

Files are read and hashed by Spark; the manifest and the listing are compared both ways.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import unique_keys

MANIFEST = "manifest.json"
MANIFEST_BYTES = 8 << 20
CLASSIFICATION_FILES = ("config.json", "tokenizer.json", "encoder.onnx", "classifier.onnx")


class BundleError(ValueError):
    pass


def safe_path(path: str) -> str:
    """A relative path without steps upwards, empty parts or backslashes."""
    parts = PurePosixPath(path).parts
    if not path or path.startswith("/") or "\\" in path or ".." in parts or "." in path.split("/") or "" in path.split("/"):
        raise BundleError(f"unsafe path {path!r}")
    return path


def read_manifest(content: bytes) -> list[dict]:
    """Entries of path, bytes and sha256."""
    if len(content) > MANIFEST_BYTES:
        raise BundleError("the manifest is too large")
    try:
        found = json.loads(content, object_pairs_hook=unique_keys)
    except ValueError as e:
        raise BundleError(str(e)) from e
    entries = found.get("files") if isinstance(found, dict) else None
    if not isinstance(entries, list) or not entries:
        raise BundleError("the manifest lists no files")
    seen = set()
    for e in entries:
        if safe_path(e["path"]) in seen:
            raise BundleError(f"{e['path']} is listed twice")
        seen.add(e["path"])
        if not isinstance(e["bytes"], int) or e["bytes"] < 0 or len(e["sha256"]) != 64 or set(e["sha256"]) - set("0123456789abcdef"):
            raise BundleError(f"bad entry for {e['path']}")
    return entries


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files of a folder but the manifest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inner = F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("://")[-1].lstrip("/").replace(".", r"\.") + "/", "")
    return found.select(inner.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(F.col("path") != MANIFEST)


def differences(spark: SparkSession, folder: str) -> DataFrame:
    """(path, problem): files that are missing, not listed, or of other size or content than listed."""
    content = spark.read.format("binaryFile").load(f"{folder}/{MANIFEST}").select("content").first()[0]
    listed = spark.createDataFrame([(e["path"], e["bytes"], e["sha256"]) for e in read_manifest(bytes(content))], "path string, bytes long, sha256 string")
    both = listed.alias("l").join(files_of(spark, folder).alias("f"), "path", "full")
    problem = F.when(F.col("f.bytes").isNull(), "missing").when(F.col("l.bytes").isNull(), "not listed").when(F.col("l.bytes") != F.col("f.bytes"), "size").when(F.col("l.sha256") != F.col("f.sha256"), "digest")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def validate_bundle(spark: SparkSession, folder: str) -> None:
    if bad := differences(spark, folder).orderBy("path").limit(20).collect():
        raise BundleError("; ".join(f"{r['path']}: {r['problem']}" for r in bad))


def missing_files(paths: list[str], required: tuple[str, ...] = CLASSIFICATION_FILES) -> list[str]:
    return [p for p in required if p not in paths]
