"""Label scores as products of a text's vector with the label's centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import from_vectors
from .base import Provider


def centroids_of(vectors: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(label_idx, label, centroid): the mean vector of each label, labels in order."""
    parts = vectors.select(F.col(label).alias("l"), F.posexplode(embedding).alias("i", "x")).groupBy("l", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))
    # Labels are those of a schema: as few as a task has.
    from pyspark.sql import Window

    return rows.select((F.dense_rank().over(Window.orderBy("l")) - 1).alias("label_idx"), F.col("l").cast("string").alias("label"), "centroid")


class EmbeddingProvider(Provider):
    name = "embedding provider"

    def __init__(self, vectors: DataFrame, centroids: DataFrame):
        """vectors: doc_id, embedding; centroids: label_idx, label, centroid."""
        self.vectors, self.centroids = vectors, centroids

    def label_logits(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        own = self.centroids.filter(F.col("label").isin(labels))
        return from_vectors(self.vectors.join(docs.select("doc_id"), "doc_id", "left_semi"), own, task)
