"""Classification of texts from label logits in long form: (doc_id, task, label_idx, label, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import activation, sigmoid, softmax

GROUP = ["doc_id", "task"]


def distribution(logits: DataFrame, multi_label: bool = False, temperature: float = 1.0, act: str = "auto", checked: bool = True) -> DataFrame:
    """Adds scaled logit and probability of every label. Softmax over a task's labels, or a sigmoid for each.

    checked: a logit that isn't finite, and probabilities of a softmax that don't sum to 1, are errors.
    """
    if not temperature > 0:
        raise ValueError(f"temperature {temperature}")
    logit = F.col("logit").cast("double")
    if checked:
        logit = F.when(logit.isNotNull() & ~F.isnan(logit) & (F.abs(logit) < float("inf")), logit).otherwise(F.raise_error(F.lit("a label's logit isn't finite")))
    scaled = logits.withColumn("scaled_logit", logit / F.lit(float(temperature)))
    if activation(multi_label, act) == "sigmoid":
        return scaled.withColumn("probability", sigmoid(F.col("scaled_logit")))
    out = scaled.withColumn("probability", softmax(F.col("scaled_logit"), GROUP))
    if checked:
        total = F.sum("probability").over(Window.partitionBy(*GROUP))
        out = out.withColumn("probability", F.when(F.abs(total - 1) <= 1e-4, F.col("probability")).otherwise(F.raise_error(F.lit("probabilities don't sum to 1"))))
    return out


def best_label(scores: DataFrame, last_on_tie: bool = False) -> DataFrame:
    """One row for each text and task: the label of the greatest probability, the first on a tie (or the last)."""
    tie = F.desc("label_idx") if last_on_tie else F.asc("label_idx")
    over = Window.partitionBy(*GROUP).orderBy(F.desc("probability"), tie)
    return scores.withColumn("_r", F.row_number().over(over)).filter("_r = 1").drop("_r")


def select_labels(scores: DataFrame, threshold: float = 0.5, by_probability: bool = False) -> DataFrame:
    """All labels at or above the threshold; where none is, the best one.

    Adds rank: in the order of the labels, or by probability (ties by label). The second kind takes
    the last of equally good labels where none reaches the threshold; the first kind takes the first.
    """
    over = Window.partitionBy(*GROUP)
    tie = F.desc("label_idx") if by_probability else F.asc("label_idx")
    marked = scores.withColumn("_best", F.row_number().over(over.orderBy(F.desc("probability"), tie))).withColumn("_any", F.max(F.col("probability") >= threshold).over(over))
    kept = marked.filter(((F.col("probability") >= threshold)) | (~F.col("_any") & (F.col("_best") == 1)))
    order = [F.desc("probability"), F.asc("label_idx")] if by_probability else [F.asc("label_idx")]
    return kept.withColumn("rank", F.row_number().over(over.orderBy(*order))).drop("_best", "_any")


def formatted(selected: DataFrame, multi_label: bool, confidence: bool) -> DataFrame:
    """One row for each text and task with ``result``: a label or an array of labels, each with its confidence if asked for."""
    item = F.struct("label", F.col("probability").alias("confidence")) if confidence else F.col("label")
    if not multi_label:
        return selected.select(*GROUP, item.alias("result"))
    rows = selected.withColumn("_i", item)
    gathered = F.array_sort(F.collect_list(F.struct("rank", "_i")))
    return rows.groupBy(*GROUP).agg(F.transform(gathered, lambda x: x["_i"]).alias("result"))


def from_vectors(vectors: DataFrame, centroids: DataFrame, task: str = "task") -> DataFrame:
    """Label logits of vectors (doc_id, embedding) as products with each label's centroid (label_idx, label, centroid).

    The centroids are joined, as few rows as the task has labels.
    """
    product = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    named = F.collect_list(F.struct("label_idx", "label", "centroid"))
    every = centroids.agg(named.alias("labels")).first()["labels"]
    rows = F.array(*(F.struct(F.lit(r["label_idx"]).alias("label_idx"), F.lit(r["label"]).alias("label"), F.array(*map(F.lit, r["centroid"])).alias("centroid")) for r in sorted(every, key=lambda r: r["label_idx"])))
    return vectors.withColumn("l", F.explode(rows)).select("doc_id", F.lit(task).alias("task"), "l.label_idx", "l.label", "embedding", "l.centroid").select("doc_id", "task", "label_idx", "label", product.alias("logit"))
