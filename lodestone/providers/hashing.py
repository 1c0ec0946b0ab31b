"""Scores by integer arithmetic over places and query numbers.

They let every operator be checked exactly against SQL and mean nothing about language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spans import grid, origin
from ..plans.prompts import Query
from .base import ArrayProvider, Provider, RowProvider

# Multipliers and the grid of the scores.
MULTIPLIERS = (7919, 104729, 1299709, 15485863)
MODULUS, CENTRE, SCALE = 20011, 10005, 2000.0


def hash_logit(*parts: Column | int) -> Column:
    """A logit on a grid of 1/2000 between -5 and 5, from integers in order."""
    terms = [(F.lit(p) if isinstance(p, int) else p.cast("long")) * F.lit(m).cast("long") for p, m in zip(parts, MULTIPLIERS, strict=False)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return (F.pmod(total, F.lit(MODULUS)) - CENTRE) / SCALE


def hash_logits(*parts):
    """The same of arrays."""
    return (sum(p * m for p, m in zip(parts, MULTIPLIERS, strict=False)) % MODULUS - CENTRE) / SCALE


def hash_logit_sql(*parts: str, signed: bool = False) -> str:
    """The same in SQL. signed: the sum may be below zero."""
    total = " + ".join(f"CAST({p} AS BIGINT) * {m}" for p, m in zip(parts, MULTIPLIERS, strict=False))
    if signed:
        total = f"({total}) % {MODULUS} + {MODULUS}"
    return f"((({total}) % {MODULUS}) - {CENTRE}) / {SCALE}"


def _each(docs: DataFrame, items: list[tuple], schema: str) -> DataFrame:
    """docs with a row for each of a few items that the schema gives."""
    names = [x.split(":")[0] for x in schema.split(",")]
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(i, names, strict=True))) for i in items)).cast(f"array<struct<{schema}>>")
    return docs.withColumn("_q", F.explode(rows)).select(*docs.columns, "_q.*")


class HashingProvider(Provider, RowProvider, ArrayProvider):
    """Places count from the text's first word, so that a prefix changes no score of the text."""

    name = "hashing provider"
    reads_words = False

    def __init__(self, width: int = 4):
        self.width = width

    def span_logits(self, docs: DataFrame, queries: list[Query], keep: tuple[str, ...] = ()) -> DataFrame:
        """keep: what else of a document's row its spans bring along."""
        spans = _each(grid(docs.withColumn("_o", origin(docs)), width=self.width, keep=["doc_id", "_o", *keep]), [(q.query_id,) for q in queries], "query_id:int")
        return spans.select("doc_id", *keep, "query_id", "start", "end", hash_logit(F.col("doc_id"), F.col("start") - F.col("_o"), F.col("end") - F.col("start"), F.col("query_id")).alias("logit"))

    def span_array(self, doc_id, start, end, query_id):
        return hash_logits(doc_id, start, end - start, query_id)

    def instance_array(self, doc_id, start, end, query_id, instance):
        return hash_logits(doc_id, start, end - start + 16 * instance, query_id)

    def boundary_array(self, doc_id, pos, query_id):
        return tuple(hash_logits(doc_id, pos, side, query_id) for side in (1, 2))

    def candidate_logits(self, docs: DataFrame, candidates: DataFrame, queries: list[Query]) -> DataFrame:
        """candidates carry prefix_words where there is a prefix."""
        rows = _each(candidates, [(q.query_id,) for q in queries], "query_id:int")
        return rows.withColumn("logit", hash_logit(F.col("doc_id"), F.col("start") - origin(rows), F.col("end") - F.col("start"), F.col("query_id")))

    def instance_logits(self, docs: DataFrame, queries: list[Query], most: int) -> DataFrame:
        spans = _each(grid(docs.withColumn("_o", origin(docs)), width=self.width, keep=["doc_id", "_o"]), [(q.query_id, i) for q in queries for i in range(most)], "query_id:int,instance:int")
        width = F.col("end") - F.col("start") + 16 * F.col("instance")
        return spans.select("doc_id", "instance", "query_id", "start", "end", hash_logit(F.col("doc_id"), F.col("start") - F.col("_o"), width, F.col("query_id")).alias("logit"))

    def prefix_logits(self, docs: DataFrame, query: Query, present: list[tuple[str, int]]) -> DataFrame:
        rows = _each(docs.select("doc_id", origin(docs).alias("_o")), [(i, c, place) for i, (c, place) in enumerate(present)], "choice_idx:int,choice:string,place:int")
        return rows.select("doc_id", "choice_idx", "choice", hash_logit(F.col("doc_id"), F.col("place") - F.col("_o"), 1, query.query_id).alias("logit"))

    def null_logits(self, docs: DataFrame, queries: list[Query]) -> DataFrame:
        rows = _each(docs.select("doc_id"), [(q.query_id,) for q in queries], "query_id:int")
        return rows.select("doc_id", "query_id", hash_logit(F.col("doc_id"), 3, 11, F.col("query_id")).alias("null_logit"))

    def label_logits(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        rows = _each(docs.select("doc_id"), list(enumerate(labels)), "label_idx:int,label:string")
        return rows.select("doc_id", F.lit(task).alias("task"), "label_idx", "label", hash_logit(F.col("doc_id"), F.col("label_idx"), 7, len(task)).alias("logit"))

    def boundary_logits(self, docs: DataFrame, queries: list[Query]) -> DataFrame:
        at = docs.select("doc_id", origin(docs).alias("_o"), F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("pos"))
        rows = _each(at, [(q.query_id,) for q in queries], "query_id:int")
        logit = lambda side: hash_logit(F.col("doc_id"), F.col("pos") - F.col("_o"), side, F.col("query_id"))
        return rows.select("doc_id", "query_id", "pos", logit(1).alias("start_logit"), logit(2).alias("end_logit"), F.lit(True).alias("mask"), F.lit(True).alias("query_mask"))

    def pair_logits(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        place = lambda side: (F.col(f"{side}_start") - origin(pairs)) * 31 + F.col(f"{side}_end") - origin(pairs)
        return pairs.withColumn("logit", hash_logit(F.col("doc_id"), place("head"), place("tail"), F.length("relation")))

    def count_logits(self, docs: DataFrame, owner: str, most: int) -> DataFrame:
        rows = _each(docs.select("doc_id"), [(n,) for n in range(most + 1)], "n:int")
        return rows.select("doc_id", "n", hash_logit(F.col("doc_id"), F.col("n"), 5, len(owner)).alias("logit"))

    @staticmethod
    def _own(docs: DataFrame) -> DataFrame:
        """doc_id, the number of the text's own words, and where they begin."""
        return docs.select("doc_id", (F.col("n_words") - origin(docs)).alias("n_words"), origin(docs).alias("_o"))

    def object_logits(self, docs: DataFrame, structure: str, most: int = 4) -> DataFrame:
        rows = _each(self._own(docs), [(i,) for i in range(most)], "instance:int").filter("instance < n_words")
        logit = hash_logit(F.col("doc_id"), F.col("instance"), 13, len(structure))
        start = F.expr("_o + cast(pmod(doc_id * 31 + instance * 17, n_words) AS int)")
        return rows.select("doc_id", F.lit(structure).alias("structure"), "instance", logit.alias("logit"), start.alias("seed_start"), (start + 1).alias("seed_end"))

    def assign_logits(self, docs: DataFrame, structure: str, fields: list[str], most: int = 4, candidates: int = 4) -> DataFrame:
        rows = _each(self._own(docs), [(i,) for i in range(most)], "instance:int").filter("instance < n_words")
        rows = _each(rows, list(enumerate(fields)), "f:int,field:string")
        rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.least(F.lit(candidates), F.col("n_words")))))
        logit = hash_logit(F.col("doc_id"), F.col("instance") * 101 + F.col("col"), F.col("f") + 1, len(structure))
        place = F.col("_o") + F.col("col") - 1
        return rows.select("doc_id", F.lit(structure).alias("structure"), "field", "instance", "col", logit.alias("logit"), place.alias("start"), (place + 1).alias("end"))

    def explicit_logits(self, docs: DataFrame, spans: DataFrame, labels: list[str]) -> DataFrame:
        rows = _each(spans.select("doc_id", "start", "end").distinct(), [(i,) for i in range(len(labels))], "label_idx:int")
        return rows.select("doc_id", "label_idx", "start", "end", hash_logit(F.col("doc_id"), F.col("start"), F.col("end"), F.col("label_idx")).alias("logit"))

    def choice_logits(self, docs: DataFrame, query: Query, choices: list[str]) -> DataFrame:
        rows = _each(docs.select("doc_id"), list(enumerate(choices)), "choice_idx:int,choice:string")
        return rows.select("doc_id", "choice_idx", "choice", hash_logit(F.col("doc_id"), F.col("choice_idx"), 17, query.query_id).alias("logit"))

    def row_spans(self, query: Query) -> Column:
        n, width = F.col("n_words"), self.width

        def of_start(s: Column) -> Column:
            ends = F.sequence(s + 1, F.least(s + width, n))
            return F.transform(ends, lambda e: F.struct(s.alias("start"), e.alias("end"), hash_logit(F.col("doc_id"), s, e - s, query.query_id).alias("logit")))

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of_start)))
