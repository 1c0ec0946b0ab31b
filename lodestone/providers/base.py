"""The contract of score providers.

A provider turns documents and queries into long-form scores. A family that it can't score is an
error, never an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prompts import Query

FAMILIES = ("span_logits", "null_logits", "label_logits", "boundary_logits", "pair_logits", "count_logits", "object_logits", "assign_logits", "explicit_logits", "choice_logits", "candidate_logits", "prefix_logits", "instance_logits")


class MissingFamily(ValueError):
    pass


class Provider:
    """Families are methods; a provider overrides those that it has.

    docs has doc_id, text, tokens (with offsets) and n_words; all results carry doc_id. Where a prefix of
    choices stands before the text, docs has prefix and prefix_words too, n_words counts both, and all
    coordinates are those of prefix and text together.
    """

    name = "provider"
    #: Whether scores are made of the words of docs; if not, tokens may be missing there.
    reads_words = True

    def _missing(self, family: str):
        raise MissingFamily(f"{self.name} has no {family}")

    def span_logits(self, docs: DataFrame, queries: list[Query]) -> DataFrame:
        """(query_id, start, end, logit)"""
        self._missing("span_logits")

    def null_logits(self, docs: DataFrame, queries: list[Query]) -> DataFrame:
        """(query_id, null_logit)"""
        self._missing("null_logits")

    def label_logits(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        """(task, label_idx, label, logit)"""
        self._missing("label_logits")

    def boundary_logits(self, docs: DataFrame, queries: list[Query]) -> DataFrame:
        """(query_id, pos, start_logit, end_logit, mask, query_mask)"""
        self._missing("boundary_logits")

    def pair_logits(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """pairs with logit"""
        self._missing("pair_logits")

    def count_logits(self, docs: DataFrame, owner: str, most: int) -> DataFrame:
        """(n, logit)"""
        self._missing("count_logits")

    def object_logits(self, docs: DataFrame, structure: str) -> DataFrame:
        """(structure, instance, logit, seed_start, seed_end)"""
        self._missing("object_logits")

    def assign_logits(self, docs: DataFrame, structure: str, fields: list[str]) -> DataFrame:
        """(structure, field, instance, col, logit, start, end)"""
        self._missing("assign_logits")

    def explicit_logits(self, docs: DataFrame, spans: DataFrame, labels: list[str]) -> DataFrame:
        """(label_idx, start, end, logit)"""
        self._missing("explicit_logits")

    def choice_logits(self, docs: DataFrame, query: Query, choices: list[str]) -> DataFrame:
        """(choice_idx, choice, logit)"""
        self._missing("choice_logits")

    def candidate_logits(self, docs: DataFrame, candidates: DataFrame, queries: list[Query]) -> DataFrame:
        """candidates (doc_id, start, end and others), each with each query: query_id and logit. Those that the provider doesn't score go."""
        scored = self.span_logits(docs, queries).select("doc_id", "query_id", "start", "end", "logit")
        return candidates.join(scored, ["doc_id", "start", "end"])

    def prefix_logits(self, docs: DataFrame, query: Query, present: list[tuple[str, int]]) -> DataFrame:
        """(choice_idx, choice, logit) of choices and their places in the prefix. Without scores of places, those of the choices."""
        return self.choice_logits(docs, query, [c for c, _ in present])

    def instance_logits(self, docs: DataFrame, queries: list[Query], most: int) -> DataFrame:
        """(instance, query_id, start, end, logit). Without scores by instance all instances have the same."""
        return self.span_logits(docs, queries).withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))


class RowProvider:
    """A provider that scores the spans of a text within its row, as streams need."""

    def row_spans(self, query: Query) -> Column:
        """An array of (start, end, logit) from the columns doc_id, text, n_words and what else the rows have."""
        raise NotImplementedError


class ArrayProvider:
    """A provider that scores places from arrays, for decoders that keep few of a text's many: they read these a few texts at a time
    instead of rows. Arguments are numpy arrays that go together; places count from the text's own first word."""

    #: The most words of a span.
    width: int

    def span_array(self, doc_id, start, end, query_id):
        """What span_logits gives."""
        raise NotImplementedError

    def instance_array(self, doc_id, start, end, query_id, instance):
        """What instance_logits gives. Without scores by instance all instances have the same."""
        return self.span_array(doc_id, start, end, query_id)

    def boundary_array(self, doc_id, pos, query_id):
        """What boundary_logits gives where nothing is masked: the logits of starts and of ends."""
        raise NotImplementedError


class ColumnProvider(RowProvider):
    """Scores that rows bring along: a column of arrays of (start, end, logit) for each query's name."""

    def __init__(self, columns: dict[str, str]):
        self.columns = columns

    def row_spans(self, query: Query) -> Column:
        if query.name not in self.columns:
            raise MissingFamily(f"no column of scores for {query.name!r}")
        return F.col(self.columns[query.name])
