"""Scores that were made before and lie in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .base import FAMILIES, Provider


class TableProvider(Provider):
    """Gives each family from a DataFrame with the columns of its contract, for the documents asked for."""

    name = "table provider"

    def __init__(self, **tables: DataFrame):
        if unknown := set(tables) - set(FAMILIES):
            raise ValueError(f"unknown families {sorted(unknown)}")
        for family, rows in tables.items():
            setattr(self, family, self._given(rows))

    @staticmethod
    def _given(rows: DataFrame):
        return lambda docs, *_: rows.join(docs.select("doc_id"), "doc_id", "left_semi")
