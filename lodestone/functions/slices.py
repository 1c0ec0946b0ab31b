"""Arrow functions of columns that hold a few rows' values in Python at a time, however many an Arrow batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: So many rows are worked on together.
ROWS = 128


def by_slices(kind: str, run: Callable[[pa.Array], pa.Array], rows: int = ROWS):
    """run as a function of a column with the given type of results."""

    @F.arrow_udf(kind)
    def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield run(batch.slice(at, rows))

    return sliced
