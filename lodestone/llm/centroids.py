"""Centroid clustering in exact integers, with nearest centroids shortlisted in single precision.

Vectors are turned into integers. For a batch, one single-precision product of vectors and centroids
gives all scalar products at once; a bound on its rounding error, that of a sum of so many products in
any order, puts each squared distance into an interval. A centroid whose interval lies below all
others is nearest. Where intervals overlap, the centroids that may be nearest are computed again in exact
integers, and the smallest number wins a tie.

A round is one pass over the vectors: each task adds up its own by cluster and gives one row for each
cluster, which Spark adds up on; what comes to the driver, and goes out again, is as many vectors as
there are centroids, whatever the data. Sums are kept in digits of 20 bits, so that none overflows.
Nothing is written in between: vectors are read from their table in each pass.

Nulls: vectors that are null, have a null or non-finite component or another number of them are left
out; a null id is hashed as an empty one. Repeated rows count each; of equal hashes the smaller vector
comes first as a centroid, and equal centroids are all kept, of which the first takes all vectors.
Vectors of any size are handled exactly; a distance or inertia that a long can't hold is null. With fewer
vectors than centroids there are as many centroids as vectors. An empty table, or one without a kept vector,
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of op11: components, what they are multiplied with, centroids, rounds, the seed of the first centroids.
WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Up to this size of components squared distances fit 64 bits, and single precision neither overflows nor loses whole numbers by underflow.
SAFE = 1 << 27
#: Vectors that are worked on at once.
ROWS = 8192
#: Bits of a digit of a sum.
DIGIT = 20
_LARGEST = 2**63 - 1


def kept(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and components (doubles) of the vectors of a batch of vec_id and embedding that are kept."""
    ids, vectors = batch.column(0), batch.column(1)
    whole = np.asarray(pc.equal(pc.list_value_length(vectors), width).fill_null(False))
    ids, vectors = ids.filter(pa.array(whole)), vectors.filter(pa.array(whole))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls become NaN
    finite = np.isfinite(x).all(1)
    return ids.filter(pa.array(finite)), x[finite]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python's integers where a component is large."""
    with np.errstate(over="ignore"):
        found = np.floor(x * scale)
    if (np.abs(found) < SAFE).all():
        return found.astype(np.int64)
    from fractions import Fraction

    return np.array([[int((Fraction(v) * scale) // 1) for v in row] for row in x.tolist()], object).reshape(x.shape)


def split_by_size(x: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and integers of vectors of ordinary size, ROWS at a time, and of the others."""
    small = (np.abs(x) < SAFE / scale).all(1) if len(x) else np.zeros(0, bool)
    for places in (np.flatnonzero(small), np.flatnonzero(~small)):
        for at in range(0, len(places), ROWS):
            some = places[at : at + ROWS]
            yield some, integers(x[some], scale)


class Nearest:
    """Finds nearest centroids. ``recomputed`` counts vectors whose intervals overlapped."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object).reshape(len(centroids), -1)
        self.small = bool((np.abs(self.exact) < SAFE).all())
        self.recomputed = 0
        if self.small:
            self.whole = self.exact.astype(np.int64)
            self.single = np.ascontiguousarray(self.whole.T.astype(np.float32))
            self.squares = (self.whole * self.whole).sum(1).astype(np.float64)
            self.norms = np.sqrt(self.squares) * (1 + 2.0**-40)

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray | list[int]]:
        """The number of each vector's centroid and the squared distance to it."""
        if not self.small or v.dtype == object:
            return self._by_definition(v)
        # Two roundings of the operands, one of the product and width - 1 of the sum, whatever its order.
        roundings = v.shape[1] + 2
        unit = 2.0**-24
        bound = roundings * unit / (1 - roundings * unit) * (1 + 2.0**-40)
        product = (v.astype(np.float32) @ self.single).astype(np.float64)
        length = np.sqrt((v * v).sum(1).astype(np.float64)) * (1 + 2.0**-40)
        middle = self.squares - 2 * product  # the distance less the vector's own square
        radius = 2 * bound * length[:, None] * self.norms + 2.0**-49 * (self.squares + 2 * np.abs(product)) + 2.0**-30
        near = middle - radius <= (middle + radius).min(1, keepdims=True)
        found = near.argmax(1)
        open_rows = np.flatnonzero(near.sum(1) > 1)
        self.recomputed += len(open_rows)
        if len(open_rows):
            row, number = np.nonzero(near[open_rows])
            far = v[open_rows[row]] - self.whole[number]
            exact = np.full((len(open_rows), len(self.whole)), _LARGEST)
            exact[row, number] = (far * far).sum(1)
            found[open_rows] = exact.argmin(1)  # the first of equal ones
        far = v - self.whole[found]
        return found, (far * far).sum(1)

    def _by_definition(self, v: np.ndarray) -> tuple[np.ndarray, list[int]]:
        number, distance = np.zeros(len(v), np.int64), []
        for i, row in enumerate(v.astype(object)):
            all_of = ((self.exact - row) ** 2).sum(1).tolist()
            distance.append(min(all_of))
            number[i] = all_of.index(distance[-1])
        return number, distance


def digits(value: int) -> Iterator[tuple[int, int]]:
    """Place and value of the digits of an integer, between -2**19 and 2**19."""
    place, half = 0, 1 << (DIGIT - 1)
    while value:
        low = (value + half) % (1 << DIGIT) - half
        if low:
            yield place, low
        value = (value - low) >> DIGIT
        place += 1


def vectors_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def first_centroids(vectors: DataFrame, number: int, seed: int, width: int, scale: int) -> list[list[int]]:
    """The kept vectors with the smallest hashes of seed and id, as integers; each task gives its smallest."""

    def run(batches):
        best: list = []
        for batch in batches:
            ids, x = kept(batch, width)
            keyed = [(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), row) for i, row in zip(ids.to_pylist(), x.tolist())]
            best = sorted(best + keyed)[:number]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([x for _, x in best], pa.list_(pa.float64()))], ["hash", "x"])

    # at most `number` rows come to the driver
    found = vectors.mapInArrow(run, "hash string, x array<double>").orderBy("hash", "x").limit(number).toArrow()
    return [integers(np.array([x]), scale)[0].tolist() for x in found.column("x").to_pylist()]


def totals(vectors: DataFrame, centroids: list[list[int]], width: int, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """For each centroid that has vectors: their number, the sums of their components, and of their squared distances."""

    def run(batches):
        nearest = Nearest(centroids)
        counts, sums, spans = {}, {}, {}
        for batch in batches:
            _, x = kept(batch, width)
            for _, v in split_by_size(x, scale):
                found, distance = nearest.of(v)
                order = np.argsort(found, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(found[order])) + 1) if len(order) else ():
                    c = int(found[part[0]])
                    counts[c] = counts.get(c, 0) + len(part)
                    of_part = [int(s) for s in v[part].sum(0)]
                    sums[c] = [a + b for a, b in zip(sums[c], of_part)] if c in sums else of_part
                    spans[c] = spans.get(c, 0) + sum(int(distance[i]) for i in part)
        rows: dict[tuple[int, int], list[int]] = {}
        for c, n in counts.items():
            for i, value in enumerate([n, spans[c], *sums[c]]):
                for place, low in digits(value):
                    rows.setdefault((c, place), [0] * (width + 2))[i] = low
        columns = zip(*([*key, *values] for key, values in rows.items())) if rows else [[]] * (width + 4)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    names = ["c", "place", *(f"s{i}" for i in range(width + 2))]
    parts = vectors.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("c", "place").agg(*(F.sum(n).alias(n) for n in names[2:])).collect()  # a row for each centroid and digit
    out: dict[int, list[int]] = {}
    for row in found:
        held = out.setdefault(row["c"], [0] * (width + 2))
        for i in range(width + 2):
            held[i] += row[f"s{i}"] << (DIGIT * row["place"])
    return {c: (v[0], v[2:], v[1]) for c, v in out.items()}


def cluster(vectors: DataFrame, number: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept row of vec_id and embedding."""
    vectors = vectors_of(vectors)
    centroids = first_centroids(vectors, number, seed, width, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums, _) in totals(vectors, centroids, width, scale).items():
            centroids[c] = [s // n for s in sums]
    within = {c: span for c, (_, _, span) in totals(vectors, centroids, width, scale).items()} if centroids else {}
    held = lambda value: value if value <= _LARGEST else None
    of_cluster = [held(within.get(c, 0)) for c in range(len(centroids))]
    inertia = held(sum(within.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        nearest = Nearest(centroids) if centroids else None
        for batch in batches:
            ids, x = kept(batch, width)
            for places, v in split_by_size(x, scale) if nearest else ():
                found, distance = nearest.of(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(places)),
                        pa.array(found, pa.int32()),
                        pa.array([held(int(d)) for d in distance], pa.int64()),
                        pa.array(of_cluster, pa.int64()).take(pa.array(found)),
                        pa.array([inertia] * len(found), pa.int64()),
                        pa.array(digests, pa.string()).take(pa.array(found)),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op11_centroid_clusters(vectors: DataFrame) -> DataFrame:
    return cluster(vectors)


def _oracle() -> str:
    """All rounds one after the other, each distance by its definition."""
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id) - 1 AS c, v AS m FROM v ORDER BY c LIMIT {CENTROIDS})",
    ]
    square = f"list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, v, c, {square} AS d FROM v, c{r})")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d) AS d, min_by(c, (d, c)) AS c FROM d{r} GROUP BY vec_id)")
        if r < ROUNDS:
            steps.append(f"n{r} AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS m FROM (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {WIDTH + 1}) t(i) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} USING (c))")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"\nSELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"
    )


ORACLE = _oracle()
