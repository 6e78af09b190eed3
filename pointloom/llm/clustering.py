"""Centroid clustering (Lloyd's rounds) of whole-number vectors, exact to the last digit.

Distances are expanded as |x|^2 - 2 x.c + |c|^2, one matrix product a block, in doubles. All the terms are whole numbers,
so as long as none of their partial sums can reach 2^53 the doubles are exact; a row whose magnitude does not prove that
is compared in 64-bit integers, or in Python's own where those could overflow too. Vectors are packed once into blocks of
the narrowest type that holds them, written to the shared folder; each round is one treeAggregate over the blocks, whose
combiners add sums and counts of the centroids, so only those, of a fixed size, meet the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize

#: Bytes of a packed block at most (or one vector), as doubles, and rows whose distances a task computes at once.
PACKED, ROWS = 1 << 20, 4096
#: Whole numbers below this add up exactly in doubles, and below that in 64-bit integers.
EXACT, LONG = 2.0**53, 2.0**62
KINDS = ("i1", "i2", "i4", "f8")


def whole(batch: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those lists that have dim components, none null or non-finite: each component as floor(scale * x).

    Raises where the product leaves the range of doubles, which hold every other such whole number exactly.
    """
    lists = batch.cast(pa.list_(pa.float64()))
    size, there = np.diff(lists.offsets.to_numpy()), lists.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(there & (size == dim))
    flat = lists.values.to_numpy(zero_copy_only=False)  # a null is a NaN here
    v = flat[lists.offsets.to_numpy()[rows][:, None] + np.arange(dim)].astype(np.float64)
    good = np.isfinite(v).all(axis=1)
    with np.errstate(over="ignore"):
        out = np.floor(v[good] * scale)
    if not np.isfinite(out).all():
        raise ValueError("a component is too large for this scale")
    return rows[good], out


def _exact(x: np.ndarray, c: list[list[int]], bound: float) -> np.ndarray:
    """Squared distances by differences, in 64-bit integers below their bound, in Python's own beyond."""
    if bound < LONG:
        a, b = x.astype(np.int64), np.array(c, np.int64)
    else:
        a, b = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape), np.array(c, object)
    return np.stack([((a - b[j]) ** 2).sum(axis=1) for j in range(len(c))], axis=1)


def distances(x: np.ndarray, c: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, squared distances to all centroids) of the whole-number vectors x: rows of doubles that are exact, then the rest."""
    dim, most = x.shape[1], float(max((abs(v) for r in c for v in r), default=0))
    bound = dim * (np.abs(x).max(axis=1, initial=0.0) + most) ** 2
    fine = np.flatnonzero(bound < EXACT)
    if len(fine):
        a, b = x[fine] if len(fine) < len(x) else x, np.array(c, np.float64)
        yield fine, (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
    for rows in (np.flatnonzero((bound >= EXACT) & (bound < LONG)), np.flatnonzero(bound >= LONG)):
        if len(rows):
            yield rows, _exact(x[rows], c, float(bound[rows].max()))


def nearest(x: np.ndarray, c: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector, ties to the smaller number. Raises where a distance does not fit a long."""
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        for rows, all_ in distances(x[a : a + ROWS], c):
            best = all_.argmin(axis=1)
            least = all_[np.arange(len(rows)), best]
            if least.dtype == object and any(v >= 2**63 for v in least):
                raise ValueError("a squared distance does not fit 64 bits: use a smaller scale")
            at[a + rows], d[a + rows] = best, least.astype(np.int64)
    return at, d


def _totals(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    if not len(x):
        return [0] * x.shape[1]
    if len(x) * float(np.abs(x).max()) < EXACT:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(int(v) for v in col) for col in x.T]


def pack(vectors: DataFrame, dim: int, scale: float, vec_col: str) -> DataFrame:
    """Blocks (kind, data) of the vectors that take part, made where the rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, PACKED // (8 * max(dim, 1)))
        for batch in batches:
            _, x = whole(batch.column(0), dim, scale)
            for a in range(0, len(x), most):
                part = x[a : a + most]
                low, high = part.min(), part.max()
                kind = next(k for k in KINDS if k == "f8" or (np.iinfo(k).min <= low and high <= np.iinfo(k).max))
                yield pa.RecordBatch.from_pydict({"kind": [kind], "data": [part.astype(f"<{kind}").tobytes()]}, schema=pa.schema([("kind", pa.string()), ("data", pa.binary())]))

    return vectors.select(vec_col).mapInArrow(run, "kind string, data binary")


def _first(vectors: DataFrame, k: int, dim: int, scale: float, salt: str, id_col: str, vec_col: str) -> list[list[int]]:
    """The k vectors whose salted ids have the smallest SHA-256: a bounded sort, k rows of one vector to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "x"])

    hashed = vectors.select(F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256).alias("h"), vec_col).mapInArrow(run, "h string, x array<double>")
    return [[int(v) for v in r["x"]] for r in hashed.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]


class _Round:
    """One pass over the blocks against fixed centroids: exact sums, counts and inertia of each centroid's vectors."""

    def __init__(self, centroids: list[list[int]], dim: int):
        self.c, self.dim = centroids, dim

    def zero(self) -> list:
        return [[0] * len(self.c), [0] * len(self.c), [[0] * self.dim for _ in self.c]]

    def add(self, acc: list, block) -> list:
        x = np.frombuffer(block["data"], f"<{block['kind']}").reshape(-1, self.dim).astype(np.float64)
        at, d = nearest(x, self.c)
        counts, inertia, sums = acc
        for j in np.unique(at).tolist():
            mine = at == j
            counts[j] += int(mine.sum())
            inertia[j] += _totals(d[mine][:, None].astype(object))[0] if int(d.max()) >= 2**40 else int(d[mine].sum())
            sums[j] = [a + b for a, b in zip(sums[j], _totals(x[mine]), strict=True)]
        return acc

    def merge(self, a: list, b: list) -> list:
        return [[p + q for p, q in zip(a[0], b[0], strict=True)], [p + q for p, q in zip(a[1], b[1], strict=True)], [[p + q for p, q in zip(r, s, strict=True)] for r, s in zip(a[2], b[2], strict=True)]]

    def over(self, blocks: DataFrame) -> list:
        return blocks.rdd.treeAggregate(self.zero(), self.add, self.merge)


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[list[list[int]], list[int]]:
    """(centroids, inertia of each) after so many rounds; fewer where a round changes nothing, since later ones would not either."""
    centroids = _first(vectors, k, dim, scale, salt, id_col, vec_col)
    if not centroids:
        return [], []
    blocks = materialize(pack(vectors, dim, scale, vec_col), "cluster-blocks")
    for _ in range(rounds):
        counts, inertia, sums = _Round(centroids, dim).over(blocks)
        moved = [[s // n for s in row] if n else c for c, n, row in zip(centroids, counts, sums, strict=True)]
        if moved == centroids:
            return centroids, inertia
        centroids = moved
    return centroids, _Round(centroids, dim).over(blocks)[1]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of longs) of each vector that takes part.

    A vector takes part if it has dim components, none null or non-finite; each becomes floor(scale * x). The first
    centroids are the k vectors whose SHA-256 of salt and decimal id is smallest, in that order (all, if fewer; of rows that
    share an id the smaller vector first; rows with a null id last). A round assigns each vector to the nearest centroid
    (ties: smaller number) and moves each centroid that has any to the floor of their mean; then vectors are assigned once
    more. distance is squared, cluster_inertia its sum over the cluster, inertia over all. Repeated rows each count and get
    their row. An empty table gives no rows. Components, distances or sums beyond 64 bits fail the job rather than be wrong.
    """
    centroids, inertia = fit(vectors, k, rounds, dim, scale, salt, id_col, vec_col)
    total = sum(inertia)
    if total >= 2**63 or any(abs(v) >= 2**63 for c in centroids for v in c):
        raise ValueError("an inertia or a centroid does not fit 64 bits: use a smaller scale")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column(1), dim, scale)
            if not len(rows):
                continue
            at, d = nearest(x, centroids)
            own = pa.array(np.array(inertia, np.int64)[at])
            each = pa.array(centroids, pa.list_(pa.int64())).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(d), own, pa.array(np.full(len(at), total, np.int64)), each], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(run, schema)


def centroid_sha256(centroids: list[list[int]]) -> list[str]:
    """Lowercase hex of each centroid's components, as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
