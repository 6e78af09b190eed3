"""Normals by covariance of neighbourhoods."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import cloud

TERMS = G.TERMS


def moments(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, y, z, n, sx..sz, xx..zz): sums of the neighbours' offsets from each point, and of their products.

    One pass: edges meet the far end, then the near end by the id they are summed up by. Sums from any tasks add up, and
    combine before the shuffle. Points without a place take no part.
    """
    there = cloud.finite(points)
    c = there.select(F.col("id").alias("cid"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    p = there.select(F.col("id").alias("pid"), "x", "y", "z")
    e = edges.select("id", "nid").join(c, F.col("nid") == F.col("cid")).join(p, F.col("id") == F.col("pid"))
    off = {a: F.col(f"c{a}") - F.col(a) for a in "xyz"}
    sums = [F.sum(off[a]).alias(f"s{a}") for a in "xyz"] + [F.sum(off[t[0]] * off[t[1]]).alias(t) for t in TERMS]
    return e.groupBy("id").agg(*[F.first(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n"), *sums)


def centroids(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n, gx, gy, gz): the mean of a point and its neighbours; n counts neighbours only."""
    m = moments(points, edges).select(F.col("id").alias("sid"), "n", "sx", "sy", "sz")
    out = points.join(m, F.col("id") == F.col("sid"), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("id", n.cast("long").alias("n"), *[(F.col(a) + F.coalesce(f"s{a}", F.lit(0.0)) / (n + 1)).alias(f"g{a}") for a in "xyz"])


def scatter(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n, xx, xy, xz, yy, yz, zz): sums of products of the neighbours' offsets from the centroid, neighbours only.

    The moments about the point itself, moved to the centroid of n + 1 points: less s s' (n + 2) / (n + 1)^2.
    """
    m, n = moments(points, edges), F.col("n")
    less = (n + 2) / ((n + 1) * (n + 1))
    return m.select("id", "n", *[(F.col(t) - F.col(f"s{t[0]}") * F.col(f"s{t[1]}") * less).alias(t) for t in TERMS])


def eigenvalues(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, e0, e1, e2) ascending."""
    return G.with_eigenvalues(scatter(points, edges)).select("id", "e0", "e1", "e2")


def pca_normals(points: DataFrame, edges: DataFrame, exact: bool = False) -> DataFrame:
    """(id, nx, ny, nz): the direction of least spread, its largest component positive; null with fewer than two neighbours.

    exact: batches go through an iterative eigen solver in numpy instead of the closed form in generated code.
    """
    s = scatter(points, edges).where("n >= 2")
    if exact:
        n = s.select("id", *TERMS).mapInArrow(_solve, "id long, nx double, ny double, nz double")
    else:
        sound = reduce(Column.__and__, [F.abs(t) < F.lit(float("inf")) for t in TERMS])
        n = G.with_smallest_vector(G.with_eigenvalues(s.where(sound))).select("id", "nx", "ny", "nz")
    return points.select("id").join(n.withColumnRenamed("id", "nid"), F.col("id") == F.col("nid"), "left").select("id", "nx", "ny", "nz")


def _matrices(batch: pa.RecordBatch) -> np.ndarray:
    xx, xy, xz, yy, yz, zz = (batch.column(f"{t}").to_numpy(zero_copy_only=False) for t in TERMS)
    return np.stack((np.stack((xx, xy, xz), -1), np.stack((xy, yy, yz), -1), np.stack((xz, yz, zz), -1)), -2)


def _lead_positive(v: np.ndarray) -> np.ndarray:
    """Vectors, or their opposites, so that the component with the largest absolute value is positive."""
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=-1)[..., None], -1)
    return v * np.where(lead < 0, -1.0, 1.0)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = _matrices(batch)
        if not len(a):
            continue
        bad = ~np.isfinite(a).all(axis=(1, 2))  # sums beyond doubles
        v = _lead_positive(np.linalg.eigh(np.where(bad[:, None, None], 0.0, a))[1][:, :, 0])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v[:, k], mask=bad) for k in range(3))], names=["id", "nx", "ny", "nz"])


ASCENDING, DESCENDING, BY_AXIS = 1, -1, 0
_PERMUTED = np.array(list(itertools.permutations(range(3))))
BASIS = [f"v{k}{a}" for k in range(3) for a in "xyz"]


def eigen_bases(points: DataFrame, edges: DataFrame, order: int = ASCENDING) -> DataFrame:
    """(id, n, e0, e1, e2, v0x, .., v2z): eigenvalues of the scatter with an orthonormal, right-handed basis of eigenvectors.

    order: ASCENDING, DESCENDING, or BY_AXIS: the vector that leans most to x first, then y, then z. The first two vectors
    have their largest component positive, the third is their cross product. Equal eigenvalues share a plane or space, of
    which some basis is taken. A point with no neighbour has no row; sums beyond doubles give nulls.
    """
    if order not in (ASCENDING, DESCENDING, BY_AXIS):
        raise ValueError("order is 1, -1 or 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _matrices(batch)
            if not len(a):
                continue
            bad = ~np.isfinite(a).all(axis=(1, 2))
            e, v = np.linalg.eigh(np.where(bad[:, None, None], 0.0, a))
            v = v.transpose(0, 2, 1)  # a vector a row
            if order == DESCENDING:
                e, v = e[:, ::-1], v[:, ::-1]
            elif order == BY_AXIS:
                lean = np.abs(v)[:, _PERMUTED, np.arange(3)].sum(axis=2).argmax(axis=1)
                at = _PERMUTED[lean]
                e, v = np.take_along_axis(e, at, 1), np.take_along_axis(v, at[:, :, None], 1)
            v = _lead_positive(v)
            v[:, 2] = np.cross(v[:, 0], v[:, 1])
            cols = [*e.T, *v.reshape(-1, 9).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c), mask=bad) for c in cols)], names=["id", "n", "e0", "e1", "e2", *BASIS])

    return scatter(points, edges).mapInArrow(run, ", ".join(["id long, n long", *(f"{c} double" for c in ("e0", "e1", "e2", *BASIS))]))
