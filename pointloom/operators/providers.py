"""Where neighbours come from: one way to ask for them, whatever finds them.

A provider says what it can do and gives edges (id, nid, d2, rank) of a cloud in its unit cube; pruning, smoothing and
normals take any. Others follow the same protocol by having these members.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import knn, mesh

#: What a provider can do: find a cloud's own neighbours, those of other points, all within a radius, those along a mesh.
SELF, CROSS, RADIUS, RING = "self", "cross", "radius", "ring"


@runtime_checkable
class Neighbours(Protocol):
    """can: some of SELF, CROSS, RADIUS, RING. edges() is asked of all; cross() only of those that can."""

    @property
    def can(self) -> frozenset[str]: ...

    def edges(self, unit: DataFrame) -> DataFrame:
        """(id, nid, d2, rank) of points in their unit cube, rank from 1 by d2 and nid; a missing neighbour is a missing row."""
        ...

    def cross(self, queries: DataFrame, unit: DataFrame) -> DataFrame:
        """The same for other points, in the cube of the cloud."""
        ...


def _no_cross(provider: Neighbours) -> DataFrame:
    raise NotImplementedError(f"{type(provider).__name__} has no neighbours of other points")


@dataclass(frozen=True)
class Nearest:
    """The k nearest, up to a distance where one is given (in the unit cube)."""

    k: int
    max_distance: float | None = None

    @property
    def can(self) -> frozenset[str]:
        return frozenset((SELF, CROSS) if self.max_distance is None else (SELF, CROSS, RADIUS))

    def _most(self) -> float | None:
        return None if self.max_distance is None else self.max_distance**2

    def edges(self, unit: DataFrame) -> DataFrame:
        return knn.knn_join(unit, unit, self.k, self._most(), exclude_self=True, strict=False)

    def cross(self, queries: DataFrame, unit: DataFrame) -> DataFrame:
        return knn.knn_join(queries, unit, self.k, self._most(), strict=False)


@dataclass(frozen=True)
class Within:
    """All up to a distance (in the unit cube), however many."""

    distance: float

    @property
    def can(self) -> frozenset[str]:
        return frozenset((SELF, CROSS, RADIUS))

    def _ranked(self, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nid")).cast("long")
        return found.withColumn("rank", rank).select("id", "nid", "d2", "rank")

    def edges(self, unit: DataFrame) -> DataFrame:
        return self._ranked(knn.within_unit(unit, self.distance))

    def cross(self, queries: DataFrame, unit: DataFrame) -> DataFrame:
        return self._ranked(knn.within_unit(unit, self.distance, queries))


@dataclass(frozen=True)
class Ring:
    """The vertices that share an edge of a mesh of triangles, the k nearest of them where k is given."""

    faces: DataFrame
    k: int | None = None

    @property
    def can(self) -> frozenset[str]:
        return frozenset((SELF, RING))

    def edges(self, unit: DataFrame) -> DataFrame:
        return mesh.one_ring(unit, self.faces, self.k)

    def cross(self, queries: DataFrame, unit: DataFrame) -> DataFrame:
        return _no_cross(self)
