"""Extents and coordinates of point clouds. points: (id long, x, y, z double)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import geometry as G

#: Added on both sides of an extent, so that it is never empty.
PAD = 1e-6


def finite(points: DataFrame) -> DataFrame:
    """The points whose coordinates are all there and finite. NaN is above infinity to Spark."""
    return points.where(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz"))


def extent(points: DataFrame, pad: float = PAD) -> DataFrame:
    """One row: min and max of each axis, and lo and hi, the padded cubic extent that all axes share. Of finite points only."""
    ends = finite(points).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return ends.withColumn("lo", F.least(*[F.col(f"min_{a}") for a in "xyz"]) - F.lit(pad)).withColumn("hi", F.greatest(*[F.col(f"max_{a}") for a in "xyz"]) + F.lit(pad))


def with_extent(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """points with lo and hi of bounds, which has one row: scalar subqueries, no join."""
    return points.withColumns({c: bounds.select(c).scalar() for c in ("lo", "hi")})


def normalise(points: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """points scaled into the unit cube by their own cubic extent, or by another cloud's."""
    both = with_extent(points, extent(points) if bounds is None else bounds)
    return both.withColumns({a: G.normalised(F.col(a), F.col("lo"), F.col("hi")) for a in "xyz"}).select(*points.columns)


def denormalise(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """The inverse of normalise."""
    return with_extent(points, bounds).withColumns({a: G.denormalised(F.col(a), F.col("lo"), F.col("hi")) for a in "xyz"}).select(*points.columns)


def index_of_cells(points: DataFrame, b: int) -> DataFrame:
    """Normalised points with cx, cy, cz and the linear cell id among b cells an axis."""
    out = points.withColumns({f"c{a}": G.cell_coordinate(F.col(a), 0.0, 1.0, b) for a in "xyz"})
    return out.withColumn("cell", G.linear_cell(F.col("cx"), F.col("cy"), F.col("cz"), b))


def outside(points: DataFrame) -> DataFrame:
    """points (normalised) with out: whether they lie outside the unit cube; a null or NaN coordinate lies there too."""
    inside = [F.coalesce(G.in_bounds(F.col(a), 0, 1), F.lit(False)) for a in "xyz"]
    return points.withColumn("out", ~(inside[0] & inside[1] & inside[2]))


def occupancy(points: DataFrame, b: int) -> DataFrame:
    """cell, its coordinates, points in it and the smallest id among them; of points that have a place."""
    return index_of_cells(finite(points), b).groupBy("cell", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def pyramid(points: DataFrame, levels: tuple[int, ...] = (1024, 512, 256, 128, 64, 32, 16, 8)) -> DataFrame:
    """For each number of cells an axis: occupied cells and the fullest cell. One pass over the points for all levels."""
    per = finite(points).select("x", "y", "z", F.explode(F.array(*[F.lit(b) for b in levels])).alias("b"))
    per = per.groupBy("b", *[G.cell_coordinate(F.col(a), 0.0, 1.0, F.col("b")).alias(f"c{a}") for a in "xyz"]).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("b").agg(F.count(F.lit(1)).alias("occupied"), F.max("n").alias("max_n"), F.sum("n").alias("points"))


def crowded(points: DataFrame, b: int, most: int) -> DataFrame:
    """ids of the points whose cell holds at least most points: those a crowded-cell guard would set aside."""
    cells = occupancy(points, b).where(F.col("n") >= most).select(F.col("cell").alias("full"), "n")
    return index_of_cells(finite(points), b).join(cells, F.col("cell") == F.col("full")).select("id", "cell", "n")


def gap_density(points: DataFrame, axis: str = "x", parts: int | None = None) -> DataFrame:
    """id and the distance to the next point along an axis, for all but the last. See order.gaps."""
    from pointloom.operators.order import gaps

    return gaps(points.select("id", F.col(axis).alias("v")), parts)


def spatial_order(points: DataFrame, b: int, parts: int | None = None) -> DataFrame:
    """(id, old_pos, new_pos): places by id, and by cell and id among b cells an axis, so that neighbours lie together."""
    from pointloom.operators.order import permutation

    return permutation(index_of_cells(points, b).select("id", "cell"), "cell", parts)


def split_queries(points: DataFrame, n_refs: int, parts: int | None = None) -> DataFrame:
    """(id, place) of the queries in a table that holds references with ids below n_refs and queries from there on, closed up."""
    from pointloom.operators.order import compact

    return compact(points.select("id"), "id", F.col("id") >= n_refs, parts).select("id", F.col("place").cast("long").alias("place"))
