"""Pruning a neighbour graph to the elliptic Gabriel graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import geometry as G

#: Edges whose half length is below this stay.
SHORT = 1e-6


def _placed(points: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with both ends' coordinates: p is the point, c its neighbour."""
    p = points.select(F.col("id").alias("pid"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    c = points.select(F.col("id").alias("cid"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    return edges.join(c, F.col("nid") == F.col("cid")).join(p, F.col("id") == F.col("pid")).drop("cid", "pid")


def elliptic_gabriel(points: DataFrame, edges: DataFrame, alpha: float = 0.65) -> DataFrame:
    """The edges (id, nid, d2, rank) that no nearer neighbour of id blocks.

    A nearer-ranked neighbour blocks an edge if it lies strictly inside the spheroid around it whose cross half axes are
    alpha times half its length. All nearer neighbours count, pruned or not, so the result does not depend on an order.
    One shuffle by id gathers a point's few neighbours in an array, on which the test is a higher-order function; points
    and edges are in normalised coordinates.
    """
    at = F.struct("rank", "nid", "d2", "cx", "cy", "cz")
    rows = _placed(points, edges).groupBy("id", "px", "py", "pz").agg(F.sort_array(F.collect_list(at)).alias("near"))
    p = G.vec("p")

    def stays(c):
        own = tuple(c[f"c{a}"] for a in "xyz")
        blocked = F.exists("near", lambda q: (q["rank"] < c["rank"]) & G.in_ellipsoid(p, own, tuple(q[f"c{a}"] for a in "xyz"), alpha))
        return (F.sqrt(G.squared_distance(p, own)) / 2 < SHORT) | ~F.coalesce(blocked, F.lit(False))

    return rows.select("id", F.inline(F.transform(F.filter("near", stays), lambda c: F.struct(c["nid"].alias("nid"), c["d2"].alias("d2"), c["rank"].alias("rank")))))


def elliptic_gabriel_join(points: DataFrame, edges: DataFrame, alpha: float = 0.65) -> DataFrame:
    """The same as an anti join: for graphs whose rows are too long for one array."""
    e = _placed(points, edges)
    q = e.select(F.col("id").alias("qid"), F.col("rank").alias("qrank"), *[F.col(f"c{a}").alias(f"q{a}") for a in "xyz"])
    long_ = F.sqrt(G.squared_distance(G.vec("p"), G.vec("c"))) / 2 >= SHORT
    blocks = (F.col("id") == F.col("qid")) & (F.col("qrank") < F.col("rank")) & long_ & G.in_ellipsoid(G.vec("p"), G.vec("c"), G.vec("q"), alpha)
    return e.join(q, blocks, "left_anti").select("id", "nid", "d2", "rank")


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
