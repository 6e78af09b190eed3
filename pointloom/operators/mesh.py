"""Triangle meshes: rings, degrees, boundaries, triangulation. faces: (face_id long, v0, v1, v2 long) or vertex lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import cloud

#: Largest unsigned 32-bit number: the mark of a vertex that is not there.
NO_VERTEX = 0xFFFFFFFF


def valid_faces(faces: DataFrame) -> DataFrame:
    """Faces without missing vertices."""
    bad = F.lit(False)
    for v in ("v0", "v1", "v2"):
        bad = bad | F.col(v).isNull() | (F.col(v) < 0) | (F.col(v) == NO_VERTEX)
    return faces.where(~bad)


def directed_edges(faces: DataFrame) -> DataFrame:
    """(id, nid): the six directed edges of each triangle, each once."""
    pairs = [("v0", "v1"), ("v1", "v0"), ("v1", "v2"), ("v2", "v1"), ("v2", "v0"), ("v0", "v2")]
    out = valid_faces(faces).select(F.inline(F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("nid")) for a, b in pairs])))
    return out.where("id <> nid").distinct()


def one_ring(points: DataFrame, faces: DataFrame, k: int | None = None) -> DataFrame:
    """(id, nid, d2, rank): the vertices that share an edge with each vertex, the k nearest where k is given."""
    a = points.select(F.col("id").alias("aid"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = points.select(F.col("id").alias("bid"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    e = directed_edges(faces).join(a, F.col("id") == F.col("aid")).join(b, F.col("nid") == F.col("bid"))
    e = e.select("id", "nid", G.squared_distance(G.vec("a"), G.vec("b")).alias("d2"))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nid")).cast("long"))
    return e if k is None else e.where(F.col("rank") <= k)


def vertex_degree(faces: DataFrame) -> DataFrame:
    return directed_edges(faces).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def edge_use(faces: DataFrame) -> DataFrame:
    """(u, v, n): each undirected edge with the number of its triangles."""
    pairs = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    out = valid_faces(faces).select(F.inline(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in pairs])))
    return out.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_use(faces).where("n = 1").select("u", "v")


def euler(points: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: vertices, edges, faces and vertices - edges + faces."""
    e, f = (x.agg(F.count(F.lit(1))).scalar() for x in (edge_use(faces), valid_faces(faces)))
    v = points.agg(F.count(F.lit(1)).alias("vertices")).withColumns({"edges": e, "faces": f})
    return v.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def face_areas(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(face_id, area). Points and faces meet by a sort, as in triangulate."""
    out = valid_faces(faces)
    for i in range(3):
        p = points.select(F.col("id").alias(f"i{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]).hint("merge")
        out = out.join(p, F.col(f"v{i}") == F.col(f"i{i}"))
    a, b, c = (tuple(F.col(f"{x}{i}") for x in "xyz") for i in range(3))
    n = G.cross(G.sub(b, a), G.sub(c, a))
    return out.select("face_id", (F.sqrt(G.dot(n, n)) / 2).alias("area"))


def triangle_count(polygons: DataFrame, lists: str = "vertex_indices") -> DataFrame:
    """One row: triangles that the polygons come to, and whether any polygon is not a triangle."""
    n = F.size(lists)
    return polygons.agg(F.coalesce(F.sum(F.when(n >= 3, n - 2).otherwise(0)), F.lit(0)).cast("long").alias("triangles"), F.coalesce(F.bool_or(n != 3), F.lit(False)).alias("requires_triangulation"))


def list_statistics(polygons: DataFrame, lists: str = "vertex_indices") -> DataFrame:
    """One row: lists, entries in all, shortest and longest."""
    n = F.size(lists)
    return polygons.agg(F.count(lists).alias("lists"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("entries"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


def fixed_columns(rows: DataFrame, lists: str, n: int) -> DataFrame:
    """A list column as <name>_count and <name>_0 to <name>_(n-1); lists of another length raise no error but fill nulls."""
    return rows.select("*", F.size(lists).cast("long").alias(f"{lists}_count"), *[F.get(lists, F.lit(i)).alias(f"{lists}_{i}") for i in range(n)]).drop(lists)


def ear_clip(corners: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a polygon with five corners or more, as positions: n - 2 of them.

    The polygon is laid into its own plane, turned so that it runs counter-clockwise, and again and again the convex corner
    with the sharpest angle that holds no other corner is cut off. Where no corner qualifies, as in a polygon that crosses
    itself, the sharpest of all is.
    """
    origin = corners[0]
    normal = np.sum([np.cross(corners[i] - origin, corners[(i + 1) % len(corners)] - origin) for i in range(len(corners))], axis=0)
    length = np.linalg.norm(normal)
    if length < 1e-30:
        return [(0, i, i + 1) for i in range(1, len(corners) - 1)]
    normal = normal / length
    u = np.cross(normal, np.eye(3)[int(np.argmin(np.abs(normal)))])
    u /= np.linalg.norm(u)
    flat = np.stack((corners @ u, corners @ np.cross(normal, u)), axis=1)
    left, out = list(range(len(corners))), []

    def turn(a: int, b: int, c: int) -> float:
        return float((flat[b, 0] - flat[a, 0]) * (flat[c, 1] - flat[a, 1]) - (flat[b, 1] - flat[a, 1]) * (flat[c, 0] - flat[a, 0]))

    while len(left) > 3:
        best = None
        for i, b in enumerate(left):
            a, c = left[i - 1], left[(i + 1) % len(left)]
            p, q = flat[a] - flat[b], flat[c] - flat[b]
            angle = float(np.arctan2(abs(p[0] * q[1] - p[1] * q[0]), p @ q))
            convex = turn(a, b, c) > 0
            free = convex and not any(turn(a, b, x) >= 0 and turn(b, c, x) >= 0 and turn(c, a, x) >= 0 for x in left if x not in (a, b, c))
            rank = (not free, not convex, angle, i)
            best = rank if best is None or rank < best else best
        i = best[3]
        out.append((left[i - 1], left[i], left[(i + 1) % len(left)]))
        del left[i]
    return [*out, tuple(left)]


def triangulate(points: DataFrame, polygons: DataFrame, lists: str = "vertex_indices") -> DataFrame:
    """(face_id, t, v0, v1, v2) from (face_id, list of vertex ids).

    Triangles stay, quads become (0, 1, 3) and (2, 3, 1); both need no coordinates and stay in SQL. Only polygons with five
    corners or more meet their points and are clipped in Python. Shorter lists give nothing, nor does a polygon of five or
    more of which a corner is null, is no point or has no place: what is left of it would be another shape.
    Points and corners meet by a sort: a file's size says little of its rows (ids in order take a byte or two each), and by
    that size Spark would send a large mesh's points through the driver.
    """
    n, at = F.size(lists), lambda i: F.get(lists, F.lit(i)).cast("long")
    tri = lambda t, a, b, c: F.struct(F.lit(t).cast("long").alias("t"), at(a).alias("v0"), at(b).alias("v1"), at(c).alias("v2"))
    small = polygons.where((n == 3) | (n == 4)).select("face_id", F.inline(F.when(n == 3, F.array(tri(0, 0, 1, 2))).otherwise(F.array(tri(0, 0, 1, 3), tri(1, 2, 3, 1)))))
    corners = polygons.where(n >= 5).select("face_id", n.alias("size"), F.posexplode(lists).alias("pos", "vid"))
    p = cloud.finite(points).select(F.col("id").alias("pid"), "x", "y", "z").hint("merge")
    rings = corners.join(p, F.col("vid") == F.col("pid")).groupBy("face_id", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "vid", "x", "y", "z"))).alias("ring"))
    rings = rings.where(F.size("ring") == F.col("size")).select("face_id", "ring")

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for face, ring in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [int(r["vid"]) for r in ring]
                out += [(face, t, ids[a], ids[b], ids[c]) for t, (a, b, c) in enumerate(ear_clip(np.array([[r["x"], r["y"], r["z"]] for r in ring])))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["face_id", "t", "v0", "v1", "v2"])

    return small.unionByName(rings.mapInArrow(clip, "face_id long, t long, v0 long, v1 long, v2 long"))
