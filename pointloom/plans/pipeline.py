"""Smoothing of clouds and meshes from file to file."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import cloud, egg, graph, knn, mesh, normals, smoothing
from pointloom.operators.providers import Nearest, Neighbours, Ring
from pointloom.plans.storage import materialize
from pointloom.sources import ply


def oriented_normals(points: DataFrame, edges: DataFrame, exact: bool = True, near: DataFrame | None = None) -> DataFrame:
    """(id, nx, ny, nz, comp) from pruned neighbours and positions, both normalised.

    Directions agree along the spanning forest of the pruned edges. near: neighbours before pruning; with them the forest's
    components vote on each other where they neighbour, and those that disagree flip as a whole. A component with which
    none votes keeps the direction of its smallest vertex.
    """
    raw = materialize(normals.pca_normals(points, edges, exact), "normals")
    _, labels = graph.spanning_forest(graph.undirected(edges, raw))
    oriented = graph.orient(raw, labels)
    return oriented if near is None else agreed(oriented, near)


def agreed(oriented: DataFrame, near: DataFrame) -> DataFrame:
    """oriented (id, nx, ny, nz, comp) with components flipped by the votes of neighbours in different ones."""
    oriented = materialize(oriented, "oriented")
    votes = materialize(graph.component_votes(near, oriented), "votes")
    return oriented if votes.isEmpty() else graph.flip_components(oriented, votes)


def unoriented_normals(points: DataFrame, k: int = 40, k_use: int = 20, exact: bool = True) -> DataFrame:
    """(id, nx, ny, nz) over the first k_use of k neighbours; directions are not aligned. For their forest see distance_forest."""
    unit, edges = _near_of(points, k, k_use)
    return normals.pca_normals(unit, edges, exact)


def distance_forest(points: DataFrame, k: int = 40, k_use: int = 20) -> DataFrame:
    """(u, v, w): the spanning forest by squared distance over the first k_use of k neighbours."""
    return graph.spanning_forest(graph.distance_edges(_near_of(points, k, k_use)[1]))[0]


def _near_of(points: DataFrame, k: int, k_use: int) -> tuple[DataFrame, DataFrame]:
    unit = materialize(cloud.normalise(points.select("id", "x", "y", "z")), "unit")
    return unit, materialize(knn.first_neighbours(Nearest(k).edges(unit), k_use), "near")


def smooth(points: DataFrame, neighbours: Neighbours, iterations: int = 150, alpha: float = 0.65) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(extent, neighbours, pruned neighbours, smoothed positions), all but the extent in the unit cube; of any provider.

    Neighbours are found once on the normalised input and pruned once; smoothing keeps them.
    """
    bounds = materialize(cloud.extent(points), "extent")
    unit = materialize(cloud.normalise(points.select("id", "x", "y", "z"), bounds), "unit")
    near = materialize(neighbours.edges(unit), "near")
    edges = materialize(egg.elliptic_gabriel(unit, near, alpha), "edges")
    return bounds, near, edges, materialize(smoothing.taubin_many(unit, edges, iterations), "smooth")


def smooth_cloud(points: DataFrame, k: int = 40, iterations: int = 150, alpha: float = 0.65, exact: bool = True, neighbours: Neighbours | None = None) -> DataFrame:
    """id, smoothed x, y, z in the input's units, and oriented normals nx, ny, nz.

    Normals use the pruned neighbours on the smoothed positions, and the others to let components agree. neighbours: another
    provider than the k nearest.
    """
    bounds, near, edges, at = smooth(points, neighbours or Nearest(k), iterations, alpha)
    n = oriented_normals(at, edges, exact, near).select(F.col("id").alias("nid"), "nx", "ny", "nz")
    return cloud.denormalise(at, bounds).join(n, F.col("id") == F.col("nid"), "left").drop("nid")


def smooth_mesh(points: DataFrame, faces: DataFrame, k: int = 40, iterations: int = 150, alpha: float = 1e-8) -> DataFrame:
    """id, smoothed x, y, z; neighbours are the k nearest of each vertex's ring, pruned like a cloud's. Faces do not change."""
    bounds, _, _, at = smooth(points, Ring(faces, k), iterations, alpha)
    return cloud.denormalise(at, bounds)


def run(spark: SparkSession, source: str, target: str, k: int, iterations: int, alpha: float, is_mesh: bool) -> None:
    """Reads a PLY file, smooths it and writes a PLY file. A file that cannot be read raises."""
    points, polygons = ply.load_mesh(spark, source)
    if not is_mesh:
        ply.write_mesh(target, smooth_cloud(points, k, iterations, alpha))
        return
    if polygons is None:
        raise ValueError("a mesh needs faces")
    tri = materialize(mesh.triangulate(points, polygons), "triangles")
    out = smooth_mesh(points, tri, k, iterations, alpha)
    rest = [c for c in points.columns if c not in ("id", "x", "y", "z")]
    if rest:
        out = out.join(points.select(F.col("id").alias("pid"), *rest), F.col("id") == F.col("pid")).drop("pid")
    ply.write_mesh(target, out, polygons)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Smooth a point cloud or a mesh")
    p.add_argument("file")
    p.add_argument("k", type=int)
    p.add_argument("iterations", type=int)
    p.add_argument("alpha", type=float)
    p.add_argument("is_mesh", type=int, choices=(0, 1))
    p.add_argument("parts", type=int, nargs="?", default=0, help="shuffle partitions; results do not depend on it")
    p.add_argument("--output", default="output.ply")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    if a.parts:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.parts))
    run(spark, a.file, a.output, a.k, a.iterations, a.alpha, bool(a.is_mesh))


if __name__ == "__main__":
    main()
