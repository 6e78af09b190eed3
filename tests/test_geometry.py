"""Properties and hand-made cases of the cloud, mesh and graph operators."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import cloud, egg, graph, knn, mesh, normals, order, smoothing
from pointloom.operators.components import components
from pointloom.operators.providers import RADIUS, RING, SELF, Nearest, Neighbours, Ring, Within
from pointloom.plans import pipeline, queries, storage

POINTS = "id long, x double, y double, z double"


def points(spark, xyz, ids=None):
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids if ids is not None else range(len(xyz)), xyz, strict=True)], POINTS)


def noise(n, seed=0):
    return np.random.default_rng(seed).random((n, 3))


def nearest(xyz, k):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(xyz)) for j in np.lexsort((np.arange(len(xyz)), d[i]))[: min(k, len(xyz) - 1)]}


def pairs(df):
    return {(r["id"], r["nid"]) for r in df.collect()}


def output_rows(plan):
    """Rows that each node of a plan that has run gave out."""
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    plan = plan.plan() if plan.getClass().getSimpleName().endswith("QueryStageExec") else plan
    found = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
    return found + [n for i in range(plan.children().size()) for n in output_rows(plan.children().apply(i))]


@pytest.fixture(params=[0, 1, 2], autouse=False)
def finish(request, monkeypatch):
    monkeypatch.setattr(knn, "GRID_ROUNDS", request.param)


@pytest.mark.usefixtures("finish")
@pytest.mark.parametrize(("n", "k", "cells"), [(120, 5, None), (120, 5, 16), (3, 8, None), (1, 4, None), (0, 4, None)])
def test_grid_neighbours_are_all_there(spark, n, k, cells):
    xyz = noise(n)
    assert pairs(knn.knn_self(points(spark, xyz), k, cells=cells)) == (nearest(xyz, k) if n else set())


def test_neighbours_do_not_depend_on_partitions_or_order(spark):
    xyz = noise(80, 4)
    want = pairs(knn.knn_self(points(spark, xyz), 4))
    assert pairs(knn.knn_self(points(spark, xyz).orderBy(F.desc("id")).repartition(7), 4)) == want
    assert pairs(knn.knn_self(points(spark, xyz * 10 + 3), 4)) == want


def test_all_pairs_are_compared_but_no_rows_made(spark, monkeypatch):
    """A row a pair filled the disk when sorted: their number grows with the square of the points."""
    monkeypatch.setattr(knn, "BLOCK", 64, raising=False)
    monkeypatch.setattr(knn, "STRETCH", 24, raising=False)
    xyz = np.round(noise(500, 21), 1)  # ties and points in one place
    p = points(spark, [*map(tuple, xyz.tolist()), (float("nan"), 0.5, 0.5)]).repartition(3)
    got = knn.knn_bruteforce(p, 6)
    rows = sorted((r["id"], r["rank"], r["nid"], r["d2"]) for r in got.collect())
    u = {r["id"]: (r["x"], r["y"], r["z"]) for r in cloud.normalise(p).collect() if r["id"] < 500}
    dist = lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])
    want = [(i, k + 1, j, d) for i in u for k, (d, j) in enumerate(sorted((dist(u[i], u[j]), j) for j in u if j != i)[:6])]
    assert max(output_rows(got._jdf.queryExecution().executedPlan())) < 500 * 499 / 10
    assert rows == sorted(want)


def test_query_outside_the_cube(spark):
    refs, q = noise(60, 1), np.array([[-2.0, 0.5, 0.5], [0.5, 0.5, 3.0], [0.4, 0.4, 0.4]])
    got = pairs(knn.knn_query(points(spark, q), points(spark, refs), 3, cells=8))
    d = ((q[:, None] - refs[None]) ** 2).sum(-1)
    assert got == {(i, int(j)) for i in range(3) for j in np.argsort(d[i])[:3]}


def crowds(kind):
    r = np.random.default_rng(11)
    if kind == "cluster and outlier":
        return np.concatenate((r.random((1200, 3)) * 1e-3, [[1.0, 1.0, 1.0]]))
    if kind == "copies":
        return np.concatenate((np.full((300, 3), 0.5), r.random((150, 3))))
    return np.concatenate((r.random((250, 3)) * 1e-9, r.random((250, 3)) * 1e-9 + 0.7, r.random((30, 3))))


@pytest.mark.parametrize("kind", ["cluster and outlier", "copies", "far clusters"])
def test_neighbours_in_uneven_clouds(spark, kind):
    xyz = crowds(kind)
    lo, hi = xyz.min() - 1e-6, xyz.max() + 1e-6
    assert pairs(knn.knn_self(points(spark, xyz), 5)) == nearest((xyz - lo) / (hi - lo), 5)


@pytest.mark.parametrize("kind", ["cluster and outlier", "copies", "far clusters"])
def test_candidates_stay_few_in_uneven_clouds(spark, kind):
    u = cloud.normalise(points(spark, crowds(kind))).cache()
    n = u.count()
    per = knn._descend(u, u, n, 5, None, True).groupBy("id").count().agg(F.avg("count"), F.max("count")).first()
    assert 5 <= per[0] < 8 * knn.leaf(6)
    assert per[1] < n / 2


def test_dense_clouds_are_met_by_finer_grids(spark, monkeypatch):
    """Nearly all of a cloud that is dense in its middle descended the tree, whose fronts filled the disk."""
    monkeypatch.setattr(knn, "WORTH", 100, raising=False)
    left, descend = [], knn._descend
    monkeypatch.setattr(knn, "_descend", lambda q, *rest: left.append(q.count()) or descend(q, *rest))
    r = np.random.default_rng(31)
    xyz = np.concatenate((0.4 + 0.2 * r.random((2400, 3)), r.random((100, 3)), [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]))
    lo, hi = xyz.min() - 1e-6, xyz.max() + 1e-6
    rows = [(x["id"], x["nid"], x["rank"]) for x in knn.knn_self(points(spark, xyz), 5).collect()]
    assert {x[:2] for x in rows} == nearest((xyz - lo) / (hi - lo), 5)
    assert len(set(rows)) == len(rows) == 5 * len(xyz)
    assert sum(left) < len(xyz) / 2


def within(xyz, radius, q=None):
    q = xyz if q is None else q
    d = ((q[:, None] - xyz[None]) ** 2).sum(-1)
    return {(int(i), int(j)) for i, j in np.argwhere(d <= radius**2)}


@pytest.mark.parametrize("part", [4, 4096])
@pytest.mark.parametrize("kind, radius", [("cluster and outlier", 1e-4), ("copies", 0.2), ("copies", 0.0), ("far clusters", 2e-10), ("far clusters", 2.0)])
def test_radius_in_uneven_clouds(spark, monkeypatch, kind, radius, part):
    monkeypatch.setattr(knn, "PART", part)
    xyz = crowds(kind)
    got = [(r["id"], r["nid"]) for r in knn.radius_join(points(spark, xyz).repartition(3), radius).collect()]
    assert len(got) == len(set(got))
    near = {(i, j) for i, j in within(xyz, radius * (1 - 1e-6)) if i != j}
    assert near <= set(got) <= {(i, j) for i, j in within(xyz, radius * (1 + 1e-6)) if i != j}


@pytest.mark.parametrize("part", [2, 4096])
def test_radius_around_queries(spark, monkeypatch, part):
    monkeypatch.setattr(knn, "PART", part)
    refs, q = noise(300, 7), np.concatenate((noise(200, 8) * 3 - 1, [[1e300, 0.0, 0.0], [np.nan, 0.5, 0.5]]))
    got = sorted((r["id"], r["nid"]) for r in knn.radius_join(points(spark, refs), 0.3, points(spark, q)).collect())
    assert got == sorted(within(refs, 0.3, q[:200]))


def test_radius_candidates_stay_linear_in_the_answers(spark):
    """2,000 points in a unit cube and one a million away once met each other in full."""
    xyz = np.concatenate((np.random.default_rng(0).random((2000, 3)), [[1e6, 1e6, 1e6]]))
    p = points(spark, xyz)
    b = cloud.extent(p).first()
    u = cloud.normalise(p).cache()
    for radius in (0.01, 0.1):
        met = knn.pairs_within(u, u, knn.cells_of_radius(radius / (b["hi"] - b["lo"]))).count()
        assert met <= 216 * (len(within(xyz, radius)))  # each point is its own answer here
    assert knn.pairs_within(u, u, knn.cells_of_radius(0.01 / (b["hi"] - b["lo"]))).count() < 3 * 2001


def test_radius_of_no_points(spark):
    none = points(spark, noise(3, 1)).limit(0)
    nowhere = points(spark, np.full((2, 3), np.nan))
    for p in (none, nowhere):
        assert knn.radius_join(p, 0.5).collect() == [] and knn.knn_self(p, 2, max_radius=0.5).collect() == []
        assert knn.radius_join(p, 0.5, points(spark, noise(3, 1))).collect() == []


def test_many_queries_outside_the_cube(spark):
    r = np.random.default_rng(3)
    refs, q = noise(400, 2), r.normal(size=(10_000, 3)) * 20
    u, b = cloud.normalise(points(spark, refs)), cloud.extent(points(spark, refs))
    far = cloud.normalise(points(spark, q), b).cache()
    candidates = knn._descend(far, u, 400, 3, None, False).count()
    assert candidates < 10_000 * 60
    got = defaultdict(set)
    for e in knn.knn_join(far, u, 3).collect():
        got[e["id"]].add(e["nid"])
    for i in range(0, 10_000, 97):
        assert got[i] == set(np.lexsort((np.arange(400), ((q[i] - refs) ** 2).sum(1)))[:3].tolist())
    assert len(got) == 10_000


def test_points_without_a_place_take_no_part(spark):
    xyz = noise(60, 5)
    xyz[3], xyz[4], xyz[5] = np.nan, np.inf, (0.5, -np.inf, 0.5)
    p = points(spark, xyz).unionByName(spark.createDataFrame([(100, None, 0.5, 0.5)], POINTS))
    got = pairs(knn.knn_self(p, 4))
    kept = np.array([i for i in range(60) if i not in (3, 4, 5)])
    assert got == {(int(kept[a]), int(kept[b])) for a, b in nearest(xyz[kept], 4)}
    far = points(spark, [(1e12, 0.5, 0.5)])
    assert knn.knn_query(far, points(spark, xyz[kept]), 4).count() == 4
    assert {r["id"]: r["out"] for r in cloud.outside(p).where("id in (3, 4, 5, 6, 100)").collect()} == {3: True, 4: True, 5: True, 6: False, 100: True}


def test_cube_ties_take_the_lowest_id(spark):
    xyz = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    got = knn.knn_self(points(spark, xyz), 3).groupBy("id").agg(F.max("d2").alias("d")).collect()
    assert len(got) == 8
    assert len({round(r["d"], 9) for r in got}) == 1


def test_pruning_forms_agree_and_shrink_with_alpha(spark):
    u = cloud.normalise(points(spark, noise(90, 2)))
    e = knn.knn_self(points(spark, noise(90, 2)), 8)
    sets = []
    for alpha in (1e-4, 0.4, 0.65, 1.0):
        a, b = pairs(egg.elliptic_gabriel(u, e, alpha)), pairs(egg.elliptic_gabriel_join(u, e, alpha))
        assert a == b <= pairs(e)
        sets.append(a)
    assert sets[0] == pairs(e)
    assert sets[0] >= sets[1] >= sets[2] >= sets[3]


def test_line_keeps_neighbours_only(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (2.1, 0, 0), (3.5, 0, 0), (4.2, 0, 0)])
    assert pairs(egg.elliptic_gabriel(cloud.normalise(p), knn.knn_self(p, 4), 0.65)) == {(i, j) for i in range(5) for j in range(5) if abs(i - j) == 1}


def test_ellipsoid_in_its_frame(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, rng.random(9))) for _ in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{a} double" for p in "pcq" for a in "xyz"))
    p, c, q = (G.vec(k) for k in "pcq")
    mid = tuple((a + b) / 2 for a, b in zip(p, c, strict=True))
    t = G.to_frame(G.frame(G.sub(c, p)), mid, q)
    in_frame = t[0] * t[0] + (t[1] * t[1] + t[2] * t[2]) / (0.65 * 0.65) < G.squared_distance(p, c) / 4
    assert df.where(in_frame != G.in_ellipsoid(p, c, q, 0.65)).count() == 0


def test_taubin_without_scale_or_neighbours_stays(spark):
    p = points(spark, noise(20, 3))
    e = knn.knn_self(p, 3)
    assert smoothing.taubin(p, e, 1, 0.0, 0.0).exceptAll(p).count() == 0
    assert smoothing.taubin(p, e.limit(0), 1).exceptAll(p).count() == 0


def test_taubin_forms_agree(spark):
    p, e = points(spark, noise(60, 6)), knn.knn_self(points(spark, noise(60, 6)), 3)
    a = np.array(sorted(map(tuple, smoothing.taubin(p, e, 3).collect())))
    for most in (1000, 1):
        assert np.allclose(a, sorted(map(tuple, smoothing.taubin_many(p, e, 3, most=most).collect())), atol=1e-12)


@pytest.mark.parametrize(("most", "at_once"), [(15, 1), (20, 2), (7, 3)])
def test_taubin_blocks_with_halos(spark, most, at_once):
    xyz = noise(80, 16)
    p, e = points(spark, xyz), knn.knn_self(points(spark, xyz), 4)
    x, u, v = xyz, *np.array([(r["id"], r["nid"]) for r in e.collect()]).T
    want = smoothing._kernel(x, u, v, 7, smoothing.LAMBDA, smoothing.MU)
    got = smoothing.taubin_many(p, e.select("id", "nid").union(spark.createDataFrame([(3, 10**6), (10**6, 3)], "id long, nid long")), 7, most=most, at_once=at_once)
    assert np.allclose(want, [tuple(r)[1:] for r in got.orderBy("id").collect()], atol=1e-12)


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(8)
    p = points(spark, np.column_stack((rng.random((50, 2)), np.zeros(50))))
    for exact in (False, True):
        got = normals.pca_normals(p, knn.knn_self(p, 6), exact).collect()
        assert all(abs(abs(r["nz"]) - 1) < 1e-6 for r in got)


def test_normal_needs_two_neighbours(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0)])
    assert [r["nx"] for r in normals.pca_normals(p, knn.knn_self(p, 1)).collect()] == [None, None]


def test_pipelines_take_any_provider(spark):
    """The k nearest, all within a distance, a mesh's ring, and one that is written here."""

    class Given:
        can = frozenset((SELF,))

        def __init__(self, df):
            self.df = df

        def edges(self, unit):
            return self.df

        def cross(self, queries, unit):
            raise NotImplementedError

    p, f = points(spark, noise(60, 3)), spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(58)], "face_id long, v0 long, v1 long, v2 long")
    unit = cloud.normalise(p)
    own = Nearest(6).edges(unit)
    for provider in (Nearest(6), Nearest(6, 0.5), Within(0.35), Ring(f), Given(own)):
        assert isinstance(provider, Neighbours) and SELF in provider.can
        got = pipeline.smooth_cloud(p, iterations=2, neighbours=provider).collect()
        assert len(got) == 60 and all(math.isfinite(r["x"]) for r in got)
    assert pairs(Within(0.35).edges(unit)) == {(i, j) for i, j in pairs(Nearest(59).edges(unit).where("d2 <= 0.35 * 0.35"))}
    assert pairs(Within(0.35).cross(unit.where("id < 9"), unit)) - {(i, i) for i in range(9)} == {(i, j) for i, j in pairs(Within(0.35).edges(unit)) if i < 9}
    assert RADIUS not in Nearest(3).can and RING in Ring(f).can
    with pytest.raises(NotImplementedError):
        Ring(f).cross(unit, unit)


def test_components_agree_over_the_unpruned_neighbours(spark):
    """Two flat patches side by side whose forests do not touch: the smaller vertex's direction wins for both."""
    xyz = [(x / 4, y / 4, 0.001 * ((x * 7 + y * 3) % 5)) for x in range(8) for y in range(4)]
    p = points(spark, xyz)
    rows = [(i, 0.0, 0.0, 1.0 if i < 16 else -1.0, 0 if i < 16 else 16) for i in range(32)]
    oriented = spark.createDataFrame(rows, "id long, nx double, ny double, nz double, comp long")
    near = knn.knn_self(p, 5)
    assert {r["nz"] for r in pipeline.agreed(oriented, near).collect()} == {1.0}
    inside = near.where("(id < 16) = (nid < 16)")
    assert {r["nz"] for r in pipeline.agreed(oriented, inside).collect()} == {1.0, -1.0}


def test_sphere_points_one_way(spark):
    i = np.arange(200) + 0.5
    phi, theta = np.arccos(1 - 2 * i / 200), math.pi * (1 + 5**0.5) * i
    xyz = np.stack((np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)), 1)
    p = points(spark, xyz)
    got = pipeline.oriented_normals(p, knn.knn_self(p, 8)).collect()
    side = {np.sign(np.dot(xyz[r["id"]], (r["nx"], r["ny"], r["nz"]))) for r in got}
    assert len(side) == 1


def plain_kruskal(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for w, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((u, v, w))
    return sorted(out)


def some_graph(kind):
    rng = random.Random(1)
    if kind == "chain":  # each component's lightest edge leads on along it
        return {(i, i + 1): 1.0 - i / 100 for i in range(40)}
    if kind == "dense":
        return {(i, j): rng.random() for i in range(30) for j in range(i + 1, 30)}
    return {(min(a, b), max(a, b)): rng.choice((0.1, 0.5, rng.random())) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a != b}


@pytest.mark.parametrize("kind, task", [("ties", 1), ("ties", 50), ("ties", None), ("chain", 1), ("chain", 8), ("dense", 70), ("dense", 1)])
def test_forest_is_kruskals(spark, kind, task):
    rng, es = random.Random(2), some_graph(kind)
    df = spark.createDataFrame([(u, v, w, rng.choice((1, -1))) for (u, v), w in es.items()], "u long, v long, w double, s int")
    forest, labels = graph.spanning_forest(df, task)
    assert sorted(map(tuple, forest.collect())) == plain_kruskal([(w, u, v) for (u, v), w in es.items()])
    sign = {r["id"]: (r["comp"], r["sign"]) for r in labels.collect()}
    s = {(r["u"], r["v"]): r["s"] for r in df.collect()}
    for r in forest.collect():
        a, b = sign[r["u"]], sign[r["v"]]
        assert a[0] == b[0]
        assert a[1] * b[1] == s[r["u"], r["v"]]
    assert all(c <= i and sign[c] == (c, 1) for i, (c, _) in sign.items())


def test_own_forests_keep_all_that_counts(spark):
    es = some_graph("dense")
    df = spark.createDataFrame([(u, v, w, u, v, 1) for (u, v), w in es.items()], graph.OPEN)
    left = {(r["u"], r["v"], r["w"]) for r in graph._own_forests(df, 3).collect()}
    assert set(plain_kruskal([(w, u, v) for (u, v), w in es.items()])) <= left and len(left) <= 3 * 29


def test_forest_of_nothing(spark):
    for task in (1, None):
        forest, labels = graph.spanning_forest(spark.createDataFrame([], "u long, v long, w double, s int"), task)
        assert (forest.count(), labels.count()) == (0, 0)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (7, 7)], [(3, 1), (1, 3), (9, 8)]])
def test_components(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    for parts in (1, 7):
        got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(parts)).collect()}
        assert got == {x: find(x) for x in up}


def test_flips_make_components_agree(spark):
    rows = [(i, 0.0, 0.0, 1.0 if i < 5 else -1.0, 0 if i < 5 else 5) for i in range(10)]
    n = spark.createDataFrame(rows, "id long, nx double, ny double, nz double, comp long")
    e = spark.createDataFrame([(4, 5), (5, 4), (3, 6)], "id long, nid long")
    v = graph.component_votes(e, n)
    assert [tuple(r) for r in v.collect()] == [(0, 5, -3, -1)]
    assert {r["nz"] for r in graph.flip_components(n, v).collect()} == {1.0}


def test_tetrahedron(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3), (2, 1, 2, 3), (3, 0, 2, 3), (4, mesh.NO_VERTEX, 1, 2)], "face_id long, v0 long, v1 long, v2 long")
    assert {r["degree"] for r in mesh.vertex_degree(f).collect()} == {3}
    assert mesh.boundary_edges(f).count() == 0
    assert tuple(mesh.euler(p, f).first()) == (4, 6, 4, 2)
    assert mesh.one_ring(p, f, 2).groupBy("id").count().where("count <> 2").count() == 0


def polygon_area(xyz):
    return np.linalg.norm(sum(np.cross(xyz[i], xyz[(i + 1) % len(xyz)]) for i in range(len(xyz)))) / 2


@pytest.mark.parametrize("xy", [[(0, 0), (2, 0), (3, 1), (1, 3), (0, 2)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (3, 2), (3, 3), (0, 3)]])
def test_ears_cover_the_polygon(spark, xy):
    xyz = np.array([(x, y, 0.5 * x) for x, y in xy], float)
    t = mesh.ear_clip(xyz)
    assert len(t) == len(xy) - 2
    assert abs(sum(polygon_area(xyz[list(i)]) for i in t) - polygon_area(xyz)) < 1e-9


def test_polygons_with_unknown_corners_give_nothing(spark):
    p = points(spark, [(0, 0, 0), (2, 0, 0), (3, 1, 0), (1, 3, 0), (np.nan, 2, 0)])
    f = spark.createDataFrame([(0, [0, 1, 2, 3, 4]), (1, [0, 1, 2, 3, 99]), (2, [0, 1, 2, None, 3]), (3, [0, 1, 2, 3, 0])], "face_id long, vertex_indices array<long>")
    assert {r["face_id"] for r in mesh.triangulate(p, f).collect()} == {3}


def test_points_without_a_place_in_sums_and_gaps(spark):
    nan, inf = float("nan"), float("inf")
    p = spark.createDataFrame([(0, 0.1, 0.2, 0.3), (1, 0.4, 0.1, 0.9), (2, 0.5, 0.5, 0.1), (3, nan, 0.0, 0.0), (4, 0.0, inf, 0.0), (5, None, 0.0, 0.0), (6, 0.9, 0.8, 0.2)], "id long, x double, y double, z double")
    e = spark.createDataFrame([(a, b) for a in range(7) for b in range(7) if a != b], "id long, nid long")
    good = p.where("id in (0, 1, 2, 6)")
    for exact in (False, True):
        got = {r["id"]: (r["nx"], r["ny"], r["nz"]) for r in normals.pca_normals(p, e, exact).collect()}
        want = {r["id"]: (r["nx"], r["ny"], r["nz"]) for r in normals.pca_normals(good, e, exact).collect()}
        assert all(got[i] == pytest.approx(want[i]) for i in want) and all(got[i] == (None, None, None) for i in (3, 4, 5))
    a = {r["id"]: tuple(r)[1:] for r in smoothing.taubin(p, e, 2).collect()}
    b = {r["id"]: tuple(r)[1:] for r in smoothing.taubin_many(p, e, 2).collect()}
    for i in (0, 1, 2, 6):
        assert a[i] == pytest.approx(b[i])
    assert a[5] == (None, 0.0, 0.0) and a[4] == b[4] == (0.0, inf, 0.0) and math.isnan(a[3][0]) and math.isnan(b[3][0])
    assert cloud.occupancy(p, 4).agg(F.sum("n")).first()[0] == 4
    v = spark.createDataFrame([(0, 1.0), (1, nan), (2, 4.0), (3, -inf), (4, None), (5, 2.0), (6, inf)], "id long, v double")
    assert sorted(tuple(r) for r in order.gaps(v).collect()) == [(0, 1.0, 1.0), (5, 2.0, 2.0)]
    assert {r["nid"] for r in knn.nearest_to(p, 0, 9).collect()} == {1, 2, 6}
    assert knn.nearest_to(p, 77).collect() == [] == knn.nearest_to(p, 3).collect()


@pytest.mark.parametrize("order_", [1, -1, 0])
def test_bases_are_right_handed_and_hold_for_equal_eigenvalues(spark, order_):
    r = np.random.default_rng(5)
    shapes = {0: r.random((9, 3)), 100: np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)], float), 200: np.concatenate((np.eye(3), -np.eye(3))), 300: np.array([(1, 1, 1), (2, 2, 2)], float), 400: np.zeros((3, 3))}
    rows = [(o, 0.0, 0.0, 0.0) for o in shapes] + [(o + 1 + i, *map(float, v)) for o, s in shapes.items() for i, v in enumerate(s)]
    edges = [(o, o + 1 + i) for o, s in shapes.items() for i in range(len(s))]
    p, e = spark.createDataFrame(rows, "id long, x double, y double, z double"), spark.createDataFrame(edges, "id long, nid long")
    a = {s["id"]: np.array([[s[normals.TERMS[k]] for k in row] for row in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]) for s in normals.scatter(p, e).collect()}
    for b in normals.eigen_bases(p, e, order_).collect():
        v, w = np.array([b[c] for c in normals.BASIS]).reshape(3, 3), np.array([b["e0"], b["e1"], b["e2"]])
        assert np.allclose(v @ v.T, np.eye(3)) and np.linalg.det(v) > 0.999
        assert np.allclose(v @ a[b["id"]], w[:, None] * v, atol=1e-9)
        assert order_ == 0 or (np.diff(w) * order_ >= -1e-12).all()
        s = shapes[b["id"]]
        g = s.sum(0) / (len(s) + 1)
        assert np.allclose(a[b["id"]], (s - g).T @ (s - g))


def test_one_query_opens_few_row_groups(spark, tmp_path):
    xyz = noise(20_000, 31)
    laid = knn.lay_out(points(spark, xyz).repartition(4), str(tmp_path / "laid"), group=20_000)
    u = {r["id"]: (r["x"], r["y"], r["z"]) for r in laid.collect()}
    for i in (0, 7, 4321):
        d = sorted((sum((a - b) ** 2 for a, b in zip(u[i], v, strict=True)), j) for j, v in u.items() if j != i)[:12]
        got = knn.nearest_in(laid, u[i], 12, but=i).collect()
        assert [(r["nid"], r["rank"]) for r in got] == [(j, n) for n, (_, j) in enumerate(d, 1)]
        box = knn.box_around(laid, u[i], 0.05)
        box.collect()
        assert scanned_rows(box) < 20_000 / 3
    assert [r["nid"] for r in knn.nearest_in(laid.limit(0), (0.5, 0.5, 0.5), 3).collect()] == []
    assert len(knn.nearest_in(laid, (-3.0, 9.0, 0.5), 5).collect()) == 5


def scanned_rows(df):
    """Rows that left the file scan of a query that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.length()))


def test_triangulate_mixed(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (-1, 0.5, 0)])
    f = spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 1, 2, 3]), (2, [0, 1, 2, 3, 4]), (3, [0, 1]), (4, [])], "face_id long, vertex_indices array<long>")
    got = mesh.triangulate(p, f).groupBy("face_id").count().collect()
    assert {r["face_id"]: r["count"] for r in got} == {0: 1, 1: 2, 2: 3}
    assert tuple(mesh.triangle_count(f).first()) == (6, True)
    assert mesh.fixed_columns(f, "vertex_indices", 3).where("vertex_indices_count = 2 and vertex_indices_2 is null").count() == 1


def test_large_meshes_in_small_files_are_not_broadcast(spark):
    """Files of ids in order are a fraction of their rows; by their size the points of 1.2 million parts went through the driver."""
    sf, key = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")  # 2,000 rows take 5 kB of the file and 32 kB at least in memory
    try:
        with storage.scratch(spark):
            p, q = queries.lattice(spark, sf), queries.quads(spark, sf)
            a = F.col("face_id")
            five = q.where(a % 20 < 18).select("face_id", F.array(a, a + 1, a + 2, a + 21, a + 20).alias("vertex_indices"))
            for df, n in ((q, 1881), (mesh.triangulate(p, five), 3 * 1782), (mesh.face_areas(p, queries.faces(spark, sf)), 3762), (queries.mesh_triangulate_polygons(spark, sf), 1782)):
                assert len(df.collect()) == n
                assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_running_sums(spark):
    vals = [(i * 7 % 31, i) for i in range(31)]
    df = spark.createDataFrame(vals, "k long, v long")
    got = {r["k"]: (r["exclusive"], r["inclusive"]) for r in order.prefix_sum(df, "k", "v", 5).collect()}
    run = 0
    for k, v in sorted(vals):
        assert got[k] == (run, run + v)
        run += v
    assert order.prefix_sum(df.limit(0), "k", "v").count() == 0


def test_degenerate_extent(spark):
    p = points(spark, [(2, 2, 2)])
    r = cloud.normalise(p).first()
    assert all(0 <= r[a] <= 1 for a in "xyz")


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    """Those of all steps stayed until the driver collected its garbage: 50 exchanges of a large cloud's blocks and more."""

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    cleaned = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(cleaned, None)
    out = storage.materialize(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 10).alias("k")).count(), "shuffled")
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(cleaned, None) == setting
    assert out.agg(F.sum("count")).first()[0] == 1000


def test_pipeline_covers_all_points(spark):
    p = points(spark, noise(70, 9) * 5 - 1, range(100, 170))
    out = pipeline.smooth_cloud(p, k=6, iterations=7)
    assert {r["id"] for r in out.collect()} == set(range(100, 170))
    u = cloud.normalise(p)
    lone = egg.degree(egg.elliptic_gabriel(u, knn.knn_self(p, 6))).where("degree < 2").count()  # too few neighbours for a plane
    assert out.where("nx is null").count() == lone < 5
