"""Weighted neighbour graphs: spanning forests, orientation along them, votes between components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.plans.storage import materialize

#: Edges that a task reduces to their own forest at once.
TASK = 250_000


def undirected(edges: DataFrame, normals: DataFrame) -> DataFrame:
    """(u, v, w, s) with u < v: each undirected edge once, weight max(0, 1 - |n_u . n_v|) and the sign of n_u . n_v (+1 for 0).

    Edges at points without a normal are left out.
    """
    e = edges.select(F.least("id", "nid").alias("u"), F.greatest("id", "nid").alias("v")).where("u <> v").distinct()
    n = normals.where("nx is not null")
    a = n.select(F.col("id").alias("aid"), *[F.col(f"n{x}").alias(f"a{x}") for x in "xyz"])
    b = n.select(F.col("id").alias("bid"), *[F.col(f"n{x}").alias(f"b{x}") for x in "xyz"])
    both = e.join(a, F.col("u") == F.col("aid")).join(b, F.col("v") == F.col("bid"))
    return both.select("u", "v", G.mst_weight(G.vec("a"), G.vec("b")).alias("w"), F.when(G.dot(G.vec("a"), G.vec("b")) < 0, F.lit(-1)).otherwise(F.lit(1)).alias("s"))


def distance_edges(edges: DataFrame) -> DataFrame:
    """(u, v, w, s) with u < v: each undirected edge once, weighed by its squared distance to 12 decimals; s is 1."""
    e = edges.select(F.least("id", "nid").alias("u"), F.greatest("id", "nid").alias("v"), "d2").where("u <> v")
    return e.groupBy("u", "v").agg(F.round(F.min("d2"), 12).alias("w")).withColumn("s", F.lit(1))


def local_forest(cu: np.ndarray, cv: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edges of the minimum spanning forest, vertices, the smallest vertex of each one's component, sign of the path to it).

    Edges join cu and cv with sign r and are ordered by (w, u, v); whole arrays go from round to round: each component takes
    its lightest edge, which is the first of those that still leave it.
    """
    order = np.lexsort((v, u, w))
    verts, ends = np.unique(np.concatenate((cu[order], cv[order])), return_inverse=True)
    a, b = ends[: len(order)], ends[len(order) :]
    n, r = len(verts), r[order].astype(np.int64)
    comp, sign, alive, picked = np.arange(n), np.ones(n, np.int64), np.arange(len(order)), np.zeros(len(order), bool)
    while True:
        alive = alive[comp[a[alive]] != comp[b[alive]]]
        if not len(alive):
            break
        best = np.full(n, len(order))
        for x in (a, b):
            first = np.full(n, len(order))
            first[comp[x[alive]][::-1]] = alive[::-1]  # of several the last written, which is the lightest, stays
            best = np.minimum(best, first)
        c = np.flatnonzero(best < len(order))
        e = best[c]
        picked[e] = True
        up, flip = np.arange(n), np.ones(n, np.int64)
        up[c], flip[c] = np.where(comp[a[e]] == c, comp[b[e]], comp[a[e]]), r[e] * sign[a[e]] * sign[b[e]]
        top = c[(up[up[c]] == c) & (c < up[c])]  # of two that chose the same edge
        up[top], flip[top] = top, 1
        while (up[up] != up).any():
            up, flip = up[up], flip * flip[up]
        comp, sign = up[comp], sign * flip[comp]
    least = np.full(n, n)
    np.minimum.at(least, comp, np.arange(n))
    return order[picked], verts, verts[least[comp]], sign * sign[least[comp]]


OPEN = "u long, v long, w double, cu long, cv long, r int"


def _own_forests(open_: DataFrame, tasks: int) -> DataFrame:
    """OPEN: what is left when each task reduces its edges to their forest; an edge heaviest on a cycle is in no other either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(held)
            u, v, w, cu, cv, r = (c.to_numpy() for c in t.columns)
            yield from t.take(pa.array(np.sort(local_forest(cu, cv, w, u, v, r)[0]))).combine_chunks().to_batches()

    return open_.repartition(tasks, "u", "v").mapInArrow(run, OPEN)


def _last_forest(open_: DataFrame) -> DataFrame:
    """(u, v, w, s, kind) of at most TASK edges: kind 0 the forest, kind 1 the labels of cu and cv: u, its component v, sign s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            u, v, w, cu, cv, r = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            e, verts, comp, sign = local_forest(cu, cv, w, u, v, r)
            none = pa.nulls(len(verts), pa.float64())
            cols = [np.append(u[e], verts), np.append(v[e], comp), pa.concat_arrays([pa.array(w[e]), none]), np.append(np.zeros(len(e)), sign).astype(np.int32), np.append(np.zeros(len(e)), np.ones(len(verts))).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=["u", "v", "w", "s", "kind"])

    return open_.repartition(1).mapInArrow(run, "u long, v long, w double, s int, kind int")


def _counted(df: DataFrame, tag: str, *done: DataFrame) -> tuple[DataFrame, int]:
    """df written, and its number of rows, counted while they are."""
    seen = Observation()
    return materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), tag, *done), seen.get["n"]


def _hook(open_: DataFrame) -> DataFrame:
    """(c, up, sign, u, v, w): the lightest edge out of each component, toward the component it ends in."""
    way = lambda a, b: open_.select(F.col(a).alias("c"), F.struct("w", "u", "v", F.col(b).alias("to"), "r").alias("e"))
    best = way("cu", "cv").unionByName(way("cv", "cu")).groupBy("c").agg(F.min("e").alias("e"))
    return best.select("c", F.col("e.to").alias("up"), F.col("e.r").alias("sign"), F.col("e.u").alias("u"), F.col("e.v").alias("v"), F.col("e.w").alias("w"))


def _roots(hook: DataFrame) -> DataFrame:
    """(c, root, sign) along hooks whose only cycles are pairs with the same edge, of which the smaller is the root.

    Each pass of pointer jumps makes the way four times as short; whether one moved is counted while it is written.
    """
    other = hook.select(F.col("c").alias("oc"), F.col("up").alias("oup"))
    now = hook.join(other, F.col("up") == F.col("oc"), "left")
    top = (F.col("oup") == F.col("c")) & (F.col("c") < F.col("up"))
    now = now.select("c", F.when(top, F.col("c")).otherwise(F.col("up")).alias("up"), F.when(top, F.lit(1)).otherwise(F.col("sign")).cast("int").alias("sign"))
    while True:
        for _ in range(2):
            above = now.select(F.col("c").alias("oc"), F.col("up").alias("oup"), F.col("sign").alias("osign"))
            ends = F.col("up") == F.col("c")  # every component that can be met has a row
            now = now.join(above, F.col("up") == F.col("oc")).select("c", F.col("oup").alias("up"), (F.col("sign") * F.when(ends, F.lit(1)).otherwise(F.col("osign"))).alias("sign"), (F.col("oup") != F.col("up")).alias("moved"))
        seen = Observation()
        now = materialize(now.observe(seen, F.count_if("moved").alias("n")).drop("moved"), "forest-jump")
        if not seen.get["n"]:
            return now.withColumnRenamed("up", "root")


def spanning_forest(edges: DataFrame, task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of (u, v, w, s): the minimum spanning forest, unique since edges are ordered by (w, u, v).

    labels (id, comp, sign): comp is the smallest vertex of the component, sign the product of s along the forest's path to
    it. While there are too many components for that to help, rounds contract them: each takes its lightest edge, combined
    before the shuffle, and of the edges between two components the lightest stays. Then tasks of some TASK edges reduce
    theirs to a forest of their own, and those forests meet in fewer and fewer tasks until one holds what is left. Rounds
    and forests are written to the shared folder; a graph of any size ends in such a task, however many rounds come first.
    """
    task = task or TASK
    start = edges.where("u <> v").select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("s").cast("int").alias("r"))
    open_, n = _counted(start, "forest-start")
    comps, moves, picked = None, [], []
    while n > task:
        if comps is not None and 2 * comps <= task:  # each task leaves fewer edges than comps: at most half of all
            open_, n = _counted(_own_forests(open_, -(-n // task)), "forest-own", open_)
            continue
        hook, found = _counted(_hook(open_), "forest-hooks")
        roots = _roots(hook.select("c", "up", "sign"))
        picked.append(hook.select("u", "v", "w"))
        moves.append(roots)
        a, b = (roots.select(F.col("c").alias(f"{x}c"), F.col("root").alias(f"{x}root"), F.col("sign").alias(f"{x}s")) for x in "ab")
        moved = open_.join(a, F.col("cu") == F.col("ac")).join(b, F.col("cv") == F.col("bc")).where("aroot <> broot")
        rest = moved.groupBy(F.least("aroot", "broot").alias("cu"), F.greatest("aroot", "broot").alias("cv")).agg(F.min(F.struct("w", "u", "v", (F.col("r") * F.col("as") * F.col("bs")).cast("int").alias("r"))).alias("e"))
        open_, n = _counted(rest.select("e.u", "e.v", "e.w", "cu", "cv", "e.r"), "forest-open", open_)
        comps = found
    last = materialize(_last_forest(open_), "forest-last", open_)
    forest = last.where("kind = 0").select("u", "v", "w")
    labels = last.where("kind = 1").select(F.col("u").alias("id"), F.col("v").alias("comp"), F.col("s").alias("sign"))
    if not moves:
        return forest, labels
    for f in picked:
        forest = forest.unionByName(f)
    for m in reversed(moves):
        up = labels.select(F.col("id").alias("uid"), "comp", F.col("sign").alias("us"))
        labels = m.join(up, F.col("root") == F.col("uid"), "left").select(F.col("c").alias("id"), F.coalesce("comp", "root").alias("comp"), (F.col("sign") * F.coalesce("us", F.lit(1))).cast("int").alias("sign"))
    state = materialize(labels, "forest-state")
    least = state.groupBy("comp").agg(F.min(F.struct("id", "sign")).alias("m")).select(F.col("comp").alias("c"), F.col("m.id").alias("least"), F.col("m.sign").alias("ls"))
    labels = state.join(least, F.col("comp") == F.col("c")).select("id", F.col("least").alias("comp"), (F.col("sign") * F.col("ls")).cast("int").alias("sign"))
    return forest.distinct(), materialize(labels, "forest-labels")


def forest_degree(forest: DataFrame) -> DataFrame:
    return forest.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def orient(normals: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, nx, ny, nz, comp): normals flipped so that neighbours in the forest never point apart.

    The smallest vertex of a component keeps its direction, which pca_normals makes the one with a positive largest
    component. Normals at points outside the forest stay as they are, comp is then the point itself.
    """
    lab = labels.select(F.col("id").alias("lid"), "comp", "sign")
    s = F.coalesce("sign", F.lit(1)).cast("double")
    return normals.join(lab, F.col("id") == F.col("lid"), "left").select("id", *[(F.col(f"n{a}") * s).alias(f"n{a}") for a in "xyz"], F.coalesce("comp", "id").alias("comp"))


def component_votes(edges: DataFrame, oriented: DataFrame) -> DataFrame:
    """(c1, c2, votes, sign) with c1 < c2: for pairs of components that neighbour each other, agreeing minus disagreeing pairs.

    A neighbour pair in two components votes +1 if its normals' product is positive, else -1; both directions count. Pairs
    whose votes cancel out are left out.
    """
    n = oriented.where("nx is not null")
    a = n.select(F.col("id").alias("aid"), F.col("comp").alias("c1"), *[F.col(f"n{x}").alias(f"a{x}") for x in "xyz"])
    b = n.select(F.col("id").alias("bid"), F.col("comp").alias("c2"), *[F.col(f"n{x}").alias(f"b{x}") for x in "xyz"])
    e = edges.select("id", "nid").join(a, F.col("id") == F.col("aid")).join(b, F.col("nid") == F.col("bid")).where("c1 <> c2")
    vote = F.when(G.dot(G.vec("a"), G.vec("b")) > 0, F.lit(1)).otherwise(F.lit(-1))
    total = e.groupBy(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).agg(F.sum(vote).cast("long").alias("votes"))
    return total.where("votes <> 0").withColumn("sign", F.signum("votes").cast("int"))


def flip_components(oriented: DataFrame, votes: DataFrame) -> DataFrame:
    """oriented with whole components flipped, so that along a forest of the vote graph neighbours agree.

    The forest prefers pairs with many votes; the smallest component of each group stays.
    """
    e = votes.select(F.col("c1").alias("u"), F.col("c2").alias("v"), (-F.abs("votes")).cast("double").alias("w"), F.col("sign").alias("s"))
    _, lab = spanning_forest(e)
    lab = lab.select(F.col("id").alias("fid"), F.col("sign").cast("double").alias("flip"))
    s = F.coalesce("flip", F.lit(1.0))
    return oriented.join(lab, F.col("comp") == F.col("fid"), "left").select("id", *[(F.col(f"n{a}") * s).alias(f"n{a}") for a in "xyz"], "comp")
