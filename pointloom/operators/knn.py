"""Neighbour joins over grids. Results are edges (id, nid, d2, rank); a missing neighbour is a missing row.

A grid round compares each query with the points in the 27 cells around its own, cube by cube in numpy. A query is done
when its k-th distance is strictly below the distance to every face of that block behind which the grid goes on: nothing
nearer, and no tie, can lie outside. Queries near crowded cells meet a grid with cells half as wide in the next round. Those
that are then left, outside the cube or in sparse surroundings descend a tree of cells instead, which is split until no cell holds many points: from level to level only cells go on that can hold one
of the k nearest, judged by the cells' bounds, so clusters, outliers and far queries meet few points too.

Points with a null or non-finite coordinate are no references, and as queries they have no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import cloud
from pointloom.plans.storage import materialize

FINEST = 1024
#: Rounds over the grid, each for the queries near cells that the one before found crowded, with cells half as wide, and the
#: number of such queries from which on there is one more. The queries that are left then descend the tree.
GRID_ROUNDS, WORTH = 3, 2_000
#: Cells an axis of the cubes that a grid round handles in one go.
SIDE = 8
#: Pairs of points that a task compares at once.
PAIRS = 1 << 21
#: Points in a block where all pairs are compared, and points that a block is compared with at once.
BLOCK, STRETCH = 1024, 256
#: Cells an axis at most of a grid as wide as a radius, whose places doubles still tell apart, and points of a cell met at once.
MOST_CELLS, PART = float(1 << 40), 4096
#: Levels that the tree goes down at once where cells are crowded, and its last level, beyond which doubles hardly resolve.
STEP, DEEPEST = 3, 48


def crowd(k: int) -> int:
    """Points in a grid cell from which on queries around it leave the grid: many times an even cloud's."""
    return 8 * k + 64


def leaf(k: int) -> int:
    """Points in a cell of the tree up to which it is not split."""
    return 2 * k + 16


def start_cells(n: int, k: int) -> int:
    """Cells an axis such that a cell holds about k / 2 points of an even cloud."""
    return max(1, min(FINEST, round((2 * max(n, 1) / max(k, 1)) ** (1 / 3) + 0.5)))


def _wide_cells(points: DataFrame, b: int) -> DataFrame:
    """points with their cells (cx, cy, cz) as longs among any number b of cells an axis; coordinates far outside stay near."""
    at = lambda a: F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(b + 1.0), F.col(a) * F.lit(float(b))))).cast("long")
    return points.select("id", "x", "y", "z", *[at(a).alias(f"c{a}") for a in "xyz"])


def _spread(cells: DataFrame) -> DataFrame:
    """A row for each of the 27 cells around each row's own, as (tx, ty, tz)."""
    for a in "xyz":
        cells = cells.withColumn(f"t{a}", F.explode(F.sequence(F.col(f"c{a}") - 1, F.col(f"c{a}") + 1)))
    return cells.drop("cx", "cy", "cz")


def cells_of_radius(radius: float) -> int:
    """Cells an axis of the unit cube, as many as are still wider than the radius by far more than rounding."""
    return int(max(1.0, min(MOST_CELLS, 1 / max(radius * (1 + 1e-3), 1 / MOST_CELLS))))


def crowded_cells(refs: DataFrame, b: int, queries: DataFrame | None = None) -> DataFrame:
    """(hx, hy, hz, into, over) of the cells that are met in parts: so many of their references, and of the queries around them.

    queries: with them also cells that many queries are near; a stream's are not counted. Counts combine before the shuffle.
    """
    cell = lambda t: _wide_cells(t, b).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))
    own = cell(refs).select(*[F.col(f"c{a}").alias(f"h{a}") for a in "xyz"], F.col("n").alias("refs"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(PART))).cast("int")
    if queries is None:
        return own.where(F.col("refs") > PART).select("hx", "hy", "hz", parts("refs").alias("into"), F.lit(1).alias("over"))
    near = own.withColumnRenamed("refs", "n") if queries is refs else cell(queries).toDF("hx", "hy", "hz", "n")
    near = near.where(F.col("n") > PART // 27)  # 27 cells of fewer are no crowd
    near = _spread(near.select(*[F.col(f"h{a}").alias(f"c{a}") for a in "xyz"], "n")).groupBy("tx", "ty", "tz").agg(F.sum("n").alias("asked"))
    both = own.join(near, reduce(Column.__and__, [F.col(f"h{a}") == F.col(f"t{a}") for a in "xyz"]), "left")
    return both.where((F.col("refs") > PART) | (F.col("asked") > 2 * PART)).select("hx", "hy", "hz", parts("refs").alias("into"), F.coalesce(parts("asked"), F.lit(1)).alias("over"))


def pairs_within(queries: DataFrame, refs: DataFrame, b: int, crowded: DataFrame | None = None) -> DataFrame:
    """(id, nid, d2) of each query and every reference in the 27 cells around it; cells are as wide as the radius asked for.

    Were a cube of that width to hold n points, at least n * n / 8 of their pairs would be nearer than it, so in any cloud
    the candidates are at most a fixed multiple of answers and points. A crowded cell is met in parts of some PART
    references and queries: each reference goes to the parts of the queries, each query to those of the references.
    """
    q = _spread(_wide_cells(queries, b))
    r = _wide_cells(refs, b).select(F.col("id").alias("nid"), *[F.col(a).alias(f"r{a}") for a in "xyz"], *[F.col(f"c{a}").alias(f"s{a}") for a in "xyz"])
    on = reduce(Column.__and__, [F.col(f"t{a}") == F.col(f"s{a}") for a in "xyz"])
    if crowded is not None:
        met = lambda c: reduce(Column.__and__, [F.col(f"{c}{a}") == F.col(f"h{a}") for a in "xyz"])
        own = lambda i, n: F.pmod(F.xxhash64(i, F.lit(n)), F.coalesce(n, F.lit(1))).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        q = q.join(crowded, met("t"), "left").withColumns({"qo": own("id", "over")}).withColumn("qi", all_("into")).drop("hx", "hy", "hz", "into", "over")
        r = r.join(crowded, met("s"), "left").withColumns({"ri": own("nid", "into")}).withColumn("ro", all_("over")).drop("hx", "hy", "hz", "into", "over")
        on = on & (F.col("qi") == F.col("ri")) & (F.col("qo") == F.col("ro"))
    return q.join(r, on).select("id", "nid", G.squared_distance(G.vec(), G.vec("r")).alias("d2"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nid"))).where(F.col("rank") <= k)


def _crowded(refs: DataFrame, b: int, most: int) -> DataFrame:
    """The cells (fx, fy, fz) with more than most points."""
    return cloud.occupancy(refs, b).where(F.col("n") > most).select(*[F.col(f"c{a}").alias(f"f{a}") for a in "xyz"])


def _around(cells: DataFrame) -> DataFrame:
    """The cells (hx, hy, hz) whose block of 27 holds one of these cells."""
    for a in "xyz":
        cells = cells.withColumn(f"h{a}", F.explode(F.sequence(F.col(f"f{a}") - 1, F.col(f"f{a}") + 1)))
    return cells.select("hx", "hy", "hz").distinct()


def _nearest_in_block(k: int, b: int, max_d2: float | None, exclude_self: bool):
    """The kernel of a grid round: (id, nid, d2, rank) of the queries that their 27 cells prove done, for each also a row of rank 0.

    Points lie sorted by cell, x running fastest, so a query's 27 cells are nine stretches. Only points nearer than the
    query's reach count: if k of them are, they are the nearest; if max_d2 is within reach, those within it are all.
    """

    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "nid": np.zeros(0, np.int64), "d2": np.zeros(0), "rank": np.zeros(0, np.int32)})
        if not len(queries):
            return none
        cell = lambda t: [t[f"c{a}"].to_numpy(np.int64) for a in "xyz"]
        q, r = queries[["x", "y", "z"]].to_numpy(float), refs[["x", "y", "z"]].to_numpy(float)
        qc, rc, ids, nids = cell(queries), cell(refs), queries["id"].to_numpy(), refs["id"].to_numpy()
        line = lambda x, y, z: (z * (b + 2) + y) * (b + 2) + x
        at = line(*rc)
        order = np.argsort(at, kind="stable")
        at, r, nids = at[order], r[order], nids[order]
        reach = np.full(len(q), np.inf)
        for a in range(3):
            reach = np.minimum(reach, np.where(qc[a] - 1 > 0, q[:, a] - (qc[a] - 1) / b, np.inf))
            reach = np.minimum(reach, np.where(qc[a] + 2 < b, (qc[a] + 2) / b - q[:, a], np.inf))
        low = np.stack([line(qc[0] - 1, qc[1] + dy, qc[2] + dz) for dz in (-1, 0, 1) for dy in (-1, 0, 1)], axis=1)
        begin, end = np.searchsorted(at, low), np.searchsorted(at, low + 2, side="right")
        upto = np.cumsum((end - begin).sum(axis=1))
        out = []
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(upto // PAIRS)) + 1):  # so many pairs at once
            size = (end[part] - begin[part]).ravel()
            of = np.repeat(np.repeat(part, 9), size)
            near = np.arange(len(of)) + np.repeat(begin[part].ravel() - np.cumsum(size) + size, size)
            d = q[of] - r[near]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            keep = np.sqrt(d2) < reach[of]
            if max_d2 is not None:
                keep &= d2 <= max_d2
            if exclude_self:
                keep &= ids[of] != nids[near]
            of, near, d2 = of[keep], near[keep], d2[keep]
            order = np.lexsort((nids[near], d2, of))
            of, near, d2 = of[order], near[order], d2[order]
            count = np.bincount(of, minlength=len(q))
            rank = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + 1
            done = count[part] >= k
            if max_d2 is not None:
                done |= max_d2**0.5 < reach[part]
            done = part[done]
            keep = np.isin(of, done) & (rank <= k)
            out.append((np.append(ids[of[keep]], ids[done]), np.append(nids[near[keep]], ids[done]), np.append(d2[keep], np.zeros(len(done))), np.append(rank[keep], np.zeros(len(done))).astype(np.int32)))
        return pd.DataFrame(dict(zip(("id", "nid", "d2", "rank"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def _grid_round(active: DataFrame, refs: DataFrame, k: int, b: int, max_d2: float | None, exclude_self: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges of the queries that are done, the queries near crowded cells, the others that are not done).

    Cubes of SIDE cells an axis with the cells around them are handled in one go each; crowded cells are left out with all
    queries around them, so a cube holds a bounded number of points.
    """
    full = materialize(_crowded(refs, b, crowd(k)), "knn-crowded")
    inside = reduce(Column.__and__, [F.col(a).between(0.0, 1.0) for a in "xyz"])
    q, r = cloud.index_of_cells(active.where(inside), b), cloud.index_of_cells(refs, b)
    on = lambda h: reduce(Column.__and__, [F.col(f"c{a}") == F.col(f"{h}{a}") for a in "xyz"])
    near = _around(full)
    crowded = q.join(near, on("h"), "left_semi").select("id", "x", "y", "z")
    q, r = q.join(near, on("h"), "left_anti"), r.join(full, on("f"), "left_anti")
    for a in "xyz":
        q = q.withColumn(f"b{a}", F.floor(F.col(f"c{a}") / SIDE))
        r = r.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"c{a}") + d) / SIDE) for d in (-1, 0, 1)]))))
    cube, cols = ["bx", "by", "bz"], ["id", "x", "y", "z", "cx", "cy", "cz", "bx", "by", "bz"]
    got = q.select(cols).groupBy(cube).cogroup(r.select(cols).groupBy(cube)).applyInPandas(_nearest_in_block(k, b, max_d2, exclude_self), "id long, nid long, d2 double, rank int")
    got = materialize(got, "knn-round")
    ok = got.where("rank = 0").select(F.col("id").alias("ok"))
    rest = active.join(ok, F.col("id") == F.col("ok"), "left_anti")
    if full.isEmpty():
        return got.where("rank > 0"), crowded, rest
    left = crowded.select(F.col("id").alias("of"))
    return got.where("rank > 0"), crowded, rest.join(left, F.col("id") == F.col("of"), "left_anti")


def _cells(points: DataFrame, level: int) -> DataFrame:
    """points with their cell (cx, cy, cz) among 2 ** level an axis."""
    side = float(1 << level)
    return points.withColumns({f"c{a}": F.least(F.lit((1 << level) - 1), F.greatest(F.lit(0), F.floor(F.col(a) * F.lit(side)))).cast("long") for a in "xyz"})


def _summed(cells: DataFrame, n: Column) -> DataFrame:
    """cells with their number of points and their bounds; both combine before the shuffle."""
    return cells.groupBy("cx", "cy", "cz").agg(n.alias("n"), *[f(c).alias(c) for a in "xyz" for f, c in ((F.min, f"lo{a}"), (F.max, f"hi{a}"))])


def _tree(refs: DataFrame, n: int, k: int, need: int) -> tuple[list[tuple[int, DataFrame]], dict[int, DataFrame]]:
    """(nodes by level, points by level) of a tree of cells.

    nodes: cell, n, bounds, split (whether the next level goes on with it). Down to the level at which an even cloud's
    cells hold some leaf(k) points all are split; there and below only crowded ones are. points: those in the leaves of a
    level, with their cell. Of points in one place only the need smallest ids can be among the nearest; where cells are
    crowded the others are left out first, so copies of one point in any number do not crowd a cell.
    """
    level = max(0, math.ceil(math.log(max(1.0, 4 * n / leaf(k)), 8)))
    nodes, points, first = [], {}, True
    while True:
        at = _cells(refs, level)
        base = _summed(at.withColumns({f"{e}{a}": F.col(a) for a in "xyz" for e in ("lo", "hi")}), F.count(F.lit(1)))
        base = materialize(base.withColumn("split", (F.col("n") > crowd(k)) & F.lit(level < DEEPEST)), "tree-cells")
        if first:
            for up in range(level % 2 or 2, level, 2):  # two levels at once
                higher = base.withColumns({f"c{a}": F.shiftright(f"c{a}", level - up) for a in "xyz"})
                nodes.append((up, _summed(higher, F.sum("n")).withColumn("split", F.lit(True))))
        nodes.append((level, base))
        full = base.where("split").select(*[F.col(f"c{a}").alias(f"f{a}") for a in "xyz"])
        if full.isEmpty():
            return nodes, points | {level: at}
        same = reduce(Column.__and__, [F.col(f"c{a}") == F.col(f"f{a}") for a in "xyz"])
        points[level] = at.join(full, same, "left_anti")
        refs = at.join(full, same, "left_semi").select("id", "x", "y", "z")
        if first:
            refs = refs.withColumn("same", F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("id"))).where(F.col("same") <= need).drop("same")
        refs, first, level = materialize(refs, "tree-crowded"), False, min(DEEPEST, level + STEP)


def _descend(queries: DataFrame, refs: DataFrame, n: int, k: int, max_d2: float | None, exclude_self: bool) -> DataFrame:
    """(id, nid, d2) of all candidates that the tree leaves for each query: every one of its k nearest and few others.

    most: a bound on a query's k-th distance, squared: the largest distance to a cell that alone holds enough points. It
    holds from level to level and gets smaller. Bounds are widened by far more than rounding, so ties are never lost.
    """
    need = k + exclude_self
    nodes, points = _tree(refs, n, k, need)
    far = F.lit(float("inf") if max_d2 is None else float(max_d2))
    front = queries.select("id", "x", "y", "z", far.alias("most"), *[F.lit(0).cast("long").alias(f"p{a}") for a in "xyz"])
    above, found = 0, []
    for at, (level, cells) in enumerate(nodes):
        child = cells.withColumns({f"u{a}": F.shiftright(f"c{a}", level - above) for a in "xyz"})
        both = front.join(child, reduce(Column.__and__, [F.col(f"p{a}") == F.col(f"u{a}") for a in "xyz"]))
        least = reduce(Column.__add__, [F.pow(F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), F.lit(0.0)), 2) for a in "xyz"])
        most = reduce(Column.__add__, [F.pow(F.greatest(F.abs(F.col(a) - F.col(f"lo{a}")), F.abs(F.col(a) - F.col(f"hi{a}"))), 2) for a in "xyz"])
        both = both.withColumns({"least": least, "enough": F.when(F.col("n") >= need, most * (1 + 1e-9) + 1e-300)})
        both = both.withColumn("most", F.least("most", F.min("enough").over(Window.partitionBy("id")))).where(F.col("least") <= F.col("most"))
        went = both.select("id", "x", "y", "z", "most", "split", *[F.col(f"c{a}").alias(f"p{a}") for a in "xyz"])
        if level in points:
            went = materialize(went, "knn-front") if at + 1 < len(nodes) else went
            r = points[level].select(F.col("id").alias("nid"), *[F.col(a).alias(f"r{a}") for a in "xyz"], *[F.col(f"c{a}").alias(f"t{a}") for a in "xyz"])
            near = went.where("not split").join(r, reduce(Column.__and__, [F.col(f"p{a}") == F.col(f"t{a}") for a in "xyz"]))
            near = near.select("id", "nid", G.squared_distance(G.vec(), G.vec("r")).alias("d2"), "most").where(F.col("d2") <= F.col("most"))
            found.append(near.where("id <> nid") if exclude_self else near)
        front, above = went.where("split").drop("split"), level
    return reduce(DataFrame.unionByName, found).select("id", "nid", "d2")


def knn_join(queries: DataFrame, refs: DataFrame, k: int, max_d2: float | None = None, exclude_self: bool = False, strict: bool = True, cells: int | None = None) -> DataFrame:
    """The k nearest reference points of each query, both in the references' unit cube, ties to the smaller nid.

    max_d2: only neighbours below it (strict) or up to it. With fewer than k references all of them are returned.
    cells: cells an axis of the grid. Results do not depend on it. Each round is written to the shared folder.
    """
    own, done = materialize(cloud.finite(refs.select("id", "x", "y", "z")), "knn-refs"), []
    active = own.toDF(*own.columns) if queries is refs else materialize(cloud.finite(queries.select("id", "x", "y", "z")), "knn-queries")
    refs = own
    n = refs.count()
    b = cells or start_cells(n, k)
    waiting = []
    for _ in range(GRID_ROUNDS):
        if b < 4 or b > FINEST:  # nearly all points share a block, or cells are as fine as they get
            break
        got, active, rest = _grid_round(active, refs, k, b, max_d2, exclude_self)
        done.append(got)
        waiting.append(materialize(rest, "knn-sparse"))
        active, b = materialize(active, "knn-active"), 2 * b
        if active.limit(WORTH).count() < WORTH:
            break
    active = reduce(DataFrame.unionByName, waiting, active)
    done.append(_top(_descend(active, refs, n, k, max_d2, exclude_self), k).select("id", "nid", "d2", "rank"))
    out = reduce(DataFrame.unionByName, done)
    if max_d2 is not None:
        out = out.where(F.col("d2") < max_d2 if strict else F.col("d2") <= max_d2)
    return out.withColumn("rank", F.col("rank").cast("long"))


def knn_self(points: DataFrame, k: int, max_radius: float | None = None, cells: int | None = None) -> DataFrame:
    """The k nearest other points of each point; points are normalised here, max_radius is in their own units (inclusive)."""
    unit = cloud.normalise(points)
    return knn_join(unit, unit, k, _scaled(points, max_radius), exclude_self=True, strict=False, cells=cells)


def knn_query(queries: DataFrame, refs: DataFrame, k: int, max_radius: float | None = None, cells: int | None = None) -> DataFrame:
    """The k nearest references of each query; both are normalised by the references' extent (max_radius exclusive).

    A query outside the references' cube is answered too, by the tree.
    """
    bounds = cloud.extent(refs)
    return knn_join(cloud.normalise(queries, bounds), cloud.normalise(refs, bounds), k, _scaled(refs, max_radius), cells=cells)


def _scaled(points: DataFrame, radius: float | None) -> float | None:
    """The radius in the points' unit cube, squared; without points any will do."""
    if radius is None:
        return None
    b = cloud.extent(points).first()
    return 0.0 if b["lo"] is None else (radius / (b["hi"] - b["lo"])) ** 2


def _packed(points: DataFrame) -> DataFrame:
    """Blocks (ids, at) of up to BLOCK points, made where the rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
            for a in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_pydict({"ids": [ids[a : a + BLOCK].tobytes()], "at": [np.ascontiguousarray(at[:, a : a + BLOCK]).tobytes()]}, schema=pa.schema([("ids", pa.binary()), ("at", pa.binary())]))

    return points.select(F.col("id").cast("long"), "x", "y", "z").mapInArrow(run, "ids binary, at binary")


class _Nearest:
    """The k nearest so far of each point of a block, held against other blocks one after the other."""

    def __init__(self, ids: bytes, at: bytes, k: int):
        self.ids, self.at, self.k = np.frombuffer(ids, np.int64), np.frombuffer(at, float).reshape(3, -1), k
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, nid, d2
        self.new, self.waiting = [], 0  # the same of pairs that may be among the nearest
        self.most = np.full(len(self.ids), np.finfo(float).max)  # a bound on the k-th distance, squared
        self.room = np.empty((2, len(self.ids), STRETCH)), np.empty((len(self.ids), STRETCH), bool)  # fresh arrays would cost more than the sums

    def meet(self, ids: bytes, at: bytes) -> None:
        """Every pair is compared, a stretch of the other block at a time."""
        nids, r = np.frombuffer(ids, np.int64), np.frombuffer(at, float).reshape(3, -1)
        for a in range(0, len(nids), STRETCH):
            n = nids[a : a + STRETCH]
            (d2, d), near = (x[..., : len(n)] for x in self.room)
            for i, to in enumerate((d2, d, d)):
                np.subtract(self.at[i][:, None], r[i, a : a + STRETCH], out=to)
                np.multiply(to, to, out=to)
                if i:
                    np.add(d2, d, out=d2)
            same = np.flatnonzero(np.isin(n, self.ids))
            if len(same):
                d2[:, same] = np.where(self.ids[:, None] == n[same], np.inf, d2[:, same])
            if len(self.held[0]) < self.k * len(self.ids) and len(n) > self.k:
                self.most = np.minimum(self.most, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1])
            q, c = np.divmod(np.flatnonzero(np.less_equal(d2, self.most[:, None], out=near)), len(n))
            if len(q):
                self.new.append((q, n[c], d2[q, c]))
                self.waiting += len(q)
            if self.waiting > self.k * len(self.ids):
                self._merge()

    def _merge(self) -> None:
        of, nids, d2 = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((nids, d2, of))
        of, nids, d2 = of[order], nids[order], d2[order]
        count = np.bincount(of, minlength=len(self.ids))
        keep = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) < self.k
        self.held, self.new, self.waiting = (of[keep], nids[keep], d2[keep]), [], 0
        full = np.flatnonzero(count >= self.k)
        self.most[full] = np.minimum(self.most[full], self.held[2][np.searchsorted(self.held[0], full, side="right") - 1])

    def rows(self) -> pa.RecordBatch:
        self._merge()
        of, nids, d2 = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.ids[of]), pa.array(nids), pa.array(d2)], names=["id", "nid", "d2"])


def knn_bruteforce(points: DataFrame, k: int) -> DataFrame:
    """All pairs compared, block by block, as a yardstick: time grows with the square of the points, what is shuffled with the points."""
    blocks = materialize(_packed(cloud.finite(cloud.normalise(points))), "knn-blocks")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = blocks.toDF("nids", "nat").coalesce(1)  # read once more by each task
    pairs = blocks.repartition(tasks).crossJoin(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for batch in batches:
            for ids, at, nids, nat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (ids, at):
                    if found is not None:
                        yield found.rows()
                    last, found = (ids, at), _Nearest(ids, at, k)
                found.meet(nids, nat)
        if found is not None:
            yield found.rows()

    return _top(pairs.mapInArrow(run, "id long, nid long, d2 double"), k).select("id", "nid", "d2", F.col("rank").cast("long").alias("rank"))


def nearest_to(points: DataFrame, of: int, k: int = 40) -> DataFrame:
    """The k nearest of one point, by one scan and a bounded sort; none where there is no such point or it has no place.

    See lay_out() and nearest_in() for many such questions to one cloud.
    """
    p = cloud.finite(cloud.normalise(points))
    one = p.where(F.col("id") == of).agg(*[F.first(a).alias(a) for a in "xyz"])
    at = p.where(F.col("id") != of).withColumns({f"r{a}": one.select(a).scalar() for a in "xyz"})
    d2 = G.squared_distance(G.vec(), G.vec("r")).alias("d2")
    return at.select(F.lit(of).cast("long").alias("id"), F.col("id").alias("nid"), d2).where("d2 is not null").orderBy("d2", "nid").limit(k)


def lay_out(points: DataFrame, path: str, group: int = 1 << 20) -> DataFrame:
    """A cloud, scaled to its unit cube, written along a space-filling curve: each row group of about group bytes is a small box.

    Its bounds stand in the files' own statistics, so a reader that asks for a box opens the row groups it touches.
    """
    unit = cloud.finite(cloud.normalise(points.select("id", "x", "y", "z")))
    bits = lambda a: F.least(F.lit(1023), F.floor(F.col(a) * 1024)).cast("long")
    code = reduce(Column.bitwiseOR, [F.shiftleft(_apart(bits(a)), k) for k, a in enumerate("xyz")])
    laid = unit.withColumn("code", code).repartitionByRange("code", "id").sortWithinPartitions("code", "id").drop("code")
    laid.write.option("parquet.block.size", group).option("parquet.page.row.count.limit", 20_000).parquet(path)
    return points.sparkSession.read.schema(laid.schema).parquet(path)


def _apart(c: Column) -> Column:
    """The bits of a number below 1024, two zeros behind each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def box_around(laid: DataFrame, at: tuple[float, float, float], radius: float) -> DataFrame:
    """The points of a laid out cloud in the cube of this half width: a filter that reaches the row groups' bounds."""
    return laid.where(reduce(Column.__and__, [F.col(a).between(v - radius, v + radius) for a, v in zip("xyz", at, strict=True)]))


def nearest_in(laid: DataFrame, at: tuple[float, float, float], k: int = 40, but: int | None = None) -> DataFrame:
    """(nid, d2, rank): the k points of a laid out cloud that are nearest to a place in its unit cube, one id left out.

    The search starts with the radius that would hold k points of an even cloud and doubles it until the k-th distance is
    within it, or all points are. k rows at most come to the driver.
    """
    radius = (k / max(laid.count(), 1)) ** (1 / 3)  # the count is in the files' footers
    most = sum(max(abs(v), abs(1 - v)) ** 2 for v in at) ** 0.5
    while True:
        d2 = G.squared_distance(G.vec(), tuple(F.lit(float(v)) for v in at)).alias("d2")
        near = box_around(laid, at, radius).select(F.col("id").alias("nid"), d2).where(F.col("d2") <= radius * radius)
        found = (near if but is None else near.where(F.col("nid") != but)).orderBy("d2", "nid").limit(k).collect()
        if len(found) == k or radius > most:
            return laid.sparkSession.createDataFrame([(r["nid"], r["d2"], n) for n, r in enumerate(found, 1)], "nid long, d2 double, rank long")
        radius *= 2


def radius_join(points: DataFrame, radius: float, queries: DataFrame | None = None) -> DataFrame:
    """(id, nid, d2) of all other points within radius of each point, or of all points within radius of each query.

    radius is in the points' own units, inclusive; d2 in their unit cube. Points without a place take no part; without
    points there are no rows. See within_unit() for how.
    """
    ends = cloud.extent(points).first()
    if ends["lo"] is None:
        return (points if queries is None else queries).select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("nid"), F.lit(0.0).alias("d2")).limit(0)
    scale = lambda t: t.select("id", *[G.normalised(F.col(a), F.lit(ends["lo"]), F.lit(ends["hi"])).alias(a) for a in "xyz"])
    return within_unit(scale(cloud.finite(points)), radius / (ends["hi"] - ends["lo"]), None if queries is None else scale(cloud.finite(queries)))


def within_unit(unit: DataFrame, distance: float, queries: DataFrame | None = None) -> DataFrame:
    """radius_join in the unit cube: one round over cells as wide as the distance, however many that are.

    So clusters, outliers and copies meet no more candidates than a fixed multiple of answers and points.
    """
    unit = cloud.finite(unit)
    b, asked, most = cells_of_radius(distance), unit if queries is None else cloud.finite(queries), distance**2
    crowded = materialize(crowded_cells(unit, b, asked), "radius-crowded")
    found = pairs_within(asked, unit, b, None if crowded.isEmpty() else crowded).where(F.col("d2") <= most)
    return found.where("id <> nid") if queries is None else found


def merge_top_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two edge tables merged: each (id, nid) once, the k nearest of each id."""
    both = a.select("id", "nid", "d2").unionByName(b.select("id", "nid", "d2")).groupBy("id", "nid").agg(F.min("d2").alias("d2"))
    return _top(both, k).withColumn("rank", F.col("rank").cast("long"))


def elementwise_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, nid, d2): for each id the nearer of two single neighbours."""
    both = a.select("id", "nid", "d2").unionByName(b.select("id", "nid", "d2"))
    return both.groupBy("id").agg(F.min(F.struct("d2", "nid")).alias("m")).select("id", F.col("m.nid").alias("nid"), F.col("m.d2").alias("d2"))


def first_neighbours(edges: DataFrame, k_use: int = 20) -> DataFrame:
    """The first k_use neighbours of each point."""
    return edges.where(F.col("rank") <= k_use)


def kth_radius(edges: DataFrame) -> DataFrame:
    """id, number of neighbours, largest squared distance."""
    return edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("max_d2"))


def edge_cut(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """For each pair of contiguous id ranges: distinct foreign points that the first needs from the second."""
    e = edges.select(G.partition_of(F.col("id"), n, parts).alias("part"), G.partition_of(F.col("nid"), n, parts).alias("from_part"), "nid")
    return e.where("part <> from_part").groupBy("part", "from_part").agg(F.countDistinct("nid").alias("halo"))
