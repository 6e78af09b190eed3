"""Taubin smoothing: alternating shrinking and inflating passes over a frozen neighbour graph."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import cloud
from pointloom.plans.storage import materialize

LAMBDA, MU = 0.63, -0.64
#: Points of a block, and the iterations that blocks run before they exchange positions.
BLOCK, AT_ONCE = 100_000, 3


def taubin_pass(points: DataFrame, edges: DataFrame, scale: float, regularised: bool = False) -> DataFrame:
    """Each point moved by scale times its weighted mean displacement toward its neighbours; without neighbours it stays.

    A point without a place stays as it is and draws no other.

    Weights use the positions before the pass. Edges are joined with the far end's position, summed up by id next to the
    near end's; sums combine before the shuffle.
    """
    there = cloud.finite(points)
    c = there.select(F.col("id").alias("cid"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    p = there.select(F.col("id").alias("pid"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    e = edges.select("id", "nid").join(c, F.col("nid") == F.col("cid")).join(p, F.col("id") == F.col("pid"))
    w = G.smoothing_weight(G.squared_distance(G.vec("c"), G.vec("p")), scale, regularised)
    sums = e.withColumn("w", w).groupBy("id").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * (F.col(f"c{a}") - F.col(f"p{a}"))).alias(f"s{a}") for a in "xyz"])
    sums = sums.withColumnRenamed("id", "sid").withColumn("w", F.when(F.col("w") == 0, F.lit(1e-8)).otherwise(F.col("w")))
    out = points.join(sums, F.col("id") == F.col("sid"), "left")
    return out.select("id", *[(F.col(a) + F.lit(scale) * F.coalesce(F.col(f"s{a}") / F.col("w"), F.lit(0.0))).alias(a) for a in "xyz"])


def taubin(points: DataFrame, edges: DataFrame, iterations: int, lam: float = LAMBDA, mu: float = MU, regularised: bool = False) -> DataFrame:
    """iterations times a pass with lam and one with mu. Each pass is written to the shared folder, which keeps plans small."""
    now = points.select("id", "x", "y", "z")  # not one of the tables that passes make and drop
    edges = materialize(edges.select("id", "nid"), "taubin-edges")
    for _ in range(iterations):
        for scale in (lam, mu):
            now = materialize(taubin_pass(now, edges, scale, regularised), "taubin-pass", now)
    return now


def _kernel(x: np.ndarray, u: np.ndarray, v: np.ndarray, iterations: int, lam: float, mu: float) -> np.ndarray:
    """All passes over one component; u and v are positions in x."""
    for _ in range(iterations):
        for scale in (lam, mu):
            d = x[v] - x[u]
            w = np.exp(-(d * d).sum(1))
            total = np.bincount(u, w, len(x))
            total[total == 0] = 1e-8
            x = x + scale * np.stack([np.bincount(u, w * d[:, k], len(x)) for k in range(3)], axis=1) / total[:, None]
    return x


def _spread(c: Column) -> Column:
    """The bits of a number below 1024, two zeros behind each."""
    for shift, keep in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(keep))
    return c


def spatial_blocks(points: DataFrame, most: int) -> tuple[DataFrame, int]:
    """((id, x, y, z, block), blocks): about most points a block, which lie together on a space-filling curve; equal places split by id."""
    ends = cloud.extent(points).crossJoin(points.agg(F.count(F.lit(1)).alias("n"))).first()  # a row each
    parts = max(1, -(-ends["n"] // most))
    if parts == 1:
        return points.select("id", "x", "y", "z", F.lit(0).cast("long").alias("block")), 1
    cells = [G.cell_coordinate(F.col(a), ends["lo"] or 0.0, ends["hi"] or 1.0, 1024) for a in "xyz"]
    at = points.withColumn("curve", sum((F.shiftleft(_spread(c), k) for k, c in enumerate(cells)), F.lit(0)))
    return at.repartitionByRange(parts, "curve", "id").select("id", "x", "y", "z", F.spark_partition_id().cast("long").alias("block")), parts


def _halo(at: DataFrame, edges: DataFrame, hops: int, blocks: int) -> tuple[DataFrame, bool]:
    """((block, id, hop), whether blocks meet): the points of each block, hop 0, and those within so many edges of them.

    Only the newly found points of a hop go on to the next, so a step costs what the blocks' rims are.
    """
    own = at.select("block", "id")
    if blocks == 1:
        return own.withColumn("hop", F.lit(0)), False
    to = at.select(F.col("id").alias("tid"), F.col("block").alias("tblock"))
    rim = edges.join(own, "id").join(to, F.col("nid") == F.col("tid")).where("block <> tblock").select("block", F.col("nid").alias("id")).distinct()
    found = materialize(rim.withColumn("hop", F.lit(1)), "taubin-rim")
    if found.isEmpty():
        return own.withColumn("hop", F.lit(0)), False
    parts = [found]
    for hop in range(2, hops + 1):
        seen = reduce(DataFrame.unionByName, [p.select("block", "id") for p in parts]).unionByName(own)
        near = parts[-1].select("block", "id").join(edges, "id").select("block", F.col("nid").alias("id")).distinct()
        parts.append(materialize(near.join(seen, ["block", "id"], "left_anti").withColumn("hop", F.lit(hop)), "taubin-rim"))
    return materialize(reduce(DataFrame.unionByName, [own.withColumn("hop", F.lit(0)), *parts]), "taubin-halo"), True


def taubin_many(points: DataFrame, edges: DataFrame, iterations: int, lam: float = LAMBDA, mu: float = MU, most: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """taubin for many iterations, in blocks of about most points that run several iterations between two exchanges.

    A pass moves a point by its neighbours' places, so after p passes it depends on points p edges away. Each block gets
    its points and those within 2 * at_once edges, runs at_once iterations in numpy and passes on its own points, which are
    right; the halo's inner rings are right as far as the passes left need them. Blocks without a halo, as in a cloud of
    one block or of parts far from each other, run all iterations at once. Positions differ from taubin's by rounding only.
    Points without a place stay as they are and draw no other.
    """
    lost = points.select("id", "x", "y", "z").where(~F.coalesce(F.expr(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz")), F.lit(False)))
    cut, blocks = spatial_blocks(cloud.finite(points.select("id", "x", "y", "z")), most)
    at, e = cut, edges.select("id", "nid")
    if blocks > 1:  # they are read many times
        at, e = materialize(at, "taubin-blocks"), materialize(e, "taubin-all")
    halo, meet = _halo(at, e, 2 * at_once, blocks)
    step = at_once if meet else max(iterations, 1)
    inner = halo.where(F.col("hop") < 2 * step).select("block", F.col("id").alias("hid"))
    tied = inner.join(e, F.col("hid") == F.col("id")).select("block", "id", "nid")
    if meet:  # every step reads it
        tied = materialize(tied.repartition("block"), "taubin-tied")
    now = at.select("id", "x", "y", "z")
    for done in range(0, iterations, step):
        run = _block_passes(min(step, iterations - done), lam, mu)
        placed = halo.withColumnRenamed("id", "hid").join(now, F.col("hid") == F.col("id")).select("block", "id", "hop", "x", "y", "z") if meet else at.toDF(*at.columns).withColumn("hop", F.lit(0))
        after = placed.groupBy("block").cogroup(tied.groupBy("block")).applyInPandas(run, "id long, x double, y double, z double")
        now = after if done + step >= iterations else materialize(after, "taubin-step", now)
    return now.unionByName(lost)


def _block_passes(iterations: int, lam: float, mu: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("id")
        ids = left["id"].to_numpy()
        ends = [right[c].to_numpy() for c in ("id", "nid")]
        u, v = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in ends)
        own = left["hop"].to_numpy() == 0
        there = (ids[u] == ends[0]) & (ids[v] == ends[1])  # not so for edges to points that there are none of
        out = _kernel(left[["x", "y", "z"]].to_numpy(float), u[there], v[there], iterations, lam, mu)[own]
        return pd.DataFrame({"id": ids[own], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    return run
