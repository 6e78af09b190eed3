"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize

#: Edges that a task contracts at once.
HELD = 1 << 20


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of the vertex and its neighbours."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("u", "low").alias("low"))
    return near.where("v > u").join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them. edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), "low")
    down = edges.join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return down.unionByName(low.select(F.col("of").alias("u"), F.col("low").alias("v"))).where("u <> v").distinct()


def label(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of each one's component) of an edge list held in memory: minima hooked and halved until at rest."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if (new == up).all():
            return ids, ids[up]
        up = new


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that tie the same vertices together, fewer of them: each task ties those of its edges to their smallest vertex.

    Works on so many edges at a time as a task can hold, so it needs no shuffle; a graph that lies in one task is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            ids, comp = label(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            far = ids != comp
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(comp[far])], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= HELD:
                yield out()
                n = 0
        if held:
            yield out()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and as good as never for others."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(u, v) -> (id, comp): every vertex that has an edge, with the smallest vertex of its component.

    Tasks first contract what they hold, before and after one shuffle. Then each round turns neighbourhoods into stars
    (first of larger, then of smaller neighbours) until nothing changes, which takes about log(n) rounds however long the
    paths are. A round costs two aggregations that combine before the shuffle and two joins that adaptive execution can
    split, so a vertex with very many neighbours holds nothing up. Each round is written to the shared folder. Self loops
    and null ends are left out.
    """
    own = edges.where("u is not null and v is not null and u <> v")
    now = materialize(_contracted(_contracted(own).distinct()).distinct(), tag)
    mark = _mark(now)
    while True:
        now = materialize(_small_star(_large_star(now)), tag, now)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
