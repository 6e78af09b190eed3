"""Neighbours of streamed query points. An extension: each micro-batch is one neighbour join, so nothing is kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.functions import geometry as G
from pointloom.operators import cloud, knn
from pointloom.plans.storage import materialize


def stream_knn(queries: DataFrame, refs: DataFrame, k: int, path: str, checkpoint: str, max_radius: float | None = None, **trigger) -> StreamingQuery:
    """Writes (batch, id, nid, d2, rank) of each micro-batch of queries (id, x, y, z) below path.

    A batch replaces its own folder, so one that is run again after a failure leaves its rows once.
    """
    fixed = materialize(refs.select("id", "x", "y", "z"), "stream-refs")

    def each(batch: DataFrame, number: int) -> None:
        knn.knn_query(batch, fixed, k, max_radius).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_within(queries: DataFrame, refs: DataFrame, radius: float) -> DataFrame:
    """(id, nid, d2) of the references within radius (exclusive) of each streamed query, in the references' unit cube.

    A plain stream-static join on grid cells: cells are as wide as the radius, so the 27 around a query hold all of them;
    crowded cells are met in parts. Without references there are no rows.
    """
    bounds = materialize(cloud.extent(refs), "stream-extent")
    b = bounds.first()
    lo, hi = (0.0, 1.0) if b["lo"] is None else (b["lo"], b["hi"])
    most = (radius / (hi - lo)) ** 2
    cells = knn.cells_of_radius(most**0.5)
    scale = lambda t: cloud.finite(t).select("id", *[G.normalised(F.col(a), F.lit(lo), F.lit(hi)).alias(a) for a in "xyz"])
    unit = scale(refs)
    crowded = materialize(knn.crowded_cells(unit, cells), "stream-crowded")
    return knn.pairs_within(scale(queries), unit, cells, None if crowded.isEmpty() else crowded).where(F.col("d2") < most)
