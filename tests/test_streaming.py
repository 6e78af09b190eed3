"""Streamed queries give what one batch gives."""

import numpy as np

from pointloom.operators import knn
from pointloom.streaming.neighbours import stream_knn, stream_within

SCHEMA = "id long, x double, y double, z double"


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    refs = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((80, 3)))], SCHEMA)
    for part in range(3):
        rows = [(100 * part + i, *map(float, p)) for i, p in enumerate(rng.random((10, 3)) * 1.4 - 0.2)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_knn(stream, refs, 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    queries = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert got.select("batch").distinct().count() == 3
    assert sorted(map(tuple, got.select("id", "nid", "rank").collect())) == sorted(map(tuple, knn.knn_query(queries, refs, 3).select("id", "nid", "rank").collect()))
    within = stream_within(stream, refs, 0.3).writeStream.format("memory").queryName("within").trigger(availableNow=True).start()
    within.awaitTermination()
    want = knn.knn_query(queries, refs, 80, max_radius=0.3)
    assert sorted(map(tuple, spark.table("within").select("id", "nid").collect())) == sorted(map(tuple, want.select("id", "nid").collect()))
