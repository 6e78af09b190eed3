"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where that is unset (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="pointloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Scratch paths of this process that have not been removed yet.
_made: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other run uses."""
    _made.append(f"{shared_dir(spark)}/pointloom/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def clean(spark: SparkSession) -> None:
    """Removes all scratch tables of this process. Results that have not been written or collected yet still read them."""
    _remove(spark, list(_made))


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the cluster may be gone already
            clean(spark)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes at its end the scratch tables that were made inside, but for those put into the list.

    What else is wanted must be written or collected by then.
    """
    before, keep = set(_made), []
    try:
        yield keep
    finally:
        kept = before | {t.__dict__.get("_scratch") for t in keep}
        _remove(spark, [p for p in _made if p not in kept])


def drop(*tables: DataFrame) -> None:
    """Removes tables that materialize made and that nothing will read any more; others are left alone."""
    for t in tables:
        if (path := t.__dict__.get("_scratch")) in _made:
            _remove(t.sparkSession, [path])


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go at its end; the session's own setting is put back."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def materialize(df: DataFrame, tag: str, *done: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back; done: tables that are dropped then.

    Unlike a cached table it survives lost executors, and the reader knows its size, so joins with a small table
    become broadcast joins by the session's own threshold instead of by a hint. What was shuffled for it goes as soon as it
    is written, not when the driver happens to collect its garbage.
    """
    path = scratch_path(df.sparkSession, tag)
    with _shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    drop(*done)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
