"""Point clouds as text: x y z, or x y z nx ny nz, a line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("x", "y", "z", "nx", "ny", "nz")


def read_xyz(spark: SparkSession, path: str, normals: bool = False) -> DataFrame:
    """(x, y, z[, nx, ny, nz]) of lines separated by white space; lines that are blank give no row, short ones fill nulls.

    Text files are split, so rows have no number: use order.number on a key, or monotonically_increasing_id, to give ids.
    """
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return rows.select(*[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(NAMES[: 6 if normals else 3])])


def write_xyz(points: DataFrame, path: str) -> None:
    """Lines with six decimals, nx, ny, nz too where points has them; a folder of text files."""
    names = [n for n in NAMES if n in points.columns]
    points.select(F.format_string(" ".join(["%.6f"] * len(names)), *[F.col(n).cast("double") for n in names]).alias("value")).write.text(path)
