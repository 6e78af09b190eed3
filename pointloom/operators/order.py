"""Running sums, numbering and permutations over whole tables without one task that holds them all.

Rows are split by value ranges of the ordering key, each range is worked off on its own, and the ranges' totals, of which
there are as many as ranges, are summed up before they are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize

#: Rows of a range, about, where the number of ranges is not given.
RANGE_ROWS = 1_000_000


def _ranges(rows: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """rows with __part, ascending in the order of keys. Written once, since only a written table keeps its ranges when a
    task is run again; keys that end with a unique one divide a value that many rows share."""
    parts = parts or -(-rows.count() // RANGE_ROWS) or 1
    return materialize(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "order-ranges")


def prefix_sum(rows: DataFrame, key: str, value: str | Column, parts: int | None = None) -> DataFrame:
    """rows with inclusive and exclusive running sums of value in the order of key, which must be unique."""
    r = _ranges(rows, [key], parts).withColumn("__v", F.col(value) if isinstance(value, str) else value)
    totals = r.groupBy("__part").agg(F.sum("__v").alias("__t"))
    upto = totals.withColumn("__base", F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("__v").over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = r.withColumn("__run", run).join(F.broadcast(upto.select(F.col("__part").alias("__p"), "__base")), F.col("__part") == F.col("__p"))  # a row a range
    return out.withColumn("inclusive", F.col("__base") + F.col("__run")).withColumn("exclusive", F.col("inclusive") - F.col("__v")).select(*rows.columns, "inclusive", "exclusive")


def number(rows: DataFrame, key: str, parts: int | None = None, name: str = "pos") -> DataFrame:
    """rows with their position from 0 in the order of key, which must be unique."""
    return prefix_sum(rows, key, F.lit(1).cast("long"), parts).withColumnRenamed("exclusive", name).drop("inclusive")


def compact(rows: DataFrame, key: str, keep: Column, parts: int | None = None) -> DataFrame:
    """The rows that keep marks, with the place each gets when the others are closed up."""
    flagged = prefix_sum(rows.withColumn("__keep", F.when(keep, F.lit(1)).otherwise(F.lit(0)).cast("long")), key, "__keep", parts)
    return flagged.where("__keep = 1").drop("__keep", "inclusive").withColumnRenamed("exclusive", "place")


def permutation(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """id, old position (by id), new position (by key and id): a permutation and, read the other way, its inverse."""
    a = number(rows.select("id", F.col(key).alias("__k")), "id", parts, "old_pos")
    ordered = a.withColumn("__s", F.struct(F.col("__k"), F.col("id")))
    r = _ranges(ordered, ["__k", "id"], parts)
    totals = r.groupBy("__part").count()
    upto = totals.withColumn("__base", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("__part").orderBy("__s")) - 1
    out = r.withColumn("__l", local).join(F.broadcast(upto.select(F.col("__part").alias("__p"), "__base")), F.col("__part") == F.col("__p"))
    return out.select("id", "old_pos", (F.col("__base") + F.col("__l")).cast("long").alias("new_pos"))


def gaps(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, v) -> (id, v, gap): distance to the next value in order of v and id, for all but the last.

    Null and non-finite values are no places: they have no row and end no gap.
    """
    r = _ranges(rows.where("abs(v) < double('infinity')"), ["v", "id"], parts)
    firsts = r.groupBy("__part").agg(F.min("v").alias("__first"))
    after = firsts.withColumn("__next", F.min("__first").over(Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)))
    inside = F.lead("v").over(Window.partitionBy("__part").orderBy("v", "id"))
    out = r.withColumn("__lead", inside).join(F.broadcast(after.select(F.col("__part").alias("__p"), "__next")), F.col("__part") == F.col("__p"))
    return out.withColumn("gap", F.abs(F.coalesce("__lead", "__next") - F.col("v"))).where("gap is not null").select("id", "v", "gap")


def segment_ends(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The rows that are the last of their key in the order of by, whole: an aggregate, since a segment's end is its maximum.

    Of rows that tie in by the one with the largest other columns, in their order, is the last.
    """
    rest = [c for c in rows.columns if c not in (key, by)]
    last = rows.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("__last"))
    return last.select(key, "__last.*").select(*rows.columns)


def strided(rows: DataFrame, key: str, names: list[str], stride: int | None = None, offset: int = 0, parts: int | None = None) -> DataFrame:
    """(slot, value): the columns of rows, in the order of key, laid out with stride places a row; gaps have no row."""
    stride = len(names) if stride is None else stride
    if offset < 0 or offset + len(names) > stride:
        raise ValueError("the columns do not fit the stride")
    laid = F.posexplode(F.array(*[F.col(n) for n in names])).alias("__at", "value")
    return number(rows.select(key, *names), key, parts, "__row").select("__row", laid).select((F.col("__row") * stride + offset + F.col("__at")).alias("slot"), "value")


def flatten_lists(rows: DataFrame, key: str, lists: str, parts: int | None = None) -> DataFrame:
    """(slot, key, at, value): all lists one behind the other in the order of key, with the place of each entry in it."""
    begin = prefix_sum(rows.select(key, lists), key, F.greatest(F.coalesce(F.size(lists), F.lit(0)), F.lit(0)).cast("long"), parts)
    return begin.select("exclusive", key, F.posexplode(lists).alias("at", "value")).select((F.col("exclusive") + F.col("at")).alias("slot"), key, "at", "value")


def transpose(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(row, col, value) of the matrix whose columns are the arrays of rows: entry i of the array at key k is at (i, k).

    The long form, since a row of the result is as long as the table; a missing entry is a missing row.
    """
    return rows.select(F.col(key).alias("col"), F.posexplode(values).alias("row", "value")).select("row", "col", "value")


def mask_or(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """(key, mask): the bits set in any row of a key; combines before the shuffle."""
    return rows.groupBy(key).agg(F.bit_or(mask).alias(mask))
