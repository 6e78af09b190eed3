"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document gets a 64-bit hash. Per source, the sizes are summed by hash bucket; the running sum finds the bucket in
which the source's budget ends, and only that bucket is summed again by the next hash bits. Documents below the resulting
threshold are taken once more than the others, so nothing is sorted, a larger budget always takes a superset of what a
smaller one takes, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
BITS = 10
LEVELS = 4


def word_count(text: str | Column) -> Column:
    """Number of words in the whole text; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    max_repeat times its source's size and the excess is shared again by weight, until none is above: the targets are
    least(max_repeat * size, level * weight) for one water level, which the sources ordered by cap / weight give in one
    pass. The table has one row a source; a source without words has target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, all_ = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    t = t.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_))
    target = F.when(F.col("source_size") > 0, F.least("cap", F.coalesce(F.col("water.level"), F.lit(0.0)) * F.col("weight"))).otherwise(F.lit(0.0))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _cell(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _prefix(level: int) -> Column:
    """The hash bits of all levels before this one."""
    return F.shiftrightunsigned("h", 64 - BITS * level) if level else F.lit(0).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Size and hash of a row."""
    return word_count(docs[text_col]), F.xxhash64(docs[id_col], docs[text_col])


def thresholds(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, plan). sized: doc_id, source, size, h of each row; plan: a row a source with source_size, target, times, edge, open.

    Documents of a source are taken times times, those whose hash prefix lies below edge once more.
    """
    size, h = _sized(docs, id_col, text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), h.alias("h"))
    sized = materialize(sized, "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = source_targets(sizes, weights, max_repeat).withColumn("times", times)
    plan = plan.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")).withColumn("base", F.lit(0).cast("long")).withColumn("edge", F.lit(0).cast("long"))
    plan = materialize(plan, "mix-plan")
    for level in range(LEVELS):
        plan = materialize(_refine(sized, plan, level), f"mix-level{level}")
    return sized, plan.select(F.col("source").alias("of"), "source_size", "target", "times", "edge", "open")


def _copies(h: Column) -> Column:
    once_more = F.when(F.col("open") & (F.shiftrightunsigned(h, 64 - BITS * LEVELS) < F.col("edge")), F.lit(1)).otherwise(F.lit(0))
    return (F.col("times") + once_more).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken.

    copies is how often the mix takes the row (0 to max_repeat), taken = copies * size. Nulls: a null text has size 0,
    a null source is a source of its own, a null id is hashed like any other. Repeated rows hash alike and are taken
    alike. An empty table gives no rows. Other columns of docs are not looked at.
    """
    sized, plan = thresholds(docs, weights, max_repeat, id_col, text_col, source_col)
    both = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(F.col("h")))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; its columns are docs' own.

    The rows are hashed again where they are read and only meet the plan, a row a source, so no text is shuffled unless
    there are too many sources for a broadcast join.
    """
    _, plan = thresholds(docs, weights, max_repeat, id_col, text_col, source_col)
    plan = plan.select(F.col("of").alias("__of"), "times", "edge", "open").select("__of", F.struct("times", "edge", "open").alias("__plan"))
    _, h = _sized(docs, id_col, text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[source_col].cast("string").alias("__source"), h.alias("__h"))
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("__of")))
    once_more = F.when(F.col("__plan.open") & (F.shiftrightunsigned("__h", 64 - BITS * LEVELS) < F.col("__plan.edge")), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col("__plan.times") + once_more).cast("int")
    return rows.where(copies > 0).select("__row", F.explode(F.array_repeat(F.lit(True), copies)).alias("__copy")).select("__row.*")


def _refine(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The plan with its edge moved one level down.

    edge: hash prefix of the bucket in which the budget ends; base: words below it. The last level rounds to the nearer
    side of that bucket, so edge becomes the first prefix that is not taken. open: whether any document is taken once more.
    """
    p = plan.where("budget > 0").select(F.col("source").alias("of"), "edge")
    inner = sized.join(p, F.col("source").eqNullSafe(F.col("of")) & (_prefix(level) == F.col("edge"))) if level else sized
    hist = inner.groupBy("source", _cell(level).alias("c")).agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.select(F.col("source").alias("of"), "c", "n", run.alias("upto"))
    far = plan.join(hist, F.col("source").eqNullSafe(F.col("of")) & (F.col("base") + F.col("upto") > F.col("budget")) & (F.col("base") + F.col("upto") - F.col("n") <= F.col("budget")), "left")
    keep = ["source", "source_size", "weight", "target", "times", "budget"]
    edge = F.col("edge") * (1 << BITS) + F.coalesce("c", F.lit(0))
    base = F.col("base") + F.coalesce(F.col("upto") - F.col("n"), F.lit(0))
    if level == LEVELS - 1:
        nearer = F.coalesce((F.col("base") + F.col("upto") - F.col("budget")) < (F.col("budget") - base), F.lit(False))
        edge = edge + nearer.cast("long")
    return far.select(*keep, base.alias("base"), edge.alias("edge"), (F.col("budget") > 0).alias("open"))

