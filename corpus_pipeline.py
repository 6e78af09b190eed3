"""From raw documents to token ids: rules, near duplicates, secrets, mixture, encoding.

Each stage takes all that the one before kept and its decisions take effect. All but the last return the columns of
documents. Rows that share an id, or have none, are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import bpe, minhash, mixing, quality_rules, secrets
from pointloom.llm.queries import small_batches, vocabulary
from pointloom.plans.storage import materialize, scratch, scratch_path

#: Ids below this are given to rows whose own id is null or not theirs alone.
GIVEN = -(1 << 62)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a base rule nor, by their host's rate and their own excess, a soft one."""
    small_batches(spark)
    return quality_rules.keep(docs)


def _one_of_each(rows: DataFrame, by: str) -> DataFrame:
    """One row for each value of by, the smallest in the order of its columns that have an order; combined before the shuffle."""
    ordered = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType))]
    return rows.groupBy(F.col(by).alias("__by")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*ordered)).alias("__row")).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows whose id is null or repeats stand for themselves under an id made of id and text; of those that share both, one stays.
    """
    small_batches(spark)
    several = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    several = materialize(several.select(F.col("doc_id").alias("__several"), F.lit(True).alias("__many")), "pipeline-several")
    given = F.lit(GIVEN) - F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.join(several, docs["doc_id"].eqNullSafe(F.col("__several")), "left").withColumn("__id", F.when(F.col("__many"), given).otherwise(F.col("doc_id"))).drop("__several", "__many")
    groups = minhash.near_duplicates(rows, k=5, percent=80, id_col="__id")
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "pipeline-dropped")
    left = rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    return left.where(F.col("__id") >= GIVEN).unionByName(_one_of_each(left.where(F.col("__id") < GIVEN), "__id")).drop("__id")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark.

    Findings go through a ledger: the folder that pointloom.secrets.ledger names in the session, so that a later run scans
    new texts only, or else one of this run.
    """
    ledger = spark.conf.get("pointloom.secrets.ledger", None) or scratch_path(spark, "pipeline-ledger")
    out = secrets.redact(docs, ledger)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.take(docs, weights=(5.0, 2.0, 1.0), max_repeat=3.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each row."""
    small_batches(spark)
    return bpe.encode(docs, vocabulary(), ends=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scans", secret_scan), ("source mixture", mixture), ("byte-level BPE", encoding)]

#: Hash thresholds, signatures and pair merging have no SQL; the tests hold run() against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage leaves in the shared folder goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), docs)
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
