"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of a document is addressed by the SHA-256 of its text. Only pairs of blob and rule version that the ledger
has not seen are scanned, and the ledger gets a row for each of them; findings are joined from the ledger back to every row
(path) that holds the blob. A rule version is a name and a digest of the rules themselves, so other rules under the same name
never meet each other's findings. A ledger is a table (blob_id, rule_version, spans) or the folder of one, which a scan extends.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize


@dataclass(frozen=True)
class Rule:
    """kind of secret, pattern (leftmost, not overlapping), the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds with a fixed shape.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"\bgh[opsru]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
RULES_VERSION = "1"
SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"
LEDGER = f"blob_id string, rule_version string, spans {SPANS}"


def rules_key(rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> str:
    """What the ledger knows a set of rules by: the version's name and a digest of kinds, patterns, groups and lengths."""
    said = json.dumps([[r.kind, r.pattern, r.group, r.least] for r in rules])
    return f"{version}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"


def blob_id(text: str | Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def _suspect(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule matches in the text; false for null."""
    return F.coalesce(reduce(Column.__or__, [text.rlike(r.pattern) for r in rules]), F.lit(False))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger kept in a folder; None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _paths(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], version: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(paths, blobs): id and blob_id of each row; blob_id and text of the blobs that the ledger has not seen, one row each.

    A text in which no rule matches is null in blobs. Without a ledger all blobs are new, and one read of the texts makes
    both tables. With one, ids and addresses alone are held against it, and then only the texts of new blobs, each under
    its smallest id, are looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), blob_id(text_col).alias("blob_id"), F.col(text_col).alias("text"))
    hit = F.when(_suspect(F.col("text"), rules), F.col("text")).alias("text")
    if ledger is None:
        paths = new = materialize(rows.select("id", "blob_id", hit), "secrets-paths")
    else:
        paths = materialize(rows.select("id", "blob_id"), "secrets-paths")
        seen = ledger.where(F.col("rule_version") == rules_key(rules, version)).select("blob_id")
        reps = paths.join(seen, "blob_id", "left_anti").groupBy("blob_id").agg(F.min("id").alias("rep"))
        reps = materialize(reps.withColumnRenamed("blob_id", "of"), "secrets-new")
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(reps, F.col("id").eqNullSafe(F.col("rep")))
        new = materialize(texts.where(blob_id("text") == F.col("of")).select(F.col("of").alias("blob_id"), hit), "secrets-texts")
    return paths.select("id", "blob_id"), new.groupBy("blob_id").agg(F.min("text").alias("text"))


def unseen(docs: DataFrame, ledger: DataFrame | None, version: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, text): one row a blob that the ledger has not seen under these rules and this version; no text where no rule matches."""
    return _paths(docs, ledger, rules, version, id_col, text_col)[1]


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, text), a row a blob -> (blob_id, spans), for blobs with a finding only.

    SQL's regular expressions give matches but no places: the text is split at the matches, and a match starts where the
    pieces and the matches before it end. Lengths count code points. The matches of all rules leave a text together.
    """

    def matches(rank: int, r: Rule) -> Column:
        pat = F.lit(r.pattern)
        hits = F.regexp_extract_all("text", pat, F.lit(0))
        both = F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"), hits.alias("hit"), (F.regexp_extract_all("text", pat, F.lit(r.group)) if r.group else hits).alias("own"))
        each = F.transform(both, lambda m, at: F.struct(F.lit(rank).alias("rank"), F.lit(r.kind).alias("kind"), at.alias("at"), F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("hit"), (F.length(m["own"]) >= r.least).alias("ok")))
        return F.when(F.col("text").rlike(r.pattern), each).otherwise(F.array().cast("array<struct<rank:int,kind:string,at:int,gap:int,hit:int,ok:boolean>>"))

    found = blobs.where("text is not null").select("blob_id", F.explode(F.concat(*[matches(k, r) for k, r in enumerate(rules)])).alias("m"))
    found = found.select("blob_id", "m.*").where("hit is not null")
    end = F.sum((F.col("gap") + F.col("hit")).cast("long")).over(Window.partitionBy("blob_id", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("end", end).where("ok")
    spans = F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "end", "kind")))
    return found.groupBy("blob_id").agg(spans.cast(SPANS).alias("spans"))


def _new_rows(blobs: DataFrame, rules: tuple[Rule, ...], version: str) -> DataFrame:
    """The ledger's rows for newly scanned blobs, findings or none."""
    found = find(blobs, rules).withColumnRenamed("blob_id", "of")
    rows = blobs.select("blob_id").join(found, F.col("blob_id") == F.col("of"), "left")
    return rows.select("blob_id", F.lit(rules_key(rules, version)).alias("rule_version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _extended(docs: DataFrame, ledger: DataFrame | str | None, rules: tuple[Rule, ...], version: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id and blob_id of each row, the ledger after the run)."""
    spark = docs.sparkSession
    old = read_ledger(spark, ledger) if isinstance(ledger, str) else ledger
    paths, blobs = _paths(docs, old, rules, version, id_col, text_col)
    new = _new_rows(blobs, rules, version)
    if isinstance(ledger, str):
        new.write.mode("append").parquet(ledger)
        return paths, read_ledger(spark, ledger)
    new = materialize(new, "secrets-ledger")
    return paths, new if old is None else old.select("blob_id", "rule_version", F.col("spans").cast(SPANS).alias("spans")).unionByName(new)


def scan(docs: DataFrame, ledger: DataFrame | str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, blob_id, spans (by start, then kind as listed; empty if none), all from the ledger.

    ledger: that of earlier runs, as a table or as a folder, to which the new blobs are added; None for an empty one. Rows
    that runs side by side added twice count once. Nulls: a null text is the empty blob; a null id is kept. Repeated rows
    each get their row. An empty table gives no rows. Other columns are not looked at.
    """
    paths, known = _extended(docs, ledger, rules, version, id_col, text_col)
    found = known.where((F.col("rule_version") == rules_key(rules, version)) & (F.size("spans") > 0)).select(F.col("blob_id").alias("of"), "spans").dropDuplicates(["of"])
    out = paths.join(materialize(found, "secrets-found"), F.col("blob_id") == F.col("of"), "left")
    return out.select(F.col("id").alias("doc_id"), "blob_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def extend(docs: DataFrame, ledger: DataFrame | str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger after a run over docs: the old rows and one row a newly scanned blob, findings or none."""
    return _extended(docs, ledger, rules, version, id_col, text_col)[1]


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: DataFrame | str | None = None, mark: str = "[REDACTED]", text_col: str = "text", rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """docs with every found span replaced by mark; where spans touch or overlap the mark stands once. Its columns are docs' own.

    Findings come from the ledger, which gets the blobs that it has not seen, as in scan(). The texts are looked at once:
    rows are written with the address of those in which a rule matches; only these are held against the ledger, and the
    others pass as they are. The pieces between the spans are cut out by their places, so the replacement is what the scan
    found and nothing else.
    """
    blob = F.when(_suspect(F.col(text_col), rules), blob_id(text_col))
    marked = materialize(docs.withColumn("__blob", blob), "secrets-marked")
    dirty = marked.where("__blob is not null")
    _, known = _extended(dirty, ledger, rules, version, "__blob", text_col)
    found = known.where((F.col("rule_version") == rules_key(rules, version)) & (F.size("spans") > 0)).select(F.col("blob_id").alias("__of"), F.col("spans").alias("__spans")).dropDuplicates(["__of"])
    rows = dirty.join(materialize(found, "secrets-found"), F.col("__blob") == F.col("__of"), "left")
    merged = F.aggregate(
        "__spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.when(s["start"] <= acc["at"], F.when(F.size(acc["out"]) == 0, F.array(F.lit(""))).otherwise(acc["out"])).otherwise(F.concat(acc["out"], F.array(F.substring(F.col(text_col), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))))).alias("out"))
        ),
    )
    rows = rows.withColumn("__m", merged)
    tail = F.substring(F.col(text_col), F.col("__m.at").cast("int") + 1, F.length(text_col))
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.array_join(F.concat(F.col("__m.out"), F.array(tail)), mark))
    return marked.where("__blob is null").drop("__blob").unionByName(rows.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]))
