"""Quality rules: measures of each document, rule failures by host with a shrunken rate, and verdicts joined back.

A document fails outright by the base rules. The softer rules alone reject nothing: a host's share of failing documents is
shrunk toward the mean of all hosts by a beta prior fitted to the hosts' own rates, and is taken as the odds that a document
of that host which fails a soft rule is bad. How far it exceeds the rule's bound shifts these odds: on an ordinary host only
a gross excess rejects, on a bad one any does. Documents that fail no rule are always kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import _text
from pointloom.plans.storage import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[off])


def _twice(key: np.ndarray, stable: bool) -> tuple[np.ndarray, np.ndarray]:
    """(later, any): whether the same key came before; whether it comes elsewhere at all."""
    order = np.argsort(key, kind="stable" if stable else None)
    k = key[order]
    same = k[1:] == k[:-1]
    later, some = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    return later, some


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document in a chunk of UTF-8 bytes."""
    n_docs = len(off) - 1
    starts, ends, first = _text.words(buf, off)
    solid = ~_text.SPACE[buf]
    out = {"n_words": np.diff(first), "word_chars": _per_doc(solid & ((buf & 0xC0) != 0x80), off), "n_symbols": _per_doc(_SYMBOL[buf], off)}
    with np.errstate(over="ignore"):
        feeds = np.flatnonzero(buf == 10) + 1
        lines = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], feeds[feeds < len(buf)])))
        ends_of = np.searchsorted(starts, np.append(lines, len(buf)))
        of = np.searchsorted(off, lines, side="right") - 1
        stops = np.append(lines, len(buf))[1:]
        key = _text.span_hashes(buf, lines, stops - (buf[stops - 1] == 10)) ^ _text.mix64(of.astype(np.uint64) * _GOLDEN)
        worded = np.diff(ends_of) > 0
        of, key = of[worded], key[worded]
        later, _ = _twice(key, True)
        out["n_lines"] = np.bincount(of, minlength=n_docs)
        out["n_dup_lines"] = np.bincount(of[later], minlength=n_docs)
        h = _text.window_hashes(_text.span_hashes(buf, starts, ends), WINDOW)
        of = _text.owner(first)
        at = np.flatnonzero(_text.window_starts(first, WINDOW)[: len(h)]) if len(h) else np.zeros(0, np.int64)
        _, some = _twice(h[at] ^ _text.mix64(of[at].astype(np.uint64) * _GOLDEN), False)
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, at[some], 1)
        np.add.at(edge, at[some] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(of[np.cumsum(edge[:-1]) > 0], minlength=n_docs) if len(starts) else np.zeros(n_docs, np.int64)
    return out


def measures(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the MEASURES of each whole text; a null text has none of anything.

    Without an id_col the rows themselves go along instead of an id, as the struct row.
    """
    text, host = F.col(text_col), F.col(host_col).cast("string")
    if id_col is None:
        rows, first = docs.select(host.alias("__host"), text.alias("__text"), *[docs[c] for c in docs.columns if c != text_col]), T.StructField("row", docs.schema)
    else:
        rows, first = docs.select(host.alias("host"), text.alias("text"), F.col(id_col).alias("doc_id")), None
    schema = T.StructType([first or rows.schema["doc_id"], T.StructField("host", T.StringType()), *[T.StructField(m, T.LongType()) for m in MEASURES]])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2) if first is None else None
            if own is None:  # the text is sent once and put back in its place
                by = dict(zip([c for c in names if c != text_col], batch.columns[2:], strict=True)) | {text_col: batch.column(1)}
                own = pa.StructArray.from_arrays([by[c] for c in names], names=names)
            for buf, off, a, n in _text.chunks(batch.column(1), batch.column(1)):
                m = measure(buf, off)
                yield pa.RecordBatch.from_arrays([own.slice(a, n), batch.column(0).slice(a, n), *[pa.array(m[x].astype(np.int64)) for x in MEASURES]], names=schema.names)

    return rows.mapInArrow(run, schema)


def failures(m: DataFrame) -> DataFrame:
    """base_failed and soft_failed beside the measures."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n_docs, n_failed and the shrunken rate: (failed + a) / (docs + a + b).

    a and b fit a beta distribution to the hosts' rates by mean and variance, each host counting once; their sum is held
    between 2 and 1000, so one host or equal rates still give a prior.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "rules-counts")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"))
    weight = F.when(F.col("var") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1).otherwise(F.lit(1000.0))
    prior = prior.select("mean", F.least(F.lit(1000.0), F.greatest(F.lit(2.0), weight)).alias("weight"))
    all_ = hosts.withColumns({c: prior.select(c).scalar() for c in ("mean", "weight")})
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return all_.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"))


def excess() -> Column:
    """How many times over its bound the worst soft measure is; at most 1 where no soft rule fails."""
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    n, c = F.col("n_words"), F.col("word_chars")
    return F.greatest(over(10 * F.col("n_symbols"), n), over(10 * F.col("n_dup_lines"), 3 * F.col("n_lines")), over(2 * n, c), over(c, 15 * n))


def rejected() -> Column:
    """A host's shrunken rate are the odds that a document of it is bad; its own excess, squared, shifts them. Even odds reject."""
    return F.col("soft_failed") & (F.col("host_rate") * excess() * excess() > 1 - F.col("host_rate"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns.

    Rows are judged by themselves, so no id is needed and none is joined. The texts are measured once and written with their
    measures; hosts are counted from those. Only rows that fail a soft rule meet the hosts' rates; nothing else is shuffled.
    """
    rows = materialize(failures(measures(docs, None, text_col, host_col)), "rules-rows")
    hosts = materialize(host_rates(rows).withColumnRenamed("host", "of"), "rules-hosts")
    fine = rows.where(~F.col("base_failed"))
    soft = fine.where("soft_failed").join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(~rejected())
    return fine.where(~F.col("soft_failed")).select("row.*").unionByName(soft.select("row.*"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, host, the MEASURES, base_failed, soft_failed, host_rate, kept.

    kept: no base rule fails, and if a soft one does, the host's rate and the document's own excess leave it the better odds
    (see rejected); a document that fails no rule stays whatever its host. Nulls: a null text fails the base rules; a null
    host is a host of its own; a null id is kept as it is. Repeated rows are judged alike and count each. An empty table gives
    no rows. Other columns are not looked at.
    """
    judged = materialize(failures(measures(docs, id_col, text_col, host_col)), "rules-measures")
    hosts = materialize(host_rates(judged).withColumnRenamed("host", "of"), "rules-hosts")
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("of")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected(), F.lit(False))).drop("of")
