"""Quality classifier: document evidence under hierarchical empirical Bayes over hosts and paths.

A logistic model on measures of the text is fitted to a bounded sample of labelled documents. Its calibrated odds are the
document's evidence. Rates of good documents are then estimated for all hosts and paths from every document (its label
where it has one, else the model's probability): a host's rate is shrunk toward the global rate, a path's toward its
host's, with prior weights fitted to the spread of the rates. The posterior odds are the evidence times the path's odds
over the global odds, so a path with few documents leaves the evidence alone.

Toxic texts are told by two measures together. Single words that stand almost only in toxic documents count by themselves.
Weak evidence is pooled over the document by a second logistic model, over the same measures and over how often the most
telling words and runs of bytes within words occur, in lower case of any script: so a stem counts in all its inflections.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import _text, quality_rules
from pointloom.plans.storage import materialize

#: Labelled documents that the models are fitted to at most.
SAMPLE = 20_000
#: A word counts as a sign of toxic text from this log odds ratio and this many standard errors on.
SIGN_ODDS, SIGN_ERRORS = 3.0, 4.0
#: Signs that a model holds at most, the strongest first.
SIGNS = 4096
#: Bytes in a gram, the space before a word counted.
GRAMS = (4, 6, 8)
#: At most so many words and grams are pooled, each in two toxic documents or more and so many standard errors above chance.
POOLED, POOLED_ERRORS = 512, 3.0
#: Weights of the pooled model are held back by this much; at most so many rows of features wait to be merged.
POOLED_RIDGE, WAITING = 10.0, 1 << 21


def _share(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return quality_rules._per_doc(flags, off)


def describe(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of numbers for each document, none of which grows without bound."""
    m = {k: v.astype(float) for k, v in quality_rules.measure(buf, off).items()}
    words, chars, lines = (np.maximum(m[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    upper, lower = _share((buf >= 65) & (buf <= 90), off), _share((buf >= 97) & (buf <= 122), off)
    digit, bang = _share((buf >= 48) & (buf <= 57), off), _share((buf == 33) | (buf == 63), off)
    punct = _share((buf == 44) | (buf == 46), off)
    cols = [np.log1p(m["n_words"]), (m["n_words"] < 20).astype(float), m["word_chars"] / words, upper / np.maximum(upper + lower, 1), digit / chars, bang / words, punct / words, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, np.log1p(words / lines)]
    x = np.stack(cols, axis=1)
    return np.concatenate((x, np.minimum(x, 10) ** 2), axis=1)


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, without case and without punctuation at its end."""
    last = ends.copy()
    edge = np.isin(buf, np.frombuffer(b".,;:!?\"')(*$%&#", np.uint8))
    cut = np.arange(len(ends))
    for _ in range(3):
        cut = cut[(last[cut] > starts[cut]) & edge[last[cut] - 1]]
        last[cut] -= 1
    return _text.span_hashes(buf, starts, last, fold=True)


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case in any script; a text that is not UTF-8 only in A-Z."""
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        return pc.ascii_lower(texts) if len(texts) == 1 else pa.concat_arrays([_lower(texts.slice(i, 1)) for i in range(len(texts))])


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of the words and of the grams of each size in turn, in lower case; no gram spans two words."""
    low = _lower(texts)
    for buf, off, a, _ in _text.chunks(low, low):
        starts, ends, first = _text.words(buf, off)
        yield a + _text.owner(first), _text.mix64(_hashes(buf, starts, ends))
        b = np.insert(buf, off[:-1], 32)
        space = _text.SPACE[b]
        b[space] = 32
        count = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
        for size in GRAMS:
            h = _text.gram_hashes(b, size)
            at = np.flatnonzero(count[size : size + len(h)] == count[1 : 1 + len(h)])
            yield a + np.searchsorted(off + np.arange(len(off)), at, side="right") - 1, h[at]


def tell(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the texts and for each the numbers of other and of toxic documents that hold it."""
    doc, h = (np.concatenate(x) for x in zip(*features(texts), strict=True))
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return merged(h[new], np.eye(2, dtype=np.int64)[toxic.astype(np.int64)[doc[new]]])


def merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with the sums of its rows of n."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


class Known:
    """Known hashes, found whole; low bits alone only rule out."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where h is known, and as which of the keys."""
        some = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        hit = self.keys[at] == h[some]
        return some[hit], at[hit]


class Pool(Known):
    """The pooled features."""

    def rates(self, texts: pa.Array, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, index of the feature, log rate a hundred words) of all that occur, in this order."""
        found = [np.zeros(0, np.int64)]
        for doc, h in features(texts):
            where, at = self.find(h)
            found.append(doc[where] * len(self.keys) + at)
        code, n = np.unique(np.concatenate(found), return_counts=True)
        doc, at = np.divmod(code, len(self.keys))
        return doc, at, np.log1p(100 * n / np.maximum(n_words[doc], 20))


@dataclass
class Model:
    """Logistic weights over the described numbers; signs: the words that mark toxic text, by whole hashes, with their odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    signs: Known
    odds: np.ndarray
    pool: Pool | None = None
    pooled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale)) @ self.weights, -30, 30)

    def toxic(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        starts, ends, first = _text.words(buf, off)
        where, at = self.signs.find(_hashes(buf, starts, ends))
        out = np.zeros(len(off) - 1)
        np.maximum.at(out, _text.owner(first)[where], self.odds[at])
        return out

    def pooled_toxic(self, texts: pa.Array, x: np.ndarray) -> np.ndarray:
        """Log odds of a toxic text by the pooled model, 0 where they are below."""
        if self.pool is None:
            return np.zeros(len(x))
        mean, scale, w = self.pooled
        k = len(self.pool.keys)
        slope = w[1:] / scale
        doc, at, rate = self.pool.rates(texts, np.expm1(x[:, 0]))
        return np.maximum(np.bincount(doc, weights=rate * slope[at], minlength=len(x)) + x @ slope[k:] + w[0] - mean @ slope, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) by Newton steps with a ridge, a step halved while it makes the fit worse.

    With no rows or one class the weights say just the rate.
    """
    n, d = x.shape
    rate = (y.sum() + 1) / (n + 2)
    w = np.zeros(d + 1)
    w[0] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return np.zeros(d), np.ones(d), w
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-9
    blocks = [slice(a, a + 4096) for a in range(0, n, 4096)]
    pen = np.full(d + 1, ridge)
    pen[0] = 1e-6

    def rows(s: slice) -> np.ndarray:
        return np.column_stack((np.ones(len(x[s])), (x[s] - mean) / scale))

    def loss(w: np.ndarray) -> float:
        q = np.concatenate([rows(s) @ w for s in blocks])
        return (np.logaddexp(0, q) - y * q).sum() + (pen * w * w).sum() / 2

    now = loss(w)
    for _ in range(steps):
        curve, slope = np.diag(pen), -pen * w
        for s in blocks:
            z = rows(s)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
            slope += z.T @ (y[s] - p)
        step = np.linalg.solve(curve, slope)
        while (then := loss(w + step)) > now and np.abs(step).max() >= 1e-6:
            step = step / 2
        w, now = w + step, then
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def sign_odds(with_: np.ndarray, without: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a word is a sign, its log odds ratio) from the numbers of toxic and other documents that hold it, of n1 and n0."""
    odds = np.log((with_ + 0.5) / (n1 - with_ + 0.5)) - np.log((without + 0.5) / (n0 - without + 0.5))
    error = np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
    return (odds > SIGN_ODDS) & (odds > SIGN_ERRORS * error), odds


def fit_signs(words: list[np.ndarray], toxic: np.ndarray) -> tuple[Known, np.ndarray]:
    """The words (hashes, once a document) that stand in far more toxic documents than others, and their log odds ratio."""
    h = np.concatenate([np.zeros(0, np.uint64), *words])
    kind = np.repeat(toxic.astype(np.int64), [len(w) for w in words])
    h, n = merged(h, np.eye(2, dtype=np.int64)[kind])
    sign, odds = sign_odds(n[:, 1], n[:, 0], int(toxic.sum()), int((~toxic).sum()))
    return Known(h[sign]), odds[sign]


def found_signs(told: DataFrame, n_toxic: int, n_other: int) -> tuple[Known, np.ndarray]:
    """fit_signs for a table (text, toxic): words are counted where they are read, and only the signs come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (batch.column(1).to_numpy(zero_copy_only=False) != 0).astype(np.int64)
            for buf, off, a, n in _text.chunks(batch.column(0), batch.column(0)):
                starts, ends, first = _text.words(buf, off)
                h, doc = _hashes(buf, starts, ends), _text.owner(first)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, m = merged(h[new], np.eye(2, dtype=np.int64)[kind[a + doc[new]]])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(m[:, 0]), pa.array(m[:, 1])], names=["h", "other", "toxic"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign, odds = sign_odds(batch.column(2).to_numpy(), batch.column(1).to_numpy(), n_toxic, n_other)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds)], names=["h", "odds"]).filter(pa.array(sign))

    counts = told.mapInArrow(count, "h long, other long, toxic long").groupBy("h").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).where("toxic > 0")
    got = counts.mapInArrow(judge, "h long, odds double").orderBy(F.desc("odds"), "h").limit(SIGNS).collect()
    h = np.array([r["h"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Known(h), np.array([r["odds"] for r in got], float)[order]


def pooled_keys(told: DataFrame, n_toxic: int, n_other: int) -> np.ndarray:
    """The features of (text, toxic) that stand in more toxic documents than chance puts there, the clearest POOLED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, n = merged(*(np.concatenate(x) for x in zip(*wait, strict=True)))
            for a in range(0, len(h), 1 << 16):
                m = n[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)].view(np.int64)), pa.array(m[:, 0]), pa.array(m[:, 1])], names=["h", "other", "toxic"])

        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) != 0
            for _, _, a, n in _text.chunks(batch.column(0), batch.column(0)):
                wait.append(tell(batch.column(0).slice(a, n), toxic[a : a + n]))
                size += len(wait[-1][0])
                if size > WAITING:
                    yield from out()
                    wait, size = [], 0
        if wait:
            yield from out()

    n = n_toxic + n_other
    found = told.mapInArrow(run, "h long, other long, toxic long").groupBy("h").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).where("toxic >= 2")
    both = F.col("toxic") + F.col("other")
    chance = both * n_toxic / n
    errors = (F.col("toxic") - chance) / F.sqrt(chance * (n_other / n) * (1 - both / n) + 1e-9)
    got = found.select("h", errors.alias("errors")).where(F.col("errors") > POOLED_ERRORS).orderBy(F.desc("errors"), "h").limit(POOLED).collect()
    return np.array([r["h"] for r in got], np.int64).view(np.uint64)


def fit_pool(told: DataFrame, n_toxic: int, n_other: int) -> tuple[Pool | None, tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """The pooled features and (mean, scale, weights) over them and the described numbers; none where nothing tells."""
    keys = pooled_keys(told, n_toxic, n_other) if n_toxic and n_other else []
    if not len(keys):
        return None, None
    pool = Pool(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, off, a, n in _text.chunks(batch.column(0), batch.column(0)):
                x = describe(buf, off)
                doc, at, rate = pool.rates(batch.column(0).slice(a, n), np.expm1(x[:, 0]))
                full = np.zeros((n, len(keys)), np.float32)
                full[doc, at] = rate
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.concatenate((full, x.astype(np.float32)), axis=1)], pa.binary()), batch.column(1).slice(a, n)], names=["x", "toxic"])

    got = told.mapInArrow(run, "x binary, toxic int").toArrow()
    got = sorted(zip(got["x"].to_pylist(), got["toxic"].to_pylist(), strict=True))  # sums in the same order in each run
    x = np.frombuffer(b"".join(r for r, _ in got), np.float32).reshape(len(got), -1)
    return pool, fit_logistic(x, np.array([float(t != 0) for _, t in got]), POOLED_RIDGE)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits to at most sample labelled documents, chosen by hash of their id and so the same in each run.

    What comes to the driver is bounded by sample, POOLED and SIGNS, whatever the texts' lengths. Of documents that share an
    id one counts, the same in each run.
    """
    lab = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("lid")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    lab = materialize(lab.orderBy(F.xxhash64("lid"), "lid").limit(sample), "quality-sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(lab), F.col("doc_id") == F.col("lid"))  # at most sample rows
    kept = F.struct("text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    rows = materialize(rows.groupBy("lid").agg(F.min_by(kept, F.xxhash64("text")).alias("r")).select("r.*"), "quality-texts")  # a row an id, however often it repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, off, a, n in _text.chunks(batch.column(0), batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in describe(buf, off)], pa.binary()), batch.column(1).slice(a, n), batch.column(2).slice(a, n)], names=["x", "quality", "toxic"])

    got = rows.mapInArrow(run, "x binary, quality int, toxic int").collect()
    good = sorted((r["x"], r["quality"]) for r in got if r["quality"] is not None)  # sums in the same order in each run
    width = len(describe(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])
    x = np.array([np.frombuffer(r) for r, _ in good]).reshape(-1, width)
    told, toxic = rows.where("toxic is not null").select("text", "toxic"), [bool(r["toxic"]) for r in got if r["toxic"] is not None]
    n_toxic, n_other = sum(toxic), len(toxic) - sum(toxic)
    signs, pool = found_signs(told, n_toxic, n_other), fit_pool(told, n_toxic, n_other)
    return Model(*fit_logistic(x, np.array([float(q > 0) for _, q in good])), *signs, *pool)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, host, path, logit (log odds of a good document) and toxic of each whole text.

    toxic: the strongest sign or the pooled log odds, whichever is more; 0 for a text that is not toxic.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (host if host is not None else F.col("source")).cast("string").alias("host"), (path if path is not None else F.col("lang")).cast("string").alias("path"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for buf, off, a, n in _text.chunks(batch.column(0), batch.column(3)):
                x = describe(buf, off)
                toxic = np.maximum(m.toxic(buf, off), m.pooled_toxic(batch.column(3).slice(a, n), x))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, n) for k in range(3)), pa.array(m.logit(x)), pa.array(toxic)], names=["doc_id", "host", "path", "logit", "toxic"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["host"], rows.schema["path"], T.StructField("logit", T.DoubleType()), T.StructField("toxic", T.DoubleType())]))


def _weight(rate: Column, around: Column) -> Column:
    """Weight of a beta prior by moments: groups that spread as chance would have them give a large one."""
    return F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.coalesce(F.avg(around * (1 - around)) / F.nullif(F.avg((rate - around) * (rate - around)), F.lit(0.0)) - 1, F.lit(1000.0))))


def site_rates(scored: DataFrame) -> DataFrame:
    """(host, path, good) -> host, path, n_path, n_host, host_rate, path_rate, all_rate: rates shrunk level by level."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), F.sum("good").alias("s_path"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    hosts = hosts.withColumn("all_rate", hosts.agg(F.sum("s_host") / F.sum("n_host")).scalar())
    hosts = hosts.withColumn("host_w", hosts.agg(_weight(F.col("s_host") / F.col("n_host"), F.col("all_rate"))).scalar())
    hosts = materialize(hosts.select(F.col("host").alias("h"), "n_host", "all_rate", ((F.col("s_host") + F.col("all_rate") * F.col("host_w")) / (F.col("n_host") + F.col("host_w"))).alias("host_rate")), "quality-hosts")
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    both = both.withColumn("path_w", both.agg(_weight(F.col("s_path") / F.col("n_path"), F.col("host_rate"))).scalar())
    rate = (F.col("s_path") + F.col("host_rate") * F.col("path_w")) / (F.col("n_path") + F.col("path_w"))
    return both.select("host", "path", "n_path", "n_host", "all_rate", "host_rate", rate.alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, evidence, toxic, host_rate, path_rate, posterior, kept.

    kept: the posterior reaches threshold and the text is not toxic, by a sign or by the pooled evidence. Host and path default to source and lang.
    Nulls: a null text is judged as empty, a null host or path is one of its own, a null id has no label. Repeated rows are
    judged alike and count each; of repeated labels the largest holds. Without labels all evidence is the same and all
    documents stay. An empty table gives no rows. Other columns are not looked at.
    """
    scored = materialize(score(docs, fit(docs, labels, sample, id_col, text_col), id_col, text_col, host, path), "quality-scores")
    lab = labels.where("quality is not null").groupBy(F.col("doc_id").alias("lid")).agg((F.max("quality") > 0).cast("double").alias("told"))
    p = 1 / (1 + F.exp(-F.col("logit")))
    rates = materialize(site_rates(scored.join(lab, F.col("doc_id") == F.col("lid"), "left").select("host", "path", F.coalesce("told", p).alias("good"))), "quality-sites")
    rates = rates.withColumnRenamed("host", "h").withColumnRenamed("path", "p")
    odds = lambda c: F.log((F.col(c) + 1e-6) / (1 - F.col(c) + 1e-6))
    out = scored.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    post = 1 / (1 + F.exp(-(F.col("logit") + odds("path_rate") - odds("all_rate"))))
    return out.select("doc_id", F.col("logit").alias("evidence"), "toxic", "host_rate", "path_rate", post.alias("posterior"), ((post >= threshold) & (F.col("toxic") <= 0)).alias("kept"))
