"""Exact top-k by inner product with Fagin's threshold algorithm over blocks of candidates.

Candidates and queries are dealt out row by row, packed where they are read into small blocks of whole numbers as narrow as
hold them, and meet deal by deal. A deal's candidates go in blocks with a sorted list for each dimension. The lists are
walked from the ends that the signs of a group of queries prefer, for the whole group at once: every vector met is scored in
full, by one matrix product a step, and a query's walk stops as soon as the score that a vector not yet met could reach at
most is below its k-th best score, those of earlier blocks included. Lists are walked in growing strides. The k best of each
deal are merged by a window over the query. How early a walk stops depends on the vectors: soon where few dimensions decide,
as in sparse or skewed ones; where all dimensions weigh alike and nothing is similar, every vector is met before the bound
falls, and the walk scores them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates with one set of lists, and queries that walk them together, at most.
BLOCK, GROUP = 8192, 512
#: Bytes of a packed block at most (or one vector), bytes that a task packs at once, and deals of candidates times queries.
PACKED, HELD, DEALS = 1 << 18, 1 << 24, 256
NONE = np.finfo(np.float64).min


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, ids, scores) of the k highest scores of each of n queries, smaller ids first among equals."""
    order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    count = np.bincount(of, minlength=n)
    first = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) < k
    return of[first], ids[first], scores[first]


class Lists:
    """The sorted per-dimension lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)
        self.longest = float(np.sqrt((self.vectors * self.vectors).sum(1).max(initial=0.0)))
        self.scored = 0  # candidates scored so far, for all queries

    def top(self, query: np.ndarray, own: int, k: int, stride: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions, scores) of the k best other than the query's own id, smaller ids first among equals; depth walked."""
        _, at, scores, depth = self.walk(query[None, :], np.array([own]), k, np.array([NONE]), stride)
        return at, scores, depth

    def walk(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, stride: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, position, score) of the k best of each query with scores of at least least, as top; depth of the longest walk.

        The threshold is the score made of the values at the walked depth of all lists. A vector not met has no larger
        product in any dimension, so once the threshold is below the k-th score nothing better, and no tie, is left.
        """
        n = len(self.ids)
        if self.longest * float(np.sqrt((queries * queries).sum(1).max(initial=0.0))) >= 2**53:
            raise ValueError("scores of 2**53 or more are not exact in doubles: use a smaller scale")
        met, going, kth = np.zeros(n, bool), np.arange(len(queries)), least.astype(np.float64)
        of, at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        up, depth = 0, min(stride, n)
        while True:
            some = queries[going]
            down, rise, rows = np.flatnonzero((some > 0).any(0)), np.flatnonzero((some < 0).any(0)), np.arange(up, depth)
            new = np.zeros(n, bool)
            new[self.order[n - 1 - rows][:, down].ravel()] = True
            new[self.order[rows][:, rise].ravel()] = True
            if not len(down) and not len(rise):  # all scores are zero
                new[:] = True
            new &= ~met
            met |= new
            fresh = np.flatnonzero(new)
            for a in range(0, len(fresh), BLOCK // 4):
                part = fresh[a : a + BLOCK // 4]
                got = self._scores(some, own[going], part)
                if len(part) > k:
                    kth[going] = np.maximum(kth[going], np.partition(got, -k, axis=1)[:, -k])
                q, c = np.nonzero((got >= kth[going][:, None]) & (got > NONE))
                of, at, scores = _best(np.append(of, going[q]), np.append(at, part[c]), np.append(scores, got[q, c]), len(queries), k)
                last = np.flatnonzero(np.bincount(of, minlength=len(queries)) == k)
                ends = np.searchsorted(of, last, side="right") - 1
                kth[last] = np.maximum(kth[last], scores[ends])
            if depth == n or met.all():
                return of, at, scores, depth
            high, low = self.sorted[n - depth], self.sorted[depth - 1]
            going = going[np.maximum(some, 0) @ high + np.minimum(some, 0) @ low >= kth[going]]
            if not len(going):
                return of, at, scores, depth
            up, depth = depth, min(n, depth * 2)

    def _scores(self, queries: np.ndarray, own: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Scores, a row a query; of candidates with the query's own id NONE. Whole-number products below 2**53 add up exactly."""
        got, ids = queries @ self.vectors[fresh].T, self.ids[fresh]  # ids ascend
        at, end = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        self.scored += got.size - int((end - at).sum())
        while (same := np.flatnonzero(at < end)).size:
            got[same, at[same]] = NONE
            at[same] += 1
        return got


def quantise(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): each component as floor(scale * component); rows with a null or non-finite part are left out."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return x.where("id is not null and v is not null").where(~F.exists("v", bad)).select("id", F.transform("v", lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("vec"))


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks (deal, dim, kind, ids, vecs) of (id, vec, deal), made where the rows are read: kind is the narrowest type that holds all components."""

    def block(deal: int, ids: np.ndarray, vecs: np.ndarray) -> dict:
        ends = (float(vecs.min(initial=0.0)), float(vecs.max(initial=0.0)))
        kind = next((t for t in ("i1", "i2", "i4") if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max), "f8")
        return {"deal": deal, "dim": vecs.shape[1], "kind": kind, "ids": ids.astype("<i8").tobytes(), "vecs": vecs.astype(f"<{kind}").tobytes()}

    schema = pa.schema([("deal", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def out(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for dim in list(held):
            ids, vecs, deals = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.argsort(deals, kind="stable")
            ids, vecs, deals = ids[order], vecs[order], deals[order]
            most, starts = max(1, PACKED // (8 * max(dim, 1))), np.flatnonzero(np.diff(deals, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(deals)), strict=True):
                for c in range(a, b, most):
                    yield pa.RecordBatch.from_pylist([block(int(deals[a]), ids[c : min(b, c + most)], vecs[c : min(b, c + most)])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            ids, lists, deals = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                held.setdefault(int(dim), []).append((ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)], deals[at]))
            size += 8 * (len(flat) + 2 * len(ids))
            if size >= HELD:
                yield from out(held)
                size = 0
        yield from out(held)

    return rows.mapInArrow(run, "deal int, dim int, kind string, ids binary, vecs binary")


def _unpacked(blocks: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of all blocks of each dimension, the vectors in the widest of their types."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for dim, kind, ids, vecs in zip(*(blocks[c].to_pylist() for c in ("dim", "kind", "ids", "vecs")), strict=True):
        i = np.frombuffer(ids, "<i8")
        found.setdefault(dim, []).append((i, np.frombuffer(vecs, f"<{kind}").reshape(len(i), dim)))
    return {dim: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for dim, parts in found.items()}


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by every; candidates all rows with another id and a vector of the same
    length. Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id. If a
    query's id repeats, its smallest vector asks; repeated candidates are all candidates and each may be returned. An empty
    table gives no rows. Scores are whole numbers; vectors long enough for one of 2**53 or more, which doubles do not hold
    exactly, fail the job.
    """
    all_ = quantise(vectors, scale, id_col, vec_col)
    asked = all_.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    # The stated query set against all rows: a deal is one of `wide` parts of the candidates beside one of `high` parts of
    # the queries, which are far fewer, so candidates are copied `high` times and queries `wide` times: least when balanced.
    tasks = min(DEALS, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wide = min(tasks, max(1, round((tasks * every) ** 0.5)))
    high = max(1, tasks // wide)
    part = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = _packed(all_.withColumn("deal", part(wide))).withColumn("other", each(high)).withColumn("deal", F.col("other") * wide + F.col("deal")).drop("other")
    q = _packed(asked.withColumn("deal", part(high))).withColumn("other", each(wide)).withColumn("deal", F.col("deal") * wide + F.col("other")).drop("other")

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found, there = [(np.zeros(0, np.int64),) * 3], _unpacked(candidates)
        for dim, (asks, wanted) in _unpacked(queries).items():
            ids, vecs = there.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for a in range(0, len(ids), BLOCK):
                lists, least = Lists(ids[a : a + BLOCK], vecs[a : a + BLOCK]), np.full(len(asks), NONE)
                last = np.flatnonzero(np.bincount(held[0], minlength=len(asks)) == k)
                least[last] = held[2][np.searchsorted(held[0], last, side="right") - 1]
                got = [held]
                for b in range(0, len(asks), GROUP):
                    of, at, scores, _ = lists.walk(wanted[b : b + GROUP].astype(np.float64), asks[b : b + GROUP], k, least[b : b + GROUP])
                    got.append((of + b, lists.ids[at], scores))
                held = _best(*(np.concatenate(x) for x in zip(*got, strict=True)), len(asks), k)
            found.append((asks[held[0]], held[1], held[2].astype(np.int64)))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    found = c.groupBy("deal").cogroup(q.groupBy("deal")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
