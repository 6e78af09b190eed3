"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and grouping of the links.

Exact copies are one class from the start. Each class has a SuperMinHash signature: an element gets one random permutation
of the signature's places, and its rank at a place decides before its random fraction does, which spreads a small set over
all places. Ranks are worked off step by step for all elements at once, and a document stops as soon as every place has a
value, since later ranks are larger: long documents stop after one or two steps.

Classes that agree in a band are candidates. They are never listed as pairs. Round one ties each class to one other class
of its buckets and verifies that; the components of these links settle most buckets. Round two takes the buckets that
still hold several components and compares whole sets of all members outside a bucket's main component with all members
of their buckets: members lie in blocks of bounded bytes, each in one block, with an inverted list of their shingles, and
the others pass by in a stream. Every candidate pair between components is so decided on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import _text
from pointloom.operators.components import components
from pointloom.plans.storage import materialize

#: 36 bands of 6 places: a pair at the threshold 0.8 agrees in none with probability (1 - 0.8 ** 6) ** 36 < 2e-5.
BANDS, ROWS = 36, 6
#: Bytes of shingles that the members of one block in round two have, about.
BLOCK = 4 << 20
#: Elements whose permutations are held at once.
HELD = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(h: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash of each document's distinct element hashes h[first[i]:first[i + 1]]: rank << 32 | fraction a place."""
    sig = np.full((len(first) - 1, places), _NONE)
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + HELD, side="right")) - 1)
        sig[a:b] = _signatures(h[first[a] : first[b]], np.diff(first[a : b + 1]), places)
        a = b
    return sig


def _signatures(h: np.ndarray, sizes: np.ndarray, places: int) -> np.ndarray:
    sig = np.full((len(sizes), places), _NONE)
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    perm = None
    low = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for j in range(places):
            u = _text.mix64(h + np.uint64(j + 1) * _STEP)
            k = ((u & low) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64) + j
            if perm is None:
                at = k
            else:
                line = np.arange(len(h))
                at = perm[line, k].astype(np.int64)
                perm[line, k] = perm[line, j]
            np.minimum.at(flat, row * places + at, (np.uint64(j) << np.uint64(32)) | (u >> np.uint64(32)))
            open_ = (sig == _NONE).any(axis=1)
            live = open_[row]
            if not live.any():
                break
            if perm is None:
                h, row, k = h[live], row[live], k[live]
                perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(h), 1))
                perm[np.arange(len(h)), k] = 0
            elif live.mean() < 0.7:
                h, row, perm = h[live], row[live], perm[live]
    return sig


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band, in which the band's number counts."""
    s = sig[:, : n_bands * rows].reshape(len(sig), n_bands, rows)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), s.shape[:2]) * _STEP
        for k in range(rows):
            acc = _text.mix64(acc * np.uint64(3) + s[:, :, k])
    return acc


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes by document, where each document's begin, words, the 128-bit digest of the whole word sequence in two parts)."""
    starts, ends, first = _text.words(buf, off)
    w = _text.span_hashes(buf, starts, ends, fold=True)
    n_words = np.diff(first)
    of = _text.owner(first)
    keys = _text.digests(w, first)
    with np.errstate(over="ignore"):
        h = _text.window_hashes(w, k)
        ok = np.flatnonzero(_text.window_starts(first, k)[: len(h)]) if len(h) else np.zeros(0, np.int64)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        h = np.concatenate((h[ok], _text.mix64(keys[0, short] ^ _STEP)))
        of = np.concatenate((of[ok], short)).astype(np.uint64)
        packed = of << np.uint64(44) | h >> np.uint64(20)
        order = np.argsort(packed) if len(n_words) < 1 << 20 else np.lexsort((h, of))
        same_packed = packed[order][1:] == packed[order][:-1]
        if (same_packed & (h[order][1:] != h[order][:-1])).any():
            order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(n_words) + 1, dtype=np.uint64)), n_words, keys[0], keys[1]


def features(rows: DataFrame, k: int, n_bands: int, band_rows: int) -> DataFrame:
    """(doc, text) -> (doc, n_shingles, n_words, k1, k2, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, off, a, n in _text.chunks(batch.column(0), batch.column(1)):
                h, first, n_words, k1, k2 = shingles(buf, off, k)
                b = bands(signatures(h, first, n_bands * band_rows), n_bands, band_rows).view(np.int64)
                size = np.diff(first)
                places = np.concatenate(([0], np.cumsum(np.where(size > 0, n_bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(places, pa.array(b[size > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(size.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists], names=["doc", "n_shingles", "n_words", "k1", "k2", "bands"])

    return rows.mapInArrow(run, "doc long, n_shingles long, n_words long, k1 long, k2 long, bands array<long>")


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """(doc, text) -> (doc, shingles): the sorted distinct shingle hashes as a blob of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, off, a, n in _text.chunks(batch.column(0), batch.column(1)):
                h, first, *_ = shingles(buf, off, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array([np.sort(h[x:y]).tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc", "shingles"])

    return rows.mapInArrow(run, "doc long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    a, b = (sets.select(F.col("doc").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b")).select("u", "v", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                s = np.sort(np.concatenate((p, q)))
                common = int((s[1:] == s[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


class Block:
    """Members whose common shingles with others are counted through an inverted list."""

    def __init__(self, doc: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]):
        self.doc, self.comp = doc, comp
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.of = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]
        h = h[order]
        self.low = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        self.values, self.counts = h[self.low], np.diff(np.append(self.low, len(h)))

    def links(self, comp: int, own: np.ndarray, percent: int) -> list[int]:
        """Members that a set is linked with, one for each other component."""
        if not len(self.values):
            return []
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        n = self.counts[at]
        flat = np.arange(int(n.sum())) + np.repeat(self.low[at] - np.cumsum(n) + n, n)
        common = np.bincount(self.of[flat], minlength=len(self.doc))
        hit = np.flatnonzero((100 * common >= percent * (self.size + len(own) - common)) & (self.comp != comp))
        return self.doc[hit[np.unique(self.comp[hit], return_index=True)[1]]].tolist()


def compare_block(part: pd.DataFrame, percent: int) -> tuple[list[int], list[int]]:
    """Links between the queries of a block and all its members: at least one for each pair of components that has any."""
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
    block = Block(part["doc"].to_numpy(), part["comp"].to_numpy(), sets)
    u, v = [], []
    for q in np.flatnonzero(part["query"].to_numpy(dtype=bool)):
        found = block.links(int(block.comp[q]), sets[q], percent)
        u += [int(block.doc[q])] * len(found)
        v += found
    return u, v


def _heads(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(u, v): each class with the class of its buckets that it shares most bands with, as far as it meets it.

    A bucket of n classes is cut into about sqrt(n) parts by class hash; members meet their part's smallest class, and those
    meet the bucket's smallest. So no class is compared with more than about sqrt(n) others.
    """
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")) / 2)).cast("long")
    m = members.join(buckets, members["h"] == buckets["bh"]).select("h", "doc", "lo", F.pmod(F.xxhash64("doc"), parts).alias("part"))
    head = m.groupBy("h", "part").agg(F.min("doc").alias("head")).select(F.col("h").alias("hh"), F.col("part").alias("hp"), "head")
    to = F.when(F.col("doc") == F.col("head"), F.col("lo")).otherwise(F.col("head"))
    met = m.join(head, (F.col("h") == F.col("hh")) & (F.col("part") == F.col("hp"))).select("doc", to.alias("to")).where("doc <> to")
    best = met.groupBy("doc", "to").count().groupBy("doc").agg(F.max(F.struct("count", (-F.col("to")).alias("to"))).alias("b"))
    return best.select(F.col("doc").alias("u"), (-F.col("b.to")).alias("v"))


def _left_over(members: DataFrame, comps: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components that still meet in a bucket."""
    m = members.join(comps, F.col("doc") == F.col("id"), "left").select("h", "doc", F.coalesce("comp", "doc").alias("comp"))
    m = materialize(m, "near-members")
    main = m.groupBy("h", "comp").count().groupBy("h").agg(F.max(F.struct("count", (-F.col("comp")).alias("comp"))).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    main = materialize(main.select(F.col("h").alias("mh"), (-F.col("b.comp")).alias("main")), "near-mixed")
    m = materialize(m.join(main, F.col("h") == F.col("mh")).select("h", "doc", "comp", "main"), "near-open")
    q = materialize(m.where("comp <> main").groupBy(F.col("doc").alias("qdoc")).agg(F.min("main").alias("qlabel")), "near-queries")
    touched = m.where("comp <> main").join(q, F.col("doc") == F.col("qdoc")).select(F.col("qlabel").alias("label"), F.col("h").alias("th")).distinct()
    base = touched.join(m, F.col("th") == F.col("h")).select("label", "doc", "comp").distinct()
    base = materialize(base.join(sizes, F.col("doc") == F.col("zdoc")).select("label", "doc", "comp", "n_shingles"), "near-blocks")
    cut = materialize(base.groupBy(F.col("label").alias("clabel")).agg(F.ceil(F.sum("n_shingles") * 8 / F.lit(BLOCK)).cast("long").alias("cuts")), "near-cuts")
    base = base.join(cut, F.col("label") == F.col("clabel")).join(q, (F.col("doc") == F.col("qdoc")) & (F.col("label") == F.col("qlabel")), "left")
    # each member lies in one block, and in block order comes before the queries, which pass by all blocks of their label
    member = F.array(F.struct(F.pmod(F.xxhash64("doc"), F.col("cuts")).alias("cut"), F.lit(False).alias("query")))
    ask = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda c: F.struct(c.alias("cut"), F.lit(True).alias("query")))
    base = base.select("label", "doc", "comp", F.inline(F.when(F.col("qdoc").isNotNull(), F.concat(member, ask)).otherwise(member)))
    full = base.join(sets.withColumnRenamed("doc", "sdoc"), F.col("doc") == F.col("sdoc")).select("label", "cut", "query", "doc", "comp", "shingles")
    full = full.repartition("label", "cut").sortWithinPartitions("label", "cut", "query", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, block = None, [], None
        for batch in batches:
            u, v = [], []
            for label, at, query, doc, comp, own in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if of != (label, at):
                    of, held, block = (label, at), [], None
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if not query:
                    held.append((doc, comp, own.copy()))
                    continue
                if block is None:
                    block, held = Block(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), [x[2] for x in held]), []
                found = block.links(comp, own, percent)
                u += [doc] * len(found)
                v += found
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return full.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, n_bands: int = BANDS, band_rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (it is that id).

    Words are split at ASCII white space and A-Z lower-cased; a document's set holds its distinct k-word shingles, with
    fewer words the whole sequence as one. Two documents are linked if 100 * intersection >= percent * union, decided on the
    full sets. Documents without words are linked with nothing. Ids are whole numbers; rows that share an id share their
    links; a row with a null id takes no part in links, has a null component and is kept. An empty table gives no rows.
    Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    feats = materialize(features(rows, k, n_bands, band_rows), "near-features")
    own = feats.where("n_words > 0 and doc is not null")
    copies = own.groupBy("k1", "k2", "n_words").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).where("rep < top")
    copies = materialize(copies.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n_words").alias("cn"), "rep"), "near-copies")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_words") == F.col("cn"))
    classed = own.join(copies, same, "left").withColumn("rep", F.coalesce("rep", "doc"))
    spread = classed.where("doc = rep").select("doc", F.explode("bands").alias("h"))
    buckets = spread.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    buckets = materialize(buckets.select(F.col("h").alias("bh"), "lo", "n"), "near-buckets")
    members = materialize(spread.join(buckets.select("bh"), F.col("h") == F.col("bh"), "left_semi").distinct(), "near-collided")
    needed = materialize(members.select(F.col("doc").alias("need")).distinct(), "near-needed")
    sets = materialize(full_sets(rows.join(needed.hint("shuffle_hash"), F.col("doc") == F.col("need"), "left_semi"), k), "near-sets")
    links = materialize(verify(_heads(members, buckets), sets, percent), "near-links")
    sizes = classed.where("doc = rep").groupBy(F.col("doc").alias("zdoc")).agg(F.max("n_shingles").alias("n_shingles"))
    more = materialize(_left_over(members, components(links), sets, sizes, percent), "near-more")
    comps = materialize(components(links.unionByName(more)), "near-components").select(F.col("id").alias("rid"), "comp")
    out = feats.where("n_words = 0 or doc is null").withColumn("rep", F.col("doc")).select("doc", "n_shingles", "rep").unionByName(classed.select("doc", "n_shingles", "rep"))
    out = out.join(comps, F.col("rep") == F.col("rid"), "left")
    comp = F.coalesce("comp", "rep")
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc") == comp, F.lit(True)).alias("kept"))
