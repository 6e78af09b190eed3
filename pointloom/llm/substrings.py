"""Substring dedup: windows of words that start earlier elsewhere, found behind a count-min prefilter.

Pass 1 sketches. Of the anchors (runs of ANCHOR words) in a window the one with the smallest hash stands for it, so equal
windows have equal anchors, and an anchor stands for several windows in a row. Each task counts its anchors in a sketch; the
sketches are merged by shards. Counters stop at two, more is not asked. A sketch has as many counters as the input asks for,
up to CELLS; where that is not enough the anchors are divided by their hash into ranges, each with a sketch of its own, and
pass 2 goes over the texts once a range. So no worker holds more than one range's sketch, and its load stays below LOAD.
Pass 2 groups exactly. A window whose anchor the merged sketch estimates at one cannot repeat, since a sketch never counts
too little; all others are grouped by a 96-bit hash of their words. Each task first keeps the earliest place of each of
its own windows, so a passage that a third of all documents share is one entry a task, not one a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import _text
from pointloom.plans.storage import materialize

WINDOW, ANCHOR = 20, 10
#: Counters of two bits in each of a sketch's two rows at most; the bits that pass 2 looks at are 64 MB then.
CELLS = 1 << 28
#: Anchors a counter at most, as long as RANGES ranges are enough; bytes of text an anchor, as measured on prose.
LOAD, ANCHOR_BYTES, RANGES = 0.75, 32, 16
SHARDS = 64
#: Bytes of windows that one group of the exact step gets, about.
GROUP = 32 << 20
#: Windows that a task holds before it passes their earliest places on.
HELD = 1 << 20
#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max
#: A window's place: 96 bits of hash, document, first word.
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("at", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("at", "<i4")])


def _anchors(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, the place of each one's anchor, hashes of all anchors). h: word hashes of many documents."""
    a = _text.window_hashes(h, anchor)
    starts = np.flatnonzero(_text.window_starts(first, window)) if len(h) >= window else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, a
    span = window - anchor + 1
    best, width = np.arange(len(a)), 1
    while width * 2 <= span:
        p, q = best[:-width], best[width:]
        best, width = np.where(a[q] < a[p], q, p), width * 2
    if width < span:
        shift = span - width
        p, q = best[:-shift], best[shift:]
        best = np.where(a[q] < a[p], q, p)
    return starts, best[starts], a


def _cells(v: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each value in the sketch's two rows."""
    mask = np.uint64(cells - 1)
    return (v & mask).astype(np.int64), ((v >> np.uint64(32)) & mask).astype(np.int64)


def _bit(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _count(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters above zero and above one, from the cells of some values."""
    u, n = np.unique(cell, return_counts=True)
    return u, u[n > 1]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for buf, off, a, n in _text.chunks(batch.column(0), batch.column(1)):
            starts, ends, first = _text.words(buf, off)
            yield batch.column(0).slice(a, n), first, _text.span_hashes(buf, starts, ends)


def plan(size: int, cells: int | None = None) -> tuple[int, int]:
    """(counters a row, ranges) for so many bytes of text: a power of two each; cells: the counters at most."""
    anchors, most = size / ANCHOR_BYTES / LOAD, cells or CELLS
    fits = min(most, max(1 << 12, 1 << max(0, int(anchors)).bit_length()))
    return fits, 1 if cells else min(RANGES, 1 << max(0, int(anchors) // most).bit_length())


def _range(v: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each anchor, by its highest bits; counters go by others."""
    return (v >> np.uint64(60)).astype(np.int64) % ranges


def sketches(rows: DataFrame, window: int, anchor: int, cells: int, ranges: int = 1) -> DataFrame:
    """(shard, deal, row, ones, twos): the merged sketches of all anchors, a row a shard of each range and row; bitmaps of the
    counters above zero and above one. Shards of range r are those from r * SHARDS on."""
    per = cells // SHARDS
    deals = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    layout = pa.schema([("shard", pa.int32()), ("deal", pa.int32()), ("row", pa.int32()), ("ones", pa.binary()), ("twos", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            v = np.concatenate(found)
            found.clear()
            of = _range(v, ranges)
            deal = int(v[0] % np.uint64(deals))
            for g in range(ranges):
                cols: dict[str, list] = {k: [] for k in layout.names}
                for r, c in enumerate(_cells(v[of == g] if ranges > 1 else v, cells)):
                    ones, twos = _count(c)
                    for s in range(SHARDS):
                        o, t = (x[slice(*np.searchsorted(x, [s * per, (s + 1) * per]))] - s * per for x in (ones, twos))
                        if len(o):
                            for k, x in zip(layout.names, (g * SHARDS + s, deal, r, _sparse(o, per), _sparse(t, per)), strict=True):
                                cols[k].append(x)
                yield pa.RecordBatch.from_pydict(cols, schema=layout)

        held = 0
        for _, first, h in _words_of(batches):
            starts, at, a = _anchors(h, first, window, anchor)
            if len(starts):
                found.append(a[at[np.append(True, at[1:] != at[:-1])]])
                held += len(found[-1])
            if held >= HELD:
                yield from flush()
                held = 0
        if found:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for s, _, r, ones, twos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = planes.setdefault((s, r), np.zeros((2, per // 8), np.uint8))
                new1, new2 = _dense(ones, per), _dense(twos, per)
                own[1] |= new2 | (own[0] & new1)
                own[0] |= new1
        for (s, r), own in sorted(planes.items()):
            yield pa.RecordBatch.from_pydict(dict(zip(layout.names, ([s], [0], [r], *([_sparse(np.flatnonzero(np.unpackbits(x, bitorder="little")), per)] for x in own)), strict=True)), schema=layout)

    schema = "shard int, deal int, row int, ones binary, twos binary"
    parts = rows.mapInArrow(count, schema)
    if deals > 1:  # as many tasks as there are partitions merge first, so the last tasks read at most deals planes a shard
        parts = parts.repartition(SHARDS * ranges * deals, "shard", "deal").mapInArrow(merge, schema)
    return parts.repartition(SHARDS * ranges, "shard").mapInArrow(merge, schema)


def _planes(merged: DataFrame, cells: int, columns: tuple[str, ...]) -> np.ndarray:
    """planes[row, column, byte] of one range's shards: CELLS bits for each row and column, which is all that comes to the driver."""
    per = cells // SHARDS
    planes = np.zeros((2, len(columns), cells // 8), np.uint8)
    for x in merged.select("shard", "row", *columns).collect():
        at = x["shard"] % SHARDS * (per // 8)
        for k, c in enumerate(columns):
            planes[x["row"], k, at : at + per // 8] = _dense(x[c], per)
    return planes


def sketch(rows: DataFrame, window: int, anchor: int, cells: int) -> np.ndarray:
    """The merged sketch of all anchors: planes[row, above zero or above one, byte], bit-packed."""
    return _planes(sketches(rows, window, anchor, cells), cells, ("ones", "twos"))


def _sparse(at: np.ndarray, per: int) -> bytes:
    """Sorted cells as 32-bit numbers behind a 0 byte, or as a bitmap behind a 1 where that is shorter."""
    if len(at) * 4 <= per // 8:
        return b"\0" + at.astype("<u4").tobytes()
    bits = np.zeros(per, np.uint8)
    bits[at] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def _dense(blob: bytes, per: int) -> np.ndarray:
    if blob[0]:
        return np.frombuffer(blob, np.uint8, offset=1)
    at = np.frombuffer(blob, "<u4", offset=1).astype(np.int64)
    out = np.zeros(per // 8, np.uint8)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _earliest(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest entry of each window, the entries that start later)."""
    e = e[np.lexsort((e["at"], e["doc"], e["h2"], e["h1"]))]
    new = np.append(True, (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])) if len(e) else np.zeros(0, bool)
    lead = e[new][np.cumsum(new) - 1] if len(e) else e
    return e[new], e[(e["doc"] != lead["doc"]) | (e["at"] != lead["at"])]


def _columns(e: np.ndarray) -> bytes:
    """Entries column by column and ordered by document, as the shuffle's compression likes them."""
    e = e[np.lexsort((e["at"], e["doc"]))]
    return b"".join(np.ascontiguousarray(e[c]).tobytes() for c in e.dtype.names)


def _entries(blobs: Iterable[bytes], dtype: np.dtype) -> np.ndarray:
    out = [np.empty(0, dtype)]
    for blob in blobs:
        n, at = len(blob) // dtype.itemsize, 0
        e = np.empty(n, dtype)
        for c in dtype.names:
            e[c] = np.frombuffer(blob, dtype[c], n, at)
            at += n * dtype[c].itemsize
        out.append(e)
    return np.concatenate(out)


def _dealt(e: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Entries packed by key: (keys, blobs)."""
    if not len(e):
        return np.zeros(0, np.int64), []
    order = np.argsort(key, kind="stable")
    e, key = e[order], key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[cut].astype(np.int64), [_columns(x) for x in np.split(e, cut[1:])]


def _places(later: np.ndarray, deals: int) -> tuple[np.ndarray, list[bytes]]:
    """The places of entries, dealt out by document."""
    p = np.empty(len(later), PLACE)
    p["doc"], p["at"] = later["doc"], later["at"]
    with np.errstate(over="ignore"):
        return _dealt(p, _text.mix64(p["doc"].astype(np.uint64)) % np.uint64(deals))


def repeats(rows: DataFrame, above: np.ndarray, window: int, anchor: int, cells: int, deals: int, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(doc, starts): a row for each document with windows whose words also start earlier, their 32-bit starts as a blob.

    above: the sketch's bits above one, by row; part: the range that it is for, and the number of ranges. Windows are dealt
    to groups by hash, and what they find out is dealt on by document. Both go in packed rows, one for each pair of task
    and group, so the number of rows does not depend on how a document's windows are spread.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(above)
    schema = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), ("blob", pa.binary())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = shared.value
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            lead, later = _earliest(np.concatenate(held))
            held.clear()
            a, blobs = _dealt(lead, (lead["h1"] >> np.uint64(32)) % np.uint64(deals))
            b, settled = _places(later, deals)
            return pa.RecordBatch.from_arrays([pa.array(np.append(a, b)), pa.array(np.arange(len(a) + len(b)) >= len(a)), pa.array([*blobs, *settled], pa.binary())], schema=schema)

        n = 0
        for ids, first, h in _words_of(batches):
            starts, at, a = _anchors(h, first, window, anchor)
            if not len(starts):
                continue
            if part[1] > 1:
                own = _range(a[at], part[1]) == part[0]
                starts, at = starts[own], at[own]
            c1, c2 = _cells(a[at], cells)
            s = starts[(_bit(above[0], c1) & _bit(above[1], c2)).astype(bool)]
            if not len(s):
                continue
            e = np.empty(len(s), ENTRY)
            e["h1"], e["h2"] = _text.window_hashes(h, window)[s], _text.window_hashes(h, window, 1)[s] >> np.uint64(32)
            of = _text.owner(first)[s]
            e["doc"] = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)[of]
            e["at"] = s - first[of]
            held.append(e)
            n += len(e)
            if n >= HELD:
                yield flush()
                n = 0
        if held:
            yield flush()

    def group(part: pd.DataFrame) -> pd.DataFrame:
        settled = part["settled"].to_numpy(bool)
        _, later = _earliest(_entries(part["blob"][~settled], ENTRY))
        deal, blobs = _places(later, deals)
        return pd.DataFrame({"deal": np.append(deal, part["bucket"][settled]).astype(np.int64), "blob": [*blobs, *part["blob"][settled]]})

    def by_doc(part: pd.DataFrame) -> pd.DataFrame:
        p = _entries(part["blob"], PLACE)
        p = p[np.lexsort((p["at"], p["doc"]))]
        cut = np.flatnonzero(np.append(True, p["doc"][1:] != p["doc"][:-1])) if len(p) else np.zeros(0, np.int64)
        return pd.DataFrame({"doc": p["doc"][cut].astype(np.int64), "starts": [x.tobytes() for x in np.split(np.ascontiguousarray(p["at"]), cut[1:])] if len(cut) else []})

    # what a task could settle itself travels along, so the candidates are made once and kept nowhere but in the shuffle
    found = rows.mapInArrow(candidates, "bucket long, settled boolean, blob binary")
    dealt = found.groupBy("bucket").applyInPandas(group, "deal long, blob binary")
    return dealt.groupBy("deal").applyInPandas(by_doc, "doc long, starts binary")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of the document covers it whose words also start earlier: in a smaller id, or before in the
    same document. Windows are judged on the input. Ids are whole numbers; a null id comes after all others. Rows with
    equal ids count as one document: a window at the same start in both is not earlier than itself, so exact repeats of a
    row stay whole. A null text has no words; an empty table gives no rows. Other columns are not looked at.
    cells: the counters of the only sketch, at most; if absent, what the bytes of all texts ask for.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor lies within a window")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    cells, ranges = plan(size, cells)
    deals = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * 1.5 / ranges / GROUP))  # up to 24 bytes a window
    merged = materialize(sketches(rows, window, anchor, cells, ranges), "substrings-sketch")
    found = []
    for r in range(ranges):
        above = _planes(merged.where(F.floor(F.col("shard") / SHARDS) == r), cells, ("twos",))[:, 0]
        found.append(repeats(rows, above, window, anchor, cells, deals, (r, ranges)))
        if ranges > 1:  # one range's sketch at a time
            found[-1] = materialize(found[-1], "substrings-range")
    goes = reduce(DataFrame.unionByName, found)
    if ranges > 1:
        goes = goes.groupBy("doc").agg(F.unhex(F.array_join(F.collect_list(F.hex("starts")), "")).alias("starts"))
    goes = goes.withColumnRenamed("doc", "of")
    both = rows.join(goes.hint("shuffle_hash"), F.coalesce("doc", F.lit(int(NO_ID))) == F.col("of"), "left").select("doc", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if not starts.is_valid:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + window + 1, np.int32)
                at = np.unique(np.frombuffer(starts.as_py(), "<i4"))
                at = at[at + window <= len(words)]
                edge[at] += 1
                edge[at + window] -= 1
                stay = np.cumsum(edge[: len(words)]) == 0
                n_removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(compress(words, stay.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
