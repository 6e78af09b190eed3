"""Text files, and binary lists of several lengths, read in splits: where rows start is found in a pass of its own.

A text's rows are runs of words, wherever its lines end. Words are counted in each split; a sum over the splits gives the
number of each one's first word, and with it, for rows of equal numbers of words, the first row that starts there. Rows with
lists start where the row before ends, which a split cannot know. So each one follows the rows from every place at which its
first row can start: these ways meet after a few rows, and what is left is a table of few entries, from such a place to the
place in the next split. Chained from the element's beginning, the tables give each split its first row and its number.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.sources import ply

#: Bytes of a split, and splits of a file at most: the tables of more would be much for the driver.
SPLIT, SPLITS = 64 << 20, 2000
#: A list's count in one byte, so that a row's length has a bound.
SHORT = ("i1", "u1")
WORD = re.compile(rb"\S+")


def can_split(header: ply.Header, e: ply.Element) -> bool:
    """Whether an element's rows can be found in splits: rows of equal width before it, and lists of at most 255 entries in it."""
    before = header.elements[: header.elements.index(e)]
    return all(x.fixed for x in before) and all(p.count_kind is None or ply.TYPES[p.count_kind][0] in SHORT for p in e.properties)


@dataclass
class Splits:
    """One element of one file and its splits: bytes a to b of the file's data from `begin` on."""

    path: str
    header: ply.Header
    element: ply.Element
    names: list[str]
    begin: int
    size: int
    step: int

    @property
    def text(self) -> bool:
        return self.header.encoding == "ascii"

    @property
    def longest(self) -> int:
        """Words, or bytes, of the longest row that there can be."""
        out = 0
        for p in self.element.properties:
            item = 1 if self.text else np.dtype(ply.TYPES[p.kind][0]).itemsize
            out += 1 + 255 * item if p.count_kind else item
        return out

    def read(self, k: int, extra: int = 0) -> bytes:
        """The bytes of split k and of so many words, or bytes, behind it; in a text from the first word that starts in it on."""
        a, b = self.begin + k * self.step, min(self.begin + (k + 1) * self.step, self.size)
        fs, at = ply._open(self.path)
        with fs.open_input_file(at) as f:
            f.seek(a - (1 if self.text and k else 0))
            data, tail = f.read(b - f.tell()), b""
            if self.text and k:
                data = data[re.match(rb"\S*", data).end() :]  # a word that began before
            if not self.text:
                return data + f.read(extra)
            if not data or (not extra and data[-1:].isspace()):
                return data
            while (more := f.read(max(1 << 12, len(tail)))) and len(WORD.findall(tail := tail + more)) <= extra + 1:
                pass
            if more:  # the last word may go on
                tail = tail[: max(tail.rfind(x) for x in b" \t\r\n\v\f") + 1] if extra else re.match(rb"\S*", tail).group()
            return data + tail


def _next(s: Splits, data: bytes | list[bytes]) -> Callable[[int], int]:
    """From the place of a row to that of the next, in bytes or words; -1 where there is no row or it goes beyond the data."""
    if s.text:
        lists = [p.count_kind is not None for p in s.element.properties]

        def step(i: int) -> int:
            for is_list in lists:
                if is_list:
                    if i >= len(data) or not data[i].isdigit() or len(data[i]) > 3:
                        return -1
                    i += int(data[i])
                i += 1
            return i

        return step
    sizes = [(p.count_kind is not None, np.dtype(ply.TYPES[p.kind][0]).itemsize) for p in s.element.properties]
    signed = any(p.count_kind and ply.TYPES[p.count_kind][0] == "i1" for p in s.element.properties)

    def step(i: int) -> int:
        for is_list, size in sizes:
            if is_list:
                if i >= len(data) or (signed and data[i] > 127):
                    return -1
                i += 1 + data[i] * size
            else:
                i += size
        return i

    return step


def ways(step: Callable[[int], int], starts: range, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(place behind the last row that starts before end, rows until there) of the way from each start; -1 where it breaks off.

    The way that is furthest behind goes on; ways that meet are one from then on.
    """
    ends, rows = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.int64)
    at = {s: [k] for k, s in enumerate(starts)}
    heap = list(starts)
    while heap:
        i = heapq.heappop(heap)
        mine, n = at.pop(i), 0
        while 0 <= i < end and not (heap and heap[0] <= i):
            j = step(i)
            if j < 0:
                i = -1
                break
            i, n = j, n + 1
        rows[mine] += n
        if 0 <= i < end:
            if i in at:
                at[i] += mine
            else:
                at[i] = mine
                heapq.heappush(heap, i)
        else:
            ends[mine] = i
    return ends, rows


def _values(words: list[bytes], kind: str) -> np.ndarray:
    """Words as numbers of a kind; those that are none raise, as they do where files are read in one go."""
    code = ply.TYPES[kind][0]
    try:
        v = pa.array(words, pa.binary()).cast(pa.string()).cast(pa.float64() if code[0] == "f" else pa.int64()).to_numpy(zero_copy_only=False)
        fine = np.isfinite(v).all() if code[0] == "f" else bool((v >= np.iinfo(code).min).all() and (v <= np.iinfo(code).max).all())
    except (pa.ArrowInvalid, UnicodeDecodeError):
        fine = False
    if not fine:
        v = np.array([ply._scalar(x.decode("latin-1"), kind) for x in words], np.float64 if code[0] == "f" else np.int64)
    return v.astype(code)


def _rows(s: Splits, data: bytes | list[bytes], start: int, rows: int, first: int) -> Iterator[pa.RecordBatch]:
    """rows rows from the place start on, numbered from first, a column at a time."""
    schema, order = ply.arrow_schema(s.element, s.names), "" if s.text else ply.ORDER[s.header.encoding]
    if not s.text:
        data = np.frombuffer(data, np.uint8)
    step, at = _next(s, data if s.text else data.tobytes()), np.zeros(rows, np.int64)
    i = start
    for r in range(rows):
        if i < 0 or i >= len(data):
            raise ValueError(f"{s.path}: element {s.element.name!r} ends early")
        at[r], i = i, step(i)
    if i < 0 or i > len(data):
        raise ValueError(f"{s.path}: element {s.element.name!r} ends early")

    def take(places: np.ndarray, kind: str) -> np.ndarray:
        if s.text:
            return _values([data[x] for x in places.tolist()], kind)
        dt = np.dtype(order + ply.TYPES[kind][0])
        return np.ascontiguousarray(data[places[:, None] + np.arange(dt.itemsize)]).view(dt).ravel()

    cols, where = {}, at
    for p in s.element.properties:
        size = 1 if s.text else np.dtype(ply.TYPES[p.kind][0]).itemsize
        if p.count_kind:
            n = take(where, p.count_kind).astype(np.int64)
            where = where + 1
            if p.name in s.names:
                own = np.repeat(where - (np.cumsum(n) - n) * size, n) + np.arange(int(n.sum())) * size
                flat = take(own, p.kind)
                t = schema.field(p.name).type
                cols[p.name] = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(flat.astype(flat.dtype.newbyteorder("="))).cast(t.value_type))
            where = where + n * size
        else:
            if p.name in s.names:
                cols[p.name] = ply._column(take(where, p.kind), schema.field(p.name).type)
            where = where + size
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), *(cols[n] for n in schema.names[1:])], schema=schema)


def plan(path: str, header: ply.Header, e: ply.Element, names: list[str], size: int, split: int = SPLIT) -> Splits:
    begin = header.size
    if header.encoding != "ascii":
        begin += sum(x.count * x.dtype(ply.ORDER[header.encoding]).itemsize for x in header.elements[: header.elements.index(e)])
    return Splits(path, header, e, names, begin, size, max(split, -(-(size - begin) // SPLITS)))


def load(spark: SparkSession, s: Splits) -> DataFrame:
    """The element's rows (id and its columns): two or three passes over the file, a task a split; a row a split meets the driver."""
    n = max(1, -(-(s.size - s.begin) // s.step))
    e, width = s.element, len(s.element.properties)
    sizes, first = np.full(n, s.step, np.int64), 0
    sizes[-1] = max(0, s.size - s.begin - (n - 1) * s.step)

    def each(f: Callable[[int], tuple], schema: str) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({x.split()[0]: [v] for x, v in zip(schema.split(", "), (k, *f(k)), strict=True)})

        return sorted(spark.range(0, n, 1, n).mapInArrow(run, schema).collect())

    if s.text:
        sizes = np.array([r[1] for r in each(lambda k: (len(WORD.findall(s.read(k))),), "k long, words long")], np.int64)
        first = sum(x.count * len(x.properties) for x in s.header.elements[: s.header.elements.index(e)])
    upto = np.append(0, np.cumsum(sizes))
    starts = np.zeros((n, 3), np.int64)  # place of the first row in the split, its number, rows
    if e.fixed and s.text:
        low = np.clip(-(-(upto - first) // max(width, 1)), 0, e.count) if width else np.zeros(n + 1, np.int64)
        if width and upto[-1] < first + e.count * width:
            raise ValueError(f"{s.path}: element {e.name!r} ends early")
        starts[:, 0], starts[:, 1], starts[:, 2] = first + low[:-1] * width - upto[:-1], low[:-1], np.diff(low)
    else:
        home = int(np.searchsorted(upto, first, side="right")) - 1
        home = min(max(home, 0), n - 1)

        def table(k: int) -> tuple[bytes, bytes]:
            reach = int(sizes[k])
            data = s.read(k, s.longest)
            places = range(first - int(upto[k]), first - int(upto[k]) + 1) if k == home else range(min(s.longest, reach)) if k > home else range(0)
            ends, rows = ways(_next(s, WORD.findall(data) if s.text else data), places, reach)
            return ends.tobytes(), rows.tobytes()

        at, row = first - int(upto[home]), 0
        for k, ends, rows in each(table, "k long, ends binary, rows binary"):
            if k < home or row >= e.count:
                continue
            if at >= sizes[k]:
                at -= int(sizes[k])
                continue
            i = 0 if k == home else at
            end, m = int(np.frombuffer(ends, np.int64)[i]), int(np.frombuffer(rows, np.int64)[i])
            starts[k] = at, row, min(m, e.count - row)
            row += int(starts[k, 2])
            if end < 0 and row < e.count:
                raise ValueError(f"{s.path}: element {e.name!r} breaks off")
            at = end - int(sizes[k])
        if row < e.count:
            raise ValueError(f"{s.path}: element {e.name!r} ends early")
    known = {int(k): tuple(map(int, starts[k])) for k in np.flatnonzero(starts[:, 2])}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                if k not in known:
                    continue
                place, row, rows = known[k]
                data = s.read(k, s.longest)
                yield from _rows(s, WORD.findall(data) if s.text else data, place, rows, row)

    out = ", ".join(["id long", *(f"`{p.name}` {p.spark().simpleString()}" for p in e.properties if p.name in s.names)])
    return spark.range(0, n, 1, n).mapInArrow(parse, out)
