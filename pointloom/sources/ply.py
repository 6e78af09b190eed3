"""PLY files: header, all three encodings, any elements and properties; a Spark data source and a mesh writer."""

from __future__ import annotations

import fnmatch
import functools
import io
import itertools
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format: names of scalar types -> numpy code, Spark type.
TYPES = {
    **dict.fromkeys(("char", "int8"), ("i1", T.ByteType())),
    **dict.fromkeys(("uchar", "uint8"), ("u1", T.ShortType())),
    **dict.fromkeys(("short", "int16"), ("i2", T.ShortType())),
    **dict.fromkeys(("ushort", "uint16"), ("u2", T.IntegerType())),
    **dict.fromkeys(("int", "int32"), ("i4", T.IntegerType())),
    **dict.fromkeys(("uint", "uint32"), ("u4", T.LongType())),
    **dict.fromkeys(("float", "float32"), ("f4", T.FloatType())),
    **dict.fromkeys(("double", "float64"), ("f8", T.DoubleType())),
}
#: Spellings of the columns with a meaning, preferred first.
FINDERS = {
    "position": (("x", "y", "z"),),
    "normal": (("nx", "ny", "nz"),),
    "texture": (("u", "v"), ("s", "t"), ("texture_u", "texture_v"), ("texture_s", "texture_t")),
    "colour": (("red", "green", "blue"), ("r", "g", "b")),
    "indices": (("vertex_indices",), ("vertex_index",)),
}
ORDER = {"binary_little_endian": "<", "binary_big_endian": ">"}
ROWS_A_PARTITION = 4_000_000
#: Files of a folder are read together up to this many bytes; larger ones are split. Bytes of a written part, about.
TOGETHER, PART = 64 << 20, 64 << 20
HEADER_MOST = 1 << 20
#: Bits of the NaN that stands for null in a binary file's floats, which have no other place for it (the payload R gives NA).
NULL = 0x7FC007A2


@dataclass
class Property:
    name: str
    kind: str
    count_kind: str | None = None

    def spark(self) -> T.DataType:
        t = TYPES[self.kind][1]
        return T.ArrayType(t, False) if self.count_kind else t


@dataclass
class Element:
    name: str
    count: int
    properties: list[Property] = field(default_factory=list)

    @property
    def fixed(self) -> bool:
        return all(p.count_kind is None for p in self.properties)

    def dtype(self, order: str) -> np.dtype:
        return np.dtype([(p.name, order + TYPES[p.kind][0]) for p in self.properties])

    def find(self, meaning: str) -> tuple[str, ...] | None:
        """The columns with a meaning: the first spelling of which all are there."""
        names = {p.name for p in self.properties}
        return next((x for x in FINDERS[meaning] if names.issuperset(x)), None)


@dataclass
class Header:
    encoding: str
    elements: list[Element]
    size: int

    def element(self, name: str) -> Element:
        for e in self.elements:
            if e.name == name:
                return e
        raise ValueError(f"no element {name!r}; there are {[e.name for e in self.elements]}")


def parse_header(data: bytes) -> Header:
    """Raises ValueError where the header breaks the format."""
    m = re.search(rb"(?m)^end_header[ \t]*\r?\n", data)
    if not re.match(rb"ply[ \t]*\r?\n", data) or not m:
        raise ValueError("not a PLY file, or its header does not end")
    encoding, elements = None, []
    for line in data[: m.start()].decode("latin-1").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format" and len(word) == 3:
            if word[1] not in ("ascii", *ORDER):
                raise ValueError(f"unknown encoding {word[1]!r}")
            encoding = word[1]
        elif word[0] == "element" and len(word) == 3 and word[2].isdigit():
            elements.append(Element(word[1], int(word[2])))
        elif word[0] == "property" and elements and len(word) == 3 and word[1] in TYPES:
            elements[-1].properties.append(Property(word[2], word[1]))
        elif word[0] == "property" and elements and len(word) == 5 and word[1] == "list" and word[2] in TYPES and word[3] in TYPES:
            elements[-1].properties.append(Property(word[4], word[3], word[2]))
        else:
            raise ValueError(f"header line {line!r}")
    if encoding is None:
        raise ValueError("the header names no encoding")
    return Header(encoding, elements, m.end())


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Local files in every spelling that Spark takes: file:/a, file:///a and /a, with blanks and per cent signs as they are."""
    if local := re.match(r"file:(?://)?(?=/)", path):
        return pafs.LocalFileSystem(), path[local.end() :]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _create(path: str) -> pa.NativeFile:
    """A file to write, with the folders above it: the shared folder has none until someone makes them."""
    fs, at = _open(path)
    if "/" in at.rstrip("/"):
        fs.create_dir(at.rstrip("/").rpartition("/")[0] or "/", recursive=True)
    return fs.open_output_stream(at, compression=None)


def read_header(path: str) -> Header:
    fs, at = _open(path)
    with fs.open_input_stream(at, compression=None) as f:
        return parse_header(f.read(HEADER_MOST))


def _walk(read, e: Element, order: str) -> list[dict]:
    """Rows of an element with lists, one value after the other."""
    out = []
    one = {p.name: struct.Struct(order + _code(p.kind)) for p in e.properties}
    count = {p.name: struct.Struct(order + _code(p.count_kind)) for p in e.properties if p.count_kind}
    for _ in range(e.count):
        row = {}
        for p in e.properties:
            if p.count_kind:
                (n,) = count[p.name].unpack(read(count[p.name].size))
                dt = np.dtype(order + TYPES[p.kind][0])
                row[p.name] = np.frombuffer(read(int(n) * dt.itemsize), dt).tolist()
            else:
                (row[p.name],) = one[p.name].unpack(read(one[p.name].size))
        out.append(row)
    return out


def _code(kind: str) -> str:
    return {"i1": "b", "u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I", "f4": "f", "f8": "d"}[TYPES[kind][0]]


def _scalar(token: str, kind: str):
    if TYPES[kind][0][0] == "f":
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", token):
            raise ValueError(f"{token!r} is no number")
        return float(token)
    if not re.fullmatch(r"[+-]?\d{1,10}", token):
        raise ValueError(f"{token!r} is no whole number of at most ten digits")
    v, info = int(token), np.iinfo(TYPES[kind][0])
    if not info.min <= v <= info.max:
        raise ValueError(f"{v} does not fit {kind}")
    return v


def _ascii_rows(tokens: Iterator[str], e: Element) -> Iterator[dict]:
    try:
        for _ in range(e.count):
            row = {}
            for p in e.properties:
                if p.count_kind:
                    row[p.name] = [_scalar(next(tokens), p.kind) for _ in range(_scalar(next(tokens), p.count_kind))]
                else:
                    row[p.name] = _scalar(next(tokens), p.kind)
            yield row
    except StopIteration:
        raise ValueError(f"element {e.name!r} ends early") from None


def arrow_schema(e: Element, names: list[str]) -> pa.Schema:
    kinds = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}
    out = [pa.field("id", pa.int64(), False)]
    for p in e.properties:
        if p.name in names:
            t = kinds[type(TYPES[p.kind][1])]
            out.append(pa.field(p.name, pa.list_(t) if p.count_kind else t))
    return pa.schema(out)


@dataclass
class Range(InputPartition):
    start: int
    rows: int
    lengths: tuple[int, ...] | None = None
    path: str = ""


@dataclass
class Parts(InputPartition):
    """Ranges of files that one task reads; a range without rows is a whole file that planning did not look into."""

    ranges: list[Range]


def _exactly(f, n: int, e: Element) -> bytes:
    raw = f.read(n)
    if len(raw) != n:
        raise ValueError(f"element {e.name!r} ends early")
    return raw


def _laid(e: Element, order: str, lengths: tuple[int, ...]) -> np.dtype:
    """One row of an element whose lists have these lengths: each list's count, then its entries."""
    out, lens = [], iter(lengths)
    for p in e.properties:
        if p.count_kind:
            out += [(f"n {p.name}", order + TYPES[p.count_kind][0]), (p.name, order + TYPES[p.kind][0], (next(lens),))]
        else:
            out.append((p.name, order + TYPES[p.kind][0]))
    return np.dtype(out)


def _first_lengths(f, e: Element, order: str) -> tuple[int, ...]:
    """The lengths of the lists in the row at which f stands; f stands there again afterwards."""
    at = f.tell()
    one = Element(e.name, min(e.count, 1), e.properties)
    rows = _walk(lambda n: _exactly(f, n, e), one, order)
    f.seek(at)
    return tuple(len(rows[0][p.name]) if rows else 0 for p in e.properties if p.count_kind)


def _skip(f, x: Element, order: str) -> None:
    if x.fixed:
        f.seek(f.tell() + x.count * x.dtype(order).itemsize)
    else:
        _walk(lambda n: _exactly(f, n, x), x, order)


def _column(v: np.ndarray, kind: pa.DataType) -> pa.Array:
    v = np.ascontiguousarray(v.astype(v.dtype.newbyteorder("=")))
    if v.ndim == 1:
        return pa.array(v, mask=v.view(np.uint32) == NULL if v.dtype == np.float32 else None).cast(kind)
    return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.reshape(-1)).cast(kind.value_type))


def _read(f, header: Header, e: Element, names: list[str], part: Range) -> Iterator[pa.RecordBatch]:
    """Rows of an element from an open file."""
    schema, before = arrow_schema(e, names), header.elements[: header.elements.index(e)]
    f.seek(header.size)
    if header.encoding == "ascii":
        tokens = (t for line in io.TextIOWrapper(f, "latin-1") for t in line.split())  # an element may begin within a line
        for x in before:
            for _ in _ascii_rows(tokens, x):
                pass
        rows, at = _ascii_rows(tokens, e), 0
        while some := list(itertools.islice(rows, 1 << 16)):
            yield _batch(some, schema, at)
            at += len(some)
        return
    order = ORDER[header.encoding]
    for x in before:
        _skip(f, x, order)
    if part.lengths is None and not e.fixed:
        yield from _walked(f, e, order, schema, 0, e.count)
        return
    dt, begin = _laid(e, order, part.lengths or ()), f.tell()
    f.seek(begin + part.start * dt.itemsize)
    for a in range(part.start, part.start + part.rows, 1 << 18):
        n = min(1 << 18, part.start + part.rows - a)
        rows = np.frombuffer(_exactly(f, n * dt.itemsize, e), dt)
        lists = [p for p in e.properties if p.count_kind]
        if any((rows[f"n {p.name}"] != x).any() for p, x in zip(lists, part.lengths or (), strict=True)):
            f.seek(begin)  # lists of other lengths after all: the rest of this part is found by walking
            yield from _walked(f, e, order, schema, a, part.start + part.rows)
            return
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *(_column(rows[p.name], schema.field(p.name).type) for p in e.properties if p.name in names)], schema=schema)


def _walked(f, e: Element, order: str, schema: pa.Schema, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows start to end, value by value from the element's beginning, at which f stands."""
    for a in range(0, end, 1 << 16):
        some = _walk(lambda n: _exactly(f, n, e), Element(e.name, min(1 << 16, end - a), e.properties), order)
        if a + len(some) > start:
            yield _batch(some[max(0, start - a) :], schema, max(a, start))


def _batch(rows: list[dict], schema: pa.Schema, first: int) -> pa.RecordBatch:
    def column(n: str) -> pa.Array:
        t, v = schema.field(n).type, [r[n] for r in rows]
        return _column(np.array(v, np.float32), t) if t == pa.float32() else pa.array(v, t)  # which knows the NaN for null

    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(rows)), pa.int64()), *(column(n) for n in schema.names[1:])], schema=schema)


def files(path: str) -> tuple[list[tuple[str, int]], bool]:
    """(path, bytes) of the file, of the .ply files of the folder or of those that a pattern names, and whether it is one file."""
    fs, at = _open(path)
    here = lambda name: path[: len(path) - len(at)] + name if path.endswith(at) else name
    folder, _, pattern = at.rpartition("/")
    if re.search(r"[*?\[]", pattern):
        found = [x for x in fs.get_file_info(pafs.FileSelector(folder or "/")) if x.is_file and fnmatch.fnmatch(x.base_name, pattern)]
    else:
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            return [(path, info.size)], True
        found = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and x.extension == "ply"]
    found = sorted((here(x.path), x.size) for x in found if not x.base_name.startswith(("_", ".")))
    if not found:
        raise ValueError(f"no PLY files: {path}")
    return found, False


class Reader(DataSourceReader):
    """One element of one or more files of the same kind. Filters on id and file leave out files and rows where they are planned."""

    def __init__(self, path: str, element: str, columns: list[str] | None, chosen: list[tuple[str, int]] | None = None):
        found, self.single = files(path) if chosen is None else (chosen, False)
        self.files, self.header = found, read_header(found[0][0])
        self.element = self.header.element(element)
        self.names = [p.name for p in self.element.properties if columns is None or p.name in columns]
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of id are kept exactly, a choice of files too; of a choice of ids the range between the ends."""
        for f in filters:
            at, v = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("file",) and not self.single and isinstance(f, EqualTo | In):
                self.files = [x for x in self.files if x[0] in ((v,) if isinstance(f, EqualTo) else v)]
            elif at == ("id",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and v not in (None, ()):
                some = [x for x in v if x is not None] if isinstance(f, In) else [v]
                if isinstance(f, In):
                    yield f
                if not some:
                    continue
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, min(some) + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = max(some) + (not isinstance(f, LessThan))
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def _ranges(self, path: str, header: Header, size: int) -> list[Range]:
        """Rows of equal width behind elements of equal width can be found by their number and are split; others are read in one go.

        Lists are taken to have all the length that the first row's have where the file's size says so; each part holds
        its own counts against that.
        """
        e = header.element(self.element.name)
        at, order = header.elements.index(e), ORDER.get(header.encoding)
        low, high = min(self.low, e.count), e.count if self.high is None else max(0, min(e.count, self.high))
        if order is None or not all(x.fixed for x in header.elements[:at]):
            return [Range(0, e.count, None, path)]
        lengths: tuple[int, ...] | None = ()
        if not e.fixed:
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                f.seek(header.size)
                for x in header.elements[:at]:
                    _skip(f, x, order)
                begin, lengths = f.tell(), _first_lengths(f, e, order)
                after = sum(x.count * x.dtype(order).itemsize for x in header.elements[at + 1 :] if x.fixed)
                if not all(x.fixed for x in header.elements[at + 1 :]) or begin + e.count * _laid(e, order, lengths).itemsize + after != size:
                    return [Range(0, e.count, None, path)]
        return [Range(a, min(ROWS_A_PARTITION, high - a), lengths, path) for a in range(low, max(high, low), ROWS_A_PARTITION)]

    def partitions(self) -> list[Parts]:
        """Large files by ranges of rows; small ones, into which only tasks look, together."""
        out, held, size = [], [], 0
        for k, (path, n) in enumerate(sorted(self.files, key=lambda x: (-x[1], x[0]))):
            if self.single or n > TOGETHER // 4:
                head = self.header if path == self.files[0][0] and k == 0 else read_header(path)
                out += [Parts([r]) for r in self._ranges(path, head, n)]
                continue
            held.append(Range(0, -1, None, path))
            size += n
            if size >= TOGETHER:
                out.append(Parts(held))
                held, size = [], 0
        return [*out, *([Parts(held)] if held else [])] or [Parts([])]

    def read(self, part: Parts) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            fs, at = _open(r.path)
            with fs.open_input_file(at) as f:
                head = parse_header(f.read(HEADER_MOST))
                e = head.element(self.element.name)
                if arrow_schema(e, self.names) != arrow_schema(self.element, self.names):
                    raise ValueError(f"{r.path}: element {e.name!r} has other columns than in {self.files[0][0]}")
                for one in [r] if r.rows >= 0 else self._ranges(r.path, head, f.size()):
                    for rows in _read(f, head, e, self.names, one):
                        if (self.low or self.high is not None) and one.lengths is None:
                            ids = rows.column(0).to_numpy()
                            rows = rows.filter(pa.array((ids >= self.low) & (ids < (self.high if self.high is not None else len(ids) + ids[:1].sum()))))
                        if not self.single:
                            rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array([r.path] * rows.num_rows, pa.string())], names=[*rows.schema.names, "file"])
                        yield rows


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Tasks write complete files of about PART bytes into a folder beside; only when all are done, a commit moves them in."""

    def __init__(self, path: str, element: str, schema: T.StructType, overwrite: bool):
        kinds = {T.ByteType: "char", T.ShortType: "short", T.IntegerType: "int", T.FloatType: "float", T.DoubleType: "double"}
        self.path, self.overwrite, self.tag, self.properties = path, overwrite, uuid.uuid4().hex, []
        for f in schema.fields:
            t = f.dataType
            if type(t) in kinds:
                self.properties.append(Property(f.name, kinds[type(t)]))
            elif isinstance(t, T.ArrayType) and (type(t.elementType) in kinds or isinstance(t.elementType, T.LongType)):
                self.properties.append(Property(f.name, kinds.get(type(t.elementType), "uint"), "uint"))
            else:
                raise ValueError(f"a PLY file cannot hold column {f.name!r} of type {t.simpleString()}")
            if not re.fullmatch(r"\S+", f.name):
                raise ValueError(f"a PLY file cannot hold a column named {f.name!r}")
        self.element = element

    def _bytes(self, batch: pa.RecordBatch) -> bytes:
        fixed = all(p.count_kind is None for p in self.properties)
        cols = [_stored(c, p) for c, p in zip(batch.columns, self.properties, strict=True)]
        if fixed:
            out = np.empty(batch.num_rows, [(str(k), c.dtype) for k, c in enumerate(cols)])
            for k, c in enumerate(cols):
                out[str(k)] = c
            return out.tobytes()
        lists = [c if isinstance(c, tuple) else None for c in cols]
        return b"".join(b"".join(struct.pack("<I", x[1][i + 1] - x[1][i]) + x[0][x[1][i] : x[1][i + 1]].tobytes() if x is not None else c[i : i + 1].tobytes() for c, x in zip(cols, lists, strict=True)) for i in range(batch.num_rows))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, held, size, rows = [], [], 0, 0

        def out() -> None:
            head = ["ply", "format binary_little_endian 1.0", f"element {self.element} {rows}"]
            head += [f"property {'list uint ' if p.count_kind else ''}{p.kind} {p.name}" for p in self.properties]
            names.append(f"part-{uuid.uuid4().hex}.ply")
            with _create(f"{self.path}/_{self.tag}/{names[-1]}") as f:
                f.write(("\n".join([*head, "end_header"]) + "\n").encode())
                for x in held:
                    f.write(x)

        for b in iterator:
            if not b.num_rows:
                continue
            held.append(self._bytes(b))
            size, rows = size + len(held[-1]), rows + b.num_rows
            if size >= PART:
                out()
                held, size, rows = [], 0, 0
        if held:
            out()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        before = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file] if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.names]
        if not names:  # a table without rows has its columns
            names = self.write(iter(())).names or self._empty()
        for n in names:
            fs.move(f"{at}/_{self.tag}/{n}", f"{at}/{n}")
        for x in before:
            fs.delete_file(x.path)
        self._clear(fs, at)

    def _empty(self) -> list[str]:
        head = ["ply", "format binary_little_endian 1.0", f"element {self.element} 0", *(f"property {'list uint ' if p.count_kind else ''}{p.kind} {p.name}" for p in self.properties), "end_header", ""]
        with _create(f"{self.path}/_{self.tag}/part-{self.tag}.ply") as f:
            f.write("\n".join(head).encode())
        return [f"part-{self.tag}.ply"]

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, fs: pafs.FileSystem, at: str) -> None:
        if fs.get_file_info(f"{at}/_{self.tag}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_{self.tag}")


def _stored(col: pa.Array, p: Property):
    """A column's numbers as they stand in a file, or (numbers, offsets) of lists; a null float is the NaN for it, others raise."""
    if p.count_kind:
        if col.null_count or col.flatten().null_count:
            raise ValueError(f"a PLY file cannot hold a null list or entry: {p.name!r}")
        off = col.offsets.to_numpy() - col.offsets[0].as_py()
        return _fits(col.flatten().to_numpy(), p), off
    if col.null_count and p.kind != "float":
        raise ValueError(f"a PLY file cannot hold a null {p.kind}: {p.name!r}")
    v = _fits(col.fill_null(0).to_numpy(zero_copy_only=False), p)
    if col.null_count:
        v = v.copy()
        v[col.is_null().to_numpy(zero_copy_only=False)] = np.array(NULL, "<u4").view("<f4")
    return v


def _fits(v: np.ndarray, p: Property) -> np.ndarray:
    code = TYPES[p.kind][0]
    if code[0] != "f" and len(v) and (v.min() < np.iinfo(code).min or v.max() > np.iinfo(code).max):
        raise ValueError(f"{p.name!r} holds a number that does not fit {p.kind}")
    return v.astype("<" + code)


class PlyDataSource(DataSource):
    """spark.read.format("ply").option("element", "face").load(path): one element's rows, numbered by id in each file.

    path: a file, a folder of .ply files or a pattern of names; of the latter two rows also have their file. Options:
    element (vertex if absent), columns (comma-separated names to read; all if absent). df.write.format("ply") writes a
    folder of files with df's columns: numbers and lists of numbers; appended to, or replaced with mode("overwrite").
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _reader(self) -> Reader:
        cols, chosen = self.options.get("columns"), self.options.get("chosen")
        return Reader(self.options["path"], self.options.get("element", "vertex"), cols.split(",") if cols else None, [tuple(x) for x in json.loads(chosen)] if chosen else None)

    def schema(self) -> T.StructType:
        r = self._reader()
        file = [] if r.single else [T.StructField("file", T.StringType(), False)]
        return T.StructType([T.StructField("id", T.LongType(), False), *[T.StructField(p.name, p.spark()) for p in r.element.properties if p.name in r.names], *file])

    def reader(self, schema: T.StructType) -> Reader:
        return self._reader()

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), self.options.get("element", "vertex"), schema, overwrite)


def register(spark: SparkSession) -> None:
    """format("ply") for a session, with filters that reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlyDataSource)


def load(spark: SparkSession, path: str, element: str = "vertex", columns: list[str] | None = None, split: int | None = None) -> DataFrame:
    """One element of the file, folder or pattern of files at path.

    Text files and lists of several lengths beyond split bytes are read in splits too, where their rows can be found so.
    """
    from pointloom.sources import ply_splits

    register(spark)
    found, single = files(path)
    parts, split = [], ply_splits.SPLIT if split is None else split
    for name, size in found:
        if size > split:
            head = read_header(name)
            e = head.element(element)
            if (head.encoding == "ascii" or not e.fixed) and ply_splits.can_split(head, e):
                names = [p.name for p in e.properties if columns is None or p.name in columns]
                if head.encoding == "ascii" or len(Reader(name, element, columns)._ranges(name, head, size)) == 1:
                    parts.append((name, size, ply_splits.plan(name, head, e, names, size, split)))
    r = spark.read.format("ply").option("element", element)
    r = r.option("columns", ",".join(columns)) if columns else r
    if not parts:
        return r.load(path)
    rest = [x for x in found if x[0] not in {name for name, _, _ in parts}]
    out = [r.option("chosen", json.dumps(rest)).load(path)] if rest else []
    for name, _, p in parts:
        rows = ply_splits.load(spark, p)
        out.append(rows if single else rows.withColumn("file", F.lit(name)))
    return functools.reduce(DataFrame.unionByName, out)


def load_bytes(files: DataFrame, schema: str, element: str = "vertex", content: str = "content") -> DataFrame:
    """One element's rows (file, id and the columns of schema) of PLY files that are held in a binary column.

    schema: the columns to read, as DDL, which all files have. files: path (string) and the content, as the reader
    "binaryFile" gives them. A null content has no rows; one that breaks the format fails the job with its path.
    """
    fields = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    header = parse_header(data.as_buffer()[:HEADER_MOST].to_pybytes())
                    e = header.element(element)
                    for rows in _read(io.BytesIO(data.as_buffer()), header, e, fields, Range(0, e.count, () if e.fixed else None)):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * rows.num_rows, pa.string()), rows.column("id"), *(rows.column(n) for n in fields)], names=["file", "id", *fields])
                except ValueError as why:
                    raise ValueError(f"{path}: {why}") from why

    return files.select("path", content).mapInArrow(run, f"file string, id long, {schema}")


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(vertices, polygons): id, x, y, z and where present nx, ny, nz, u, v, red, green, blue; face_id, vertex_indices, or None."""
    head = read_header(path)
    v = head.element("vertex")
    pos, normal, texture, colour = (v.find(m) for m in ("position", "normal", "texture", "colour"))
    if pos is None:
        raise ValueError("the vertices have no position")
    names = [*zip(pos, "xyz", strict=True), *zip(normal or (), ("nx", "ny", "nz")), *zip(texture or (), ("u", "v")), *zip(colour or (), ("red", "green", "blue"))]
    points = load(spark, path, "vertex", [a for a, _ in names])
    points = points.select("id", *[F.col(a).cast("short" if b in ("red", "green", "blue") else "double").alias(b) for a, b in names])
    face = next((e for e in head.elements if e.name == "face" and e.find("indices")), None)
    if face is None:
        return points, None
    (name,) = face.find("indices")
    return points, load(spark, path, "face", [name]).select(F.col("id").alias("face_id"), F.col(name).cast("array<long>").alias("vertex_indices"))


def write_mesh(path: str, points: DataFrame, polygons: DataFrame | None = None) -> None:
    """One binary little-endian file: float positions, normals if there are nx, ny, nz, uchar colours if there are red, green, blue.

    Tasks write the rows of contiguous id ranges as pieces in a folder beside the target; only their places, sizes and counts
    come to the driver, which joins the pieces byte by byte behind the header and renames the whole. Whatever fails, the
    folder goes and an earlier target stays. Vertices are stored in the order of id. Faces refer to places in it: with faces,
    ids that do not run from 0 without gaps, corners that are no vertex and null lists raise. Without faces rows of a null
    id come last. A null position or normal is stored as a NaN that the readers here give back as null. For a table of any
    size in parts, without the joining, see format("ply").
    """
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue") if c in points.columns]
    dtype = np.dtype([(c, "u1" if c in ("red", "green", "blue") else "<f4") for c in names])
    place, schema, by_id, meshed = f"{path}.{uuid.uuid4().hex}", "first long, rows long, piece string, gap boolean", F.asc_nulls_last("id"), polygons is not None

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _piece(batches, place, "v", lambda b: _packed(b, names, dtype))

    def written(df: DataFrame, pack) -> list:
        return sorted(df.mapInArrow(pack, schema).collect(), key=lambda r: (r["first"] is None, r["first"]))  # a row a task

    fs, at = _open(path)
    try:
        pieces = written(points.select("id", *names).repartitionByRange(by_id).sortWithinPartitions(by_id), vertices)
        n = sum(r["rows"] for r in pieces)
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"]
        head += [f"property {'uchar' if c in ('red', 'green', 'blue') else 'float'} {c}" for c in names]
        if meshed:
            starts = itertools.accumulate((r["rows"] for r in pieces), initial=0)
            if any(r["gap"] or r["first"] != k for r, k in zip(pieces, starts, strict=False)):
                raise ValueError("faces need vertices with ids from 0 on, without gaps")
            long = (polygons.agg(F.max(F.size("vertex_indices")).alias("n")).first()["n"] or 0) > 255

            def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from _piece(batches, place, "f", lambda b: _corners(b.column(1), n, long))

            got = written(polygons.select("face_id", "vertex_indices").repartitionByRange("face_id").sortWithinPartitions("face_id"), faces)
            head += [f"element face {sum(r['rows'] for r in got)}", f"property list {'uint' if long else 'uchar'} uint vertex_indices"]
            pieces += got
        whole = f"{place}/whole"
        with _create(whole) as out:
            out.write(("\n".join([*head, "end_header"]) + "\n").encode())
            for r in pieces:
                with fs.open_input_stream(_open(r["piece"])[1], compression=None) as f:
                    while chunk := f.read(1 << 24):
                        out.write(chunk)
        fs.move(_open(whole)[1], at)
    finally:
        if fs.get_file_info(_open(place)[1]).type != pafs.FileType.NotFound:
            fs.delete_dir(_open(place)[1])


def _corners(lists: pa.Array, n: int, long: bool) -> bytes:
    """Counts and corners of polygons over n vertices, all of a batch at once."""
    flat = lists.flatten()
    if lists.null_count or flat.null_count:
        raise ValueError("a face without corners, or a corner that is null")
    v, size = flat.to_numpy(), np.diff(lists.offsets.to_numpy())
    if len(v) and (v.min() < 0 or v.max() >= n):
        raise ValueError(f"a face has a corner that is none of {n} vertices")
    head = 4 if long else 1
    starts = np.cumsum(head + 4 * size) - head - 4 * size
    out = np.zeros(int((head + 4 * size).sum()), np.uint8)
    out[starts[:, None] + np.arange(head)] = size.astype("<u4" if long else "u1").view(np.uint8).reshape(-1, head)
    own = np.repeat(starts + head - 4 * (np.cumsum(size) - size), size) + 4 * np.arange(len(v))
    out[own[:, None] + np.arange(4)] = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def _packed(batch: pa.RecordBatch, names: list[str], dtype: np.dtype) -> bytes:
    out = np.empty(batch.num_rows, dtype)
    for k, c in enumerate(names):
        v = batch.column(k + 1)
        out[c] = v.to_numpy(zero_copy_only=False)
        if v.null_count and dtype[c] == np.float32:
            out[c][v.is_null().to_numpy(zero_copy_only=False)] = np.array(NULL, "<u4").view("<f4")
    return out.tobytes()


def _piece(batches, place: str, kind: str, pack) -> Iterator[pa.RecordBatch]:
    first, last, rows, gap, name, out = None, None, 0, False, f"{place}/{kind}{uuid.uuid4().hex}", None
    for b in batches:
        if not b.num_rows:
            continue
        if out is None:
            first, out = b.column(0)[0].as_py(), _create(name)
        ids = b.column(0)
        gap = gap or ids.null_count > 0 or bool((np.diff(ids.to_numpy(), prepend=ids[0].as_py() - 1 if last is None else last) != 1).any())
        last = ids[-1].as_py()
        out.write(pack(b))
        rows += b.num_rows
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"first": [first], "rows": [rows], "piece": [name], "gap": [gap]}, schema=pa.schema([("first", pa.int64()), ("rows", pa.int64()), ("piece", pa.string()), ("gap", pa.bool_())]))
