"""PLY and XYZ round trips."""

import math
import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

from pointloom.plans import pipeline, queries, storage
from pointloom.sources import ply, ply_splits, xyz

HEAD = "ply\nformat {} 1.0\ncomment made by hand\nobj_info none\nelement vertex 3\nproperty float x\nproperty double y\nproperty short z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement thing 2\nproperty list uchar int parts\nelement face 2\nproperty list uchar uint {}\nend_header\n"
V = [(0.5, 1.25, -3, 1, 2, 255), (1.0, -2.5, 4, 0, 0, 0), (3.5, 0.0, 7, 9, 8, 7)]
THINGS = [[1, 2, 3], []]
FACES = [[0, 1, 2], [2, 1, 0, 4294967295]]


def body(encoding):
    if encoding == "ascii":
        lines = [" ".join(map(str, v)) for v in V] + [" ".join(map(str, [len(t), *t])) for t in THINGS + FACES]
        return ("\n".join(lines) + "\n").encode()
    o = {"binary_little_endian": "<", "binary_big_endian": ">"}[encoding]
    out = b"".join(struct.pack(o + "fdhBBB", *v) for v in V)
    out += b"".join(struct.pack(f"{o}B{len(t)}i", len(t), *t) for t in THINGS)
    return out + b"".join(struct.pack(f"{o}B{len(t)}I", len(t), *t) for t in FACES)


@pytest.mark.parametrize("encoding", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("index", ["vertex_indices", "vertex_index"])
def test_all_encodings(spark, tmp_path, encoding, index):
    path = tmp_path / "a.ply"
    path.write_bytes(HEAD.format(encoding, index).encode() + body(encoding))
    pts, faces = ply.load_mesh(spark, str(path))
    assert [tuple(r) for r in pts.orderBy("id").collect()] == [(i, *map(float, v[:3]), *v[3:]) for i, v in enumerate(V)]
    assert [r["vertex_indices"] for r in faces.orderBy("face_id").collect()] == FACES
    assert [r["parts"] for r in ply.load(spark, str(path), "thing").orderBy("id").collect()] == THINGS
    assert ply.load(spark, str(path), columns=["z"]).columns == ["id", "z"]


@pytest.mark.parametrize("bad", [b"", b"plx\n", HEAD.format("ascii", "vertex_indices").encode()[:-4], HEAD.format("odd", "vertex_indices").encode(), HEAD.format("ascii", "q").replace("float", "quad").encode()])
def test_bad_headers_raise(bad):
    with pytest.raises(ValueError):
        ply.parse_header(bad)


@pytest.mark.parametrize("row", ["nan 0 0", "inf 0 0", "1 2", "1 0x 3"])
def test_bad_ascii_rows_raise(spark, tmp_path, row):
    path = tmp_path / "b.ply"
    path.write_text(f"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n{row}\n")
    with pytest.raises(Exception, match="Python"):
        ply.load(spark, str(path)).collect()


def test_splits_and_empty(spark, tmp_path, monkeypatch):
    p = spark.range(1000).selectExpr("id", "id / 2.0D as x", "-id as y", "0.25D as z")
    path = str(tmp_path / "c.ply")
    ply.write_mesh(path, p)
    monkeypatch.setattr(ply, "ROWS_A_PARTITION", 300)
    assert len(ply.Reader(path, "vertex", None).partitions()) == 4
    got = ply.load(spark, path).orderBy("id").collect()
    assert [(r["id"], r["x"], r["y"]) for r in got] == [(i, i / 2, -i) for i in range(1000)]
    ply.write_mesh(path, p.limit(0))
    assert ply.load(spark, path).count() == 0
    assert [f.name for f in tmp_path.iterdir()] == ["c.ply"]


@pytest.mark.parametrize("rows", [0, 1000])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_folders_above_a_file_are_made(spark, tmp_path, rows, scheme):
    path = f"{scheme}{tmp_path}/not/there/c.ply"
    p = spark.range(rows).selectExpr("id", "id / 2.0D as x", "-id as y", "0.25D as z")
    ply.write_mesh(path, p)
    assert ply.load_mesh(spark, path)[0].count() == rows
    assert [f.name for f in (tmp_path / "not/there").iterdir()] == ["c.ply"]


@pytest.mark.parametrize("name", ["ply_in_memory", "ply_roundtrip", "ply_faces_roundtrip"])
def test_queries_on_files_come_first_in_a_shared_folder(spark, sf_dir, tmp_path, monkeypatch, name):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
@pytest.mark.parametrize("name", ["ply_in_memory", "ply_roundtrip", "ply_faces_roundtrip"])
def test_queries_on_files_take_every_spelling_of_a_shared_folder(spark, sf_dir, tmp_path, monkeypatch, scheme, name):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"{scheme}{tmp_path}/sha red%20%")
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    assert [f.name for f in tmp_path.iterdir()] == ["sha red%20%"]


@pytest.mark.parametrize("pieces", [1, 4])
@pytest.mark.parametrize("name", ["ply_in_memory", "ply_roundtrip"])
def test_queries_on_files_of_odd_points(spark, tmp_path, pieces, name):
    """Null ids come last, as in the SQL; what a vector lacks is null, which is no NaN."""
    odd = [(None, [7.0, 8.0, 9.0]), (-1, None), (-2, [0.5]), (-3, [None, 0.25, math.inf]), (-4, [math.nan, 1.0, -0.0]), (-5, [])]
    rows = odd + [(i, [i / 8, 0.5, 1.0]) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", pieces == 1)
    try:
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    full = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    want = [(i, *((v or []) + [None] * 3)[:3]) for i, (_, v) in enumerate(full)]
    assert list(map(repr, got)) == [repr(tuple(x if x is None or k == 0 else x + 0.0 for k, x in enumerate(w))) for w in want]


def test_mesh_round_trip_and_smoothing(spark, tmp_path):
    path, out = str(tmp_path / "m.ply"), str(tmp_path / "o.ply")
    p = spark.range(9).selectExpr("id", "cast(id % 3 as double) as x", "cast(id div 3 as double) as y", "cast(id * id % 5 as double) as z", "1.0D as nx", "0.0D as ny", "0.0D as nz", "cast(id as short) as red", "cast(2 as short) as green", "cast(255 as short) as blue")
    quads = spark.createDataFrame([(k, [a, a + 1, a + 4, a + 3]) for k, a in enumerate((0, 1, 3, 4))], "face_id long, vertex_indices array<long>")
    ply.write_mesh(path, p, quads)
    back, faces = ply.load_mesh(spark, path)
    assert back.orderBy("id").collect() == p.orderBy("id").collect()
    assert faces.orderBy("face_id").collect() == quads.orderBy("face_id").collect()
    pipeline.main([path, "8", "1", "1e-8", "1", "--output", out])
    moved, same = ply.load_mesh(spark, out)
    assert same.count() == 4
    assert moved.where("nx = 1").count() == 9
    assert moved.select("z").exceptAll(p.select("z")).count() > 0


def test_xyz_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0.5, -1.25, 3.0, 0.0, 0.0, 1.0)], "x double, y double, z double, nx double, ny double, nz double")
    xyz.write_xyz(p, str(tmp_path / "t"))
    assert xyz.read_xyz(spark, str(tmp_path / "t"), normals=True).collect() == p.collect()
    (tmp_path / "u").write_text("  1\t2   3 \n\n4 5\n")
    assert sorted(map(tuple, xyz.read_xyz(spark, str(tmp_path / "u")).collect())) == [(1.0, 2.0, 3.0), (4.0, 5.0, None)]


# ---- folders, filters, splits


def texts(header, rows, sep):
    return (header + sep.join(" ".join(map(str, r)) for r in rows) + "\n").encode()


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("encoding", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_lists_in_splits_equal_one_reading(spark, tmp_path, encoding, seed):
    """Rows of all lengths, some of none; words of a text run over its lines at random."""
    r, o = random.Random(seed), {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[encoding]
    front = [(r.randrange(-99, 99), r.random()) for _ in range(20)]
    faces = [([r.randrange(70000) for _ in range(r.choice((0, 1, 3, 3, 3, 4, 40)))], r.randrange(256), [r.randrange(-5, 5) for _ in range(r.randrange(3))]) for _ in range(400)]
    head = f"ply\nformat {encoding} 1.0\nelement vertex 20\nproperty short a\nproperty double b\nelement face 400\nproperty list uchar uint vertex_indices\nproperty uchar c\nproperty list uchar char d\nelement edge 1\nproperty int e\nend_header\n"
    path = tmp_path / "lists.ply"
    if encoding == "ascii":
        words = [w for v in front for w in v] + [w for v, c, d in faces for w in (len(v), *v, c, len(d), *d)] + [7]
        path.write_bytes(head.encode() + "".join(f"{w}{r.choice((' ', ' ', ' ', chr(10), '  ', chr(13) + chr(10)))}" for w in words).encode())
    else:
        data = b"".join(struct.pack(o + "hd", *v) for v in front) + b"".join(struct.pack(f"{o}B{len(v)}I", len(v), *v) + struct.pack("B", c) + struct.pack(f"B{len(d)}b", len(d), *d) for v, c, d in faces)
        path.write_bytes(head.encode() + data + struct.pack(o + "i", 7))
    for split in (200, 1000, 1 << 20):
        df = ply.load(spark, str(path), "face", split=split)
        got = df.orderBy("id").collect()
        assert [(x["id"], x["vertex_indices"], x["c"], x["d"]) for x in got] == [(i, *f) for i, f in enumerate(faces)]
        assert split > 1000 or df.rdd.getNumPartitions() > 3
    if encoding == "ascii":
        assert [(x["a"], x["b"]) for x in ply.load(spark, str(path), split=64).orderBy("id").collect()] == front
        assert [x["d"] for x in ply.load(spark, str(path), "face", ["d"], split=300).orderBy("id").collect()] == [f[2] for f in faces]


@pytest.mark.parametrize("row", ["nan 0 0", "inf 0 0", "1 2", "1 0x 3", "1_0 2 3"])
def test_bad_text_raises_in_splits_too(spark, tmp_path, row):
    path = tmp_path / "b.ply"
    path.write_text("ply\nformat ascii 1.0\nelement vertex 30\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + "1 2 3\n" * 29 + row + "\n")
    with pytest.raises(Exception, match="number|early|Python"):
        ply.load(spark, str(path), split=40).collect()


def test_ways_meet():
    step = lambda i: i + (3 if i % 2 else 4)
    ends, rows = ply_splits.ways(step, range(6), 50)
    for s in range(6):
        i, n = s, 0
        while i < 50:
            i, n = step(i), n + 1
        assert (ends[s], rows[s]) == (i, n)
    assert ply_splits.ways(lambda i: -1 if i > 4 else i + 2, range(2), 9)[0].tolist() == [-1, -1]


def test_written_in_tasks_and_read_as_a_folder(spark, tmp_path, monkeypatch):
    ply.register(spark)
    rows = [(i, i / 3, float(i) if i % 5 else None, [i, i + 1] * (i % 3), i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "n int, x double, f float, l array<int>, c tinyint").repartition(4)
    at = f"file://{tmp_path}/out"
    df.write.format("ply").option("element", "thing").mode("append").save(at)
    back = ply.load(spark, at, "thing")
    assert back.columns == ["id", "n", "x", "f", "l", "c", "file"]
    assert sorted(tuple(r)[1:6] for r in back.collect()) == [(a, b, None if c is None else c, d, e) for a, b, c, d, e in rows]
    df.where("n < 5").write.format("ply").option("element", "thing").mode("append").save(at)
    assert ply.load(spark, at, "thing").count() == 505
    df.where("n < 7").write.format("ply").option("element", "thing").mode("overwrite").save(at)
    assert ply.load(spark, at, "thing").count() == 7
    df.limit(0).write.format("ply").option("element", "thing").mode("overwrite").save(at)
    assert ply.load(spark, at, "thing").collect() == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    ply.register(spark)
    at = tmp_path / "failed"
    bad = spark.range(100).selectExpr("cast(if(id = 99, null, id) as int) as n").repartition(4)
    with pytest.raises(Exception, match="null"):
        bad.write.format("ply").mode("append").save(str(at))
    assert not at.exists() or os.listdir(at) == []
    with pytest.raises(Exception, match="cannot hold"):
        spark.range(3).write.format("ply").mode("append").save(str(at))


def test_filters_leave_out_files_and_ranges(spark, tmp_path, monkeypatch):
    ply.register(spark)
    for k in range(4):
        ply.write_mesh(str(tmp_path / f"part{k}.ply"), spark.range(1000).selectExpr("id", f"{k} + id / 1000D as x", "0D as y", "0D as z"))
    (tmp_path / "part9.txt").write_text("no file of this kind")
    chosen = ply.Reader(f"{tmp_path}/part[12].ply", "vertex", ["x"])
    assert [os.path.basename(f) for f, _ in chosen.files] == ["part1.ply", "part2.ply"]
    monkeypatch.setattr(ply, "ROWS_A_PARTITION", 100)
    one = ply.Reader(f"{tmp_path}/part1.ply", "vertex", None)
    assert len(one.partitions()) == 10
    left = list(one.pushFilters([GreaterThanOrEqual(("id",), 250), LessThan(("id",), 420), GreaterThan(("x",), 0.0)]))
    assert left == [GreaterThan(("x",), 0.0)]
    assert [(r.start, r.rows) for p in one.partitions() for r in p.ranges] == [(250, 100), (350, 70)]
    many = ply.Reader(str(tmp_path), "vertex", None)
    assert list(many.pushFilters([EqualTo(("file",), f"{tmp_path}/part2.ply"), In(("id",), (5, 7))])) == [In(("id",), (5, 7))]
    assert [os.path.basename(r.path) for p in many.partitions() for r in p.ranges] == ["part2.ply"]
    got = ply.load(spark, str(tmp_path)).where(F.col("file").endswith("part3.ply") & F.col("id").isin(5, 7)).collect()
    assert sorted((r["id"], round(r["x"], 3)) for r in got) == [(5, 3.005), (7, 3.007)]
    plan = ply.load(spark, f"{tmp_path}/part1.ply").where("id = 900")
    assert plan.rdd.getNumPartitions() == 1 and [r["id"] for r in plan.collect()] == [900]
    with pytest.raises(Exception, match="no PLY files|nothing here"):
        ply.load(spark, f"{tmp_path}/none*.ply")


def test_meshes_that_cannot_be_written(spark, tmp_path):
    path = str(tmp_path / "m.ply")
    p = lambda ids: spark.createDataFrame([(i, 0.5, 1.0, 2.0) for i in ids], "id long, x double, y double, z double").repartition(2)
    f = lambda *lists: spark.createDataFrame(list(enumerate(lists)), "face_id long, vertex_indices array<long>")
    for points, faces, why in ((p([10, 20, 30]), f([10, 20, 30]), "without gaps"), (p(range(3)), f([0, 1, 3]), "none of 3"), (p(range(3)), f([0, -1, 2]), "none of 3"), (p(range(3)), f(None), "without corners"), (p([0, 1, 1]), f([0, 1, 1]), "without gaps")):
        with pytest.raises(Exception, match=why):
            ply.write_mesh(path, points, faces)
        assert os.listdir(tmp_path) == []
    ply.write_mesh(path, p(range(400)), f(list(range(300)), [0, 1, 2]))
    assert [r["vertex_indices"] for r in ply.load_mesh(spark, path)[1].orderBy("face_id").collect()] == [list(range(300)), [0, 1, 2]]
    assert os.listdir(tmp_path) == ["m.ply"]
