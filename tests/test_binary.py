"""PLY files of all three formats against a plain writer."""

import struct

import pytest
from pyspark.sql import functions as F

from tempora.sources import ply

FIELDS = [("x", "float", "f"), ("y", "double", "d"), ("red", "uchar", "B"), ("n", "int32", "i"), ("u", "ushort", "H"), ("k", "uint", "I")]


def rows(n):
    return [(i / 4, i / 3, i % 256, -i, 65535 - i, 2**32 - 1 - i) for i in range(n)]


def write(path, data, kind, before="", extra=b"", fields=FIELDS):
    head = ["ply", f"format {kind} 1.0", "comment made by hand", *([before] if before else []), f"element vertex {len(data)}"]
    head += [f"property {t} {n}" for n, t, _ in fields] + ["element face 1", "property list uchar int vertex_indices", "end_header"]
    body = b"".join(
        (" ".join(map(repr, r)) + "\n").encode() if kind == "ascii" else struct.pack(("<" if "little" in kind else ">") + "".join(c for *_, c in fields), *r) for r in data
    )
    path.write_bytes(("\n".join(head) + "\n").encode() + extra + body + (b"3 0 1 2\n" if kind == "ascii" else b"\x03" + bytes(12)))


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(ply.PlySource)
    return lambda path, **options: spark.read.format("ply").options(**options).load(str(path))


@pytest.mark.parametrize("kind", ["binary_little_endian", "binary_big_endian", "ascii"])
def test_rows_ranges_and_partitions(source, tmp_path, kind):
    data = rows(1000)
    write(tmp_path / "a.ply", data, kind)
    write(tmp_path / "b.ply", data[:7], kind)
    df = source(f"{tmp_path}/*.ply", rows=90)
    got = sorted(map(tuple, df.collect()))
    want = [(f"{tmp_path}/{name}.ply", i, *r) for name, n in (("a", 1000), ("b", 7)) for i, r in enumerate(data[:n])]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(a - b) < 1e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g[2:], w[2:], strict=True))
    assert df.rdd.getNumPartitions() == (2 if kind == "ascii" else 13)
    assert [c for _, c in df.dtypes] == ["string", "bigint", "float", "double", "smallint", "int", "int", "bigint"]


def test_elements_before_the_vertices(source, tmp_path):
    write(tmp_path / "a.ply", rows(5), "binary_little_endian", "element sensor 2\nproperty float f\nproperty char c", bytes(10))
    assert [r.n for r in source(tmp_path / "a.ply").orderBy("row").collect()] == [0, -1, -2, -3, -4]
    write(tmp_path / "b.ply", rows(5), "ascii", "element sensor 2\nproperty list uchar int f", b"1 2\n0\n")
    assert [r.n for r in source(tmp_path / "b.ply").orderBy("row").collect()] == [0, -1, -2, -3, -4]


def test_round_trip(spark, source, tmp_path):
    df = spark.range(5000).select((F.col("id") / 7).cast("float").alias("x"), (F.col("id") / 3).alias("y"), F.col("id").cast("int").alias("n")).repartition(3)
    df.write.format("ply").mode("append").save(str(tmp_path / "cloud"))
    back = source(tmp_path / "cloud", rows=400)
    assert sorted(map(tuple, back.select("x", "y", "n").collect())) == sorted(map(tuple, df.collect()))
    assert back.select("path").distinct().count() == 3 and back.rdd.getNumPartitions() >= 13


def test_bad_files(source, tmp_path):
    write(tmp_path / "short.ply", rows(50), "binary_little_endian")
    (tmp_path / "short.ply").write_bytes((tmp_path / "short.ply").read_bytes()[:-400])
    (tmp_path / "none.ply").write_bytes(b"not a cloud")
    for name in ("short", "none", "absent"):
        with pytest.raises(Exception):
            source(tmp_path / f"{name}.ply").collect()
    for head in (b"ply\nformat other 1.0\nend_header\n", b"ply\nend_header\n", b"ply\nformat ascii 1.0\nend_header\n",
                 b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list int int x\nend_header\n",
                 b"ply\nformat binary_big_endian 1.0\nelement face 1\nproperty list int int x\nelement vertex 0\nend_header\n"):
        with pytest.raises(ValueError):
            ply.parse_header(head)
    write(tmp_path / "empty.ply", [], "binary_big_endian")
    assert source(tmp_path / "empty.ply").count() == 0


def test_a_large_camera_file_is_read_in_parts(spark, tmp_path):
    """One file gives several parts and partitions with the rows of the whole; bad files raise."""
    from tempora.sources import colmap

    def record(i, points):
        name = ("folder/" * (i % 40) + f"image {i}.jpg").encode() + b"\0"
        keys = struct.pack("<Q", i % 90) + bytes(24 * (i % 90)) if points else b""
        return struct.pack("<I7dI", i, 1.0, 0.1, 0.2, 0.3, i, -i, 0.5, i % 7) + name + keys

    for points in (True, False):
        data = struct.pack("<Q", 700) + b"".join(record(i, points) for i in range(700))
        path = tmp_path / f"{points}.bin"
        path.write_bytes(data)
        (tmp_path / f"none-{points}.bin").write_bytes(struct.pack("<Q", 0))
        want = sorted((str(path), *r) for r in colmap.images(data, points))
        parts = list(colmap.image_parts(str(path), points, 10_000))
        assert len(parts) > 5 and sum(n for *_, n in parts) == 700 and parts[0][0] == 8 and parts[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        got = colmap.read_images(spark, f"{tmp_path}/*{points}.bin", points, 10_000)
        assert sorted(map(tuple, got.collect())) == want
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        for bad in (data[:-5], data + b"x"):
            path.write_bytes(bad)
            with pytest.raises(ValueError):
                list(colmap.image_parts(str(path), points))
            with pytest.raises(Exception):
                colmap.read_images(spark, str(path), points).collect()
