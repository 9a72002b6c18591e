"""Files and nested records."""

import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tempora.functions import strings as st
from tempora.sources import colmap, index, metadata
from tempora.streaming.incremental import date_new_files

CAMERA = struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 11, 1, 1920, 1080, 1500.5, 1490.25, 960.0, 540.0)


def image_file(points):
    out = struct.pack("<Q", 2)
    for i, name in enumerate(("archive/K/pier 9.jpg", "archive/L/ž.jpg")):
        out += struct.pack("<I7dI", i + 1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 11) + name.encode() + b"\0"
        if points:
            out += struct.pack("<Q", i) + b"\7" * 24 * i
    return out


def test_colmap_source(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(CAMERA)
    (tmp_path / "images.bin").write_bytes(image_file(True))
    (tmp_path / "images.minibin").write_bytes(image_file(False))
    spark.dataSource.register(colmap.ColmapSource)
    read = lambda name, **o: spark.read.format("colmap").options(**o).load(str(tmp_path / name))
    cam = read("cameras.bin", kind="cameras").first()
    assert (cam.camera_id, cam.model, cam.width, cam.params) == (11, "PINHOLE", 1920, [1500.5, 1490.25, 960.0, 540.0])
    full, small = read("images.bin"), read("images.minibin", points="false")
    assert [(r.image_id, r.name, r.tz, r.n_points) for r in full.collect()] == [(1, "archive/K/pier 9.jpg", 3.0, 0), (2, "archive/L/ž.jpg", 3.0, 1)]
    assert [r.name for r in small.collect()] == [r.name for r in full.collect()]
    binary = spark.read.format("binaryFile").load(str(tmp_path / "images.bin"))
    assert colmap.parse_files(binary).drop("path").exceptAll(full.drop("path")).count() == 0
    with pytest.raises(Exception):
        read("images.bin", points="false").collect()
    assert read("images.bin", points="false", mode="PERMISSIVE").count() == 0


@pytest.mark.parametrize("data", [struct.pack("<Q", 3), CAMERA + b"x", struct.pack("<Q", 1) + struct.pack("<iiQQ", 1, 99, 1, 1)])
def test_broken_camera_files(data):
    with pytest.raises((ValueError, struct.error)):
        list(colmap.cameras(data))


def test_recon_and_categories(spark, tmp_path):
    (tmp_path / "recon.json").write_text(json.dumps({"31": ["Old Mill", 2, 17, 2300, 8, 95], "44": ["Quay", 1, 6, 41], "52": ["Tower", 0]}))
    rows = index.load_recon_metadata(spark, str(tmp_path / "recon.json")).orderBy("scene_id", "model").collect()
    assert [(r.scene_id, r.scene, r.model, r.n_images, r.n_points) for r in rows] == [(31, "Old Mill", 0, 17, 2300), (31, "Old Mill", 1, 8, 95), (44, "Quay", 0, 6, 41)]
    (tmp_path / "bad.json").write_text(json.dumps({"31": ["Old Mill", 2, 17]}))
    with pytest.raises(Exception, match="sizes"):
        index.load_recon_metadata(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "cat.json").write_text(json.dumps({"Quay": 44, "Tower": 52}))
    assert {r.scene: r.scene_id for r in index.load_categories(spark, str(tmp_path / "cat.json")).collect()} == {"Quay": 44, "Tower": 52}
    (tmp_path / "scenes.txt").write_text("# all\nOld Mill\n\n 44 # the quay\n")
    assert [r.scene for r in index.read_scene_file(spark, str(tmp_path / "scenes.txt")).collect()] == ["Old Mill", "44"]


def page(**ext):
    info = {
        "timestamp": "2010-01-02T03:04:05Z", "width": 8, "height": 6, "url": "u",
        "extmetadata": {k: {"value": v, "source": "commons-desc-page"} for k, v in ext.items()},
        "commonmetadata": [{"name": "Make", "value": "Old"}, {"name": "Make", "value": "Canon"}, {"name": "Other", "value": 1}],
    }
    return {"pageid": 61, "title": "File:Mill weir.jpg", "imageinfo": [info]}


def test_raw_metadata(spark, tmp_path):
    first = page(
        DateTimeOriginal='<i>1777</i>\x01 <div style="display: none;">date QS:P571,+1777&quot;/9</div>',
        Artist='<a title="A painter (c. 1741 – 1799)">S</a>', Categories="A|B|", ObjectName={"de": "x", "en": "Mill &amp; weir", "_type": "lang"},
        ImageDescription="d" * 3000,
    )
    raw = json.dumps({"elements": [{"61": first}, {"62": {"pageid": 62, "title": "File:none"}}]}).replace("\\u0001", "\x01")
    with gzip.open(tmp_path / "raw_metadata.json.gz", "wt") as f:
        f.write(raw)
    (tmp_path / "raw2.json").write_text("not json")
    found = metadata.parse_pages(metadata.read_raw_metadata(spark, str(tmp_path / "*.json*"))).collect()
    assert len(found) == 1
    r = found[0]
    assert (r.title, r.file_key, r.date_qs, r.artist_born, r.artist_died) == ("Mill weir.jpg", "Mill_weir.jpg", 'P571,+1777"/9', 1741, 1799)
    assert r.categories == ["A", "B"] and r.object_name == "Mill & weir" and len(r.description) == 2000 and r.exif == {"Make": "Canon"}
    text = spark.read.text(str(tmp_path / "*.json*"), wholetext=True).withColumn("path", F.input_file_name())
    assert metadata.audit(text).count() == 1


def test_names(spark):
    long = "é" * 100
    names = ["commons/Q/3/Pier 9.jpg", "File:Z\u030Ciz\u030Ckov.jpg", "x*y|z<.png", long]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, s string")
    got = df.select(st.file_key(F.col("s")).alias("k"), st.safe_filename(F.col("s")).alias("f"), st.title_of(F.col("s")).alias("t")).collect()
    assert [r.k for r in got[:2]] == ["Pier_9.jpg", "\u017Di\u017Ekov.jpg"]
    assert got[2].f == "x%2Ay%7Cz%3C.png" and len(got[3].f) == 180 and got[3].f[-13] == "_"
    assert got[0].t == "File:Pier 9.jpg"
    ids = spark.createDataFrame([(42007,), (999,), (1234567,)], "i long").select(st.scene_prefix(F.col("i")).alias("p")).collect()
    assert [r.p for r in ids] == ["042/007", "000/999", "1234/567"]


def test_aliases_with_a_cycle(spark):
    """A cycle ends at the title that is repeated first: at the asked one itself, if it lies on the cycle."""
    asked = spark.createDataFrame([("p",), ("q",), ("in",), ("lost",)], "title string")
    edges = spark.createDataFrame([("p", "o"), ("o", "n"), ("q", "r"), ("r", "s"), ("s", "q"), ("in", "r")], "src string, dst string")
    pages = spark.createDataFrame([("n",), ("q",)], "title string")
    got = {r.title: (r.final, r.found) for r in metadata.resolve_aliases(asked, edges, pages).collect()}
    assert got == {"p": ("n", True), "q": ("q", True), "in": ("r", False), "lost": ("lost", False)}


def test_aliases_of_any_length(spark):
    """A chain of 21 hops, tails into cycles, a title that is its own alias, and random graphs by brute force."""
    rng = random.Random(4)
    alias = {f"c{i}": f"c{i + 1}" for i in range(21)} | {"t0": "t1", "t1": "t2", "t2": "r0", "self": "self"}
    alias |= {f"r{i}": f"r{(i + 1) % 5}" for i in range(5)}
    alias |= {f"g{i}": f"g{rng.randrange(60)}" for i in range(60) if i % 7}
    titles = sorted({*alias, *alias.values(), "lost"})

    def walk(title):
        seen, last = [], title
        while title in alias and title not in seen:
            seen.append(title)
            last, title = title, alias[title]
        return (last if title in seen else title), title

    asked = spark.createDataFrame([(t,) for t in titles], "title string")
    edges = spark.createDataFrame(list(alias.items()), "src string, dst string")
    pages = spark.createDataFrame([("c21",), ("r0",)], "title string")
    for i, ends in enumerate(("last", "first")):
        got = {r.title: (r.final, r.found) for r in metadata.resolve_aliases(asked, edges, pages, ends).collect()}
        assert got == {t: (walk(t)[i], walk(t)[i] in ("c21", "r0")) for t in titles}
        assert got["c0"] == ("c21", True)


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    out = str(tmp_path / "t")
    index.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "scene_id int, v string"), out)
    index.write_partitions(spark.createDataFrame([(2, "c")], "scene_id int, v string"), out)
    assert {(r.scene_id, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}


def test_stream_dates_only_new_files(spark, tmp_path):
    schema = (
        "scene_id int, file_key string, title string, date_text string, date_qs string, date_source string, exif map<string,string>, "
        "categories array<string>, subcats array<string>, object_name string, license string, credit string, upload_time string, "
        "artist_born int, artist_died int"
    )
    row = lambda k, text: (1, k, "t", text, None, "commons-desc-page", {}, [], [], "", "", "", "2015-01-01T00:00:00Z", None, None)
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([row("a", "1900")], schema).write.parquet(source)
    kind = spark.read.parquet(source).schema
    for extra in (None, row("b", "1920s")):
        if extra:
            spark.createDataFrame([extra], schema).write.mode("append").parquet(source)
        date_new_files(spark, source, kind, target, check, 2025).awaitTermination()
    got = {(r.file_key, r.date_lo) for r in spark.read.parquet(target).collect()}
    assert got == {("a", 1900.0), ("b", 1920.0)} and spark.read.parquet(target).count() == 2
