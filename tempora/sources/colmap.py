"""Binary camera files as a Python data source, a task per file, and large ones in parts.

spark.dataSource.register(ColmapSource)
spark.read.format("colmap").option("kind", "images").load(path or glob)

kind: cameras, images (with key points, which are skipped) or minimal images
(option points=false). Truncated or overlong files raise in FAILFAST mode
(default) and give no rows in PERMISSIVE mode. Files are read through pyarrow's
file systems (local, S3, GCS, HDFS); for other stores, read with binaryFile and
use parse_files.

Records vary in length, so a large file cannot be cut blindly: read_images walks
each file once, a task per file, from record to record without reading key
points, and notes where a part of about part_bytes begins; then every part is a
row of its own, dealt to any task, that reads and parses its own range.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tempora.plans.materialize import materialize
from tempora.sources.files import listed, opened, read_range

# Lens models in the order of their numbers, and their parameters.
MODELS = (
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8),
    ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4),
    ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
)
CAMERAS = "path string, camera_id int, model string, width long, height long, params array<double>"
IMAGES = (
    "path string, image_id long, qw double, qx double, qy double, qz double, "
    "tx double, ty double, tz double, camera_id long, name string, n_points long"
)
KEYPOINT_BYTES = 24


def cameras(data: bytes):
    """Rows of a cameras file."""
    (n,), at = struct.unpack_from("<Q", data, 0), 8
    for _ in range(n):
        camera, model, w, h = struct.unpack_from("<iiQQ", data, at)
        if not 0 <= model < len(MODELS):
            raise ValueError(f"unknown camera model {model}")
        name, count = MODELS[model]
        at += 24
        yield camera, name, w, h, list(struct.unpack_from(f"<{count}d", data, at))
        at += 8 * count
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes left over")


def images(data: bytes, points: bool = True):
    """Rows of an images file; key points are skipped, not read."""
    return image_records(data, *struct.unpack_from("<Q", data, 0), points, 8)


def image_records(data: bytes, n: int, points: bool = True, at: int = 0):
    """Rows of n records that begin at a place and end with the data."""
    for _ in range(n):
        image, *pose, camera = struct.unpack_from("<I7dI", data, at)
        end = data.index(b"\0", at + 64)
        name, at, count = data[at + 64 : end].decode(), end + 1, None
        if points:
            (count,) = struct.unpack_from("<Q", data, at)
            at += 8 + KEYPOINT_BYTES * count
        if at > len(data):
            raise ValueError("file ends early")
        yield image, *pose, camera, name, count
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes left over")


def rows(data: bytes, kind: str, points: bool):
    return cameras(data) if kind == "cameras" else images(data, points)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.kind = options.get("kind", "images")
        self.points = options.get("points", "true").lower() == "true"
        self.lenient = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self):
        return [_File(p) for p, _ in listed(self.path)]

    def read(self, partition):
        if partition is None:  # no file fits
            return
        system, path = opened(partition.path)
        data = read_range(partition.path, 0, system.get_file_info(path).size)
        try:
            found = [(partition.path, *r) for r in rows(data, self.kind, self.points)]
        except (ValueError, struct.error):
            if not self.lenient:
                raise
            found = []
        yield from found


class ColmapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colmap"

    def schema(self) -> str:
        return CAMERAS if self.options.get("kind", "images") == "cameras" else IMAGES

    def reader(self, schema):
        return _Reader(self.options)


def parse_files(binary: DataFrame, kind: str = "images", points: bool = True) -> DataFrame:
    """The same rows from spark.read.format('binaryFile'): any store that Spark reads."""
    schema = CAMERAS if kind == "cameras" else IMAGES
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            found = [(p, *r) for p, d in zip(pdf["path"], pdf["content"]) for r in rows(d, kind, points)]
            yield pd.DataFrame(found, columns=names)

    return binary.select("path", "content").mapInPandas(run, schema)


PARTS = "path string, start long, stop long, n long"


def image_parts(uri: str, points: bool = True, part_bytes: int = 16 << 20):
    """(start, stop, records) of the parts of an images file, found by walking over its records."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        size, block, begin = f.size(), b"", 0

        def at(place: int, n: int) -> bytes:
            """n bytes from a place, by reads of a megabyte."""
            nonlocal block, begin
            if not begin <= place <= place + n <= begin + len(block):
                begin, block = place, f.read_at(max(n, min(1 << 20, size - place)), place)
                if len(block) < n:
                    raise ValueError(f"{uri} ends early")
            return block[place - begin : place - begin + n]

        (left,), place = struct.unpack("<Q", at(0, 8)), 8
        start, n = place, 0
        while left:
            place += 64
            step = 64
            while (zero := at(place, min(step, size - place)).find(b"\0")) < 0:
                if place + step >= size:
                    raise ValueError(f"{uri} ends early")
                step *= 2
            place += zero + 1
            if points:
                place += 8 + KEYPOINT_BYTES * struct.unpack("<Q", at(place, 8))[0]
            if place > size:
                raise ValueError(f"{uri} ends early")
            left, n = left - 1, n + 1
            if place - start >= part_bytes or not left:
                yield start, place, n
                start, n = place, 0
        if place != size:
            raise ValueError(f"{size - place} bytes left over")


def read_images(spark: SparkSession, path: str, points: bool = True, part_bytes: int = 16 << 20) -> DataFrame:
    """Rows of IMAGES of all files of a path, folder or pattern, each large file in parts; bad files raise."""
    names = [c.split()[0] for c in IMAGES.split(", ")]
    files = [(p,) for p, _ in listed(path)]
    listing = spark.createDataFrame(files, "path string").repartition(max(1, len(files)))

    def walk(batches):
        for pdf in batches:
            found = [(p, *part) for p in pdf["path"] for part in image_parts(p, points, part_bytes)]
            yield pd.DataFrame(found, columns=["path", "start", "stop", "n"])

    def parse(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                data = read_range(r.path, r.start, r.stop - r.start)
                yield pd.DataFrame([(r.path, *row) for row in image_records(data, r.n, points)], columns=names)

    parts = materialize(listing.mapInPandas(walk, PARTS), "camera-parts")
    # A part each: as few numbers as they are, adaptive execution would put them together.
    return parts.repartition(max(1, parts.count()), "path", "start").mapInPandas(parse, IMAGES)
