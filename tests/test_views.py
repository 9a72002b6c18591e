"""View tables, per-sample kernels and hooks."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import views


def poses(n, rng):
    out = []
    for _ in range(n):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = q * np.sign(np.linalg.det(q)), rng.normal(size=3) * 4
        out.append(m)
    return np.array(out)


def frame(m):
    return pd.DataFrame({"scene_id": 1, "sample": 0, "view": range(len(m)), "c2w": [x.ravel().tolist() for x in m]})


def test_normalised_cameras():
    m = poses(20, np.random.default_rng(0))
    m[7, :3, 3] = 1e9
    got = np.array(views.normalise_cameras(frame(m).sample(frac=1, random_state=1))["c2w"].tolist()).reshape(-1, 4, 4)
    assert np.linalg.norm(got[0, :3, 3]) == pytest.approx(2.0) and np.allclose(got[:, :3, :3], m[:, :3, :3])
    inside = np.arange(20) != 7
    assert np.allclose(got[inside, :3, 3].mean(axis=0), 0, atol=1e-6)


def test_plucker_rays_of_the_first_camera_start_at_the_origin():
    m = poses(3, np.random.default_rng(1))
    f = frame(m).assign(k=[[1.2, 0, 0.5, 0, 1.2, 0.5, 0, 0, 1]] * 3)
    rays = np.array(views.plucker_rays(f, 4, 6)["rays"].tolist()).reshape(3, 6, 4, 6)
    assert np.allclose(np.linalg.norm(rays[:, :3], axis=1), 1) and np.allclose(rays[0, 3:], 0)
    assert np.allclose((rays[:, :3] * rays[:, 3:]).sum(axis=1), 0)


def test_plane_keeps_the_two_widest_directions(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(80, 3)) * np.array([9.0, 4.0, 0.1])
    turn = poses(1, rng)[0][:3, :3]
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pts @ turn.T)], "scene_id long, i long, cx double, cy double, cz double")
    got = np.array([(r.u, r.v) for r in views.plane(df).orderBy("i").collect()])
    c = pts @ turn.T - np.median(pts @ turn.T, axis=0)
    vt = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(c @ vt.T), atol=1e-6)


def test_chunks_keep_every_item(spark):
    df = spark.range(123).select(F.format_string("n%04d", "id").alias("t"))
    got = sorted((r.chunk, r["items"]) for r in views.chunks(df, "t", 50).collect())
    assert [len(i) for _, i in got] == [50, 50, 23] and sum((i for _, i in got), []) == [f"n{i:04d}" for i in range(123)]


def test_embedding_hook(spark):
    df = spark.createDataFrame([(f"f{i}", bytes([i, 1])) for i in range(70)], "file_key string, content binary")
    sizes = []

    def model(contents):
        assert len(contents) <= 32
        return np.array([[c[0], 3.0] for c in contents])

    rows = views.embed(df, model).collect()
    assert len(rows) == 70 and not sizes
    assert all(np.linalg.norm(r.vec) == pytest.approx(1) for r in rows)


def test_chroma():
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    saturation, minor = views.chroma(grey)
    assert saturation == 0 and minor < 0.1
    sepia = np.clip(grey * np.array([1.0, 0.9, 0.7]), 0, 255)
    colours = np.random.default_rng(0).integers(0, 256, (500, 3))
    assert views.chroma(sepia)[1] < views.chroma(colours)[1] and views.chroma(colours)[0] > 0.4


def test_frames(spark):
    m = list(map(float, range(16)))
    df = spark.createDataFrame([("a/b.jpg", m, 1.0, 2.0, 3.0, 4.0, 8, 6)], "path string, c2w array<double>, fx double, fy double, cx double, cy double, width int, height int")
    got = json.loads(views.frames_json(df).first().value)
    assert got["transform_matrix"][1] == [4, 5, 6, 7] and got["fl_y"] == 2 and got["w"] == 8


def test_capped_subset_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, f"f{i}", 1990.0 + i % 20) for i in range(200)] + [(1, "none", None)], "scene_id long, file_key string, date_mid double")
    a = views.cap_modern(df, 12)
    assert a.where("date_mid >= 2000").count() == 12 and a.where("date_mid is null").count() == 1
    assert a.exceptAll(views.cap_modern(df.orderBy(F.rand(3)), 12)).count() == 0
