"""Camera geometry as column arithmetic: no UDF, wide codegen.

Quaternions are (w, x, y, z) from world to camera; matrices are arrays of nine
doubles, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.strings import let
from tempora.plans.materialize import materialize
from tempora.plans.ranking import medians


def rotation(w: Column, x: Column, y: Column, z: Column, normalise: bool = True) -> Column:
    """Rotation matrix of a quaternion, as array<double> of nine."""
    n = F.sqrt(w * w + x * x + y * y + z * z) if normalise else F.lit(1.0)

    def matrix(q: Column) -> Column:
        a, b, c, d = (q[k] for k in "wxyz")
        return F.array(
            1 - 2 * (c * c + d * d), 2 * (b * c - a * d), 2 * (b * d + a * c),
            2 * (b * c + a * d), 1 - 2 * (b * b + d * d), 2 * (c * d - a * b),
            2 * (b * d - a * c), 2 * (c * d + a * b), 1 - 2 * (b * b + c * c),
        )

    unit = F.struct(*[(v / n).alias(k) for k, v in zip("wxyz", (w, x, y, z), strict=True)])
    return let(unit, matrix)


def center(r: Column, tx: Column, ty: Column, tz: Column) -> list[Column]:
    """Camera position: minus the transposed rotation times the translation."""
    return [-(r[i] * tx + r[3 + i] * ty + r[6 + i] * tz) for i in range(3)]


def direction(r: Column) -> list[Column]:
    """Viewing direction: the third row of world-to-camera."""
    return [r[6], r[7], r[8]]


def camera_to_world(r: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """The 4x4 pose as array<double> of sixteen."""
    c = center(r, tx, ty, tz)
    rows = [[r[i], r[3 + i], r[6 + i], c[i]] for i in range(3)]
    return F.array(*[v for row in rows for v in row], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def quaternion(m: Column) -> Column:
    """Unit quaternion with w >= 0 of a rotation matrix, as array<double> of four."""
    e = lambda i, j: m[3 * i + j]
    trace = e(0, 0) + e(1, 1) + e(2, 2)
    s0 = 2 * F.sqrt(trace + 1)
    whole = F.array(0.25 * s0, (e(2, 1) - e(1, 2)) / s0, (e(0, 2) - e(2, 0)) / s0, (e(1, 0) - e(0, 1)) / s0)

    def around(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2 * F.sqrt(1 + e(i, i) - e(j, j) - e(k, k))
        q = [(e(k, j) - e(j, k)) / s, None, None, None]
        q[1 + i], q[1 + j], q[1 + k] = 0.25 * s, (e(j, i) + e(i, j)) / s, (e(k, i) + e(i, k)) / s
        return F.array(*q)

    raw = (
        F.when(trace > 0, whole)
        .when((e(0, 0) >= e(1, 1)) & (e(0, 0) >= e(2, 2)), around(0))
        .when(e(1, 1) >= e(2, 2), around(1))
        .otherwise(around(2))
    )

    def unit(q: Column) -> Column:
        n = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, v: a + v * v))
        return F.transform(q, lambda v: v * F.when(q[0] >= 0, 1.0).otherwise(-1.0) / n)

    return let(raw, unit)


def rotation_error_deg(a: Column, b: Column) -> Column:
    """Angle between two rotation matrices, in degrees."""
    trace = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def pose_distance(a: dict[str, Column], b: dict[str, Column], scale: Column) -> Column:
    """Distance of the centres in scene widths, and the angle as a part of 180 degrees.

    a and b hold cx, cy, cz and unit directions dx, dy, dz.
    """
    apart = F.sqrt(sum((a[k] - b[k]) * (a[k] - b[k]) for k in ("cx", "cy", "cz")))
    cosine = sum(a[k] * b[k] for k in ("dx", "dy", "dz"))
    return apart / scale + F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / math.pi


def camera_features(views: DataFrame) -> DataFrame:
    """Add centres cx..cz and unit directions dx..dz to rows with qw..qz and tx..tz."""
    r = F.col("__r")
    out = views.withColumn("__r", rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")]))
    c, d = center(r, F.col("tx"), F.col("ty"), F.col("tz")), direction(r)
    n = F.greatest(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(1e-12))
    names = dict(zip(("cx", "cy", "cz"), c, strict=True)) | {
        k: v / n for k, v in zip(("dx", "dy", "dz"), d, strict=True)
    }
    return out.withColumns(names).drop("__r")


def scene_scale(cameras: DataFrame, by: list[str]) -> DataFrame:
    """by.., scale: median distance to the component-wise median centre, 1 where that is 0."""
    own = ("cx", "cy", "cz")
    centres = materialize(cameras.select(*by, *own), "centres")
    middle = medians(centres, by, list(own)).withColumnsRenamed({c: f"m{c}" for c in own})
    far = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in own))
    apart = centres.join(materialize(middle, "middles"), by).select(*by, far.alias("scale"))
    return medians(apart, by, ["scale"]).withColumn("scale", F.coalesce(F.nullif(F.col("scale"), F.lit(0.0)), F.lit(1.0)))


def focal_and_center(model: Column, params: Column) -> Column:
    """struct(fx, fy, cx, cy) of a camera; models with one focal length repeat it."""
    single = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE", "FOV")
    p = lambda i: F.get(params, F.lit(i))
    return F.when(
        single, F.struct(p(0).alias("fx"), p(0).alias("fy"), p(1).alias("cx"), p(2).alias("cy"))
    ).otherwise(F.struct(p(0).alias("fx"), p(1).alias("fy"), p(2).alias("cx"), p(3).alias("cy")))


def resize_and_crop(w: Column, h: Column, size: int) -> Column:
    """struct(scale, left, top) of 'short side to size, centre crop'; halves round to even."""
    scale = F.lit(size) / F.least(w, h)
    side = lambda v: F.floor((F.rint(v * scale) - size) / 2).cast("int")
    return F.struct(scale.alias("scale"), side(w).alias("left"), side(h).alias("top"))


def adjusted_intrinsics(fx, fy, cx, cy, sx, sy, left=0.0, top=0.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        (fx * sx).alias("fx"), (fy * sy).alias("fy"),
        (cx * sx - lit(left)).alias("cx"), (cy * sy - lit(top)).alias("cy"),
    )


def date_features(year: Column, octaves: int = 8) -> Column:
    """Centuries since 1900, and sine and cosine of its octaves: 1 + 2 * octaves doubles."""
    t = (year - 1900) / 100
    wave = lambda f: F.transform(
        F.sequence(F.lit(0), F.lit(octaves - 1)), lambda k: f(t * F.pow(F.lit(2.0), k) * math.pi)
    )
    return F.concat(F.array(t), wave(F.sin), wave(F.cos))
