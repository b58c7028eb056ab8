"""Column expressions: angles, ground plane, georeference, polylines, mode maps. Unknown is NULL, never NaN."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.params import LABEL_MODES, PCE


def known(c: Column) -> Column:
    """NULL for NaN and infinite values."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def mode_of_label(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LABEL_MODES.items() for x in kv))[label]


def pce_of_mode(mode: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PCE.items() for x in kv))[mode], F.lit(1.0))


def wrapped(deg: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def turn_of(bearing_in: Column, bearing_out: Column) -> Column:
    d = wrapped(bearing_out - bearing_in)
    return F.when(d.isNull(), "unknown").when(F.abs(d) <= 35, "through").when(F.abs(d) >= 145, "u-turn").when(d > 0, "right").otherwise("left")


def circular_mean(deg: Column) -> Column:
    """An aggregate: the mean direction of angles in degrees."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg)))))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from +Y."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); the denominator is at least 1e-6."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda t: (t[2] - t[0]) * (t[3] - t[1])
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-6))


@dataclass(frozen=True)
class GroundPlane:
    """A camera at a height over flat ground that looks down at a pitch."""

    height_m: float
    pitch_deg: float
    f_px: float
    width: int
    height: int
    confidence: float = 1.0

    @property
    def _cs(self) -> tuple[float, float]:
        t = math.radians(abs(self.pitch_deg))
        return math.cos(t), math.sin(t)

    def depth(self, y: Column) -> Column:
        """NULL at the horizon and over it."""
        c, s = self._cs
        a = (y - self.height / 2.0) * c + self.f_px * s
        return F.when(a > 1e-6, a)

    def scales(self, y: Column) -> tuple[Column, Column]:
        a = self.depth(y)
        return self.height_m / a, self.height_m * self.f_px / (a * a)

    def to_ground(self, x: Column, y: Column) -> tuple[Column, Column]:
        c, s = self._cs
        scale = self.height_m / self.depth(y)
        return (x - self.width / 2.0) * scale, scale * (self.f_px * c - (y - self.height / 2.0) * s)

    def to_image(self, gx: Column, gy: Column) -> tuple[Column, Column]:
        c, s = self._cs
        den = gy * c + self.height_m * s
        p = self.f_px * (self.height_m * c - gy * s) / F.when(F.abs(den) >= 1e-9, den)
        a = p * c + self.f_px * s
        return self.width / 2.0 + gx * F.when(F.abs(a) >= 1e-9, a) / self.height_m, p + self.height / 2.0

    def in_range(self, y: Column) -> Column:
        return self.depth(y).isNotNull()

    def horizon_row(self) -> float:
        c, s = self._cs
        return self.height / 2.0 - self.f_px * s / c

    def anisotropy(self, y: Column) -> Column:
        sx, sy = self.scales(y)
        return sy / sx

    def length_m(self, px: Column, y: Column) -> Column:
        sx, sy = self.scales(y)
        return px * F.sqrt(sx * sy)


@dataclass(frozen=True)
class RowScale:
    """The isotropic fallback: a metre scale that is linear in the image row; sizes in pixels are clipped."""

    base: float
    slope: float
    width: int
    height: int
    confidence: float = 0.2

    def scales(self, y: Column) -> tuple[Column, Column]:
        px = F.least(F.greatest(self.base + self.slope * y, F.lit(6.0)), F.lit(600.0))
        m = 4.3 / px
        return m, m

    def to_ground(self, x: Column, y: Column) -> tuple[Column, Column]:
        m, _ = self.scales(y)
        return (x - self.width / 2.0) * m, (self.height / 2.0 - y) * m

    def in_range(self, y: Column) -> Column:
        return y.isNotNull()

    def length_m(self, px: Column, y: Column) -> Column:
        return px * self.scales(y)[0]


@dataclass(frozen=True)
class NoScale:
    """No metric scale is known: places, lengths and all that follows are NULL."""

    width: int
    height: int
    confidence: float = 0.0

    def scales(self, y: Column) -> tuple[Column, Column]:
        none = F.lit(None).cast("double")
        return none, none

    def to_ground(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.scales(y)

    def in_range(self, y: Column) -> Column:
        return F.lit(False)

    def length_m(self, px: Column, y: Column) -> Column:
        return F.lit(None).cast("double")


#: The WGS 84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def metres_per_degree(lat_deg: float) -> tuple[float, float]:
    lat, e2 = math.radians(lat_deg), WGS84_F * (2 - WGS84_F)
    w = math.sqrt(1 - e2 * math.sin(lat) ** 2)
    return math.pi * WGS84_A * (1 - e2) / (180 * w**3), math.pi * WGS84_A * math.cos(lat) / (180 * w)


@dataclass(frozen=True)
class GeoReference:
    """The local frame's origin and the compass bearing of its +Y axis."""

    lat0: float
    lon0: float
    yaw_deg: float
    alt_m: float = 0.0
    yaw_spread_deg: float = 0.0
    drift_m: float = 0.0
    samples: int = 0

    @property
    def _cs(self) -> tuple[float, float]:
        return math.cos(math.radians(self.yaw_deg)), math.sin(math.radians(self.yaw_deg))

    def to_enu(self, x: Column, y: Column) -> tuple[Column, Column]:
        c, s = self._cs
        return x * c + y * s, -x * s + y * c

    def from_enu(self, east: Column, north: Column) -> tuple[Column, Column]:
        c, s = self._cs
        return east * c - north * s, east * s + north * c

    def to_wgs84(self, x: Column, y: Column) -> tuple[Column, Column]:
        lat_m, lon_m = metres_per_degree(self.lat0)
        east, north = self.to_enu(x, y)
        return self.lat0 + north / lat_m, self.lon0 + east / lon_m

    def to_local(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        lat_m, lon_m = metres_per_degree(self.lat0)
        return self.from_enu((lon - self.lon0) * lon_m, (lat - self.lat0) * lat_m)

    def compass(self, local_bearing: Column) -> Column:
        return F.pmod(local_bearing + self.yaw_deg, F.lit(360.0))

    def heading_to_compass(self, heading: Column) -> Column:
        """From degrees counter-clockwise of +X."""
        return self.compass(F.pmod(90.0 - heading, F.lit(360.0)))

    def uncertainty_m(self, range_m: Column) -> Column:
        return range_m * math.radians(self.yaw_spread_deg)

    def described(self) -> dict[str, float | int]:
        """Rounded for people: where the frame lies, how it is turned, and how sure that is."""
        return {
            "origin_lat": round(self.lat0, 8),
            "origin_lon": round(self.lon0, 8),
            "plus_y_compass_bearing_deg": round(self.yaw_deg, 2),
            "camera_altitude_m": round(self.alt_m, 2),
            "gimbal_yaw_spread_deg": round(self.yaw_spread_deg, 3),
            "position_drift_m": round(self.drift_m, 3),
            "position_uncertainty_at_100m_m": round(100 * math.radians(self.yaw_spread_deg), 2),
            "telemetry_samples": self.samples,
        }


Line = list[tuple[float, float]]


def line_length(line: Line) -> float:
    return sum(max(math.hypot(b[0] - a[0], b[1] - a[1]), 1e-9) for a, b in zip(line, line[1:]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once per row, so that nested formulas don't multiply in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def segments_of(line: Line) -> Column:
    """The pieces of a polyline as a literal array: number, start, direction, length, and the way along the line at the start."""
    parts, at = [], 0.0
    for k, (a, b) in enumerate(zip(line, line[1:])):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = max(math.hypot(dx, dy), 1e-9)
        parts.append(F.struct(*(F.lit(v).alias(c) for c, v in (("k", k), ("ax", a[0]), ("ay", a[1]), ("dx", dx), ("dy", dy), ("n", n), ("at", at)))))
        at += n
    return F.array(*parts)


def projected(x: Column, y: Column, line: Line | Column) -> Column:
    """struct(s_m, offset_m): the place along a polyline and the signed offset; the first of equally near segments counts.

    An expression over an array of segments, literal or a column: rows are projected within their stage, and the plan's size does not depend on how
    many polylines there are when each row brings its own.
    """

    def nearest(g: Column) -> Column:
        t = F.least(F.greatest(((x - g["ax"]) * g["dx"] + (y - g["ay"]) * g["dy"]) / (g["n"] * g["n"]), F.lit(0.0)), F.lit(1.0))

        def offset(t: Column) -> Column:
            e = F.struct((x - (g["ax"] + t * g["dx"])).alias("x"), (y - (g["ay"] + t * g["dy"])).alias("y"))

            def placed(e: Column) -> Column:
                d2 = e["x"] * e["x"] + e["y"] * e["y"]
                return F.struct(d2.alias("d2"), g["k"].alias("k"), (g["at"] + t * g["n"]).alias("s_m"), (F.signum(g["dx"] * e["y"] - g["dy"] * e["x"]) * F.sqrt(d2)).alias("offset_m"))

            return let(e, placed)

        return let(t, offset)

    best = F.array_min(F.transform(line if isinstance(line, Column) else segments_of(line), nearest))
    return F.when(x.isNotNull() & y.isNotNull(), best)
