"""Fits of a camera to observed vehicle sizes: Spark bins and takes medians, the driver solves over a dozen rows."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.expressions import GroundPlane, NoScale, RowScale


def row_bins(samples: DataFrame, bins: int, least: int = 25) -> tuple[list[tuple[float, float, float]], int, float]:
    """(row, median size, sqrt of count) of each of `bins` equal row ranges with enough samples; the samples; the median of all. samples: y, px."""
    s = samples.where("y IS NOT NULL AND px > 4")
    low, high, n, med = s.agg(F.min("y"), F.max("y"), F.count(F.lit(1)), F.median("px")).first()
    if not n:
        return [], 0, 0.0
    step = (high - low) / bins or 1.0
    b = F.least(F.floor((F.col("y") - low) / step), F.lit(bins - 1))
    rows = s.groupBy(b.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.median("px").alias("px")).where(F.col("n") >= least).orderBy("b").collect()
    return [(low + (r["b"] + 0.5) * step, r["px"], math.sqrt(r["n"])) for r in rows], n, med


def fit_ground_plane(samples: DataFrame, height_m: float, pitch_deg: float, width: int, height: int, length_m: float = 4.3, bounds: tuple[float, float] = (200.0, 12000.0)) -> GroundPlane | None:
    """The focal length that makes median sizes most plausible, by golden section on its logarithm; None without 100 samples and four bins."""
    rows, n, _ = row_bins(samples, 14)
    if n < 100 or len(rows) < 4:
        return None
    t = math.radians(abs(pitch_deg))

    def predicted(f: float) -> list[float] | None:
        depth = [(y - height / 2) * math.cos(t) + f * math.sin(t) for y, _, _ in rows]
        return None if min(depth) <= 1e-6 else [length_m / math.sqrt(height_m / a * height_m * f / (a * a)) for a in depth]

    def cost(f: float) -> float:
        p = predicted(f)
        return 1e9 if p is None else sum(w * (math.log(a) - math.log(m)) ** 2 for a, (_, m, w) in zip(p, rows))

    low, high = map(math.log, bounds)
    for _ in range(80):
        a, b = high - (high - low) * 0.6180339887, low + (high - low) * 0.6180339887
        low, high = (low, b) if cost(math.exp(a)) < cost(math.exp(b)) else (a, high)
    f = math.exp((low + high) / 2)
    p = predicted(f)
    errors = sorted(abs(a - m) / m for a, (_, m, _) in zip(p, rows))
    k = len(errors)
    residual = (errors[(k - 1) // 2] + errors[k // 2]) / 2
    confidence = min(max(1 - residual / 0.25, 0.0), 1.0) * min(max(k / 10, 0.3), 1.0)
    return GroundPlane(height_m, pitch_deg, f, width, height, confidence)


def fit_row_scale(samples: DataFrame, width: int, height: int) -> RowScale:
    """A weighted line of size by row, or a constant where samples or bins are too few."""
    rows, n, med = row_bins(samples, 12)
    if n < 100:
        return RowScale(44.0, 0.0, width, height, 0.15)
    if len(rows) < 3:
        return RowScale(med, 0.0, width, height, 0.2)
    w2 = [(w * w, y, m) for y, m, w in rows]
    sw, sy, sm = sum(w for w, _, _ in w2), sum(w * y for w, y, _ in w2), sum(w * m for w, _, m in w2)
    syy, sym = sum(w * y * y for w, y, _ in w2), sum(w * y * m for w, y, m in w2)
    slope = (sw * sym - sy * sm) / (sw * syy - sy * sy)
    base = (sm - slope * sy) / sw
    if min(slope * y + base for y, _, _ in rows) <= 5:
        slope, base = 0.0, med
    errors = sorted(abs(slope * y + base - m) / m for y, m, _ in rows)
    residual = (errors[(len(errors) - 1) // 2] + errors[len(errors) // 2]) / 2
    return RowScale(base, slope, width, height, min(max(0.6 - residual, 0.1), 0.6))


Calibration = GroundPlane | RowScale | NoScale


def choose(samples: DataFrame, width: int, height: int, camera_height_m: float | None, pitch_deg: float | None, prefer: str = "auto") -> Calibration:
    """The ground plane where telemetry is usable and the fit is good, else the row scale; prefer is auto, ground_plane, row_scale or none.

    Both "auto" and "ground_plane" fall back to the row scale. With "none" nothing is fitted, and all metric values are NULL.
    """
    if prefer not in ("auto", "ground_plane", "row_scale", "none"):
        raise ValueError(f"no calibration is called {prefer}")
    if prefer == "none":
        return NoScale(width, height)
    if prefer != "row_scale" and camera_height_m is not None and pitch_deg is not None and camera_height_m > 3 and 5 < abs(pitch_deg) < 89.5:
        fit = fit_ground_plane(samples, camera_height_m, pitch_deg, width, height)
        if fit is not None and fit.confidence > 0.25:
            return fit
    return fit_row_scale(samples, width, height)


def described(cal: Calibration) -> dict[str, object]:
    """The calibration as plain values, for a report."""
    out: dict[str, object] = {"method": {"GroundPlane": "ground_plane", "RowScale": "row_scale", "NoScale": "none"}[type(cal).__name__], **asdict(cal)}
    if isinstance(cal, GroundPlane):
        out["horizon_row"] = round(cal.horizon_row(), 1)
    return out


def calibration_json(cal: Calibration) -> str:
    return json.dumps(described(cal), indent=2, sort_keys=True, allow_nan=False)
