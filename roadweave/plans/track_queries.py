"""Queries over tracks: repair, kinematics, summaries. QUERIES and ORACLES by name."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import expressions as X
from roadweave.operators import legacy as L
from roadweave.operators import tracks as T
from roadweave.params import MotionParams
from roadweave.plans.adapters import CAMERA, FPS, TRACKS, duck, tracks

HV, HA = MotionParams().half_velocity(FPS), MotionParams().half_acceleration(FPS)
_C, _S = math.cos(math.radians(63.1)), math.sin(math.radians(63.1))
_BOX = ("x1", "y1", "x2", "y2")


def _r(df: DataFrame, *cols: str, keys: tuple[str, ...] = ("track_id", "frame")) -> DataFrame:
    return df.select(*keys, *(F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in cols))


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.smoothed(T.segmented(T.filled(T.kept_tracks(tracks(spark, sf_dir)))))


def kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.kinematics(smooth(spark, sf_dir), CAMERA, FPS)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.track_summary(kin(spark, sf_dir), FPS)


BASE = f"""WITH tracks AS ({duck(TRACKS)}),
kept AS (SELECT * EXCLUDE (life, n) FROM (SELECT *, max(frame) OVER w - min(frame) OVER w + 1 AS life, count(*) OVER w AS n FROM tracks WINDOW w AS (PARTITION BY track_id)) WHERE life >= 15 AND n >= 8),
nx AS (SELECT *, lead(frame) OVER w AS f2, {', '.join(f'lead({c}) OVER w AS n_{c}' for c in (*_BOX, 'conf'))} FROM kept WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
steps AS (SELECT *, unnest(CASE WHEN f2 - frame > 1 AND f2 - frame <= 31 THEN range(0, f2 - frame) ELSE [0::BIGINT] END) AS k FROM nx),
filled AS (SELECT track_id, CAST(frame + k AS INT) AS frame, {', '.join(f'CASE WHEN k > 0 THEN {c} + (n_{c} - {c}) * (k / CAST(f2 - frame AS DOUBLE)) ELSE {c} END AS {c}' for c in _BOX)},
  CASE WHEN k > 0 THEN least(conf, n_conf) * 8e-1 ELSE conf END AS conf, cls_name, k > 0 AS interpolated FROM steps),
seg AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY track_id ORDER BY frame) AS INT) AS segment FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) > 1 THEN 1 ELSE 0 END AS jump FROM filled)),
smooth AS (SELECT *, (x1 + x2) * 5e-1 AS cx, (y1 + y2) * 5e-1 AS cy FROM (SELECT track_id, frame, segment, interpolated, cls_name, conf, {', '.join(f'avg({c}) OVER w AS {c}' for c in _BOX)} FROM seg WINDOW w AS (PARTITION BY track_id, segment ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))),
gnd AS (SELECT *, (cx - 960e0) * (70.472::DOUBLE / a) AS world_x_m, (70.472::DOUBLE / a) * ({924.5 * _C!r}::DOUBLE - (cy - 540e0) * {_S!r}::DOUBLE) AS world_y_m
  FROM (SELECT *, (cy - 540e0) * {_C!r}::DOUBLE + {924.5 * _S!r}::DOUBLE AS a FROM smooth)),
vel AS (SELECT *, (lead(world_x_m, {HV}) OVER w - lag(world_x_m, {HV}) OVER w) / {2 * HV / FPS!r}::DOUBLE AS vx, (lead(world_y_m, {HV}) OVER w - lag(world_y_m, {HV}) OVER w) / {2 * HV / FPS!r}::DOUBLE AS vy,
  CASE WHEN lead(frame, {HV}) OVER w IS NOT NULL AND lag(frame, {HV}) OVER w IS NOT NULL THEN avg(interpolated::INT) OVER (PARTITION BY track_id, segment ORDER BY frame ROWS BETWEEN {HV} PRECEDING AND {HV} FOLLOWING) END AS part,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id, segment) AS m FROM gnd WINDOW w AS (PARTITION BY track_id, segment ORDER BY frame)),
known AS (SELECT *, CASE WHEN vx IS NOT NULL THEN i END AS ki FROM vel),
ends AS (SELECT *, last(vx IGNORE NULLS) OVER b AS px, first(vx IGNORE NULLS) OVER f AS qx, last(CASE WHEN vx IS NOT NULL THEN vy END IGNORE NULLS) OVER b AS py, first(CASE WHEN vx IS NOT NULL THEN vy END IGNORE NULLS) OVER f AS qy,
  CAST(i - last(ki IGNORE NULLS) OVER b AS DOUBLE) / (first(ki IGNORE NULLS) OVER f - last(ki IGNORE NULLS) OVER b) AS share, count(vx) OVER (PARTITION BY track_id, segment) AS known FROM known
  WINDOW f AS (PARTITION BY track_id, segment ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY track_id, segment ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
held AS (SELECT *, CASE WHEN vx IS NOT NULL THEN vx ELSE coalesce(px + (qx - px) * share, qx, px) END AS hx, CASE WHEN vx IS NOT NULL THEN vy ELSE coalesce(py + (qy - py) * share, qy, py) END AS hy FROM ends),
acc AS (SELECT *, CASE WHEN inner_ THEN ({' + '.join(f'(lead(hx, {k}) OVER w - lag(hx, {k}) OVER w) * {k}' for k in range(1, HA + 1))}) / {sum(k * k for k in range(-HA, HA + 1)) / FPS!r}::DOUBLE END AS ax,
  CASE WHEN inner_ THEN ({' + '.join(f'(lead(hy, {k}) OVER w - lag(hy, {k}) OVER w) * {k}' for k in range(1, HA + 1))}) / {sum(k * k for k in range(-HA, HA + 1)) / FPS!r}::DOUBLE END AS ay
  FROM (SELECT *, i > {HA} AND i <= m - {HA} AND known >= {2 * HA + 1} AND vx IS NOT NULL AS inner_ FROM held) WINDOW w AS (PARTITION BY track_id, segment ORDER BY frame)),
raw AS (SELECT *, sqrt(vx * vx + vy * vy) AS v, sqrt(ax * ax + ay * ay) AS acceleration, coalesce(part, 1) > 0.5 AS invented FROM acc),
kin AS (SELECT track_id, frame, segment, interpolated, cls_name, conf, world_x_m, world_y_m, part AS interpolated_fraction_in_window, CASE WHEN NOT fast_bad THEN v END AS speed_mps, CASE WHEN NOT fast_bad THEN vx END AS velocity_x_mps, CASE WHEN NOT fast_bad THEN vy END AS velocity_y_mps,
  CASE WHEN NOT fast_bad AND v >= 1 THEN degrees(atan2(vy, vx)) END AS heading_deg, CASE WHEN NOT fast_bad AND NOT acc_bad THEN acceleration END AS acceleration_mps2,
  CASE WHEN NOT fast_bad AND NOT acc_bad AND v >= 1 THEN (ax * vx + ay * vy) / greatest(v, 1e-6) END AS longitudinal_acceleration_mps2, CASE WHEN NOT fast_bad AND NOT acc_bad AND v >= 1 THEN (vx * ay - vy * ax) / greatest(v, 1e-6) END AS lateral_acceleration_mps2,
  v IS NOT NULL AND NOT fast_bad AND NOT invented AS kinematics_valid, CASE WHEN v IS NOT NULL AND NOT fast_bad AND NOT invented THEN 1e0 - 5e-1 * coalesce(part, 1) END AS kinematics_quality
  FROM (SELECT *, coalesce(v > 55, false) AS fast_bad, coalesce(acceleration > 10, false) OR invented AS acc_bad FROM raw)),
dec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, segment ORDER BY frame) - 1 AS r FROM kin) WHERE r % 2 = 0),
paths AS (SELECT track_id, coalesce(sum(d), 0) AS path_m FROM (SELECT track_id, sqrt((world_x_m - lag(world_x_m) OVER w) ** 2 + (world_y_m - lag(world_y_m) OVER w) ** 2) AS d FROM dec WINDOW w AS (PARTITION BY track_id, segment ORDER BY frame)) GROUP BY 1),
wins AS (SELECT track_id, coalesce(max(CASE WHEN rr = n AND n > 1 AND n <= 20 THEN s ELSE d END), 0) AS win_m FROM (
  SELECT track_id, row_number() OVER w AS rr, count(*) OVER (PARTITION BY track_id, segment) AS n, sqrt((world_x_m - lag(world_x_m, 20) OVER w) ** 2 + (world_y_m - lag(world_y_m, 20) OVER w) ** 2) AS d, sqrt((world_x_m - first(world_x_m) OVER w) ** 2 + (world_y_m - first(world_y_m) OVER w) ** 2) AS s
  FROM dec WHERE world_x_m IS NOT NULL AND world_y_m IS NOT NULL WINDOW w AS (PARTITION BY track_id, segment ORDER BY frame)) GROUP BY 1),
agg AS (SELECT track_id, min(frame) AS f0, max(frame) AS f1, sqrt((arg_max(world_x_m, frame) - arg_min(world_x_m, frame)) ** 2 + (arg_max(world_y_m, frame) - arg_min(world_y_m, frame)) ** 2) AS net_m, avg((speed_mps > 0.7)::INT) AS moving_frac,
  median(speed_mps) AS median_speed_mps, quantile_cont(speed_mps, 0.95) AS p95_speed_mps, max(speed_mps) AS max_speed_mps, quantile_cont(longitudinal_acceleration_mps2, 0.95) AS p95_accel_mps2, quantile_cont(longitudinal_acceleration_mps2, 0.05) AS p05_brake_mps2,
  count(*) FILTER (NOT interpolated) AS n_obs FROM kin GROUP BY 1),
summary AS (SELECT *, coalesce(life_s >= 3 AND moving_frac < 0.05 AND net_m < 2.5 AND win_m < 3, false) AS parked FROM (SELECT *, (f1 - f0 + 1) / 5e0 AS life_s FROM agg JOIN paths USING (track_id) JOIN wins USING (track_id)))
"""


def _rs(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def d1_kept_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.kept_tracks(tracks(spark, sf_dir)).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("frame").alias("last_frame"))


def d2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.filled(T.kept_tracks(tracks(spark, sf_dir))), *_BOX, "conf", "interpolated", "cls_name")


def d3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.segmented(T.filled(T.kept_tracks(tracks(spark, sf_dir)))).groupBy("track_id", "segment").agg(F.count(F.lit(1)).alias("n_rows"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))


def d4_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(smooth(spark, sf_dir), "segment", *_BOX, "cx", "cy")


def e2_ground_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = smooth(spark, sf_dir)
    sx, sy = CAMERA.scales(F.col("cy"))
    gx, gy = CAMERA.to_ground(F.col("cx"), F.col("cy"))
    ix, iy = CAMERA.to_image(F.col("gx"), F.col("gy"))
    df = df.withColumns({"scale_x": sx, "scale_y": sy, "gx": gx, "gy": gy, "anisotropy": CAMERA.anisotropy(F.col("cy")), "length_m": CAMERA.length_m(F.col("x2") - F.col("x1"), F.col("cy"))})
    return _r(df.withColumns({"back_x": ix, "back_y": iy}), "scale_x", "scale_y", "gx", "gy", "anisotropy", "length_m", "back_x", "back_y")


def f1_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(kin(spark, sf_dir), "segment", "velocity_x_mps", "velocity_y_mps", "speed_mps", "heading_deg")


def f4_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(kin(spark, sf_dir), "acceleration_mps2", "longitudinal_acceleration_mps2", "lateral_acceleration_mps2")


def f4_over_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accelerations of tracks whose places are unknown for some frames of every 31, as beyond the horizon."""
    rows = smooth(spark, sf_dir).withColumn("cy", F.when(F.col("frame") % 31 >= 4, F.col("cy")))
    return _r(T.kinematics(rows, CAMERA, FPS), "velocity_x_mps", "acceleration_mps2", "longitudinal_acceleration_mps2", "lateral_acceleration_mps2")


def f7_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(kin(spark, sf_dir), "interpolated_fraction_in_window", "kinematics_valid", "kinematics_quality")


def f9_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.path_lengths(kin(spark, sf_dir), FPS), "path_m", keys=("track_id",))


def f10_window_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.window_displacements(kin(spark, sf_dir), FPS), "win_m", keys=("track_id",))


SUMMARY = ("net_m", "moving_frac", "median_speed_mps", "p95_speed_mps", "max_speed_mps", "p95_accel_mps2", "p05_brake_mps2", "path_m", "win_m", "life_s")


def f18_track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(summary(spark, sf_dir), "f0", "f1", "n_obs", "parked", *SUMMARY, keys=("track_id",))


def f20_motion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kin(spark, sf_dir)
    return T.motion_states(k, T.track_summary(k, FPS)).select("track_id", "frame", "parked", "motion_state", "display_id")


def f23_stats_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kin(spark, sf_dir).withColumn("mode", X.mode_of_label(F.col("cls_name")))
    return _r(T.stats_by_mode(k, T.track_summary(k, FPS)), "n_tracks", "median_speed_mps", "p95_speed_mps", "p95_accel_mps2", "p05_brake_mps2", keys=("mode",))


def f24_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, k = tracks(spark, sf_dir), kin(spark, sf_dir)
    return _r(T.run_report(raw, k, T.track_summary(k, FPS)), "value", keys=("metric",))


def f2_slope_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.slope_velocity(kin(spark, sf_dir), FPS), "slope_x_mps", "slope_y_mps")


def f11_row_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.row_speed(smooth(spark, sf_dir), FPS, 0.1), "row_speed_mps")


def n_motion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parked and moving tracks with their median life and speed: the flagship, from raw boxes to verdicts."""
    s = summary(spark, sf_dir)
    return s.groupBy("parked").agg(F.count(F.lit(1)).alias("n_tracks"), F.round(F.median("life_s"), 6).alias("median_life_s"), F.round(F.median("p95_speed_mps"), 6).alias("median_p95_speed_mps"), F.round(F.avg("path_m"), 6).alias("mean_path_m"))


def f25_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier post-processing of all tracks: class by vote and size, parked verdict, display id and what they rest on."""
    _, t, _ = L.processed(tracks(spark, sf_dir), FPS)
    return _r(t, "mode", "median_length_m", "moving_frac", "net_m", "path_m", "win_m", "parked", "display_id", keys=("track_id",))


def f25_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t, _ = L.processed(tracks(spark, sf_dir), FPS)
    return _r(L.report(tracks(spark, sf_dir), rows, t), "value", keys=("metric",))


QUERIES = {f.__name__: f for f in (d1_kept_tracks, d2_filled, d3_segments, d4_smoothed, e2_ground_plane, f1_velocity, f2_slope_velocity, f11_row_speed, f4_acceleration, f4_over_holes, f7_validity, f9_path_length, f10_window_displacement, f18_track_summary, f20_motion_state, f23_stats_by_mode, f24_report, f25_legacy, f25_report, n_motion_summary)}

_MODE = "CASE cls_name WHEN 'car' THEN 'car' WHEN 'van' THEN 'LGV' WHEN 'truck' THEN 'truck' WHEN 'motor' THEN 'motorcycle' WHEN 'pedestrian' THEN 'pedestrian' END"
LEGACY = BASE + f""", sam AS (SELECT (y1 + y2) / 2 AS y, greatest(x2 - x1, y2 - y1) AS px FROM smooth WHERE NOT interpolated AND (cls_name = 'car' OR (SELECT count(*) FROM smooth WHERE NOT interpolated AND cls_name = 'car') < 200)),
  ext AS (SELECT min(y) AS lo, max(y) AS hi, count(*) AS n, median(px) AS med FROM sam WHERE px > 4),
  bins AS (SELECT lo + (b + 5e-1) * (hi - lo) / 12 AS y, c, m FROM (SELECT least(floor((y - lo) / ((hi - lo) / 12)), 11) AS b, count(*) AS c, median(px) AS m, any_value(lo) AS lo, any_value(hi) AS hi FROM sam, ext WHERE px > 4 GROUP BY 1) WHERE c >= 25),
  li AS (SELECT *, (sm - slope * sy) / sw AS base FROM (SELECT *, (sw * sym - sy * sm) / (sw * syy - sy * sy) AS slope FROM (SELECT count(*) AS k, sum(c) AS sw, sum(c * y) AS sy, sum(c * m) AS sm, sum(c * y * y) AS syy, sum(c * y * m) AS sym FROM bins))),
  sc AS (SELECT CASE WHEN fine THEN slope ELSE 0 END AS slope, CASE WHEN fine THEN base WHEN n > 0 THEN med ELSE 44 END AS base FROM (SELECT *, coalesce(n >= 200 AND k >= 3 AND least(slope * lo + base, slope * hi + base) > 5, false) AS fine FROM li, ext)),
  lr AS (SELECT smooth.*, 4.3::DOUBLE / least(greatest(slope * cy + base, 8), 400) AS mpp, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i FROM smooth, sc),
  lv AS (SELECT *, sqrt((lead(cx, 2) OVER w - lag(cx, 2) OVER w) ** 2 + (lead(cy, 2) OVER w - lag(cy, 2) OVER w) ** 2) / (lead(frame, 2) OVER w - lag(frame, 2) OVER w) * mpp * 5 AS v FROM lr WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
  lh AS (SELECT *, coalesce(v, last(v IGNORE NULLS) OVER b, first(v IGNORE NULLS) OVER f, 0) AS h FROM lv WINDOW f AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  ls AS (SELECT *, avg(h) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS s FROM lh),
  lw AS (SELECT track_id, coalesce(sum(step), 0) AS path_m, coalesce(max(CASE WHEN n > 25 THEN far WHEN r = n AND n > 1 THEN whole END), 0) AS win_m FROM (
    SELECT track_id, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER w AS r, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) * lag(mpp) OVER w AS step, sqrt((cx - lag(cx, 25) OVER w) ** 2 + (cy - lag(cy, 25) OVER w) ** 2) * lag(mpp, 25) OVER w AS far,
      sqrt((cx - first(cx) OVER w) ** 2 + (cy - first(cy) OVER w) ** 2) * first(mpp) OVER w AS whole FROM ls WHERE i % 2 = 0 WINDOW w AS (PARTITION BY track_id ORDER BY frame)) GROUP BY 1),
  la AS (SELECT track_id, min(frame) AS f0, max(frame) AS f1, avg((s > 0.7::DOUBLE)::INT) AS moving_frac, sqrt((arg_max(cx, frame) - arg_min(cx, frame)) ** 2 + (arg_max(cy, frame) - arg_min(cy, frame)) ** 2) * median(mpp) AS net_m, median(greatest(x2 - x1, y2 - y1) * mpp) AS len FROM ls GROUP BY 1),
  lc AS (SELECT track_id, m AS coarse FROM (SELECT track_id, {_MODE} AS m, sum(conf) AS v, min(frame) AS f FROM smooth WHERE NOT interpolated AND {_MODE} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY v DESC, f) = 1),
  lt AS (SELECT *, (f1 - f0 + 1) / 5e0 >= 3 AND moving_frac < 0.05::DOUBLE AND net_m < 2.5::DOUBLE AND win_m < 3 AS parked, (f1 - f0 + 1) / 5e0 AS life_s, CASE coalesce(coarse, 'car') WHEN 'car' THEN CASE WHEN len > 6.2::DOUBLE THEN 'LGV' ELSE 'car' END WHEN 'LGV' THEN CASE WHEN len > 9.5::DOUBLE THEN 'HGV' WHEN len > 7.5::DOUBLE THEN 'truck' ELSE 'LGV' END
    WHEN 'truck' THEN CASE WHEN len > 9.5::DOUBLE THEN 'HGV' ELSE 'truck' END ELSE coarse END AS mode FROM la JOIN lw USING (track_id) LEFT JOIN lc USING (track_id))
"""
ORACLES = {
    "f25_legacy": LEGACY + f"SELECT track_id, mode, round(len, 6) AS median_length_m, {_rs('moving_frac', 'net_m', 'path_m', 'win_m')}, parked, CASE WHEN NOT parked THEN row_number() OVER (PARTITION BY parked ORDER BY f0, track_id) END AS display_id FROM lt",
    "f25_report": LEGACY
    + """SELECT metric, round(value, 6) AS value FROM (SELECT 'tracks_total' AS metric, count(*)::DOUBLE AS value FROM lt UNION ALL SELECT 'tracks_moving', count(*) FILTER (NOT parked)::DOUBLE FROM lt UNION ALL SELECT 'tracks_parked', count(*) FILTER (parked)::DOUBLE FROM lt UNION ALL SELECT 'median_track_seconds', median(life_s) FROM lt
      UNION ALL SELECT 'p90_track_seconds', quantile_cont(life_s, 0.9) FROM lt UNION ALL SELECT 'rows', count(*)::DOUBLE FROM ls UNION ALL SELECT 'rows_interpolated', count(*) FILTER (interpolated)::DOUBLE FROM ls UNION ALL SELECT 'frames', (max(frame) + 1)::DOUBLE FROM ls
      UNION ALL SELECT 'tracks_dropped_short', ((SELECT count(DISTINCT track_id) FROM tracks) - (SELECT count(*) FROM lt))::DOUBLE UNION ALL SELECT 'moving_' || m, (SELECT count(*) FROM lt WHERE mode = m AND NOT parked)::DOUBLE FROM (SELECT unnest(['pedestrian', 'motorcycle', 'car', 'LGV', 'truck', 'HGV', 'bus']) AS m))""",
    "d1_kept_tracks": BASE + "SELECT track_id, count(*) AS n_rows, max(frame) AS last_frame FROM kept GROUP BY 1",
    "d2_filled": BASE + f"SELECT track_id, frame, {_rs(*_BOX, 'conf')}, interpolated, cls_name FROM filled",
    "d3_segments": BASE + "SELECT track_id, segment, count(*) AS n_rows, min(frame) AS f0, max(frame) AS f1 FROM seg GROUP BY 1, 2",
    "d4_smoothed": BASE + f"SELECT track_id, frame, segment, {_rs(*_BOX, 'cx', 'cy')} FROM smooth",
    "e2_ground_plane": BASE + f"""SELECT track_id, frame, round(70.472::DOUBLE / a, 6) AS scale_x, round(70.472::DOUBLE * 924.5::DOUBLE / (a * a), 6) AS scale_y, round(world_x_m, 6) AS gx, round(world_y_m, 6) AS gy,
      round(924.5::DOUBLE / a, 6) AS anisotropy, round((x2 - x1) * sqrt((70.472::DOUBLE / a) * (70.472::DOUBLE * 924.5::DOUBLE / (a * a))), 6) AS length_m, round(cx, 6) AS back_x, round(cy, 6) AS back_y FROM gnd""",
    "f1_velocity": BASE + f"SELECT track_id, frame, segment, {_rs('velocity_x_mps', 'velocity_y_mps', 'speed_mps', 'heading_deg')} FROM kin",
    "f2_slope_velocity": BASE + """, sl AS (SELECT *, (lead(world_x_m) OVER w - lag(world_x_m) OVER w) / 4e-1 AS sx, (lead(world_y_m) OVER w - lag(world_y_m) OVER w) / 4e-1 AS sy FROM kin WINDOW w AS (PARTITION BY track_id, segment ORDER BY frame))
      SELECT track_id, frame, round(coalesce(sx, first(sx IGNORE NULLS) OVER f, last(sx IGNORE NULLS) OVER b), 6) AS slope_x_mps, round(coalesce(sy, first(sy IGNORE NULLS) OVER f, last(sy IGNORE NULLS) OVER b), 6) AS slope_y_mps FROM sl
      WINDOW f AS (PARTITION BY track_id, segment ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY track_id, segment ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "f11_row_speed": BASE + """, rv AS (SELECT *, sqrt((lead(cx) OVER w - lag(cx) OVER w) ** 2 + (lead(cy) OVER w - lag(cy) OVER w) ** 2) * 1e-1 / (lead(frame) OVER w - lag(frame) OVER w) * 5 AS v FROM smooth WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
      rh AS (SELECT *, least(greatest(coalesce(v, last(v IGNORE NULLS) OVER b, first(v IGNORE NULLS) OVER f), 0), 60) AS h FROM rv WINDOW f AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT track_id, frame, round(avg(h) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS row_speed_mps FROM rh""",
    "f4_acceleration": BASE + f"SELECT track_id, frame, {_rs('acceleration_mps2', 'longitudinal_acceleration_mps2', 'lateral_acceleration_mps2')} FROM kin",
    "f4_over_holes": BASE.replace("(y1 + y2) * 5e-1 AS cy", "CASE WHEN frame % 31 >= 4 THEN (y1 + y2) * 5e-1 END AS cy")
    + f"SELECT track_id, frame, {_rs('velocity_x_mps', 'acceleration_mps2', 'longitudinal_acceleration_mps2', 'lateral_acceleration_mps2')} FROM kin",
    "f7_validity": BASE + f"SELECT track_id, frame, {_rs('interpolated_fraction_in_window')}, kinematics_valid, {_rs('kinematics_quality')} FROM kin",
    "f9_path_length": BASE + f"SELECT track_id, {_rs('path_m')} FROM paths",
    "f10_window_displacement": BASE + f"SELECT track_id, {_rs('win_m')} FROM wins",
    "f18_track_summary": BASE + f"SELECT track_id, f0, f1, n_obs, parked, {_rs(*SUMMARY)} FROM summary",
    "f20_motion_state": BASE + """SELECT track_id, frame, parked, CASE WHEN parked THEN 'parked' WHEN kinematics_valid AND speed_mps > 0.7 THEN 'moving' WHEN kinematics_valid THEN 'temporarily_stopped' ELSE 'unknown' END AS motion_state, display_id
      FROM kin JOIN summary USING (track_id) LEFT JOIN (SELECT track_id, row_number() OVER (ORDER BY f0, track_id) AS display_id FROM summary WHERE NOT parked) USING (track_id)""",
    "f23_stats_by_mode": BASE + f"""SELECT mode, count(*) AS n_tracks, round(median(median_speed_mps), 6) AS median_speed_mps, round(quantile_cont(p95_speed_mps, 0.95), 6) AS p95_speed_mps, round(quantile_cont(p95_accel_mps2, 0.95), 6) AS p95_accel_mps2, round(quantile_cont(p05_brake_mps2, 0.05), 6) AS p05_brake_mps2
      FROM summary JOIN (SELECT track_id, min({_MODE}) AS mode FROM kin GROUP BY 1) USING (track_id) WHERE NOT parked GROUP BY 1""",
    "f24_report": BASE + """SELECT metric, round(value, 6) AS value FROM (SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM kin UNION ALL SELECT 'interpolated_rows', (count(*) FILTER (interpolated))::DOUBLE FROM kin
      UNION ALL SELECT 'dropped_tracks', ((SELECT count(DISTINCT track_id) FROM tracks) - (SELECT count(DISTINCT track_id) FROM kin))::DOUBLE UNION ALL SELECT CASE WHEN parked THEN 'parked_tracks' ELSE 'moving_tracks' END, count(*)::DOUBLE FROM summary GROUP BY parked
      UNION ALL SELECT 'median_life_s', median(life_s) FROM summary UNION ALL SELECT 'p90_life_s', quantile_cont(life_s, 0.9) FROM summary)""",
    "n_motion_summary": BASE + "SELECT parked, count(*) AS n_tracks, round(median(life_s), 6) AS median_life_s, round(median(p95_speed_mps), 6) AS median_p95_speed_mps, round(avg(path_m), 6) AS mean_path_m FROM summary GROUP BY 1",
}
