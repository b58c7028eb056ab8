"""Queries over detections, classes, places and inferred networks. QUERIES and ORACLES by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import expressions as X
from roadweave.operators import calibration as C
from roadweave.operators import classify as K
from roadweave.operators import detections as D
from roadweave.operators import network as N
from roadweave.operators import tracker as TR
from roadweave.operators.classify import BUS_MIN_M, LADDER
from roadweave.plans.adapters import CAMERA, TRACKS, duck, ground, tracks
from roadweave.plans.aggregate_queries import GR, rounded
from roadweave.plans.track_queries import _C, _S, BASE, smooth
from roadweave.sources import tables as S
from roadweave.streaming import counts as SC

GEO = X.GeoReference(18.566225, 73.771845, 233.6, 70.47, 1.2)
_LAT, _LON = X.metres_per_degree(GEO.lat0)
_COS, _SIN = GEO._cs


def b3_owned(spark: SparkSession, d: str) -> DataFrame:
    """Every box in every tile that holds its centre, given back by the one that owns it."""
    grid = D.tiles(spark, 1920, 1080)
    rows = tracks(spark, d).withColumnsRenamed({"x1": "bx1", "y1": "by1", "x2": "bx2", "y2": "by2"}).crossJoin(F.broadcast(grid.select("tile_id", "x0", "y0", "x1", "y1")))
    cx, cy = (F.col("bx1") + F.col("bx2")) / 2, (F.col("by1") + F.col("by2")) / 2
    rows = rows.where((cx >= F.col("x0")) & (cx < F.col("x1")) & (cy >= F.col("y0")) & (cy < F.col("y1")))
    rows = rows.select("event_id", "conf", "tile_id", (F.col("bx1") - F.col("x0")).alias("x1_t"), (F.col("by1") - F.col("y0")).alias("y1_t"), (F.col("bx2") - F.col("x0")).alias("x2_t"), (F.col("by2") - F.col("y0")).alias("y2_t"))
    return rounded(D.owned(rows, grid, 1920, 1080).select("event_id", "x1", "y1", "x2", "y2"))


def b6_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return D.not_excluded(tracks(spark, d), [(0, 0, 300, 500), (600, 400, 900, 1000)]).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


def b7_modes(spark: SparkSession, d: str) -> DataFrame:
    return D.confidence_band(D.with_modes(tracks(spark, d))).groupBy("mode", "band").agg(F.count(F.lit(1)).alias("n"))


def b9_labels(spark: SparkSession, d: str) -> DataFrame:
    return D.label_dictionary(tracks(spark, d))


def b5_suppressed(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("frame", "track_id", "x1", "y1", "x2", "y2", "conf")
    return rounded(D.suppressed(t, 0.5))


def c16_tracked(spark: SparkSession, d: str) -> DataFrame:
    """The tracker over three videos made of the tracks' boxes."""
    t = D.with_modes(tracks(spark, d)).select(F.concat(F.lit("v"), F.col("track_id") % 3).alias("video_id"), "frame", "x1", "y1", "x2", "y2", "conf", "mode")
    return TR.tracked(t).groupBy("video_id", "mode").agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("track_id").alias("ids"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).where("cls_name = 'car'").select(((F.col("y1") + F.col("y2")) / 2).alias("y"), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("px"))


def e5_calibration(spark: SparkSession, d: str) -> DataFrame:
    g, r = C.fit_ground_plane(_samples(spark, d), 70.472, -63.1, 1920, 1080), C.fit_row_scale(_samples(spark, d), 1920, 1080)
    found = spark.createDataFrame([("ground_plane", g.f_px if g else None, g.confidence if g else None), ("row_scale", r.base, r.confidence)], "method string, value double, confidence double")
    return rounded(found).withColumn("value", F.round("value", 3))  # the search ends where the misfit is flat in doubles


def f14_votes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.votes(smooth(spark, d)))


def f15_classified(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.classified(smooth(spark, d), CAMERA, 1920, 1080))


def g3_wgs84(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = GEO.to_wgs84(F.col("world_x_m"), F.col("world_y_m"))
    bx, by = GEO.to_local(F.col("lat"), F.col("lon"))
    return rounded(ground(spark, d).select("track_id", "frame", lat.alias("lat"), lon.alias("lon")).withColumns({"back_x": bx, "back_y": by, "compass": GEO.heading_to_compass(F.col("frame").cast("double"))}))


def g7_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return S.trajectories(ground(spark, d), GEO, 4.0).select("track_id", "points", F.get_json_object("feature", "$.properties.mode").alias("mode"))


def h3_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.endpoints(ground(spark, d)).drop("on_edge_in", "on_edge_out"))


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g, e = N.gates(N.endpoints(ground(spark, d)), cluster_m=40.0, min_tracks=5)
    return g, e, N.movements(e, g)


def h4_gates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_network(spark, d)[0])


def h7_movements(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_network(spark, d)[2])


def h9_lanes(spark: SparkSession, d: str) -> DataFrame:
    g, _, mv = _network(spark, d)
    return N.entry_lanes(ground(spark, d), mv, g)


def h10_centrelines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.centrelines(ground(spark, d), ground(spark, d).select("track_id", F.lit("W").alias("origin"), F.lit("E").alias("destination")).distinct()))


def s1_interval_counts(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    out = SC.interval_counts(e, "ts", ["event_type"], "1 day")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), F.sum("count").alias("n"), F.max("count").alias("busiest"))


def s2_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return SC.sessions(e, "ts", ["event_type"], "10 minutes").groupBy("event_type").agg(F.count(F.lit(1)).alias("sessions"), F.max("vehicles").alias("largest"))


QUERIES = {f.__name__: f for f in (b3_owned, b5_suppressed, b6_exclusion, b7_modes, b9_labels, c16_tracked, e5_calibration, f14_votes, f15_classified, g3_wgs84, g7_trajectories, h3_endpoints, h4_gates, h7_movements, h9_lanes, h10_centrelines, s1_interval_counts, s2_sessions)}

_DET = f"WITH tracks AS ({duck(TRACKS)})"
_M = "CASE cls_name WHEN 'car' THEN 'car' WHEN 'van' THEN 'LGV' WHEN 'truck' THEN 'truck' WHEN 'motor' THEN 'motorcycle' WHEN 'pedestrian' THEN 'pedestrian' END"
#: Boxes of a frame from the best on: one stays if none of those that stay overlaps it by more than a half.
_IOU = "greatest(least(b.x2, k.x2) - greatest(b.x1, k.x1), 0) * greatest(least(b.y2, k.y2) - greatest(b.y1, k.y1), 0)"
_KEPT = f"""WITH RECURSIVE tracks AS ({duck(TRACKS)}), b AS (SELECT frame, track_id, x1, y1, x2, y2, conf, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, x1, y1, x2, y2, track_id) AS i FROM tracks),
      f AS (SELECT frame, i, true AS ok, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM b WHERE i = 1
        UNION ALL SELECT frame, i, ok, CASE WHEN ok THEN list_append(kept, box) ELSE kept END FROM (
          SELECT b.frame, b.i, f.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}} AS box, len(list_filter(f.kept, lambda k: {_IOU} / greatest((b.x2 - b.x1) * (b.y2 - b.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - {_IOU}, 1e-6) > 0.5)) = 0 AS ok
          FROM f JOIN b ON b.frame = f.frame AND b.i = f.i + 1))
"""


def _ladder_sql() -> str:
    """final_mode, mode_confidence and classification_source by appearance, length and its uncertainty."""
    final, conf, source = "", "", ""
    for mode, steps in LADDER.items():
        own, open_, to, doubt = f"measured AND am = '{mode}'", "true", f"'{mode}'", "false"
        for border, name in steps:
            over = f"({open_} AND l > {border!r}::DOUBLE + unc)"
            doubt += f" OR ({open_} AND NOT l > {border!r}::DOUBLE + unc AND l > {border!r}::DOUBLE - unc)"
            to, open_ = f"CASE WHEN {over} THEN '{name}' ELSE {to} END", over
        changed = f"{own} AND NOT ({doubt}) AND ({to}) <> '{mode}'"
        final += f" WHEN {changed} THEN {to}"
        source += f" WHEN {changed} THEN 'length_override' WHEN {own} THEN 'appearance_and_length'"
        conf += f" WHEN {own} AND ({doubt}) THEN p1 * 0.7::DOUBLE WHEN {changed} THEN least(1, p1 * 0.9::DOUBLE + 0.1::DOUBLE) WHEN {own} THEN least(1, p1 * 1.05::DOUBLE)"
    bus, low, high = "measured AND am = 'bus'", f"l < {BUS_MIN_M!r}::DOUBLE - unc", f"l < {BUS_MIN_M!r}::DOUBLE + unc"
    final = f"CASE WHEN am IS NULL THEN 'car' WHEN {bus} AND {low} THEN 'LGV'{final} ELSE am END"
    source = f"CASE WHEN am IS NULL THEN 'appearance_fallback_no_calibration' WHEN {bus} AND {low} THEN 'length_override' WHEN {bus} AND {high} THEN 'appearance_and_length'{source} ELSE 'appearance' END"
    conf = f"CASE WHEN am IS NULL THEN 0 WHEN {bus} AND {low} THEN p1 * 0.75::DOUBLE WHEN {bus} AND {high} THEN p1 * 0.8::DOUBLE{conf} ELSE p1 END"
    return f"{final} AS final_mode, round({conf}, 6) AS mode_confidence, {source} AS classification_source"


_CLASSED = BASE + f""", vo AS (SELECT track_id, arg_min(m, r) AS am, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 1) - coalesce(max(p) FILTER (r = 2), 0) AS vote_margin, sum(-p * ln(greatest(p, 1e-12))) AS vote_entropy
      FROM (SELECT *, w / sum(w) OVER (PARTITION BY track_id) AS p, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, f) AS r FROM (SELECT track_id, {_M} AS m, sum(conf) AS w, min(frame) AS f FROM smooth WHERE NOT interpolated AND {_M} IS NOT NULL GROUP BY 1, 2)) GROUP BY 1),
      l0 AS (SELECT track_id, frame, conf, size * sqrt(70.472::DOUBLE / a * (70.472::DOUBLE * 924.5::DOUBLE / (a * a))) AS l FROM (SELECT *, greatest(x2 - x1, y2 - y1) AS size, ((y1 + y2) / 2 - 540e0) * {_C!r}::DOUBLE + {924.5 * _S!r}::DOUBLE AS a FROM smooth)
        WHERE NOT interpolated AND x1 > 3 AND y1 > 3 AND x2 < 1916 AND y2 < 1076 AND conf >= 0.35::DOUBLE AND size >= 14 AND a > 1e-6),
      l1 AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, median(l) OVER w AS med FROM l0 WHERE l > 0 WINDOW w AS (PARTITION BY track_id)) WHERE n < 3 OR (l > 0.35::DOUBLE * med AND l < 2.5::DOUBLE * med)),
      l2 AS (SELECT *, sum(conf) OVER (PARTITION BY track_id ORDER BY l, frame ROWS UNBOUNDED PRECEDING) AS c, sum(conf) OVER (PARTITION BY track_id) AS total FROM l1),
      l3 AS (SELECT *, min(CASE WHEN c >= 0.5::DOUBLE * total THEN l END) OVER (PARTITION BY track_id) AS wm FROM l2),
      le AS (SELECT track_id, count(*) AS n, any_value(wm) AS l, greatest(1.253::DOUBLE * 1.4826::DOUBLE * median(abs(l - wm)) / sqrt(count(*)), 0.35::DOUBLE) AS unc FROM l3 GROUP BY 1 HAVING count(*) >= 5),
      al AS (SELECT *, l IS NOT NULL AND coalesce(am IN ('car', 'LGV', 'truck', 'bus'), false) AS measured FROM (SELECT DISTINCT track_id FROM smooth) LEFT JOIN vo USING (track_id) LEFT JOIN le USING (track_id))
      SELECT track_id, coalesce(am, 'car') AS appearance_mode, {_ladder_sql()}, round(CASE WHEN measured THEN l END, 6) AS estimated_length_m, CASE WHEN measured THEN n END AS length_measurement_count, round(CASE WHEN measured THEN unc END, 6) AS length_uncertainty_m,
      round(coalesce(vote_margin, 0), 6) AS vote_margin, round(vote_entropy, 6) AS vote_entropy FROM al"""
def _bins_sql(bins: int) -> str:
    """The row, median size and count of each range of rows with 25 samples or more."""
    return f"""(SELECT lo + (b + 5e-1) * (hi - lo) / {bins} AS y, m, c FROM (SELECT least(floor((y - lo) / ((hi - lo) / {bins})), {bins - 1}) AS b, count(*) AS c, median(px) AS m, any_value(lo) AS lo, any_value(hi) AS hi FROM sam, ext GROUP BY 1) WHERE c >= 25)"""


def _misfit(at: str) -> str:
    """How far the sizes that a focal length predicts are from the medians, by logarithms."""
    depth = f"((r.y - 540) * {_C!r}::DOUBLE + exp({at}) * {_S!r}::DOUBLE)"
    size = f"4.3::DOUBLE / sqrt(70.472::DOUBLE / {depth} * 70.472::DOUBLE * exp({at}) / ({depth} * {depth}))"
    return f"list_sum(list_transform(rows, lambda r: sqrt(r.c) * (ln({size}) - ln(r.m)) ** 2))"


_GOLD = "0.6180339887::DOUBLE"
_FIT = f"""WITH RECURSIVE tracks AS ({duck(TRACKS)}), sam AS (SELECT (y1 + y2) / 2 AS y, greatest(x2 - x1, y2 - y1) AS px FROM tracks WHERE cls_name = 'car' AND greatest(x2 - x1, y2 - y1) > 4), ext AS (SELECT min(y) AS lo, max(y) AS hi, count(*) AS n, median(px) AS med FROM sam),
      b14 AS (SELECT list({{'y': y, 'm': m, 'c': c}} ORDER BY y) AS rows, count(*) AS k FROM {_bins_sql(14)}),
      go AS (SELECT 0 AS i, ln(200e0) AS low, ln(12000e0) AS high UNION ALL SELECT i + 1, CASE WHEN left_ THEN low ELSE a END, CASE WHEN left_ THEN b ELSE high END
        FROM (SELECT *, {_misfit('a')} < {_misfit('b')} AS left_ FROM (SELECT *, high - (high - low) * {_GOLD} AS a, low + (high - low) * {_GOLD} AS b FROM go WHERE i < 80), b14)),
      f AS (SELECT exp((low + high) / 2) AS f FROM go WHERE i = 80), er AS (SELECT median(abs(4.3::DOUBLE / sqrt(70.472::DOUBLE / d * 70.472::DOUBLE * f / (d * d)) - m) / m) AS e, count(*) AS k FROM (SELECT *, (y - 540) * {_C!r}::DOUBLE + f * {_S!r}::DOUBLE AS d FROM {_bins_sql(14)}, f)),
      b12 AS (SELECT *, sw * syy - sy * sy AS det FROM (SELECT count(*) AS k, sum(c) AS sw, sum(c * y) AS sy, sum(c * m) AS sm, sum(c * y * y) AS syy, sum(c * y * m) AS sym FROM {_bins_sql(12)})),
      l0 AS (SELECT *, (sw * sym - sy * sm) / det AS slope, (sm - (sw * sym - sy * sm) / det * sy) / sw AS base FROM b12), l1 AS (SELECT k, CASE WHEN ok THEN slope ELSE 0 END AS slope, CASE WHEN ok THEN base ELSE (SELECT med FROM ext) END AS base FROM (SELECT *, (SELECT min(slope * y + base) FROM {_bins_sql(12)}) > 5 AS ok FROM l0)),
      l2 AS (SELECT any_value(base) AS base, median(abs(slope * y + base - m) / m) AS e FROM l1, {_bins_sql(12)})
SELECT 'ground_plane' AS method, round(CASE WHEN n >= 100 AND k >= 4 THEN f END, 3) AS value, round(CASE WHEN n >= 100 AND k >= 4 THEN least(greatest(1 - e / 0.25::DOUBLE, 0), 1) * least(greatest(k / 10e0, 0.3::DOUBLE), 1) END, 6) AS confidence FROM f, er, ext
UNION ALL SELECT 'row_scale', round(CASE WHEN n < 100 THEN 44 WHEN k < 3 THEN med ELSE l2.base END, 3), round(CASE WHEN n < 100 THEN 0.15::DOUBLE WHEN k < 3 THEN 0.2::DOUBLE ELSE least(greatest(0.6::DOUBLE - e, 0.1::DOUBLE), 0.6::DOUBLE) END, 6) FROM l1, l2, ext"""
ORACLES = {
    "e5_calibration": _FIT,
    "b5_suppressed": _KEPT + "SELECT frame, track_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("x1", "y1", "x2", "y2", "conf")) + " FROM b JOIN f USING (frame, i) WHERE ok",
    "f15_classified": _CLASSED,
    "b3_owned": _DET + " SELECT event_id, " + ", ".join(f"round(least(greatest({c}, 0), {n}), 6) AS {c}" for c, n in (("x1", 1920), ("y1", 1080), ("x2", 1920), ("y2", 1080))) + " FROM tracks WHERE (x1 + x2) / 2 < 1920 AND (y1 + y2) / 2 < 1080 AND (x1 + x2) / 2 >= 0 AND (y1 + y2) / 2 >= 0",
    "b6_exclusion": _DET + " SELECT track_id, count(*) AS n FROM (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM tracks) WHERE NOT (x >= 0 AND x < 300 AND y >= 0 AND y < 500) AND NOT (x >= 600 AND x < 900 AND y >= 400 AND y < 1000) GROUP BY 1",
    "b7_modes": _DET + f" SELECT {_M} AS mode, CASE WHEN conf >= 0.45 THEN 'high' WHEN conf >= 0.15 THEN 'low' END AS band, count(*) AS n FROM tracks WHERE {_M} IS NOT NULL AND conf >= 0.15 GROUP BY 1, 2",
    "b9_labels": _DET + " SELECT DISTINCT cls_name FROM tracks",
    "f14_votes": BASE + f"""SELECT track_id, arg_min(m, r) AS appearance_mode, round(max(p) FILTER (r = 1), 6) AS p1, round(sum(-p * ln(greatest(p, 1e-12))), 6) AS vote_entropy, round(max(p) FILTER (r = 1) - coalesce(max(p) FILTER (r = 2), 0), 6) AS vote_margin
      FROM (SELECT *, w / sum(w) OVER (PARTITION BY track_id) AS p, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, f) AS r FROM (SELECT track_id, {_M} AS m, sum(conf) AS w, min(frame) AS f FROM smooth WHERE NOT interpolated AND {_M} IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""",
    "g3_wgs84": GR + f"SELECT track_id, frame, round({GEO.lat0!r}::DOUBLE + (-world_x_m * {_SIN!r}::DOUBLE + world_y_m * {_COS!r}::DOUBLE) / {_LAT!r}::DOUBLE, 6) AS lat, round({GEO.lon0!r}::DOUBLE + (world_x_m * {_COS!r}::DOUBLE + world_y_m * {_SIN!r}::DOUBLE) / {_LON!r}::DOUBLE, 6) AS lon, round(world_x_m, 6) AS back_x, round(world_y_m, 6) AS back_y, round(fmod(fmod(fmod(90e0 - frame, 360) + 360, 360) + 233.6::DOUBLE, 360), 6) AS compass FROM ground",
    "h3_endpoints": GR + """, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM ground), k AS (SELECT *, greatest(2, least(floor(n / 4e0), 45)) AS k FROM o),
      e AS (SELECT track_id, arg_min(world_x_m, frame) AS x0, arg_min(world_y_m, frame) AS y0, arg_max(world_x_m, frame) AS x1, arg_max(world_y_m, frame) AS y1, min(frame) AS f0, max(frame) AS f1, arg_min(mode, frame) AS mode, max(world_x_m) FILTER (i = k) AS xk, max(world_y_m) FILTER (i = k) AS yk, max(world_x_m) FILTER (i = n - k + 1) AS xm, max(world_y_m) FILTER (i = n - k + 1) AS ym FROM k GROUP BY 1)
      SELECT track_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, f0, f1, mode, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS travel_m, round(fmod(degrees(atan2(xk - x0, yk - y0)) + 360, 360), 6) AS bearing_in, round(fmod(degrees(atan2(x1 - xm, y1 - ym)) + 360, 360), 6) AS bearing_out FROM e WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= 25""",
    "s1_interval_counts": "SELECT event_type, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, max(n) AS busiest FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "s2_sessions": "SELECT event_type, count(*) AS sessions, max(n) AS largest FROM (SELECT event_type, s, count(*) AS n FROM (SELECT event_type, sum(b) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS b FROM events)) GROUP BY 1, 2) GROUP BY 1",
}
