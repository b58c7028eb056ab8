"""Queries over what a viewer is served. QUERIES and ORACLES by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import expressions as X
from roadweave.operators import aggregates as A
from roadweave.operators import network as N
from roadweave.operators import serving as V
from roadweave.operators import tracks as T
from roadweave.plans.adapters import FPS, LINE, MOVED, MOVEMENTS, duck, ground, movements, projected_sql
from roadweave.plans.aggregate_queries import GR, rounded
from roadweave.plans.aggregate_queries import ORACLES as ONE
from roadweave.plans.more_queries import _COS, _LAT, _LON, _SIN, GEO
from roadweave.plans.track_queries import BASE, kin

SOUTH = [(40.0, -8.0), (360.0, -8.0)]
#: Gates at given places, one per region.
GATES = [("AFRICA", 10.0, 5.0), ("AMERICA", 200.0, 80.0), ("ASIA", -60.0, 40.0), ("EUROPE", 90.0, -75.0)]


def states(spark: SparkSession, d: str) -> DataFrame:
    k = kin(spark, d).withColumn("mode", X.mode_of_label(F.col("cls_name")))
    return T.motion_states(k, T.track_summary(k, FPS))


def k2_overlay_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The overlay chunks, a row per box of their frames' lists."""
    chunks = V.overlay_chunks(states(spark, d), FPS)
    rows = chunks.select("chunk", F.explode("frames").alias("frame", "boxes"))
    return rows.select("chunk", "frame", F.posexplode("boxes").alias("place", "b")).select("chunk", "frame", "place", "b.*")


def k6_track_paths(spark: SparkSession, d: str) -> DataFrame:
    mv = movements(spark, d, "track_id", "origin", "destination", "turn").select((F.col("track_id") - 1).alias("track_id"), "origin", "destination", "turn")
    t = V.track_details(ground(spark, d), mv)
    last = F.element_at("path", -1)
    return rounded(t.select("track_id", "mode", "f0", "f1", "median_speed_kmh", "max_speed_kmh", "origin", "destination", F.size("path").alias("points"), F.element_at(last, 1).alias("last_x"), F.element_at(last, 2).alias("last_y")))


def k16_peak_of_approaches(spark: SparkSession, d: str) -> DataFrame:
    """The longest queue over the approaches of two corridors."""
    parts = [A.queue_lengths(ground(spark, d), line, FPS, stop_kmh=9.0).select(F.lit(name).alias("approach"), (F.col("frame") / FPS).alias("t_s"), "queue_vehicles", "queue_length_m") for name, line in (("main", LINE), ("south", SOUTH))]
    return rounded(V.peak_queues(parts[0].unionByName(parts[1])))


def k19_trail_ends(spark: SparkSession, d: str) -> DataFrame:
    """Each moving row's trail: its length, and where it begins and ends."""
    t = V.trails(states(spark, d), 12)
    return rounded(t.select("frame", "track_id", F.size("trail").alias("n"), F.element_at("trail", 1)["cx"].alias("x0"), F.element_at("trail", -1)["cx"].alias("x1")))


def r1_frame_groups(spark: SparkSession, d: str) -> DataFrame:
    return V.frame_groups(states(spark, d)).select("frame", F.size("boxes").alias("n"), F.element_at("boxes", 1)["display_id"].alias("first"), F.element_at("boxes", -1)["display_id"].alias("last"))


def g8_points(spark: SparkSession, d: str) -> DataFrame:
    """Every track's first place as a feature, read back from its JSON."""
    first = ground(spark, d).groupBy("track_id").agg(F.min_by("world_x_m", "frame").alias("x"), F.min_by("world_y_m", "frame").alias("y"), F.min_by("mode", "frame").alias("mode"))
    at = lambda k: F.get_json_object("feature", f"$.geometry.coordinates[{k}]").cast("double")
    return V.point_features(first, GEO, ["track_id", "mode"]).select("track_id", F.get_json_object("feature", "$.properties.mode").alias("mode"), F.round(at(0), 6).alias("lon"), F.round(at(1), 6).alias("lat"))


def _gates(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {x}D, {y}D)" for n, x, y in GATES) + " AS t(name, x, y)")


def i4_desire_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions: one with a centreline of its own, others by the chord between their gates; read back from their JSON."""
    line = ground(spark, d).select("track_id", F.lit("ASIA").alias("origin"), F.lit("EUROPE").alias("destination")).distinct()
    out = V.desire_lines(A.od_summary(movements(spark, d, *MOVED)), N.centrelines(ground(spark, d), line), _gates(spark), GEO)
    at = lambda path: F.round(F.get_json_object("feature", path).cast("double"), 6)
    return out.select("origin", "destination", F.get_json_object("feature", "$.properties.turn").alias("turn"), F.get_json_object("feature", "$.properties.count").cast("long").alias("count"), "points", at("$.geometry.coordinates[0][0]").alias("lon0"), at("$.geometry.coordinates[0][1]").alias("lat0"))


def h10_centreline_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Median paths by mode, their nodes' places."""
    pairs = ground(spark, d).groupBy("track_id").agg(F.lit("W").alias("origin"), F.min_by("mode", "frame").alias("destination"))
    return rounded(N.centrelines(ground(spark, d), pairs))


def b9_label_ids(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of a detector's class numbers and names; an event's type has the number of its name."""
    from roadweave.operators import detections as D

    e = spark.read.parquet(f"{d}/events.parquet").select(F.length("event_type").alias("cls_id"), F.col("event_type").alias("cls_name"))
    return D.label_dictionary(e)


def f24_distributions(spark: SparkSession, d: str) -> DataFrame:
    s = states(spark, d)
    return T.distributions(s, ["mode", "motion_state", "cls_name"])


QUERIES = {f.__name__: f for f in (k2_overlay_boxes, k6_track_paths, k16_peak_of_approaches, k19_trail_ends, r1_frame_groups, g8_points, i4_desire_lines, h10_centreline_nodes, b9_label_ids, f24_distributions)}

_MODE = "CASE cls_name WHEN 'car' THEN 'car' WHEN 'van' THEN 'LGV' WHEN 'truck' THEN 'truck' WHEN 'motor' THEN 'motorcycle' WHEN 'pedestrian' THEN 'pedestrian' END"
ST = BASE + f""", st AS (SELECT kin.*, sm.x1, sm.y1, sm.x2, sm.y2, sm.cx, {_MODE} AS mode, parked, display_id, CASE WHEN parked THEN 'parked' WHEN kinematics_valid AND speed_mps > 0.7 THEN 'moving' WHEN kinematics_valid THEN 'temporarily_stopped' ELSE 'unknown' END AS motion_state
      FROM kin JOIN (SELECT track_id, frame, x1, y1, x2, y2, cx FROM smooth) sm USING (track_id, frame) JOIN summary USING (track_id) LEFT JOIN (SELECT track_id, row_number() OVER (ORDER BY f0, track_id) AS display_id FROM summary WHERE NOT parked) USING (track_id))"""
_LONLAT = f"round({GEO.lon0!r}::DOUBLE + (x * {_COS!r}::DOUBLE + y * {_SIN!r}::DOUBLE) / {_LON!r}::DOUBLE, 6)", f"round({GEO.lat0!r}::DOUBLE + (-x * {_SIN!r}::DOUBLE + y * {_COS!r}::DOUBLE) / {_LAT!r}::DOUBLE, 6)"
#: Centrelines: the places of 24 equally spaced nodes along each path, and their medians.
NODES = """, st0 AS (SELECT track_id, frame, world_x_m AS x, world_y_m AS y, coalesce(sqrt((world_x_m - lag(world_x_m) OVER w) ** 2 + (world_y_m - lag(world_y_m) OVER w) ** 2), 0) AS d FROM ground WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
      st1 AS (SELECT *, sum(d) OVER (PARTITION BY track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY track_id) AS n FROM st0),
      st2 AS (SELECT *, max(s) OVER (PARTITION BY track_id) AS total, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM st1 WHERE n >= 4 WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
      nd AS (SELECT DISTINCT ON (track_id, node) track_id, node, x + greatest(0, least(1, (node * total / 23 - s) / (s2 - s))) * (x2 - x) AS px, y + greatest(0, least(1, (node * total / 23 - s) / (s2 - s))) * (y2 - y) AS py
        FROM st2, (SELECT unnest(range(24))::INT AS node) WHERE total > 0 AND s2 > s AND node >= ceil(s / (total / 23) - 1e-9) AND node <= CASE WHEN s2 >= total THEN 23 ELSE ceil(s2 / (total / 23) - 1e-9) - 1 END)"""
ORACLES = {
    "k16_peak_of_approaches": f"""SELECT approach, t_s, queue_vehicles, queue_length_m FROM (SELECT 'main' AS approach, * FROM ({ONE["i9_queue_lengths"]}) UNION ALL SELECT 'south', * FROM ({ONE["i9_queue_lengths"].replace(projected_sql("world_x_m", "world_y_m", LINE), projected_sql("world_x_m", "world_y_m", SOUTH))}))
      ORDER BY queue_vehicles DESC, queue_length_m DESC, t_s, approach DESC LIMIT 1""",
    "k2_overlay_boxes": ST + f""" SELECT CAST(floor(frame / 5e0 / 10) AS INT) AS chunk, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY display_id) - 1 AS INT) AS place, display_id, CASE mode WHEN 'pedestrian' THEN 0 WHEN 'motorcycle' THEN 1 WHEN 'car' THEN 2 WHEN 'LGV' THEN 3 WHEN 'truck' THEN 4 ELSE 2 END AS mode,
      {', '.join(f'round_even(st.{c}, 0)::INT AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))}, round_even(speed_mps * 3.6::DOUBLE, 1) AS speed_kmh, CASE motion_state WHEN 'moving' THEN 0 WHEN 'temporarily_stopped' THEN 1 ELSE 3 END AS state, round_even(longitudinal_acceleration_mps2, 1) AS acceleration FROM st WHERE NOT parked""",
    "k6_track_paths": GR
    + f""", movements AS ({duck(MOVEMENTS)}), pts AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i FROM ground), p AS (SELECT track_id, count(*)::INT AS points, round(arg_max(world_x_m, frame), 2) AS last_x, round(arg_max(world_y_m, frame), 2) AS last_y FROM pts WHERE i % 10 = 0 GROUP BY 1)
      SELECT g.track_id, arg_min(g.mode, frame) AS mode, min(frame) AS f0, max(frame) AS f1, round(median(speed_kmh), 6) AS median_speed_kmh, round(max(speed_kmh), 6) AS max_speed_kmh, any_value(m.origin) AS origin, any_value(m.destination) AS destination, any_value(points) AS points, any_value(last_x) AS last_x, any_value(last_y) AS last_y
      FROM ground g JOIN p USING (track_id) LEFT JOIN movements m ON m.track_id - 1 = g.track_id GROUP BY 1""",
    "k19_trail_ends": ST + " SELECT frame, track_id, (count(*) OVER w)::INT AS n, round(first(cx) OVER w, 6) AS x0, round(cx, 6) AS x1 FROM st WHERE motion_state = 'moving' WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS 11 PRECEDING)",
    "r1_frame_groups": ST + " SELECT frame, count(*)::INT AS n, min(display_id) AS first, max(display_id) AS last FROM st WHERE NOT parked GROUP BY 1",
    "g8_points": GR + f" SELECT track_id, mode, {_LONLAT[0]} AS lon, {_LONLAT[1]} AS lat FROM (SELECT track_id, arg_min(world_x_m, frame) AS x, arg_min(world_y_m, frame) AS y, arg_min(mode, frame) AS mode FROM ground GROUP BY 1)",
    "i4_desire_lines": GR
    + NODES
    + f""", movements AS ({duck(MOVEMENTS)}), gate AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, x, y in GATES)}) AS t(name, x, y)), od AS (SELECT origin, destination, turn, count(*) AS count FROM movements WHERE turn <> 'internal' GROUP BY 1, 2, 3),
      line AS (SELECT 'ASIA' AS origin, 'EUROPE' AS destination, 24 AS points, median(px) FILTER (node = 0) AS x, median(py) FILTER (node = 0) AS y FROM nd),
      ch AS (SELECT od.*, coalesce(l.points, 2)::INT AS points, coalesce(l.x, g.x) AS x, coalesce(l.y, g.y) AS y FROM od LEFT JOIN line l USING (origin, destination) LEFT JOIN gate g ON g.name = origin LEFT JOIN gate h ON h.name = destination WHERE l.x IS NOT NULL OR (g.x IS NOT NULL AND h.x IS NOT NULL))
      SELECT origin, destination, turn, count, points, {_LONLAT[0]} AS lon0, {_LONLAT[1]} AS lat0 FROM ch""",
    "h10_centrelines": GR + NODES + " SELECT 'W' AS origin, 'E' AS destination, node, round(median(px), 6) AS x, round(median(py), 6) AS y FROM nd GROUP BY 3 HAVING count(*) >= 3",
    "g7_trajectories": "WITH RECURSIVE"
    + GR[4:]
    + """, o AS (SELECT track_id, world_x_m AS x, world_y_m AS y, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM ground), f AS (SELECT track_id, i, x, y, 1 AS n FROM o WHERE i = 1
      UNION ALL SELECT track_id, i, CASE WHEN far THEN x1 ELSE x END, CASE WHEN far THEN y1 ELSE y END, CASE WHEN far THEN n + 1 ELSE n END FROM (SELECT f.track_id, o.i, f.x, f.y, o.x AS x1, o.y AS y1, f.n, sqrt((o.x - f.x) ** 2 + (o.y - f.y) ** 2) >= 4 AS far FROM f JOIN o ON o.track_id = f.track_id AND o.i = f.i + 1))
      SELECT track_id, max(n)::INT AS points, any_value(m) AS mode FROM f JOIN (SELECT track_id, arg_min(mode, frame) AS m FROM ground GROUP BY 1) USING (track_id) GROUP BY 1 HAVING max(n) >= 2""",
    "h10_centreline_nodes": GR + NODES + ", md AS (SELECT track_id, arg_min(mode, frame) AS destination FROM ground GROUP BY 1) SELECT 'W' AS origin, destination, node, round(median(px), 6) AS x, round(median(py), 6) AS y FROM nd JOIN md USING (track_id) GROUP BY 2, 3 HAVING count(DISTINCT track_id) >= 3",
    "b9_label_ids": "SELECT DISTINCT length(event_type)::INT AS cls_id, event_type AS cls_name FROM events",
    "f24_distributions": ST + " SELECT 'mode' AS field, mode AS value, count(DISTINCT track_id) AS tracks, count(*) AS n_rows FROM st GROUP BY 2 UNION ALL SELECT 'motion_state', motion_state, count(DISTINCT track_id), count(*) FROM st GROUP BY 2 UNION ALL SELECT 'cls_name', cls_name, count(DISTINCT track_id), count(*) FROM st GROUP BY 2",
}
