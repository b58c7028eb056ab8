"""Queries over movements and corridors. QUERIES and ORACLES by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.expressions import line_length
from roadweave.operators import aggregates as A
from roadweave.operators import serving as V
from roadweave.params import MODES, PCE
from roadweave.plans.adapters import FPS, GROUND, LINE, MOVED, MOVEMENTS, TRACKS, duck, ground, movements, projected_sql, tracks

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def i1_movement_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.movement_counts(movements(spark, d, *MOVED), FPS))


def i2_approach_volumes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.approach_volumes(movements(spark, d, *MOVED), FPS))


def i3_od_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.od_summary(movements(spark, d, *MOVED)))


def i6_speed_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.speed_profile(ground(spark, d), LINE, limit_kmh=14.0))


def i7_lane_volumes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.lane_volumes(movements(spark, d, *MOVED)))


def i8_modal_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.modal_split(movements(spark, d, *MOVED)))


def h8_od_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.od_matrix(movements(spark, d, *MOVED), REGIONS).withColumnsRenamed({r: r.lower().replace(" ", "_") for r in REGIONS})


def i5_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.on_corridor(ground(spark, d), LINE, 14.0).select("track_id", "frame", "event_id", "s_m", "offset_m"))


def i9_queue_lengths(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.queue_lengths(ground(spark, d), LINE, FPS, stop_kmh=9.0))


def i10_fundamental_diagram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.fundamental_diagram(ground(spark, d), LINE, FPS))


def i11_time_space(spark: SparkSession, d: str) -> DataFrame:
    t = A.time_space(ground(spark, d), LINE, FPS)
    return t.select("track_id", "mode", F.size("t").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 2).alias("sum_t"), F.round(F.array_max("s"), 1).alias("max_s"), F.size(F.filter("v", lambda x: x.isNull())).alias("unknown_v"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return A.edie_cells(ground(spark, d), LINE, FPS)


def i12_edie_cells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cells(spark, d))


def i13_fd_validity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.fd_validity(cells(spark, d), min_cells=3, min_vehicles=1, lanes=(-6, 6)))


def i14_smoothed_offsets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.smoothed_offsets(ground(spark, d), LINE, FPS).select("track_id", "frame", "lateral_offset_m", "raw_lane"))


def i14_held_lanes(spark: SparkSession, d: str) -> DataFrame:
    return A.held_lanes(A.smoothed_offsets(ground(spark, d), LINE, FPS, lane_width_m=0.5), FPS, lane_width_m=0.5, hysteresis_m=0.1, dwell_s=0.2)


def i15_lane_changes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.lane_change_summary(ground(spark, d), i14_held_lanes(spark, d)))


def k10_od_heat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.od_heat(movements(spark, d, *MOVED)))


def k11_top_movements(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.top_movements(movements(spark, d, *MOVED)))


def k12_pce_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.pce_shares(movements(spark, d, *MOVED)))


def k13_approach_pivot(spark: SparkSession, d: str) -> DataFrame:
    return V.approach_pivot(movements(spark, d, *MOVED), FPS, REGIONS).withColumnsRenamed({r: r.lower().replace(" ", "_") for r in REGIONS})


def k14_lane_pivot(spark: SparkSession, d: str) -> DataFrame:
    return V.lane_pivot(movements(spark, d, *MOVED)).withColumnsRenamed({m: m.lower() for m in MODES})


def k15_slowest_bin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.slowest_bin(A.speed_profile(ground(spark, d), LINE)).select("bin", "mean_speed_kmh", "n_samples"))


def k16_peak_queue(spark: SparkSession, d: str) -> DataFrame:
    q = A.queue_lengths(ground(spark, d), LINE, FPS, stop_kmh=9.0)
    return rounded(q.orderBy(F.desc("queue_vehicles"), "frame").limit(1).select("frame", "queue_vehicles", "queue_length_m"))


def k18_overlay_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.overlay_filter(ground(spark, d), 10.0)


def k2_overlay_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Ten-second chunks: rows, frames and vehicles of each."""
    g = ground(spark, d).where("NOT parked").withColumn("chunk", F.floor(F.col("frame") / (10 * FPS)).cast("int"))
    return g.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("frame").alias("n_frames"), F.count_distinct("track_id").alias("n_vehicles"))


def k6_track_detail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ground(spark, d).groupBy("track_id").agg(F.min_by("mode", "frame").alias("mode"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.median("speed_kmh").alias("median_kmh"), F.max("speed_kmh").alias("max_kmh")))


def k17_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Vehicles whose time on screen overlaps the window from 20 s to 30 s."""
    return V.overlapping(ground(spark, d), 20, 30, FPS)


def k19_trails(spark: SparkSession, d: str) -> DataFrame:
    """The trail of each vehicle's last ten positions: its length in rows and its mean place."""
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(-9, 0)
    return rounded(ground(spark, d).where("speed_kmh > 5").select("track_id", "frame", F.count(F.lit(1)).over(w).alias("n"), F.avg("world_x_m").over(w).alias("mean_x"), F.avg("world_y_m").over(w).alias("mean_y")))


def r3_draw_order(spark: SparkSession, d: str) -> DataFrame:
    return V.draw_order(tracks(spark, d))


def r5_waiting(spark: SparkSession, d: str) -> DataFrame:
    return V.waiting(ground(spark, d))


def r2_cumulative_modes(spark: SparkSession, d: str) -> DataFrame:
    return V.cumulative_modes(ground(spark, d))


QUERIES = {f.__name__: f for f in (i1_movement_counts, i2_approach_volumes, i3_od_summary, i5_projection, i6_speed_profile, i7_lane_volumes, i8_modal_split, h8_od_matrix, i9_queue_lengths, i10_fundamental_diagram, i11_time_space, i12_edie_cells, i13_fd_validity, i14_smoothed_offsets, i14_held_lanes, i15_lane_changes, k2_overlay_chunks, k6_track_detail, k10_od_heat, k11_top_movements, k12_pce_share, k13_approach_pivot, k14_lane_pivot, k15_slowest_bin, k16_peak_queue, k17_overlapping, k18_overlay_filter, k19_trails, r2_cumulative_modes, r3_draw_order, r5_waiting)}

MV = f"WITH movements AS ({duck(MOVEMENTS)}), mv AS (SELECT *, CAST(floor(f0 / 5e0 / 6e1) AS INT) AS interval FROM movements WHERE turn <> 'internal')"
_PCE = "CASE mode " + " ".join(f"WHEN '{m}' THEN {v!r}::DOUBLE" for m, v in PCE.items()) + " ELSE 1 END"
N_SEG = int(line_length(LINE) // 50)
LOW = line_length(LINE) / 2 - 30
GR = f"""WITH ground AS ({duck(GROUND)}), pr AS (SELECT *, p.s_m AS s_m, p.offset_m AS offset_m FROM (SELECT *, {projected_sql('world_x_m', 'world_y_m', LINE)} AS p FROM ground)), near AS (SELECT * FROM pr WHERE abs(offset_m) <= 12),
edie0 AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 5 THEN abs(s_m - lag(s_m) OVER w) ELSE 0 END AS ds, CASE WHEN frame - lag(frame) OVER w <= 5 THEN (frame - lag(frame) OVER w) / 5e0 ELSE 0 END AS dt FROM near WHERE mode <> 'pedestrian' WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
cells AS (SELECT segment, segment * 50e0 AS segment_start_m, interval, interval * 20e0 AS interval_start_s, lane, ds / 1000 * 3600 AS flow_veh_per_h, dt / 1000 * 1000 AS density_veh_per_km, ds / dt * 3.6::DOUBLE AS speed_kmh, n_vehicles FROM (
  SELECT CAST(least(greatest(floor(s_m / 50), 0), {N_SEG - 1}) AS INT) AS segment, CAST(floor(frame / 5e0 / 20) AS INT) AS interval, CAST(floor(offset_m / 3.2::DOUBLE) AS INT) AS lane, sum(ds) AS ds, sum(dt) AS dt, count(DISTINCT track_id) AS n_vehicles FROM edie0 GROUP BY ALL) WHERE dt > 0),
queues AS (SELECT f.frame, f.frame / 5e0 AS t_s, coalesce(n, 0) AS queue_vehicles, coalesce(len, 0) AS queue_length_m, coalesce(head, 0) AS queue_head_s_m FROM (SELECT DISTINCT frame FROM near WHERE speed_kmh IS NOT NULL AND frame % 5 = 0) f
  LEFT JOIN (SELECT frame, count(*) AS n, max(s_m) - min(s_m) AS len, min(s_m) AS head FROM (SELECT *, sum(b) OVER (PARTITION BY frame ORDER BY s_m, track_id) AS run FROM (SELECT *, CASE WHEN s_m - lag(s_m) OVER (PARTITION BY frame ORDER BY s_m, track_id) > 12 THEN 1 ELSE 0 END AS b FROM near WHERE speed_kmh <= 9 AND frame % 5 = 0)) WHERE run = 0 GROUP BY 1) q USING (frame)),
profile AS (SELECT CAST(floor(s_m / 10) AS INT) AS bin, avg(s_m) AS distance_m, count(*) AS n_samples, count(DISTINCT track_id) AS n_vehicles, avg(speed_kmh) AS mean_speed_kmh, median(speed_kmh) AS median_speed_kmh, quantile_cont(speed_kmh, 0.15) AS p15_speed_kmh, quantile_cont(speed_kmh, 0.85) AS p85_speed_kmh, 100 * avg((speed_kmh > 14)::INT) AS exceeding_share FROM near WHERE speed_kmh IS NOT NULL GROUP BY 1),
offs AS (SELECT *, median(offset_m) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS lateral_offset_m FROM pr WHERE abs(offset_m) <= 14)
"""


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_LOWER = {r: r.lower().replace(" ", "_") for r in REGIONS}
def held_sql(width: str, margin: str, dwell: int) -> str:
    """Lanes of a width that are held until `dwell` rows lie beyond the margin in one other lane: row by row."""
    return (
        "WITH RECURSIVE"
        + GR[4:]
        + f""", o AS (SELECT track_id, frame, lateral_offset_m AS o, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM offs),
      f AS (SELECT track_id, frame, i, floor(o / {width})::INT AS cur, floor(o / {width})::INT AS cand, 0 AS pending, false AS ch FROM o WHERE i = 1
        UNION ALL SELECT track_id, frame, i, CASE WHEN chg THEN own ELSE cur END, CASE WHEN inside THEN cur ELSE own END, CASE WHEN inside OR chg THEN 0 ELSE cnt END, chg
        FROM (SELECT *, NOT inside AND cnt >= {dwell} AS chg FROM (SELECT o.track_id, o.frame, o.i, f.cur, floor(o.o / {width})::INT AS own,
          o.o >= f.cur * {width} - {margin} AND o.o <= (f.cur + 1) * {width} + {margin} AS inside, CASE WHEN floor(o.o / {width})::INT = f.cand THEN f.pending + 1 ELSE 1 END AS cnt
          FROM f JOIN o ON o.track_id = f.track_id AND o.i = f.i + 1)))
"""
    )


CHANGES = """, st AS (SELECT g.track_id, ch, sqrt((world_x_m - lag(world_x_m) OVER w) ** 2 + (world_y_m - lag(world_y_m) OVER w) ** 2) AS d FROM ground g JOIN f USING (track_id, frame) WINDOW w AS (PARTITION BY g.track_id ORDER BY frame)),
      su AS (SELECT count(DISTINCT track_id) AS n_vehicles, count(*) FILTER (ch) AS lane_changes, coalesce(sum(d), 0) / 1e3 AS vehicle_km FROM st)
      SELECT n_vehicles, lane_changes, round(vehicle_km, 6) AS vehicle_km, round(lane_changes / greatest(n_vehicles, 1), 6) AS changes_per_vehicle, round(lane_changes / greatest(vehicle_km, 1e-6), 6) AS changes_per_km FROM su"""
HELD = held_sql("5e-1", "1e-1", 3)
ORACLES = {
    "i1_movement_counts": MV + f" SELECT interval, origin, destination, turn, mode, count(*) AS count, interval * 6e1 AS interval_start_s, round(count(*) * {_PCE}, 6) AS pce FROM mv GROUP BY interval, origin, destination, turn, mode",
    "i2_approach_volumes": MV + """ SELECT interval, approach, CAST(sum(e) AS BIGINT) AS entering, CAST(sum(l) AS BIGINT) AS leaving, interval * 6e1 AS interval_start_s, interval * 6e1 + 60 > (SELECT max(f1) / 5e0 FROM movements) AS partial,
      CASE WHEN NOT (interval * 6e1 + 60 > (SELECT max(f1) / 5e0 FROM movements)) THEN round_even(sum(e) / (60 / 3600e0), 0) END AS entering_veh_per_h FROM (SELECT interval, origin AS approach, 1 AS e, 0 AS l FROM mv UNION ALL SELECT interval, destination, 0, 1 FROM mv) GROUP BY 1, 2""",
    "i3_od_summary": MV + " SELECT origin, destination, turn, count(*) AS count, round(median(travel_m), 6) AS median_travel_m, round(1e2 * count(*) / (SELECT count(*) FROM mv), 6) AS share_pct FROM mv GROUP BY 1, 2, 3",
    "i5_projection": GR + f"SELECT track_id, frame, event_id, {r6('s_m', 'offset_m')} FROM pr WHERE abs(offset_m) <= 14",
    "i6_speed_profile": GR + f"SELECT bin, {r6('distance_m')}, n_samples, n_vehicles, {r6('mean_speed_kmh', 'median_speed_kmh', 'p15_speed_kmh', 'p85_speed_kmh', 'exceeding_share')} FROM profile",
    "i7_lane_volumes": MV + f" SELECT origin, lane_in, mode, count(*) AS count, round(1e2 * count(*) / sum(count(*)) OVER (PARTITION BY origin, lane_in), 6) AS lane_share_pct, round(count(*) * {_PCE}, 6) AS pce FROM mv WHERE lane_in IS NOT NULL GROUP BY 1, 2, 3",
    "i8_modal_split": MV + f" SELECT mode, coalesce(n, 0) AS count, round(1e2 * coalesce(n, 0) / (SELECT count(*) FROM mv), 6) AS share_pct, round(coalesce(n, 0) * {_PCE}, 6) AS pce_total FROM (SELECT unnest({list(MODES)!r}) AS mode) LEFT JOIN (SELECT mode, count(*) AS n FROM mv GROUP BY 1) USING (mode)",
    "h8_od_matrix": MV + f" SELECT origin, {', '.join(f'''count(*) FILTER (destination = '{r}') AS {c}''' for r, c in _LOWER.items())} FROM mv GROUP BY 1",
    "i9_queue_lengths": GR + f"SELECT frame, {r6('t_s')}, queue_vehicles, {r6('queue_length_m', 'queue_head_s_m')} FROM queues",
    "i10_fundamental_diagram": GR + f""", seg AS (SELECT *, CAST(floor(frame / 5e0 / 15) AS INT) AS interval FROM near WHERE speed_kmh IS NOT NULL AND s_m >= {LOW!r} AND s_m < {LOW + 60!r}),
      pf AS (SELECT interval, frame, count(DISTINCT track_id) AS present FROM seg GROUP BY 1, 2), c AS (SELECT interval, avg(present) / 0.06::DOUBLE AS k, count(*) AS frames FROM pf GROUP BY 1), v AS (SELECT interval, count(*) / sum(1 / greatest(speed_kmh, 1e-3)) AS v, count(DISTINCT track_id) AS distinct_vehicles FROM seg GROUP BY 1)
      SELECT interval, interval * 15e0 AS interval_start_s, round(k, 6) AS density_veh_per_km, round(v, 6) AS space_mean_speed_kmh, round(k * v, 6) AS flow_veh_per_h, round(100 * least(1, frames / 75e0), 6) AS occupancy_pct, distinct_vehicles FROM c JOIN v USING (interval)""",
    "i11_time_space": GR + "SELECT track_id, arg_min(mode, frame) AS mode, CAST(count(*) AS INT) AS n, round(sum(round(frame / 5e0, 2)), 2) AS sum_t, round(max(s_m), 1) AS max_s, CAST(count(*) FILTER (speed_kmh IS NULL) AS INT) AS unknown_v FROM near WHERE mode <> 'pedestrian' GROUP BY 1 HAVING count(*) >= 3 AND max(s_m) - min(s_m) >= 25",
    "i12_edie_cells": GR + f"SELECT segment, segment_start_m, interval, interval_start_s, lane, {r6('flow_veh_per_h', 'density_veh_per_km', 'speed_kmh')}, n_vehicles FROM cells",
    "i13_fd_validity": GR + f"SELECT segment, lane, cells, {r6('corr', 'median_speed_kmh', 'p95_density')} FROM (SELECT segment, lane, count(*) AS cells, corr(density_veh_per_km, speed_kmh) AS corr, median(speed_kmh) AS median_speed_kmh, quantile_cont(density_veh_per_km, 0.95) AS p95_density FROM cells WHERE lane BETWEEN -6 AND 6 GROUP BY 1, 2) WHERE cells >= 3 AND corr IS NOT NULL AND NOT isnan(corr)",
    "i14_smoothed_offsets": GR + "SELECT track_id, frame, round(lateral_offset_m, 6) AS lateral_offset_m, CAST(floor(lateral_offset_m / 3.2::DOUBLE) AS INT) AS raw_lane FROM offs",
    "i14_held_lanes": HELD + "SELECT track_id, frame, cur AS lane, ch AS lane_change FROM f",
    "i15_lane_changes": HELD + CHANGES,
    "k2_overlay_chunks": GR + "SELECT CAST(floor(frame / 50e0) AS INT) AS chunk, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, count(DISTINCT track_id) AS n_vehicles FROM ground WHERE NOT parked GROUP BY 1",
    "k6_track_detail": GR + "SELECT track_id, arg_min(mode, frame) AS mode, min(frame) AS f0, max(frame) AS f1, round(median(speed_kmh), 6) AS median_kmh, round(max(speed_kmh), 6) AS max_kmh FROM ground GROUP BY 1",
    "k10_od_heat": MV + " SELECT origin, destination, count(*) AS count, round(count(*) / (max(count(*)) OVER ())::DOUBLE, 6) AS heat FROM mv GROUP BY 1, 2",
    "k11_top_movements": MV + " SELECT origin, destination, turn, count(*) AS count, round(median(travel_m), 6) AS median_travel_m, round(1e2 * count(*) / (SELECT count(*) FROM mv), 6) AS share_pct FROM mv GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 8",
    "k12_pce_share": MV + f", m AS (SELECT mode, coalesce(n, 0) AS n, coalesce(n, 0) * {_PCE} AS pce FROM (SELECT unnest({list(MODES)!r}) AS mode) LEFT JOIN (SELECT mode, count(*) AS n FROM mv GROUP BY 1) USING (mode)) SELECT mode, round(1e2 * n / sum(n) OVER (), 6) AS share_pct, round(1e2 * pce / sum(pce) OVER (), 6) AS pce_share_pct FROM m",
    "k13_approach_pivot": MV + f" SELECT interval, {', '.join(f'''count(*) FILTER (origin = '{r}') AS {c}''' for r, c in _LOWER.items())}, count(*) AS total FROM mv WHERE NOT (interval * 6e1 + 60 > (SELECT max(f1) / 5e0 FROM movements)) GROUP BY 1",
    "k14_lane_pivot": MV + f" SELECT origin, lane_in, {', '.join(f'''count(*) FILTER (mode = '{m}') AS {m.lower()}''' for m in MODES)} FROM mv WHERE lane_in IS NOT NULL GROUP BY 1, 2",
    "k15_slowest_bin": GR + "SELECT bin, round(mean_speed_kmh, 6) AS mean_speed_kmh, n_samples FROM profile WHERE bin > (SELECT min(bin) FROM profile) AND bin < (SELECT max(bin) FROM profile) ORDER BY profile.mean_speed_kmh, bin LIMIT 1",
    "k16_peak_queue": GR + "SELECT frame, queue_vehicles, round(queue_length_m, 6) AS queue_length_m FROM queues ORDER BY queue_vehicles DESC, frame LIMIT 1",
    "k18_overlay_filter": GR + "SELECT frame, mode, count(*) AS live FROM ground WHERE coalesce(speed_kmh, 0) >= 10 GROUP BY 1, 2",
    "k17_overlapping": GR + "SELECT * FROM (SELECT track_id, min(frame) AS f0, max(frame) AS f1 FROM ground GROUP BY 1) WHERE f0 <= 150 AND f1 >= 100",
    "k19_trails": GR + "SELECT track_id, frame, count(*) OVER w AS n, round(avg(world_x_m) OVER w, 6) AS mean_x, round(avg(world_y_m) OVER w, 6) AS mean_y FROM ground WHERE speed_kmh > 5 WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "r3_draw_order": f"WITH tracks AS ({duck(TRACKS)}) SELECT frame, track_id, CAST(row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, track_id) AS INT) AS place FROM tracks",
    "r5_waiting": GR + "SELECT frame, count(*) FILTER (speed_kmh < 6 AND NOT parked) AS waiting, count(*) FILTER (NOT parked) AS shown FROM ground GROUP BY 1",
    "r2_cumulative_modes": GR + "SELECT mode, frame, new, CAST(sum(new) OVER (PARTITION BY mode ORDER BY frame) AS BIGINT) AS seen FROM (SELECT mode, frame, count(*) AS new FROM (SELECT track_id, min(frame) AS frame, min(mode) AS mode FROM ground GROUP BY 1) GROUP BY 1, 2)",
}
