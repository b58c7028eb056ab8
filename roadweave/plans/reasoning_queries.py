"""Queries that gather evidence. QUERIES and ORACLES by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import reasoning as R
from roadweave.plans.adapters import FPS, LINE, duck, ground, projected_sql, view
from roadweave.plans.aggregate_queries import GR, cells, r6, rounded

#: A stream per event type, of all events. Those of signalled streams wait for the next green part, the first half of each minute.
CROSSINGS = """
SELECT event_type AS stream, event_id AS vehicle,
       CASE WHEN event_type IN ('view', 'purchase') THEN event_id * 4e-1 ELSE floor(event_id / 150e0) * 60e0 + (event_id % 150) * 19e-2 END + (event_id % 17) / 1e2 AS t_s,
       CASE user_id % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'motorcycle' ELSE 'bus' END AS mode
FROM EVENTS
"""
LINE2 = [(40.0, -8.0), (360.0, -8.0)]


def crossings(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, CROSSINGS)


def j1_congestion_regions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.congestion_regions(cells(spark, d), congested_kmh=40.0, min_cells=2))


def j2_stopline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.stopline_crossings(ground(spark, d), LINE, FPS, at_m=60.0))


def j3_cycles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.discharge_cycles(crossings(spark, d)))


def j3_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.signal_performance(crossings(spark, d)))


def _minor_major(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = crossings(spark, d)
    minor = base.where("stream = 'purchase'").withColumn("wait_s", F.col("t_s") - 5 - F.col("vehicle") % 13)
    return minor.withColumn("stream", F.lit("junction")), base.where("stream = 'view'").withColumn("stream", F.lit("junction"))


def j4_accepted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.accepted_gaps(*_minor_major(spark, d)))


def j4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.rejected_gaps(*_minor_major(spark, d)))


def j4_critical_gap(spark: SparkSession, d: str) -> DataFrame:
    minor, major = _minor_major(spark, d)
    return rounded(R.critical_gap(R.accepted_gaps(minor, major), R.rejected_gaps(minor, major)))


def j5_desire_deviation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.desire_deviation(ground(spark, d), LINE))


def j6_obstructions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.obstruction_census(ground(spark, d), {"main": LINE, "south": LINE2}, FPS, min_dwell_s=5.0))


def j6_over_holes(spark: SparkSession, d: str) -> DataFrame:
    """Parked tracks whose places are unknown in every third frame, the first ones too: dwell counts all frames."""
    rows = ground(spark, d).withColumn("world_x_m", F.when(F.col("frame") % 3 > 0, F.col("world_x_m")))
    return rounded(R.obstruction_census(rows, {"main": LINE, "south": LINE2}, FPS, min_dwell_s=5.0))


def j8_shock_fronts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.shock_fronts(cells(spark, d), 40.0))


def j8_shockwave(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.shockwave(R.shock_fronts(cells(spark, d), 40.0)))


def j9_periodicity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.periodicity(crossings(spark, d)))


def j10_complementarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.complementarity(crossings(spark, d)))


def j11_lane_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.lane_density(ground(spark, d), LINE).drop("peak"))


def j11_lane_structure(spark: SparkSession, d: str) -> DataFrame:
    return R.lane_structure(R.lane_density(ground(spark, d), LINE)).select("n_lanes", F.round(F.array_min("mode_offsets_m"), 6).alias("first_m"), F.round(F.array_max("mode_offsets_m"), 6).alias("last_m"))


def j11_lane_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.lane_verdict(R.lane_density(ground(spark, d), LINE)).drop("mode_offsets_m"))


def _gaps(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    minor, major = _minor_major(spark, d)
    modes = minor.select("vehicle", "mode")
    a, r = R.accepted_gaps(minor, major).withColumn("accepted", F.lit(True)), R.rejected_gaps(minor, major).withColumn("accepted", F.lit(False))
    both = a.select("vehicle", "gap_s", "accepted").unionByName(r.select("vehicle", "gap_s", "accepted"))
    return both.join(modes, "vehicle").withColumn("stream", F.concat_ws("/", *keys) if keys else F.lit("all"))


def j12_raff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.raff_critical_gap(_gaps(spark, d, [])))


def j13_raff_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.raff_critical_gap(_gaps(spark, d, ["mode"])))


QUERIES = {f.__name__: f for f in (j1_congestion_regions, j2_stopline, j3_cycles, j3_signals, j4_accepted, j4_rejected, j4_critical_gap, j5_desire_deviation, j6_obstructions, j6_over_holes, j8_shock_fronts, j8_shockwave, j9_periodicity, j10_complementarity, j11_lane_density, j11_lane_structure, j11_lane_verdict, j12_raff, j13_raff_by_mode)}

CR = f"WITH cr AS ({duck(CROSSINGS)})"
CY = CR + """, h AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY stream ORDER BY t_s, vehicle) AS hw FROM cr), pl AS (SELECT *, CAST(sum(CASE WHEN hw > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t_s, vehicle) AS BIGINT) AS platoon FROM h),
pp AS (SELECT *, row_number() OVER (PARTITION BY stream, platoon ORDER BY t_s, vehicle) AS place, count(*) OVER (PARTITION BY stream, platoon) AS n FROM pl), g AS (SELECT stream, platoon, min(t_s) AS start_s, max(t_s) AS end_s, count(*) AS vehicles, avg(hw) FILTER (place > 1 AND (n <= 4 OR place > 3)) AS steady, median(hw) FILTER (n > 4 AND place > 3) AS med, max(hw) FILTER (place = 2) AS first_hw FROM pp GROUP BY 1, 2),
cy AS (SELECT stream, platoon, start_s, end_s, vehicles, end_s - start_s AS green_s, lead(start_s) OVER w - end_s AS red_s, lead(start_s) OVER w - start_s AS cycle_s, CASE WHEN vehicles >= 3 THEN 3600 / steady END AS saturation_flow_veh_h, CASE WHEN vehicles >= 4 THEN first_hw - coalesce(med, 0) END AS startup_loss_s FROM g WINDOW w AS (PARTITION BY stream ORDER BY platoon))
"""
GA = CR + """, mi AS (SELECT *, t_s - 5 - vehicle % 13 AS wait_s FROM cr WHERE stream = 'purchase'), ma AS (SELECT * FROM cr WHERE stream = 'view'), ga AS (SELECT t_s AS g0, lead(t_s) OVER (ORDER BY t_s, vehicle) AS g1 FROM ma),
acc AS (SELECT vehicle, t_s, mode, (SELECT min(t_s) FROM ma WHERE ma.t_s >= mi.t_s) - (SELECT max(t_s) FROM ma WHERE ma.t_s < mi.t_s) AS gap_s FROM mi), ac AS (SELECT * FROM acc WHERE gap_s IS NOT NULL), re AS (SELECT vehicle, mode, g1 - g0 AS gap_s FROM mi JOIN ga ON g0 >= wait_s AND g1 <= t_s)
"""


def _raff(key: str) -> str:
    return GA + f""", gs AS (SELECT {key} AS stream, true AS accepted, gap_s FROM ac UNION ALL SELECT {key}, false, gap_s FROM re), n AS (SELECT stream, count(*) FILTER (accepted) AS na, count(*) FILTER (NOT accepted) AS nr, (greatest(least(quantile_cont(gap_s, 0.99), 20), 2) - 1e-1) / 399 AS step FROM gs GROUP BY 1 HAVING na >= 5 AND nr >= 5),
      ce AS (SELECT gs.stream, greatest(ceil((gap_s - 1e-1) / step), 0)::INT AS cell, count(*) FILTER (accepted) AS a, count(*) FILTER (NOT accepted) AS r FROM gs JOIN n USING (stream) GROUP BY ALL),
      gr AS (SELECT stream, cell, na, nr, 1e-1 + cell * step AS t, coalesce(sum(a) OVER w, 0) / na::DOUBLE AS fa, 1 - coalesce(sum(r) OVER w, 0) / nr::DOUBLE AS fr FROM (SELECT *, unnest(range(400))::INT AS cell FROM n) LEFT JOIN ce USING (stream, cell) WINDOW w AS (PARTITION BY stream ORDER BY cell ROWS UNBOUNDED PRECEDING)),
      cx AS (SELECT *, fa - fr AS d, lag(fa - fr) OVER (PARTITION BY stream ORDER BY cell) AS d0, lag(t) OVER (PARTITION BY stream ORDER BY cell) AS t0 FROM gr)
      SELECT stream, round(arg_min(t0 + (t - t0) * (-d0 / (d - d0)), cell), 6) AS critical_gap_s, min(na) AS n_accepted, min(nr) AS n_rejected FROM cx WHERE d0 < 0 AND d >= 0 AND fa > 0.02 AND fr > 0.02 GROUP BY 1"""


_COLL = GR + """, cc AS (SELECT segment, interval, sum(flow_veh_per_h) AS q, sum(density_veh_per_km) AS k, avg(speed_kmh) AS v, min(segment_start_m) AS seg_m, min(interval_start_s) AS t_s FROM cells GROUP BY 1, 2),
fr AS (SELECT a.segment, a.interval, a.seg_m, a.t_s, a.q AS q_up, b.q AS q_down, a.k AS k_up, b.k AS k_down, (b.q - a.q) / (b.k - a.k) / 3.6::DOUBLE AS u_mps FROM cc a JOIN cc b ON b.interval = a.interval AND b.segment = a.segment + 1 WHERE (a.v < 40) <> (b.v < 40) AND abs(b.k - a.k) >= 1e-6), fronts AS (SELECT * FROM fr WHERE abs(u_mps) <= 30)
"""


def stop_sql(at: str) -> str:
    """track_id, t_s, mode, median_speed_kmh of each vehicle that reaches the place `at` on the corridor."""
    return GR + f""", l AS (SELECT *, lag(s_m) OVER w AS s0, lag(frame) OVER w AS f0 FROM near WHERE mode <> 'pedestrian' WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
      hit AS (SELECT * FROM l WHERE s_m >= {at} QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame) = 1)
      SELECT track_id, (f0 + CASE WHEN s_m = s0 THEN 0 ELSE ({at} - s0) / (s_m - s0) END * (hit.frame - f0)) / 5e0 AS t_s, m.mode, m.med AS median_speed_kmh
      FROM hit JOIN (SELECT track_id, arg_min(mode, frame) AS mode, median(speed_kmh) AS med FROM l GROUP BY 1) m USING (track_id) WHERE f0 IS NOT NULL"""


def census_sql(known: str) -> str:
    """Parked tracks by their nearest of two corridors, over the places of the rows that are known."""
    out = ("CASE WHEN {0} THEN abs({1}offset_m) END", "CASE WHEN {0} THEN {1}s_m END")
    near, far = (", ".join(f"median({x.format(known, p)})" for x in out) for p in ("", "p2."))
    return GR + f""", pk AS (SELECT track_id, 0 AS k, 'main' AS corridor, {near.replace(", median(CASE", " AS lat, median(CASE")} AS along, min(frame) AS f0, max(frame) AS f1, arg_min(mode, frame) AS mode FROM pr WHERE parked GROUP BY 1
      UNION ALL SELECT track_id, 1, 'south', {far}, min(frame), max(frame), arg_min(mode, frame) FROM (SELECT *, {projected_sql('world_x_m', 'world_y_m', LINE2)} AS p2 FROM ground WHERE parked) GROUP BY 1)
      SELECT track_id, mode, corridor, round(along, 6) AS distance_along_m, round(lat, 6) AS lateral_offset_m, round((f1 - f0 + 1) / 5e0, 6) AS dwell_s, round(f0 / 5e0, 6) AS start_s, CASE WHEN lat <= 3.5 THEN 'in-lane' ELSE 'kerbside' END AS obstruction
      FROM (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY lat, k) = 1) WHERE (f1 - f0 + 1) / 5e0 >= 5 AND lat <= 7"""


#: The density's peaks, merged where they are closer than 0.55 of a lane to the last that was kept.
_KEPT = (
    "WITH RECURSIVE"
    + GR[4:]
    + """, f AS (SELECT round_even(offset_m * 100, 0)::INT AS o, count(*) AS c FROM pr WHERE abs(offset_m) <= 10 GROUP BY 1), de AS (SELECT g, g * 1e-1 - 10 AS x, sum(c * exp(-5e-1 * ((g * 1e-1 - 10 - o / 1e2) / 3.5e-1) ** 2)) AS density FROM f CROSS JOIN (SELECT unnest(range(201))::INT AS g) GROUP BY g),
      pk AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT x, density, max(density) OVER (ORDER BY g ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m, avg(density) OVER () AS a FROM de) WHERE density = m AND density > 1.15::DOUBLE * a),
      ke AS (SELECT i, x, [x] AS p FROM pk WHERE i = 1 UNION ALL SELECT pk.i, pk.x, CASE WHEN pk.x - list_last(p) >= 55e-2 * 32e-1 THEN list_append(p, pk.x) ELSE p END FROM ke JOIN pk ON pk.i = ke.i + 1), en AS (SELECT p FROM ke ORDER BY i DESC LIMIT 1)
"""
)
#: Slow cells that reach each other by steps of one, with the least of them as their region.
_REGIONS = (
    "WITH RECURSIVE"
    + GR[4:]
    + """, cc AS (SELECT segment, interval, avg(speed_kmh) AS v, avg(density_veh_per_km) AS k, min(segment_start_m) AS seg_m, min(interval_start_s) AS t_s FROM cells GROUP BY 1, 2), sl AS (SELECT * FROM cc WHERE v < 40),
      re AS (SELECT interval * 100000 + segment AS region, segment, interval FROM sl UNION SELECT region, b.segment, b.interval FROM re JOIN sl b ON abs(b.segment - re.segment) + abs(b.interval - re.interval) = 1),
      own AS (SELECT sl.*, region FROM sl JOIN (SELECT segment, interval, min(region) AS region FROM re GROUP BY 1, 2) USING (segment, interval)),
      w AS (SELECT region, count(*) AS cells, min(t_s) AS start_s, max(t_s) AS end_s, max(seg_m) - min(seg_m) AS extent_m, min(v) AS min_v, max(k) AS max_k FROM own GROUP BY 1 HAVING count(*) >= 2),
      o AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY region ORDER BY t_s, v, seg_m) = 1),
      ed AS (SELECT *, count(*) OVER (PARTITION BY region) AS m, first(t_s) OVER (PARTITION BY region ORDER BY e, t_s) AS turn FROM (SELECT region, t_s, min(seg_m) AS e FROM own GROUP BY 1, 2)),
      sp AS (SELECT region, CASE WHEN count(*) >= 3 THEN regr_slope(e, t_s) END AS whole, CASE WHEN min(m) >= 3 AND count(*) FILTER (t_s <= turn) >= 3 THEN regr_slope(e, t_s) FILTER (t_s <= turn) END AS stopping,
        CASE WHEN min(m) >= 3 AND count(*) FILTER (t_s >= turn) >= 3 THEN regr_slope(e, t_s) FILTER (t_s >= turn) END AS starting FROM ed GROUP BY 1)
"""
)
ORACLES = {
    "j1_congestion_regions": _REGIONS
    + """SELECT 'all' AS place, cells, round(seg_m, 6) AS origin_distance_m, round(t_s, 6) AS origin_time_s, round(v, 6) AS origin_speed_kmh, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(extent_m, 6) AS extent_m, round(min_v, 6) AS min_speed_kmh,
      round(max_k, 6) AS peak_density_veh_km, round(whole, 6) AS shockwave_mps, round(stopping, 6) AS stopping_wave_mps, round(starting, 6) AS starting_wave_mps, abs(t_s - (SELECT min(t_s) FROM cc)) < 1e-6 AS predates FROM w JOIN o USING (region) JOIN sp USING (region)""",
    "j11_lane_structure": _KEPT + "SELECT len(p)::INT AS n_lanes, round(p[1], 6) AS first_m, round(p[-1], 6) AS last_m FROM en",
    "j11_lane_verdict": _KEPT
    + """SELECT n_lanes, round(spacing, 6) AS spacing_m, round(mi, 6) AS modality_index, coalesce(spacing BETWEEN 2.4::DOUBLE AND 4.2::DOUBLE, false) AS lane_like_spacing, CASE WHEN coalesce(spacing BETWEEN 2.4::DOUBLE AND 4.2::DOUBLE, false) THEN CASE WHEN mi >= 2.2::DOUBLE THEN 'clear' ELSE 'weak' END WHEN mi >= 2.2::DOUBLE THEN 'single undifferentiated stream' ELSE 'absent' END AS lane_structure
      FROM (SELECT len(p)::INT AS n_lanes, list_median([p[k + 1] - p[k] for k in range(1, len(p))]) AS spacing FROM en), (SELECT (max(density) - min(density)) / greatest(avg(density), 1e-9) AS mi FROM de)""",
    "j2_stopline": f"SELECT track_id, round(t_s, 6) AS t_s, mode, round(median_speed_kmh, 6) AS median_speed_kmh FROM ({stop_sql('60')})",
    "j3_cycles": CY + f"SELECT stream, platoon, {r6('start_s', 'end_s')}, vehicles, {r6('green_s', 'red_s', 'cycle_s', 'saturation_flow_veh_h', 'startup_loss_s')} FROM cy",
    "j3_signals": CY + """, s AS (SELECT stream, CAST(sum(vehicles) AS BIGINT) AS crossings, count(*) AS platoons, stddev_pop(cycle_s) / greatest(avg(cycle_s), 1e-6) AS cycle_cov, count(cycle_s) AS nc, sum(green_s) FILTER (red_s IS NOT NULL) / greatest(sum(green_s + red_s), 1e-6) AS green_split, count(*) FILTER (vehicles >= 3) AS n_cycles,
      median(saturation_flow_veh_h) FILTER (vehicles >= 3) AS sat, median(startup_loss_s) FILTER (vehicles >= 3) AS loss, median(red_s) AS red, median(green_s) FILTER (vehicles >= 3) AS green FROM cy GROUP BY 1), v AS (SELECT *, CASE WHEN crossings < 8 THEN NULL WHEN platoons < 3 THEN false ELSE coalesce(nc >= 2 AND cycle_cov <= 0.25 AND green_split <= 0.8, false) END AS signalised FROM s)
      SELECT stream, crossings, platoons, round(cycle_cov, 6) AS cycle_cov, round(green_split, 6) AS green_split, signalised, CASE WHEN signalised THEN n_cycles END AS n_cycles, CASE WHEN signalised THEN round(sat, 6) END AS median_saturation_flow_veh_h, CASE WHEN signalised THEN round(loss, 6) END AS median_startup_loss_s, CASE WHEN signalised THEN round(red, 6) END AS median_red_s, CASE WHEN signalised THEN round(green, 6) END AS median_green_s FROM v""",
    "j4_accepted": GA + f"SELECT 'junction' AS stream, vehicle, {r6('t_s', 'gap_s')} FROM ac",
    "j4_rejected": GA + f"SELECT 'junction' AS stream, vehicle, {r6('gap_s')} FROM re",
    "j4_critical_gap": GA + f"""SELECT 'junction' AS stream, n_accepted, {r6('median_accepted_gap_s', 'p15_accepted_gap_s')}, n_rejected, {r6('median_rejected_gap_s', 'p85_rejected_gap_s')}, CASE WHEN n_rejected >= 3 THEN round(5e-1 * (p15_accepted_gap_s + p85_rejected_gap_s), 6) END AS critical_gap_s
      FROM (SELECT count(*) AS n_accepted, median(gap_s) AS median_accepted_gap_s, quantile_cont(gap_s, 0.15) AS p15_accepted_gap_s FROM ac), (SELECT count(*) AS n_rejected, median(gap_s) AS median_rejected_gap_s, quantile_cont(gap_s, 0.85) AS p85_rejected_gap_s FROM re)""",
    "j5_desire_deviation": GR + """SELECT samples, round(med, 6) AS median_offset_m, round(spread, 6) AS offset_spread_m, round(share, 6) AS straddle_share, CASE WHEN share >= 0.375::DOUBLE * 0.95 THEN 'none' WHEN share >= 0.375::DOUBLE * 0.6 THEN 'partial' ELSE 'good' END AS lane_discipline, abs(med) > 0.9 AS systematic_bias
      FROM (SELECT count(*) AS samples, median(offset_m) AS med, quantile_cont(offset_m, 0.85) - quantile_cont(offset_m, 0.15) AS spread, avg((abs(offset_m / 3.2::DOUBLE - round_even(offset_m / 3.2::DOUBLE, 0)) < 6e-1 / 3.2::DOUBLE)::INT) AS share FROM pr WHERE abs(offset_m) <= 14) WHERE samples >= 50""",
    "j6_obstructions": census_sql("TRUE"),
    "j6_over_holes": census_sql("frame % 3 > 0"),
    "j8_shock_fronts": _COLL + f"SELECT segment, interval, seg_m, t_s, {r6('q_up', 'q_down', 'k_up', 'k_down', 'u_mps')} FROM fronts",
    "j8_shockwave": _COLL + "SELECT n_fronts, round(m, 6) AS median_mps, round(a, 6) AS p25_mps, round(b, 6) AS p75_mps, round(s, 6) AS upstream_share, CASE WHEN m < -0.2 THEN 'upstream' WHEN m > 0.2 THEN 'downstream' ELSE 'stationary' END AS direction FROM (SELECT count(*) AS n_fronts, median(u_mps) AS m, quantile_cont(u_mps, 0.25) AS a, quantile_cont(u_mps, 0.75) AS b, avg((u_mps < 0)::INT) AS s FROM fronts) WHERE n_fronts >= 4",
    "j9_periodicity": CR + """, b AS (SELECT stream, min(t_s) AS t0, floor(max(t_s) - min(t_s))::INT + 1 AS len FROM cr GROUP BY 1 HAVING count(*) >= 20 AND max(t_s) - min(t_s) >= 75), sec AS (SELECT cr.stream, floor(t_s - t0)::INT AS s, count(*) AS c FROM cr JOIN b USING (stream) GROUP BY ALL),
      d AS (SELECT stream, s, coalesce(c, 0) AS c FROM (SELECT stream, unnest(range(len))::INT AS s FROM b) LEFT JOIN sec USING (stream, s)), e AS (SELECT *, c - avg(c) OVER (PARTITION BY stream) AS x FROM d), va AS (SELECT stream, sum(x * x) AS var FROM e GROUP BY 1),
      ac AS (SELECT a.stream, l.lag, sum(a.x * z.x) / any_value(var) AS ac FROM e a CROSS JOIN (SELECT unnest(range(25, 180))::INT AS lag) l JOIN e z ON z.stream = a.stream AND z.s = a.s + l.lag JOIN va ON va.stream = a.stream GROUP BY 1, 2), g AS (SELECT stream, max(ac) AS peak, arg_max(lag, round(ac, 12) * 1000000 - lag / 1e9) AS cycle_s, median(ac) AS band FROM ac GROUP BY 1)
      SELECT stream, cycle_s, round(peak, 6) AS peak, round(peak - band, 6) AS prominence, peak - band >= 0.25 AND peak > 0.2 AS periodic FROM g""",
    "j10_complementarity": CR + """, e AS (SELECT max(a) AS t0, min(b) AS t1 FROM (SELECT min(t_s) AS a, max(t_s) AS b FROM cr GROUP BY stream)), h AS (SELECT stream, floor((t_s - t0) / 2)::INT AS bin, count(*) AS c FROM cr, e WHERE t_s >= t0 AND t_s < t1 GROUP BY ALL),
      d AS (SELECT s.stream, b.bin, coalesce(c, 0) AS c FROM (SELECT DISTINCT stream FROM h) s CROSS JOIN (SELECT unnest(range(ceil((t1 - t0) / 2)::BIGINT))::INT AS bin FROM e) b LEFT JOIN h ON h.stream = s.stream AND h.bin = b.bin)
      SELECT first, second, round(r, 6) AS correlation, r < -0.15 AS alternating FROM (SELECT a.stream AS first, z.stream AS second, corr(a.c, z.c) AS r FROM d a JOIN d z ON a.bin = z.bin AND a.stream < z.stream GROUP BY 1, 2)""",
    "j11_lane_density": GR + ", f AS (SELECT round_even(offset_m * 100, 0)::INT AS o, count(*) AS c FROM pr WHERE abs(offset_m) <= 10 GROUP BY 1) SELECT g, round(g * 1e-1 - 10, 6) AS x_m, round(sum(c * exp(-5e-1 * ((g * 1e-1 - 10 - o / 1e2) / 3.5e-1) ** 2)), 6) AS density FROM f CROSS JOIN (SELECT unnest(range(201))::INT AS g) GROUP BY g",
    "j12_raff": _raff("'all'"),
    "j13_raff_by_mode": _raff("mode"),
}
