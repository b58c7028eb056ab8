"""Queries over the corridors of two recordings at once. QUERIES and ORACLES by name.

The network is surrogate: every other track is of clip c0 or c1, and a third of the tracks each goes A to B, C to D, and A to D, which has no corridor.
The SQL takes each corridor by itself, with the polyline as literals; the queries take all of them in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.expressions import line_length
from roadweave.operators import bundles as B
from roadweave.operators.network import Network
from roadweave.plans.adapters import FPS, GROUND, LINE, duck, ground, projected_sql
from roadweave.plans.aggregate_queries import CHANGES, GR, N_SEG, held_sql, r6, rounded
from roadweave.plans.aggregate_queries import LOW as _LOW
from roadweave.plans.aggregate_queries import ORACLES as ONE
from roadweave.plans.reasoning_queries import CR, stop_sql
from roadweave.plans.reasoning_queries import ORACLES as EVIDENCE

KEYS = ("clip",)
#: Two streets near where the tracks begin, so that many pass their middles.
MAIN, SOUTH = [(22.0, 0.0), (55.0, 2.5), (90.0, 0.0)], [(22.0, -8.0), (90.0, -8.0)]
PAIRS = {("A", "B"): (MAIN, "track_id % 3 = 0"), ("C", "D"): (SOUTH, "track_id % 3 = 1")}


def rows(spark: SparkSession, d: str) -> DataFrame:
    return ground(spark, d).withColumn("clip", F.concat(F.lit("c"), (F.col("track_id") % 2).cast("string")))


def network(spark: SparkSession, d: str) -> Network:
    """Gates A to D of each clip, a movement per track, and the two polylines as centrelines of each clip."""
    g = rows(spark, d)
    third = F.col("track_id") % 3
    aggs = [F.min_by("mode", "frame").alias("mode"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.lit(60.0).alias("travel_m"), F.lit(None).cast("int").alias("lane_in")]
    mv = g.groupBy("clip", "track_id").agg(*aggs)
    mv = mv.withColumns({"origin": F.when(third == 1, "C").otherwise("A"), "destination": F.when(third == 0, "B").otherwise("D"), "turn": F.lit("through")})
    clips = g.select("clip").distinct()
    nodes = F.array(*(F.struct(F.lit(o).alias("origin"), F.lit(e).alias("destination"), F.lit(k).alias("node"), F.lit(x).alias("x"), F.lit(y).alias("y")) for (o, e), (line, _) in PAIRS.items() for k, (x, y) in enumerate(line)))
    gates = clips.withColumn("name", F.explode(F.array(*map(F.lit, "ABCD"))))
    return Network(gates, mv, clips.withColumn("n", F.explode(nodes)).select("clip", "n.*"))


def _moving(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("NOT parked")


def _insights(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return B.insights(_moving(spark, d), network(spark, d), FPS, 10.0, 14.0, keys=KEYS, stop_kmh=9.0)


def k3_speed_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_insights(spark, d)["speed_profiles"])


def k3_fundamental(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_insights(spark, d)["fundamental"])


def k3_queues(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_insights(spark, d)["queues"].select("clip", "approach", "frame", "t_s", "queue_vehicles", "queue_length_m", "queue_head_s_m"))


def k3_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_insights(spark, d)["totals"])


def _flow(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return B.flow(_moving(spark, d), network(spark, d), FPS, sample_hz=FPS, keys=KEYS)


def k4_time_space(spark: SparkSession, d: str) -> DataFrame:
    t = _flow(spark, d)["time_space"]
    total = F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 2).alias("sum_t")
    return t.select("clip", "corridor", "track_id", "mode", F.size("t").alias("n"), total, F.round(F.array_max("s"), 1).alias("max_s"), F.size(F.filter("v", lambda x: x.isNull())).alias("unknown_v"))


def k4_cells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_flow(spark, d)["cells"])


def k4_validity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_flow(spark, d)["validity"])


def k4_lane_changes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_flow(spark, d)["lane_changes"])


def _reasoning(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return B.reasoning(rows(spark, d), network(spark, d), FPS, keys=KEYS)


def j7_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["signals"])


def j7_shockwaves(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["shockwaves"])


def j7_obstructions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["obstructions"])


def j7_gap_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["gap_acceptance"])


def k5_desire_deviation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["desire_deviation"])


def k5_lane_structure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["lane_structure"].drop("mode_offsets_m"))


def k5_complementarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["signal_complementarity"])


def k5_periodicity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reasoning(spark, d)["signal_periodicity"])


QUERIES = {f.__name__: f for f in (k3_speed_profiles, k3_fundamental, k3_queues, k3_totals, k4_time_space, k4_cells, k4_validity, k4_lane_changes, j7_signals, j7_shockwaves, j7_obstructions, j7_gap_acceptance, k5_desire_deviation, k5_lane_structure, k5_complementarity, k5_periodicity)}

_GROUND = f"ground AS ({duck(GROUND)})"


def taken(sql: str, line: list[tuple[float, float]], tracks: str) -> str:
    """A corridor's SQL over another polyline and the tracks that a condition names."""
    low = line_length(line) / 2 - 30
    sql = sql.replace(projected_sql("world_x_m", "world_y_m", LINE), projected_sql("world_x_m", "world_y_m", line)).replace(_GROUND, f"ground AS (SELECT * FROM ({duck(GROUND)}) WHERE {tracks})")
    sql = sql.replace(f"floor(s_m / 50), 0), {N_SEG - 1})", f"floor(s_m / 50), 0), {max(1, int(line_length(line) // 50)) - 1})")
    return sql.replace(repr(_LOW + 60), repr(low + 60)).replace(repr(_LOW), repr(low))


def all_corridors(sql: str, own: bool = True, moving: bool = True, corridor: str = "'{clip}/{o}->{d}' AS corridor") -> str:
    """The SQL over each corridor of each clip: its own tracks, or all of the clip's."""
    parts = []
    for clip in (0, 1):
        for (o, d), (line, members) in PAIRS.items():
            where = f"track_id % 2 = {clip}" + f" AND {members}" * own + " AND NOT parked" * moving
            parts.append(f"SELECT 'c{clip}' AS clip, {corridor.format(clip=f'c{clip}', o=o, d=d)}, * FROM ({taken(sql.replace('AT_HALF', repr(line_length(line) / 2) + '::DOUBLE'), line, where)})")
    return "\nUNION ALL ".join(parts)


STOPS = all_corridors(stop_sql("AT_HALF"))
CROSSED = f"WITH cr AS (SELECT corridor AS stream, track_id AS vehicle, mode, t_s FROM ({STOPS}))"
#: Each clip's busiest corridor and the next, both of other origins.
GAPS = (
    CROSSED
    + f""", g AS ({duck(GROUND)}), n AS (SELECT 'c' || track_id % 2 AS clip, track_id % 3 AS k, count(DISTINCT track_id) AS n FROM g WHERE track_id % 3 < 2 GROUP BY ALL),
  r AS (SELECT clip, clip || CASE k WHEN 0 THEN '/A->B' ELSE '/C->D' END AS corridor, row_number() OVER (PARTITION BY clip ORDER BY n DESC, k) AS rank FROM n),
  p AS (SELECT a.corridor AS major, b.corridor AS minor, b.corridor || ' vs ' || a.corridor AS stream FROM r a JOIN r b USING (clip) WHERE a.rank = 1 AND b.rank = 2),
  ma AS (SELECT p.stream, t_s, vehicle FROM cr JOIN p ON cr.stream = major), mi AS (SELECT p.stream, t_s, vehicle FROM cr JOIN p ON cr.stream = minor),
  ac AS (SELECT * FROM (SELECT stream, vehicle, t_s, (SELECT min(t_s) FROM ma WHERE ma.stream = mi.stream AND ma.t_s >= mi.t_s) - (SELECT max(t_s) FROM ma WHERE ma.stream = mi.stream AND ma.t_s < mi.t_s) AS gap_s FROM mi) WHERE gap_s IS NOT NULL),
  ga AS (SELECT stream, t_s AS g0, lead(t_s) OVER (PARTITION BY stream ORDER BY t_s, vehicle) AS g1 FROM ma),
  wa AS (SELECT track_id AS vehicle, min(frame) / 5e0 AS wait_s FROM g WHERE speed_kmh < 6 GROUP BY 1),
  re AS (SELECT ac.stream, g1 - g0 AS gap_s FROM ac JOIN wa USING (vehicle) JOIN ga ON ga.stream = ac.stream AND g0 >= wait_s AND g1 <= t_s)
SELECT stream, n_accepted, {r6('median_accepted_gap_s', 'p15_accepted_gap_s')}, coalesce(n_rejected, 0) AS n_rejected, {r6('median_rejected_gap_s', 'p85_rejected_gap_s')}, CASE WHEN n_rejected >= 3 THEN round(5e-1 * (p15_accepted_gap_s + p85_rejected_gap_s), 6) END AS critical_gap_s
FROM (SELECT stream, count(*) AS n_accepted, median(gap_s) AS median_accepted_gap_s, quantile_cont(gap_s, 0.15) AS p15_accepted_gap_s FROM ac GROUP BY 1)
LEFT JOIN (SELECT stream, count(*) AS n_rejected, median(gap_s) AS median_rejected_gap_s, quantile_cont(gap_s, 0.85) AS p85_rejected_gap_s FROM re GROUP BY 1) USING (stream)"""
)
_CENSUS = GR + """SELECT track_id, arg_min(mode, frame) AS mode, median(abs(offset_m)) AS lat, median(s_m) AS along, min(frame) AS f0, max(frame) AS f1 FROM pr WHERE parked GROUP BY 1"""
_CENSUS = all_corridors(_CENSUS, own=False, moving=False)


def _by_clip(sql: str) -> str:
    """A streams' SQL over one clip's crossings at a time."""
    own = lambda k: f"WITH cr AS (SELECT corridor AS stream, track_id AS vehicle, mode, t_s FROM ({STOPS}) WHERE clip = 'c{k}')"
    return "\nUNION ALL ".join(f"SELECT 'c{k}' AS clip, * FROM ({sql.replace(CR, own(k))})" for k in (0, 1))


ORACLES = {
    "k3_speed_profiles": all_corridors(ONE["i6_speed_profile"]),
    "k3_fundamental": all_corridors(ONE["i10_fundamental_diagram"]),
    "k3_queues": all_corridors(ONE["i9_queue_lengths"], own=False, corridor="'{o}' AS approach"),
    "k3_totals": f"SELECT 'c' || track_id % 2 AS clip, count(DISTINCT track_id) FILTER (NOT parked) AS tracks_moving, round((max(frame) FILTER (NOT parked) + 1) / 5e0, 6) AS duration_s, count(DISTINCT track_id) AS movements_assigned FROM ({duck(GROUND)}) GROUP BY 1",
    "k4_time_space": all_corridors(ONE["i11_time_space"]),
    "k4_cells": f"SELECT * FROM ({all_corridors(ONE['i12_edie_cells'])}) WHERE lane BETWEEN -3 AND 2",
    "k4_validity": all_corridors(ONE["i13_fd_validity"].replace("lane BETWEEN -6 AND 6", "lane BETWEEN -3 AND 2 AND n_vehicles >= 3").replace("cells >= 3 AND corr", "cells >= 6 AND corr")),
    "k4_lane_changes": f"SELECT * FROM ({all_corridors(held_sql('32e-1', '7e-1', 5) + CHANGES)}) WHERE n_vehicles > 0",
    "j7_signals": EVIDENCE["j3_signals"].replace(CR, CROSSED),
    "j7_shockwaves": all_corridors(EVIDENCE["j8_shockwave"].replace("v < 40", "v < 15")),
    "j7_obstructions": f"""SELECT clip, track_id, mode, corridor, round(along, 6) AS distance_along_m, round(lat, 6) AS lateral_offset_m, round((f1 - f0 + 1) / 5e0, 6) AS dwell_s, round(f0 / 5e0, 6) AS start_s, CASE WHEN lat <= 3.5 THEN 'in-lane' ELSE 'kerbside' END AS obstruction
      FROM (SELECT * FROM ({_CENSUS}) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY lat, corridor) = 1) WHERE (f1 - f0 + 1) / 5e0 >= 20 AND lat <= 7""",
    "j7_gap_acceptance": GAPS,
    "k5_desire_deviation": all_corridors(EVIDENCE["j5_desire_deviation"]),
    "k5_lane_structure": all_corridors(EVIDENCE["j11_lane_verdict"]),
    "k5_complementarity": _by_clip(EVIDENCE["j10_complementarity"]),
    "k5_periodicity": EVIDENCE["j9_periodicity"].replace(CR, CROSSED),
}
