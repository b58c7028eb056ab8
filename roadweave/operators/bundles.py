"""All measures of all corridors at once, as one table by section. Corridors are data: plans do not grow with their number.

keys names the columns that tell recordings apart, () for one recording. Every table of a corridor has keys and corridor; a corridor's name holds the
values of its keys, so it is unique among recordings. Cells, crossings and gaps, which many sections read, are small and are computed once, when a bundle
is asked for; all else is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators import aggregates as A
from roadweave.operators import reasoning as R
from roadweave.operators.network import Network, described
from roadweave.storage import cut


def ranked_pairs(net: Network, corridors: DataFrame, keys: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """keys, origin, destination, corridor, n, rank: corridors by their real movements within a recording, the busiest first, ties by name."""
    by = [*keys, "origin", "destination"]
    n = A.counted(net.movements).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(corridors.select(*by, "corridor"), by)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("n"), "origin", "destination")))
    return out if top is None else out.where(F.col("rank") <= top)


def approaches(corridors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The corridor that stands for each approach: the first of its origin by name, which is now the approach's."""
    w = Window.partitionBy(*keys, "origin").orderBy("destination")
    return corridors.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "corridor").withColumnRenamed("origin", "corridor")


def insights(df: DataFrame, net: Network, fps: float, bin_m: float = 15.0, limit_kmh: float = 40.0, sample_s: float = 1.0, keys: Sequence[str] = (), stop_kmh: float = 5.0) -> dict[str, DataFrame]:
    """Approaches, flows, splits and volumes, and by corridor speed profiles and the fundamental diagram. df: rows of tracks that are not parked.

    Queues are by approach, along its first corridor, and count every vehicle on it, whole journey or not.
    """
    by = [*keys, "corridor"]
    table = A.corridor_table(net.centrelines, keys)
    rows = A.along(df, net.movements, table, keys)
    on = A.beside(df, approaches(table, keys), keys)
    return {
        "approaches": net.gates,
        "od": A.od_summary(net.movements, keys),
        "modal_split": A.modal_split(net.movements, keys),
        "lane_volumes": A.lane_volumes(net.movements, keys),
        "approach_volumes": A.approach_volumes(net.movements, fps, by=keys),
        "movement_counts": A.movement_counts(net.movements, fps, by=keys),
        "speed_profiles": A.speed_profile(rows, None, bin_m, limit_kmh, by),
        "fundamental": A.fundamental_diagram(rows, None, fps, by=by),
        "queues": A.queue_lengths(on, None, fps, stop_kmh, sample_s=sample_s, by=by).withColumnRenamed("corridor", "approach"),
        "network": described(net, keys),
        "totals": totals(df, net, fps, keys),
    }


def totals(df: DataFrame, net: Network, fps: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per recording: moving tracks, movements, and the seconds up to the last frame."""
    one = (lambda t: t) if keys else (lambda t: t.withColumn("_scene", F.lit(0)))
    by = list(keys) or ["_scene"]
    moving = one(df).groupBy(*by).agg(F.count_distinct("track_id").alias("tracks_moving"), ((F.max("frame") + 1) / fps).alias("duration_s"))
    assigned = one(net.movements).groupBy(*by).agg(F.count(F.lit(1)).alias("movements_assigned"))
    return moving.join(assigned, by, "left").withColumn("movements_assigned", F.coalesce("movements_assigned", F.lit(0))).drop("_scene")


def lane_changes(rows: DataFrame, fps: float, by: Sequence[str], lane_width_m: float = 3.2, hysteresis_m: float = 0.7, dwell_s: float = 1.0) -> DataFrame:
    """Lane changes of each corridor's vehicles among rows of aggregates.along."""
    offsets = A.smoothed_offsets(rows, None, fps, lane_width_m=lane_width_m, by=by)
    return A.lane_change_summary(rows, A.held_lanes(offsets, fps, lane_width_m, hysteresis_m, dwell_s, by), by)


def flow(df: DataFrame, net: Network, fps: float, sample_hz: float = 3.0, lanes: tuple[int, int] = (-3, 2), keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Time-space paths, cells of flow and density with their validity, and lane changes, by corridor."""
    by = [*keys, "corridor"]
    rows = A.along(df, net.movements, A.corridor_table(net.centrelines, keys), keys)
    cells = cut(A.edie_cells(rows, None, fps, by=by))
    return {
        "time_space": A.time_space(rows, None, fps, sample_hz, by=by),
        "cells": cells.where(F.col("lane").between(*lanes)),
        "validity": A.fd_validity(cells, by=by),
        "lane_changes": lane_changes(rows, fps, by),
    }


def crossings_of(rows: DataFrame, fps: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, stream, vehicle, mode, t_s: when each vehicle crosses the middle of its corridor."""
    found = R.stopline_crossings(rows, None, fps, by=[*keys, "corridor"])
    return found.select(*keys, F.col("corridor").alias("stream"), F.col("track_id").alias("vehicle"), "mode", "t_s")


def conflicts(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, stream, major, minor: each recording's busiest corridor, and the next of another origin, whose drivers must find gaps in it."""
    one = (lambda t: t) if keys else (lambda t: t.withColumn("_scene", F.lit(0)))
    by = list(keys) or ["_scene"]
    first = one(pairs).where("rank = 1").select(*by, F.col("origin").alias("_o"), F.col("corridor").alias("major"))
    other = one(pairs).join(first, by).where("rank > 1 AND origin <> _o").groupBy(*by, "major").agg(F.min_by("corridor", "rank").alias("minor"))
    return other.select(*keys, F.concat("minor", F.lit(" vs "), "major").alias("stream"), "major", "minor")


def gaps(rows: DataFrame, crossings: DataFrame, against: DataFrame, fps: float, keys: Sequence[str] = (), wait_kmh: float = 6.0) -> DataFrame:
    """stream, vehicle, mode, accepted, gap_s: the gaps in each conflict's major stream that minor vehicles took, and those that passed while they waited.

    A vehicle waits from when it is first slow; one never slow has rejected nothing. Only minor vehicles that took a gap are counted.
    """
    major = crossings.join(against.select(F.col("major").alias("stream"), F.col("stream").alias("_s")), "stream").drop("stream").withColumnRenamed("_s", "stream")
    minor = crossings.join(against.select(F.col("minor").alias("stream"), F.col("stream").alias("_s")), "stream").drop("stream").withColumnRenamed("_s", "stream")
    took = R.accepted_gaps(minor, major)
    slow = R.waits(rows, fps, wait_kmh, [*keys, "corridor"]).withColumnRenamed("corridor", "minor").join(against.select("minor", "stream"), "minor").select("stream", "vehicle", "wait_s")
    refused = R.rejected_gaps(took.select("stream", "vehicle", "t_s").join(slow, ["stream", "vehicle"]), major)
    both = took.select("stream", "vehicle", F.lit(True).alias("accepted"), "gap_s").unionByName(refused.select("stream", "vehicle", F.lit(False).alias("accepted"), "gap_s"))
    return both.join(minor.select("stream", "vehicle", "mode"), ["stream", "vehicle"])


def reasoning(df: DataFrame, net: Network, fps: float, top: int = 3, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Congestion, signals, gaps, lanes and obstructions. df: all rows, parked ones too.

    Congestion, shockwaves, signals and gaps are of each recording's `top` busiest corridors, the rest of all. Gaps are of the busiest corridor, as the
    busiest of another origin meets them: accepted, rejected and critical ones, pooled and by mode.
    """
    by = [*keys, "corridor"]
    table = A.corridor_table(net.centrelines, keys)
    pairs = cut(ranked_pairs(net, table, keys, top))
    rows = A.along(df.where(~F.coalesce("parked", F.lit(False))), net.movements, table, keys)
    busy = rows.join(pairs.select("corridor"), "corridor", "left_semi")
    cells, crossings = cut(A.edie_cells(busy, None, fps, by=by)), cut(crossings_of(busy, fps, keys))
    taken = cut(gaps(busy, crossings, conflicts(pairs, keys), fps, keys))
    named = taken.select(F.concat_ws("/", "stream", "mode").alias("stream"), "accepted", "gap_s")
    return {
        "congestion": R.congestion_regions(cells, "corridor"),
        "shockwaves": R.shockwave(R.shock_fronts(cells, by=by), by=by),
        "signals": R.signal_performance(crossings),
        "signal_periodicity": R.periodicity(crossings),
        "signal_complementarity": R.complementarity(crossings, by=keys),
        "gap_acceptance": R.critical_gap(taken.where("accepted"), taken.where("NOT accepted")),
        "critical_gap": R.raff_critical_gap(taken),
        "critical_gap_by_mode": R.raff_critical_gap(named),
        "desire_deviation": R.desire_deviation(rows, None, by=by),
        "lane_structure": R.lane_verdict(R.lane_density(rows, None, by=by), by=by),
        "lane_changes": lane_changes(rows, fps, by),
        "obstructions": R.obstruction_census(df, table, fps, keys=keys),
    }


def as_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """section, row (JSON text, unknowns null): all tables in one, to be served or written as they are."""
    parts = [t.select(F.lit(k).alias("section"), F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}).alias("row")) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
