"""Counts, volumes, profiles, queues and flow-density-speed cells.

Functions take movements (track_id, origin, destination, turn, mode, f0, f1, travel_m, lane_in) or ground tracks
(track_id, frame, world_x_m, world_y_m, speed_kmh, mode). A corridor is a polyline of literals, so rows are projected in the scan's stage; or it is data: with
line None, rows are those of along() or beside(), which have met their corridors already, and `by` names the columns that tell corridors (and recordings)
apart, so that one plan measures all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.expressions import Line, line_length, pce_of_mode, projected
from roadweave.params import MODES, FlowParams

FLOW = FlowParams()


def counted(movements: DataFrame) -> DataFrame:
    return movements.where("turn <> 'internal'")


def movement_counts(movements: DataFrame, fps: float, interval_s: float = 60.0, by_mode: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Turning counts by the interval in which a movement entered, with passenger-car equivalents."""
    keys = [*by, "interval", "origin", "destination", "turn", *["mode"] * by_mode]
    out = counted(movements).withColumn("interval", F.floor(F.col("f0") / fps / interval_s).cast("int")).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    pce = F.col("count") * pce_of_mode(F.col("mode")) if by_mode else F.col("count").cast("double")
    return out.withColumns({"interval_start_s": F.col("interval") * F.lit(interval_s), "pce": pce})


def approach_volumes(movements: DataFrame, fps: float, interval_s: float = 60.0, by: Sequence[str] = ()) -> DataFrame:
    """Vehicles that enter and leave by each approach and interval; the hourly rate is NULL for an interval that the recording cuts.

    One pass: each movement is a row for its origin and one for its destination.
    """
    end = movements.groupBy(*by).agg((F.max("f1") / fps).alias("clip_end_s"))
    rows = counted(movements).withColumn("interval", F.floor(F.col("f0") / fps / interval_s).cast("int"))
    rows = rows.select(*by, "interval", F.explode(F.array(F.struct(F.col("origin").alias("approach"), F.lit(1).alias("e"), F.lit(0).alias("l")), F.struct(F.col("destination").alias("approach"), F.lit(0).alias("e"), F.lit(1).alias("l")))).alias("x"))
    out = rows.groupBy(*by, "interval", F.col("x.approach").alias("approach")).agg(F.sum("x.e").alias("entering"), F.sum("x.l").alias("leaving"))
    out = out.withColumn("interval_start_s", F.col("interval") * F.lit(interval_s))
    out = out.join(end, list(by)) if by else out.crossJoin(F.broadcast(end))  # one row
    partial = F.col("interval_start_s") + interval_s > F.col("clip_end_s")
    return out.withColumns({"partial": partial, "entering_veh_per_h": F.when(~partial, F.rint(F.col("entering") / (interval_s / 3600.0)))}).drop("clip_end_s")


def od_summary(movements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = counted(movements).groupBy(*by, "origin", "destination", "turn").agg(F.count(F.lit(1)).alias("count"), F.median("travel_m").alias("median_travel_m"))
    return out.withColumn("share_pct", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def od_matrix(movements: DataFrame, names: list[str]) -> DataFrame:
    """Origins by destinations; the names are given, so the pivot needs no pass of its own."""
    return counted(movements).groupBy("origin").pivot("destination", names).count().fillna(0)


def lane_volumes(movements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = counted(movements).where("lane_in IS NOT NULL").groupBy(*by, "origin", "lane_in", "mode").agg(F.count(F.lit(1)).alias("count"))
    return out.withColumns({"lane_share_pct": 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(*by, "origin", "lane_in")), "pce": F.col("count") * pce_of_mode(F.col("mode"))})


def modal_split(movements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All modes, those without movements with a count of 0."""
    spark = movements.sparkSession
    scenes = movements.select(*by).distinct() if by else spark.range(1).select()
    modes = scenes.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    out = counted(movements).groupBy(*by, "mode").agg(F.count(F.lit(1)).alias("n"))
    out = modes.join(out, [*by, "mode"], "left").select(*by, "mode", F.coalesce("n", F.lit(0).cast("long")).alias("count"))
    return out.withColumns({"share_pct": 100.0 * F.col("count") / F.greatest(F.sum("count").over(Window.partitionBy(*by)), F.lit(1)), "pce_total": F.col("count") * pce_of_mode(F.col("mode"))})


def on_corridor(df: DataFrame, line: Line | None, max_offset_m: float = FLOW.max_offset_m) -> DataFrame:
    """Adds s_m and offset_m, where a line is given, and keeps rows within the offset."""
    if line is not None:
        p = projected(F.col("world_x_m"), F.col("world_y_m"), line)
        df = df.withColumn("_p", p).withColumns({"s_m": F.col("_p.s_m"), "offset_m": F.col("_p.offset_m")}).drop("_p")
    return df.where(F.abs("offset_m") <= max_offset_m)


def length_of(line: Line | None) -> Column:
    return F.col("length_m") if line is None else F.lit(line_length(line))


def corridor_table(centrelines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, origin, destination, corridor, segments, length_m: a row for each polyline of centrelines (keys, origin, destination, node, x, y).

    corridor is origin->destination, after the values of keys. A polyline of one node is none.
    """
    by = [*keys, "origin", "destination"]
    w = Window.partitionBy(*by).orderBy("node")
    step = centrelines.select(*by, "node", "x", "y", (F.row_number().over(w) - 1).alias("k"), (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy")).where("dx IS NOT NULL")
    step = step.withColumn("n", F.greatest(F.hypot("dx", "dy"), F.lit(1e-9)))
    step = step.withColumn("at", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    piece = F.struct("k", F.col("x").alias("ax"), F.col("y").alias("ay"), "dx", "dy", "n", "at")
    name = F.concat_ws("->", "origin", "destination")
    out = step.groupBy(*by).agg(F.sort_array(F.collect_list(piece)).alias("segments"), F.max(F.col("at") + F.col("n")).alias("length_m"))
    return out.select(*by, (F.concat_ws("/", *(F.col(k).cast("string") for k in keys), name) if keys else name).alias("corridor"), "segments", "length_m")


def met(rows: DataFrame) -> DataFrame:
    """Rows with segments, projected: s_m, offset_m and the direction along_x, along_y of the piece that s_m is on; the segments go."""
    p = projected(F.col("world_x_m"), F.col("world_y_m"), F.col("segments"))
    rows = rows.withColumn("_p", p).withColumns({"s_m": F.col("_p.s_m"), "offset_m": F.col("_p.offset_m")})
    own = F.filter("segments", lambda g: F.col("s_m") <= g["at"] + g["n"])
    rows = rows.withColumn("_g", F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at("segments", F.lit(-1))))
    return rows.withColumns({"along_x": F.col("_g.dx"), "along_y": F.col("_g.dy")}).drop("_p", "_g", "segments")


def along(df: DataFrame, movements: DataFrame, corridors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of tracks whose movement has a corridor, met with it: one join by track, whatever the number of corridors."""
    own = movements.join(corridors, [*keys, "origin", "destination"]).select(*keys, "track_id", "corridor", "segments", "length_m")
    return met(df.join(own, [*keys, "track_id"]))


def beside(df: DataFrame, corridors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows met with every corridor of their recording, a few for each; Spark broadcasts the corridors where their size allows it."""
    one = ["_scene"] if not keys else list(keys)
    mark = (lambda t: t) if keys else (lambda t: t.withColumn("_scene", F.lit(0)))
    return met(mark(df).join(mark(corridors.select(*keys, "corridor", "segments", "length_m")), one)).drop("_scene")


def of_movement(df: DataFrame, movements: DataFrame, origin: str, destination: str) -> DataFrame:
    members = movements.where((F.col("origin") == origin) & (F.col("destination") == destination)).select("track_id")
    return df.join(members, "track_id", "left_semi")


def speed_profile(df: DataFrame, line: Line | None, bin_m: float = 10.0, limit_kmh: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    rows = on_corridor(df.where("speed_kmh IS NOT NULL"), line).withColumn("bin", F.floor(F.col("s_m") / bin_m).cast("int"))
    aggs = [F.avg("s_m").alias("distance_m"), F.count(F.lit(1)).alias("n_samples"), F.count_distinct("track_id").alias("n_vehicles"), F.avg("speed_kmh").alias("mean_speed_kmh"), *(F.percentile("speed_kmh", F.lit(q)).alias(n) for q, n in ((0.5, "median_speed_kmh"), (0.15, "p15_speed_kmh"), (0.85, "p85_speed_kmh")))]
    if limit_kmh:
        aggs.append((100.0 * F.avg((F.col("speed_kmh") > limit_kmh).cast("double"))).alias("exceeding_share"))
    return rows.groupBy(*by, "bin").agg(*aggs)


def queue_lengths(df: DataFrame, line: Line | None, fps: float, stop_kmh: float = 5.0, link_gap_m: float = 12.0, sample_s: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """The contiguous run of slow vehicles from the smallest distance on, at every sampled frame with vehicles."""
    step = max(1, round(sample_s * fps))
    rows = on_corridor(df.where("speed_kmh IS NOT NULL").where(F.col("frame") % step == 0), line)
    frames = rows.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("vehicles"))
    w = Window.partitionBy(*by, "frame").orderBy("s_m", "track_id")
    slow = rows.where(F.col("speed_kmh") <= stop_kmh).withColumn("_break", F.coalesce((F.col("s_m") - F.lag("s_m").over(w) > link_gap_m).cast("int"), F.lit(0)))
    run = slow.withColumn("_run", F.sum("_break").over(w)).where("_run = 0")
    q = run.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("n"), (F.max("s_m") - F.min("s_m")).alias("len"), F.min("s_m").alias("head"))
    return frames.join(q, [*by, "frame"], "left").select(*by, "frame", (F.col("frame") / fps).alias("t_s"), F.coalesce("n", F.lit(0).cast("long")).alias("queue_vehicles"), F.coalesce("len", F.lit(0.0)).alias("queue_length_m"), F.coalesce("head", F.lit(0.0)).alias("queue_head_s_m"))


def fundamental_diagram(df: DataFrame, line: Line | None, fps: float, segment_m: float = 60.0, interval_s: float = 15.0, by: Sequence[str] = ()) -> DataFrame:
    """Density, space-mean speed and flow of the corridor's middle segment; density averages over frames with vehicles."""
    low = F.greatest(F.lit(0.0), length_of(line) / 2 - segment_m / 2)
    seg = on_corridor(df.where("speed_kmh IS NOT NULL"), line).where((F.col("s_m") >= low) & (F.col("s_m") < low + segment_m))
    seg = seg.withColumn("interval", F.floor(F.col("frame") / fps / interval_s).cast("int"))
    by_frame = seg.groupBy(*by, "interval", "frame").agg(F.count_distinct("track_id").alias("present"), F.count(F.lit(1)).alias("n"), F.sum(1.0 / F.greatest("speed_kmh", F.lit(1e-3))).alias("inverse"))
    cells = by_frame.groupBy(*by, "interval").agg(F.avg("present").alias("present"), (F.sum("n") / F.sum("inverse")).alias("space_mean_speed_kmh"), F.count(F.lit(1)).alias("frames"))
    ids = seg.groupBy(*by, "interval").agg(F.count_distinct("track_id").alias("distinct_vehicles"))
    k = F.col("present") / (segment_m / 1000.0)
    return cells.join(ids, [*by, "interval"]).select(*by, "interval", (F.col("interval") * F.lit(interval_s)).alias("interval_start_s"), k.alias("density_veh_per_km"), "space_mean_speed_kmh", (k * F.col("space_mean_speed_kmh")).alias("flow_veh_per_h"), (100.0 * F.least(F.lit(1.0), F.col("frames") / max(interval_s * fps, 1.0))).alias("occupancy_pct"), "distinct_vehicles")


def time_space(df: DataFrame, line: Line | None, fps: float, sample_hz: float = 5.0, min_progress_m: float = 25.0, by: Sequence[str] = ()) -> DataFrame:
    """Per vehicle the arrays t, s and v along the corridor, for those that progress; a track's array is as long as the track."""
    step = max(1, round(fps / sample_hz))
    w = Window.partitionBy(*by, "track_id").orderBy("frame")
    rows = on_corridor(df.where("mode <> 'pedestrian'"), line).withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") % step == 0)
    rows = rows.groupBy(*by, "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("s_m").alias("low"), F.max("s_m").alias("high"), F.min_by("mode", "frame").alias("mode"), F.sort_array(F.collect_list(F.struct("frame", "s_m", "speed_kmh"))).alias("p"))
    rows = rows.where((F.col("n") >= 3) & (F.col("high") - F.col("low") >= min_progress_m))
    return rows.select(*by, "track_id", "mode", F.transform("p", lambda x: F.round(x["frame"] / fps, 2)).alias("t"), F.transform("p", lambda x: F.round(x["s_m"], 1)).alias("s"), F.transform("p", lambda x: F.round(x["speed_kmh"], 1)).alias("v"))


def _against(line: Line) -> Column:
    """The velocity's product with the direction of the piece of the line that s_m is on."""
    at, parts = 0.0, []
    for a, b in zip(line, line[1:]):
        at += line_length([a, b])
        parts.append((at, b[0] - a[0], b[1] - a[1]))
    dot = F.lit(None).cast("double")
    for end, dx, dy in reversed(parts):
        own = F.col("velocity_x_mps") * dx + F.col("velocity_y_mps") * dy
        dot = own if end == parts[-1][0] else F.when(F.col("s_m") <= end, own).otherwise(dot)
    return dot


def edie_cells(df: DataFrame, line: Line | None, fps: float, p: FlowParams = FLOW, by: Sequence[str] = ()) -> DataFrame:
    """Edie's flow, density and speed by (segment, interval, lane).

    Steps are differenced after the filters, those over 5 frames count nothing, and a step belongs to its later row's cell. With
    velocity columns, vehicles moving against the corridor are left out.
    """
    rows = on_corridor(df.where("mode <> 'pedestrian'"), line, p.max_offset_m)
    if {"velocity_x_mps", "velocity_y_mps"} <= set(df.columns):
        if line is None:
            dot = F.col("velocity_x_mps") * F.col("along_x") + F.col("velocity_y_mps") * F.col("along_y")
        else:
            dot = _against(line)
        moving = F.coalesce(F.hypot("velocity_x_mps", "velocity_y_mps") > 0.5, F.lit(False))
        rows = rows.where(~moving | (dot > 0))
    w = Window.partitionBy(*by, "track_id").orderBy("frame")
    n_seg = F.greatest(F.lit(1), F.floor(length_of(line) / p.segment_m).cast("int"))
    step = F.col("frame") - F.lag("frame").over(w)
    whole = F.coalesce(step <= 5, F.lit(False))
    rows = rows.withColumns(
        {
            "_ds": F.when(whole, F.abs(F.col("s_m") - F.lag("s_m").over(w))).otherwise(0.0),
            "_dt": F.when(whole, step / fps).otherwise(0.0),
            "segment": F.least(F.greatest(F.floor(F.col("s_m") / p.segment_m), F.lit(0)), n_seg - 1).cast("int"),
            "interval": F.floor(F.col("frame") / fps / p.interval_s).cast("int"),
            "lane": F.floor(F.col("offset_m") / p.lane_width_m).cast("int"),
        }
    )
    g = rows.groupBy(*by, "segment", "interval", "lane").agg(F.sum("_ds").alias("_ds"), F.sum("_dt").alias("_dt"), F.count_distinct("track_id").alias("n_vehicles")).where("_dt > 0")
    area = p.segment_m * p.interval_s
    return g.select(*by, "segment", (F.col("segment") * F.lit(p.segment_m)).alias("segment_start_m"), "interval", (F.col("interval") * F.lit(p.interval_s)).alias("interval_start_s"), "lane", (F.col("_ds") / area * 3600.0).alias("flow_veh_per_h"), (F.col("_dt") / area * 1000.0).alias("density_veh_per_km"), (F.col("_ds") / F.col("_dt") * 3.6).alias("speed_kmh"), "n_vehicles")


def fd_validity(cells: DataFrame, min_cells: int = 6, min_vehicles: int = 3, lanes: tuple[int, int] = (-3, 2), by: Sequence[str] = ()) -> DataFrame:
    """Per (segment, lane) the correlation of density and speed, NULL-free: locations without spread are left out."""
    rows = cells.where((F.col("n_vehicles") >= min_vehicles) & F.col("lane").between(*lanes))
    g = rows.groupBy(*by, "segment", "lane").agg(F.count(F.lit(1)).alias("cells"), F.try_divide(F.covar_pop("density_veh_per_km", "speed_kmh"), F.stddev_pop("density_veh_per_km") * F.stddev_pop("speed_kmh")).alias("corr"), F.median("speed_kmh").alias("median_speed_kmh"), F.percentile("density_veh_per_km", F.lit(0.95)).alias("p95_density"))
    return g.where((F.col("cells") >= min_cells) & F.col("corr").isNotNull() & ~F.isnan("corr"))


def smoothed_offsets(df: DataFrame, line: Line | None, fps: float, smooth_s: float = 0.7, max_offset_m: float = 14.0, lane_width_m: float = 3.2, by: Sequence[str] = ()) -> DataFrame:
    """lateral_offset_m: the centred rolling median of the offset, and the lane that it falls in."""
    win = max(3, round(smooth_s * fps))
    back, ahead = win // 2, (win - 1) // 2
    w = Window.partitionBy(*by, "track_id").orderBy("frame").rowsBetween(-back, ahead)
    rows = on_corridor(df, line, max_offset_m).withColumn("lateral_offset_m", F.percentile("offset_m", F.lit(0.5)).over(w))
    return rows.withColumn("raw_lane", F.floor(F.col("lateral_offset_m") / lane_width_m).cast("int"))


def held_lanes(rows: DataFrame, fps: float, lane_width_m: float = 3.2, hysteresis_m: float = 0.7, dwell_s: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """by, track_id, frame, lane, lane_change of every row: a lane is left only beyond its margin and after a dwell in one other lane.

    Each row's lane needs the one before it, so this is one pass over every track's rows in order. Rows come sorted by track in
    Arrow batches; only the running state is kept between them, so a track may be of any length. An unknown offset keeps
    the lane as it is, and before the first known one the lane is NULL.
    """
    dwell, keys = max(3, round(dwell_s * fps)), [*by, "track_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, cur, cand, pending = None, None, None, 0
        for batch in batches:
            lanes, changes = [], []
            for *t, o in zip(*(batch.column(k).to_pylist() for k in (*keys, "lateral_offset_m"))):
                if t != track:
                    track, cur, cand, pending = t, None, None, 0
                change = False
                if o is not None:
                    own = math.floor(o / lane_width_m)
                    if cur is None:
                        cur = cand = own
                    if cur * lane_width_m - hysteresis_m <= o <= (cur + 1) * lane_width_m + hysteresis_m:
                        cand, pending = cur, 0
                    else:
                        pending = pending + 1 if own == cand else 1
                        cand = own
                        if pending >= dwell:
                            cur, pending, change = own, 0, True
                lanes.append(cur)
                changes.append(change)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("frame"), pa.array(lanes, pa.int32()), pa.array(changes, pa.bool_())], names=[*keys, "frame", "lane", "lane_change"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ordered = rows.select(*keys, "frame", "lateral_offset_m").repartition(*keys).sortWithinPartitions(*keys, "frame")
    return ordered.mapInArrow(fold, ", ".join([*(f"`{k}` {kind[k]}" for k in (*keys, "frame")), "lane int", "lane_change boolean"]))


def lane_change_summary(df: DataFrame, lanes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lane changes per vehicle and per vehicle-kilometre."""
    j = df.join(lanes, [*by, "track_id", "frame"])
    w = Window.partitionBy(*by, "track_id").orderBy("frame")
    j = j.withColumn("_d", F.hypot(F.col("world_x_m") - F.lag("world_x_m").over(w), F.col("world_y_m") - F.lag("world_y_m").over(w)))
    g = j.groupBy(*by).agg(F.count_distinct("track_id").alias("n_vehicles"), F.count_if("lane_change").alias("lane_changes"), (F.coalesce(F.sum("_d"), F.lit(0.0)) / 1000.0).alias("vehicle_km"))
    return g.withColumns({"changes_per_vehicle": F.col("lane_changes") / F.greatest("n_vehicles", F.lit(1)), "changes_per_km": F.col("lane_changes") / F.greatest("vehicle_km", F.lit(1e-6))})
