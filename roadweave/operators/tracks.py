"""Track filtering, repair, smoothing, kinematics and motion state.

All of it partitions by track: Spark deals the rows out once by track_id, and every window after that reuses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.expressions import GroundPlane, RowScale
from roadweave.operators.scan import ranked
from roadweave.params import MotionParams, TrackParams
from roadweave.storage import cut

BOX = ("x1", "y1", "x2", "y2")
#: Tracks that a task ranks, on average: some 3 MB, so that few tracks are not dealt out over hundreds of tasks, nor many over too few.
TRACKS_A_RANGE = 65_536


def kept_tracks(df: DataFrame, p: TrackParams = TrackParams()) -> DataFrame:
    """Rows of tracks that live and were seen long enough. A window keeps the one shuffle by track."""
    w = Window.partitionBy("track_id")
    life = F.max("frame").over(w) - F.min("frame").over(w) + 1
    return df.withColumn("_life", life).withColumn("_n", F.count(F.lit(1)).over(w)).where((F.col("_life") >= p.min_life_frames) & (F.col("_n") >= p.min_rows)).drop("_life", "_n")


def filled(df: DataFrame, p: TrackParams = TrackParams()) -> DataFrame:
    """Fills short gaps of each track linearly; filled rows have interpolated = true, 0.8 of the lower confidence and the left row's class."""
    w = Window.partitionBy("track_id").orderBy("frame")
    nxt = df.withColumn("_f", F.lead("frame").over(w)).withColumns({f"_{c}": F.lead(c).over(w) for c in (*BOX, "conf")})
    gap = F.col("_f") - F.col("frame")
    steps = F.when((gap > 1) & (gap <= p.max_gap_frames + 1), F.sequence(F.lit(0), (gap - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    out = nxt.withColumn("_k", F.explode(steps))
    new = F.col("_k") > 0
    share = F.col("_k") / gap
    cols = {c: F.when(new, F.col(c) + (F.col(f"_{c}") - F.col(c)) * share).otherwise(F.col(c)) for c in BOX}
    cols |= {"conf": F.when(new, F.least("conf", "_conf") * 0.8).otherwise(F.col("conf")), "interpolated": new, "frame": (F.col("frame") + F.col("_k")).cast("int")}
    return out.withColumns(cols).drop("_k", "_f", *(f"_{c}" for c in (*BOX, "conf")))


def segmented(df: DataFrame) -> DataFrame:
    """Numbers the runs without a missing frame of each track from 0."""
    w = Window.partitionBy("track_id").orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(w) > 1).cast("int"), F.lit(0))
    return df.withColumn("segment", F.sum(new).over(w).cast("int"))


def smoothed(df: DataFrame, p: TrackParams = TrackParams()) -> DataFrame:
    """Centred moving averages of the boxes within segments, and centres."""
    if p.smooth_rows >= 3:
        half = p.smooth_rows // 2
        w = Window.partitionBy("track_id", "segment").orderBy("frame").rowsBetween(-half, half)
        df = df.withColumns({c: F.avg(c).over(w) for c in BOX})
    return df.withColumns({"cx": (F.col("x1") + F.col("x2")) * 0.5, "cy": (F.col("y1") + F.col("y2")) * 0.5})


def neighbour(column: str, way: str, *keys: str) -> Column:
    """The column's last (way "lag") or next ("lead") value by frame that is not null, without the row's own."""
    return F.expr(f"{way}({column}, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY frame)")


def bridged(column: str, at: str, known: str) -> Column:
    """The column where `known` (a struct of `at` and the column) is not null; elsewhere on the straight line by `at` between _before and _after, or the only one of these."""
    a, b = F.col(f"_before.{column}"), F.col(f"_after.{column}")
    share = (F.col(at) - F.col(f"_before.{at}")) / (F.col(f"_after.{at}") - F.col(f"_before.{at}"))
    return F.when(F.col(known).isNotNull(), F.col(column)).otherwise(F.coalesce(a + (b - a) * share, b, a))


def kinematics(df: DataFrame, cal: GroundPlane | RowScale, fps: float, p: MotionParams = MotionParams()) -> DataFrame:
    """Ground position, velocity, acceleration, heading and their validity; everything unknown is NULL."""
    hv, ha, dt = p.half_velocity(fps), p.half_acceleration(fps), 1.0 / fps
    gx, gy = cal.to_ground(F.col("cx"), F.col("cy"))
    df = df.withColumns({"world_x_m": gx, "world_y_m": gy, "timestamp_s": F.col("frame") / F.lit(float(fps))})
    part = Window.partitionBy("track_id", "segment")
    w = part.orderBy("frame")
    speed = lambda c: (F.lead(c, hv).over(w) - F.lag(c, hv).over(w)) / (2 * hv * dt)
    seen = F.when(F.lead("frame", hv).over(w).isNotNull() & F.lag("frame", hv).over(w).isNotNull(), F.avg(F.col("interpolated").cast("double")).over(w.rowsBetween(-hv, hv)))
    df = df.withColumns({"vx": speed("world_x_m"), "vy": speed("world_y_m"), "interpolated_fraction_in_window": seen, "_i": F.row_number().over(w), "_m": F.count(F.lit(1)).over(part)})
    # Over holes velocities are interpolated, and held at the ends, so that the slope below is defined near them.
    df = df.withColumn("_at", F.when(F.col("vx").isNotNull(), F.struct("_i", "vx", "vy")))
    df = df.withColumns({"_before": neighbour("_at", "lag", "track_id", "segment"), "_after": neighbour("_at", "lead", "track_id", "segment"), "_known": F.count("vx").over(part)})
    df = df.withColumns({f"_{v}": bridged(v, "_i", "_at") for v in ("vx", "vy")}).drop("_at", "_before", "_after")
    inner = (F.col("_i") > ha) & (F.col("_i") <= F.col("_m") - ha) & (F.col("_known") >= 2 * ha + 1) & F.col("vx").isNotNull()
    # The slope over equal steps, as weighted differences of the rows around.
    weight = sum(k * k for k in range(-ha, ha + 1)) * dt
    slope = lambda c: sum((F.lead(c, k).over(w) - F.lag(c, k).over(w)) * float(k) for k in range(1, ha + 1)) / weight
    df = df.withColumns({"ax": F.when(inner, slope("_vx")), "ay": F.when(inner, slope("_vy"))})
    sp = F.hypot("vx", "vy")
    df = df.withColumns({"speed_mps": sp, "acceleration_mps2": F.hypot("ax", "ay")})
    fast = F.col("speed_mps") >= p.min_heading_speed
    implausible = F.coalesce(F.col("speed_mps") > p.max_speed, F.lit(False))
    invented = F.coalesce(F.col("interpolated_fraction_in_window"), F.lit(1.0)) > p.max_interpolated
    df = df.withColumns(
        {
            "longitudinal_acceleration_mps2": F.when(fast, (F.col("ax") * F.col("vx") + F.col("ay") * F.col("vy")) / F.greatest("speed_mps", F.lit(1e-6))),
            "lateral_acceleration_mps2": F.when(fast, (F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")) / F.greatest("speed_mps", F.lit(1e-6))),
            "heading_deg": F.when(fast, F.degrees(F.atan2("vy", "vx"))),
            "implausible_speed": implausible,
            "implausible_acceleration": F.coalesce(F.col("acceleration_mps2") > p.max_acceleration, F.lit(False)) | invented,
            "kinematics_valid": F.col("speed_mps").isNotNull() & cal.in_range(F.col("cy")) & ~implausible & ~invented & F.lit(cal.confidence > 0),
        }
    )
    good = ~F.col("implausible_speed")
    fine = good & ~F.col("implausible_acceleration")
    df = df.withColumn("kinematics_quality", F.when(F.col("kinematics_valid"), F.lit(cal.confidence) * (1.0 - 0.5 * F.coalesce("interpolated_fraction_in_window", F.lit(1.0)))))
    df = df.withColumns({c: F.when(good, F.col(c)) for c in ("speed_mps", "vx", "vy", "heading_deg")} | {c: F.when(fine, F.col(c)) for c in ("ax", "ay", "acceleration_mps2", "longitudinal_acceleration_mps2", "lateral_acceleration_mps2")})
    df = df.withColumn("speed_kmh", F.col("speed_mps") * 3.6)
    return df.withColumnsRenamed({"vx": "velocity_x_mps", "vy": "velocity_y_mps", "ax": "acceleration_x_mps2", "ay": "acceleration_y_mps2"}).drop("_i", "_m", "_known", "_vx", "_vy")


def with_path_steps(df: DataFrame, fps: float, interval_s: float = 0.5) -> DataFrame:
    """Adds _step_m: travel since the row an interval before, at every interval's row of a segment, else NULL."""
    w = Window.partitionBy("track_id", "segment").orderBy("frame")
    step = max(1, round(interval_s * fps))
    d = F.hypot(F.col("world_x_m") - F.lag("world_x_m", step).over(w), F.col("world_y_m") - F.lag("world_y_m", step).over(w))
    return df.withColumn("_step_m", F.when((F.row_number().over(w) - 1) % step == 0, d))


def with_window_steps(df: DataFrame, fps: float, p: MotionParams = MotionParams()) -> DataFrame:
    """Adds _away_m: at every interval's row with a place, the way from where the track was one window before; segments shorter than a window compare their ends."""
    w = Window.partitionBy("track_id", "segment").orderBy("frame")
    step, lag = max(1, round(p.path_interval_s * fps)), max(1, round(p.parked_window_s / p.path_interval_s))
    taken = ((F.row_number().over(w) - 1) % step == 0) & F.col("world_x_m").isNotNull() & F.col("world_y_m").isNotNull()
    # A place at taken rows only: what skips nulls counts and looks back among these, in the order that the rows already have.
    rows = df.withColumn("_at", F.when(taken, F.struct("world_x_m", "world_y_m")))
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "_then": F.expr(f"lag(_at, {lag}) IGNORE NULLS OVER (PARTITION BY track_id, segment ORDER BY frame)"),
            "_start": F.first("_at", ignorenulls=True).over(past),
            "_k": F.count("_at").over(past),
            "_n": F.count("_at").over(Window.partitionBy("track_id", "segment")),
        }
    )
    away = lambda c: F.hypot(F.col("world_x_m") - F.col(f"{c}.world_x_m"), F.col("world_y_m") - F.col(f"{c}.world_y_m"))
    ends = (F.col("_k") == F.col("_n")) & (F.col("_n") > 1) & (F.col("_n") <= lag)
    return rows.withColumn("_away_m", F.when(F.col("_at").isNotNull(), F.when(ends, away("_start")).otherwise(away("_then")))).drop("_at", "_then", "_start", "_k", "_n")


def path_lengths(df: DataFrame, fps: float, interval_s: float = 0.5) -> DataFrame:
    """track_id, path_m: travel summed over every interval's row within segments."""
    return with_path_steps(df, fps, interval_s).groupBy("track_id").agg(F.coalesce(F.sum("_step_m"), F.lit(0.0)).alias("path_m"))


def window_displacements(df: DataFrame, fps: float, p: MotionParams = MotionParams()) -> DataFrame:
    """track_id, win_m: the farthest that a track moved from itself in one window."""
    return with_window_steps(df, fps, p).groupBy("track_id").agg(F.coalesce(F.max("_away_m"), F.lit(0.0)).alias("win_m"))


def track_summary(df: DataFrame, fps: float, p: MotionParams = MotionParams()) -> DataFrame:
    """One row per track with its span, travel, speeds, accelerations and the parked verdict: windows and one aggregate on the one shuffle by track."""
    moving = F.avg((F.col("speed_mps") > p.moving_speed).cast("double"))
    ends = {c: (F.min_by(c, "frame"), F.max_by(c, "frame")) for c in ("world_x_m", "world_y_m")}
    pct = lambda c, q: F.percentile(c, F.lit(q))
    agg = with_window_steps(with_path_steps(df, fps, p.path_interval_s), fps, p).groupBy("track_id").agg(
        F.coalesce(F.sum("_step_m"), F.lit(0.0)).alias("path_m"),
        F.coalesce(F.max("_away_m"), F.lit(0.0)).alias("win_m"),
        F.min("frame").alias("f0"),
        F.max("frame").alias("f1"),
        F.hypot(ends["world_x_m"][1] - ends["world_x_m"][0], ends["world_y_m"][1] - ends["world_y_m"][0]).alias("net_m"),
        moving.alias("moving_frac"),
        F.median("speed_mps").alias("median_speed_mps"),
        pct("speed_mps", 0.95).alias("p95_speed_mps"),
        F.max("speed_mps").alias("max_speed_mps"),
        *(pct("longitudinal_acceleration_mps2", q).alias(n) for q, n in ((0.95, "p95_accel_mps2"), (0.05, "p05_brake_mps2"), (0.995, "peak_accel_mps2"), (0.005, "peak_brake_mps2"))),
        F.count_if(~F.col("interpolated")).alias("n_obs"),
    )
    agg = agg.withColumn("life_s", (F.col("f1") - F.col("f0") + 1) / F.lit(float(fps)))
    parked = (F.col("life_s") >= p.parked_min_life_s) & (F.col("moving_frac") < p.parked_moving_share) & (F.col("net_m") < p.parked_net_m) & (F.col("win_m") < p.parked_window_m)
    return agg.withColumn("parked", F.coalesce(parked, F.lit(False)))


def motion_states(df: DataFrame, summary: DataFrame, p: MotionParams = MotionParams()) -> DataFrame:
    """Adds parked, motion_state and display_id. A display id ranks the tracks that are not parked by first frame, then id."""
    # A row a track, computed once: the ranks sample, sort and count it, and the join needs it again.
    verdicts = cut(summary.select("track_id", "f0", "parked"))
    live = verdicts.where(~F.col("parked")).select("track_id", "f0")
    ids = ranked(live, ["f0", "track_id"], "display_id", parts=live.count() // TRACKS_A_RANGE + 1)
    known = verdicts.select("track_id", "parked").join(ids.select("track_id", "display_id"), "track_id", "left")
    df = df.join(known, "track_id", "left")
    state = F.when(F.col("parked"), "parked").when(F.col("kinematics_valid") & (F.col("speed_mps") > p.moving_speed), "moving").when(F.col("kinematics_valid") & F.col("speed_mps").isNotNull(), "temporarily_stopped")
    return df.withColumn("motion_state", state.otherwise("unknown"))


def stats_by_mode(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Medians over moving tracks of their speeds, and their strong accelerations, by mode; modes without tracks have no row."""
    modes = df.groupBy("track_id").agg(F.min("mode").alias("mode"))
    j = summary.where(~F.col("parked")).join(modes, "track_id")
    return j.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.median("median_speed_mps").alias("median_speed_mps"),
        F.percentile("p95_speed_mps", F.lit(0.95)).alias("p95_speed_mps"),
        F.percentile("p95_accel_mps2", F.lit(0.95)).alias("p95_accel_mps2"),
        F.percentile("p05_brake_mps2", F.lit(0.05)).alias("p05_brake_mps2"),
    )


def run_report(raw: DataFrame, df: DataFrame, summary: DataFrame) -> DataFrame:
    """metric, value: counts of the run's rows and tracks, and track life."""
    dropped = raw.select("track_id").distinct().join(df.select("track_id").distinct(), "track_id", "left_anti")
    parts = [
        df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("metric"), "value"),
        df.agg(F.count_if("interpolated").cast("double").alias("value")).select(F.lit("interpolated_rows").alias("metric"), "value"),
        dropped.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("dropped_tracks").alias("metric"), "value"),
        summary.groupBy("parked").count().select(F.when(F.col("parked"), "parked_tracks").otherwise("moving_tracks").alias("metric"), F.col("count").cast("double").alias("value")),
        summary.agg(F.median("life_s").alias("value")).select(F.lit("median_life_s").alias("metric"), "value"),
        summary.agg(F.percentile("life_s", F.lit(0.9)).alias("value")).select(F.lit("p90_life_s").alias("metric"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distributions(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, tracks, n_rows: how many tracks and rows have each value of the given columns, from one pass; NULL is a value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))
    return df.select("track_id", pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count_distinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("n_rows"))


def analysed(raw: DataFrame, cal: GroundPlane | RowScale, fps: float, track: TrackParams = TrackParams(), motion: MotionParams = MotionParams()) -> DataFrame:
    """Raw tracks to kinematics: filter, fill, segment, smooth, measure."""
    return kinematics(smoothed(segmented(filled(kept_tracks(raw, track), track)), track), cal, fps, motion)


def slope_velocity(df: DataFrame, fps: float, p: MotionParams = MotionParams()) -> DataFrame:
    """Velocity as the least-squares slope over the velocity window; the ends of a segment take the slope of its first and last whole window."""
    h = p.half_velocity(fps)
    w = Window.partitionBy("track_id", "segment").orderBy("frame")
    weight = sum(k * k for k in range(-h, h + 1)) / fps
    out = df
    for c, v in (("world_x_m", "slope_x_mps"), ("world_y_m", "slope_y_mps")):
        inner = sum((F.lead(c, k).over(w) - F.lag(c, k).over(w)) * float(k) for k in range(1, h + 1)) / weight
        out = out.withColumn(v, inner)
        out = out.withColumn(v, F.coalesce(F.col(v), neighbour(v, "lead", "track_id", "segment"), F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return out


def row_speed(df: DataFrame, fps: float, scale_m: float, smooth_rows: int = 15, most: float = 60.0) -> DataFrame:
    """The older speed: displacement over a quarter second of rows either side whatever their frames, held over the ends, clipped and averaged."""
    k = max(1, round(fps / 4))
    w = Window.partitionBy("track_id").orderBy("frame")
    d = F.hypot(F.lead("cx", k).over(w) - F.lag("cx", k).over(w), F.lead("cy", k).over(w) - F.lag("cy", k).over(w))
    v = d * scale_m / (F.lead("frame", k).over(w) - F.lag("frame", k).over(w)) * fps
    df = df.withColumn("_v", v)
    held = F.coalesce("_v", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), neighbour("_v", "lead", "track_id"))
    half = smooth_rows // 2
    df = df.withColumn("_v", F.least(F.greatest(held, F.lit(0.0)), F.lit(most)))
    return df.withColumn("row_speed_mps", F.avg("_v").over(w.rowsBetween(-half, half))).drop("_v")
