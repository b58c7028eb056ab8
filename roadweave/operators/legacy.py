"""The earlier post-processing: one scale by image row, class by vote and size, speed by rows, and parked tracks, all in pixels times a scale.

Kept for results of its time; operators.tracks is what follows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.calibration import row_bins
from roadweave.operators.classify import mode_sums
from roadweave.operators.scan import ranked
from roadweave.operators.tracks import filled, kept_tracks, neighbour, segmented, smoothed
from roadweave.params import MODES, TrackParams

#: Lengths in metres over which a car is an LGV, an LGV a truck and a truck an HGV, and under which a bus is an LGV.
CAR_MAX_M, LGV_MAX_M, TRUCK_MAX_M, BUS_MIN_M = 6.2, 7.5, 9.5, 7.0


@dataclass(frozen=True)
class CarScale:
    """Metres a pixel by image row: the length of a car over its size in pixels, which is linear in the row and clipped."""

    slope: float
    base: float
    car_length_m: float = 4.3
    low: float = 0.0
    high: float = 1080.0
    samples: int = 0

    def m_per_px(self, y: Column) -> Column:
        return self.car_length_m / F.least(F.greatest(self.slope * y + self.base, F.lit(8.0)), F.lit(400.0))

    def described(self) -> dict[str, float]:
        px = [min(max(self.slope * y + self.base, 8.0), 400.0) for y in (self.low, self.high)]
        return {"car_px_at_top": round(px[0], 1), "car_px_at_bottom": round(px[1], 1), "m_per_px_top": round(self.car_length_m / px[0], 5), "m_per_px_bottom": round(self.car_length_m / px[1], 5), "n_car_samples": self.samples}


def car_samples(rows: DataFrame, least: int = 200) -> DataFrame:
    """y, px of the observed cars; of all observed boxes where there are fewer than `least` of them."""
    seen = rows.where("NOT interpolated").select(((F.col("y1") + F.col("y2")) / 2).alias("y"), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("px"), (F.col("cls_name") == "car").alias("car"))
    enough = (seen.agg(F.count_if("car")).first()[0] or 0) >= least
    return (seen.where("car") if enough else seen).select("y", "px")


def fit_car_scale(samples: DataFrame, car_length_m: float = 4.3, bins: int = 12, least: int = 25) -> CarScale:
    """The line of median sizes by row, each of `bins` equal ranges weighing as its samples; constant with under 200 samples or three bins, or if it is under 5 pixels anywhere."""
    low, high, n, med = samples.where("y IS NOT NULL AND px > 4").agg(F.min("y"), F.max("y"), F.count(F.lit(1)), F.median("px")).first()
    if n < 200:
        return CarScale(0.0, med if n else 44.0, car_length_m, samples=n)
    rows, _, _ = row_bins(samples, bins, least)
    slope, base = 0.0, med
    if len(rows) >= 3:
        line = [(w * w, y, m) for y, m, w in rows]
        one, sy, sm = sum(w for w, _, _ in line), sum(w * y for w, y, _ in line), sum(w * m for w, _, m in line)
        syy, sym = sum(w * y * y for w, y, _ in line), sum(w * y * m for w, y, m in line)
        slope = (one * sym - sy * sm) / (one * syy - sy * sy)
        base = (sm - slope * sy) / one
        if min(slope * low + base, slope * high + base) <= 5:
            slope, base = 0.0, med
    return CarScale(slope, base, car_length_m, low, high, n)


def sized_mode(mode: Column, length_m: Column) -> Column:
    """A mode that a length confirms or changes; unknown lengths change nothing."""
    lorry = F.when(length_m > TRUCK_MAX_M, "HGV").otherwise("truck")
    by = F.when((mode == "car") & (length_m > CAR_MAX_M), "LGV").when((mode == "LGV") & (length_m > LGV_MAX_M), lorry).when(mode.isin("truck", "HGV"), lorry).when((mode == "bus") & (length_m < BUS_MIN_M), "LGV")
    return F.when(length_m.isNull(), mode).otherwise(F.coalesce(by, mode))


def with_speed(rows: DataFrame, fps: float, smooth_rows: int = 15) -> DataFrame:
    """speed_mps: displacement over a quarter second of rows either side, whatever their frames, held over the ends, 0 where none is known, and averaged."""
    k, half = max(2, round(fps / 4)), smooth_rows // 2
    w = Window.partitionBy("track_id").orderBy("frame")
    step = lambda c: F.lead(c, k).over(w) - F.lag(c, k).over(w)
    rows = rows.withColumn("_v", F.hypot(step("cx"), step("cy")) / step("frame") * F.col("mpp") * fps)
    rows = rows.withColumn("_v", F.coalesce("_v", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), neighbour("_v", "lead", "track_id"), F.lit(0.0)))
    rows = rows.withColumn("speed_mps", F.avg(F.greatest("_v", F.lit(0.0))).over(w.rowsBetween(-half, half)))
    return rows.withColumn("speed_kmh", F.col("speed_mps") * 3.6).drop("_v")


def summary(rows: DataFrame, fps: float, moving_mps: float = 0.7, window_s: float = 10.0, min_life_s: float = 3.0, moving_share: float = 0.05, net_m: float = 2.5, window_m: float = 3.0) -> DataFrame:
    """Per track its span, share of moving rows, net way, way by half seconds, farthest from itself a window before, and whether it is parked."""
    k = max(1, round(fps / 2))
    lag = max(1, round(window_s * fps / k))
    w = Window.partitionBy("track_id").orderBy("frame")
    taken = rows.withColumn("_i", F.row_number().over(w) - 1)
    taken = taken.withColumn("_t", F.when(F.col("_i") % k == 0, F.struct("cx", "cy", "mpp")))
    half = taken.where("_t IS NOT NULL").withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("track_id")), "_k": F.row_number().over(w)})
    far = lambda a: F.hypot(F.col("cx") - a["cx"], F.col("cy") - a["cy"]) * a["mpp"]
    first = F.first("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Of a track shorter than the window its two ends are compared.
    away = F.when(F.col("_n") > lag, far(F.lag("_t", lag).over(w))).when((F.col("_k") == F.col("_n")) & (F.col("_n") > 1), far(first))
    half = half.withColumns({"_step": far(F.lag("_t", 1).over(w)), "_away": away})
    ways = half.groupBy("track_id").agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_m"), F.coalesce(F.max("_away"), F.lit(0.0)).alias("win_m"))
    g = rows.groupBy("track_id").agg(
        F.min("frame").alias("f0"),
        F.max("frame").alias("f1"),
        F.avg((F.col("speed_mps") > moving_mps).cast("double")).alias("moving_frac"),
        (F.hypot(F.max_by("cx", "frame") - F.min_by("cx", "frame"), F.max_by("cy", "frame") - F.min_by("cy", "frame")) * F.median("mpp")).alias("net_m"),
    )
    g = g.join(ways, "track_id").withColumn("life_s", (F.col("f1") - F.col("f0") + 1) / fps)
    return g.withColumn("parked", (F.col("life_s") >= min_life_s) & (F.col("moving_frac") < moving_share) & (F.col("net_m") < net_m) & (F.col("win_m") < window_m))


def processed(raw: DataFrame, fps: float, p: TrackParams = TrackParams()) -> tuple[DataFrame, DataFrame, CarScale]:
    """(rows with the columns of sources.tables.LEGACY_COLUMNS, the summary by track with modes and display ids, the scale) of raw tracks."""
    rows = smoothed(segmented(filled(kept_tracks(raw, p), p)), p)
    scale = fit_car_scale(car_samples(rows))
    rows = rows.withColumn("mpp", scale.m_per_px(F.col("cy")))
    rows = rows.withColumn("length_m", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * F.col("mpp"))
    coarse = mode_sums(rows).groupBy("track_id").agg(F.max(F.struct("w", (-F.col("f")).alias("f"), "m"))["m"].alias("coarse"))
    length = rows.groupBy("track_id").agg(F.median("length_m").alias("median_length_m")).join(coarse, "track_id", "left")
    modes = length.select("track_id", "median_length_m", sized_mode(F.coalesce("coarse", F.lit("car")), F.col("median_length_m")).alias("mode"))
    rows = with_speed(rows, fps)
    tracks = summary(rows, fps).join(modes, "track_id")
    ids = ranked(tracks.where("NOT parked").select("track_id", "f0"), ["f0", "track_id"], "display_id").select("track_id", "display_id")
    tracks = tracks.join(ids, "track_id", "left")
    return rows.join(tracks.select("track_id", "mode", "parked", "display_id"), "track_id"), tracks, scale


def report(raw: DataFrame, rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """metric, value: the earlier run report's counts and lives, and the moving tracks of each mode."""
    whole = tracks.agg(F.count(F.lit(1)).cast("double").alias("tracks_total"), F.count_if(~F.col("parked")).cast("double").alias("tracks_moving"), F.count_if("parked").cast("double").alias("tracks_parked"), F.median("life_s").alias("median_track_seconds"), F.percentile("life_s", F.lit(0.9)).alias("p90_track_seconds"), *(F.count_if(~F.col("parked") & (F.col("mode") == m)).cast("double").alias(f"moving_{m}") for m in MODES))
    counts = rows.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.count_if("interpolated").cast("double").alias("rows_interpolated"), (F.max("frame") + 1).cast("double").alias("frames"))
    all_ = raw.agg(F.count_distinct("track_id").cast("double").alias("_all"))
    one = whole.crossJoin(counts).crossJoin(all_).withColumn("tracks_dropped_short", F.col("_all") - F.col("tracks_total")).drop("_all")  # one row each
    return one.unpivot([], one.columns, "metric", "value")
