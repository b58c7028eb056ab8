"""Evidence about congestion, signals, gaps, lanes and obstructions.

Crossings are (stream, vehicle, mode, t_s) rows. A stream is one approach, and the functions keep streams apart, so Spark
works on many approaches or recordings at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.expressions import Line, projected, segments_of
from roadweave.operators.aggregates import beside, length_of, on_corridor
from roadweave.operators.graph import components
from roadweave.operators.scan import scanned
from roadweave.storage import cut


def stopline_crossings(df: DataFrame, line: Line | None, fps: float, at_m: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """When each vehicle first reaches a place on the corridor (its middle, unless given), interpolated; one already beyond it at first sight has no row."""
    keys, x0 = [*by, "track_id"], F.lit(at_m) if at_m is not None else length_of(line) / 2
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = on_corridor(df.where("mode <> 'pedestrian'"), line).withColumns({"_s": F.lag("s_m").over(w), "_f": F.lag("frame").over(w), "_x": x0})
    hit = F.when(F.col("s_m") >= F.col("_x"), F.struct("frame", F.col("_f").alias("f0"), F.col("_s").alias("s0"), F.col("s_m").alias("s1")))
    g = rows.groupBy(*keys).agg(F.min(hit).alias("h"), F.first("_x").alias("x"), F.min_by("mode", "frame").alias("mode"), F.median("speed_kmh").alias("median_speed_kmh")).where("h.f0 IS NOT NULL")
    share = F.when(F.col("h.s1") == F.col("h.s0"), 0.0).otherwise((F.col("x") - F.col("h.s0")) / (F.col("h.s1") - F.col("h.s0")))
    return g.select(*keys, ((F.col("h.f0") + share * (F.col("h.frame") - F.col("h.f0"))) / fps).alias("t_s"), "mode", "median_speed_kmh")


def platoons(crossings: DataFrame, red_gap_s: float = 12.0, bucket_s: float = 600.0) -> DataFrame:
    """Crossings with the headway before each, the number of the platoon it is in and its place there; a longer gap than red_gap_s begins a new one.

    A stream of any length is dealt out by buckets of bucket_s seconds.
    """
    rows = scanned(crossings, ["stream"], "t_s", bucket_s, ["vehicle"], before={"_t": F.col("t_s")}, totals={"_n": F.lit(1)})
    rows = rows.withColumn("headway_s", F.col("t_s") - F.col("_t"))
    new = F.coalesce(F.col("headway_s") > red_gap_s, F.lit(False))
    begins = F.when(new | F.col("_t").isNull(), F.col("_n"))
    rows = scanned(rows, ["stream"], "t_s", bucket_s, ["vehicle"], upto={"_from": begins}, totals={"platoon": new.cast("int")})
    return rows.withColumn("place", (F.col("_n") - F.col("_from") + 1).cast("int")).drop("_t", "_n", "_from")


def discharge_cycles(crossings: DataFrame, red_gap_s: float = 12.0, bucket_s: float = 600.0) -> DataFrame:
    """Per platoon its span, vehicles, and saturation flow from the headways after the first two (of all, where there are three or fewer)."""
    rows = platoons(crossings, red_gap_s, bucket_s)
    inner, late = F.when(F.col("place") > 1, F.col("headway_s")), F.when(F.col("place") > 3, F.col("headway_s"))
    n = F.count(F.lit(1))
    g = rows.groupBy("stream", "platoon").agg(
        F.min("t_s").alias("start_s"),
        F.max("t_s").alias("end_s"),
        n.alias("vehicles"),
        F.when(n <= 4, F.avg(inner)).otherwise(F.avg(late)).alias("steady_headway_s"),
        F.when(n > 4, F.median(late)).alias("_median"),
        F.max(F.when(F.col("place") == 2, F.col("headway_s"))).alias("first_headway_s"),
    )
    w = Window.partitionBy("stream").orderBy("platoon")
    return g.select(
        "stream",
        "platoon",
        "start_s",
        "end_s",
        "vehicles",
        (F.col("end_s") - F.col("start_s")).alias("green_s"),
        (F.lead("start_s").over(w) - F.col("end_s")).alias("red_s"),
        (F.lead("start_s").over(w) - F.col("start_s")).alias("cycle_s"),
        F.try_divide(F.lit(3600.0), F.when(F.col("vehicles") >= 3, F.col("steady_headway_s"))).alias("saturation_flow_veh_h"),
        F.when(F.col("vehicles") >= 4, F.col("first_headway_s") - F.coalesce("_median", F.lit(0.0))).alias("startup_loss_s"),
    )


def signal_performance(crossings: DataFrame, red_gap_s: float = 12.0, min_cycles: int = 3, max_cov: float = 0.25, max_split: float = 0.8) -> DataFrame:
    """Per stream whether its interruptions look like a signal (NULL: too few crossings) and, if so, its medians."""
    c = discharge_cycles(crossings, red_gap_s)
    big = F.col("vehicles") >= 3
    ended = F.col("red_s").isNotNull()
    g = c.groupBy("stream").agg(
        F.sum("vehicles").alias("crossings"),
        F.count(F.lit(1)).alias("platoons"),
        F.try_divide(F.stddev_pop("cycle_s"), F.greatest(F.avg("cycle_s"), F.lit(1e-6))).alias("cycle_cov"),
        F.count("cycle_s").alias("_cycles"),
        F.try_divide(F.sum(F.when(ended, F.col("green_s"))), F.greatest(F.sum(F.when(ended, F.col("green_s") + F.col("red_s"))), F.lit(1e-6))).alias("green_split"),
        F.count_if(big).alias("n_cycles"),
        F.median(F.when(big, F.col("saturation_flow_veh_h"))).alias("median_saturation_flow_veh_h"),
        F.median(F.when(big, F.col("startup_loss_s"))).alias("median_startup_loss_s"),
        F.median("red_s").alias("median_red_s"),
        F.median(F.when(big, F.col("green_s"))).alias("median_green_s"),
    )
    regular = (F.col("_cycles") >= 2) & (F.col("cycle_cov") <= max_cov) & (F.col("green_split") <= max_split)
    verdict = F.when(F.col("crossings") < 8, F.lit(None)).when(F.col("platoons") < min_cycles, False).otherwise(F.coalesce(regular, F.lit(False)))
    g = g.withColumn("signalised", verdict).drop("_cycles")
    return g.withColumns({k: F.when(F.col("signalised"), F.col(k)) for k in ("n_cycles", "median_saturation_flow_veh_h", "median_startup_loss_s", "median_red_s", "median_green_s")})


def accepted_gaps(minor: DataFrame, major: DataFrame, bucket_s: float = 600.0) -> DataFrame:
    """The major stream's gap around each minor crossing: an as-of join both ways, as one ordered pass over the union by stream, dealt out by buckets of time.

    Both tables have stream, vehicle, t_s; a minor crossing before the first or after the last major one has no row.
    """
    rows = minor.select("stream", "vehicle", "t_s", F.lit(1).alias("_minor")).unionByName(major.select("stream", "vehicle", "t_s", F.lit(0).alias("_minor")))
    # At equal times the minor crossing comes first, so the gap ends with the major one at or after it.
    t = F.when(F.col("_minor") == 0, F.col("t_s"))
    rows = scanned(rows, ["stream"], "t_s", bucket_s, [F.desc("_minor"), "vehicle"], before={"before": t}, after={"after": t})
    return rows.where("_minor = 1 AND before IS NOT NULL AND after IS NOT NULL").select("stream", "vehicle", "t_s", (F.col("after") - F.col("before")).alias("gap_s"))


def rejected_gaps(waits: DataFrame, major: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Major gaps that lie whole within a minor vehicle's wait [wait_s, t_s]: an interval join on time buckets.

    A wait is dealt to every bucket that it touches and a gap to the bucket that it begins in, so rows meet by equality and
    the range condition is checked on those alone.
    """
    ends = scanned(major.select("stream", "vehicle", "t_s"), ["stream"], "t_s", 10 * bucket_s, ["vehicle"], after={"g1": F.col("t_s")})
    gaps = ends.where("g1 IS NOT NULL").select("stream", F.col("t_s").alias("g0"), "g1", F.floor(F.col("t_s") / bucket_s).alias("b"))
    spans = waits.where("wait_s < t_s").withColumn("b", F.explode(F.sequence(F.floor(F.col("wait_s") / bucket_s), F.floor(F.col("t_s") / bucket_s))))
    return spans.join(gaps, ["stream", "b"]).where("g0 >= wait_s AND g1 <= t_s").select("stream", "vehicle", (F.col("g1") - F.col("g0")).alias("gap_s"))


def critical_gap(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per stream the midpoint of the 15th percentile of accepted and the 85th of rejected gaps; NULL under three rejections."""
    a = accepted.groupBy("stream").agg(F.count(F.lit(1)).alias("n_accepted"), F.median("gap_s").alias("median_accepted_gap_s"), F.percentile("gap_s", F.lit(0.15)).alias("p15_accepted_gap_s"))
    r = rejected.groupBy("stream").agg(F.count(F.lit(1)).alias("n_rejected"), F.median("gap_s").alias("median_rejected_gap_s"), F.percentile("gap_s", F.lit(0.85)).alias("p85_rejected_gap_s"))
    out = a.join(r, "stream", "left").withColumn("n_rejected", F.coalesce("n_rejected", F.lit(0).cast("long")))
    return out.withColumn("critical_gap_s", F.when(F.col("n_rejected") >= 3, 0.5 * (F.col("p15_accepted_gap_s") + F.col("p85_rejected_gap_s"))))


def raff_critical_gap(gaps: DataFrame, points: int = 400, least: int = 5) -> DataFrame:
    """Per stream where the share of accepted gaps up to t meets the share of rejected gaps over t, on a grid. gaps: stream, accepted, gap_s.

    The grid meets each gap by an equal stream and its cell alone: gaps are counted by grid cell, then summed along the grid.
    """
    n = gaps.groupBy("stream").agg(F.count_if("accepted").alias("na"), F.count_if(~F.col("accepted")).alias("nr"), F.percentile("gap_s", F.lit(0.99)).alias("p99")).where((F.col("na") >= least) & (F.col("nr") >= least))
    n = n.withColumn("high", F.greatest(F.least("p99", F.lit(20.0)), F.lit(2.0))).withColumn("step", (F.col("high") - 0.1) / (points - 1))
    cell = F.greatest(F.ceil((F.col("gap_s") - 0.1) / F.col("step")), F.lit(0)).cast("int")
    counts = gaps.join(n, "stream").withColumn("cell", cell).groupBy("stream", "cell").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    grid = n.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).join(counts, ["stream", "cell"], "left")
    w = Window.partitionBy("stream").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"t": 0.1 + F.col("cell") * F.col("step"), "fa": F.coalesce(F.sum("a").over(w), F.lit(0)) / F.col("na"), "fr": 1.0 - F.coalesce(F.sum("r").over(w), F.lit(0)) / F.col("nr")})
    o = Window.partitionBy("stream").orderBy("cell")
    grid = grid.withColumns({"d": F.col("fa") - F.col("fr"), "d0": F.lag(F.col("fa") - F.col("fr")).over(o), "t0": F.lag("t").over(o)})
    cross = grid.where("d0 < 0 AND d >= 0 AND fa > 0.02 AND fr > 0.02")
    at = F.col("t0") + (F.col("t") - F.col("t0")) * F.try_divide(-F.col("d0"), F.col("d") - F.col("d0"))
    return cross.groupBy("stream").agg(F.min_by(at, "cell").alias("critical_gap_s"), F.first("na").alias("n_accepted"), F.first("nr").alias("n_rejected"))


def desire_deviation(df: DataFrame, line: Line | None, lane_width_m: float = 3.2, band_m: float = 0.6, least: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Offsets from the corridor's line: spread, and the share near a lane border against chance."""
    rows = on_corridor(df, line, 14.0).withColumn("_u", F.col("offset_m") / lane_width_m)
    near = F.abs(F.col("_u") - F.rint("_u")) < band_m / lane_width_m
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.median("offset_m").alias("median_offset_m"), (F.percentile("offset_m", F.lit(0.85)) - F.percentile("offset_m", F.lit(0.15))).alias("offset_spread_m"), F.avg(near.cast("double")).alias("straddle_share")).where(F.col("samples") >= least)
    chance = min(1.0, 2 * band_m / lane_width_m)
    verdict = F.when(F.col("straddle_share") >= chance * 0.95, "none").when(F.col("straddle_share") >= chance * 0.6, "partial").otherwise("good")
    return g.withColumns({"lane_discipline": verdict, "systematic_bias": F.abs("median_offset_m") > 0.9})


def obstruction_census(df: DataFrame, corridors: dict[str, Line] | DataFrame, fps: float, carriageway_m: float = 7.0, min_dwell_s: float = 20.0, keys: Sequence[str] = ()) -> DataFrame:
    """Parked tracks by their nearest corridor, in lane or at the kerb. Dwell and start count all of a track's frames, those without a known place too.

    corridors: polylines by name, as literals, or the table of aggregates.corridor_table, whose recordings keys tell apart. Of equally near ones the first
    by name, or as given, counts.
    """
    track = [*keys, "track_id"]
    parked = df.where("parked")
    whole = parked.groupBy(*track).agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by("mode", "frame").alias("mode"))
    if isinstance(corridors, DataFrame):
        rows = beside(parked, corridors, keys).withColumn("k", F.col("corridor"))
    else:
        table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(name).alias("corridor"), segments_of(line).alias("segments")) for k, (name, line) in enumerate(corridors.items())))
        p = F.transform(table, lambda c: F.struct(c["k"].alias("k"), c["corridor"].alias("corridor"), projected(F.col("world_x_m"), F.col("world_y_m"), c["segments"]).alias("p")))
        rows = parked.withColumn("c", F.explode(p)).select(*track, "c.k", "c.corridor", "c.p.s_m", "c.p.offset_m")
    g = rows.where("offset_m IS NOT NULL").groupBy(*track, "k", "corridor").agg(F.median(F.abs("offset_m")).alias("lateral"), F.median("s_m").alias("along"))
    best = g.groupBy(*track).agg(F.min(F.struct("lateral", "k", "corridor", "along")).alias("b")).select(*track, "b.*").join(whole, track)
    dwell = (F.col("f1") - F.col("f0") + 1) / fps
    out = best.select(*track, "mode", "corridor", F.col("along").alias("distance_along_m"), F.col("lateral").alias("lateral_offset_m"), dwell.alias("dwell_s"), (F.col("f0") / fps).alias("start_s"))
    return out.where((F.col("dwell_s") >= min_dwell_s) & (F.col("lateral_offset_m") <= carriageway_m)).withColumn("obstruction", F.when(F.col("lateral_offset_m") <= carriageway_m * 0.5, "in-lane").otherwise("kerbside"))


def collapsed_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, "segment", "interval").agg(F.sum("flow_veh_per_h").alias("q"), F.sum("density_veh_per_km").alias("k"), F.avg("density_veh_per_km").alias("mean_k"), F.avg("speed_kmh").alias("v"), F.min("segment_start_m").alias("seg_m"), F.min("interval_start_s").alias("t_s"))


def shock_fronts(cells: DataFrame, congested_kmh: float = 15.0, by: Sequence[str] = ()) -> DataFrame:
    """Adjacent segments of which just one is congested, with the wave speed that conservation of vehicles gives."""
    c = collapsed_cells(cells, by)
    w = Window.partitionBy(*by, "interval").orderBy("segment")
    nxt = {f"{x}2": F.when(F.lead("segment").over(w) == F.col("segment") + 1, F.lead(x).over(w)) for x in ("q", "k", "v")}
    c = c.withColumns(nxt).where((F.col("v") < congested_kmh) != (F.col("v2") < congested_kmh))
    c = c.where(F.abs(F.col("k2") - F.col("k")) >= 1e-6).withColumn("u_mps", (F.col("q2") - F.col("q")) / (F.col("k2") - F.col("k")) / 3.6)
    return c.where(F.abs("u_mps") <= 30).select(*by, "segment", "interval", "seg_m", "t_s", F.col("q").alias("q_up"), F.col("q2").alias("q_down"), F.col("k").alias("k_up"), F.col("k2").alias("k_down"), "u_mps")


def shockwave(fronts: DataFrame, least: int = 4, by: Sequence[str] = ()) -> DataFrame:
    g = fronts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fronts"), F.median("u_mps").alias("median_mps"), F.percentile("u_mps", F.lit(0.25)).alias("p25_mps"), F.percentile("u_mps", F.lit(0.75)).alias("p75_mps"), F.avg((F.col("u_mps") < 0).cast("double")).alias("upstream_share"))
    return g.where(F.col("n_fronts") >= least).withColumn("direction", F.when(F.col("median_mps") < -0.2, "upstream").when(F.col("median_mps") > 0.2, "downstream").otherwise("stationary"))


def congestion_regions(cells: DataFrame, place: str | None = None, congested_kmh: float = 15.0, min_cells: int = 4) -> DataFrame:
    """Connected congested regions of each place's space-time grid, their origins and edge speeds. place: a column that names corridor and recording.

    Neighbouring slow segments of an interval are one run, runs of following intervals that share a segment are joined, and components of runs are
    regions, so a grid of any size is spread over tasks. The edge is the least slow distance at each time; its slopes are of the whole life, up to its first least
    place, and from there on, each of three times or more. A wave's verdict needs no more than these.
    """
    c = cells.withColumn("place", F.col(place).cast("string") if place else F.lit("all"))
    c = c.groupBy("place", "segment", "interval").agg(F.avg("speed_kmh").alias("v"), F.avg("density_veh_per_km").alias("k"), F.min("segment_start_m").alias("seg_m"), F.min("interval_start_s").alias("t_s"))
    clip = c.groupBy("place").agg(F.min("t_s").alias("clip"))
    row = Window.partitionBy("place", "interval").orderBy("segment")
    slow = c.where(F.col("v") < congested_kmh)
    slow = slow.withColumn("_new", F.coalesce((F.col("segment") - F.lag("segment").over(row) > 1).cast("int"), F.lit(1)))
    slow = cut(slow.withColumn("run", F.struct("place", "interval", F.sum("_new").over(row).alias("n"))).drop("_new"))
    later = slow.select("place", "segment", (F.col("interval") - 1).alias("interval"), F.col("run").alias("b"))
    found = components(slow.join(later, ["place", "segment", "interval"]).select(F.col("run").alias("a"), "b").distinct())
    own = slow.join(found.select(F.col("node").alias("run"), "component"), "run", "left").withColumn("region", F.coalesce("component", "run"))
    own = own.select("region", "place", "seg_m", "t_s", "v", "k")
    whole = own.groupBy("region", "place").agg(F.count(F.lit(1)).alias("cells"), F.min(F.struct("t_s", "v", "seg_m")).alias("o"), F.max("t_s").alias("end_s"), (F.max("seg_m") - F.min("seg_m")).alias("extent_m"), F.min("v").alias("min_speed_kmh"), F.max("k").alias("peak_density_veh_km")).where(F.col("cells") >= min_cells)
    edge = own.groupBy("region", "t_s").agg(F.min("seg_m").alias("e"))
    edge = edge.join(edge.groupBy("region").agg(F.min(F.struct("e", "t_s"))["t_s"].alias("turn"), F.count(F.lit(1)).alias("m")), "region")
    slope = lambda on: F.when((F.count_if(on) >= 3) & (F.first("m") >= 3), F.regr_slope(F.when(on, F.col("e")), F.when(on, F.col("t_s"))))
    edge = edge.groupBy("region").agg(slope(F.lit(True)).alias("shockwave_mps"), slope(F.col("t_s") <= F.col("turn")).alias("stopping_wave_mps"), slope(F.col("t_s") >= F.col("turn")).alias("starting_wave_mps"))
    out = whole.join(edge, "region").join(clip, "place")
    return out.select(
        "place",
        "cells",
        F.col("o.seg_m").alias("origin_distance_m"),
        F.col("o.t_s").alias("origin_time_s"),
        F.col("o.v").alias("origin_speed_kmh"),
        F.col("o.t_s").alias("start_s"),
        "end_s",
        "extent_m",
        "min_speed_kmh",
        "peak_density_veh_km",
        "shockwave_mps",
        "stopping_wave_mps",
        "starting_wave_mps",
        (F.abs(F.col("o.t_s") - F.col("clip")) < 1e-6).alias("predates"),
    )


def lagged_products(sec: DataFrame, low_s: int, high_s: int, block_s: int = 16_384) -> DataFrame:
    """stream, lag, p: of counts c by second (stream, s, c) the sums of products c(s) c(s + lag), for lags in [low_s, high_s).

    A stream is dealt out by blocks of seconds. A block also gets the first high_s seconds of the next one, so each task multiplies
    its own counts with all that follow them, and only a sum per block and lag leaves it.
    """
    block = F.floor(F.col("s") / block_s).cast("int")
    copies = F.when(F.col("s") - block * block_s < high_s, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = sec.select("stream", "s", "c", F.explode(copies).alias("block"))

    def multiplied(g: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(block_s + high_s, np.int64)
        c[g["s"].to_numpy() - int(g["block"].iloc[0]) * block_s] = g["c"].to_numpy()
        sums = [int(c[:block_s] @ c[lag : lag + block_s]) for lag in range(low_s, high_s)]
        return pd.DataFrame({"stream": g["stream"].iloc[0], "lag": range(low_s, high_s), "p": sums})

    sums = dealt.groupBy("stream", "block").applyInPandas(multiplied, f"stream {dict(sec.dtypes)['stream']}, lag int, p long")
    return sums.where("p > 0").groupBy("stream", "lag").agg(F.sum("p").alias("p"))


def periodicity(crossings: DataFrame, low_s: int = 25, high_s: int = 180, least: int = 20, span_s: float = 75.0) -> DataFrame:
    """Per stream the lag in [low_s, high_s) with the largest autocorrelation of counts by second, and how it stands out.

    Only seconds with crossings are paired: with counts c and mean m over n seconds, the sum of (c - m)(c' - m) at a lag is the
    sum of c c' less the mean's share of the sums over the leading and trailing seconds, so the work follows the crossings.
    """
    b = crossings.groupBy("stream").agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"), F.count(F.lit(1)).alias("n"), F.count("t_s").alias("k")).where((F.col("n") >= least) & (F.col("t1") - F.col("t0") >= span_s))
    sec = crossings.join(b.select("stream", "t0"), "stream").groupBy("stream", F.floor(F.col("t_s") - F.col("t0")).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    size = b.select("stream", (F.floor(F.col("t1") - F.col("t0")) + 1).cast("int").alias("len"), "n", "k")
    total = sec.join(size, "stream").withColumn("m", F.col("n") / F.col("len"))
    var = total.groupBy("stream", "len", "m").agg((F.sum(F.col("c") * F.col("c")) - F.first("n") * F.first("m")).alias("var"))
    lags = var.withColumn("lag", F.explode(F.sequence(F.lit(low_s), F.least(F.lit(high_s - 1), F.col("len") - 1))))
    prod = lagged_products(sec, low_s, high_s)
    # All but the last, or the first, `lag` seconds: the whole sum less what the few seconds at that end hold.
    near = sec.join(size, "stream").where((F.col("s") < high_s) | (F.col("s") >= F.col("len") - high_s))
    edges = near.withColumn("lag", F.explode(F.sequence(F.lit(low_s), F.least(F.lit(high_s - 1), F.col("len") - 1))))
    left = lambda out: F.first("k") - F.sum(F.when(out, F.col("c")).otherwise(0))
    ends = edges.groupBy("stream", "lag").agg(left(F.col("s") >= F.col("len") - F.col("lag")).alias("lead"), left(F.col("s") < F.col("lag")).alias("trail"))
    ac = lags.join(prod, ["stream", "lag"], "left").join(ends, ["stream", "lag"], "left")
    value = F.coalesce("p", F.lit(0)) - F.col("m") * (F.coalesce("lead", F.lit(0)) + F.coalesce("trail", F.lit(0))) + F.col("m") * F.col("m") * (F.col("len") - F.col("lag"))
    ac = ac.withColumn("ac", F.try_divide(value, F.col("var")))
    g = ac.groupBy("stream").agg(F.max(F.struct("ac", (-F.col("lag")).alias("l"))).alias("top"), F.median("ac").alias("band"))
    return g.select("stream", (-F.col("top.l")).cast("int").alias("cycle_s"), F.col("top.ac").alias("peak"), (F.col("top.ac") - F.col("band")).alias("prominence"), ((F.col("top.ac") - F.col("band") >= 0.25) & (F.col("top.ac") > 0.2)).alias("periodic"))


def complementarity(crossings: DataFrame, bin_s: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every two streams' counts by bin over all streams' common range; under -0.15 they alternate.

    by tells junctions apart: only a junction's own streams, which are a few, are paired. Rows meet by equal bins, and empty bins enter as counts alone.
    """
    if not by:
        return complementarity(crossings.withColumn("_junction", F.lit(0)), bin_s, ["_junction"]).drop("_junction")
    by = list(by)
    ends = crossings.groupBy(*by, "stream").agg(F.min("t_s").alias("a"), F.max("t_s").alias("b")).groupBy(*by).agg(F.max("a").alias("t0"), F.min("b").alias("t1"))
    rows = crossings.join(ends, by).where("t_s >= t0 AND t_s < t1").withColumn("bin", F.floor((F.col("t_s") - F.col("t0")) / bin_s).cast("int"))
    h = rows.groupBy(*by, "stream", "bin").agg(F.count(F.lit(1)).alias("c"), F.max(F.ceil((F.col("t1") - F.col("t0")) / bin_s)).alias("n"))
    m = h.groupBy(*by, "stream").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.max("n").alias("n"))
    x, y = m.select(*by, F.col("stream").alias("first"), F.col("s").alias("s1"), F.col("ss").alias("ss1"), "n"), m.select(*by, F.col("stream").alias("second"), F.col("s").alias("s2"), F.col("ss").alias("ss2"))
    both = h.select(*by, F.col("stream").alias("first"), "bin", F.col("c").alias("c1")).join(h.select(*by, F.col("stream").alias("second"), "bin", F.col("c").alias("c2")), [*by, "bin"])
    both = both.where("first < second").groupBy(*by, "first", "second").agg(F.sum(F.col("c1") * F.col("c2")).alias("p"))
    out = x.join(y, by).where("first < second").join(both, [*by, "first", "second"], "left")
    cov = F.coalesce("p", F.lit(0)) * F.col("n") - F.col("s1") * F.col("s2")
    sd = F.sqrt((F.col("ss1") * F.col("n") - F.col("s1") * F.col("s1")).cast("double")) * F.sqrt((F.col("ss2") * F.col("n") - F.col("s2") * F.col("s2")).cast("double"))
    return out.select(*by, "first", "second", F.try_divide(cov.cast("double"), sd).alias("correlation")).withColumn("alternating", F.col("correlation") < -0.15)


def lane_density(df: DataFrame, line: Line | None, width_m: float = 0.35, step_m: float = 0.1, reach_m: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """A Gaussian kernel density of offsets on a grid: offsets are first counted in fine cells (a hundredth of a metre), so the work
    after the scan does not grow with the rows."""
    fine = on_corridor(df, line, reach_m).groupBy(*by, F.rint(F.col("offset_m") * 100).cast("int").alias("o")).agg(F.count(F.lit(1)).alias("c"))
    n = round(2 * reach_m / step_m) + 1
    cells = fine.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.col("g") * step_m - reach_m)
    z = (F.col("x") - F.col("o") / 100.0) / width_m
    out = cells.groupBy(*by, "g").agg(F.min("x").alias("x_m"), F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("density"))
    mean, w = F.avg("density").over(Window.partitionBy(*by)), Window.partitionBy(*by).orderBy("g").rowsBetween(-4, 4)
    return out.withColumn("peak", (F.col("density") == F.max("density").over(w)) & (F.col("density") > 1.15 * mean))


def lane_structure(density: DataFrame, lane_width_m: float = 3.2, by: Sequence[str] = ()) -> DataFrame:
    """The density's peaks, merged where they are closer than 0.55 of a lane to the last that was kept."""
    peaks = density.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("peak"), F.col("x_m")))).alias("p"))
    return _merged(peaks, lane_width_m).select(*by, "mode_offsets_m", "n_lanes")


def _merged(peaks: DataFrame, lane_width_m: float) -> DataFrame:
    kept = F.aggregate("p", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= 0.55 * lane_width_m), F.concat(a, F.array(x))).otherwise(a))
    return peaks.withColumn("mode_offsets_m", kept).withColumn("n_lanes", F.size("mode_offsets_m"))


def lane_verdict(density: DataFrame, lane_width_m: float = 3.2, spacing_m: tuple[float, float] = (2.4, 4.2), sharp: float = 2.2, by: Sequence[str] = ()) -> DataFrame:
    """Whether traffic keeps to lanes: the density's peaks, their median spacing, the modality index ((most - least) / mean) and a verdict.

    Bands about a lane apart are lanes, clear where the density is sharp and else weak. One sharp band is the road, not a lane: a
    single undifferentiated stream; without sharpness there is no structure (absent). A density without rows gives no row.
    """
    modality = (F.max("density") - F.min("density")) / F.greatest(F.avg("density"), F.lit(1e-9))
    whole = density.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("peak"), F.col("x_m")))).alias("p"), modality.alias("modality_index")).where("modality_index IS NOT NULL")
    out = _merged(whole, lane_width_m).select(*by, "mode_offsets_m", "n_lanes", "modality_index")
    gaps = F.transform(F.sequence(F.lit(1), F.col("n_lanes") - 1), lambda k: F.element_at("mode_offsets_m", k + 1) - F.element_at("mode_offsets_m", k))
    n, ordered = F.col("n_lanes") - 1, F.array_sort(gaps)
    middle = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2
    out = out.withColumn("spacing_m", F.when(F.col("n_lanes") >= 2, middle))
    lanes = F.coalesce(F.col("spacing_m").between(*spacing_m), F.lit(False))
    verdict = F.when(lanes & (F.col("modality_index") >= sharp), "clear").when(lanes, "weak").when(F.col("modality_index") >= sharp, "single undifferentiated stream").otherwise("absent")
    return out.withColumns({"lane_like_spacing": lanes, "lane_structure": verdict})


def waits(rows: DataFrame, fps: float, wait_kmh: float = 6.0, by: Sequence[str] = ()) -> DataFrame:
    """by, vehicle, wait_s: when each vehicle is first slow, if it ever is."""
    slow = rows.where(F.col("speed_kmh") < wait_kmh)
    return slow.groupBy(*by, F.col("track_id").alias("vehicle")).agg((F.min("frame") / fps).alias("wait_s"))
