"""What a viewer is served: overlay chunks, track details and GeoJSON features.

Every table keys its rows by recording where it is given such a column, and a group never exceeds what one chunk or one track holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.expressions import GeoReference
from roadweave.operators import aggregates as A
from roadweave.params import MODES
from roadweave.sources.tables import feature

#: The codes of modes (their places in MODES, 2 for any other) and of motion states (3 for any other).
MODE_CODES = {mode: k for k, mode in enumerate(("pedestrian", "motorcycle", "car", "LGV", "truck", "HGV", "bus"))}
STATE_CODES = {"moving": 0, "temporarily_stopped": 1, "parked": 2, "unknown": 3}
assert set(MODE_CODES) == set(MODES)

BOX = "struct<display_id:bigint,mode:int,x1:int,y1:int,x2:int,y2:int,speed_kmh:double,state:int,acceleration:double>"


def coded(column: Column, codes: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, code in codes.items():
        out = F.when(column == name, code).otherwise(out)
    return out.cast("int")


def shown(df: DataFrame) -> DataFrame:
    """The rows that are drawn: of tracks that are not parked and have a display id."""
    return df.where(~F.coalesce("parked", F.lit(False)) & F.col("display_id").isNotNull())


def frame_groups(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """frame, boxes: the drawn rows of each frame by display id."""
    return shown(df).groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(F.struct("display_id", "mode", "motion_state", "x1", "y1", "x2", "y2"))).alias("boxes"))


def overlay_chunks(df: DataFrame, fps: float, chunk_s: float = 10.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """chunk, frames: per interval of chunk_s a map from frame to the boxes drawn in it, by display id.

    Edges are rounded to whole pixels, speeds and accelerations to a tenth (halves to even), and modes and states are codes; what is
    unknown is NULL. A frame without drawn rows has no entry, nor has a chunk.
    """
    whole = lambda c: F.rint(c).cast("int").alias(c)
    box = F.struct(
        F.col("display_id").cast("long").alias("display_id"),
        coded(F.col("mode"), MODE_CODES, 2).alias("mode"),
        *map(whole, ("x1", "y1", "x2", "y2")),
        F.bround("speed_kmh", 1).alias("speed_kmh"),
        coded(F.col("motion_state"), STATE_CODES, 3).alias("state"),
        F.bround("longitudinal_acceleration_mps2", 1).alias("acceleration"),
    )
    rows = shown(df).select(*keys, F.floor(F.col("frame") / F.lit(float(fps)) / chunk_s).cast("int").alias("chunk"), "frame", box.alias("box"))
    frames = rows.groupBy(*keys, "chunk", "frame").agg(F.sort_array(F.collect_list("box")).alias("boxes"))
    return frames.groupBy(*keys, "chunk").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("frame").cast("int").alias("frame"), "boxes")))).alias("frames"))


def track_details(df: DataFrame, movements: DataFrame, every: int = 10) -> DataFrame:
    """Per track its mode, span, speeds, origin and destination (NULL without a movement), and every tenth of its places."""
    place = F.when(F.col("world_x_m").isNotNull() & F.col("world_y_m").isNotNull(), F.struct("frame", F.round("world_x_m", 2).alias("x"), F.round("world_y_m", 2).alias("y")))
    g = df.groupBy("track_id").agg(
        F.min_by("mode", "frame").alias("mode"),
        F.min("frame").alias("f0"),
        F.max("frame").alias("f1"),
        F.median("speed_kmh").alias("median_speed_kmh"),
        F.max("speed_kmh").alias("max_speed_kmh"),
        F.sort_array(F.collect_list(place)).alias("p"),
    )
    path = F.transform(F.filter("p", lambda x, k: k % every == 0), lambda x: F.array(x["x"], x["y"]))
    return g.withColumn("path", path).drop("p").join(movements.select("track_id", "origin", "destination", "turn"), "track_id", "left")


def od_heat(movements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Real movements by origin and destination, and as a share of the recording's largest cell."""
    g = A.counted(movements).groupBy(*by, "origin", "destination").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("heat", F.col("count") / F.max("count").over(Window.partitionBy(*by)))


def top_movements(movements: DataFrame, top: int = 8) -> DataFrame:
    """The `top` most frequent pairs and turns, ties by name."""
    return A.od_summary(movements).orderBy(F.desc("count"), "origin", "destination", "turn").limit(top)


def pce_shares(movements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each mode's share of the vehicles and of their passenger-car equivalents, in percent."""
    m = A.modal_split(movements, by)
    return m.select(*by, "mode", "share_pct", (100.0 * F.col("pce_total") / F.sum("pce_total").over(Window.partitionBy(*by))).alias("pce_share_pct"))


def approach_pivot(movements: DataFrame, fps: float, names: Sequence[str], interval_s: float = 60.0, by: Sequence[str] = ()) -> DataFrame:
    """Entering vehicles of each whole interval by approach, whose names are given, and their total."""
    p = A.approach_volumes(movements, fps, interval_s, by).where("NOT partial").groupBy(*by, "interval").pivot("approach", list(names)).agg(F.sum("entering")).fillna(0)
    return p.withColumn("total", sum((F.col(f"`{n}`") for n in names), F.lit(0).cast("long")))


def lane_pivot(movements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vehicles by entry lane, a column for each mode."""
    return A.lane_volumes(movements, by).groupBy(*by, "origin", "lane_in").pivot("mode", list(MODES)).agg(F.sum("count")).fillna(0)


def slowest_bin(profile: DataFrame) -> DataFrame:
    """The slowest bin of a corridor's speed profile without its end bins, the first of equal ones."""
    ends = profile.agg(F.min("bin").alias("low"), F.max("bin").alias("high"))  # one row
    return profile.crossJoin(F.broadcast(ends)).where("bin > low AND bin < high").orderBy("mean_speed_kmh", "bin").limit(1).drop("low", "high")


def overlay_filter(df: DataFrame, min_kmh: float, keys: Sequence[str] = ()) -> DataFrame:
    """Live vehicles by frame and mode of at least a speed; an unknown speed counts as 0."""
    return df.where(F.coalesce("speed_kmh", F.lit(0.0)) >= min_kmh).groupBy(*keys, "frame", "mode").agg(F.count(F.lit(1)).alias("live"))


def overlapping(df: DataFrame, start_s: float, end_s: float, fps: float, keys: Sequence[str] = ()) -> DataFrame:
    """Tracks, with their first and last frames, whose time on screen overlaps a window."""
    g = df.groupBy(*keys, "track_id").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return g.where((F.col("f0") <= end_s * fps) & (F.col("f1") >= start_s * fps))


def draw_order(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, frame, track_id, place: boxes of each frame from the largest to the smallest."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return df.select(*keys, "frame", "track_id", F.row_number().over(Window.partitionBy(*keys, "frame").orderBy(area.desc(), "track_id")).alias("place"))


def waiting(df: DataFrame, slow_kmh: float = 6.0, keys: Sequence[str] = ()) -> DataFrame:
    """Of each frame the vehicles shown and those of them that are slow."""
    return df.groupBy(*keys, "frame").agg(F.count_if((F.col("speed_kmh") < slow_kmh) & ~F.col("parked")).alias("waiting"), F.count_if(~F.col("parked")).alias("shown"))


def cumulative_modes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct tracks of each mode that have been seen up to each frame with a first sight."""
    first = df.groupBy(*keys, "track_id").agg(F.min("frame").alias("frame"), F.min("mode").alias("mode"))
    per = first.groupBy(*keys, "mode", "frame").agg(F.count(F.lit(1)).alias("new"))
    return per.withColumn("seen", F.sum("new").over(Window.partitionBy(*keys, "mode").orderBy("frame")))


def trails(df: DataFrame, length: int = 24) -> DataFrame:
    """frame, track_id, trail: of each moving row the places of the track's last `length` moving rows, itself the last."""
    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(-(length - 1), 0)
    moving = df.where("motion_state = 'moving' AND cx IS NOT NULL AND cy IS NOT NULL")
    return moving.select("frame", "track_id", F.collect_list(F.struct("cx", "cy")).over(w).alias("trail"))


def peak_queues(queues: DataFrame) -> DataFrame:
    """Of all approaches' queues (approach, t_s, queue_vehicles, queue_length_m) the longest, the earliest of equal ones."""
    best = F.max(F.struct("queue_vehicles", "queue_length_m", (-F.col("t_s")).alias("at"), "approach")).alias("b")
    return queues.agg(best).where("b IS NOT NULL").select("b.approach", (-F.col("b.at")).alias("t_s"), "b.queue_vehicles", "b.queue_length_m")


def lonlat(geo: GeoReference | None, x: Column, y: Column) -> Column:
    """A GeoJSON position: longitude and latitude to eight places, or without a reference the metres to two."""
    if geo is None:
        return F.array(F.round(x, 2), F.round(y, 2))
    lat, lon = geo.to_wgs84(x, y)
    return F.array(F.round(lon, 8), F.round(lat, 8))


def point_features(rows: DataFrame, geo: GeoReference | None, properties: list[str]) -> DataFrame:
    """The properties and feature: a GeoJSON point (JSON text) of every row with a place."""
    at = F.struct(F.lit("Point").alias("type"), lonlat(geo, F.col("x"), F.col("y")).alias("coordinates"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL").select(*properties, feature(at, F.struct(*properties)).alias("feature"))


def desire_lines(od: DataFrame, centrelines: DataFrame, gates: DataFrame, geo: GeoReference | None = None) -> DataFrame:
    """origin, destination, points and a GeoJSON line of every pair of od (origin, destination, turn, count, share_pct): its centreline, else the chord between its gates; a pair with neither has no row.

    All tables have a row per gate or pair of gates (a centreline some more), so they meet by broadcast where Spark sees that.
    """
    own = centrelines.groupBy("origin", "destination").agg(F.sort_array(F.collect_list(F.struct("node", "x", "y"))).alias("line"))
    at = lambda k: gates.select(F.col("name").alias(k), F.struct("x", "y").alias(f"_{k}"))
    rows = od.join(own, ["origin", "destination"], "left").join(at("origin"), "origin", "left").join(at("destination"), "destination", "left")
    chord = F.when(F.col("_origin").isNotNull() & F.col("_destination").isNotNull(), F.array("_origin", "_destination"))
    points = F.coalesce(F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), chord)
    rows = rows.withColumn("p", points).where("p IS NOT NULL")
    line = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda p: lonlat(geo, p["x"], p["y"])).alias("coordinates"))
    return rows.select("origin", "destination", F.size("p").alias("points"), feature(line, F.struct("origin", "destination", "turn", "count", "share_pct")).alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One row: all features as one GeoJSON FeatureCollection, for the small sets that a map shows. Larger ones go to lines by write_features."""
    text = F.array_join(F.sort_array(F.collect_list("feature")), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), text, F.lit("]}")).alias("collection"))


def bundle(sections: dict[str, DataFrame], folder: str) -> None:
    """A static export: each section's rows as JSON lines in a folder of its name. Unknowns are null, and no value is NaN."""
    for name, rows in sections.items():
        finite = {c: F.when(~F.isnan(c), F.col(c)) for c, t in rows.dtypes if t in ("double", "float")}
        rows.withColumns(finite).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")
