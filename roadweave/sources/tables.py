"""Tables, telemetry text and GeoJSON."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.expressions import GeoReference, known, metres_per_degree
from roadweave.operators.scan import scanned

#: The columns of the table of analysed tracks, in order.
TRACK_COLUMNS = ("frame", "timestamp_s", "track_id", "display_id", "mode", "motion_state", "conf", "x1", "y1", "x2", "y2", "cx", "cy", "world_x_m", "world_y_m", "velocity_x_mps", "velocity_y_mps", "speed_mps", "speed_kmh", "acceleration_x_mps2", "acceleration_y_mps2", "acceleration_mps2", "longitudinal_acceleration_mps2", "lateral_acceleration_mps2", "heading_deg", "kinematics_valid", "kinematics_quality", "interpolated", "interpolated_fraction_in_window", "parked")

#: The columns of the earlier table, in order.
LEGACY_COLUMNS = ("frame", "track_id", "display_id", "mode", "cls_name", "conf", "x1", "y1", "x2", "y2", "cx", "cy", "speed_kmh", "length_m", "parked", "interpolated")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header where the path ends in .csv; NaN in any double column becomes NULL."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).option("inferSchema", schema is None).csv(path) if path.endswith(".csv") else reader.parquet(path)
    return df.withColumns({c: known(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_tracks(df: DataFrame, path: str, csv: bool = False, legacy: bool = False) -> None:
    """The known columns that df has, with conf renamed; parquet sorted within tasks by frame, or CSV with four decimals and blank unknowns.

    legacy: the sixteen columns of the earlier table, all of which df has to have, under their own names, with three decimals in CSV.
    """
    out = df.select(*LEGACY_COLUMNS) if legacy else df.select(*(c for c in TRACK_COLUMNS if c in df.columns)).withColumnRenamed("conf", "detection_confidence")
    order = [c for c in ("frame", "display_id") if c in out.columns]
    if csv:
        out = out.select(*(F.when(F.col(c).isNotNull(), F.format_string("%.3f" if legacy else "%.4f", c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))
        out.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    else:
        out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


_FIELDS = {"iso": "iso", "shutter": "shutter", "lat": "latitude", "lon": "longitude", "rel_alt": "rel_alt", "abs_alt": "abs_alt", "gb_yaw": "gb_yaw", "gb_pitch": "gb_pitch", "focal_len": "focal_len"}


def telemetry_of(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Fields of subtitle blocks; one that is missing or malformed is NULL. A block's number, less one, is its frame."""
    text = F.col(column)
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract({column}, '{name}\\\\s*:\\\\s*([-+]?[0-9]*\\\\.?[0-9]+)', 1), '') AS double)")
    frame = F.expr(f"try_cast(nullif(regexp_extract({column}, '^\\\\s*([0-9]+)\\\\s', 1), '') AS int) - 1")
    stamp = F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?)", 1), F.lit(""))
    return blocks.where(F.trim(text) != "").select(frame.alias("frame"), stamp.alias("timestamp"), *(number(pattern).alias(name) for name, pattern in _FIELDS.items() if name not in ("iso", "shutter")))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """A subtitle file, read by blank-line blocks, so a long one is split among tasks."""
    return telemetry_of(spark.read.option("lineSep", "\n\n").text(path))


def aligned(telemetry: DataFrame, n_frames: int, bucket: int = 10_000) -> DataFrame:
    """One row per frame 0..n-1; a frame without telemetry takes the last known values before it. Dealt out by buckets of frames."""
    cols = [c for c in telemetry.columns if c != "frame"]
    all_ = telemetry.sparkSession.range(n_frames).select(F.col("id").cast("int").alias("frame")).join(telemetry, "frame", "left")
    rows = all_.select("frame", *(F.col(c).alias(f"_{c}") for c in cols))
    return scanned(rows, [], "frame", bucket, upto={c: F.col(f"_{c}") for c in cols}).select("frame", *cols)


def georeference(telemetry: DataFrame, yaw_offset_deg: float = 0.0, bucket: int = 10_000) -> GeoReference | None:
    """The frame's origin and bearing from telemetry medians, one row; None without any usable entry. The yaw is unwound in order of frames, dealt out by buckets."""
    t = telemetry.where("lat IS NOT NULL AND lon IS NOT NULL AND gb_yaw IS NOT NULL")
    t = scanned(t, [], "frame", bucket, before={"_yaw": F.col("gb_yaw")})
    turn = F.coalesce(F.pmod(F.col("gb_yaw") - F.col("_yaw") + 180.0, F.lit(360.0)) - 180.0, F.lit(0.0))
    t = scanned(t, [], "frame", bucket, totals={"_u": turn})
    yaw = F.degrees(F.atan2(F.median(F.sin(F.radians("gb_yaw"))), F.median(F.cos(F.radians("gb_yaw")))))
    reach = lambda c: F.max(c) - F.min(c)
    r = t.agg(F.count(F.lit(1)).alias("n"), F.median("lat").alias("lat"), F.median("lon").alias("lon"), yaw.alias("yaw"), F.median(F.coalesce("rel_alt", F.lit(0.0))).alias("alt"), reach("_u").alias("spread"), reach("lat").alias("dlat"), reach("lon").alias("dlon")).first()
    if not r["n"]:
        return None
    a, b = metres_per_degree(r["lat"])
    return GeoReference(r["lat"], r["lon"], (r["yaw"] + yaw_offset_deg) % 360.0, r["alt"], r["spread"], ((r["dlat"] * a) ** 2 + (r["dlon"] * b) ** 2) ** 0.5, r["n"])


def feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def kept_points(df: DataFrame, least_m: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each track's simplified path: its first known place, and each that is at least least_m from the last kept one.

    One pass over rows in order, in Arrow batches; only the last kept place is held between them, so a track of any length takes linear time.
    """
    track, least = [*keys, "track_id"], least_m * least_m

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, px, py = None, 0.0, 0.0
        for batch in batches:
            keep = []
            for *t, x, y in zip(*(batch.column(k).to_pylist() for k in (*track, "world_x_m", "world_y_m"))):
                far = t != last or (x - px) ** 2 + (y - py) ** 2 >= least
                if far:
                    last, px, py = t, x, y
                keep.append(far)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = df.where("world_x_m IS NOT NULL AND world_y_m IS NOT NULL").repartition(*track).sortWithinPartitions(*track, "frame")
    return rows.mapInArrow(fold, rows.schema)


def trajectories(df: DataFrame, geo: GeoReference, least_m: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys, track_id, points and a GeoJSON feature (JSON text) of every track's simplified path of two or more points; with speeds, their median over these."""
    has = "speed_kmh" in df.columns
    rows = df.select(*keys, "track_id", "frame", "mode", "world_x_m", "world_y_m", *["speed_kmh"] * has)
    lat, lon = geo.to_wgs84(F.col("world_x_m"), F.col("world_y_m"))
    kept = kept_points(rows, least_m, keys).withColumn("_p", F.struct("frame", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat")))
    speed = [F.round(F.median("speed_kmh"), 1).alias("median_speed_kmh")] if has else []
    g = kept.groupBy(*keys, "track_id").agg(F.min_by("mode", "frame").alias("mode"), F.count(F.lit(1)).cast("int").alias("points"), F.sort_array(F.collect_list("_p")).alias("p"), *speed).where("points >= 2")
    line = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return g.select(*keys, "track_id", "points", feature(line, F.struct("track_id", "mode", *["median_speed_kmh"] * has, "points")).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature per line (GeoJSON text sequences), so that any number of tasks can write."""
    features.select("feature").write.mode("overwrite").text(path)
