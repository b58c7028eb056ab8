"""The earlier post-processing with known answers, the export, and descriptions."""

import glob
import json
import math

from pyspark.sql import functions as F

from roadweave.functions.expressions import GeoReference
from roadweave.operators import classify as K
from roadweave.operators import legacy as L
from roadweave.operators import serving as V
from roadweave.params import MODES
from roadweave.sources import tables


def boxes():
    """Cars of 44 pixels everywhere; one drives at 3 pixels a frame, one stands, one is twice as long, one flickers."""
    rows = []
    for t in range(12):
        for f in range(60):
            x, y = 100.0 + 3 * f, 60.0 + 80 * t
            rows.append((t, f, x, y, x + 44.0, y + 20.0, 0.9, "car"))
    rows += [(20, f, 300.0, 500.0, 344.0, 520.0, 0.9, "car") for f in range(60) if not 20 <= f < 25]
    rows += [(21, f, 100.0 + 3 * f, 900.0, 200.0 + 3 * f, 930.0, 0.9, "van") for f in range(60)]
    rows += [(22, f, 5.0, 5.0, 49.0, 25.0, 0.9, "car") for f in range(9)]
    return rows


def test_earlier_processing(spark):
    raw = spark.createDataFrame(boxes(), "track_id long, frame int, x1 double, y1 double, x2 double, y2 double, conf double, cls_name string")
    rows, tracks, scale = L.processed(raw, 10.0)
    assert scale.slope == 0 or abs(scale.slope) < 1e-9 and abs(scale.base - 44) < 1e-6
    got = {r["track_id"]: r for r in tracks.collect()}
    assert set(got) == {*range(12), 20, 21} and got[20]["parked"] and not got[3]["parked"]
    assert [got[t]["display_id"] for t in (*range(12), 21)] == list(range(1, 14)) and got[20]["display_id"] is None
    assert got[3]["mode"] == "car" and got[21]["mode"] == "HGV"  # 100 px at 4.3 m for 44 px are 9.8 m
    speed = rows.where("track_id = 3").agg(F.median("speed_mps")).first()[0]
    assert abs(speed - 3 * 4.3 / 44 * 10) < 1e-6 and abs(got[3]["path_m"] - 53 * 3 * 4.3 / 44) < 1e-6  # smoothing moves the first place on by two frames
    assert rows.where("track_id = 20 AND interpolated").count() == 5 and set(tables.LEGACY_COLUMNS) <= set(rows.columns)
    told = {r["metric"]: r["value"] for r in L.report(raw, rows, tracks).collect()}
    assert told["tracks_dropped_short"] == 1 and told["tracks_parked"] == 1 and told["moving_car"] == 12 and told["moving_HGV"] == 1 and told["frames"] == 60
    assert scale.described()["n_car_samples"] == scale.samples > 200


def test_scale_follows_the_row(spark):
    df = spark.range(4000).select((F.col("id") % 1000).cast("double").alias("y"), (30 + 0.02 * (F.col("id") % 1000)).alias("px"))
    s = L.fit_car_scale(df)
    assert abs(s.slope - 0.02) < 1e-4 and abs(s.base - 30) < 0.05
    assert L.fit_car_scale(df.limit(50)).slope == 0 and L.fit_car_scale(df.where("false")).base == 44.0
    steep = L.fit_car_scale(df.withColumn("px", 100 - 0.12 * F.col("y")))
    assert steep.slope == 0


def test_sizes_change_modes(spark):
    rows = [("car", 6.0), ("car", 6.3), ("LGV", 7.6), ("LGV", 9.6), ("truck", 9.6), ("HGV", 9.0), ("bus", 6.9), ("bus", 7.0), ("motorcycle", 12.0), ("car", None)]
    df = spark.createDataFrame(rows, "m string, l double")
    assert [r[0] for r in df.select(L.sized_mode(F.col("m"), F.col("l"))).collect()] == ["car", "LGV", "truck", "HGV", "HGV", "truck", "LGV", "bus", "motorcycle", "car"]


def test_classes_are_known_modes(spark):
    import __spark_entry__ as e

    rows = e.queries()["f15_classified"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r["final_mode"] for r in rows} | {r["appearance_mode"] for r in rows} <= set(MODES)
    assert {r["classification_source"] for r in rows} <= {"appearance", "appearance_fallback_no_calibration", "length_override", "appearance_and_length"}
    assert all(0 <= r["mode_confidence"] <= 1 for r in rows) and K.BUS_MIN_M == 7.0


def test_export_and_descriptions(spark, tmp_path):
    geo = GeoReference(18.5, 73.7, 233.6, 70.0, 1.2, 0.5, 9)
    told = geo.described()
    assert told["origin_lat"] == 18.5 and told["position_uncertainty_at_100m_m"] == round(100 * math.radians(1.2), 2) and told["telemetry_samples"] == 9
    sections = {"od": spark.createDataFrame([("W", 3, float("nan"))], "origin string, count int, share double"), "none": spark.createDataFrame([], "a int")}
    V.bundle(sections, str(tmp_path / "out"))
    rows = [json.loads(x) for f in glob.glob(f"{tmp_path}/out/od/*.json") for x in open(f)]
    assert rows == [{"origin": "W", "count": 3, "share": None}]
