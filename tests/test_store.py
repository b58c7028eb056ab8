"""Stages that are not made twice, stores whose look-ups read little, sinks, and long paths in linear time."""

import csv
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from roadweave.functions.expressions import GeoReference
from roadweave.params import TrackParams
from roadweave.sources import manifest, stages, store, tables


def test_only_later_stages_are_made_again(spark, tmp_path):
    base = spark.range(100).withColumnRenamed("id", "x")
    made = []

    def plan(step, least):
        return [
            stages.Stage("scaled", lambda t, p: made.append("scaled") or t.select((F.col("x") * p["by"]).alias("x")), {"by": step}, ["base"]),
            stages.Stage("kept", lambda t, p: made.append("kept") or t.where(F.col("x") >= p.min_rows), TrackParams(min_rows=least), ["scaled"]),
            stages.Stage("other", lambda t: made.append("other") or t.agg(F.count(F.lit(1)).alias("n")), None, ["base"]),
            stages.Stage("last", lambda a, b: made.append("last") or a.crossJoin(b), None, ["kept", "other"]),
        ]

    def run(step, least, mark="v1"):
        made.clear()
        r = stages.Run(spark, str(tmp_path / "run"), {"base": (base, mark)})
        out = r.all(plan(step, least))
        assert r.made == made
        return list(made), out["last"].count()

    assert run(2, 8) == (["scaled", "kept", "other", "last"], 96)
    assert run(2, 8) == ([], 96)
    assert run(2, 100) == (["kept", "last"], 50)
    assert run(3, 100)[0] == ["scaled", "kept", "last"]
    assert run(3, 100, "v2")[0] == ["scaled", "kept", "other", "last"]
    entry = stages.Run(spark, str(tmp_path / "run")).entry("kept")
    assert entry["params"]["min_rows"] == 100 and entry["schema"]["fields"][0]["name"] == "x" and os.path.exists(entry["path"])
    # A stage that fails leaves what was committed before.
    bad = stages.Stage("kept", lambda t: t.select(F.raise_error(F.lit("no"))), None, ["base"])
    with pytest.raises(Exception, match="no"):
        stages.Run(spark, str(tmp_path / "run"), {"base": (base, "v1")}).table(bad)
    assert stages.Run(spark, str(tmp_path / "run")).entry("kept") == entry


def test_paths_sidecars_and_sinks(spark, tmp_path):
    assert stages.paths("out/", "clip")["final"] == "out/clip_l2_tracks.parquet" and len(stages.paths("out", "clip")) == 7
    (tmp_path / "clip.SRT").write_text("1\n")
    assert stages.sidecar(spark, str(tmp_path / "clip.MP4")) == str(tmp_path / "clip.SRT") and stages.sidecar(spark, str(tmp_path / "none.MP4")) is None
    manifest.commit(spark, str(tmp_path / "m.json"), "é1")
    manifest.commit(spark, str(tmp_path / "m.json"), "é2")
    assert manifest.read(spark, str(tmp_path / "m.json")) == "é2" and not glob.glob(str(tmp_path / "*.tmp"))
    df = spark.createDataFrame([(2, 1, None, "car", 0.5, None), (1, 1, 7, "bus", 0.25, 1.23456)], "frame int, track_id long, display_id long, mode string, conf double, speed_kmh double")
    assert stages.save_table(df, str(tmp_path / "t.parquet")).endswith(".parquet")
    at = stages.save_table(df.select("frame", F.make_interval(F.lit(1)).alias("span")), str(tmp_path / "odd.parquet"))  # no parquet type
    assert at.endswith("odd.csv") and spark.read.option("header", True).csv(at).columns == ["frame", "span"]
    tables.write_tracks(df, str(tmp_path / "l2"))
    assert "detection_confidence" in tables.read_table(spark, str(tmp_path / "l2")).columns
    tables.write_tracks(df, str(tmp_path / "text"), csv=True)
    rows = [x for f in sorted(glob.glob(str(tmp_path / "text" / "*.csv"))) for x in csv.DictReader(open(f))]
    assert [(x["frame"], x["detection_confidence"], x["speed_kmh"], x["display_id"]) for x in rows] == [("1", "0.2500", "1.2346", "7"), ("2", "0.5000", "", "")]
    whole = df.select("*", F.lit("c").alias("cls_name"), *(F.lit(1.0).alias(c) for c in ("x1", "y1", "x2", "y2", "cx", "cy", "length_m")), F.lit(False).alias("parked"), F.lit(False).alias("interpolated"))
    tables.write_tracks(whole, str(tmp_path / "old"), csv=True, legacy=True)
    rows = [x for f in sorted(glob.glob(str(tmp_path / "old" / "*.csv"))) for x in csv.DictReader(open(f))]
    assert list(rows[0]) == list(tables.LEGACY_COLUMNS) and rows[0]["conf"] == "0.250" and rows[1]["speed_kmh"] == ""


def test_store_reads_few_files(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") + 1).alias("track_id")).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(49))))
    rows = rows.withColumn("frame", (F.col("frame") + F.col("track_id") % 10 * 30).cast("int")).select(
        "track_id", "frame", F.when(F.col("track_id") % 5 > 0, F.col("track_id")).alias("display_id"), F.lit("car").alias("mode"), F.lit("moving").alias("motion_state"), *(F.lit(1.0).alias(c) for c in ("x1", "y1", "x2", "y2")),
        F.col("frame").cast("double").alias("world_x_m"), F.lit(0.0).alias("world_y_m"), F.lit(36.0).alias("speed_kmh"), F.lit(0.0).alias("longitudinal_acceleration_mps2"), (F.col("track_id") % 5 == 0).alias("parked"),
    )
    s = store.Store(spark, str(tmp_path / "store"))
    for name in ("a", "b"):
        s.load(store.Meta(name, 1920, 1080, 10.0, 320), rows.where("track_id <= 100") if name == "b" else rows)
    s = store.Store(spark, str(tmp_path / "store"))  # opened again
    assert s.meta("a") == store.Meta("a", 1920, 1080, 10.0, 320) and s.meta("a").duration_s == 32.0 and s.meta("a").chunks == 4
    one = s.track("a", 123)
    assert [(r["track_id"], r["f0"], r["f1"], r["origin"]) for r in one.collect()] == [(123, 90, 139, None)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(display_id), EqualTo(display_id,123)]" in plan
    # Of the files of all tracks the ranges of one hold the id.
    spans = [spark.read.parquet(f).agg(F.min("display_id"), F.max("display_id")).first() for f in spark.read.parquet(f"{tmp_path}/store/details/{s._entry('a')['load']}").inputFiles()]
    assert len(spans) == 8 and sum(a <= 123 <= b for a, b in spans) == 1
    chunk = s.chunk("a", 2)
    assert len([f for f in spark.read.parquet(f"{tmp_path}/store/overlay/{s._entry('a')['load']}").inputFiles() if "chunk=2" in f]) == 1 and "PartitionFilters: [isnotnull(chunk" in chunk._jdf.queryExecution().executedPlan().toString()
    frames = chunk.first()["frames"]
    assert min(frames) == 200 and max(frames) == 299 and s.chunk("a", 99).count() == 0 and s.track("b", 123).count() == 0
    s.load(store.Meta("b", 1920, 1080, 10.0, 320), rows)
    assert s.track("b", 123).count() == 1 and s.track("a", 123).count() == 1
    with pytest.raises(KeyError):
        s.meta("none")
    with pytest.raises(KeyError):
        s.section("a", "od")


def test_long_paths_are_simplified_in_linear_time(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("track_id"), F.col("id").cast("int").alias("frame"), F.lit("car").alias("mode"), (F.col("id") * 0.5).alias("world_x_m"), F.when(F.col("id") % 7 > 0, 0.0).alias("world_y_m"), F.lit(36.0).alias("speed_kmh"))
    more = spark.createDataFrame([(2, 0, "bus", 0.0, 0.0, None), (2, 1, "bus", 0.4, 0.0, 5.0), (3, 0, "bus", 0.0, 0.0, 4.0), (3, 1, "bus", 0.6, 0.8, None), (3, 2, "car", None, None, 9.0)], "track_id long, frame int, mode string, world_x_m double, world_y_m double, speed_kmh double")
    begun = time.time()
    got = {r["track_id"]: r for r in tables.trajectories(df.unionByName(more), GeoReference(18.5, 73.7, 0.0)).collect()}
    assert time.time() - begun < 60 and set(got) == {1, 3}
    last, want = None, 0
    for k in range(n):
        if k % 7 and (last is None or (k - last) * 0.5 >= 1.0):
            last, want = k, want + 1
    assert got[1]["points"] == want and json.loads(got[1]["feature"])["properties"] == {"track_id": 1, "mode": "car", "median_speed_kmh": 36.0, "points": want}
    assert json.loads(got[3]["feature"])["properties"]["median_speed_kmh"] == 4.0
