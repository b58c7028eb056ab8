"""Closed loops: ground truth is projected to the image, and what comes back is compared."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import expressions as X
from roadweave.operators import aggregates as A
from roadweave.operators import calibration as C
from roadweave.operators import classify as K
from roadweave.operators import detections as D
from roadweave.operators import network as N
from roadweave.operators import reasoning as R
from roadweave.operators import tracks as T
from roadweave.operators.tracker import Track, Tracker, assignment, motion_quality, tracked
from roadweave.sources import tables as S

FPS = 29.97
CAM = X.GroundPlane(70.472, -63.1, 924.5, 1920, 1080)
SCHEMA = "track_id long, frame int, x1 double, y1 double, x2 double, y2 double, conf double, cls_name string"


def image(gx, gy):
    c, s = CAM._cs
    p = CAM.f_px * (CAM.height_m * c - gy * s) / (gy * c + CAM.height_m * s)
    a = p * c + CAM.f_px * s
    return CAM.width / 2 + gx * a / CAM.height_m, p + CAM.height / 2


def track(i, places, label="car", px=44.0, frames=None):
    rows = []
    for k, (gx, gy) in enumerate(places):
        x, y = image(gx, gy)
        rows.append((i, frames[k] if frames else k, x - px / 2, y - px / 2, x + px / 2, y + px / 2, 0.9, label))
    return rows


def moving(vx, vy=0.0, n=200, x0=-20.0, y0=40.0, acc=0.0):
    return [(x0 + vx * k / FPS + acc * (k / FPS) ** 2 / 2, y0 + vy * k / FPS) for k in range(n)]


@pytest.fixture(scope="module")
def analysed(spark):
    rows = track(1, moving(5)) + track(2, moving(12)) + track(3, moving(8, 4)) + track(4, moving(2, acc=3.0, n=150)) + track(5, [(0.0, 40.0)] * 300) + track(6, moving(90, n=60, x0=-60)) + track(7, moving(6), frames=[k if k < 60 else k + 340 for k in range(200)]) + track(8, moving(5, n=10)) + track(9, moving(5), frames=[k if k < 100 else k + 10 for k in range(200)])
    raw = spark.createDataFrame(rows, SCHEMA)
    return T.analysed(raw, CAM, FPS).cache()


def test_speed_acceleration_and_gaps(analysed):
    speed = {r["track_id"]: r["s"] for r in analysed.groupBy("track_id").agg(F.median("speed_mps").alias("s")).collect()}
    assert abs(speed[1] - 5) < 0.5 and abs(speed[2] - 12) < 1.2 and abs(speed[3] - math.hypot(8, 4)) < 0.9
    assert speed[5] < 0.15 and 8 not in speed and speed[6] is None
    acc = analysed.where("track_id = 4").agg(F.median("longitudinal_acceleration_mps2")).first()[0]
    assert abs(acc - 3) < 0.5
    assert analysed.where("track_id = 7").agg(F.max("segment")).first()[0] == 1
    assert analysed.where("track_id = 9 AND interpolated").count() == 10 and analysed.where("track_id = 9").agg(F.max("segment")).first()[0] == 0
    edge = analysed.where("track_id = 1").orderBy("frame").limit(3)
    assert edge.where("speed_mps IS NOT NULL").count() == 0
    assert analysed.where("speed_mps = 'NaN'").count() == 0


def test_parked_and_states(analysed):
    s = T.track_summary(analysed, FPS)
    parked = {r["track_id"]: r["parked"] for r in s.collect()}
    assert parked[5] and not parked[1] and not parked[6]
    states = T.motion_states(analysed, s)
    ids = [r[0] for r in states.where("display_id IS NOT NULL").select("display_id").distinct().orderBy("display_id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    assert {r[0] for r in states.where("track_id = 5").select("motion_state").distinct().collect()} == {"parked"}


@pytest.mark.parametrize(("label", "metres", "mode"), [("car", 4.3, "car"), ("car", 6.9, "LGV"), ("van", 5.0, "LGV"), ("van", 8.4, "truck"), ("truck", 12.0, "HGV"), ("truck", 8.0, "truck"), ("bus", 11.0, "bus"), ("bus", 5.0, "LGV"), ("pedestrian", 4.0, "pedestrian"), ("motor", 5.0, "motorcycle")])
def test_classes(spark, label, metres, mode):
    x, y = image(0.0, 40.0)
    c, s = CAM._cs
    a = (y - 540) * c + CAM.f_px * s
    px = metres / math.sqrt(CAM.height_m / a * CAM.height_m * CAM.f_px / (a * a))
    df = spark.createDataFrame(track(1, [(0.0, 40.0)] * 30, label, px), SCHEMA).withColumn("interpolated", F.lit(False))
    assert K.classified(df, CAM, 1920, 1080).first()["final_mode"] == mode


def test_calibration_recovers_the_focal_length(spark):
    rows = []
    c, s = CAM._cs
    for k in range(1000):
        y = 100.0 + 900.0 * k / 1000
        a = (y - 540) * c + CAM.f_px * s
        rows.append((y, 4.3 / math.sqrt(CAM.height_m / a * CAM.height_m * CAM.f_px / (a * a))))
    fit = C.choose(spark.createDataFrame(rows, "y double, px double"), 1920, 1080, 70.472, -63.1)
    assert isinstance(fit, X.GroundPlane) and abs(fit.f_px - 924.5) < 20
    assert isinstance(C.choose(spark.createDataFrame(rows[:50], "y double, px double"), 1920, 1080, 70.472, -63.1), X.RowScale)


def test_edie_by_hand_and_refusals(spark):
    line = [(0.0, 0.0), (100.0, 0.0)]
    df = spark.createDataFrame([(1, k, 10.0 * k / 5, 1.0, 36.0, "car") for k in range(51)], "track_id long, frame int, world_x_m double, world_y_m double, speed_kmh double, mode string")
    from roadweave.params import FlowParams

    cells = A.edie_cells(df, line, 5.0, FlowParams(interval_s=10.0)).collect()
    assert all(abs(c["speed_kmh"] - 36) < 1e-6 and abs(c["flow_veh_per_h"] - c["density_veh_per_km"] * c["speed_kmh"]) < 1e-6 for c in cells)
    schema = "segment int, interval int, lane int, flow_veh_per_h double, density_veh_per_km double, speed_kmh double, segment_start_m double, interval_start_s double, n_vehicles int"
    two = spark.createDataFrame([(0, 0, 0, 1800.0, 30.0, 60.0, 0.0, 0.0, 3), (1, 0, 0, 600.0, 90.0, 6.7, 50.0, 0.0, 3)], schema)
    assert abs(R.shock_fronts(two).first()["u_mps"] + 5.5556) < 1e-3
    assert R.shockwave(R.shock_fronts(two)).count() == 0


def test_signals(spark):
    rows = [("a", c * 15 + k, "car", 60.0 * c + 2.0 * k) for c in range(7) for k in range(15)] + [("b", k, "car", 3.0 * k) for k in range(60)] + [("c", k, "car", 5.0 * k) for k in range(3)]
    c = spark.createDataFrame(rows, "stream string, vehicle long, mode string, t_s double")
    got = {r["stream"]: r for r in R.signal_performance(c).collect()}
    assert got["a"]["signalised"] and got["a"]["n_cycles"] == 7 and 20 <= got["a"]["median_red_s"] <= 40 and 1500 <= got["a"]["median_saturation_flow_veh_h"] <= 2100
    assert got["b"]["signalised"] is False and got["c"]["signalised"] is None
    p = {r["stream"]: r for r in R.periodicity(c.where("stream = 'a'")).collect()}
    assert abs(p["a"]["cycle_s"] - 60) <= 1 and p["a"]["periodic"]


def test_lanes_fold_needs_dwell(spark):
    off = [1.0] * 10 + [4.8] * 2 + [1.0] * 10 + [4.8] * 10
    df = spark.createDataFrame([(1, k, o) for k, o in enumerate(off)], "track_id long, frame int, lateral_offset_m double")
    got = A.held_lanes(df, 5.0).orderBy("frame").collect()
    assert [r["lane"] for r in got][:22] == [0] * 22 and got[-1]["lane"] == 1 and sum(r["lane_change"] for r in got) == 1


def test_tiles_own_each_point_once(spark):
    grid = D.tiles(spark, 3840, 2160).collect()
    for x in range(0, 3840, 97):
        for y in range(0, 2160, 89):
            assert sum(g["cx0"] <= x < g["cx1"] and g["cy0"] <= y < g["cy1"] and g["x0"] <= x < g["x1"] and g["y0"] <= y < g["y1"] for g in grid) == 1
    with pytest.raises(ValueError):
        D.tiles(spark, 3840, 2160, overlap=100, max_object=200)


def test_assignment_matches_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1), (0, 3)):
        c = r.random((n, m))
        pairs, rows, cols = assignment(c, 10.0)
        k = min(n, m)
        best = min((sum(c[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.combinations(range(m), k)), default=0)
        assert len(pairs) == k and abs(sum(c[i, j] for i, j in pairs) - best) < 1e-9 and len(rows) == n - k and len(cols) == m - k


def test_tracker_keeps_ids_through_hiding(spark):
    rows = []
    for f in range(150):
        for i, (x, y) in enumerate([(100 + 4 * f, 300.0), (900 - 4 * f, 500.0), (400.0, 800.0)]):
            if i == 0 and 60 <= f < 80:
                continue
            rows.append(("v", f, x - 20.0, y - 15.0, x + 20.0, y + 15.0, 0.9, "car", [1.0 if k == i else 0.0 for k in range(4)]))
    df = spark.createDataFrame(rows, "video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, mode string, feature array<double>")
    out = tracked(df)
    assert out.select("track_id").distinct().count() == 3
    assert Tracker().step(0, df.toPandas()[["x1", "y1", "x2", "y2"]].to_numpy()[:0], df.toPandas()["conf"].to_numpy()[:0], [], []) == []


def test_network_of_a_junction(spark):
    rows, i = [], 0
    for (ox, oy), (dx, dy), n in (((-60, 0), (60, 0), 14), ((60, 4), (-60, 4), 8), ((0, 60), (0, -60), 9)):
        for k in range(n):
            i += 1
            rows += [(i, 10 * k + f, ox + (dx - ox) * f / 60 + 0.3 * (k % 3), oy + (dy - oy) * f / 60 + 0.3 * (k % 2), "car") for f in range(61)]
    df = spark.createDataFrame([(a, b, float(c), float(d), e) for a, b, c, d, e in rows], "track_id long, frame int, world_x_m double, world_y_m double, mode string")
    g, e = N.gates(N.endpoints(df), min_tracks=5)
    mv = N.movements(e, g)
    assert g.count() == 4 and mv.count() == 31 and mv.where("turn = 'through'").count() == 31
    line = N.centrelines(df, mv).where("origin = 'W'").orderBy("node").collect()
    assert len(line) == 24 and abs(line[0]["x"] + 60) < 1 and abs(line[-1]["x"] - 60) < 1


def test_telemetry_and_geojson(spark):
    text = "".join(f"{k + 1}\n00:00:00,000 --> 00:00:00,033\n2024-01-01 10:00:0{k}.000\n[latitude: 18.5{k}] [longitude: 73.7] [rel_alt: 70.1 abs_alt: 600.2] [gb_yaw: {179 if k % 2 else -179} gb_pitch: -63.1]\n\n" for k in range(4)) + "9\nbroken\n\n"
    t = S.telemetry_of(spark.createDataFrame([(b,) for b in text.split("\n\n")], "value string"))
    assert t.count() == 5 and t.where("lat IS NULL").count() == 1
    geo = S.georeference(t)
    assert abs(geo.yaw_deg - 180) < 1 and abs(geo.yaw_spread_deg - 2) < 1e-6
    assert S.aligned(t, 7).where("frame = 6").first()["gb_pitch"] == -63.1
    df = spark.createDataFrame([(1, f, 0.4 * f, 0.0, "car") for f in range(10)], "track_id long, frame int, world_x_m double, world_y_m double, mode string")
    row = S.trajectories(df, geo).first()
    assert row["points"] == 4 and '"LineString"' in row["feature"]


def test_streams_agree_with_batch(spark, tmp_path):
    from roadweave.streaming.counts import interval_counts

    rows = spark.range(200).selectExpr("timestamp_seconds(id * 7) AS ts", "CAST(id % 2 AS STRING) AS gate")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    batch = interval_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["gate"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    q = interval_counts(stream, "ts", ["gate"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, spark.table("counts").collect()))


def test_tracking_stream_agrees_with_batch_and_forgets(spark, tmp_path):
    from roadweave.streaming.tracking import tracked_stream

    schema = "video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, mode string, event_time timestamp"
    box = lambda v, f, k, at: (v, f, 100.0 + 4 * f, 100.0 + 90 * k, 140.0 + 4 * f, 130.0 + 90 * k, 0.9, "car", at)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    first = [box("v", f, k, at(f / 10)) for f in range(30) for k in range(3) if not (k == 1 and 12 <= f < 20)]
    batches = [[r for r in first if r[1] < 14], [r for r in first if 9 <= r[1]], [box("w", f, 0, at(500 + f / 10)) for f in range(9)], [box("w", f, 0, at(500 + f / 10)) for f in range(9, 12)], [r for r in first if r[1] < 5]]
    run = lambda: tracked_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("event_time", "5 seconds"), keep_s=30.0).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    left = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = run()
        q.awaitTermination()
        state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "video").load()
        left.append(sorted(r[0] for r in state.selectExpr("key.video_id").collect()))
    # A video is forgotten once another's frames have moved the watermark past its timer; its frames that come again then are late.
    assert left[0] == left[1] == ["v"] and left[-1] == ["w"] and left[3] == ["w"]
    want = tracked(spark.createDataFrame(first + batches[2] + batches[3], schema)).collect()
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(repr, want)) and len({r["track_id"] for r in want if r["video_id"] == "v"}) == 3


def test_camera_motion_keeps_ids(spark):
    schema = "video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, mode string"
    pan = lambda f: 0.0 if f < 8 else 70.0 * (f - 7)  # the camera turns: all that stands moves by 70 pixels a frame
    places = [(300.0, 200.0), (420.0, 500.0), (900.0, 350.0)]
    df = spark.createDataFrame([("v", f, x - pan(f), y, x - pan(f) + 40, y + 30, 0.9, "car") for f in range(16) for x, y in places], schema)
    moves = spark.createDataFrame([("v", f, 1.0, 0.0, pan(f - 1) - pan(f), 0.0, 1.0, 0.0, 300 if f < 12 else 60, 110 if f < 12 else 9) for f in range(1, 16) if f != 15], "video_id string, frame int, a double, b double, tx double, c double, d double, ty double, points int, inliers int")
    moves = moves.withColumn("quality", motion_quality(F.col("inliers"), F.col("points")))
    ids = lambda out: {f: sorted(r["track_id"] for r in out if r["frame"] == f) for f in range(16)}
    with_, without = ids(tracked(df, moves).collect()), ids(tracked(df).collect())
    assert all(with_[f] == [1, 2, 3] for f in range(1, 15)) and with_[15] == [] and without[12] != [1, 2, 3]
    quality = {r["frame"]: r["camera_motion_quality"] for r in tracked(df, moves).collect()}
    assert abs(quality[5] - 110 / 120 * min(110 / 300 / 0.6, 1)) < 1e-12 and quality[13] == 0.0 and {r["camera_motion_quality"] for r in tracked(df).collect()} == {1.0}
    turned = Track.begin(np.array([10.0, 20.0, 30.0, 60.0]), None)
    turned.mean[4:6], cov = (3.0, 1.0), turned.cov.copy()
    turned.moved(np.array([[0.0, -2.0, 5.0], [2.0, 0.0, 7.0]]))
    assert np.allclose(turned.mean, [-2 * 40 + 5, 2 * 20 + 7, 0.5, 80, -2, 6, 0, 0]) and np.allclose(turned.cov[0, 0], 4 * cov[1, 1])


def test_gallery_forgets_what_left_the_image():
    box, none = np.array([[1500.0, 500, 1540, 530]]), (np.zeros((0, 4)), np.zeros(0), [], [])
    for size, kept in (((1600, 900), 0), (None, 1)):
        tracker = Tracker(keep_lost=3, size=size)
        for f in range(20):
            tracker.step(f, box + [[18.0 * f, 0, 18.0 * f, 0]], np.array([0.9]), ["car"], [None])
        for f in range(20, 60):
            tracker.step(f, *none)
        # It goes on unseen at 18 pixels a frame, by which it is more than a quarter of the width outside.
        assert len(tracker.gallery) == kept and not tracker.live


def test_new_tracks_need_sure_boxes_and_a_second_sight():
    tracker, box = Tracker(), np.array([[100.0, 100, 140, 130]])
    seen = [len(tracker.step(f, box, np.array([c]), ["car"], [None])) for f, c in enumerate((0.5, 0.5, 0.9, 0.5, 0.3, 0.1, 0.5))]
    assert seen == [0, 0, 0, 1, 1, 0, 1] and tracker.ids == 1


def test_tracked_query_tracks_every_box(spark, tmp_path):
    import __spark_entry__ as e
    from roadweave.plans.adapters import tracks

    kinds = ["click", "view", "purchase", "signup", "error"]
    events = [(20 * u + k, 1_700_000_000 + 60 * k, u, kinds[u % 5]) for u in range(15) for k in range(20)]
    spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    modes = {"car": "car", "van": "LGV", "truck": "truck", "motor": "motorcycle", "pedestrian": "pedestrian"}
    boxes = tracks(spark, str(tmp_path)).toPandas()
    assert len(boxes) == len(events)
    want = {}
    for v in range(3):
        tracker, of = Tracker(), boxes[boxes["track_id"] % 3 == v].sort_values(["x1", "y1"])
        for f in range(of["frame"].min(), of["frame"].max() + 1):
            d = of[of["frame"] == f]
            for i, _, _, mode in tracker.step(f, d[["x1", "y1", "x2", "y2"]].to_numpy(), d["conf"].to_numpy(), [modes[c] for c in d["cls_name"]], [None] * len(d)):
                want.setdefault((f"v{v}", mode), []).append(i)
    got = {(r["video_id"], r["mode"]): (r["boxes"], r["ids"]) for r in e.queries()["c16_tracked"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(i), len(set(i))) for k, i in want.items()}
    assert {m for _, m in got} == set(modes.values())


def test_tracking_breaks_ties_by_whole_boxes(spark):
    rows = [("v", f, 100.0, 100.0, 140.0 + 9 * k, 130.0 + 9 * k, 0.9, "car") for f in range(8) for k in range(4)]
    schema = "video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, mode string"
    up, down = (sorted(map(tuple, tracked(spark.createDataFrame(r, schema).coalesce(1)).collect())) for r in (rows, rows[::-1]))
    assert up == down and len(up) > 0


def test_entry_lists_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
