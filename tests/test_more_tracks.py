"""Networks, bundles, lanes and served chunks with known answers."""

import json
import math
import random

import numpy as np
import pytest


def junction_rows():
    """A T-junction with known turns: west, east and north arms of 100 m, all at 10 m/s and 10 frames a second."""
    arms = {"W": (-100.0, 0.0), "E": (100.0, 0.0), "N": (0.0, 100.0)}
    plan = [("E", "W", 14), ("W", "E", 8), ("E", "N", 6), ("N", "E", 5), ("N", "W", 4), ("W", "N", 3)]
    r, rows, track = random.Random(2), [], 0
    for a, b, n in plan:
        for k in range(n):
            (x0, y0), (x1, y1) = arms[a], arms[b]
            half, start = 100, 60 * k + r.randrange(20)
            for i in range(2 * half + 1):
                s = i / half
                x, y = (x0 * (1 - s), y0 * (1 - s)) if s <= 1 else (x1 * (s - 1), y1 * (s - 1))
                rows.append((track, start + i, x + r.gauss(0, 0.1), y + r.gauss(0, 0.1), 36.0, "car", False))
            track += 1
    return rows


@pytest.fixture(scope="module")
def junction(spark):
    df = spark.createDataFrame(junction_rows(), "track_id long, frame int, world_x_m double, world_y_m double, speed_kmh double, mode string, parked boolean")
    return df.cache()


def test_network_is_built_with_turns_lanes_and_centrelines(spark, junction):
    from roadweave.operators import network as N

    net = N.build(junction, cluster_m=25.0, min_tracks=5)
    assert net.gates.count() == 3
    turns = {r["turn"]: r["count"] for r in net.movements.groupBy("turn").count().collect()}
    assert sum(turns.values()) == 40 and turns["through"] == 22 and "u-turn" not in turns
    lines = net.corridors()
    assert len(lines) == 4 and all(len(v) == 24 for v in lines.values())
    found = {r["value"]: r["n"] for r in N.described(net).collect()}
    assert found[None] == 3 and found["through"] == 22
    # Two recordings are told apart: each has its own three gates, and no track changes.
    both = junction.withColumn("clip", (junction["track_id"] % 2).cast("string"))
    ends = N.endpoints(both).join(both.select("track_id", "clip").distinct(), "track_id")
    g, e = N.gates(ends, min_tracks=3, scene="clip")
    assert sorted((r["clip"], r["count"]) for r in g.groupBy("clip").count().collect()) == [("0", 3), ("1", 3)]
    assert N.movements(e, g, scene="clip").count() == 40


def test_sections_become_rows(spark):
    from roadweave.operators import aggregates as A
    from roadweave.operators import bundles as B

    mv = spark.createDataFrame([(k, "W", "E", "through", "car", 0, 9, 5.0) for k in range(3)] + [(9, "E", "E", "internal", "car", 0, 9, 5.0)], "track_id long, origin string, destination string, turn string, mode string, f0 int, f1 int, travel_m double")
    rows = B.as_rows({"od": A.od_summary(mv), "modes": A.modal_split(mv)}).collect()
    assert [json.loads(r["row"])["count"] for r in rows if r["section"] == "od"] == [3] and {r["section"] for r in rows} == {"od", "modes"}


def test_bundles_hold_every_section(spark, junction):
    from roadweave.operators import bundles as B
    from roadweave.operators import network as N

    net = N.build(junction, min_tracks=5)
    table = B.A.corridor_table(net.centrelines)
    assert [(r["n"], r["rank"]) for r in B.ranked_pairs(net, table).orderBy("rank").collect()] == [(14, 1), (8, 2), (6, 3), (5, 4)]
    found = B.insights(junction, net, 10.0)
    rows = B.as_rows({k: v for k, v in found.items() if k != "approaches"}).collect()
    by = {k: [json.loads(r["row"]) for r in rows if r["section"] == k] for k in found}
    assert sorted(x["count"] for x in by["od"]) == [3, 4, 5, 6, 8, 14] and by["totals"] == [{"tracks_moving": 40, "duration_s": by["totals"][0]["duration_s"], "movements_assigned": 40}]
    assert len({x["corridor"] for x in by["speed_profiles"]}) == 4 and all(abs(x["mean_speed_kmh"] - 36.0) < 1e-6 for x in by["speed_profiles"])
    assert len({x["approach"] for x in by["queues"]}) == 3 and all(x["queue_vehicles"] == 0 for x in by["queues"])
    moved = B.flow(junction, net, 10.0)
    assert {r["corridor"] for r in moved["time_space"].collect()} == {x["corridor"] for x in by["speed_profiles"]}
    assert all(abs(r["speed_kmh"] - 36) < 3 for r in moved["cells"].where("n_vehicles > 1").collect()) and sum(r["lane_changes"] for r in moved["lane_changes"].collect()) <= 2
    why = B.reasoning(junction, net, 10.0)
    assert why["congestion"].count() == 0 and why["obstructions"].count() == 0
    assert {r["signalised"] for r in why["signals"].collect()} <= {None, False, True} and why["signals"].count() == 3
    # The busiest corridor is E to W with 14 vehicles; those from W must find gaps in it, and none of them ever waits.
    gap = why["gap_acceptance"].first()
    assert gap["stream"].count("->") == 2 and gap["n_accepted"] > 0 and gap["n_rejected"] == 0
    assert {r["lane_structure"] for r in why["lane_structure"].collect()} == {"single undifferentiated stream"}


def test_two_recordings_in_one_call_are_as_two_calls(spark, junction):
    from pyspark.sql import functions as F

    from roadweave.operators import bundles as B
    from roadweave.operators import network as N

    clip = (F.col("track_id") % 2).cast("string")
    # The same track ids stand in both recordings, in one of them elsewhere.
    parts = {k: junction.where(clip == k).select((F.col("track_id") / 2).cast("long").alias("track_id"), "frame", (F.col("world_x_m") + 3 * int(k)).alias("world_x_m"), "world_y_m", "speed_kmh", "mode", "parked") for k in "01"}
    both = parts["0"].withColumn("clip", F.lit("0")).unionByName(parts["1"].withColumn("clip", F.lit("1"))).cache()
    net = N.build(both, min_tracks=3, least_paths=3, scene="clip")
    rows = lambda df, *drop: sorted(repr(tuple(r)) for r in df.drop(*drop).select(*(F.round(c, 6) if t == "double" else F.col(c) for c, t in df.drop(*drop).dtypes)).collect())
    whole = B.insights(both, net, 10.0, keys=("clip",)) | B.flow(both, net, 10.0, keys=("clip",)) | {"movements": net.movements, "lines": net.centrelines}
    for k in "01":
        own = N.build(parts[k], min_tracks=3, least_paths=3)
        alone = B.insights(parts[k], own, 10.0) | B.flow(parts[k], own, 10.0) | {"movements": own.movements, "lines": own.centrelines}
        for name in ("od", "movement_counts", "approach_volumes", "modal_split", "speed_profiles", "fundamental", "queues", "cells", "lane_changes", "totals", "network", "movements", "lines"):
            mine = whole[name].where(F.col("clip") == k)
            assert rows(mine, "clip", "corridor") == rows(alone[name], "corridor"), name


def test_plans_do_not_grow_with_corridors(spark, junction):
    import time

    from roadweave.operators import bundles as B
    from roadweave.operators.network import Network

    def sized(n):
        lines = [("g", f"h{k}", j, float(j * 9), float(k)) for k in range(n) for j in range(24)]
        mv = junction.sparkSession.createDataFrame([(t, "g", f"h{t % n}", "through", "car", 0, 9, 50.0, None) for t in range(40)], "track_id long, origin string, destination string, turn string, mode string, f0 int, f1 int, travel_m double, lane_in int")
        net = Network(junction.select("mode").distinct(), mv, junction.sparkSession.createDataFrame(lines, "origin string, destination string, node int, x double, y double"))
        begun = time.time()
        found = B.insights(junction, net, 10.0)
        plans = [found[k]._jdf.queryExecution().executedPlan().toString() for k in ("speed_profiles", "fundamental", "queues")]
        return sum(p.count("\n") for p in plans), time.time() - begun

    few, many = sized(2), sized(30)
    assert few[0] == many[0] and many[1] < 5


def test_acceleration_over_holes_is_as_numpy_has_it(spark):
    from roadweave.functions.expressions import GroundPlane
    from roadweave.operators import tracks as T
    from roadweave.params import MotionParams

    cam, fps, p = GroundPlane(70.0, -60.0, 900.0, 1920, 1080), 29.97, MotionParams()
    r = random.Random(8)
    x = [500 + 6 * k + 40 * math.sin(k / 9) + r.random() for k in range(120)]
    gone = {*range(30, 38), *range(70, 71), *range(100, 120)}
    rows = [(1, k, 0, 700.0 if k not in gone else None, x[k], False) for k in range(120)]
    df = spark.createDataFrame([(t, f, s, cx, cy, i) for t, f, s, cy, cx, i in rows], "track_id long, frame int, segment int, cx double, cy double, interpolated boolean")
    got = T.kinematics(df, cam, fps, MotionParams(max_acceleration=1e9, max_speed=1e9)).orderBy("frame").collect()
    v = np.array([np.nan if g["velocity_x_mps"] is None else g["velocity_x_mps"] for g in got])
    ok, pos, h = np.isfinite(v), np.arange(120), p.half_acceleration(fps)
    full = np.interp(pos, pos[ok], v[ok])
    k = np.arange(-h, h + 1)
    want = np.array([np.dot(k, full[i - h : i + h + 1]) / (k @ k) * fps if h <= i < 120 - h and ok[i] else np.nan for i in range(120)])
    have = np.array([np.nan if g["acceleration_x_mps2"] is None else g["acceleration_x_mps2"] for g in got])
    assert np.isfinite(want).sum() > 20 and (np.isnan(want) == np.isnan(have)).all() and np.allclose(want, have, equal_nan=True, atol=1e-9)


def test_average_linkage_against_brute_force():
    from roadweave.operators.network import average_linkage

    r = np.random.default_rng(3)
    for _ in range(12):
        n = int(r.integers(1, 40))
        p = r.uniform(-60, 60, (4, 2))[r.integers(0, 4, n)] + r.normal(size=(n, 2)) * 9
        w = r.integers(1, 4, n)
        groups = [[k] for k in range(n)]
        far = lambda a, b: sum(w[i] * w[j] * math.dist(p[i], p[j]) for i in a for j in b) / (sum(w[i] for i in a) * sum(w[j] for j in b))
        while len(groups) > 1:
            d, a, b = min((far(groups[a], groups[b]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
            if d > 25:
                break
            groups[a] += groups.pop(b)
        want = {k: min(g) for g in groups for k in g}
        got = average_linkage(p, w, 25.0)
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(n) for b in range(n))


def test_lanes_are_held_as_a_plain_loop_says(spark):
    from roadweave.operators.aggregates import held_lanes

    r, rows = random.Random(4), []
    for t in range(6):
        o = 0.0
        for f in range(0, 300, 1 + t % 2):
            o += r.gauss(0, 0.6)
            rows.append((t, f, None if r.random() < 0.03 else o))
    got = {(x["track_id"], x["frame"]): (x["lane"], x["lane_change"]) for x in held_lanes(spark.createDataFrame(rows, "track_id long, frame int, lateral_offset_m double"), 4.0).collect()}
    track = None
    for t, f, o in rows:
        if t != track:
            track, cur, cand, pending = t, None, None, 0
        change = False
        if o is not None:
            own = math.floor(o / 3.2)
            cur, cand = (own, own) if cur is None else (cur, cand)
            if cur * 3.2 - 0.7 <= o <= (cur + 1) * 3.2 + 0.7:
                cand, pending = cur, 0
            else:
                cand, pending = own, pending + 1 if own == cand else 1
                if pending >= 4:
                    cur, pending, change = own, 0, True
        assert got[t, f] == (cur, change)


@pytest.mark.parametrize(("spread", "want"), [((-3.2, 0.0, 3.2), "clear"), ((0.0,), "single undifferentiated stream")])
def test_lane_verdict_of_known_bands(spark, spread, want):
    from roadweave.operators import reasoning as R

    r = random.Random(6)
    rows = [(k, float(f), r.choice(spread) + r.gauss(0, 0.35)) for k in range(30) for f in range(0, 200, 10)]
    df = spark.createDataFrame(rows, "track_id long, world_x_m double, world_y_m double")
    got = R.lane_verdict(R.lane_density(df, [(0.0, 0.0), (200.0, 0.0)])).first()
    assert got["lane_structure"] == want and got["n_lanes"] == len(spread)
    if len(spread) == 3:
        assert abs(got["spacing_m"] - 3.2) < 0.3


def test_overlay_chunks_round_and_code(spark):
    from roadweave.operators import serving as V

    rows = [(0, 5, "car", "moving", 1.5, 2.5, 3.4, 4.6, 12.34, -0.25, False), (0, 3, "bus", "parked", 1.0, 1.0, 2.0, 2.0, None, None, False), (299, 5, "x", "unknown", 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, False), (300, 5, "car", "moving", 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, False), (1, None, "car", "moving", 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, False), (2, 7, "car", "parked", 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "frame int, display_id long, mode string, motion_state string, x1 double, y1 double, x2 double, y2 double, speed_kmh double, longitudinal_acceleration_mps2 double, parked boolean")
    got = {r["chunk"]: r["frames"] for r in V.overlay_chunks(df, 30.0).collect()}
    assert sorted(got) == [0, 1] and sorted(got[0]) == [0, 299]
    first, second = got[0][0]
    assert tuple(second) == (5, 2, 2, 2, 3, 5, 12.3, 0, -0.2) and tuple(first)[:2] == (3, 6) and first["speed_kmh"] is None and first["state"] == 2
    assert tuple(got[0][299][0])[1] == 2 and V.overlay_chunks(df.limit(0), 30.0).count() == 0
    one = V.feature_collection(V.point_features(spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0)], "id int, x double, y double"), None, ["id"])).first()
    assert [f["geometry"]["coordinates"] for f in json.loads(one["collection"])["features"]] == [[2.0, 3.0]]


def test_boxes_in_frame_coordinates_have_one_owner(spark):
    from roadweave.operators import detections as D

    grid = D.tiles(spark, 1920, 1080)
    r = random.Random(1)
    boxes = [(k, x := r.uniform(0, 1900), y := r.uniform(0, 1060), x + 15, y + 15) for k in range(200)]
    tiles = [t["tile_id"] for t in grid.collect()]
    every = spark.createDataFrame([(t, *b) for b in boxes for t in tiles], "tile_id int, box int, x1 double, y1 double, x2 double, y2 double")
    got = D.owned(every, grid, 1920, 1080).collect()
    assert sorted(g["box"] for g in got) == list(range(200)) and max(g["x2"] for g in got) <= 1920
    assert [D.tile_scale(w) for w in (1280, 1920, 2400, 2401, 3840)] == [1, 1, 1, 1, 2]


def test_without_a_scale_all_is_unknown(spark):
    from roadweave.operators import calibration as C
    from roadweave.operators import tracks as T

    samples = spark.createDataFrame([(float(y), 40.0) for y in range(50)], "y double, px double")
    cal = C.choose(samples, 1920, 1080, 70.0, -60.0, prefer="none")
    assert C.described(cal)["method"] == "none" and json.loads(C.calibration_json(cal))["confidence"] == 0.0
    raw = spark.createDataFrame([(f, 1, f * 5.0, 10.0, f * 5.0 + 20, 30.0, 0.9, "car") for f in range(40)], "frame int, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls_name string")
    got = T.analysed(raw, cal, 30.0).collect()
    assert len(got) == 40 and all(g["world_x_m"] is None and g["speed_mps"] is None and not g["kinematics_valid"] for g in got)
    with pytest.raises(ValueError):
        C.choose(samples, 1920, 1080, None, None, prefer="best")


def test_gap_of_a_known_critical_value(spark):
    """Accepted gaps of 3 to 10 s and rejected ones of 0 to 5 s meet at 4.17 s."""
    from roadweave.operators import reasoning as R

    r = random.Random(0)
    rows = [("a", True, r.uniform(3, 10)) for _ in range(3000)] + [("a", False, r.uniform(0, 5)) for _ in range(3000)]
    got = R.raff_critical_gap(spark.createDataFrame(rows, "stream string, accepted boolean, gap_s double")).first()
    assert abs(got["critical_gap_s"] - 4.17) < 0.35


def test_congestion_origin_and_receding_tail(spark):
    """A jam that begins at 150 m and 100 s, whose tail recedes by 1 m/s."""
    from roadweave.operators import reasoning as R

    rows = []
    for i in range(20):
        for s in range(8):
            t, at = i * 20.0, s * 50.0
            jam = t >= 100 and 150 - (t - 100) <= at <= 150
            rows.append((s, i, 0, at, t, 6.0 if jam else 40.0, 80.0 if jam else 12.0, 500.0, 5))
    df = spark.createDataFrame(rows, "segment int, interval int, lane int, segment_start_m double, interval_start_s double, speed_kmh double, density_veh_per_km double, flow_veh_per_h double, n_vehicles long")
    got = R.congestion_regions(df).first()
    assert (got["origin_distance_m"], got["start_s"]) == (150.0, 100.0) and -2.5 < got["stopping_wave_mps"] < -0.4 and not got["predates"]
