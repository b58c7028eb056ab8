"""Motion states: what joins the rows to their tracks' verdicts, and how often the tracks are computed for it."""

import math
import random

from pyspark.sql import functions as F

from roadweave.operators import tracks as T
from roadweave.params import MotionParams

ROWS = "track_id long, frame int, kinematics_valid boolean, speed_mps double"
TRACKS = "track_id long, f0 int, parked boolean"


def states(spark, rows, tracks):
    out = T.motion_states(spark.createDataFrame(rows, ROWS), spark.createDataFrame(tracks, TRACKS))
    assert out.columns == ["track_id", "frame", "kinematics_valid", "speed_mps", "parked", "display_id", "motion_state"]
    return sorted((tuple(r) for r in out.select("track_id", "frame", "parked", "motion_state", "display_id").collect()), key=repr)


def test_verdicts_are_computed_once(spark):
    """Ranks and the join use the same rows of tracks; a summary is all of kinematics, which was computed for each of them."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def verdict(k):
        asked.add(1)
        return k % 3 == 0

    rows = spark.range(40).selectExpr("id AS track_id", "0 AS frame", "true AS kinematics_valid", "1D AS speed_mps")
    summary = spark.range(40).selectExpr("id AS track_id", "cast(100 - id AS int) AS f0").withColumn("parked", verdict("track_id"))
    got = {r["track_id"]: r["display_id"] for r in T.motion_states(rows, summary).collect()}
    assert asked.value == 40
    live = [k for k in reversed(range(40)) if k % 3]
    assert got == {k: live.index(k) + 1 if k % 3 else None for k in range(40)}


def test_states_of_unknown_and_null_tracks(spark):
    """A row without a known track keeps its motion; verdicts that are null rank nothing, and null ids meet nothing."""
    rows = [(1, 0, True, 5.0), (2, 0, True, 5.0), (3, 0, True, 0.1), (4, 0, True, None), (9, 0, False, 5.0), (None, 0, True, 5.0)]
    tracks = [(1, 5, False), (2, 0, True), (3, 2, False), (4, 1, None), (None, 0, False)]
    want = [(1, 0, False, "moving", 3), (2, 0, True, "parked", None), (3, 0, False, "temporarily_stopped", 2), (4, 0, None, "unknown", None), (9, 0, None, "unknown", None), (None, 0, None, "moving", None)]
    assert states(spark, rows, tracks) == sorted(want, key=repr)
    assert states(spark, rows[:1], []) == [(1, 0, None, "moving", None)] and states(spark, [], tracks) == []


def test_states_of_repeated_tracks(spark):
    """Each row meets each verdict of its track, and each of these each of its ranks, as in joins one after the other."""
    rows, tracks = [(1, 0, True, 5.0), (1, 0, True, 5.0), (2, 0, True, 5.0)], [(1, 0, False), (1, 3, False), (2, 1, False), (2, 1, True)]
    want = [(1, 0, False, "moving", k) for k in (1, 3)] * 4 + [(2, 0, False, "moving", 2), (2, 0, True, "parked", 2)]
    assert states(spark, rows, tracks) == sorted(want, key=repr)


def test_ranges_of_ranks_go_by_the_number_of_tracks(spark, monkeypatch):
    """Few tracks are ranked by one task, more by more, with the same display ids."""
    dealt, ranked = [], T.ranked

    def seen(*args, **named):
        out = ranked(*args, **named)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(T, "ranked", seen)
    rows = spark.range(90).selectExpr("id AS track_id", "0 AS frame", "true AS kinematics_valid", "1D AS speed_mps")
    summary = spark.range(90).selectExpr("id AS track_id", "cast(id % 7 AS int) AS f0", "id % 3 = 0 AS parked")
    live = sorted((k % 7, k) for k in range(90) if k % 3)
    want = {k: live.index((k % 7, k)) + 1 if k % 3 else None for k in range(90)}
    for n in (100, 10):
        monkeypatch.setattr(T, "TRACKS_A_RANGE", n, raising=False)
        assert {r["track_id"]: r["display_id"] for r in T.motion_states(rows, summary).collect()} == want
    assert dealt == [1, 7]


def test_window_steps_keep_the_order_of_the_rows(spark):
    """Against a loop over each segment's taken rows: null and unplaced rows, null tracks, segments shorter than a window and single rows. One sort serves all of it."""
    r = random.Random(7)
    p = MotionParams(path_interval_s=0.4, parked_window_s=1.6)  # at 5 frames a second every second row, four of them a window
    rows, want = [], {}
    for track in (1, 2, 3, 4, 5, None):
        for segment, n in enumerate((1, 2, 7, r.randrange(8, 12), 30)):
            places = [(None if r.random() < 0.2 else r.uniform(-9, 9), None if r.random() < 0.2 else r.uniform(-9, 9)) for _ in range(n)]
            taken = [k for k in range(0, n, 2) if None not in places[k]]
            for k, (x, y) in enumerate(places):
                rows.append((track, segment, 50 * segment + k, x, y))
                i = taken.index(k) if k in taken else -1
                back = 0 if 1 < len(taken) <= 4 and i == len(taken) - 1 else i - 4
                want[track, 50 * segment + k] = math.hypot(x - places[taken[back]][0], y - places[taken[back]][1]) if i >= 0 and back >= 0 else None
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "track_id long, segment int, frame int, world_x_m double, world_y_m double")
    out = T.with_window_steps(df, 5.0, p)
    assert out.columns == [*df.columns, "_away_m"]
    got = {(x["track_id"], x["frame"]): x["_away_m"] for x in out.collect()}
    assert got.keys() == want.keys() and all(got[k] is want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    assert sum(v is not None for v in want.values()) > 40
    assert T.with_window_steps(df.where("false"), 5.0, p).count() == 0
    assert T.with_window_steps(df, 5.0, p)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
