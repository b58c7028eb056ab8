"""Steps whose tasks must stay small however large the tables are."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from roadweave.operators import network as N
from roadweave.operators import reasoning as R
from roadweave.operators import tracker as T
from roadweave.plans import adapters as A


def test_movement_numbers_without_one_task(spark):
    """The numbers are those of the view's row_number, which puts all rows into one task."""
    d = "/root/testdata/sf0.001"
    rows = A.movements(spark, d, "track_id", "origin", "destination", "turn")
    assert "row_number" not in rows._jdf.queryExecution().toString()
    want = A.view(spark, d, A.MOVEMENTS).select(*rows.columns)
    assert rows.count() == want.count() and rows.exceptAll(want).count() == 0


def test_lagged_products_over_blocks(spark):
    r = np.random.default_rng(2)
    c = r.integers(0, 3, 700)
    sec = spark.createDataFrame([("a", int(s), int(v)) for s, v in enumerate(c) if v], "stream string, s int, c long")
    got = {x["lag"]: x["p"] for x in R.lagged_products(sec, 5, 40, block_s=64).collect()}
    assert got == {lag: int(c[:-lag] @ c[lag:]) for lag in range(5, 40)}
    plan = R.periodicity(spark.range(2000).select(F.lit("a").alias("stream"), F.col("id").alias("vehicle"), F.lit("car").alias("mode"), (F.col("id") * 0.7).alias("t_s")))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan


def test_videos_have_tasks_of_their_own(spark):
    """Small videos are not merged into one task, and pairing asks for a track's mode once, not once a box."""
    rows = spark.range(12).selectExpr("concat('v', id % 3) AS video_id", "cast(id / 3 AS int) AS frame", "10D AS x1", "10D AS y1", "50D AS x2", "40D AS y2", "0.9D AS conf", "'car' AS mode")
    assert T.tracked(rows).select(F.spark_partition_id()).distinct().count() > 1

    class Asked(T.Track):
        n = 0

        @property
        def mode(self):
            Asked.n += 1
            return "car"

    box = np.array([10.0, 10.0, 50.0, 40.0])
    cost = T.Tracker().fused([Asked.begin(box + k, None) for k in range(5)], np.array([box] * 7), [None] * 7, ["car"] * 6 + ["bus"])
    assert Asked.n == 5 and np.allclose(cost[:, 6] - cost[:, 5], 0.1)


def test_clusters_by_rounds_are_those_of_a_matrix():
    r = np.random.default_rng(3)
    for n, cut in ((40, 5.0), (150, 15.0), (250, 40.0)):
        p, w = r.random((n, 2)) * [300, 40], r.integers(1, 9, n).astype(float)
        tight = {k: [h for *_, h in N.merges(p, w, cut, matrix=m) if h <= cut] for k, m in (("rounds", 6), ("matrix", 1000))}
        assert np.allclose(sorted(tight["rounds"]), sorted(tight["matrix"]))
        whole = N.average_linkage(p, w, cut)
        few, N.merges = N.merges, lambda p, w, c: few(p, w, c, matrix=6)
        try:
            assert np.array_equal(N.average_linkage(p, w, cut), whole)
        finally:
            N.merges = few


def test_clustering_needs_no_matrix_of_all_points():
    p = np.random.default_rng(4).random((7000, 2)) * [2000, 40]
    tracemalloc.start()
    labels = N.average_linkage(p, np.ones(len(p)), 20.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 7000 and peak < 8 * 7000 * 7000


def test_tracking_needs_no_matrix_of_a_frame(monkeypatch):
    """Pairs are those of the whole matrix, and a frame of many boxes takes memory by its boxes."""
    r = np.random.default_rng(5)
    at = r.random((60, 2)) * [300, 200]
    boxes = lambda f: np.hstack([at + 2 * f, at + 2 * f + 30 + r.integers(0, 9, (60, 2))]).round()
    frames = [(boxes(f), r.random(60), [("car", "bus")[k] for k in r.integers(0, 2, 60)], [None if k % 7 == 0 else np.eye(4)[k % 4] for k in range(60)]) for f in range(12)]

    def found(whole, looks):
        monkeypatch.setattr(T, "WHOLE", whole)
        monkeypatch.setattr(T, "HELD", 200)
        tracker = T.Tracker(keep_lost=2)
        return [[(i, tuple(box), c, m) for i, box, c, m in tracker.step(f, b, conf, modes, feats if looks else [None] * 60)] for f, (b, conf, modes, feats) in enumerate(frames)]

    for looks in (False, True):
        assert found(0, looks) == found(1 << 20, looks) and found(0, looks)[-1]
    monkeypatch.undo()
    y, x = np.divmod(np.arange(4000), 80)
    many = np.stack([60.0 * x, 60.0 * y, 60.0 * x + 40, 60.0 * y + 30], 1)
    tracker, none = T.Tracker(), [None] * 4000
    tracemalloc.start()
    seen = [len(tracker.step(f, many + 3 * f, np.full(4000, 0.9), ["car"] * 4000, none)) for f in range(3)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [0, 4000, 4000] and peak < 8 * 4000 * 4000


def test_tracking_holds_a_frame_at_a_time(spark):
    """Rows come in parts that may split a frame, and a frame's tracks leave before the rest is read."""
    places = [(300.0, 200.0), (420.0, 500.0), (900.0, 350.0)]
    rows = [(v, f, x + 3 * f, y, x + 3 * f + 40, y + 30, 0.9, "car") for v in (None, "u", "v") for f in (*range(5), *range(8, 12)) for x, y in places]
    df = spark.createDataFrame(rows, "video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, mode string")
    g = df.toPandas().sort_values(list(T.ORDER))
    of = lambda out: {(None if isinstance(r[0], float) else r[0], *r[1:]) for r in out}
    want = set()
    for v in (None, "u", "v"):
        one = g[g["video_id"].isna() if v is None else g["video_id"] == v]
        want |= of(T.tracked_frames(T.Tracker(), one).itertuples(index=False, name=None))
    assert len(want) == 3 * 8 * 3
    read = []
    parts = (read.append(k) or g.iloc[k : k + 2] for k in range(0, len(g), 2))
    out = T.tracked_videos(parts)
    first = next(out)
    assert len(first) == 3 and len(read) < 6
    assert of(r for d in (first, *out) for r in d.itertuples(index=False, name=None)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert of(tuple(r) for r in T.tracked(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
