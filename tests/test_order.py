"""Results that must not depend on the order in which rows arrive."""

import random

from pyspark.sql import functions as F

from roadweave.operators import classify as K
from roadweave.operators import detections as D
from roadweave.operators import legacy as L

SCHEMA = "track_id long, frame int, x1 double, y1 double, x2 double, y2 double, conf double, cls_name string, interpolated boolean"


def added(values):
    total = 0.0
    for v in values:  # sum() of Python 3.12 and later corrects its roundings
        total += v
    return total


def close_vote():
    """Rows of cars and trucks with the same confidences, of which those that win by frame lose by falling frames."""
    r = random.Random(1)
    while True:
        by = {m: [0.2 + k / 100 for k in r.sample(range(80), 30)] for m in ("car",)}
        by["truck"] = r.sample(by["car"], 30)
        if added(by["car"]) < added(by["truck"]) and added(by["car"][::-1]) >= added(by["truck"][::-1]):
            return [(7, 2 * k + j, 100.0 + 3 * k, 500.0, 144.0 + 3 * k, 530.0, by[m][k], m, False) for k in range(30) for j, m in enumerate(("car", "truck"))]


def test_votes_are_added_by_frame(spark):
    rows = close_vote()
    for given in (rows, rows[::-1], sorted(rows, key=lambda r: (r[1] * 37) % 60)):
        df = spark.createDataFrame(given, SCHEMA).coalesce(1)
        assert K.votes(df).first()["appearance_mode"] == "truck"
        assert L.processed(df.drop("interpolated"), 10.0)[1].first()["mode"] in ("truck", "HGV")


def test_equal_boxes_go_by_track(spark):
    """Of boxes equal in place and confidence the least track stays, whichever row comes first."""
    box = (10.0, 10.0, 50.0, 40.0, 0.9)
    for ids in ((905, 5, 1805), (5, 905, 1805), (1805, None, 5)):
        df = spark.createDataFrame([(3, t, *box) for t in ids], "frame int, track_id long, x1 double, y1 double, x2 double, y2 double, conf double").coalesce(1)
        assert [r["track_id"] for r in D.suppressed(df, 0.5).collect()] == [5]
    nested = df.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    assert D.suppressed(nested, 0.5).count() == 1
