"""Ordered passes by buckets against plain windows, and ranks against sorting."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.operators import reasoning as R
from roadweave.operators.scan import ranked, scanned


def test_scan_equals_windows_by_stream(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 90)]), k, r.choice([None, None, k]), r.choice([None, 1, 2])) for k in range(600)]
    df = spark.createDataFrame(rows, "s string, t int, id int, v int, n int")
    order = ["t", "id"]
    w = Window.partitionBy("s").orderBy(*order)
    first = Window.unboundedPreceding
    want = df.withColumns({
        "last": F.last("v", ignorenulls=True).over(w.rowsBetween(first, -1)),
        "here": F.last("v", ignorenulls=True).over(w.rowsBetween(first, 0)),
        "next": F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "sum": F.coalesce(F.sum("n").over(w.rowsBetween(first, 0)), F.lit(0)),
    })
    for width in (1.0, 7.0, 1000.0):
        got = scanned(df, ["s"], "t", width, ["id"], before={"last": F.col("v")}, upto={"here": F.col("v")}, after={"next": F.col("v")}, totals={"sum": F.col("n")})
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert scanned(df.where("false"), ["s"], "t", 5.0, totals={"sum": F.lit(1)}).count() == 0
    alone = scanned(df.where("s = 'a' AND t IS NOT NULL"), [], "t", 7.0, ["id"], totals={"k": F.lit(1)})
    assert sorted(r["k"] for r in alone.collect()) == list(range(1, alone.count() + 1))


def test_one_long_stream_is_dealt_over_all_tasks(spark):
    n = 60_000
    base = spark.range(n).select(F.lit("only").alias("stream"), F.col("id").alias("vehicle"), (F.col("id") * 0.7 + F.pmod(F.xxhash64("id"), F.lit(97)) / 90.0).alias("t_s"))
    minor, major = base.where("vehicle % 3 = 0"), base.where("vehicle % 3 > 0")
    got = R.accepted_gaps(minor, major)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join tasks of so few rows
    try:
        rows = R.platoons(base).select(F.spark_partition_id().alias("p"), "vehicle").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in rows) < 0.6 * n
    t = sorted(r["t_s"] for r in major.collect())
    import bisect

    for r in got.orderBy("t_s").limit(300).collect():
        k = bisect.bisect_left(t, r["t_s"])
        assert abs(r["gap_s"] - (t[k] - t[k - 1])) < 1e-9
    assert got.count() == minor.where(f"t_s > {t[0]!r}D AND t_s <= {t[-1]!r}D").count()


def test_platoons_of_a_stream_without_pauses(spark):
    times = [k * 2.0 for k in range(900)] + [2000.0 + 3 * k for k in range(5)] + [2100.0]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(times)], "stream string, vehicle int, t_s double")
    got = R.platoons(df, 12.0, bucket_s=50.0).orderBy("t_s").collect()
    assert [r["platoon"] for r in got] == [0] * 900 + [1] * 5 + [2] and [r["place"] for r in got] == [*range(1, 901), *range(1, 6), 1]
    cycles = R.discharge_cycles(df, 12.0, 50.0).orderBy("platoon").collect()
    assert [r["vehicles"] for r in cycles] == [900, 5, 1] and cycles[0]["saturation_flow_veh_h"] == 1800 and cycles[1]["saturation_flow_veh_h"] == 1200


def test_ranks_spread_equal_first_columns(spark):
    df = spark.range(5000).select(F.lit(0).alias("f0"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("track_id"))
    out = ranked(df, ["f0", "track_id"], "rank", parts=16)
    got = out.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001)) and [r["track_id"] for r in got] == sorted(r["track_id"] for r in got)
    ranges = df.repartitionByRange(16, "f0", "track_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 1000
    assert ranked(df.where("false"), ["f0"], "rank").count() == 0
