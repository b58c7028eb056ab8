"""A track's mode from weighted votes and its measured length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.expressions import GroundPlane, RowScale, mode_of_label

#: Lengths in metres over which a mode becomes the next, and the least length of a bus.
LADDER = {"car": [(6.2, "LGV"), (7.5, "truck"), (9.5, "HGV")], "LGV": [(7.5, "truck"), (9.5, "HGV")], "truck": [(9.5, "HGV")]}
BUS_MIN_M = 7.0


def mode_sums(df: DataFrame) -> DataFrame:
    """track_id, m, w, f: per track and mode the sum of confidences over its observed rows and the first frame.

    Sums of doubles depend on their order and decide ties, so rows are added by frame, however they are dealt out.
    """
    v = df.where("NOT interpolated").withColumn("m", mode_of_label(F.col("cls_name"))).where("m IS NOT NULL")
    whole = Window.partitionBy("track_id", "m").orderBy("frame", "conf").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return v.withColumn("w", F.sum("conf").over(whole)).groupBy("track_id", "m").agg(F.first("w").alias("w"), F.min("frame").alias("f"))


def votes(df: DataFrame) -> DataFrame:
    """Per track the mode with the largest sum of confidences, its share, its margin and the entropy; the first seen wins a tie."""
    v = mode_sums(df)
    share = Window.partitionBy("track_id")
    v = v.withColumn("p", F.try_divide("w", F.sum("w").over(share))).withColumn("r", F.row_number().over(share.orderBy(F.desc("w"), "f")))
    g = v.groupBy("track_id").agg(F.max(F.when(F.col("r") == 1, F.col("m"))).alias("appearance_mode"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p1"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("p2"), F.sum(-F.col("p") * F.ln(F.greatest("p", F.lit(1e-12)))).alias("vote_entropy"))
    return g.withColumn("vote_margin", F.col("p1") - F.coalesce("p2", F.lit(0.0))).drop("p2")


def lengths(df: DataFrame, cal: GroundPlane | RowScale, width: int, height: int) -> DataFrame:
    """Per track the weighted median of lengths, their number and uncertainty; boxes at the border, small or unsure ones count nothing."""
    size = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    clear = (F.col("x1") > 3) & (F.col("y1") > 3) & (F.col("x2") < width - 4) & (F.col("y2") < height - 4)
    s = df.where(~F.col("interpolated") & clear & (F.col("conf") >= 0.35) & (size >= 14)).withColumn("l", cal.length_m(size, (F.col("y1") + F.col("y2")) / 2)).where("l > 0")
    part = Window.partitionBy("track_id")
    s = s.withColumns({"n": F.count(F.lit(1)).over(part), "med": F.percentile("l", F.lit(0.5)).over(part)}).where("n < 3 OR (l > 0.35 * med AND l < 2.5 * med)")
    # The whole sum is added in the running sum's order, so that half of it is the same half.
    by = part.orderBy("l", "frame")
    s = s.withColumns({"c": F.sum("conf").over(by.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("conf").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    s = s.withColumn("wm", F.min(F.when(F.col("c") >= 0.5 * F.col("all"), F.col("l"))).over(part))
    g = s.groupBy("track_id").agg(F.count(F.lit(1)).alias("length_measurement_count"), F.first("wm").alias("estimated_length_m"), F.median(F.abs(F.col("l") - F.col("wm"))).alias("mad"))
    unc = F.greatest(1.253 * 1.4826 * F.col("mad") / F.sqrt("length_measurement_count"), F.lit(0.35))
    return g.where("length_measurement_count >= 5").withColumn("length_uncertainty_m", unc).drop("mad")


def _climbed(mode: str, length: Column, unc: Column) -> tuple[Column, Column]:
    """The mode that a length promotes to, and whether it straddles a border on the way."""
    final, open_, ambiguous = F.lit(mode), F.lit(True), F.lit(False)
    for border, to in LADDER[mode]:
        over = open_ & (length > border + unc)
        ambiguous = ambiguous | (open_ & ~(length > border + unc) & (length > border - unc))
        final = F.when(over, to).otherwise(final)
        open_ = over
    return final, ambiguous


def classified(df: DataFrame, cal: GroundPlane | RowScale, width: int, height: int) -> DataFrame:
    """track_id, appearance_mode, final_mode, mode_confidence, classification_source and the length evidence. A track without votes is a car of confidence 0."""
    t = df.select("track_id").distinct().join(votes(df), "track_id", "left").join(lengths(df, cal, width, height), "track_id", "left")
    length, unc, p1 = F.col("estimated_length_m"), F.col("length_uncertainty_m"), F.col("p1")
    measured = length.isNotNull() & F.col("appearance_mode").isin("car", "LGV", "truck", "bus")
    final, conf, source = F.col("appearance_mode"), p1, F.lit("appearance")
    for mode in LADDER:
        to, ambiguous = _climbed(mode, length, unc)
        own = measured & (F.col("appearance_mode") == mode)
        changed = own & ~ambiguous & (to != mode)
        final = F.when(changed, to).otherwise(final)
        source = F.when(changed, "length_override").when(own, "appearance_and_length").otherwise(source)
        conf = F.when(own & ambiguous, p1 * 0.7).when(changed, F.least(F.lit(1.0), p1 * 0.9 + 0.1)).when(own, F.least(F.lit(1.0), p1 * 1.05)).otherwise(conf)
    bus = measured & (F.col("appearance_mode") == "bus")
    short, near = bus & (length < BUS_MIN_M - unc), bus & (length < BUS_MIN_M + unc)
    final = F.when(short, "LGV").otherwise(final)
    source = F.when(short, "length_override").when(near, "appearance_and_length").otherwise(source)
    conf = F.when(short, p1 * 0.75).when(near, p1 * 0.8).otherwise(conf)
    none = F.col("appearance_mode").isNull()
    return t.select("track_id", F.coalesce("appearance_mode", F.lit("car")).alias("appearance_mode"), F.when(none, "car").otherwise(final).alias("final_mode"), F.when(none, 0.0).otherwise(conf).alias("mode_confidence"), F.when(none, "appearance_fallback_no_calibration").otherwise(source).alias("classification_source"), *(F.when(measured, F.col(c)).alias(c) for c in ("estimated_length_m", "length_measurement_count", "length_uncertainty_m")), F.coalesce("vote_margin", F.lit(0.0)).alias("vote_margin"), "vote_entropy")
