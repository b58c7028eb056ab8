"""Ordered passes over long streams, dealt out by buckets of the order: what a row needs of rows far away is carried from bucket to bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.storage import cut


def scanned(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    width: float,
    ties: Sequence[str | Column] = (),
    before: dict[str, Column] | None = None,
    upto: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """df with, of each row's stream (keys) in order of `order` and then `ties`: the last known value of an expression among the rows before it (before) or up
    to it (upto), the next known one after it (after), and the sum up to it (totals), by name.

    Equal to windows by stream, in two levels: windows within buckets of `width` of the order, which spread one stream over many tasks, and windows over one
    row a bucket that carry values and sums on. Choose a width of which a task holds a stream's rows. Rows whose order is null are a bucket of their own, the first.
    """
    keys, by = list(keys), [*keys, "_bucket"]
    before, upto, after, totals = before or {}, upto or {}, after or {}, totals or {}
    rows = df.withColumn("_bucket", F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(1 << 62))))
    rows = rows.withColumns({f"_v_{n}": e for part in (before, upto, after, totals) for n, e in part.items()})
    inside = Window.partitionBy(*by).orderBy(order, *ties)
    rows = rows.withColumn("_place", F.row_number().over(inside))
    local = Window.partitionBy(*by).orderBy("_place")
    first, past, here = Window.unboundedPreceding, -1, 0
    own = {n: F.last(f"_v_{n}", ignorenulls=True).over(local.rowsBetween(first, past)) for n in before}
    own |= {n: F.last(f"_v_{n}", ignorenulls=True).over(local.rowsBetween(first, here)) for n in upto}
    listed = ", ".join(f"`{k}`" for k in by)
    own |= {n: F.expr(f"lead(`_v_{n}`, 1) IGNORE NULLS OVER (PARTITION BY {listed} ORDER BY _place)") for n in after}
    own |= {n: F.sum(f"_v_{n}").over(local.rowsBetween(first, here)) for n in totals}
    rows = rows.withColumns({f"_o_{n}": e for n, e in own.items()})

    known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col("_place"))
    ends = [F.max_by(f"_v_{n}", known(n)).alias(f"_e_{n}") for n in (*before, *upto)] + [F.min_by(f"_v_{n}", known(n)).alias(f"_e_{n}") for n in after] + [F.sum(f"_v_{n}").alias(f"_e_{n}") for n in totals]
    buckets = rows.groupBy(*by).agg(*ends)
    whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    told = ", ".join(f"`{k}`" for k in keys) or "0"
    carried = {n: F.last(f"_e_{n}", ignorenulls=True).over(whole.rowsBetween(first, past)) for n in (*before, *upto)}
    carried |= {n: F.expr(f"lead(`_e_{n}`, 1) IGNORE NULLS OVER (PARTITION BY {told} ORDER BY _bucket)") for n in after}
    carried |= {n: F.sum(f"_e_{n}").over(whole.rowsBetween(first, past)) for n in totals}
    buckets = buckets.select(*by, *(e.alias(f"_c_{n}") for n, e in carried.items()))

    same = lambda k: F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    on = same("_bucket")
    for k in keys:
        on = on & same(k)
    out = rows.alias("r").join(buckets.alias("b"), on)
    value = lambda n: F.coalesce(f"_o_{n}", f"_c_{n}").alias(n)
    total = lambda n: (F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n)
    return out.select(*(F.col(f"r.{c}").alias(c) for c in df.columns), *map(value, (*before, *upto, *after)), *map(total, totals))


def ranked(df: DataFrame, order: Sequence[str | Column], name: str, parts: int = 256) -> DataFrame:
    """row_number of the whole table, without one task for all rows: rows are dealt out by quantile ranges of the full order, counted by range, and numbered within.

    A range is some 1/parts of the rows whatever their values, so equal first columns spread as well. The table is computed once and kept in order by range, so
    the numbers within a range are those of its rows, and nothing is shuffled again.
    """
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    # The id that Spark gives a row has its partition over 33 bits of its place in it.
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_id", 33), "_r": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", base.alias("_base"))  # a row a range
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_base") + F.col("_r")).cast("long")).drop("_id", "_part", "_base", "_r")
