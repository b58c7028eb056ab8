"""The test tables have no tracks; these views, in SQL that Spark and DuckDB both take, stand in for them.

tracks: one per user of `events`, a row per event, with short gaps that can be filled and a long one; a fifth of them
hardly move. movements: one per line item, from the customer's to the supplier's region. crossings: the events of
each type over time. The operators run on surrogate data; what is compared is their algebra.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from roadweave.functions.expressions import GroundPlane
from roadweave.operators.scan import ranked

FPS = 5.0
CAMERA = GroundPlane(70.472, -63.1, 924.5, 1920, 1080)
LINE = [(40.0, 0.0), (120.0, 5.0), (200.0, 0.0), (360.0, -4.0)]
LABELS = "CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'van' WHEN 'purchase' THEN 'truck' WHEN 'signup' THEN 'motor' WHEN 'error' THEN 'pedestrian' ELSE 'others' END"

TRACKS = f"""
SELECT user_id AS track_id, frame, cx - w / 2e0 AS x1, cy - h / 2e0 AS y1, cx + w / 2e0 AS x2, cy + h / 2e0 AS y2, conf, cls_name, event_id
FROM (
  SELECT user_id, event_id, CAST(rn + 4 * tens + CASE WHEN rn >= 40 THEN 40 ELSE 0 END AS INT) AS frame,
         200e0 + 3 * (user_id % 5) * (rn + 4 * tens) + event_id % 3 AS cx, 100e0 + (user_id * 37) % 900 AS cy,
         40e0 + event_id % 9 AS w, 30e0 + event_id % 7 AS h, 2e-1 + (event_id % 80) / 1e2 AS conf, {LABELS} AS cls_name
  FROM (SELECT user_id, event_id, event_type, rn, CAST(floor(rn / 1e1) AS INT) AS tens
        FROM (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS rn FROM EVENTS) a) b
) c
"""

#: Tracks that are already on the ground, along a corridor, with modes and speeds.
GROUND = f"""
SELECT user_id AS track_id, frame, 20e0 + (1 + user_id % 6) * 9e-1 * rn + (event_id % 7) / 1e1 AS world_x_m,
       ((user_id * 37) % 24 - 12) * 9e-1 + (event_id % 3) * 4e-1 AS world_y_m,
       CAST(CASE WHEN event_id % 23 = 0 THEN NULL ELSE (1 + user_id % 6) * 3e0 + event_id % 11 END AS DOUBLE) AS speed_kmh,
       CASE user_id % 7 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'motorcycle' WHEN 2 THEN 'LGV' WHEN 3 THEN 'bus' ELSE 'car' END AS mode,
       user_id % 6 = 0 AS parked, event_id
FROM (SELECT user_id, event_id, rn, CAST(rn + 2 * CAST(floor(rn / 1e1) AS INT) + (user_id % 40) * 5 AS INT) AS frame
      FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS rn FROM EVENTS) a) b
"""

MOVEMENTS = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS track_id,
       a.r_name AS origin, b.r_name AS destination,
       CASE WHEN a.r_regionkey = b.r_regionkey THEN 'internal' WHEN (a.r_regionkey + 1) % 5 = b.r_regionkey THEN 'right'
            WHEN (a.r_regionkey + 4) % 5 = b.r_regionkey THEN 'left' ELSE 'through' END AS turn,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'truck' WHEN 'FURNITURE' THEN 'LGV' WHEN 'MACHINERY' THEN 'HGV' ELSE 'motorcycle' END AS mode,
       CAST(o_orderkey % 5000 AS INT) AS f0, CAST(o_orderkey % 5000 + 20 + l_linenumber * 7 AS INT) AS f1,
       CAST(l_quantity AS DOUBLE) * 3e0 AS travel_m, CASE WHEN l_linenumber < 5 THEN CAST(l_linenumber AS INT) END AS lane_in
FROM LINEITEM JOIN ORDERS ON l_orderkey = o_orderkey JOIN CUSTOMER ON o_custkey = c_custkey JOIN SUPPLIER ON l_suppkey = s_suppkey
JOIN NATION na ON c_nationkey = na.n_nationkey JOIN NATION nb ON s_nationkey = nb.n_nationkey
JOIN REGION a ON na.n_regionkey = a.r_regionkey JOIN REGION b ON nb.n_regionkey = b.r_regionkey
"""


def _sql(text: str, marks: dict[str, str]) -> str:
    for k, v in marks.items():
        text = text.replace(k, v)
    return text


def duck(view: str) -> str:
    """The view's SQL for DuckDB."""
    return _sql(view, {k: k.lower() for k in ("EVENTS", "LINEITEM", "ORDERS", "CUSTOMER", "SUPPLIER", "NATION", "REGION")})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view over the folder's tables; Spark reads only the columns that the query needs."""
    names = [t for t in ("EVENTS", "LINEITEM", "ORDERS", "CUSTOMER", "SUPPLIER", "NATION", "REGION") if t in text]
    return spark.sql(_sql(text, {t: f"{{{t.lower()}}}" for t in names}), **{t.lower(): spark.read.parquet(f"{sf_dir}/{t.lower()}.parquet") for t in names})


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRACKS)


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GROUND)


#: What a movement tells besides its number.
MOVED = ("origin", "destination", "turn", "mode", "f0", "f1", "travel_m", "lane_in")
#: The view's number of a row, and the columns that order it.
NUMBER, ORDER = re.search(r"row_number\(\) OVER \(ORDER BY (.*?)\)", MOVEMENTS).group(0, 1)


def movements(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The movements, or those columns of them. Their numbers are counted by ranges of the order, which needs no task for all rows."""
    kept = columns or ("track_id", *MOVED)
    if "track_id" not in kept:
        return view(spark, sf_dir, MOVEMENTS.replace(f"{NUMBER} AS track_id,", "")).select(*kept)
    order = ORDER.split(", ")
    rows = view(spark, sf_dir, MOVEMENTS.replace(f"{NUMBER} AS track_id", ORDER)).select(*order, *(c for c in kept if c != "track_id"))
    return ranked(rows, order, "track_id").select(*kept)


def projected_sql(x: str, y: str, line: list[tuple[float, float]]) -> str:
    """DuckDB's form of expressions.projected, a struct of s_m and offset_m."""
    import math

    parts, at = [], 0.0
    for k, (a, b) in enumerate(zip(line, line[1:])):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = max(math.hypot(dx, dy), 1e-9)
        t = f"least(greatest((({x} - {a[0]!r}) * {dx!r}::DOUBLE + ({y} - {a[1]!r}) * {dy!r}::DOUBLE) / ({n!r}::DOUBLE * {n!r}::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"
        ex, ey = f"({x} - ({a[0]!r}::DOUBLE + {t} * {dx!r}::DOUBLE))", f"({y} - ({a[1]!r}::DOUBLE + {t} * {dy!r}::DOUBLE))"
        d2 = f"({ex} * {ex} + {ey} * {ey})"
        parts.append(f"{{'d2': {d2}, 'k': {k}, 's_m': {at!r}::DOUBLE + {t} * {n!r}::DOUBLE, 'offset_m': sign({dx!r}::DOUBLE * {ey} - {dy!r}::DOUBLE * {ex}) * sqrt({d2})}}")
        at += n
    return f"list_min([{', '.join(parts)}])"
