"""Suppression, components and congestion regions against brute force."""

import random

import numpy as np

from roadweave.operators.detections import suppressed
from roadweave.operators.graph import components
from roadweave.operators.reasoning import congestion_regions


def over(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    s = max(w, 0) * max(h, 0)
    return s / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - s, 1e-6)


def test_suppression_against_the_loop(spark):
    r = random.Random(9)
    rows = []
    for f in range(6):
        for _ in range(60):
            x, y = r.uniform(-50, 700), r.uniform(-50, 700)
            w, h = r.choice([(30, 30), (60, 40), (400, 300)])
            rows.append(("v", f, x, y, x + w + r.random(), y + h, r.choice([0.3, 0.5, 0.5, 0.9]), "car"))
        rows += [("v", f, 10.0, 10.0, 90.0, 90.0, 0.7, "car")] * 30 + [("v", f, 10.0 + k, 10.0, 90.0 + k, 90.0, 0.5 + k / 100, "car") for k in range(25)]
    rows += [("v", 9, None, 0.0, 1.0, 1.0, 0.5, "car"), ("v", 9, 0.0, 0.0, 10.0, 10.0, None, "car"), ("v", 9, 0.0, 0.0, 10.0, 11.0, 0.1, "car"), (None, 9, 0.0, 0.0, 10.0, 10.0, 0.2, "car")]
    df = spark.createDataFrame(rows, "video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, mode string")
    want = [x for x in rows if x[2] is None]
    for key in {x[:2] for x in rows}:
        kept = []
        for x in sorted((x for x in rows if x[:2] == key and x[2] is not None), key=lambda x: (-(x[6] if x[6] is not None else -9), x[2:6])):
            if all(over(k[2:6], x[2:6]) <= 0.6 for k in kept):
                kept.append(x)
        want += kept
    for cell in (64.0, 1000.0):
        got = [tuple(x) for x in suppressed(df, 0.6, cell).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert suppressed(df.where("false")).count() == 0 and suppressed(df).columns == df.columns


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)] + [(7, 7), (None, 3)]
    low = {x: x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}
    for _ in range(len(low)):
        for a, b in edges:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == low


def test_congestion_regions_against_flood_fill(spark):
    r = random.Random(12)
    cells = [(p, s, i, s * 50.0, i * 20.0, r.choice([5.0, 8.0, 12.0, 30.0, 40.0, None]), r.uniform(1, 90)) for p in "ab" for s in range(12) for i in range(25) if r.random() < 0.9]
    df = spark.createDataFrame(cells, "corridor string, segment int, interval int, segment_start_m double, interval_start_s double, speed_kmh double, density_veh_per_km double")
    want = []
    for p in "ab":
        left = {(s, i): (t, v, m, k) for q, s, i, m, t, v, k in cells if q == p and v is not None and v < 15}
        clip = min(t for q, _, _, _, t, _, _ in cells if q == p)
        while left:
            stack, comp = [next(iter(left))], []
            comp.append(left.pop(stack[0]))
            while stack:
                s, i = stack.pop()
                for n in ((s + 1, i), (s - 1, i), (s, i + 1), (s, i - 1)):
                    if n in left:
                        comp.append(left.pop(n))
                        stack.append(n)
            if len(comp) < 4:
                continue
            t0, v0, m0, _ = min(comp)
            ts = sorted({c[0] for c in comp})
            edge = [min(c[2] for c in comp if c[0] == t) for t in ts]
            k = int(np.argmin(edge))
            slope = lambda a, b: float(np.polyfit(ts[a:b], edge[a:b], 1)[0]) if b - a >= 3 and len(ts) >= 3 else None  # noqa: B023, E731
            want.append((p, len(comp), m0, t0, v0, t0, ts[-1], max(c[2] for c in comp) - min(c[2] for c in comp), min(c[1] for c in comp), max(c[3] for c in comp), slope(0, len(ts)), slope(0, k + 1), slope(k, len(ts)), abs(t0 - clip) < 1e-6))
    got = [tuple(x) for x in congestion_regions(df, "corridor").collect()]
    clean = lambda rows: sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in x)) for x in rows)
    assert clean(got) == clean(want) and len(want) > 5
    assert congestion_regions(df.where("false"), "corridor").count() == 0
