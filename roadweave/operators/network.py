"""Approaches, movements, lanes and centrelines inferred from tracks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.expressions import bearing, circular_mean, turn_of
from roadweave.storage import cut

#: The 16 compass points.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def endpoints(df: DataFrame, min_travel_m: float = 25.0, frame: tuple[int, int] | None = None, margin_px: float = 45.0, keys: Sequence[str] = ()) -> DataFrame:
    """Per track its first and last known place (each column by itself), span, travel, bearings over its first and last points, and whether its ends lie at the border."""
    at = lambda c, f: f(c, F.when(F.col(c).isNotNull(), F.col("frame")))
    track = [*keys, "track_id"]
    w = Window.partitionBy(*track)
    known = F.col("world_x_m").isNotNull() & F.col("world_y_m").isNotNull()
    df = df.withColumns({"_i": F.when(known, F.count_if(known).over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))), "_n": F.count_if(known).over(w)})
    k = F.greatest(F.lit(2), F.least(F.floor(F.col("_n") / 4), F.lit(45)))
    pick = lambda c, i: F.max(F.when(known & (F.col("_i") == i), F.col(c)))
    cols = {"x0": at("world_x_m", F.min_by), "y0": at("world_y_m", F.min_by), "x1": at("world_x_m", F.max_by), "y1": at("world_y_m", F.max_by), "f0": F.min("frame"), "f1": F.max("frame"), "mode": at("mode", F.min_by)}
    for c, a in (("world_x_m", "x"), ("world_y_m", "y")):
        cols |= {f"_{a}1": pick(c, F.lit(1)), f"_{a}k": pick(c, k), f"_{a}m": pick(c, F.col("_n") - k + 1), f"_{a}n": pick(c, F.col("_n"))}
    if frame:
        cols |= {"px0": at("cx", F.min_by), "py0": at("cy", F.min_by), "px1": at("cx", F.max_by), "py1": at("cy", F.max_by)}
    g = df.groupBy(*track).agg(*(v.alias(n) for n, v in cols.items()))
    edge = (lambda x, y: (x <= margin_px) | (x >= frame[0] - 1 - margin_px) | (y <= margin_px) | (y >= frame[1] - 1 - margin_px)) if frame else (lambda x, y: F.lit(True))
    g = g.withColumns({"travel_m": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "bearing_in": bearing(F.col("_xk") - F.col("_x1"), F.col("_yk") - F.col("_y1")), "bearing_out": bearing(F.col("_xn") - F.col("_xm"), F.col("_yn") - F.col("_ym")), "on_edge_in": edge(F.col("px0") if frame else None, F.col("py0") if frame else None), "on_edge_out": edge(F.col("px1") if frame else None, F.col("py1") if frame else None)})
    return g.where((F.col("travel_m") >= min_travel_m) & F.col("x0").isNotNull() & F.col("y0").isNotNull()).select(*track, "x0", "y0", "x1", "y1", "f0", "f1", "mode", "travel_m", "bearing_in", "bearing_out", "on_edge_in", "on_edge_out")


def average_linkage(points: np.ndarray, weights: np.ndarray, cut: float) -> np.ndarray:
    """Labels of weighted points: the two clusters of least mean distance merge while it is at most cut. Labels order by first member.

    Clusters only merge if some of their points lie within cut, so each connected neighbourhood is worked on its own: by chains of
    nearest neighbours where a matrix of its points is small, and else by `merged_near` first. Memory is bounded by the points; time is their square.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, int)
    label = np.arange(n)
    for part in neighbourhoods(points, cut):
        for i, j, height in merges(points[part], weights[part].astype(float), cut):
            if height <= cut:
                a, b = sorted((label[part[i]], label[part[j]]))
                label[part[label[part] == b]] = a
    return np.unique(label, return_inverse=True)[1]


def neighbourhoods(points: np.ndarray, reach: float) -> list[np.ndarray]:
    """The indices of points that steps of at most reach connect. Points of one cell, whose diagonal is reach, always are; cells are compared while they are apart."""
    cells: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(np.floor(points * (2**0.5 / max(reach, 1e-9))).astype(np.int64).tolist()):
        cells.setdefault((x, y), []).append(k)
    low = np.arange(len(points))

    def root(k: int) -> int:
        while low[k] != k:
            low[k] = low[low[k]]
            k = int(low[k])
        return k

    for own in cells.values():
        low[own] = own[0]
    for (x, y), own in cells.items():
        for dx, dy in ((0, 1), (0, 2), *((dx, dy) for dx in (1, 2) for dy in range(-2, 3))):
            other = cells.get((x + dx, y + dy))
            if other is None or (a := root(own[0])) == (b := root(other[0])):
                continue
            q = points[other]
            if any((np.hypot(q[:, 0] - px, q[:, 1] - py) <= reach).any() for px, py in points[own]):
                low[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(points))])
    order = np.argsort(roots, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)


def merges(points: np.ndarray, weights: np.ndarray, cut: float, matrix: int = 4096) -> list[tuple[int, int, float]]:
    """All merges up to a mean distance of cut, and maybe further ones. Clusters are merged by rounds until a matrix of them has at most `matrix` rows."""
    if len(points) <= matrix:
        return chained(points, weights)
    out, clusters = merged_near(points, weights, cut, matrix)
    if len(clusters) < 2:
        return out
    size = np.array([weights[c].sum() for c in clusters])
    d = mean_distances(points, weights, clusters) / (size[:, None] * size[None])
    return out + [(int(clusters[i][0]), int(clusters[j][0]), h) for i, j, h in chain(d, size)]


def mean_distances(points: np.ndarray, weights: np.ndarray, clusters: list[np.ndarray]) -> np.ndarray:
    """The weighted sums of distances between the points of every two clusters, computed for a few rows at a time."""
    order, starts = np.concatenate(clusters), np.cumsum([0, *(len(c) for c in clusters[:-1])])
    p, w, of = points[order], weights[order], np.repeat(np.arange(len(clusters)), [len(c) for c in clusters])
    out = np.zeros((len(clusters), len(clusters)))
    step = max(1, 4_000_000 // len(p))
    for at in range(0, len(p), step):
        d = np.hypot(p[at : at + step, :1] - p[None, :, 0], p[at : at + step, 1:] - p[None, :, 1]) * w
        np.add.at(out, of[at : at + step], np.add.reduceat(d, starts, axis=1) * w[at : at + step, None])
    return out


def merged_near(points: np.ndarray, weights: np.ndarray, cut: float, most: int) -> tuple[list[tuple[int, int, float]], list[np.ndarray]]:
    """(merges, clusters): rounds in which clusters that are each other's nearest, by mean distance, merge, until at most `most` may merge further.

    In average linkage such pairs merge sooner or later, whatever else does. The mean distance of two clusters lies between that of their centres, c, and the root of
    c * c and both variances, so only few pairs are measured. Clusters whose nearest is beyond cut are done.
    """
    out: list[tuple[int, int, float]] = []
    clusters = [np.array([k]) for k in range(len(points))]
    size, centre, spread = weights.copy(), points.astype(float), np.zeros(len(points))

    def mean(a: int, b: int) -> float:
        p, q, total = clusters[a], clusters[b], 0.0
        step = max(1, 4_000_000 // len(q))
        for at in range(0, len(p), step):
            r = p[at : at + step]
            total += float(weights[r] @ np.hypot(points[r, :1] - points[None, q, 0], points[r, 1:] - points[None, q, 1]) @ weights[q])
        return total / (size[a] * size[b])

    while len(clusters) > most:
        step = max(1, 1_000_000 // len(clusters))
        found: list[tuple[float, int, int] | None] = []
        known: dict[tuple[int, int], float] = {}
        for at in range(0, len(clusters), step):
            c2 = (centre[at : at + step, :1] - centre[None, :, 0]) ** 2 + (centre[at : at + step, 1:] - centre[None, :, 1]) ** 2
            rows = np.arange(len(c2))
            c2[rows, at + rows] = np.inf
            top = np.minimum((c2 + spread[at : at + step, None] + spread).min(1), cut * cut)
            ii, jj = np.nonzero(c2 <= top[:, None] * (1 + 1e-9))
            order = np.lexsort((c2[ii, jj], ii))
            best: list[tuple[float, int, int] | None] = [None] * len(c2)
            for i, j, low in zip(ii[order].tolist(), jj[order].tolist(), np.sqrt(c2[ii[order], jj[order]]).tolist()):
                if best[i] is not None and low > best[i][0] * (1 + 1e-9):
                    continue
                pair = (min(at + i, j), max(at + i, j))
                d = known.get(pair)
                if d is None:
                    d = known[pair] = low if len(clusters[pair[0]]) == len(clusters[pair[1]]) == 1 else mean(*pair)
                if d <= cut and (best[i] is None or (d, *pair) < best[i]):
                    best[i] = (d, *pair)
            found += best
        pairs = [f for k, f in enumerate(found) if f is not None and f[1] == k and found[f[2]] == f]
        if not pairs:
            break
        gone = set()
        for d, a, b in pairs:
            out.append((int(clusters[a][0]), int(clusters[b][0]), d))
            both = size[a] + size[b]
            apart = ((centre[a] - centre[b]) ** 2).sum()
            spread[a] = (size[a] * spread[a] + size[b] * spread[b]) / both + size[a] * size[b] / (both * both) * apart
            centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / both
            size[a], clusters[a] = both, np.concatenate([clusters[a], clusters[b]])
            gone.add(b)
        # What is beyond cut of all others stays so: a merged cluster is no nearer than its parts were.
        live = [k for k in range(len(clusters)) if k not in gone and found[k] is not None]
        clusters, size, centre, spread = [clusters[k] for k in live], size[live], centre[live], spread[live]
    return out, clusters


def chained(points: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (i, j, mean distance) of average linkage, i and j being members of the clusters: a chain follows nearest neighbours until two are each other's."""
    d = np.hypot(points[:, None, 0] - points[None, :, 0], points[:, None, 1] - points[None, :, 1])
    return chain(d, size)


def chain(d: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """The same from a matrix of mean distances, which is overwritten."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, path, out, live = size.copy(), [], [], np.ones(n, bool)
    while len(out) < n - 1:
        if not path:
            path = [int(np.flatnonzero(live)[0])]
        i = path[-1]
        j = int(d[i].argmin())
        # A tie with the one before it in the chain ends the chain.
        if len(path) > 1 and d[i, path[-2]] <= d[i, j]:
            j = path[-2]
            del path[-2:]
            a, b = min(i, j), max(i, j)
            out.append((a, b, float(d[a, b])))
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a], d[:, a] = new, new
            d[a, a] = np.inf
            d[b], d[:, b] = np.inf, np.inf
            d[a, ~live] = d[~live, a] = np.inf
            size[a] += size[b]
            live[b] = False
        else:
            path.append(j)
    return out


def gates(ends: DataFrame, cluster_m: float = 25.0, min_tracks: int = 12, cell_m: float | None = None, scene: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(gates, ends with gate_in and gate_out, -1 for none) from the clustered entry and exit points.

    scene names a column of ends that tells recordings or places apart: each is clustered by a task of its own, in the square of
    its distinct points. For a scene with more endpoints than that allows, cell_m counts them by cells first, which bounds the
    work by the scene's area; then points within a cell share a gate, and results differ a little from those of exact points.
    """
    keys = [scene] if scene else []
    ends = ends.withColumn("_scene", F.col(scene).cast("string") if scene else F.lit("all"))
    at = lambda v: F.floor(v / cell_m).cast("double") if cell_m else v
    both = ends.where("on_edge_in").select("_scene", *keys, F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(1).alias("i"), F.col("bearing_in").alias("b")).unionByName(ends.where("on_edge_out").select("_scene", *keys, F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0).alias("i"), F.col("bearing_out").alias("b")))
    both = both.withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
    cells = both.groupBy("_scene", "cx", "cy").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))

    def label(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y"])
        return pd.DataFrame({"_scene": g["_scene"], "cx": g["cx"], "cy": g["cy"], "label": average_linkage(g[["x", "y"]].to_numpy(), g["n"].to_numpy(), cluster_m)})

    labels = cut(cells.groupBy("_scene").applyInPandas(label, "_scene string, cx double, cy double, label int"))
    j = both.join(labels, ["_scene", "cx", "cy"])
    g = j.groupBy("_scene", *keys, "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("i").alias("n_in"), F.sum(1 - F.col("i")).alias("n_out"), circular_mean(F.when(F.col("i") == 1, F.col("b"))).alias("bearing_in"), circular_mean(F.when(F.col("i") == 0, F.col("b"))).alias("bearing_out")).where(F.col("n_in") + F.col("n_out") >= min_tracks)
    g = g.withColumn("gate", F.row_number().over(Window.partitionBy("_scene").orderBy("label")) - 1)
    lab = labels.join(g.select("_scene", "label", "gate"), ["_scene", "label"]).select("_scene", "cx", "cy", "gate")
    e = ends
    for side, x, y in (("in", "x0", "y0"), ("out", "x1", "y1")):
        e = e.withColumns({"_cx": F.when(F.col(f"on_edge_{side}"), at(F.col(x))), "_cy": F.when(F.col(f"on_edge_{side}"), at(F.col(y)))})
        e = e.join(lab.select("_scene", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("gate").alias(f"gate_{side}")), ["_scene", "_cx", "_cy"], "left").drop("_cx", "_cy")
    return named(g.drop("label"), scene=scene).drop("_scene"), e.withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("gate_in", "gate_out")}).drop("_scene")


def compass_point(deg: Column) -> Column:
    k = F.floor(F.pmod(deg + 11.25, F.lit(360.0)) / 22.5).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), k + 1)


def named(g: DataFrame, yaw_deg: float = 0.0, scene: str | None = None) -> DataFrame:
    """Names gates by where traffic comes from; a repeated name gets its number."""
    b = F.coalesce("bearing_in", "bearing_out") + F.lit(yaw_deg)
    g = g.withColumn("_p", F.when(b.isNotNull(), compass_point(F.pmod(b + 180.0, F.lit(360.0)))).otherwise(F.concat(F.lit("G"), F.col("gate"))))
    r = F.row_number().over(Window.partitionBy(*([scene] if scene else []), "_p").orderBy("gate"))
    return g.withColumn("_r", r).withColumn("name", F.when(F.col("_r") > 1, F.concat("_p", F.col("_r").cast("string"))).otherwise(F.col("_p"))).drop("_p", "_r")


def movements(ends: DataFrame, g: DataFrame, scene: str | None = None) -> DataFrame:
    """A row per track with both gates: origin, destination and turn. Gates are a few rows of each scene, so they are broadcast where Spark sees that they are small."""
    keys = [scene] if scene else []
    e = ends.join(g.select(*keys, F.col("gate").alias("gate_in"), F.col("name").alias("origin")), [*keys, "gate_in"]).join(g.select(*keys, F.col("gate").alias("gate_out"), F.col("name").alias("destination")), [*keys, "gate_out"])
    turn = turn_of(F.col("bearing_in"), F.col("bearing_out"))
    same = (F.col("gate_in") == F.col("gate_out")) & (turn != "u-turn")
    return e.select(*keys, "track_id", "origin", "destination", F.when(same, "internal").otherwise(turn).alias("turn"), "mode", "f0", "f1", "travel_m", "gate_in", "gate_out")


def centrelines(df: DataFrame, mv: DataFrame, nodes: int = 24, min_points: int = 4, min_paths: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """keys, origin, destination, node, x, y: the median over paths of each of `nodes` places equally spaced along them."""
    track, pair = [*keys, "track_id"], [*keys, "origin", "destination"]
    rows = df.where("world_x_m IS NOT NULL AND world_y_m IS NOT NULL").join(mv.select(*track, "origin", "destination"), track)
    w, whole = Window.partitionBy(*track).orderBy("frame"), Window.partitionBy(*track)
    step = F.coalesce(F.hypot(F.col("world_x_m") - F.lag("world_x_m").over(w), F.col("world_y_m") - F.lag("world_y_m").over(w)), F.lit(0.0))
    rows = rows.withColumn("_d", step).withColumns({"_s": F.sum("_d").over(w), "_n": F.count(F.lit(1)).over(whole)}).where(F.col("_n") >= min_points)
    rows = rows.withColumns({"_t": F.max("_s").over(whole), "_s2": F.lead("_s").over(w), "_x2": F.lead("world_x_m").over(w), "_y2": F.lead("world_y_m").over(w)}).where("_t > 0 AND _s2 > _s")
    # Each piece of a path yields the nodes that fall on it, so nodes and pieces need no join.
    u = F.col("_t") / (nodes - 1)
    first, last = F.ceil(F.col("_s") / u - 1e-9), F.when(F.col("_s2") >= F.col("_t"), F.lit(nodes - 1)).otherwise(F.ceil(F.col("_s2") / u - 1e-9) - 1)
    rows = rows.withColumn("node", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("node") * u - F.col("_s")) / (F.col("_s2") - F.col("_s"))))
    x = (F.col("world_x_m") + share * (F.col("_x2") - F.col("world_x_m"))).alias("x")
    y = (F.col("world_y_m") + share * (F.col("_y2") - F.col("world_y_m"))).alias("y")
    rows = rows.select("track_id", *pair, F.col("node").cast("int").alias("node"), x, y)
    return rows.groupBy(*pair, "node").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count_distinct("track_id").alias("paths")).where(F.col("paths") >= min_paths).drop("paths")


def entry_lanes(df: DataFrame, mv: DataFrame, g: DataFrame, reach_m: float = 30.0, lane_width_m: float = 3.2, min_points: int = 3, min_tracks: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """keys, track_id, lane_in: each track's median offset across its entry, clustered per gate of its recording; equal offsets count once with their number.

    Gates are a few rows a recording and lanes a few a gate; Spark broadcasts them where their size allows it.
    """
    track, gate = [*keys, "track_id"], [*keys, "gate_in"]
    near = df.join(mv.select(*track, "gate_in"), track).join(g.select(*keys, F.col("gate").alias("gate_in"), F.col("x").alias("gx"), F.col("y").alias("gy"), "bearing_in"), gate)
    dx, dy, b = F.col("world_x_m") - F.col("gx"), F.col("world_y_m") - F.col("gy"), F.radians("bearing_in")
    near = near.where(F.hypot(dx, dy) <= reach_m).withColumn("o", dx * F.cos(b) - dy * F.sin(b))
    off = near.groupBy(*gate, "track_id").agg(F.median("o").alias("o"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_points) & F.col("o").isNotNull())
    fine = off.groupBy(*gate, "o").agg(F.count(F.lit(1)).alias("n"))

    def lanes(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("o")
        x, n = p["o"].to_numpy(), p["n"].to_numpy()
        lab = average_linkage(np.stack([x, np.zeros(len(x))], 1), n, 0.75 * lane_width_m)
        c = sorted(float(np.average(x[lab == k], weights=n[lab == k])) for k in np.unique(lab) if n[lab == k].sum() >= min_tracks)
        return pd.DataFrame({**{k: p[k].iloc[0] for k in gate}, "lane": range(len(c)), "centre": c})

    kinds = dict(fine.dtypes)
    centres = fine.groupBy(*gate).applyInPandas(lanes, ", ".join([*(f"`{k}` {kinds[k]}" for k in gate), "lane int", "centre double"]))
    j = off.join(centres, gate)
    return j.groupBy(*track).agg(F.min(F.struct(F.abs(F.col("o") - F.col("centre")).alias("d"), "lane"))["lane"].alias("lane_in"))


@dataclass
class Network:
    """What tracks tell of the roads: gates, movements with their entry lanes, and the centreline of every pair of gates with enough tracks."""

    gates: DataFrame
    movements: DataFrame
    centrelines: DataFrame

    def corridors(self) -> dict[tuple[str, str], list[tuple[float, float]]]:
        """The centrelines of one recording as polylines: two dozen points for each pair of gates, which operators take as literals."""
        out: dict[tuple[str, str], list[tuple[float, float]]] = {}
        for r in self.centrelines.orderBy("origin", "destination", "node").collect():
            out.setdefault((r["origin"], r["destination"]), []).append((r["x"], r["y"]))
        return out


def build(df: DataFrame, min_travel_m: float = 25.0, cluster_m: float = 25.0, min_tracks: int = 12, lane_width_m: float = 3.2, least_paths: int = 5, frame: tuple[int, int] | None = None, scene: str | None = None) -> Network:
    """Gates from where tracks begin and end, movements between them, entry lanes, and centrelines of pairs with at least least_paths real movements.

    scene names the column that tells recordings apart: each gets a network of its own, all in one plan. The tables, which have a row per gate, track, or node
    of a centreline, are computed here and kept, so what is made of them has short plans.
    """
    keys = [scene] if scene else []
    track, pair = [*keys, "track_id"], [*keys, "origin", "destination"]
    g, ends = gates(cut(endpoints(df, min_travel_m, frame, keys=keys)), cluster_m, min_tracks, scene=scene)
    g = cut(g)
    real = cut(movements(ends, g, scene))
    mv = cut(real.join(entry_lanes(df, real, g, lane_width_m=lane_width_m, keys=keys), track, "left"))
    pairs = mv.where("turn <> 'internal'")
    busy = pairs.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_paths).drop("n")
    return Network(g, mv, cut(centrelines(df, pairs.join(busy, pair, "left_semi"), keys=keys)))


def described(net: Network, keys: Sequence[str] = ()) -> DataFrame:
    """keys, field, value, n: how many gates there are, and movements by turn."""
    gates_ = net.gates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit("gates").alias("field"), F.lit(None).cast("string").alias("value"), "n")
    return gates_.unionByName(net.movements.groupBy(*keys, "turn").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit("turn").alias("field"), F.col("turn").alias("value"), "n"))
