"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, grouped, lookup_join, table
from roadweave.llm.components import components

WIDTH = 2.0  # of a quantisation step, in the unit sphere's space; about here near pairs part from others with the fewest tables
MISS = 1e-4  # chance at most that a pair just at the threshold shares no bucket
CHUNK = 512  # vectors of a bucket that one check takes; larger buckets are split into pairs of chunks
SIGNS = 128  # bits of a vector's sketch, the signs of as many projections
SPREAD = 6.0  # standard deviations over the mean of differing bits of a pair at the threshold, beyond which sketches rule a pair out: a chance under 10^-7


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection of two points at that distance is equal."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(classes: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Projections per table and tables: as many projections as keep unrelated vectors to some 16 a bucket, then as many tables as the miss rate needs."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(classes, 32) / 16) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def differing(threshold: float) -> int:
    """The bits at most in which the sketches of a pair at the threshold differ; each does with a chance of their angle over pi."""
    p = math.acos(threshold) / math.pi
    return math.floor(SIGNS * p + SPREAD * math.sqrt(SIGNS * p * (1 - p)))


def _bounds(group: np.ndarray) -> list[int]:
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]


def hashed_points(classes: DataFrame, tables: int, k: int, seed: int) -> DataFrame:
    """cid, copies, x (the values' bytes), two halves of the sketch, and the bucket keys of all tables."""
    kind = np.float32 if "array<float>" in classes.schema["v"].simpleString() else np.float64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                raw = part.column("v").flatten().to_numpy().reshape(-1, d).astype(kind)
                x = unit(raw)
                r = np.random.default_rng([seed, int(d)])
                projections, shifts = r.normal(size=(d, tables * k)), r.uniform(0, WIDTH, tables * k)
                cell = np.floor((x @ projections + shifts) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
                mix = (r.integers(1, 1 << 62, (tables, k)) * 2 + 1).astype(np.int64)
                with np.errstate(over="ignore"):
                    keys = (cell * mix[None]).sum(2)
                    keys = (keys ^ (keys >> 31)) * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) + int(d) * 1_000_003
                sketch = np.packbits(x @ r.normal(size=(d, SIGNS)) > 0, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("copies"), pa.array([row.tobytes() for row in raw], pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(list((keys >> 32).astype(np.int32)), pa.list_(pa.int32()))],
                    names=["cid", "copies", "x", "s1", "s2", "keys"],
                )

    return classes.mapInArrow(hashed, "cid long, copies long, x binary, s1 long, s2 long, keys array<int>")


def unit(x: np.ndarray) -> np.ndarray:
    """The rows in double precision, of length one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 23, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; two link when their cosine, in double precision, reaches the threshold.

    Vectors that are null, empty, zero or hold a null or a value that is not finite link with nothing, nor do vectors of
    different lengths. Equal vectors are first folded into one class, whose rows all link with each other; only
    classes are hashed. In each bucket sketches meet first, and only vectors that one of them might be near to follow.
    A pair that shares buckets of several tables counts in the first one (told by 32 bits of each key, of which two unequal
    ones agree with a chance of 2^-32), so no list of pairs is made: each check returns one row per vector. A null id takes
    part, and never is a component's smallest unless alone. Rows that repeat an id each count. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    if "array<float>" not in v.schema["v"].simpleString():
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("key", F.when(sound, F.unhex(F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0).cast("float")).cast("string"))), 256))))
    classes = v.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = scratch.stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    k, tables = plan(n, threshold)
    points = scratch.stored(hashed_points(classes, tables, k, seed), "points")

    rows = points.select("cid", "s1", "s2", F.posexplode("keys").alias("t", "b"))
    buckets = rows.groupBy("t", "b").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = lookup_join(rows, buckets, ["t", "b"], "m", n * tables, ["cid"]).where("m IS NOT NULL")
    rows = rows.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("cid", "t"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(F.xxhash64("t", "b", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("group"), "cid", "s1", "s2", "t", F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side"))
    most, limit = differing(threshold), threshold

    def apart(side: np.ndarray, link: np.ndarray) -> np.ndarray:
        """Without a vector's link to itself; of a pair of chunks only the links across."""
        np.fill_diagonal(link, False)
        return link & (side[:, None] != side[None]) if side[0] else link

    def sketched(whole: pa.Table) -> pa.RecordBatch | None:
        """The rows of a group that another row's sketch is near to."""
        group, side = whole.column("group").to_numpy(), whole.column("side").to_numpy()
        bits = np.stack([whole.column(c).to_numpy() for c in ("s1", "s2")], 1)
        near = np.zeros(len(group), bool)
        for a, b in zip(bounds := _bounds(group), bounds[1:]):
            if b - a > 1:
                x = bits[a:b]
                count = np.bitwise_count(x[:, None, 0] ^ x[None, :, 0]) + np.bitwise_count(x[:, None, 1] ^ x[None, :, 1])
                near[a:b] = apart(side[a:b], count <= most).any(1)
        part = whole.select(["group", "cid", "t", "side"]).filter(pa.array(near)).combine_chunks()
        return part.to_batches()[0] if part.num_rows else None

    close = scratch.stored(grouped(rows, ["group"], sketched, "group long, cid long, t int, side int"), "close")

    def check(whole: pa.Table) -> pa.RecordBatch | None:
        """Links of every group's vectors with the others: copies linked first here, and the least class number that they reach within the group."""
        group, names, copies, t, side = (whole.column(c).to_numpy() for c in ("group", "cid", "copies", "t", "side"))
        x = whole.column("x").to_pylist()
        keys = whole.column("keys").combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(bounds := _bounds(group), bounds[1:]):
            if b - a < 2 or len({len(v) for v in x[a:b]}) > 1:
                continue
            y = unit(np.frombuffer(b"".join(x[a:b]), kind).reshape(b - a, -1))
            link = apart(side[a:b], y @ y.T >= limit)
            if not link.any():
                continue
            i, j = np.nonzero(link)
            first = ~(keys[a + i, : t[a]] == keys[a + j, : t[a]]).any(1) if t[a] else np.ones(len(i), bool)
            seen = np.bincount(i, copies[a + j] * first, b - a).astype(np.int64)
            low = np.arange(b - a)
            while True:
                new = low.copy()
                np.minimum.at(new, i, low[j])
                new = np.minimum(new, new[new])
                if (new == low).all():
                    break
                low = new
            at = np.flatnonzero(link.any(1))
            out.append((names[a + at], seen[at], names[a + low[at]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cid", "seen", "root"]) if out else None

    kind = np.float32 if "array<float>" in classes.schema["v"].simpleString() else np.float64
    vectors_of = close.join(points.select("cid", "copies", "x", "keys"), "cid")
    found = scratch.stored(grouped(vectors_of, ["group"], check, "cid long, seen long, root long", order=["cid"]), "links")
    scratch.drop(close, points)
    seen = found.groupBy("cid").agg(F.sum("seen").alias("seen"))
    joined = components(found.where("cid <> root"), "cid", "root", scratch)
    named = classes.select("cid", "key", "rep", "copies").join(seen, "cid", "left").join(joined.select(F.col("node").alias("cid"), F.col("component").alias("root")), "cid", "left")
    named = scratch.stored(named.select("key", "rep", "copies", F.coalesce("seen", F.lit(0).cast("long")).alias("seen"), F.coalesce("root", "cid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("m"))
    named = lookup_join(named, least, ["root"], "m", n, ["key"])
    result = scratch.stored(named.select("key", "copies", (F.col("seen") + F.col("copies") - 1).alias("n_links"), "component"), "classes")
    scratch.drop(classes, found, joined)
    out = lookup_join(v.select("vec_id", "key"), result, ["key"], "copies", int(total), ["vec_id"])
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, unsound ones too, as near_duplicates gives them."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
