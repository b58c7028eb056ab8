"""Mixing sources to target weights by fixed-length blocks and pseudorandom permutations of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import WORD, partitions, slices, small_table, stored, table

BLOCK = 64  # words in a block
SHARD = 4096  # slots in an output shard
PARTS = 4096  # of a source's rows, each of which one task numbers


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: share times all words by weight; what is over most times a size goes to the others by weight."""
    total = share * sum(sizes)
    out, capped = [0.0] * len(sizes), [n == 0 for n in sizes]
    while True:
        rest = total - sum(o for o, c in zip(out, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        if not weight:
            return out
        over = False
        for k, n in enumerate(sizes):
            if not capped[k]:
                out[k] = rest * weights[k] / weight
                if out[k] > most * n:
                    over = True
        if not over:
            return out
        for k, n in enumerate(sizes):
            if not capped[k] and out[k] > most * n:
                out[k], capped[k] = most * n, True


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of the indices i under a pseudorandom permutation of 0..n-1: a four-round Feistel network that walks its cycles."""
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(b"%d:%d" % (seed, k))) for k in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            h = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(i.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def drawn(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n balls drawn from counts without replacement, exactly and alike for counts of any size.

    Each ball is taken by a coin toss first; then as many as are too many, or too few, are drawn from those
    taken, or left, in the same way. That is about the square root of n, so the last few are drawn one by one soon.
    """
    total = int(counts.sum())
    if n > total - n:
        return counts - drawn(rng, counts, total - n)
    if n <= 32:
        left, out = counts.copy(), np.zeros_like(counts)
        for _ in range(n):
            k = int(np.searchsorted(np.cumsum(left), rng.integers(int(left.sum())), side="right"))
            left[k] -= 1
            out[k] += 1
        return out
    out = rng.binomial(counts, n / total)
    over = int(out.sum()) - n
    return out - drawn(rng, out, over) if over > 0 else out + drawn(rng, counts - out, -over)


def shard_counts(shard: int, shards: int, slots: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The multinomial source counts of one output shard, given that all shards together meet the quotas; and the counts of all shards before.

    The draws split the shards in halves, each split seeded by its range, so any task finds any shard's
    counts in logarithmically many draws, and all tasks agree.
    """
    low, high, have, before = 0, shards, quotas.copy(), np.zeros_like(quotas)
    size = lambda a, b: min(b * slots, int(quotas.sum())) - a * slots
    while high - low > 1:
        mid = (low + high) // 2
        left = drawn(np.random.default_rng([seed, low, high]), have, size(low, mid))
        if shard < mid:
            high, have = mid, left
        else:
            low, before, have = mid, before + left, have - left
    return have, before


class Mixture:
    """Packs documents into blocks of each source, and draws a mixture of blocks.

    A null text counts as empty, a null source is a source, the last by order. Words are runs of other
    than ASCII white space. Rows are packed in the order of a hash of their id and then id and size, so a hot
    source is numbered by many tasks; rows that repeat an id are packed one by one. The order is that of `parts` fixed parts of the hashes, so the mixture
    depends on the rows and these parameters alone, not on the session's partitions. Only one row per
    source (its name, words and documents) comes to the driver: sources are what weights are configured
    for, so their number is bounded by that configuration.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block: int = BLOCK, slots: int = SHARD, seed: int = 17, parts: int = PARTS) -> None:
        self.block, self.slots, self.seed, self.docs = block, slots, seed, docs
        spark = docs.sparkSession
        sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("text_hash"))
        self.sized = stored(sized.withColumn("part", F.pmod(F.col("text_hash"), F.lit(parts)).cast("int")), "sizes")
        sums = self.sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
        rows = [r for r in self.sized.groupBy("source").agg(F.sum("size").alias("words")).collect()]
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.sources = [r["source"] for r in rows]
        self.sizes = [int(r["words"]) for r in rows]
        self.targets = targets(self.sizes, [weights[k % len(weights)] for k in range(len(rows))], share, most)
        self.blocks = [-(-n // block) for n in self.sizes]
        # A source's slots: rounded to whole blocks, and at most `most` passes over them.
        self.quotas = [min(int(most * b), round(t / n * b)) if n else 0 for n, t, b in zip(self.sizes, self.targets, self.blocks)]
        named = small_table(spark, [list(range(len(rows))), self.sources, self.sizes, self.targets], "sid int, source_name string, source_size long, target double")
        from pyspark.sql import Window

        before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "base")
        inside = Window.partitionBy("source", "part").orderBy("doc_id", "text_hash")
        placed = self.sized.withColumn("row", F.row_number().over(inside)).withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        placed = placed.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
        placed = placed.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("source_name")))
        placed = placed.withColumn("start", F.col("base") + F.col("inner"))
        #: doc_id, text_hash, source, size, sid, part, row, start (its first word's place in the source), source_size, target
        self.placed = stored(placed.select("doc_id", "text_hash", "source", "size", "sid", "part", "row", "start", "source_size", "target"), "placed")

    def pieces(self) -> DataFrame:
        """A row per document and block that it reaches: sid, block, first (word within the document), words. Empty documents have none."""
        b = F.lit(self.block)
        cut = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        first = F.greatest(F.lit(0).cast("long"), F.col("block") * b - F.col("start"))
        last = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start"))
        return cut.select("sid", "block", "doc_id", "text_hash", "part", "row", "size", first.alias("first"), (last - first).alias("words"))

    def slots_of(self) -> DataFrame:
        """The mixture: shard, slot, sid, block. Each slot's block is found by its source's permutation of block indices."""
        spark, seed, width = self.docs.sparkSession, self.seed, self.slots
        quotas, blocks = np.array(self.quotas, np.int64), list(self.blocks)
        shards = -(-int(quotas.sum()) // width)

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard in frame["id"].tolist():
                    have, before = shard_counts(shard, shards, width, quotas, seed)
                    sid = np.repeat(np.arange(len(have)), have)
                    block = np.empty(len(sid), np.int64)
                    for k in np.flatnonzero(have):
                        at = before[k] + np.arange(have[k])
                        epoch, i = at // blocks[k], at % blocks[k]
                        for e in np.unique(epoch):
                            block[np.flatnonzero(sid == k)[epoch == e]] = permuted(i[epoch == e], blocks[k], xxhash.xxh32_intdigest(b"%d:%d:%d" % (seed, k, e)))
                    order = np.random.default_rng([seed, shard, 1]).permutation(len(sid))
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(sid)), "sid": sid[order], "block": block[order]})

        if not shards:
            return small_table(spark, [[]] * 4, "shard long, slot int, sid int, block long")
        return spark.range(0, shards, 1, min(shards, partitions(spark))).mapInPandas(draw, "shard long, slot int, sid int, block long")

    def _times(self) -> DataFrame:
        """How often each block is in the mixture. Its size grows with the data, which the planner cannot see behind the draws, so its join is hinted to be a merge."""
        return self.slots_of().groupBy("sid", "block").agg(F.count(F.lit(1)).cast("int").alias("times")).hint("merge")

    def taken(self) -> DataFrame:
        """Every document with the words that the mixture takes of it, repeats counted: its pieces, joined by block index with the slots."""
        times = self._times()
        got = self.pieces().select("sid", "block", "part", "row", "words").join(times, ["sid", "block"])
        got = got.groupBy("sid", "part", "row").agg(F.sum(F.col("words") * F.col("times")).alias("got"))
        return self.placed.join(got.hint("merge"), ["sid", "part", "row"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0).cast("long")).alias("taken"))

    def documents(self) -> DataFrame:
        """The mixture as documents, with all columns of docs: in pass e the words of a document whose blocks are taken over e times.

        A document that the mixture takes nothing of has no row; one taken whole keeps its text as it is.
        """
        spark = self.docs.sparkSession
        times = self._times()
        got = self.pieces().join(times, ["sid", "block"]).where("words > 0")
        spans = got.groupBy("sid", "part", "row", "text_hash", "size").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("__rw_spans"))
        spans = spans.select(F.col("text_hash").alias("__rw_hash"), "__rw_spans", F.col("size").alias("__rw_size"), F.row_number().over(_copies("text_hash")).alias("__rw_copy"))
        own = self.docs.withColumn("__rw_h", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
        own = own.withColumn("__rw_c", F.row_number().over(_copies("__rw_h")))
        # The copy numbers tell rows that repeat id and text apart; as a difference they are no join key, which keeps the window's partitioning.
        both = own.join(spans.hint("merge"), (F.col("__rw_h") == F.col("__rw_hash")) & (F.col("__rw_c") - F.col("__rw_copy") == 0))
        from pyspark.sql.types import StructType

        names = self.docs.columns
        sized = "n_chars" in names

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import re

            word = re.compile(WORD)
            for part in slices(batches, "text", 1 << 20):
                rows, texts = [], []
                for k, (text, spans, size) in enumerate(zip(part.column("text").to_pylist(), part.column("__rw_spans").to_pylist(), part.column("__rw_size").to_pylist())):
                    bounds = None
                    for e in range(max(s["times"] for s in spans)):
                        own = [(s["first"], s["first"] + s["words"]) for s in spans if s["times"] > e]
                        if sum(b - a for a, b in own) == size:
                            texts.append(text)
                        else:
                            bounds = bounds or [m.span() for m in word.finditer(text)]
                            merged = []
                            for a, b in own:
                                if merged and merged[-1][1] == a:
                                    merged[-1][1] = b
                                else:
                                    merged.append([a, b])
                            texts.append("\n".join(text[bounds[a][0] : bounds[b - 1][1]] for a, b in merged))
                        rows.append(k)
                out = part.take(pa.array(rows, pa.int64())).select(names)
                cols = dict(zip(names, out.columns))
                cols["text"] = pa.array(texts, pa.string())
                if sized:
                    cols["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

        schema = StructType(list(self.docs.schema.fields))
        return both.select(*names, "__rw_spans", "__rw_size").mapInArrow(cut, schema)


def _copies(*keys: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.lit(1))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and its source; nulls, ties and repeats as in Mixture."""
    mix = Mixture(table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "source")
