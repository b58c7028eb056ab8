"""N-gram Jaccard self-join by signature trees.

How whole tables are joined without comparing everything: the hash space of a document's shingles is
cut into segments, and two similar documents agree exactly in some of them, since the shingles that differ are too few
to touch all. So documents meet by (segment, sum of its shingles' hashes), and the documents that
meet under one such key are compared by signature trees, whose dual traversal leaves pairs that cannot
overlap enough; the rest are verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, files_for, grouped, lookup_join, partitions, slices, table
from roadweave.llm.components import components
from roadweave.llm.shingles import mixed, shingle_sets
from roadweave.llm.signature_tree import SignatureTree

BITS = 2048  # of a document's token bitmap
CHUNK = 1024  # documents of one key that one tree comparison takes; larger keys are split into pairs of chunks
NEAREST = 2  # rounds in which each document only meets its nearest one, before all pairs that are left are compared
FAMILY = 256  # pairs of one document that share a copy of its set when they are verified
NARROW = 4096  # shingles of a set up to which its folded form is of 16 bits each
SMALL = 24  # up to so many shingles, two documents meet by one of their least ones instead (prefix filter)
SEGMENTS = ((48, 24), (96, 40), (192, 64))  # largest size and segments of the levels without sampling
USED = 44  # of a level's segments that make keys: with a chance of 0.35 for each to agree, all differ with one of 6 * 10^-9
SAMPLED = 0.55  # the similarity below which bitmaps of sampled shingles rule a pair out
_SKETCH = "doc_id long, n long, h1 long, h2 long, own boolean, level int, nf int, bits binary, keys array<long>"


def level_of(n: int) -> int:
    """The level at which documents meet whose smaller one has n shingles: 0 up to SMALL, then by size in doubling steps."""
    if n <= SMALL:
        return 0
    for k, (most, _) in enumerate(SEGMENTS):
        if n <= most:
            return k + 1
    return len(SEGMENTS) + int(-(-n // SEGMENTS[-1][0]) - 1).bit_length()


def keys_at(s: np.ndarray, level: int, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a document with the sorted shingle hashes s is found at a level, and the shingles that its bitmap takes.

    Level 0: the least n - ceil(jaccard n) + 1 shingles; of two sets that reach the similarity the
    least common shingle is among those of both. Other levels: sums over the segments that are not empty. From
    the level of over 192 shingles on, the shingles below a fraction of the hash space stand for all, so that
    96 to 192 of the smaller document's remain.
    """
    salt = np.uint64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    if level == 0:
        return mixed(s[: len(s) - int(np.ceil(jaccard * len(s) - 1e-9)) + 1] + np.uint64(1)), s
    shift = max(0, level - len(SEGMENTS))
    count = SEGMENTS[min(level, len(SEGMENTS)) - 1][1]
    if shift:
        s = s[: np.searchsorted(s, np.uint64(1 << (64 - shift)))]
    if not len(s):
        return np.zeros(0, np.uint64), s
    place = (((s << np.uint64(shift)) >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    sums = np.add.reduceat(mixed(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    return mixed(sums + mixed(place[first] + salt))[place[first] < USED], s


def bitmap(s: np.ndarray) -> bytes:
    b = np.zeros(BITS, np.uint8)
    b[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(b).tobytes()


def sketches(docs: DataFrame, jaccard: float, size: int = 5) -> DataFrame:
    """A row per document and level: its set's size and 128-bit hash, and its keys and bitmap at the level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            rows = []
            for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text").to_pylist(), size)):
                n = len(s)
                h1, h2 = (int(mixed(s + np.uint64(c)).sum().astype(np.int64)) if n else 0 for c in (3, 0x632BE59BD9B4E019))
                least = max(1, int(np.ceil(jaccard * n - 1e-9)))
                levels = {level_of(least), level_of(n)} if n else set()
                own = True
                for level in sorted(levels, reverse=True):
                    keys, used = keys_at(s, level, jaccard)
                    rows.append((doc, n, h1, h2, own, level, len(used), bitmap(used), keys.astype(np.int64)))
                    own = False
                if not n:
                    rows.append((doc, 0, 0, 0, True, -1, 0, b"", np.zeros(0, np.int64)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def folded(s: np.ndarray) -> bytes:
    """The low 16 bits of up to NARROW shingle hashes, with repeats; more are kept as they are."""
    return (s & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if len(s) <= NARROW else s.tobytes()


def common_least(held: np.ndarray, v: bytes, n: int) -> int:
    """No fewer than the shingles that two sets share, from the counts of one's low hash bits and the other's folded form: equal hashes stay equal when folded."""
    low, times = np.unique(np.frombuffer(v, np.uint16) if n <= NARROW else (np.frombuffer(v, np.uint64) & np.uint64(0xFFFF)).astype(np.uint16), return_counts=True)
    return int(np.minimum(held[low], times).sum())


def common(held: np.ndarray, v: bytes, n: int) -> int:
    """The shingles that two sets share."""
    other = np.frombuffer(v, np.uint64)
    small, large = (held, other) if len(held) <= n else (other, held)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0


def verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, jaccard: float, folds: bool = False) -> DataFrame:
    """Of stored pairs (a, b) those whose shingle sets reach the similarity; with folds, those whose folded sets may reach it.

    sets is bucketed by doc_id. A set b travels once for each of its pairs, to the part of a's family that it is dealt to; a's
    own set once for each part of FAMILY members, so a family of any size is dealt out. Each part is one pass over its
    rows that holds a's set alone.
    """
    n = pairs.count()
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = lookup_join(pairs, sizes, ["a"], "m", n, ["b"])
    dealt = scratch.stored(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / FAMILY)).cast("int").alias("part")), "dealt", n)
    sets = sets.select("doc_id", "n", F.col("folded" if folds else "shingles").alias("v"))
    own = dealt.select("a", "part").distinct().join(sets, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "n", "v")
    others = dealt.join(sets, F.col("b") == F.col("doc_id")).select("a", "part", "b", "n", "v")
    percent = round(100 * jaccard)

    def prepared(v: bytes, n: int) -> np.ndarray:
        if not folds:
            return np.frombuffer(v, np.uint64)
        low = np.frombuffer(v, np.uint16) if n <= NARROW else (np.frombuffer(v, np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        return np.bincount(low, minlength=1 << 16).astype(np.int32)

    count = common_least if folds else common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = None, []
        for part in slices(batches, "v", 1 << 20):
            keep = []
            for a, k, b, n, v in zip(*(part.column(c).to_pylist() for c in ("a", "part", "b", "n", "v"))):
                if (a, k) != family:
                    family, held = (a, k), []
                if b is None:
                    held.append((prepared(v, n), n))
                    keep.append(False)
                else:
                    found = ((count(h, v, n), m) for h, m in held)
                    keep.append(any(x > 0 and 100 * x >= percent * (n + m - x) for x, m in found))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = own.unionByName(others).repartition(partitions(scratch.spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    # A few files of pairs instead of one per task.
    out = scratch.stored(rows.mapInArrow(run, "a long, b long").repartition(files_for(n)), "links")
    scratch.drop(dealt)
    return out


def cut_at(level: int, jaccard: float) -> float:
    """The similarity below which bitmaps of a level rule a pair out: those of sampled shingles only estimate it."""
    return SAMPLED if level > len(SEGMENTS) else jaccard


def _bounds(column: np.ndarray) -> list[int]:
    return np.flatnonzero(np.append(True, column[1:] != column[:-1])).tolist() + [len(column)]


def _bits(whole: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(whole.column("bits").to_pylist()), np.uint64).reshape(whole.num_rows, -1)


def near_hubs(scratch: Scratch, met: DataFrame, leaves: DataFrame, jaccard: float, total: int) -> DataFrame:
    """Of each document, the pair with the hub that it shares most keys with, if their trees leave it. A key's hub is its smallest id.

    A hub's followers form trees of up to about CHUNK documents; each is traversed with the hub as the other tree's only leaf.
    """
    shares = met.where("doc_id <> first").groupBy("doc_id", "first", "level").agg(F.count(F.lit(1)).alias("c"), F.max("of").alias("of")).where("c * 8 >= of")
    best = shares.groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("first")).alias("f"), "level")).alias("best"))
    best = scratch.stored(best.select("doc_id", (-F.col("best.f")).alias("hub"), "best.level"), "best", total)
    n = best.count()
    sizes = best.groupBy("hub", "level").agg(F.count(F.lit(1)).alias("m"))
    dealt = lookup_join(best, sizes, ["hub", "level"], "m", n, ["doc_id"])
    dealt = scratch.stored(dealt.select("doc_id", "hub", "level", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / CHUNK)).cast("int").alias("part")), "dealt", n)
    leaves = leaves.select("doc_id", F.col("level").alias("at"), "nf", "bits")
    others = dealt.join(leaves, "doc_id").where("level = at").select(F.xxhash64("hub", "level", "part").alias("group"), "hub", "level", "doc_id", "nf", "bits")
    hubs = dealt.select("hub", "level", "part").distinct().join(leaves.withColumnRenamed("doc_id", "hub"), "hub").where("level = at")
    hubs = hubs.select(F.xxhash64("hub", "level", "part").alias("group"), "hub", "level", F.col("hub").alias("doc_id"), "nf", "bits")

    def search(whole: pa.Table) -> pa.RecordBatch | None:
        bits, hub, ids, level, nf = _bits(whole), *(whole.column(c).to_numpy() for c in ("hub", "doc_id", "level", "nf"))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = _bounds(whole.column("group").to_numpy())
        for a, b in zip(bounds, bounds[1:]):
            own = hub[a:b] == ids[a:b]
            at = a + np.flatnonzero(~own)
            tree = SignatureTree(bits[at], nf[at].astype(np.int64), ids[at])
            for k in (a + np.flatnonzero(own)).tolist():
                near = at[tree.like(bits[k], int(nf[k]), cut_at(level[a], jaccard))]
                found.append((hub[near], ids[near]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"]) if found else None

    rows = grouped(others.unionByName(hubs), ["group"], search, "a long, b long")
    out = scratch.stored(rows.distinct(), "hubs", n)
    scratch.drop(best, dealt)
    return out


def open_keys(scratch: Scratch, met: DataFrame, known: DataFrame, leaves: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents of every key that more than one known component shares, dealt into groups: pairs of parts of about CHUNK of a key's documents; and the stored table below, to be dropped."""
    total = met.count()
    here = met.select("key", "doc_id", "level").join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    here = scratch.stored(here.select("key", "doc_id", "level", F.coalesce("component", "doc_id").alias("comp")), "here")
    open_ = here.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("m")).where("least <> most")
    open_ = open_.select("key", "m", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    left = lookup_join(here, open_, ["key"], "m", total, ["doc_id"]).where("chunks IS NOT NULL")
    left = left.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.col("chunks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = left.withColumn("group", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))).select("group", "key", "doc_id", "level", "comp")
    out = scratch.stored(left, "open")
    scratch.drop(here)
    return out.join(leaves.select("doc_id", F.col("level").alias("at"), "nf", "bits", *columns), "doc_id").where("level = at").drop("at"), out


def nearest_of_keys(scratch: Scratch, met: DataFrame, known: DataFrame, leaves: DataFrame, jaccard: float, total: int) -> DataFrame | None:
    """Of each document under an open key, the pair with that document of another component whose bitmap is most like its own, of those that the keys' trees leave. As many pairs as documents at most. None if no key is open."""
    rows, open_ = open_keys(scratch, met, known, leaves, [])
    if not open_.take(1):
        scratch.drop(open_)
        return None

    def search(whole: pa.Table) -> pa.RecordBatch | None:
        bits, ids, level, comp, nf = _bits(whole), *(whole.column(c).to_numpy() for c in ("doc_id", "level", "comp", "nf"))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(bounds := _bounds(whole.column("group").to_numpy()), bounds[1:]):
            n = nf[a:b].astype(np.int64)
            i, j, overlap = SignatureTree(bits[a:b], n, comp[a:b]).near(cut_at(level[a], jaccard))
            if not len(i):
                continue
            like = overlap / (n[i] + n[j] - overlap)
            own, other, like = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([like, like])
            best, order = np.full(b - a, -1), np.lexsort((other, like))
            best[own[order]] = order
            best = best[best >= 0]
            found.append((ids[a + own[best]], ids[a + other[best]], like[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["doc_id", "other", "like"]) if found else None

    near = grouped(rows, ["group"], search, "doc_id long, other long, like double", order=["doc_id"])
    best = near.groupBy("doc_id").agg(F.max(F.struct("like", "other"))["other"].alias("other"))
    out = scratch.stored(best.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct(), "nearest", total)
    scratch.drop(open_)
    return out


def rest_of_keys(scratch: Scratch, met: DataFrame, known: DataFrame, leaves: DataFrame, jaccard: float) -> DataFrame:
    """All pairs of documents of different known components that the trees of open keys leave, once each: of all keys that two documents share at a level, the least one returns them."""
    rows, open_ = open_keys(scratch, met, known, leaves, ["keys"])

    def search(whole: pa.Table) -> pa.RecordBatch | None:
        key, keys = whole.column("key").to_numpy(), whole.column("keys").combine_chunks()
        values, edges, sets = keys.values.to_numpy(), keys.offsets.to_numpy(), {}

        def own(k: int) -> frozenset[int]:
            if k not in sets:
                sets[k] = frozenset(values[edges[k] : edges[k + 1]].tolist())
            return sets[k]

        bits, ids, level, comp, nf = _bits(whole), *(whole.column(c).to_numpy() for c in ("doc_id", "level", "comp", "nf"))
        a_, b_ = [], []
        for a, b in zip(bounds := _bounds(whole.column("group").to_numpy()), bounds[1:]):
            if b - a < 2:
                continue
            i, j = SignatureTree(bits[a:b], nf[a:b].astype(np.int64), comp[a:b]).pairs(cut_at(level[a], jaccard))
            least = np.fromiter((min(own(p) & own(q)) == key[a] for p, q in zip((a + i).tolist(), (a + j).tolist())), bool, len(i))
            if least.any():
                a_.append(ids[a + i[least]])
                b_.append(ids[a + j[least]])
        if not a_:
            return None
        x, y = np.concatenate(a_), np.concatenate(b_)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    out = scratch.stored(grouped(rows, ["group"], search, "a long, b long", order=["doc_id"]).distinct(), "candidates")
    scratch.drop(open_)
    return out


def merged(scratch: Scratch, known: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """node, component of known, for `total` nodes at most, joined by more links; known and links go."""
    n = links.count()
    if not n:
        scratch.drop(links)
        return known
    of = known.select(F.col("node").alias("id"), "component")
    more = links.join(of.withColumnRenamed("component", "ca"), F.col("a") == F.col("id"), "left").drop("id").join(of.withColumnRenamed("component", "cb"), F.col("b") == F.col("id"), "left")
    joined = components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch=scratch, rows=n)
    sizes = known.groupBy(F.col("component").alias("mid")).agg(F.count(F.lit(1)).alias("m"))
    step = joined.select(F.col("node").alias("mid"), F.col("component").alias("to")).join(sizes, "mid")
    moved = lookup_join(known.withColumnRenamed("component", "mid"), step, ["mid"], "m", known.count(), ["node"])
    fresh = joined.join(known.select("node"), "node", "left_anti").select("node", "component")
    out = scratch.stored(moved.select("node", F.coalesce("to", "mid").alias("component")).unionByName(fresh), "known", total)
    scratch.drop(known, links, joined)
    return out


def similar_groups(docs: DataFrame, jaccard: float = 0.75, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest id that it reaches by links of the given similarity.

    Documents with equal sets are folded into their smallest id first, so copies make no pairs. The others meet by keys, and
    signature trees decide which of them are compared. At first each document's tree meets only the hub that it shares most keys
    with, which joins most of a large group by as many pairs as it has documents. Then the trees of every key whose documents
    are not in one component yet are traversed in pairs: NEAREST times for each document's nearest one of another component, which
    joins what the hubs left by as few pairs, and at last for all pairs of different components that are left. All
    links come from these traversals, and each is verified on the whole sets.

    What is lost: up to 24 shingles nothing can be. Above, a pair at the threshold shares no key with a chance of
    under 10^-10 up to 192 shingles and of 6 * 10^-9 at most over them (15 segments or more agree on average). Over 192
    shingles the trees also leave a pair if its bitmaps of sampled shingles show under 0.55, with a chance of up to
    5 * 10^-6 (two equally large sets, 96 sampled shingles in each). Both are computed for sampled shingles that
    fall independently, as they do for small fractions. Shingles are 64-bit hashes.

    Null texts count as empty and, like texts without words, link with nothing. Very long texts are read whole, by one task each.
    Rows that repeat an id count as one document with several texts. A null id takes part; its component is null unless
    it has another's text. Other columns are not read. Only the tables that the result reads stay in the shared folder.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    count = partitions(scratch.spark)
    marks = scratch.stored(sketches(docs, jaccard, size), "sketches")
    own = scratch.stored(marks.where("own").select("doc_id", "n", "h1", "h2"), "own")
    total = own.count()
    sets = scratch.stored(own.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets", total)
    reps = marks.join(sets.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    leaves = scratch.bucketed(reps.select("doc_id", "level", "nf", "bits", "keys").repartition(count, "doc_id"), "leaves", "doc_id")
    scratch.drop(marks)

    # A set without a partner needs no keys kept: of each key only those that two sets share go on.
    entries = leaves.select("doc_id", "level", F.size("keys").alias("of"), F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("m"))
    shared = scratch.stored(shared.where("first <> last").drop("last"), "keys")
    n_entries = leaves.agg(F.sum(F.size("keys"))).first()[0] or 0
    met = scratch.stored(lookup_join(entries, shared, ["key"], "m", n_entries, ["doc_id"]).where("first IS NOT NULL").drop("m"), "met")
    scratch.drop(shared)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = shingle_sets(part.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([folded(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "n", "folded", "shingles"])

    # The texts are dealt out once more, only for documents that share a key; from here on their sets stay where they are.
    wanted = docs.join(met.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").repartition(count, "doc_id")
    found = scratch.bucketed(wanted.mapInArrow(shingled, "doc_id long, n long, folded binary, shingles binary"), "shingles", "doc_id")

    pairs = near_hubs(scratch, met, leaves, jaccard, total)
    links = verified(scratch, pairs, found, jaccard)
    known = components(links, scratch=scratch, rows=links.count())
    scratch.drop(pairs, links)
    for _ in range(NEAREST):
        near = nearest_of_keys(scratch, met, known, leaves, jaccard, total)
        if near is None:
            break
        known = merged(scratch, known, verified(scratch, near, found, jaccard), total)
        scratch.drop(near)
    else:
        rest = rest_of_keys(scratch, met, known, leaves, jaccard)
        likely = verified(scratch, rest, found, jaccard, folds=True)
        known = merged(scratch, known, verified(scratch, likely, found, jaccard), total)
        scratch.drop(rest, likely)
    scratch.drop(met, leaves, found)

    named = sets.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    result = scratch.stored(named.select("h1", "h2", "n", "copies", F.coalesce("component", "rep").alias("component_id")), "named", total)
    scratch.drop(known, sets)
    out = lookup_join(own, result, ["h1", "h2", "n"], "copies", total, ["doc_id"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, as similar_groups gives them."""
    return similar_groups(table(spark, sf_dir, "documents"))
