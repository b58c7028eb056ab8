"""A Merkle manifest of a dataset: a tree by group over range-sorted rows, a tree over the groups' roots, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, partitions, shared_root, table

CHUNK = 12  # levels of the leaves that travel together as one row
ROWS = 1 << 18  # rows about of a range
MOST = 1 << 13  # nodes of one group that one task combines, 64 at least
NONE = b"0" * 65  # the step of a node that stands alone in its run
STEP = 65  # bytes of a step: L or R, the sibling's side, and its digest


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def levels_of(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the `height` levels above them; two neighbours, or a last one alone, become their digest."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest(b"".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def step(nodes: list[bytes], i: int) -> bytes:
    j = i ^ 1
    return NONE if j >= len(nodes) else (b"L" if j < i else b"R") + nodes[j]


def height_of(leaves: int) -> int:
    return (leaves - 1).bit_length()


def whole_subtrees(a: int, b: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """(level, index, first leaf, end) of the largest complete aligned subtrees over leaves a to b of a tree of `total`; the tree's last node counts as complete."""
    while a < b:
        level = height_of(total) if a == 0 else min((a & -a).bit_length() - 1, height_of(total))
        while min(a + (1 << level), total) > b:
            level -= 1
        end = min(a + (1 << level), total)
        yield level, a >> level, a, end
        a = end


def combine(nodes: list[tuple[int, int, bytes]], height: int, total: int) -> tuple[bytes, list[bytes]]:
    """The digest of the node at level `height` over these nodes (level, index, digest), which tile it, and each one's steps up to it."""
    paths, at = [b""] * len(nodes), min(n[0] for n in nodes)
    here: dict[int, tuple[bytes, list[int]]] = {}
    while True:
        here |= {i: (d, [k]) for k, (level, i, d) in enumerate(nodes) if level == at}
        if at == height:
            ((d, _),) = here.values()
            return d, paths
        above: dict[int, tuple[bytes, list[int]]] = {}
        for i in sorted(here):
            d, members = here[i]
            other = here.get(i ^ 1)
            if other is None and i % 2 == 0 and (i + 1) << at < total or other is None and i % 2:
                raise ValueError("a subtree is missing")
            for k in members:
                paths[k] += NONE if other is None else (b"R" if i % 2 == 0 else b"L") + other[0]
            if i % 2 == 0:
                above[i >> 1] = (digest(d + (other[0] if other else b"")), members + (other[1] if other else []))
        here, at = above, at + 1


class MerkleTrees:
    """One tree for each value of `group` over rows in order of `order`, then of their leaves.

    rows: group (a string without null), leaf (64 hexadecimal digits), and other columns, which come back with the proofs. Rows are sorted by range; each
    range builds the complete aligned subtrees that it holds, and only the roots of these, twice the tree's height for a range at most, are shuffled by
    coordinate and combined above. A group may hold all rows. Rows equal in all columns have places in either order.
    """

    def __init__(self, rows: DataFrame, order: list[str], scratch: Scratch, ranges: int | None = None, most: int = MOST) -> None:
        self.scratch, self.most = scratch, most
        self.payload = [c for c in rows.columns if c not in ("group", "leaf")]
        leaves = scratch.stored(rows, "leaves")
        n = ranges or max(partitions(rows.sparkSession), -(-leaves.count() // ROWS))
        keys = [F.col("group"), *(F.asc_nulls_first(c) for c in order), F.col("leaf"), F.col("__rw_tie")]
        shared_root(rows.sparkSession)
        self.sorted = leaves.withColumn("__rw_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__rw_tie").checkpoint()
        scratch.drop(leaves)
        self.offsets = self._offsets()

    def _offsets(self) -> dict[int, tuple[int, int, int]]:
        """For each range: the leaves of its first group in earlier ranges, and the sizes of its first and last group. A few numbers a range come to the driver."""

        def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = np.concatenate([np.zeros(0, object), *(b.column("group").to_numpy(zero_copy_only=False) for b in batches)])
            if len(groups):
                cut = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
                size = np.diff(cut, prepend=0)
                yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": groups[0], "n": int(size[0]), "last": groups[-1], "m": int(size[-1])}])

        found = sorted(self.sorted.select("group").mapInArrow(ends, "part long, first string, n long, last string, m long").collect())
        before: list[int] = []
        held: dict[str, int] = {}
        for r in found:
            before.append(held.get(r["first"], 0))
            held = {r["last"]: (held.get(r["last"], 0) if r["first"] == r["last"] else 0) + r["m"]}
        out: dict[int, tuple[int, int, int]] = {}
        after: dict[str, int] = {}
        for r, a in zip(reversed(found), reversed(before)):
            last = after.get(r["last"], 0) + r["m"] + (a if r["first"] == r["last"] else 0)
            out[r["part"]] = (a, last if r["first"] == r["last"] else a + r["n"], last)
            after = {r["first"]: (after.get(r["first"], 0) if r["first"] == r["last"] else 0) + r["n"]}
        return out

    def subtrees(self) -> DataFrame:
        """group, total, top, level, index, digest of the subtrees that the ranges have built; top is the level of the group's root."""
        offsets = self.offsets

        def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(g, n, height_of(n), level, index, levels[-1][0].decode()) for g, n, level, index, _, _, levels in _subtrees(batches, offsets)]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["group", "total", "top", "level", "index", "digest"])

        return self.sorted.mapInArrow(tiles, "group string, total long, top int, level int, index long, digest string")

    def paths(self) -> DataFrame:
        """group, level, index, path (steps up to the group's root), subroot of every subtree that the ranges have built; stored."""
        tiles = self.subtrees().withColumn("path", F.lit("").cast("binary")).withColumn("to_level", F.col("level")).withColumn("to_index", F.col("index"))
        tiles = self.scratch.stored(tiles, "subtrees")
        while True:
            # Nodes of a group that are more than one task's meet in blocks of its tree first; then all that are left meet at its root.
            nodes = tiles.select("group", "total", "top", F.col("to_level").alias("level"), F.col("to_index").alias("index"), "digest").distinct().where("level < top")
            sizes = self.scratch.stored(nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "sizes")
            large = sizes.where(F.col("n") > self.most).take(1)
            down = F.when(F.col("n") > self.most, F.ceil(F.log2(F.col("n") * 4.0 / self.most))).otherwise(0)
            met = nodes.join(sizes, "group").withColumn("height", (F.col("top") - down).cast("int")).where("level < height")
            made = met.groupBy("group", "height", F.expr("shiftright(index, height - level)").alias("block")).applyInPandas(_combined, "group string, level int, index long, height int, block long, made string, steps binary")
            made = made.select("group", F.col("level").alias("to_level"), F.col("index").alias("to_index"), "height", "block", "made", "steps")
            joined = tiles.join(made, ["group", "to_level", "to_index"], "left")
            after = self.scratch.stored(
                joined.select(
                    "group", "total", "level", "index", "top", F.coalesce("made", "digest").alias("digest"),
                    F.concat("path", F.coalesce("steps", F.lit("").cast("binary"))).alias("path"),
                    F.coalesce("height", "to_level").alias("to_level"), F.coalesce("block", "to_index").alias("to_index"),
                ),
                "subtrees",
            )
            self.scratch.drop(tiles, sizes)
            tiles = after
            if not large:
                return tiles.select("group", "level", "index", "path", F.col("digest").alias("subroot"))

    def chunks(self) -> DataFrame:
        """group, level, index of the subtree, first (the place of its first leaf), path (steps within the subtree) and rows of up to 2^CHUNK leaves each."""
        offsets = self.offsets

        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, _, level, index, start, part, levels in _subtrees(batches, offsets):
                c = min(level, CHUNK)
                for k in range(-(-part.num_rows >> c)):
                    sink = pa.BufferOutputStream()
                    rows = part.slice(k << c, 1 << c).combine_chunks()
                    with pa.ipc.new_stream(sink, rows.schema) as out:
                        out.write_table(rows)
                    path = b"".join(step(levels[at], k >> (at - c)) for at in range(c, level))
                    values = ([g], [level], [index], [start + (k << c)], [path], [sink.getvalue().to_pybytes()])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["group", "level", "index", "first", "within", "rows"])

        return self.sorted.mapInArrow(packed, "group string, level int, index long, first long, within binary, rows binary")

    def proofs(self, paths: DataFrame) -> DataFrame:
        """All columns of rows, position (in its group), proof (by level: the sibling, null where there is none, and whether it is on the left), and what paths has.

        paths: group, level, index, path of each subtree as paths() has them, perhaps with further steps, and other columns.
        """
        more = [c for c in paths.columns if c not in ("group", "level", "index", "path")]
        kinds = dict(self.sorted.dtypes)
        names = ["group", *self.payload, "leaf"]
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["position long", "proof array<struct<left: boolean, sibling: string>>"] + [f"`{c}` string" for c in more])

        def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = pa.ipc.open_stream(r["rows"]).read_all().combine_chunks()
                    n, c, rest = rows.num_rows, min(r["level"], CHUNK), r["within"] + r["path"]
                    levels = levels_of([x.encode() for x in rows.column("leaf").to_pylist()], c)
                    steps = np.frombuffer(b"".join(step(levels[at], i >> at) if at < c else rest for i in range(n) for at in range(c + 1)), np.uint8).reshape(-1, STEP)
                    per, ends = steps.shape[0] // n, np.arange(steps.shape[0] + 1, dtype=np.int32) * (STEP - 1)
                    alone = steps[:, 0] == ord("0")
                    text = pa.StringArray.from_buffers(len(steps), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(steps[:, 1:])), pa.py_buffer(np.packbits(~alone, bitorder="little")))
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * per), pa.StructArray.from_arrays([pa.array(steps[:, 0] == ord("L")), text], ["left", "sibling"]))
                    plain = [x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (rows.column(k) for k in names)]
                    yield pa.RecordBatch.from_arrays([*plain, pa.array(r["first"] + np.arange(n)), proof, *(pa.array([r[k]] * n, pa.string()) for k in more)], names=[*names, "position", "proof", *more])

        return self.chunks().join(paths, ["group", "level", "index"]).mapInArrow(unpacked, schema)


def _subtrees(batches: Iterable[pa.RecordBatch], offsets: dict[int, tuple[int, int, int]]) -> Iterator[tuple[str, int, int, int, int, pa.Table, list[list[bytes]]]]:
    """group, total, level, index, first leaf, rows and levels of each whole subtree of this task's range."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    whole = pa.Table.from_batches(batches)
    groups = whole.column("group").to_numpy()
    cut = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
    offset, first, last = offsets[TaskContext.get().partitionId()]
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        at = offset if k == 0 else 0
        total = first if k == 0 else last if b == len(groups) else b - a
        for level, index, start, end in whole_subtrees(at, at + b - a, total):
            part = whole.slice(a + start - at, end - start)
            yield groups[a], total, level, index, start, part, levels_of([x.encode() for x in part.column("leaf").to_pylist()], level)


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    height, total = int(rows["height"].iloc[0]), int(rows["total"].iloc[0])
    nodes = [(int(level), int(i), d.encode()) for level, i, d in zip(rows["level"], rows["index"], rows["digest"])]
    made, steps = combine(nodes, height, total)
    block = [n[1] >> (height - n[0]) for n in nodes]
    return pd.DataFrame({"group": rows["group"], "level": rows["level"], "index": rows["index"], "height": height, "block": block, "made": made.decode(), "steps": steps})


def leaf_of(*values: Column) -> Column:
    """The digest of a row: each value's count of UTF-8 bytes, a colon and the value, or - for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    pair = lambda at, s: F.when(s["sibling"].isNull(), at).when(s["left"], F.concat(s["sibling"], at)).otherwise(F.concat(at, s["sibling"]))
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(pair(at, s).cast("binary"), 256))


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, ranges: int | None = None, most: int = MOST) -> DataFrame:
    """order, group, carry, leaf, position, subroot, root and proof of every row of docs.

    A row's leaf is leaf_of its fields; each group's rows ascend by order, null first, then by leaf; the groups' roots ascend by group, null first, UTF-8
    bytewise, and make the root. A proof goes from the leaf through its group's root to the root. Rows that repeat have a place each. A table without rows
    has none. Columns beside these are not read, so their names cannot clash. carry: strings that come back with each row.
    """
    carry = carry or {}
    scratch = Scratch(docs.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    extra = [v.cast("string").alias(f"carry_{k}") for k, v in carry.items()]
    trees = MerkleTrees(docs.select(name.alias("group"), F.col(order).alias("key"), leaf_of(*(F.col(f) for f in fields)).alias("leaf"), *extra), ["key"], scratch, ranges, most)
    paths = trees.paths()
    subroots = paths.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("subroot").alias("leaf")).distinct()
    above = MerkleTrees(subroots, ["key"], scratch, ranges, most)
    top = above.proofs(above.paths().withColumnRenamed("subroot", "root"))
    side = F.transform("proof", lambda s: F.when(s["sibling"].isNull(), NONE.decode()).otherwise(F.concat(F.when(s["left"], "L").otherwise("R"), s["sibling"])))
    top = scratch.stored(top.select(F.col("key").alias("group"), F.array_join(side, "").cast("binary").alias("above"), "root"), "roots")
    full = scratch.stored(paths.join(top, "group").select("group", "level", "index", F.concat("path", "above").alias("path"), "subroot", "root"), "paths")
    out = trees.proofs(full)
    named = F.when(F.col("group") != "-", F.expr("substring(group, 2)")).cast(docs.schema[group].dataType)
    return out.select(F.col("key").alias(order), named.alias(group), *(F.col(f"carry_{k}").alias(k) for k in carry), "leaf", "position", "subroot", "root", "proof")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; nulls, ties and repeats as in manifest."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = leaf_of(*(F.try_add(F.col("n_chars"), F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS))
    out = manifest(docs, FIELDS, carry={"tampered": F.when(hit, changed)})
    siblings = F.concat_ws("", F.transform("proof", lambda s: s["sibling"]))
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)))"""
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, sha256({_LEAF}) AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
  SELECT grp, 0 AS lev, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY grp
  UNION ALL
  SELECT grp, lev + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT grp, nodes[1] AS subroot, lev AS top FROM tree WHERE len(nodes) = 1),
high AS (
  SELECT 0 AS lev, list(subroot ORDER BY encode(grp)) AS nodes FROM subroots
  UNION ALL
  SELECT lev + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM high WHERE len(nodes) > 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM subroots),
steps AS (
  SELECT p.grp, p.pos, t.lev, nodes[xor(p.pos >> t.lev, 1) + 1] AS sibling, (p.pos >> t.lev) & 1 = 1 AS on_left FROM placed p JOIN tree t USING (grp) WHERE len(nodes) > 1
  UNION ALL
  SELECT p.grp, p.pos, r.top + h.lev, nodes[xor(r.place >> h.lev, 1) + 1], (r.place >> h.lev) & 1 = 1 FROM placed p JOIN ranked r USING (grp) CROSS JOIN high h WHERE len(h.nodes) > 1),
proofs AS (SELECT grp, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY lev), '')) AS proof_sha256, max(lev) AS last FROM steps GROUP BY grp, pos),
fold AS (
  SELECT grp, pos, 0::BIGINT AS lev, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL
  SELECT f.grp, f.pos, f.lev + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN on_left THEN sibling || h ELSE h || sibling END) FROM fold f JOIN steps s ON f.grp = s.grp AND f.pos = s.pos AND f.lev = s.lev),
done AS (SELECT grp, pos, arg_max(h, lev) AS folded_root FROM fold GROUP BY grp, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (grp) JOIN done USING (grp, pos) LEFT JOIN proofs USING (grp, pos) CROSS JOIN (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1)
"""
