"""Token ids in files of fixed-width bit-packed blocks.

File format: the 8 bytes RWTOKEN1; then the blocks; then the footer, four little-endian
unsigned 64-bit arrays (document ids as signed, ids before each document, block offsets in bytes and
a CRC-32 per block); then 48 bytes: six unsigned 64-bit numbers, namely bits per id, ids per block,
ids, documents, blocks and the footer's offset; then the magic again. A block holds `block` ids (the last one
may hold fewer), each in the minimum bits for the vocabulary, least significant bit first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadweave.llm.common import make_folder, shared_path, slices, stored, table, text_of, write_file

MAGIC = b"RWTOKEN1"


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`, one at least."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    grid = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=count * bits)
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def file_parts(docs: Iterable[tuple[int | None, bytes]], vocabulary: int, block: int = 8192) -> Iterator[bytes]:
    """The bytes of a file for (doc_id, ids as little-endian unsigned 32-bit integers) pairs; one block is held at a time."""
    bits, held, kept = width(vocabulary), [], 0
    names, starts, offsets, sums, total, at = [], [], [], [], 0, len(MAGIC)
    yield MAGIC

    def flushed(least: int) -> Iterator[bytes]:
        nonlocal held, kept, at
        if kept < least or not kept:
            return
        ids = np.concatenate(held)
        cut = 0
        while len(ids) - cut >= least and cut < len(ids):
            part = ids[cut : cut + block]
            if int(part.max()) >= vocabulary:
                raise ValueError("an id is outside of the vocabulary")
            data = pack(part, bits)
            offsets.append(at)
            sums.append(zlib.crc32(data))
            at += len(data)
            cut += len(part)
            yield data
        held, kept = [ids[cut:]], len(ids) - cut

    for doc_id, raw in docs:
        ids = np.frombuffer(raw, dtype="<u4")
        names.append(-(1 << 63) if doc_id is None else doc_id)
        starts.append(total)
        total += len(ids)
        held.append(ids)
        kept += len(ids)
        if kept >= block:
            yield from flushed(block)
    yield from flushed(1)
    yield np.array(names, dtype="<i8").tobytes() + np.array(starts, dtype="<u8").tobytes() + np.array(offsets, dtype="<u8").tobytes() + np.array(sums, dtype="<u8").tobytes()
    yield struct.pack("<6Q", bits, block, total, len(names), len(offsets), at) + MAGIC


class TokenFile:
    """Reads a file's bytes; any document or range of ids is found by its block offsets."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC or bytes(self.data[-8:]) != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.bits, self.block, self.total, n, blocks, at = struct.unpack("<6Q", self.data[-56:-8])
        self.end = at
        self.names = np.frombuffer(self.data, "<i8", n, at)
        self.starts = np.append(np.frombuffer(self.data, "<u8", n, at + 8 * n), self.total).astype(np.int64)
        self.offsets = np.append(np.frombuffer(self.data, "<u8", blocks, at + 16 * n), at).astype(np.int64)
        self.sums = np.frombuffer(self.data, "<u8", blocks, at + 16 * n + 8 * blocks)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; reads only the blocks that hold them and checks their sums."""
        parts = []
        for k in range(start // self.block, -(-stop // self.block)):
            data = self.data[self.offsets[k] : self.offsets[k + 1]]
            if zlib.crc32(data) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
            first = k * self.block
            part = unpack(data, self.bits, min(self.block, self.total - first))
            parts.append(part[max(0, start - first) : stop - first])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_POINT = ".,;:!?#$%&*|+=<>/@^_~()[]{}\"-\\`"

_SMALL = re.compile("[a-zß-öø-ÿ]+")
# How byte-level vocabularies write bytes: those that print stand for themselves, all others are numbered from 256 on.
_SIGNS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


#: The rules of a file under which runs between white space can be encoded apart, in lower case and without the signs at their ends.
NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_runs(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer has just these rules, and only special tokens that are named in <| and |>."""
    rules = json.loads(tokenizer.to_str())
    added = all(t["content"].startswith("<|") for t in rules["added_tokens"])
    return added and rules["normalizer"] == NORMALISED and rules["pre_tokenizer"] == SPLIT and not rules["truncation"] and not rules["padding"]


class Encoder:
    """Encodes with a tokenizers file, each distinct run between ASCII white space once; with whole texts, where the file has other rules than these.

    The file's normaliser and pre-tokeniser treat such runs separately (none of their rules reaches over
    white space), so joining the runs' ids gives the ids of the whole text. They also fold case, and cut
    between a letter and the signs that end a run, so a new run is looked up in lower case (but in texts that might name special tokens)
    and without those signs. Up to twice `most` runs are kept: when a generation is full the one before it goes.
    """

    def __init__(self, path: str, most: int = 150_000) -> None:
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.runs = self.tokenizer.model, by_runs(self.tokenizer)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Runs of the two generations, by their rows in the arrays: where a row's ids start in the pool, and how many they are.
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.pool, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.runs:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        column = pa.array(texts, pa.string())
        named = pc.fill_null(pc.match_substring(column, "<|"), False)
        column = pc.if_else(named, column, pc.ascii_lower(column)) if pc.any(named).as_py() else pc.ascii_lower(column)
        runs = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        words = runs.values.dictionary_encode()
        if len(self.new) > self.most:
            self._turn()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.new.get, distinct, repeat(-1)), np.int64, len(distinct))
        if (rows < 0).any():
            self._learn([distinct[k] for k in np.flatnonzero(rows < 0).tolist()])
            rows = np.fromiter(map(self.new.__getitem__, distinct), np.int64, len(distinct))
        at = rows[words.indices.to_numpy()]
        counts = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        edges = ends[runs.offsets.to_numpy()]
        return [ids[i:j].tobytes() for i, j in zip(edges, edges[1:])]

    def _turn(self) -> None:
        """The newer generation becomes the older one, and the older one's rows go."""
        rows = np.fromiter(self.new.values(), np.int64, len(self.new))
        self.old, self.new = dict(zip(self.new, range(len(rows)))), {}
        self.pool, self.starts, self.lengths = _gathered(self.pool, self.starts, self.lengths, rows)

    def _add(self, words: list[str], found: list[list[int]]) -> None:
        self._put(words, np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.starts)
        self.new.update(zip(words, range(first, first + len(words))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths, self.pool = np.concatenate([self.lengths, lengths]), np.concatenate([self.pool, ids.astype("<u4")])

    def _learn(self, need: list[str]) -> None:
        new, old = self.new, self.old
        fresh, cut = set(), []

        def wanted(w: str) -> None:
            if w in old:
                new[w] = old[w]
            elif w not in new:
                fresh.add(w)

        for w in need:
            core = w.rstrip(_POINT)
            if w in old:
                new[w] = old[w]
            elif core and len(core) < len(w) and _SMALL.fullmatch(core[-1]) and "<|" not in w:
                cut.append((w, core, w[len(core) :]))
                wanted(core)
                wanted(w[len(core) :])
            else:
                fresh.add(w)
        # Small letters of Latin-1 alone pass all rules unchanged as one word, which goes to the model itself.
        plain = [w for w in fresh if _SMALL.fullmatch(w)]
        found = [[t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_SIGNS))] for w in plain]
        self._add(plain, found)
        other = list(fresh.difference(plain))
        for at in range(0, len(other), 4_000):
            part = other[at : at + 4_000]
            self._add(part, [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        if cut:
            # A run that was cut gets the ids of its two parts, one after the other.
            pairs = np.array([(new[core], new[signs]) for _, core, signs in cut], np.int64)
            ids, _, lengths = _gathered(self.pool, self.starts, self.lengths, pairs.ravel())
            self._put([w for w, _, _ in cut], ids, lengths.reshape(-1, 2).sum(1))


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the given rows, one after the other, with their starts and lengths."""
    counts = lengths[rows]
    before = np.cumsum(counts) - counts
    return pool[np.repeat(starts[rows] - before, counts) + np.arange(int(counts.sum()))], before, counts


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder per Python worker, which keeps its runs from task to task."""
    return Encoder(path)


_FILES = "shard int, piece int, documents long, ids long, bytes long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, block: int = 8192, doc_id: str = "doc_id", text: str = "text", roll: int = 64 << 20) -> DataFrame:
    """Writes docs as token files in ascending order of id; returns shard, piece, documents, ids and bytes per file.

    Rows are range-partitioned by id. A partition is one shard, whose next piece begins where the one before has `roll` bytes
    of ids; files are named by shard and piece, so in the order of their names they hold the ids in order. A document
    is never split, so one longer than that makes a longer file. A null text counts as empty; a null id
    comes first; rows that repeat an id follow one another. A retried task writes the same bytes under
    the same names. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        bits = width(encoder.vocabulary)

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for part in slices(batches, "text", 8 << 20):
                for i, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    yield i, raw + end

        rows, done = encoded(), []
        head = next(rows, None)
        while head is not None:
            counts = [0, 0]

            def own() -> Iterator[tuple[int | None, bytes]]:
                nonlocal head
                while head is not None and counts[1] * bits // 8 < roll:
                    counts[0] += 1
                    counts[1] += len(head[1]) // 4
                    yield head
                    head = next(rows, None)

            size = write_file(f"{path}/part-{shard:06d}-{len(done):05d}.tok", file_parts(own(), encoder.vocabulary, block))
            done.append((shard, len(done), *counts, size))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*done)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _FILES.split(", ")])

    path = make_folder(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(write, _FILES)


def read_token_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    files has a row per file with its count of ids, as write_token_files returns them; their running sum, by shard and
    then over shards, gives each file's first position. A file, of about the size at which they roll, is read whole by one task.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                f = TokenFile(data)
                sums = np.zeros(len(f.names), np.int64)
                for lo in range(0, len(f.names), 512):
                    hi = min(lo + 512, len(f.names))
                    ids, base = f.ids(int(f.starts[lo]), int(f.starts[hi])).astype("<u4"), int(f.starts[lo])
                    for k in range(lo, hi):
                        sums[k] = zlib.crc32(ids[f.starts[k] - base : f.starts[k + 1] - base].tobytes())
                yield pd.DataFrame({"shard": int(name[-16:-10]), "piece": int(name[-9:-4]), "doc_id": pd.Series(f.names, dtype="int64"), "start": f.starts[:-1], "n_tokens": np.diff(f.starts), "ids_crc32": sums})

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "content")
    docs = content.mapInPandas(read, "shard int, piece int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("ids").alias("ids"))
    # Shards are ordered in groups of 4096 first, then the few groups.
    groups = shards.withColumn("wide", F.floor(F.col("shard") / 4096)).groupBy("wide").agg(F.sum("ids").alias("ids"))
    first = groups.select("wide", F.coalesce(F.sum("ids").over(before.orderBy("wide")), F.lit(0)).alias("of_groups"))
    shards = shards.withColumn("wide", F.floor(F.col("shard") / 4096))
    shards = shards.withColumn("of_shards", F.coalesce(F.sum("ids").over(before.partitionBy("wide").orderBy("shard")), F.lit(0))).join(first, "wide")
    base = files.withColumn("of_pieces", F.coalesce(F.sum("ids").over(before.partitionBy("shard").orderBy("piece")), F.lit(0)))
    base = base.join(shards, "shard").select("shard", "piece", (F.col("of_groups") + F.col("of_shards") + F.col("of_pieces")).alias("base"))
    return docs.join(base, ["shard", "piece"]).select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files that hold all documents' ids."""
    import public_tokenizers

    path = shared_path(spark, "tokens")
    written = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path, stored(written, "token-files"))
