"""Benchmark decontamination by suffix arrays over the documents, in which every suffix of every benchmark item is searched."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, lookup_join, slices, table, text_of
from roadweave.llm.shingles import mixed
from roadweave.llm.terms import blocks_of, hashed_items, terms_of

WINDOW = 10  # words of an item that make a match
BLOCK = 1 << 22  # words of the items that are searched at once
SHARD = 1 << 20  # words of a suffix array; a longer document is cut into overlapping ones
PACK = 4  # words compared at once, by 16 bits of each
FOUND = "doc_id long, digest binary, row long, n_words long, spans array<struct<start: int, end: int>>, matches array<struct<item_id: string, words: int, item_word: int, doc_word: int>>"


def coded(hashes: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with a 0 after each text and `pad` more, and four words' codes of 1 to 65535 packed at every place."""
    full = np.zeros(len(hashes) + len(ends) + pad, np.uint64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    full[np.arange(len(hashes)) + owner] = hashes
    code = np.where(full == 0, np.uint64(0), mixed(full) % np.uint64(65535) + np.uint64(1))
    code = np.concatenate([code, np.zeros(PACK, np.uint64)])
    packed = np.zeros(len(full), np.uint64)
    for k in range(PACK):
        packed = (packed << np.uint64(16)) | code[k : k + len(full)]
    return full, packed


def suffix_array(packed: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their next `depth` codes, by prefix doubling of those that still tie."""
    order = places[np.argsort(packed[places], kind="stable")]
    if not len(order):
        return order
    key = packed[order]
    starts = np.append(True, key[1:] != key[:-1])
    group = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    rank = np.full(len(packed) + depth + PACK, -1, np.int64)
    rank[order] = group
    known = PACK
    tied = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    while known < depth and len(tied):
        place = order[tied]
        both = (rank[place] << 32) | (rank[place + known] + 1)
        by = np.argsort(both, kind="stable")
        place, both = place[by], both[by]
        order[tied] = place
        starts = np.append(True, both[1:] != both[:-1])
        rank[place] = tied[np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))]
        tied = tied[~(starts & np.append(starts[1:], True))]
        known *= 2
    return order


def _masks(words: np.ndarray) -> np.ndarray:
    """Of the codes packed at a place, those of the first so many words."""
    left = np.clip(PACK - words, 0, PACK).astype(np.uint64) * np.uint64(16)
    return np.where(left >= 64, np.uint64(0), np.uint64((1 << 64) - 1) << np.minimum(left, np.uint64(63)))


def bounds(packed: np.ndarray, order: np.ndarray, other: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place `at` in other: the range of the suffixes in order that begin with its next `words` codes. Binary searches, all at once."""
    keys = packed[order]
    mask = _masks(words)
    lo = np.searchsorted(keys, other[at] & mask, "left")
    hi = np.searchsorted(keys, (other[at] & mask) | ~mask, "right")
    for edge in ("left", "right"):
        a, b = lo.copy(), hi.copy()
        open_ = np.flatnonzero((a < b) & (words > PACK))
        while len(open_):
            mid = (a[open_] + b[open_]) // 2
            place = order[mid]
            # -1, 0 or 1 as the text at mid is less than, equal to or greater than the words searched.
            sign, same, k = np.zeros(len(open_), np.int8), np.arange(len(open_)), PACK
            while True:
                same = same[words[open_[same]] > k]
                if not len(same):
                    break
                q = open_[same]
                m = _masks(words[q] - k)
                x, y = packed[np.minimum(place[same] + k, len(packed) - 1)] & m, other[at[q] + k] & m
                sign[same] = np.where(x < y, -1, np.where(x > y, 1, 0))
                same, k = same[x == y], k + PACK
            up = sign < 0 if edge == "left" else sign <= 0
            a[open_[up]], b[open_[~up]] = mid[up] + 1, mid[~up]
            open_ = open_[a[open_] < b[open_]]
        if edge == "left":
            first = np.where(words > PACK, a, lo)
        else:
            last = np.where(words > PACK, a, hi)
    return first, last


class Items:
    """A block of benchmark items, ready to be searched: every suffix that still holds a window of its item."""

    def __init__(self, block: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.names = [item or "" for item, _ in block]
        sizes = np.array([len(h) for _, h in block], np.int64)
        ends = np.cumsum(sizes)
        self.longest = int(sizes.max(initial=0))
        self.full, self.packed = coded(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in block)]), ends, self.longest + PACK)
        start = ends - sizes + np.arange(len(sizes))
        wide = np.minimum(sizes, window)
        per = np.where(sizes > 0, sizes - wide + 1, 0)
        self.item = np.repeat(np.arange(len(sizes)), per)
        within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.at, self.words = start[self.item] + within, wide[self.item]
        self.start, self.end = start, start + sizes


class Shard:
    """The suffix array of some texts' hashed words, cut at SHARD words with an overlap of the longest item."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, depth: int) -> None:
        self.sizes = np.diff(at)
        self.full, self.packed = coded(hashes, at[1:], depth + PACK)
        self.first = at[:-1] + np.arange(len(self.sizes))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        words = np.arange(len(hashes)) + self.owner
        self.orders = [suffix_array(self.packed, words[a : a + SHARD + depth], depth) for a in range(0, len(words), SHARD)]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)

    def search(self, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every verified occurrence of a window: the suffix of the items, the place here, and the words of the longest match there, if it begins there, else 0."""
        for order in self.orders:
            lo, hi = bounds(self.packed, order, items.packed, items.at, items.words)
            some = np.flatnonzero(hi > lo)
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum((hi - lo)[some]) >> 20)) + 1):
                n = (hi - lo)[part]
                suffix = np.repeat(part, n)
                place = order[np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for k in range(int(items.words[part].max(initial=0))):
                    same = (self.full[place + k] == items.full[items.at[suffix] + k]) | (items.words[suffix] <= k)
                    suffix, place = suffix[same], place[same]
                longest, q = items.words[suffix].copy(), items.at[suffix]
                before = (place > 0) & (q > items.start[items.item[suffix]])
                before[before] = self.full[place[before] - 1] == items.full[q[before] - 1]
                longest[before] = 0
                grow = np.flatnonzero(~before)
                while len(grow):
                    grow = grow[q[grow] + longest[grow] < items.end[items.item[suffix[grow]]]]
                    grow = grow[self.full[place[grow] + longest[grow]] == items.full[q[grow] + longest[grow]]]
                    longest[grow] += 1
                yield suffix, place, longest

    def found(self, items: Items) -> tuple[list[list[tuple[int, int]]], list[list[tuple[str, int, int, int]]]]:
        """For each text the spans of its words that are hit, and for each item with windows there its longest match."""
        edge = np.zeros(len(self.full) + 1, np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for suffix, place, longest in self.search(items):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + items.words[suffix], -1)
            top = np.flatnonzero(longest)
            doc, item = self.owner[place[top]], items.item[suffix[top]]
            one, two = items.at[suffix[top]] - items.start[item], place[top] - self.first[doc]
            for d, i, n, a, b in zip(doc.tolist(), item.tolist(), longest[top].tolist(), one.tolist(), two.tolist()):
                old = best.get((d, i))
                if old is None or (-n, a, b) < (-old[0], old[1], old[2]):
                    best[d, i] = n, a, b
        spans: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        matches: list[list[tuple[str, int, int, int]]] = [[] for _ in self.sizes]
        hit = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])))
        for a, b in zip(hit[::2].tolist(), hit[1::2].tolist()):
            d = int(self.owner[a])
            spans[d].append((a - int(self.first[d]), b - int(self.first[d])))
        for (d, i), m in sorted(best.items()):
            matches[d].append((items.names[i], *m))
        return spans, matches


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), n_words, spans, matches of every row of docs.

    spans: the runs of words, counted from 0, inside an occurrence of a window of any item; matches: for each item with an occurring window its longest
    verbatim match, and where in the item and in the document it begins (the first, of equal ones). A window is `window` consecutive words of an item, or all
    words of a shorter one. Null texts have no words. Rows that repeat an item_id are one item; null ids are one item, named by an empty string. Rows of
    docs that repeat have a row each; other columns are not read.

    Each batch of about 4 MB of documents gets a suffix array, ordered by as many words as the longest item has, in which every suffix of the items is searched.
    Items are taken in blocks of about `block` words, and only a block is sent to the executors at once. Words are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    parts = []
    for part in blocks_of(hashed_items(items), block):
        parts.append(_searched(docs, Items(part, window)))
        if len(parts) > 1 or sum(len(h) for _, h in part) >= block:  # there may be more: keep no block on the driver
            parts[-1] = scratch.stored(parts[-1], "matches")
    if not parts:
        return _searched(docs, Items([], window)).drop("row")
    if len(parts) == 1:
        return parts[0].drop("row")
    whole = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return whole.drop("row")


def _searched(docs: DataFrame, items: Items) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int32()), ("item_word", pa.int32()), ("doc_word", pa.int32())]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, at = terms_of(part.column("text").to_pylist())
            shard = Shard(hashes, at, max(items.longest, 1))
            spans, matches = shard.found(items)
            spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
            matches = [[{"item_id": i, "words": n, "item_word": a, "doc_word": b} for i, n, a, b in m] for m in matches]
            values = [*(part.column(k) for k in ("doc_id", "digest", "row")), pa.array(shard.sizes), pa.array(spans, kinds[4]), pa.array(matches, kinds[5])]
            yield pa.RecordBatch.from_arrays([v.cast(k) for v, k in zip(values, kinds)], names=["doc_id", "digest", "row", "n_words", "spans", "matches"])

    return rows.mapInArrow(run, FOUND)


def hit_words(spans: Column) -> Column:
    """The words that spans cover, which may overlap."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(at: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(at["end"], s["start"]), F.lit(0))
        return F.struct(F.greatest(at["end"], s["end"]).alias("end"), (at["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of an item occurs."""
    scratch = Scratch(docs.sparkSession)
    hit = occurrences(docs, items, window).where(F.size("spans") > 0).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    hit = scratch.stored(hit.select(F.col("digest").alias("__rw_digest"), "copies", F.lit(True).alias("__rw_hit")), "hits")
    total = hit.agg(F.sum("copies")).first()[0] or 0
    named = docs.withColumn("__rw_digest", F.unhex(F.sha2(text_of().cast("binary"), 256)))
    marked = lookup_join(named.select(F.struct(*docs.columns).alias("doc"), "__rw_digest"), hit.withColumnRenamed("copies", "__rw_copies"), ["__rw_digest"], "__rw_copies", total, ["doc"])
    return marked.where("__rw_hit IS NULL").select("doc.*")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document; nulls, ties and repeats as in occurrences."""
    found = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    out = found.select("doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), names.alias("names"))
    return out.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT d, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT d, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows))),
found AS (SELECT d, i, p.size, item FROM places p JOIN windows w ON p.win = w.win AND p.size = w.size),
hits AS (SELECT d, count(DISTINCT spot) AS n_hit FROM (SELECT d, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT d, i, size FROM found)) GROUP BY d),
named AS (SELECT d, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY d)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (d) LEFT JOIN named USING (d)
"""
