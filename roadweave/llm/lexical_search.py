"""Ranked lexical search: document shards of CSR postings with integer impacts, searched a term at a time."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, slices, small_table, table
from roadweave.llm.terms import blocks_of, hashed_items, terms_of

SHARD = "ids binary, known binary, terms binary, offsets binary, places binary, impacts binary"
BLOCK = 1 << 18  # terms of the queries that are searched at once


def shard_of(ids: list[int | None], texts: list[str | None], n_docs: int, n_terms: int) -> list[bytes]:
    """One shard's columns: its terms in order, each with the places of its documents and their impacts.

    The impact of tf occurrences in a document of n terms is (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; it is under 10^6.
    """
    hashes, at = terms_of(texts)
    sizes = np.diff(at)
    terms, which = np.unique(hashes, return_inverse=True)
    place = np.repeat(np.arange(len(ids)), sizes)
    pairs, tf = np.unique(which.astype(np.int64) * max(len(ids), 1) + place, return_counts=True)
    term, place = np.divmod(pairs, max(len(ids), 1))
    m = np.array([50 + 50 * int(n) * n_docs // max(n_terms, 1) for n in sizes], np.int64)
    tf = tf.astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
    known = np.array([i is not None for i in ids], bool)
    columns = (np.array([i or 0 for i in ids], np.int64), known, terms, np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int64), place.astype(np.int32), impact.astype(np.int32))
    return [c.tobytes() for c in columns]


def best(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones the smaller ids stay, null ids last. In no order."""
    live = np.flatnonzero(score > 0)
    if len(live) <= k:
        return live
    s = score[live]
    top = np.argpartition(s, len(s) - k)[len(s) - k :]
    cut = s[top].min()
    over, ties = live[s > cut], live[s == cut]
    order = np.lexsort((ids[ties], ~known[ties]))
    return np.concatenate([over, ties[order[: k - len(over)]]])


def placed(own: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the terms is among a shard's own, and whether it is there."""
    at = np.searchsorted(own, terms)
    there = at < len(own)
    there[there] = own[at[there]] == terms[there]
    return at, there


class LexicalIndex:
    """An index of all terms of documents (doc_id, text) in the shared folder.

    A shard holds the documents of about 4 MB of text, so the index grows by shards. A null text has no terms; rows that repeat an id are documents of
    their own, and null ids rank last among equal scores. Terms are told apart by 64-bit hashes.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

        def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = total = 0
            for part in slices(batches, "text"):
                sizes = np.diff(terms_of(part.column("text").to_pylist())[1])
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

        row = docs.select("text").mapInArrow(counted, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
        self.n_docs, self.n_terms = n_docs, n_terms = row[0] or 0, row[1] or 0

        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                values = shard_of(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), n_docs, n_terms)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=[c.split()[0] for c in SHARD.split(", ")])

        self.shards = self.scratch.stored(docs.mapInArrow(packed, SHARD), "postings")

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """The documents that hold each of the given sorted terms."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(terms), np.int64)
            for batch in batches:
                for own, offsets in zip(batch.column("terms"), batch.column("offsets")):
                    own, offsets = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(offsets.as_buffer(), np.int64)
                    at, there = placed(own, terms)
                    total[there] += np.diff(offsets)[at[there]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

        out = np.zeros(len(terms), np.int64)
        for r in self.shards.select("terms", "offsets").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            out[r["term"]] = r["df"]
        return out

    def search(self, items: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
        """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by ascending doc_id.

        Every row of items is a query of its own; null text or no term finds nothing. Queries are taken in blocks of about `block` distinct terms, and
        only a block is sent to the executors at once. A task keeps each query's k best of its shards; a rank by query merges the tasks'.
        """
        parts, first = [], 0
        for queries in blocks_of(hashed_items(items, distinct=True), block):
            parts.append((first, queries))
            if first or sum(len(h) for _, h in queries) >= block:  # there may be more: keep no block on the driver
                parts[-1] = self.scratch.stored(self._found(first, queries, k), "found")
            first += len(queries)
        parts = [p if isinstance(p, DataFrame) else self._found(*p, k) for p in parts]
        kind = items.schema["item_id"].dataType.simpleString()
        if not parts:
            return small_table(self.spark, [[], [], [], []], "item string, rank int, doc_id long, score long").select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        out = reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)
        return out.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")

    def _found(self, first: int, queries: list[tuple[str | None, np.ndarray]], k: int) -> DataFrame:
        terms = np.unique(np.concatenate([h for _, h in queries]))
        df = self.frequencies(terms)
        weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
        wanted = [(item, at[weight[at] > 0]) for item, at in ((item, np.searchsorted(terms, h)) for item, h in queries)]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(wanted)
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, known, own, offsets, places, impacts = (np.frombuffer(batch.column(j)[row].as_buffer(), t) for j, t in enumerate((np.int64, bool, np.uint64, np.int64, np.int32, np.int32)))
                    at, there = placed(own, terms)
                    for q, (_, mine) in enumerate(wanted):
                        mine = mine[there[mine]]
                        if not len(mine):
                            continue
                        score = np.zeros(len(ids), np.int64)
                        for t in mine.tolist():
                            a, b = offsets[at[t]], offsets[at[t] + 1]
                            score[places[a:b]] += weight[t] * impacts[a:b]
                        top = best(score, ids, known, k)
                        s, i, n = (np.concatenate(x) for x in zip(kept[q], (score[top], ids[top], known[top])))
                        top = best(s, i, n, k)
                        kept[q] = s[top], i[top], n[top]
            for q, (s, i, n) in enumerate(kept):
                if len(s):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), first + q, np.int64)), pa.array([wanted[q][0]] * len(s), pa.string()), pa.array(i, mask=~n), pa.array(s)],
                        names=["query", "item", "doc_id", "score"],
                    )

        return self.shards.mapInArrow(run, "query long, item string, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score of the 50 best documents for each benchmark item; nulls, ties and repeats as in LexicalIndex."""
    return LexicalIndex(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH terms AS (
  SELECT d.rowid AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents) d),
tf AS (SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY d, term),
size AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
query AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
scored AS (
  SELECT q, any_value(item_id) AS item_id, d, any_value(doc_id) AS doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM query JOIN df USING (term) JOIN tf USING (term) JOIN size USING (d) CROSS JOIN total GROUP BY q, d)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
