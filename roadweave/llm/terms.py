"""Hashed terms of whole texts: runs of ASCII letters, digits and characters beyond ASCII, with A-Z folded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import slices
from roadweave.llm.shingles import word_hashes

GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every term of all texts in order, and the bounds of each text among them. Null has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(raw), GAP)
    return hashes, np.searchsorted(places, np.cumsum([0] + [len(r) + 1 for r in raw]))


def hashed_items(items: DataFrame, distinct: bool = False) -> DataFrame:
    """item (item_id as a string), terms (the bytes of its text's term hashes in order; distinct ones, sorted) of every row of items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, at = terms_of(part.column("text").to_pylist())
            each = [hashes[a:b] for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("item"), pa.array([(np.unique(h) if distinct else h).tobytes() for h in each], pa.binary())], names=["item", "terms"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, terms binary")


def blocks_of(hashed: DataFrame, most: int) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """Rows of hashed_items in blocks of about `most` terms; the driver holds one partition and one block at a time."""
    block, size = [], 0
    for r in hashed.toLocalIterator():
        h = np.frombuffer(bytes(r["terms"]), np.uint64)
        if block and size + len(h) > most:
            yield block
            block, size = [], 0
        block.append((r["item"], h))
        size += len(h)
    if block:
        yield block
