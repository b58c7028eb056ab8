"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
PREFIX = "__rw_"
FILE_ROWS = 1 << 17  # rows of a file of a table of which a bound of rows is known
ROW_GROUP = 16 << 20  # bytes of a row group of intermediate tables, which every task that writes holds in memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset, as in tests on one machine, a temporary folder is set.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="roadweave-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return shared_root(spark)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (with __ for a dot) for the actions inside alone."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that its lineage ends there.

    Its shuffle files go at the end of the write, since nothing reads them again, and Arrow batches are bounded
    in bytes, for tables with some very long texts.
    """
    return Scratch(df.sparkSession).stored(df, label)


class Scratch:
    """Tables of one computation in the shared folder, which go as soon as they are no longer read.

    A table may be dropped when all that was made of it is stored itself, since lineage ends at the later table, so a
    lost executor never needs it again. Row groups are small, so that every task that writes holds little.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.places: dict[int, tuple[DataFrame, str, str | None]] = {}

    def stored(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """df, written to the shared folder and read again. rows: as many as it may have, where that is known, so that a small table is not many small files."""
        path = shared_path(self.spark, label)
        if rows is not None:
            df = df.coalesce(files_for(rows))
        with self._settings():
            df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        return self._kept(self.spark.read.schema(df.schema).parquet(path), path)

    def bucketed(self, df: DataFrame, label: str, key: str) -> DataFrame:
        """df, which the caller has dealt out by hash of key, as a table whose joins by key need no shuffle of it."""
        path = shared_path(self.spark, label)
        name = f"rw_{label}_{path[-32:]}"
        with self._settings():
            df.write.format("parquet").option("parquet.block.size", ROW_GROUP).option("path", path).bucketBy(partitions(self.spark), key).saveAsTable(name)
        return self._kept(self.spark.table(name), path, name)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path, name = self.places.pop(id(df))
            if name:
                self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)

    def _settings(self):  # noqa: ANN202
        return settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxBytesPerBatch=str(8 << 20))

    def _kept(self, df: DataFrame, path: str, name: str | None = None) -> DataFrame:
        self.places[id(df)] = (df, path, name)
        return df


def files_for(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file by the file system that Spark has for its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_table(spark: SparkSession, columns: list[list], schema: str) -> DataFrame:
    """A table of a few rows that the driver has, by column; made by Arrow, since a list of rows would start Python workers of its own."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, to_arrow_schema(types).types)], schema=to_arrow_schema(types)), types)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lookup_join(left: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int, spread: list[str], shares: int = 1024) -> DataFrame:
    """left outer join with a lookup of one row per key, where a key may hold a third of all left rows.

    lookup[weight] counts the left rows of the key. Keys with over total / shares rows are fewer than
    `shares` by construction, so these are broadcast; the left rows that they match take a
    salted key in the shuffled join of the rest, where they match nothing. No column of left may start
    with __rw_. Null keys match nothing and are dealt out as well.
    """
    values = [c for c in lookup.columns if c not in keys]
    big = F.col(weight) * shares > total
    hot = lookup.where(big).select(*(F.col(k).alias(f"{PREFIX}h_{k}") for k in keys), F.struct(*values).alias(f"{PREFIX}hot"))
    cold = lookup.where(~big).select(*(F.col(k).alias(f"{PREFIX}k_{k}") for k in keys), F.pmod(F.col(weight), F.lit(1)).cast("long").alias(f"{PREFIX}k_salt"), F.struct(*values).alias(f"{PREFIX}cold"))
    on_hot = [F.col(k) == F.col(f"{PREFIX}h_{k}") for k in keys]
    out = left.join(F.broadcast(hot), on_hot, "left")
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    salt = F.when(F.col(f"{PREFIX}hot").isNotNull() | nulls, F.pmod(F.xxhash64(*spread), F.lit(1 << 24)) + 1).otherwise(F.lit(0)).cast("long")
    out = out.withColumn(f"{PREFIX}salt", salt)
    on_cold = [F.col(k) == F.col(f"{PREFIX}k_{k}") for k in keys] + [F.col(f"{PREFIX}salt") == F.col(f"{PREFIX}k_salt")]
    out = out.join(cold, on_cold, "left").withColumn(f"{PREFIX}v", F.coalesce(f"{PREFIX}hot", f"{PREFIX}cold"))
    return out.select(*left.columns, *(F.col(f"{PREFIX}v.{c}").alias(c) for c in values))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes in a string or binary column; a longer value stands alone."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        col = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            total += int(sizes[i])
            if total > most and i > at:
                yield batch.slice(at, i - at)
                at, total = i, int(sizes[i])
        yield batch.slice(at, n - at)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None, count: int | None = None) -> DataFrame:
    """Calls fn for whole groups of rows with equal keys, which the caller keeps to a bounded size.

    Spark deals the rows out by key and sorts them; fn gets a table of many whole groups, sorted by
    keys, and finds their bounds itself, so that small groups cost no call of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.zeros(whole.num_rows, dtype=bool)
            for k in keys:
                col = whole.column(k).to_numpy()
                last |= col != col[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                out = fn(whole.slice(0, cut))
                if out is not None:
                    yield out
            held = whole.slice(cut).to_batches()
        if held:
            out = fn(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield out

    n = count or partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def make_folder(spark: SparkSession, path: str) -> str:
    """Makes a folder, so that a table without rows is an empty folder of files and not a missing one; returns its path with the file system that Spark has for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    return system.makeQualified(at).toString()


def write_file(uri: str, parts: Iterable[bytes]) -> int:
    """Writes a file under any URI that pyarrow knows, by a temporary name, so that a retried task leaves whole files only."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(draft, path)
    return size
