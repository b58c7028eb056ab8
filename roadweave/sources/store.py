"""Analysed recordings at rest, for a viewer's look-ups: each reads the few files and row groups that hold what it asks for."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import bundles, serving
from roadweave.operators.network import Network
from roadweave.sources import manifest

ROW_GROUP = 1 << 20  # bytes of a row group of details, so that a look-up of one track reads little


@dataclass(frozen=True)
class Meta:
    """What a viewer knows of a recording before all else."""

    name: str
    width: int
    height: int
    fps: float
    frames: int
    chunk_s: float = 10.0

    @property
    def duration_s(self) -> float:
        return round(self.frames / self.fps, 2)

    @property
    def chunks(self) -> int:
        return -int(-self.frames / self.fps // self.chunk_s)


class Store:
    """Tables under one path: overlay (by recording and chunk), details (by recording, in order of track) and sections (by recording and section).

    A load writes a recording's rows to folders of its own and then names them in the recording's manifest, by one rename: readers see the old load or
    the new one, and other recordings are not touched.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def load(self, meta: Meta, rows: DataFrame, network: Network | None = None, files: int = 8) -> None:
        """rows: a recording's analysed tracks, parked ones too (see sources.tables.TRACK_COLUMNS). With a network its bundles are kept as well."""
        name = f"{meta.name}-{uuid.uuid4().hex}"
        moving = serving.shown(rows)
        chunks = serving.overlay_chunks(rows, meta.fps, meta.chunk_s)
        chunks.repartition("chunk").write.partitionBy("chunk").parquet(f"{self.path}/overlay/{name}")
        mv = network.movements if network else rows.sparkSession.createDataFrame([], "track_id long, origin string, destination string, turn string")
        ids = moving.groupBy("track_id").agg(F.first("display_id").alias("display_id"))
        details = serving.track_details(moving, mv).join(ids, "track_id")
        details.repartitionByRange(files, "display_id").sortWithinPartitions("display_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/details/{name}")
        if network:
            tables = bundles.insights(moving, network, meta.fps) | bundles.flow(moving, network, meta.fps) | bundles.reasoning(rows, network, meta.fps)
            bundles.as_rows({k: t for k, t in tables.items()}).repartition("section").write.partitionBy("section").parquet(f"{self.path}/sections/{name}")
        manifest.commit(self.spark, f"{self.path}/{meta.name}.json", json.dumps({"load": name, "sections": network is not None, "meta": meta.__dict__}))

    def _entry(self, recording: str) -> dict:
        text = manifest.read(self.spark, f"{self.path}/{recording}.json")
        if text is None:
            raise KeyError(recording)
        return json.loads(text)

    def meta(self, recording: str) -> Meta:
        return Meta(**self._entry(recording)["meta"])

    def chunk(self, recording: str, k: int) -> DataFrame:
        """frames of one overlay chunk: one row, or none for a chunk without boxes. Reads that chunk's folder alone."""
        return self.spark.read.parquet(f"{self.path}/overlay/{self._entry(recording)['load']}").where(F.col("chunk") == k).select("frames")

    def track(self, recording: str, display_id: int) -> DataFrame:
        """The details of one track, one row or none. Files and row groups are skipped by their ranges of ids."""
        return self.spark.read.parquet(f"{self.path}/details/{self._entry(recording)['load']}").where(F.col("display_id") == display_id)

    def section(self, recording: str, section: str) -> DataFrame:
        """row: a section's rows of the recording's bundles as JSON text."""
        entry = self._entry(recording)
        if not entry["sections"]:
            raise KeyError(section)
        return self.spark.read.parquet(f"{self.path}/sections/{entry['load']}").where(F.col("section") == section).select("row")
