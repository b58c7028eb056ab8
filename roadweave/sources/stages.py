"""Stages of a run whose tables are kept: a rerun begins at the first stage whose parameters or inputs differ."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from roadweave.sources import manifest

#: The names under which a run's files are known.
FILES = {"raw": "detections.parquet", "tracks": "tracks_raw.parquet", "final": "l2_tracks.parquet", "calib": "calibration.json", "csv": "tracks.csv", "video": "annotated.mp4", "report": "report.json"}


def paths(outdir: str, name: str) -> dict[str, str]:
    """Where a run's seven files are, by kind."""
    return {kind: f"{outdir.rstrip('/')}/{name}_{file}" for kind, file in FILES.items()}


def sidecar(spark: SparkSession, video: str) -> str | None:
    """The telemetry beside a video: its path with .srt or .SRT, whichever there is."""
    stem = video.rpartition(".")[0] if "." in video.rpartition("/")[2] else video
    return next((p for p in (f"{stem}.srt", f"{stem}.SRT") if manifest.exists(spark, p)), None)


def save_table(df: DataFrame, path: str) -> str:
    """Writes parquet, or CSV beside it where a column's type cannot be; returns the path written."""
    try:
        df.write.mode("overwrite").parquet(path)
    except AnalysisException:
        path = f"{path.removesuffix('.parquet')}.csv"
        plain = df.select(*(df[c].cast("string").alias(c) for c in df.columns))
        plain.write.mode("overwrite").option("header", True).csv(path)
    return path


@dataclass(frozen=True)
class Stage:
    """A table made of others (needs, by name) under parameters: anything that JSON holds, or dataclasses."""

    name: str
    make: Callable[..., DataFrame]
    params: object = None
    needs: Sequence[str] = ()


class Run:
    """The stages of one run under `folder`. sources: tables from outside by name, each with a text that changes when its content does."""

    def __init__(self, spark: SparkSession, folder: str, sources: dict[str, tuple[DataFrame, str]] | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = {k: df for k, (df, _) in (sources or {}).items()}
        self.marks = {k: mark for k, (_, mark) in (sources or {}).items()}
        self.made: list[str] = []

    def mark_of(self, stage: Stage) -> str:
        params = asdict(stage.params) if is_dataclass(stage.params) else stage.params
        whole = json.dumps([stage.name, params, [self.marks[n] for n in stage.needs]], sort_keys=True, default=str)
        return hashlib.sha256(whole.encode()).hexdigest()

    def entry(self, name: str) -> dict | None:
        """What is kept of a stage: mark, path, schema and parameters."""
        text = manifest.read(self.spark, f"{self.folder}/{name}.json")
        return None if text is None else json.loads(text)

    def table(self, stage: Stage) -> DataFrame:
        """The stage's table, kept from before if its mark is the same, else made, written to a folder of its own and then committed."""
        mark, old = self.mark_of(stage), self.entry(stage.name)
        if old is None or old["mark"] != mark:
            df = stage.make(*(self.tables[n] for n in stage.needs), *(() if stage.params is None else (stage.params,)))
            path = f"{self.folder}/{stage.name}-{mark[:16]}.parquet"
            df.write.mode("overwrite").parquet(path)
            old = {"mark": mark, "path": path, "schema": df.schema.jsonValue(), "params": asdict(stage.params) if is_dataclass(stage.params) else stage.params}
            manifest.commit(self.spark, f"{self.folder}/{stage.name}.json", json.dumps(old, default=str))
            self.made.append(stage.name)
        self.marks[stage.name] = mark
        self.tables[stage.name] = self.spark.read.parquet(old["path"])
        return self.tables[stage.name]

    def all(self, stages: Sequence[Stage]) -> dict[str, DataFrame]:
        """All tables by name; stages come in an order in which what one needs is before it. made lists those that were made anew."""
        return {s.name: self.table(s) for s in stages}
