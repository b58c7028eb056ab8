"""Where lineage is cut: tables of a computation in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept under spark.checkpoint.dir, for tables that many others are made of. Only where that is unset and all runs on one machine, a temporary folder is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = named or f"file://{tempfile.mkdtemp(prefix='roadweave-')}"
        if named is None:
            atexit.register(shutil.rmtree, own.removeprefix("file://"), True)
        sc.setCheckpointDir(own)
    return df.checkpoint()
