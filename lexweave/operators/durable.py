"""Cutting lineage so that loops stay short and survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to spark.checkpoint.dir.

    Where that is unset, a temporary folder is used if Spark runs in this machine alone; otherwise a RuntimeError is
    raised, as executors would each write to their own disk.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexweave-"))
    return df.checkpoint(eager=True)
