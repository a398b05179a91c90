"""Ends the lineage of tables that a loop builds on, and lets workers find the library."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder of spark.checkpoint.dir; only where that is unset, a folder of this machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()


def workers_find_library(spark) -> None:
    """Puts this library's folder on the workers' Python path, for sessions begun elsewhere; on a cluster it is shipped or mounted there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
