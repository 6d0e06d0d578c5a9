"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df; a folder is set only where the session has none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="sylvan-"))
    return df.checkpoint()
