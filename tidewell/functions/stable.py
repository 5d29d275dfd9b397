"""Results that are read more than once and must be the same each time."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder, so that later reads see the same rows in the same partitions.

    Only a local session that has no such folder gets one of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if given is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(given)
    return df.checkpoint()
