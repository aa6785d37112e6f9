"""Written intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the checkpoint folder the cluster names, for use by several branches.

    spark.checkpoint.dir of the session is used. Where neither it nor a folder is set, a temporary
    folder serves in local mode, as in tests; on a cluster, whose executors share no such folder, that
    is an error. The files outlive lost executors; Spark removes them as their plans are given up if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenry-"))
    return df.checkpoint()
