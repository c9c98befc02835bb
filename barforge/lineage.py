"""Where a plan reads one of its steps twice, the step is checkpointed first, so that nothing above it is computed again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that spark.checkpoint.dir names, or that the session has; a local session that has none gets one."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="checkpoints-")
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return df.checkpoint()
