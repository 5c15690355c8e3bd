"""A durable cut of lineage, for work in rounds and for tables that are read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there, so that a lost executor replays one round at most.

    The folder is the one that spark.checkpoint.dir names. Where that is unset, local sessions of one process get a temporary one; a cluster is refused,
    as its machines don't share such a folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rounds-"))
    return df.checkpoint(eager=True)
