"""Cutting the lineage of tables that several branches of a job read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(table: DataFrame) -> DataFrame:
    """Reliable checkpoint of a table, so that its branches read it instead of redoing it.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where none
    is named (tests on one machine) a temporary one is taken.
    """
    session = table.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return table.checkpoint()
