"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the folder that spark.checkpoint.dir names; to a temporary one in local mode if unset."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def flat(df: DataFrame) -> DataFrame:
    """df, which is persisted, as a table of its own: what is lost is computed again, but plans made of it don't hold its plan.

    Spark writes out the plans of cached tables within plans, each twice, so that a chain of them doubles with every link.
    """
    session = df.sparkSession._jsparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(session.internalCreateDataFrame(rows, df._jdf.schema(), False), df.sparkSession)
