"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def builder(name: str = "tidewatch") -> SparkSession.Builder:
    """A session builder with settings that only take effect at the start."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        # plans here are large; recording where each column was written slows building them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def configured(spark: SparkSession) -> SparkSession:
    """Pins what results depend on; sizing is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Where none is named, a temporary one serves a driver without executors (`local[n]`); on a cluster
    that is an error, as executors could not read back what another one wrote.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named is None:
        current = context.getCheckpointDir()
        if current is not None:
            return current
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tidewatch-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(rows: DataFrame) -> DataFrame:
    """Materialises rows outside the executors, so a lost one costs no recomputation."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
