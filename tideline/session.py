"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, adaptive plans, Arrow.

    Python workers import this package by its name. Workers started from this process find it by the path
    set here; on other machines it has to be installed or passed along (``--py-files``).
    """
    root, known = str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder that goes when the process ends, but only if all tasks run on this machine.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so lost executors cost no recomputation of its history.

    This runs a job at once: operators that use it read their inputs when they are called, not when their result is.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, but as a table in the same folder: smaller where values recur, and read column by column.

    Order and partitioning are not kept.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
