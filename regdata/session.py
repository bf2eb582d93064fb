"""Session defaults shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "regdata", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the settings the library is written for.

    On a cluster leave ``master`` unset: the submit command supplies it, along with
    ``spark.sql.shuffle.partitions`` (size it so that a shuffle partition stays near
    128-256 MB; adaptive execution merges the small ones).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting, such as a test, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _local_folders.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, so that it is computed once.

    It goes to reliable storage in the shared folder and survives the loss of executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def share_code(spark: SparkSession) -> None:
    """Send this package to the Python workers; those of a local session read it where the driver does."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if re.match(r"local(\[|$)", context.master) or getattr(context, "_shared_regdata", False):
        return
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/regdata", "zip", root, "regdata"))
    context._shared_regdata = True
