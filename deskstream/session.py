"""Session set-up and the one shared scratch location the engine writes to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "deskstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> None:
    """What the operators rely on, for a session somebody else built: UTC and this package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="deskstream-zip-")  # read by the driver only, which serves it to the workers
    archive = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private temporary folder is used only where the setting is absent and the
    master is local (unit tests); on a cluster a missing setting is an error,
    because a machine-local folder does not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _private:
        _private[context.applicationId] = tempfile.mkdtemp(prefix="deskstream-")
    return _private[context.applicationId]


_private: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never reused."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(frame: DataFrame, label: str = "table") -> DataFrame:
    """A Parquet table below the shared folder: like a checkpoint, with a size that the planner knows."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and has a flat plan."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return frame.checkpoint(eager=True)
