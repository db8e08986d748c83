"""Session defaults, table access and the shared-storage tables used by iterative operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if counting it stops below this many (narrow) rows.
BROADCAST_ROWS = 200_000


def get_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and AQE session; everything else is left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, this application's own part of it.

    Only a local master may go without ``spark.checkpoint.dir``: everything then runs on one machine.  A cluster that
    names no shared folder is an error, as a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints")
    return named.rstrip("/") + f"/{spark.sparkContext.applicationId}"


_folders: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete through the file system that holds ``path``, whichever that is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _tidy_at_end(spark: SparkSession, folder: str) -> None:
    """Have this application's written tables removed when the driver ends, also if the context was stopped before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def tidy() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; a plain path can still be removed without it
            path = folder.removeprefix("file://")
            if "://" not in path:
                shutil.rmtree(path, ignore_errors=True)

    atexit.register(tidy)


def cut(df: DataFrame) -> DataFrame:
    """Materialise on shared storage and read back, so a lost executor costs no recomputation of the past.

    A written table rather than ``checkpoint()``: it is columnar, and its size is known to the planner, whereas a
    checkpoint keeps the estimates of the plan it replaces, which multiply from round to round of an iteration.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _folders:
        _folders.add(folder)
        _tidy_at_end(spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__["_written_at"] = path
    return back


def free(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing reads it any more; other frames are left alone."""
    path = df.__dict__.pop("_written_at", None)
    if path:
        _remove(df.sparkSession, path)
