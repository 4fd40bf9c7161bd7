"""Tables in the folder that driver and executors share, for cutting lineage between rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_SWEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a folder of its own in local mode and an error elsewhere."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(context, path: str) -> None:
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _sweep(context, folder: str) -> None:
    try:
        _delete(context, folder)
    except (OSError, RuntimeError, AttributeError, PySparkException):  # the JVM is gone: nothing can be deleted any more
        pass


def run_dir(spark: SparkSession) -> str:
    """This application's folder for tables, deleted when the driver's Python ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/codeloom/{context.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, context, folder)
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when a query ends, not when the driver's JVM collects what names them


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it survives lost executors and has no lineage. Nothing reads the shuffle files of its plan again, so they are deleted at once."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_codeloom_path", None):
            _delete(df.sparkSession.sparkContext, path)
