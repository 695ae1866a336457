"""Getting the package to the executors of a session, and tables to the folder that they share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the session has Spark's default, so that a batch of long texts stays small.
ARROW_ROWS = "2000"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gradeloom-")) / "gradeloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*")):
            if path.suffix in (".py", ".json", ".csv", ".md") and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="gradeloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gradeloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, once its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows; else as it is, for a join that moves it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
