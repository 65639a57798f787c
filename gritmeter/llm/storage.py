"""Places for intermediate tables that must outlive the executor that made them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder (``spark.checkpoint.dir``); a private folder only where that is unset and the master is local.

    It is removed when the driver's process ends, or before by ``clear``: results
    are read from it until then.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = f"{named.rstrip('/')}/gritmeter-{app}" if named else "file://" + tempfile.mkdtemp(prefix="gritmeter-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables and files of this application, on any file system; results that weren't written elsewhere can't be read afterwards."""
    folder = _OWN.pop(spark.sparkContext.applicationId, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """File-system path of a shared folder that every executor mounts."""
    return path[len("file://"):] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the copy survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_own_dirs() -> None:
    """Remove the folders of this process, those that are mounted as files; others are ``clear``'s."""
    for path in _OWN.values():
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree(local_path(path), ignore_errors=True)
    _OWN.clear()


atexit.register(clear_own_dirs)


def as_text(df: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Only ``id_column`` and ``column``, null texts as empty ones; other columns, whatever their names, are left behind."""
    return df.select(F.col(id_column), F.coalesce(F.col(column), F.lit("")).alias(column))


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint if the counted ``rows`` are within ``limit``; else Spark's shuffled join with skew handling."""
    return F.broadcast(df) if rows <= limit else df
