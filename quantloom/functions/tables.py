"""Tables computed once, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of this machine serves a local master and goes when
    Python ends; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-stored-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return base.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark wrote."""
    at, files = _at(spark, path)
    files.delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there: plans that use it several times hold its scan, not its
    plan, its lineage is cut, and it outlives the loss of executors. The table goes when the driver ends, or before that
    at the end of a ``released`` block."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _at(spark, path)
    files.deleteOnExit(at)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession):
    """Tables stored inside the block are deleted at its end: what is read from them must be written by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            remove(spark, path)
        del _written[before:]
