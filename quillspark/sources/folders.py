"""Folders that the driver and all executors see, and small files and tables written into them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place under spark.checkpoint.dir; where that is unset, under a temporary folder if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    path = f"{base.rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written into a folder of its own and read again: what follows sees one evaluation of it, and a lost executor costs nothing of that."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session has ended: nothing reads the folder any more
            return


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file through the file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, whether it is a folder, bytes) of what lies in a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(x.getPath().getName(), x.isDirectory(), x.getLen()) for x in store.listStatus(where)] if store.exists(where) else []


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.read.text(path, wholetext=True).first().value
