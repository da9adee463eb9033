"""What the operators share: exact column picks, tables in the shared folder, hot keys."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Takes the place of a null doc_id where an order is needed: such rows come last.
NO_ID = (1 << 63) - 1

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per application; they need no copy of it installed."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="quillspark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns named by exact spelling, cast to the given types; all others go, whatever their names."""
    ship(df.sparkSession)
    cols = df.columns
    plain = df.toDF(*(f"_{i}" for i in range(len(cols))))
    return plain.select(*(F.col(f"_{cols.index(k)}").cast(v).alias(k) for k, v in kinds.items()))


def text_name(text: Column) -> Column:
    """16 bytes, of SHA-256, that tell texts apart whatever they hold; a null has its own name."""
    return F.coalesce(F.unhex(F.substring(F.sha2(text, 256), 1, 32)), F.lit(bytearray()))


def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The batches of a mapInArrow function. At the task's end the worker gives back what it holds free: it lives on to the next step's tasks, and neither
    Arrow's pool nor malloc returns memory by itself."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
            trim(0)


def parts(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Where it is unset, a folder of our own if driver and executors are one process
    (as in tests); on a cluster, where such a folder would be seen by the driver alone, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a table into the shared folder and reads it again, so a lost executor costs no earlier step."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._quill_path = path
    return again


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path() named, through the file system it lies in."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that no later step reads."""
    remove(df.sparkSession, df._quill_path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: nothing reads the folder any more
            return


def hot(counted: DataFrame, total: int, tasks: int, least: int = 64) -> DataFrame:
    """Of keys with their number of rows `n`, those with over a quarter of a task's fair share, with `salts`: the pieces that bring each
    piece down to that. At most 4 * tasks keys qualify and salts add up to at most 8 * tasks, whatever the input, so a broadcast of
    them is bounded."""
    share = max(least, -(-total // (4 * tasks)))
    return counted.filter(F.col("n") > share).withColumn("salts", F.ceil(F.col("n") / F.lit(share)).cast("int"))


def spread_join(rows: DataFrame, found: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined with `found`, which has one row to a key. The rows of the keys in `heavy`, as hot() gives them, are dealt over their salts and
    found's row of such a key goes to each, so that no task gets more of a key than a share."""
    heavy = F.broadcast(heavy.select(key, F.col("salts").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    copied = found.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
