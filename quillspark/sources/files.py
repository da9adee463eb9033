"""Content files as DataFrames, each beside its load status.

A file is all or nothing: one line or element that can't be read makes it malformed and gives no rows. Status is one of ok, missing, malformed, empty. Unknown keys
are ignored; a default stands for an absent key only, so an explicit null in a required field is malformed; a whole number may be quoted. Every row carries
`ord`, its place in the file, since Spark's rows have no order.

Files of lines are read in byte ranges, however large: each range's lines are numbered where they are read and shifted by the numbers of lines in the file's earlier
ranges, a table of one row a range. Whether a file may be taken is decided by the same table's counts. The lines are read and parsed once, into a table in the shared folder. Files
that are one JSON value, which has no lines to cut at, are read whole, one row a file, by the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schemas import INTEGERS, LANGUAGE, NUMBER, PHRASE, SOUND, snake
from ..functions.text import int_or_null, is_blank
from .folders import kept, listed

OK, MISSING, MALFORMED, EMPTY = "ok", "missing", "malformed", "empty"


def _whole(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(asset, body): a null body where there is no such file."""
    wanted = spark.createDataFrame([(n,) for n in names], "asset string")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [n for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"))]
    if not there:
        return wanted.withColumn("body", F.lit(None).cast("string"))
    read = spark.read.text([f"{folder}/{n}" for n in there], wholetext=True).select(F.col("_metadata.file_name").alias("asset"), F.col("value").alias("body"))
    # the bodies stay where they were read: what is sent about is the list of names
    found = read.join(F.broadcast(wanted), "asset")
    none = wanted.filter(~F.col("asset").isin(there)).withColumn("body", F.lit(None).cast("string"))
    bare = [n for n in there if store.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")).getLen() == 0]  # Spark gives no row for these
    return found.unionByName(none).unionByName(wanted.filter(F.col("asset").isin(bare)).withColumn("body", F.lit("")))


def _fields(v: Column, shape: dict) -> list[Column]:
    """The fields of a variant; null where one can't be read."""
    out = []
    for key, default in shape.items():
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        text = F.try_variant_get(v, f"$.{key}", "string")
        if key in INTEGERS:
            value = F.when((kind == "BIGINT") | (kind == "STRING"), int_or_null(text))
        else:
            value = F.when(kind == "STRING", text)
        out.append((value if default is None else F.when(kind.isNull(), F.lit(default)).otherwise(value)).alias(snake(key)))
    return out


def _rows(files: DataFrame, elements: Column, shape: dict) -> DataFrame:
    """(asset, body, ord, row, bad): the elements (JSON texts) of each file."""
    parts = files.filter(F.col("body").isNotNull()).select("asset", F.posexplode(elements).alias("ord", "json"))
    read = parts.withColumn("v", F.try_parse_json("json")).select("asset", F.col("ord").cast("long").alias("ord"), F.struct(*_fields(F.col("v"), shape)).alias("row"))
    bad = F.lit(False)
    for key in shape:
        bad = bad | F.col(f"row.{snake(key)}").isNull()
    return read.withColumn("bad", bad)


def _gated(files: DataFrame, rows: DataFrame, broken: Column, need_rows: bool, missing: str = MISSING) -> tuple[DataFrame, DataFrame]:
    seen = rows.groupBy("asset").agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"))
    status = files.select("asset", F.col("body").isNull().alias("gone"), F.coalesce(broken, F.lit(False)).alias("broken")).join(seen, "asset", "left")
    n, bad = F.coalesce("rows", F.lit(0)), F.coalesce("bad", F.lit(0))
    what = F.when(F.col("gone"), F.lit(missing)).when(F.col("broken") | (bad > 0), F.lit(MALFORMED))
    if need_rows:
        what = what.when(n == 0, F.lit(EMPTY))
    status = status.withColumn("status", what.otherwise(F.lit(OK)))
    status = status.select("asset", "status", F.when(F.col("status") == OK, n).otherwise(0).cast("long").alias("rows"))
    good = status.filter(F.col("status") == OK).select("asset")
    return rows.join(F.broadcast(good), "asset", "left_semi").select("asset", "ord", "row.*"), status


def _ranges(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """(asset, range, at, line): the lines of files that aren't blank. A range is the byte of its file at which it starts, `at` rises along it. Without
    line_sep, a line ends at a line feed, a carriage return or both."""
    read = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "false")
    read = (read if line_sep is None else read.option("lineSep", line_sep)).text(path)
    lines = read.select(F.col("_metadata.file_name").alias("asset"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line")).filter(~is_blank(F.col("line")))
    return lines.withColumn("at", F.monotonically_increasing_id())


def _shifted(lines: DataFrame, *sums: Column) -> tuple[DataFrame, DataFrame]:
    """`lines` (asset, range, at, ...), as they were kept, with `ord` from 0 in place of range and at; and (asset, rows, sums...)."""
    ranges = kept(lines.groupBy("asset", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"), *sums), "ranges")
    before = Window.partitionBy("asset").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select("asset", "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # lines of a range follow one another in the task that read it, so `at` has no gap between them
    placed = lines.join(shifts, ["asset", "range"]).withColumn("ord", F.col("at") + F.col("shift")).drop("range", "at", "shift")
    extra = [c for c in ranges.columns if c not in ("asset", "range", "rows", "first")]
    return placed, ranges.groupBy("asset").agg(F.sum("rows").alias("rows"), *(F.sum(c).alias(c) for c in extra))


def load_phrases(spark: SparkSession, folder: str, langs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Phrases of <lang>.jsonl with file_lang and ord, and the status of each file; blank lines are skipped and a file without rows is empty. The status has `detail`: the
    number (from 1, blank lines left out) of a malformed file's first bad line, or what an empty file lacks."""
    names = [f"{x}.jsonl" for x in langs]
    sizes = {name: size for name, is_folder, size in listed(spark, folder) if not is_folder}
    wanted = spark.createDataFrame([(n, n in sizes) for n in names], "asset string, there boolean")
    paths = [f"{folder}/{n}" for n in names if sizes.get(n)]
    if paths:
        parsed = _ranges(spark, paths).withColumn("v", F.try_parse_json("line"))
        parsed = parsed.select("asset", "range", "at", F.struct(*_fields(F.col("v"), PHRASE)).alias("row"))
        bad = F.lit(False)
        for key in PHRASE:
            bad = bad | F.col(f"row.{snake(key)}").isNull()
        lines, counts = _shifted(kept(parsed.withColumn("bad", bad), "phrases"), F.count_if("bad").alias("bads"))
    else:
        shape = ", ".join(f"{snake(k)} {'int' if k in INTEGERS else 'string'}" for k in PHRASE)
        lines = spark.createDataFrame([], f"asset string, row struct<{shape.replace(' ', ':').replace(',:', ',')}>, bad boolean, ord long")
        counts = spark.createDataFrame([], "asset string, rows long, bads long")
    n, bads = F.coalesce("rows", F.lit(0)), F.coalesce("bads", F.lit(0))
    what = F.when(~F.col("there"), MISSING).when(bads > 0, MALFORMED).when(n == 0, EMPTY).otherwise(OK)
    first_bad = lines.filter("bad").groupBy("asset").agg(F.min("ord").alias("first_bad"))
    stem = F.regexp_replace("asset", r"\.jsonl\z", "")
    detail = F.when(F.col("status") == MALFORMED, F.concat(F.lit("line "), F.col("first_bad") + 1)).when(F.col("status") == EMPTY, F.concat(F.lit("phrases:"), stem))
    status = wanted.join(F.broadcast(counts), "asset", "left").join(F.broadcast(first_bad), "asset", "left").withColumn("status", what)
    status = status.select("asset", "status", F.when(F.col("status") == OK, n).otherwise(0).cast("long").alias("rows"), detail.alias("detail"))
    good = status.filter(F.col("status") == OK).select("asset")
    rows = lines.join(F.broadcast(good), "asset", "left_semi").select("ord", "row.*", stem.alias("file_lang"))
    return rows, status


def _array(spark: SparkSession, folder: str, name: str, shape: dict) -> tuple[DataFrame, DataFrame]:
    files = _whole(spark, folder, [name])
    items = F.from_json("body", "array<string>")
    broken = F.col("body").isNotNull() & (F.json_array_length("body").isNull() | F.try_parse_json("body").isNull())
    rows, status = _gated(files, _rows(files, F.coalesce(items, F.array().cast("array<string>")), shape), broken, need_rows=False)
    return rows.drop("asset"), status


def load_catalog(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _array(spark, folder, "catalog.json", LANGUAGE)


def load_numbers(spark: SparkSession, folder: str, lang: str) -> tuple[DataFrame, DataFrame]:
    return _array(spark, folder, f"numbers-{lang}.json", NUMBER)


def load_sound_check(spark: SparkSession, folder: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """At most one row; no file is no error."""
    files = _whole(spark, folder, [f"soundcheck-{lang}.json"])
    rows, status = _gated(files, _rows(files, F.array("body"), SOUND), F.lit(False), need_rows=False, missing=OK)
    return rows.drop("asset", "ord"), status


def page_state(status: DataFrame) -> DataFrame:
    """Which page a phrase file's status leads to: missing and empty files show an empty page, malformed ones a failure."""
    return status.withColumn("page", F.when(F.col("status") == OK, F.lit("ready")).when(F.col("status") == MALFORMED, F.lit("failed")).otherwise(F.lit("empty")))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(file): all *.jsonl in a folder, with or without lines."""
    return spark.createDataFrame([(n,) for n, is_folder, _ in listed(spark, folder) if n.endswith(".jsonl") and not is_folder], "file string")


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line_no, line) of all *.jsonl in a folder; a line ends at a line feed, and lines are numbered without the blank ones."""
    if not any(size for n, is_folder, size in listed(spark, folder) if n.endswith(".jsonl") and not is_folder):
        return spark.createDataFrame([], "file string, line_no long, line string")
    placed, _ = _shifted(kept(_ranges(spark, folder, "\n"), "lines"))
    return placed.select(F.col("asset").alias("file"), (F.col("ord") + 1).alias("line_no"), "line")
