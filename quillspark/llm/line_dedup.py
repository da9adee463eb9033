"""Line dedup by range-partitioned hashes.

Each line's key (stripped, A-Z lower-cased) is named by 128 bits of its SHA-256, which no two keys share whatever their makers intend. The hashes are range-partitioned and sorted by (hash, document, position);
the first row of a hash in that order belongs to the document that keeps the line, and a streaming window marks all rows of later
documents. What returns to the documents is no text but their keep bitmap, run-length coded as the runs of dropped positions. A hash
with a large share of all rows is settled beforehand by a partial aggregate (its smallest document), so it never meets in one task.

Null or empty text is one empty line. A null doc_id sorts after all others and counts as one document. Rows that share a doc_id count as
one document; each row still gives its own result. Keys under `least` code points never drop. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, NO_ID, UPPER, hot, parts, pick, text_name, written

LEAST = 10


def _lines(text) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(docs: DataFrame, least: int) -> DataFrame:
    key = lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER)
    named = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("dk"), text_name(F.col("text")).alias("th"), "text")  # once a text and not once a line
    return (
        named.select("dk", "th", F.posexplode(F.transform(_lines(F.col("text")), key)).alias("pos", "key"))
        .filter(F.char_length("key") >= least)
        .select("dk", "th", "pos", text_name(F.col("key")).alias("hash"))
    )


def dropped_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The compressed bitmaps: (dk, th, n_dropped, runs) for documents that lose lines; runs are (start, end) in order, end excluded."""
    spark = docs.sparkSession
    tasks = parts(spark)
    rows = _rows(pick(docs, doc_id="long", text="string"), least)
    counted = written(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("dk").alias("first")).filter("n > 1"), "line-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy = hot(counted, total, tasks).select("hash", "first")
    marked = rows.join(F.broadcast(heavy), "hash", "left")
    at_once = marked.filter(F.col("dk") > F.col("first")).select("dk", "th", "pos")
    ranged = (
        marked.filter(F.col("first").isNull()).drop("first")
        .repartitionByRange(tasks, "hash")
        .sortWithinPartitions("hash", "dk", "pos")
    )
    so_far = Window.partitionBy("hash").orderBy("dk", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = ranged.withColumn("first", F.first("dk").over(so_far)).filter(F.col("dk") > F.col("first")).select("dk", "th", "pos")
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy("dk", "th").orderBy("pos"))
    runs = (
        later.unionAll(at_once)
        .select("dk", "th", "pos", island.alias("island"))
        .groupBy("dk", "th", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    )
    return runs.groupBy("dk", "th").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"),
    )


def with_kept_text(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All columns of `docs` and, as the last three, n_lines, n_dropped and kept_text."""
    cols = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(cols))))
    dk, text = F.col(f"_{cols.index('doc_id')}").cast("long"), F.col(f"_{cols.index('text')}").cast("string")
    keyed = plain.select("*", F.coalesce(dk, F.lit(NO_ID)).alias("dk"), text_name(text).alias("th"))
    joined = keyed.join(dropped_runs(docs, least), ["dk", "th"], "left").withColumn("lines", _lines(text))
    starts = F.concat(F.array(F.lit(0)), F.col("runs.end"))
    ends = F.concat(F.col("runs.start"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice(F.col("lines"), x["a"] + 1, x["b"] - x["a"])))
    out = joined.select(
        *plain.columns,
        F.size("lines").cast("long"),
        F.coalesce("n_dropped", F.lit(0).cast("long")),
        F.when(F.col("runs").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")),
    )
    return out.toDF(*cols, "n_lines", "n_dropped", "kept_text")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    return with_kept_text(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce("text", ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce("text", ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
