"""Exact dedup by deterministic block naming.

A text, its white space normalised, is cut into blocks of a fixed number of code points. All blocks are range-partitioned and sorted, and
the place of a block's first row in that order is its integer name: equal blocks get one name, different ones never share it. Then adjacent
names are paired and the pairs named the same way, until each document has one name. The order is by a hash first and the block itself next, so that
ranges are even and their sampled bounds small; no hash decides equality. A level halves the names,
so the longest document (in blocks) sets the number of levels, by its logarithm.

A block or pair held by very many rows is dealt over several salted pieces; each piece names its own first row, and the pieces' names (their
number is bounded, see common.hot) are then mapped to the smallest.

Null text counts as empty; all empty texts are equal. A null doc_id sorts after all others: keep_id is null only where every row of a group
lacks one. Repeated rows (same doc_id, same text) are copies: each counts in group_size and one of them is kept. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hot, parts, pick, written

BLOCK_CHARS = 2048


def _named(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Replaces the key columns by `name`, an integer that equal keys share."""
    spark = rows.sparkSession
    tasks = parts(spark)
    keyed = rows.withColumn("h", F.xxhash64(*keys))
    counted = written(keyed.groupBy("h").agg(F.count("*").alias("n")), f"{tag}-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy = hot(counted, total, tasks).select("h", "salts")
    salted = (
        keyed.join(F.broadcast(heavy), "h", "left")
        .withColumn("salt", F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "sha", "pos"), F.col("salts")).cast("int")))
        .drop("salts")
    )
    ordered = (
        salted.repartitionByRange(tasks, "h", "salt")
        .sortWithinPartitions("h", "salt", *keys)
        .withColumn("place", F.monotonically_increasing_id())
    )
    named = ordered.withColumn("name", F.min("place").over(Window.partitionBy("h", "salt", *keys)))
    lead = (F.col("salt") >= 0) & (F.col("place") == F.col("name"))
    named = named.withColumn("lead", F.when(lead, F.struct(*keys))).drop(*keys, "h", "salt", "place")
    table = written(named, tag)
    forget(counted)
    leads = table.filter(F.col("lead").isNotNull()).select("lead", "name")
    one = leads.groupBy("lead").agg(F.min("name").alias("first"), F.collect_set("name").alias("names"))
    same = one.select(F.explode("names").alias("name"), "first")
    return table.drop("lead").join(F.broadcast(same), "name", "left").withColumn("name", F.coalesce("first", "name")).drop("first")


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, sha, copies, level, name): documents have the same (level, name) if and only if their normalised texts are equal."""
    base = pick(docs, doc_id="long", text="string").select(
        "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("norm")
    )
    blocks = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    rows = (
        base.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), blocks.alias("blocks"))
        .select("doc_id", "sha", F.greatest(F.size("blocks"), F.lit(1)).alias("left"), F.posexplode_outer("blocks").alias("pos", "block"))
        .select("doc_id", "sha", F.lit(1).cast("long").alias("copies"), "left", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block"))
    )
    level, done = 0, []
    named = _named(rows, ["block"], "exact-0")
    longest = named.agg(F.max("left")).first()[0] or 0
    while True:
        done.append(named.filter("left = 1").select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            return reduce(DataFrame.unionAll, done)
        level, longest = level + 1, -(-longest // 2)
        even = F.col("pos") % 2 == 0
        pairs = (
            named.filter("left > 1")
            .groupBy("doc_id", "sha", "left", F.floor(F.col("pos") / 2).cast("int").alias("half"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("one"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("two"),
                F.sum(F.when(even, F.col("copies"))).alias("copies"),
            )
            .select("doc_id", "sha", "copies", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("half").alias("pos"), "one", "two")
        )
        named = _named(pairs, ["one", "two"], f"exact-{level}")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = identities(docs, block_chars).groupBy("doc_id", "sha", "level", "name").agg(F.sum("copies").alias("copies"))
    ids = written(ids, "exact-ids")
    groups = ids.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = written(groups, "exact-groups")  # else the join takes the aggregate's partitions as they are, and a large group's can't be split
    rows = ids.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
