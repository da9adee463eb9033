"""User state: an append-only log folded to what holds now.

A log row is (seq, op, lang, theme, item_id, payload); seq orders all changes and stands for one change, however often its row is met. The folds are
single aggregates with partial sums on the map side.

A stored log is a folder of batches. A batch is written whole and is there once its marker is; appending a batch again, by a job that is run twice or after a
failure, changes nothing. `compact` folds the batches so far into a snapshot of one row a key, partitioned by kind and language, which names the batches it
covers; `current` reads the last snapshot with the batches after it, and of both only the kinds and languages that are asked for.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import LOG
from ..functions.text import clamped, int_or_null
from ..sources.folders import drop, listed, put, text_of, there

KEY = ["op", "lang", "theme", "item_id"]
DONE = "_SUCCESS"
POSITION, STAR, NOTE, LAST, ACK = "position", "star_toggle", "note", "last_lang", "ack"


def changes(rows: DataFrame, op: str, lang=None, theme=None, item_id=None, payload=None) -> DataFrame:
    """Log rows of one kind from `rows`, which have `seq`; the other arguments are Columns or null."""
    given = {"lang": lang, "theme": theme, "item_id": item_id, "payload": payload}
    cells = {k: F.lit(None) if c is None else c for k, c in given.items()}
    return rows.select("seq", F.lit(op).alias("op"), *(cells[f.name].cast(f.dataType).alias(f.name) for f in LOG.fields[2:]))


def batch_name(rows: DataFrame) -> str:
    """A name that the same log rows always have, in whatever order."""
    all_ = rows.select(F.xxhash64(*LOG.fieldNames()).alias("h"), F.xxhash64(F.lit(7), *LOG.fieldNames()).alias("g"), "seq")
    told = all_.agg(F.count("*"), F.min("seq"), F.max("seq"), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(map(str, told))).encode()).hexdigest()[:32]


def append(log: DataFrame, path: str, batch: str | None = None) -> str:
    """Adds a batch of rows to the log at `path` and returns its name: the given one, or one that follows from the rows. A batch that is there already stays as it is; what a
    failed job left of it is replaced. What holds is decided by the folds: the last write wins, a toggle turns over; so no row is ever changed."""
    spark = log.sparkSession
    rows = log.select(*LOG.fieldNames())
    name = batch if batch is not None else batch_name(rows)
    folder = f"{path}/batch={name}"
    if not there(spark, f"{folder}/{DONE}") and name not in _snapshot(spark, path)[1]:
        rows.write.mode("overwrite").parquet(folder)
    return name


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that are there whole."""
    found = (n.removeprefix("batch=") for n, is_folder, _ in listed(spark, path) if is_folder and n.startswith("batch="))
    return sorted(n for n in found if there(spark, f"{path}/batch={n}/{DONE}"))


def _rows_of(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(*(f"{path}/batch={n}" for n in names))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the batches that are there."""
    return _rows_of(spark, path, batches(spark, path))


def keyed(log: DataFrame) -> DataFrame:
    """The log less what doesn't tell its kind's keys apart: a place is kept by language and theme, a star or note by language and item, the last language once for all."""
    kind = F.col("op")
    return log.withColumns({"lang": F.when(kind != LAST, F.col("lang")), "theme": F.when(kind == POSITION, F.col("theme")), "item_id": F.when(kind.isin(STAR, NOTE), F.col("item_id"))})


def folded(log: DataFrame) -> DataFrame:
    """(op, lang, theme, item_id, payload, seq, odd): one row a key: its last change, and whether it was changed an odd number of times."""
    return keyed(log).groupBy(*KEY).agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"), (F.count_distinct("seq") % 2 == 1).alias("odd"))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two folds of different batches as the fold of both."""
    odd = F.sum(F.col("odd").cast("int")) % 2 == 1
    return one.unionByName(other).groupBy(*KEY).agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"), odd.alias("odd"))


def _snapshot(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last whole snapshot's number (0: none) and the batches it covers."""
    numbers = [int(n.removeprefix("snapshot=")) for n, is_folder, _ in listed(spark, path) if is_folder and n.startswith("snapshot=")]
    for n in sorted(numbers, reverse=True):
        if there(spark, f"{path}/snapshot-{n}.json"):
            return n, json.loads(text_of(spark, f"{path}/snapshot-{n}.json"))
    return 0, []


def _state_of(spark: SparkSession, path: str, number: int) -> DataFrame:
    kinds = "lang string, theme int, item_id string, payload string, seq long, odd boolean, op string, file_lang string"
    if not number:
        return spark.createDataFrame([], kinds).drop("file_lang")
    return spark.read.schema(kinds).parquet(f"{path}/snapshot={number}")


def compact(spark: SparkSession, path: str) -> int:
    """Folds the batches that no snapshot covers into the last snapshot and writes the next; its number. A snapshot counts once it names what it covers, which is
    written last, so a job that fails midway leaves the one before in force. Nothing new: nothing is written."""
    number, covered = _snapshot(spark, path)
    new = [n for n in batches(spark, path) if n not in set(covered)]
    if not new:
        return number
    state = merged(_state_of(spark, path, number).select(*KEY, "payload", "seq", "odd"), folded(_rows_of(spark, path, new)))
    folder = f"{path}/snapshot={number + 1}"
    state.withColumn("file_lang", F.col("lang")).write.mode("overwrite").partitionBy("op", "file_lang").parquet(folder)
    put(spark, f"{path}/snapshot-{number + 1}.json", json.dumps([*covered, *new]))
    return number + 1


def retire(spark: SparkSession, path: str) -> None:
    """Deletes what the last snapshot makes needless: the batches it covers, whose names it keeps, so that they aren't appended again, and the snapshots before it. The
    log then holds one row a key and what came after; a stream must have read the batches before."""
    number, covered = _snapshot(spark, path)
    for n in covered:
        drop(spark, f"{path}/batch={n}")
    for n in range(1, number):
        drop(spark, f"{path}/snapshot-{n}.json")
        drop(spark, f"{path}/snapshot={n}")


def current(spark: SparkSession, path: str, op: str | None = None, lang: str | None = None) -> DataFrame:
    """The fold of the whole log, of one kind and language if they are given: the last snapshot, of which only these partitions are read, with the batches after it.
    Batches are folded by distinct seq among themselves; a seq isn't in two batches of different names."""
    number, covered = _snapshot(spark, path)
    late = _rows_of(spark, path, [n for n in batches(spark, path) if n not in set(covered)])
    early = _state_of(spark, path, number)
    if op is not None:
        early, late = early.filter(F.col("op") == op), late.filter(F.col("op") == op)
    if lang is not None:
        early, late = early.filter(F.col("file_lang") == lang) if number else early, late.filter(F.col("lang") == lang)
    return merged(early.select(*KEY, "payload", "seq", "odd"), folded(late))


def as_log(state: DataFrame) -> DataFrame:
    """A fold as the shortest log that has it, which all other folds read: one row a key, none for a star that is off."""
    return state.filter((F.col("op") != STAR) | F.col("odd")).select(*LOG.fieldNames())


def save_positions(rows: DataFrame, visible: Column | None = None) -> DataFrame:
    """Opening a theme or stepping in it: (seq, lang, theme, wanted, n) to position rows, the wanted place clamped to the theme's `n` phrases, or to those
    visible under a query. It is kept against the theme either way."""
    place = clamped(F.col("wanted"), F.coalesce(F.col("n") if visible is None else visible, F.lit(0)))
    return changes(rows, POSITION, F.col("lang"), F.col("theme"), payload=place.cast("string"))


def save_opened(opened: DataFrame, status: DataFrame) -> DataFrame:
    """(seq, lang) to last_lang rows, only of languages whose phrases were loaded: `status` is (lang, status)."""
    loaded = status.filter(F.col("status") == "ok").select("lang")
    return changes(opened.join(loaded, "lang", "left_semi"), LAST, payload=F.col("lang"))


def save_notes(rows: DataFrame) -> DataFrame:
    """(seq, lang, item_id, text) to note rows; a note without text is an empty one."""
    return changes(rows, NOTE, F.col("lang"), item_id=F.col("item_id"), payload=F.coalesce("text", F.lit("")))


def save_acks(rows: DataFrame) -> DataFrame:
    return changes(rows, ACK, F.col("lang"), payload=F.lit("1"))


def latest(log: DataFrame, op: str, *keys: str) -> DataFrame:
    """(keys, payload, seq) of the last change: the last write wins."""
    rows = log.filter(F.col("op") == op)
    return rows.groupBy(*keys).agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def positions(log: DataFrame) -> DataFrame:
    """(lang, theme, position): stored positions that are numbers, of themes 1 to 8."""
    found = latest(log, POSITION, "lang", "theme").filter(F.col("theme").between(1, 8))
    return found.withColumn("position", int_or_null(F.col("payload"))).filter(F.col("position").isNotNull()).select("lang", "theme", "position")


def stars(log: DataFrame) -> DataFrame:
    """(lang, item_id) that are starred: toggled an odd number of times. A toggle whose row is met again is the same one."""
    counted = log.filter(F.col("op") == STAR).groupBy("lang", "item_id").agg(F.count_distinct("seq").alias("toggles"))
    return counted.filter(F.col("toggles") % 2 == 1).select("lang", "item_id")


def notes(log: DataFrame) -> DataFrame:
    return latest(log, NOTE, "lang", "item_id").select("lang", "item_id", F.coalesce("payload", F.lit("")).alias("note"))


def acks(log: DataFrame) -> DataFrame:
    return latest(log, ACK, "lang").select("lang", F.coalesce(F.col("payload") == "1", F.lit(False)).alias("acked"))


def last_lang(log: DataFrame) -> DataFrame:
    """One row; null where no language was opened."""
    return log.filter(F.col("op") == LAST).agg(F.max_by("payload", "seq").alias("last_lang"))


def star_sets(catalog: DataFrame, starred: DataFrame) -> DataFrame:
    """(code, ids): every catalog language with its starred ids, sorted; none is an empty array."""
    sets = starred.groupBy("lang").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    joined = catalog.join(sets, catalog.code == sets.lang, "left")
    return joined.select("ord", "code", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def add_star(ids, item):
    return F.array_union(ids, F.array(item))


def drop_star(ids, item):
    return F.array_except(ids, F.array(item))
