"""The state log as a stream: what each key holds, told on change.

`observed` keeps a row of state a key and emits a key only when its value changes, in update mode, resumed from its checkpoint. Rows that come late, with a seq below the key's last, don't
change a latest value; toggles count in whatever order they come. Rows of one seq in one trigger count once. The log's batches are appended once (see the
batch folds), so no seq comes in two triggers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.schemas import LOG
from ..operators.state import STAR, keyed
from ..sources.folders import listed

#: What is told of a key: its value (of a star: on or off), the change it comes from, and how often it has changed.
TOLD = "op string, lang string, theme int, item_id string, value string, seq long, version long"


def read_log(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The batches of a stored log as they arrive, or a folder of log files without batches, at most so many files a trigger."""
    bare = any(name.endswith(".parquet") and not is_folder for name, is_folder, _ in listed(spark, path))
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(path if bare else f"{path}/batch=*")


def latest(log: DataFrame, op: str, *keys: str) -> DataFrame:
    """As the batch fold, by built-in aggregates; in update mode a key is told whenever a row of it comes. State is one row a key."""
    return log.filter(F.col("op") == op).groupBy(*keys).agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def toggles(log: DataFrame, op: str) -> DataFrame:
    """(lang, item_id, starred) by parity; run it in update mode."""
    return log.filter(F.col("op") == op).groupBy("lang", "item_id").agg((F.count("*") % 2 == 1).alias("starred"))


def observed(log: DataFrame) -> DataFrame:
    """TOLD, a row for each change of a key's value; run it in update mode. State is one row a key. A key's rows of a trigger go through one task in Arrow
    batches, and of them only their numbers are held."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        op, lang, theme, item = key
        value, seq, toggled, version = state.get if state.exists else (None, None, 0, 0)
        before, top, text = value, seq, value
        seen: set[int] = set()
        for frame in frames:
            for s, payload in zip(frame["seq"].tolist(), frame["payload"].tolist(), strict=True):
                if s in seen:
                    continue
                seen.add(s)
                toggled ^= 1
                if top is None or s > top:
                    top, text = s, payload
        value = ("on" if toggled else "off") if op == STAR else text
        changed = not version or value != before
        version += changed
        state.update((value, top, toggled, version))
        if changed:
            theme = None if theme is None or theme != theme else int(theme)
            yield pd.DataFrame([(op, lang, theme, item, value, top, version)], columns=[c.split()[0] for c in TOLD.split(", ")]).astype({"theme": "Int32"})

    rows = keyed(log.filter(F.col("seq").isNotNull() & F.col("op").isNotNull())).select(*LOG.fieldNames())
    return rows.groupBy("op", "lang", "theme", "item_id").applyInPandasWithState(step, TOLD, "value string, seq long, toggled int, version long", "update", GroupStateTimeout.NoTimeout)


def follow(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each trigger's changes into a folder of its own under `out`, whole or not at all, until all that has come is done. A trigger that is run again after
    a failure replaces its folder. Started again with the same checkpoint, it goes on from there."""

    def put_changes(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    return observed(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put_changes).trigger(availableNow=True).start()


def told(spark: SparkSession, out: str) -> DataFrame:
    """What each key holds, by the changes written so far: the one of the highest version."""
    rows = spark.read.schema(TOLD).parquet(out)
    return rows.groupBy("op", "lang", "theme", "item_id").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
