"""The engine's roles played by the given tables: documents as phrases, events as the state log, labels as stars, part as numbers.

A document is a phrase of the language file `lang`; its theme follows from its source. `k` in an event's props is the item; language and theme follow
from it. A view saves a position (the value, clamped to the theme), a click toggles a star, a sign-up acknowledges the briefing, a
purchase saves a note, and a view also makes its language the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamped
from ..operators import state

LANGS = ["es", "it", "fr", "en", "de"]
CATALOG = [("es", "Spanish", "committed", 40, 0), ("it", "Italian", "bench", 40, 1), ("fr", "French", "committed", 40, 2), ("en", "English", "committed", 40, 3), ("de", "German", "planned", 40, 4)]

P_SQL = """p AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS file_lang, CAST(substr(source, 4) AS INTEGER) % 8 + 1 AS theme,
  "text" AS english, source AS romanization, "text" AS you_say, doc_id AS ord FROM documents)"""
CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}', '{s}', {k}, {o})" for c, n, s, k, o in CATALOG) + ") t(code, name, status, kit_total, ord))"
EV_SQL = f"""ev AS (SELECT event_id AS seq, event_type, k, {LANGS}[k % 5 + 1] AS lang, k % 8 + 1 AS theme, CAST(k AS VARCHAR) AS item_id, "value"
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))"""
POS_SQL = """n AS (SELECT file_lang, theme, count(*) AS n FROM p GROUP BY ALL),
pos AS (SELECT ev.lang, ev.theme, max_by(least(greatest(CAST(floor("value") AS INTEGER), 0), greatest(coalesce(n, 0) - 1, 0)), seq) AS position
  FROM ev LEFT JOIN n ON n.file_lang = ev.lang AND n.theme = ev.theme WHERE event_type = 'view' GROUP BY 1, 2)"""
STAR_SQL = "st AS (SELECT lang, item_id FROM ev WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("file_lang"), "lang",
        (F.substring("source", 4, 9).try_cast("int") % 8 + 1).alias("theme"),
        F.col("text").alias("english"), F.col("source").alias("romanization"), F.col("text").alias("you_say"), F.lit("").alias("sound_tip"), F.lit("").alias("note"), F.col("doc_id").alias("ord"),
    )


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "code string, name string, status string, kit_total int, ord int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    lang = F.element_at(F.array(*map(F.lit, LANGS)), F.col("k") % 5 + 1)
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("event_id").alias("seq"), "event_type", lang.alias("lang"), (F.col("k") % 8 + 1).alias("theme"), F.col("k").cast("string").alias("item_id"), "value"
    )


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes but last_lang, which last_lang_log() adds."""
    sizes = phrases(spark, sf_dir).groupBy(F.col("file_lang").alias("lang"), "theme").agg(F.count("*").alias("n"))
    rows = events(spark, sf_dir).join(F.broadcast(sizes), ["lang", "theme"], "left")
    place = clamped(F.floor("value").cast("int"), F.coalesce("n", F.lit(0)))
    kind = F.col("event_type")
    op = F.when(kind == "view", state.POSITION).when(kind == "click", state.STAR).when(kind == "signup", state.ACK).when(kind == "purchase", state.NOTE)
    payload = F.when(kind == "view", place.cast("string")).when(kind == "signup", F.lit("1")).when(kind == "purchase", F.concat(F.lit("note "), F.floor("value").cast("string")))
    return rows.select("seq", op.alias("op"), "lang", "theme", "item_id", payload.alias("payload")).filter(F.col("op").isNotNull())


def last_lang_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view opens its language; it is noted only if the language has phrases."""
    have = table(spark, sf_dir, "documents").select("lang", F.lit("ok").alias("status")).distinct()
    return state.save_opened(events(spark, sf_dir).filter("event_type = 'view'").select("seq", "lang"), have)


def label_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    return docs.join(good, "doc_id", "left_semi").select("lang", F.col("doc_id").cast("string").alias("item_id"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by place from 0."""
    from ..operators.ranking import numbered

    rows = table(spark, sf_dir, "part").withColumn("one", F.lit(1))
    ranked = numbered(rows, ["one"], "p_partkey")
    return ranked.select((F.col("rn") - 1).alias("ord"), F.col("p_size").cast("string").alias("value"), F.col("p_name").alias("you_say"), F.lit("").alias("note"))
