"""Phrases stored by language, so that languages which can't matter are never opened.

A stored table is partitioned by file_lang; a language's rows lie in ranges of theme and place, so a large language is several files. What decides about languages, the catalog
and the languages that have stars, has a row a language and is looked at by the driver; then the scan opens only the partitions that are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import kept
from .phrases import SOFT_LIMIT, _hit
from .phrases import hard_deck as deck_of

ROWS = "id string, lang string, theme int, english string, romanization string, you_say string, sound_tip string, note string, ord long, file_lang string"


def store(phrases: DataFrame, path: str) -> None:
    """Replaces the stored table. Phrases without a language are of no catalog's and left out."""
    rows = phrases.filter(F.col("file_lang").isNotNull()).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in ROWS.split(", ")))
    ranged = rows.repartitionByRange(int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_lang", "theme", "ord").sortWithinPartitions("file_lang", "theme", "ord")
    ranged.write.mode("overwrite").partitionBy("file_lang").parquet(path)


def stored(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """The stored phrases, of these languages only if they are given."""
    rows = spark.read.schema(ROWS).parquet(path)
    return rows if langs is None else rows.filter(F.col("file_lang").isin(langs) if langs else F.lit(False))


def hard_deck(catalog: DataFrame, path: str, stars: DataFrame) -> DataFrame:
    """Starred phrases of catalog languages; languages without stars aren't opened."""
    starred = stars.select(F.col("lang").alias("code")).distinct().join(catalog.select("code"), "code", "left_semi")
    langs = sorted(r.code for r in starred.collect())  # at most the catalog's languages
    return deck_of(catalog, stored(catalog.sparkSession, path, langs), stars)


def search(catalog: DataFrame, path: str, term: str, limit: int = SOFT_LIMIT) -> DataFrame:
    """Hits in catalog order with cat_ord. Languages are opened in that order, twice as many at a time as the time before, until those searched have brought more than `limit` hits;
    a language isn't cut. Each opened language is read once: its hits are kept. A blank term opens nothing."""
    spark = catalog.sparkSession
    order = [(r.code, r.ord) for r in catalog.select("code", "ord").orderBy("ord", "code").collect()] if term.strip() else []
    found = stored(spark, path, []).withColumn("cat_ord", F.lit(None).cast("int"))
    total, at, width = 0, 0, 1
    while at < len(order) and total <= limit:
        group = order[at : at + width]
        hits = kept(stored(spark, path, [c for c, _ in group]).filter(_hit(term)), "hits")
        counts = {r.file_lang: r.n for r in hits.groupBy("file_lang").agg(F.count("*").alias("n")).collect()}
        listed = []
        for code, ord_ in group:
            if total > limit:
                break
            listed.append((code, ord_))
            total += counts.get(code, 0)
        # a language that the catalog lists twice is searched twice
        found = found.unionByName(hits.join(F.broadcast(spark.createDataFrame(listed, "file_lang string, cat_ord int")), "file_lang"))
        at, width = at + width, 2 * width
    return found
