"""The corpus pipeline over `documents`: language ID, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, in their order and with whatever names; where a stage changes texts, n_chars follows.

| stage | null or empty text | repeated rows | null doc_id |
| --- | --- | --- | --- |
| language_id | rejected, as is text without a letter | each judged alike | stays |
| line_dedup | one empty line: stays as '' | a doc_id's rows are one document | one document, after all others |
| ngram_join | an empty set: stays, linked with nothing | one stays | represents a group only if the group has no other |
| suffix_dedup | stays as '' | copies of each other: their windows go | stays |
| packing | one piece, the end id alone | each packed | stays |

Suffix dedup takes windows of 50 words here and not of 400 bytes: a passage of over 50 words is usually shorter than 400 bytes. White space between words
doesn't matter then. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language_id, line_dedup, ngram_join, packing, suffix_dedup
from quillspark.llm.common import written

#: A text is rejected if it has no letter or its language's score isn't this share of the way from 1 / languages, the best score of a text that fits all
#: languages equally, to 1. With the four languages of `documents` that is a score below 0.3.
LEAST_SURE = 1 / 15


def _with_text(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of `docs`, which are the first of `done`, with the last column of `done` as text. Columns are taken by place, so their names may clash."""
    plain = done.toDF(*(f"_{i}" for i in range(len(done.columns))))
    kept = F.col(plain.columns[-1])
    new = {"text": kept, "n_chars": F.char_length(kept).cast("long")}
    return plain.select(*(new.get(c, F.col(f"_{i}")).alias(f"_{i}") for i, c in enumerate(docs.columns))).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fitted(docs)
    even = 1 / max(1, len(model.languages))
    return language_id.accepted(docs, model, even + LEAST_SURE * (1 - even))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, line_dedup.with_kept_text(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, suffix_dedup.deduplicated(docs, kind=suffix_dedup.WORDS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary_path(packing.VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_near),
    ("suffix_dedup", dedup_passages),
    ("packing", pack),
]
#: Language ID, the Jaccard join, suffix dedup and tokenisation have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
