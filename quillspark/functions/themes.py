"""The fixed dimension of themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Theme numbers and names. Fixed values.
THEMES = [(1, "Greetings"), (2, "Politeness"), (3, "Numbers"), (4, "Food"), (5, "Directions"), (6, "Shopping"), (7, "Emergency"), (8, "Connection")]
#: The theme that leads to the numbers page.
NUMBERS_THEME = 3


def theme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THEMES, "theme int, theme_name string")
