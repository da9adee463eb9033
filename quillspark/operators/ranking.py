"""Numbering rows within a key, or over a whole table, without gathering a key's rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that a table is dealt into at most, and rows looked at to place a cut between two of them.
MOST, LOOKED = 4096, 16


def _cuts(df: DataFrame, columns: list[str], pieces: int, n: int) -> tuple[Column, int]:
    """An array of places (structs of the columns) that cut the n rows, sorted, into about even pieces, and its size. They are quantiles of the rows with the smallest hashes,
    LOOKED for each piece: a bounded sample, and the same one each time. A threshold that some more rows meet keeps all others where they are."""
    rows, most, h = df.select(*columns), LOOKED * pieces, F.xxhash64(*columns)
    few = rows if n <= 2 * most else rows.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 1.5 * most / n))
    seen = few.orderBy(h).limit(most).orderBy(*columns)
    text = [r.j for r in seen.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).collect()]
    chosen = list(dict.fromkeys(text[i * len(text) // pieces] for i in range(1, pieces))) if text else []
    return F.from_json(F.lit(f"[{','.join(chosen)}]"), f"array<{rows.select(F.struct(*columns).alias('s')).schema['s'].dataType.simpleString()}>"), len(chosen)


def _piece(place: Column, cuts: Column, n: int) -> Column:
    """How many cuts are at or before the place, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(int(math.log2(n)) if n else 0, -1, -1)))
    fits = lambda at: (at <= n) & (F.get(cuts, at - 1) <= place)
    return F.aggregate(steps, F.lit(0), lambda have, k: F.when(fits(have + k), have + k).otherwise(have)) if n else F.lit(0)


def numbered(df: DataFrame, keys: list[str], ord_: str | list[str], name: str = "rn", block: int = 65536) -> DataFrame:
    """row_number() over (keys, ordered by ord_), from 1; without keys, over the table. ord_ tells the rows of a key apart; nulls come first.

    Rows are dealt into pieces of about `block` rows by cuts through the order of (keys, ord_), quantiles of a sample, so neither a key with most rows nor numbers that crowd in one
    stretch or lie far off make a piece large. A piece's rows are numbered by one task, key by key, and shifted by the sizes of the same key's earlier pieces (a table
    of at most a row a key and one a piece). The sample decides how even pieces are and nothing else. A table of one piece needs no cut."""
    order = [ord_] if isinstance(ord_, str) else list(ord_)
    total = df.count()
    pieces = min(-(-total // block), MOST)
    if pieces < 2:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)).cast("long"))
    cuts, n = _cuts(df, [*keys, *order], pieces, total)
    cut = df.withColumn("_piece", _piece(F.struct(*keys, *order), cuts, n))
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(shifts, same).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).select(*df.columns, name)
