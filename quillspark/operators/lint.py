"""The content rules: each line's violations as rows, and totals per file.

A rule's `missing` covers what the content's authors leave out in any way: no key, null, false, zero, an empty array, text without a visible character. The rules on
patterns pass over what is absent (no key, null, false, zero, empty text), but not over white space or an empty array, which are two errors then.
A line that holds JSON null counts as bad JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import PHRASE
from ..functions.text import is_blank, lint_caps, lint_date

BAD_JSON, MISSING, CAPS, DATE = "bad_json", "missing", "no_caps", "bad_date"


def _absent(key: str) -> Column:
    """No key, null, false, zero or empty text: what no pattern is asked of."""
    value = F.try_variant_get("v", f"$.{key}", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get("v", f"$.{key}", "string")
    zero = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (text.try_cast("double") == 0)
    return F.coalesce(kind.isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | zero | ((kind == "STRING") & (text == "")), F.lit(False))


def _missing(key: str) -> Column:
    """Absent, or nothing but white space as text; an empty array is that too."""
    kind, text = F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")), F.try_variant_get("v", f"$.{key}", "string")
    return _absent(key) | F.coalesce(is_blank(text) | (kind == "ARRAY<VOID>") & (text == "[]"), F.lit(False))


def _said(key: str) -> Column:
    """The value as text; an empty array has none."""
    text = F.try_variant_get("v", f"$.{key}", "string")
    return F.when(text == "[]", F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def violations(lines: DataFrame) -> DataFrame:
    """(file, line_no, rule, key) of (file, line_no, line)."""
    read = lines.withColumn("v", F.try_parse_json("line")).withColumn("bad", F.col("v").isNull() | (F.schema_of_variant("v") == "VOID"))
    rule = lambda name, key: F.struct(F.lit(name).alias("rule"), F.lit(key).alias("key"))
    found = [F.when(F.col("bad"), rule(BAD_JSON, ""))]
    found += [F.when(~F.col("bad") & _missing(k), rule(MISSING, k)) for k in PHRASE]
    found += [F.when(~F.col("bad") & ~_absent("youSay") & ~lint_caps(_said("youSay")), rule(CAPS, "youSay"))]
    found += [F.when(~F.col("bad") & ~_absent("checked") & ~lint_date(_said("checked")), rule(DATE, "checked"))]
    return read.select("file", "line_no", F.explode(F.array_compact(F.array(*found))).alias("x")).select("file", "line_no", "x.rule", "x.key")


def summary(lines: DataFrame, found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, rows, errors, ok) of every file of `files`, or of those that have lines."""
    rows = lines.groupBy("file").agg(F.count("*").alias("rows"))
    if files is not None:
        rows = files.select("file").distinct().join(rows, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))
    errors = found.groupBy("file").agg(F.count("*").alias("errors"))
    joined = rows.join(errors, "file", "left").withColumn("errors", F.coalesce("errors", F.lit(0)).cast("long"))
    return joined.withColumn("ok", F.col("errors") == 0)


def passes(summed: DataFrame) -> DataFrame:
    """One row: files, errors, and whether the content may be released; no file at all may not, a file without lines may."""
    return summed.agg(F.count("*").alias("files"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")).withColumn("ok", (F.col("files") > 0) & (F.col("errors") == 0))
