"""Scalar functions: the inherited assertions and edge cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("current,total,nxt,prev", [(0, 5, 1, 4), (4, 5, 0, 3), (0, 0, 0, 0), (1, 5, 2, 0), (-5, 3, -1, 0)])
def test_wrap(spark, current, total, nxt, prev):
    assert value(spark, X.next_index(F.lit(current), F.lit(total))) == nxt
    assert value(spark, X.prev_index(F.lit(current), F.lit(total))) == prev


def test_label(spark):
    assert value(spark, X.progress_label(F.lit(18), F.lit(40))) == "18/40"


@pytest.mark.parametrize("said,ok", [("OH-lah", True), ("BWEH-nos DEE-ahs", True), ("oh-lah", False), ("", False), ("  É ", False), (" Éa ", True)])
def test_you_say(spark, said, ok):
    assert value(spark, X.valid_you_say(F.lit(said))) is ok


@pytest.mark.parametrize("raw,want", [("7", 7), ("+7", 7), ("-2", -2), (" 7 ", None), ("x", None), ("", None), ("99999999999", None), ("7\n", None)])
def test_int(spark, raw, want):
    assert value(spark, X.int_or_null(F.lit(raw))) == want


def test_percent_is_single_precision_and_uncapped(spark):
    share = X.fraction(F.lit(42), F.lit(40))
    assert value(spark, X.percent(share)) == 104
    assert value(spark, X.fraction(F.lit(3), F.lit(0))) == 0
    assert value(spark, X.tile_label(F.lit(0), F.lit(0.0).cast("float"))) == "START"


@pytest.mark.parametrize("said,ok", [("×", True), ("Þ", False), ("Š", False), ("aB", True)])
def test_lint_caps(spark, said, ok):
    assert value(spark, X.lint_caps(F.lit(said))) is ok


@pytest.mark.parametrize("day,ok", [("2026-99-99", True), ("2026-11-06\n", False), ("2026-1-1", False)])
def test_lint_date(spark, day, ok):
    assert value(spark, X.lint_date(F.lit(day))) is ok


def test_search_is_literal(spark):
    for term, ok in (("%", True), ("5%", False), ("50% OFF", True), ("_", False), (" off", True)):
        assert value(spark, X.contains_fold(F.lit("50% off"), term)) is ok


def test_blank(spark):
    for said, ok in (("", True), ("\t  ", True), ("a", False)):
        assert value(spark, X.is_blank(F.lit(said))) is ok
