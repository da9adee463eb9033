"""Scalar functions on Columns: blanks, literal search, labels, positions, lint patterns. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the content rules. Fixed values.
BLANK = r"(?U)^\s*$"
EDGES = r"(?U)^\s+|\s+$"
UPPERCASE = r"\p{IsUppercase}"
BEYOND = r"[\x{10000}-\x{10FFFF}]"
LINT_CAPS = "[A-ZÀ-Ý]"
LINT_DATE = r"^\d{4}-\d{2}-\d{2}\z"
INTEGER = r"^[+-]?[0-9]+\z"


def is_blank(c: Column) -> Column:
    return c.rlike(BLANK)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def fold_pattern(term: str) -> str:
    """A pattern that finds the term literally, character by character: two characters are equal if they are, or if the lower cases of their upper cases are. So
    dotted and dotless i, long s and the Kelvin sign meet i, s and k, while a sharp s meets no double s. Characters beyond U+FFFF keep their case apart, as each
    counts as two characters that have none."""
    quoted = [f"\\x{{{ord(c):x}}}" if ord(c) <= 0xFFFF else f"(?-i:\\x{{{ord(c):x}}})" for c in term]
    return "(?iu)" + "".join(quoted)


def contains_fold(c: Column, term: str) -> Column:
    """Whether the text holds the term, literally, in any case of each character; the term isn't trimmed."""
    return c.rlike(fold_pattern(term))


def matches_any(columns: list[Column], term: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(contains_fold(c, term), F.lit(False))
    return found


def int_or_null(c: Column) -> Column:
    """Digits with an optional sign and nothing else, within int; else null."""
    return F.when(c.rlike(INTEGER), c.try_cast("int"))


def clamped(position: Column, count: Column) -> Column:
    return F.least(F.greatest(position, F.lit(0)), F.greatest(count - 1, F.lit(0)))


def next_index(current: Column, total: Column) -> Column:
    """Wraps around; 0 where there is nothing. The remainder has the dividend's sign."""
    return F.when(total <= 0, F.lit(0)).otherwise((current + 1) % F.when(total > 0, total))


def prev_index(current: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0)).otherwise((current - 1 + total) % F.when(total > 0, total))


def progress_label(done: Column, total: Column) -> Column:
    return F.format_string("%d/%d", done, total)


def fraction(viewed: Column, total: Column) -> Column:
    """In single precision; 0 without a total; may exceed 1."""
    return F.when(total <= 0, F.lit(0.0).cast("float")).otherwise((viewed.cast("float") / F.when(total > 0, total).cast("float")).cast("float"))


def percent(share: Column) -> Column:
    """Truncated, in single precision, not capped at 100."""
    return (share * F.lit(100.0).cast("float")).cast("float").cast("int")


def tile_label(viewed: Column, share: Column) -> Column:
    return F.when(viewed == 0, F.lit("START")).otherwise(F.concat(percent(share).cast("string"), F.lit("%")))


def two_digits(c: Column) -> Column:
    return F.format_string("%02d", c)


def valid_you_say(c: Column) -> Column:
    """At least two characters after trimming, and an uppercase one. A character beyond U+FFFF counts as two."""
    return ((F.char_length(trimmed(c)) >= 2) | trimmed(c).rlike(BEYOND)) & trimmed(c).rlike(UPPERCASE)


def lint_caps(c: Column) -> Column:
    return c.rlike(LINT_CAPS)


def lint_date(c: Column) -> Column:
    """The shape of a date only."""
    return c.rlike(LINT_DATE)
