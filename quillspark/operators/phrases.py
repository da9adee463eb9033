"""What the pages of a phrasebook show: progress, lessons, cards, search, the hard deck, numbers.

Phrases are (id, file_lang, lang, theme, english, romanization, you_say, sound_tip, note, ord), the catalog is (code, name, status, kit_total, ord). A phrase
belongs to the language of its file; `lang` is what is shown. Catalog, themes and per-language sums have at most a few rows a language and are joined
as broadcasts where Spark sees their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fraction, is_blank, matches_any, percent, tile_label, two_digits
from ..functions.themes import NUMBERS_THEME, theme_table
from .ranking import numbered

COMMITTED = "committed"
#: A search stops after the language in which its hits pass this number.
SOFT_LIMIT = 60
FIRST_NUMBERS, LATER_NUMBERS = 21, ("100", "1000")


def progress(catalog: DataFrame, phrases: DataFrame, positions: DataFrame) -> DataFrame:
    """(code, ord, viewed, total): positions + 1 summed over themes that have one; phrases, or the kit's size if that is larger."""
    have = phrases.groupBy("file_lang").agg(F.count("*").alias("phrases"))
    seen = positions.groupBy("lang").agg(F.sum(F.col("position") + 1).alias("seen"))
    joined = catalog.join(have, catalog.code == have.file_lang, "left").join(seen, catalog.code == seen.lang, "left")
    return joined.select(
        "code", "name", "status", "ord",
        F.coalesce("seen", F.lit(0)).cast("long").alias("viewed"),
        F.greatest(F.coalesce("phrases", F.lit(0)), F.col("kit_total")).cast("long").alias("total"),
    )


def tiles(progressed: DataFrame) -> DataFrame:
    share = fraction(F.col("viewed"), F.col("total"))
    return progressed.select(
        "code", "name", "status", "ord", "viewed", "total", share.alias("fraction"), percent(share).alias("percent"),
        F.format_string("[%d/%d]", "viewed", "total").alias("counts"), tile_label(F.col("viewed"), share).alias("label"),
    )


def home_order(rows: DataFrame) -> DataFrame:
    """Adds `place`: the committed languages by name, then all others by name; equal names keep the catalog's order. Numbered by ranges of that order, so
    rows are nowhere gathered whole."""
    group = F.coalesce(F.col("status") != COMMITTED, F.lit(True))
    placed = numbered(rows.withColumn("bench", group), [], ["bench", "name", "ord"], "place")
    return placed.withColumn("place", F.col("place").cast("int"))


def lesson_counts(phrases: DataFrame, lang: str) -> DataFrame:
    """Every theme with its number of phrases, none as 0, and the lesson's labels."""
    counts = phrases.filter(F.col("file_lang") == lang).groupBy("theme").agg(F.count("*").alias("n"))
    rows = theme_table(phrases.sparkSession).join(counts, "theme", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    button = F.when(F.col("theme") == NUMBERS_THEME, F.lit("OPEN")).otherwise(F.format_string("[%d PHRASES]", "n"))
    return rows.select("theme", "theme_name", "n", two_digits(F.col("theme")).alias("no"), button.alias("button"))


def theme_name(rows: DataFrame) -> DataFrame:
    """Adds theme_name, empty for an unknown theme."""
    return rows.join(F.broadcast(theme_table(rows.sparkSession)), "theme", "left").withColumn("theme_name", F.coalesce("theme_name", F.lit("")))


def theme_header(rows: DataFrame) -> DataFrame:
    """(file_lang, theme, title, count) of the rows that are visible."""
    counted = theme_name(rows.groupBy("file_lang", "theme").agg(F.count("*").alias("n")))
    return counted.select("file_lang", "theme", F.format_string("%02d %s", "theme", "theme_name").alias("title"), F.format_string("[%d PHRASES]", "n").alias("shown"))


def in_theme(phrases: DataFrame, theme: int, term: str) -> DataFrame:
    """All of a theme for a blank term, else those in which one of three columns holds it."""
    rows = phrases.filter(F.col("theme") == theme)
    return rows if not term.strip() else rows.filter(_hit(term))


def _hit(term: str) -> Column:
    return matches_any([F.col("english"), F.col("romanization"), F.col("you_say")], term)


def marked(phrases: DataFrame, stars: DataFrame) -> DataFrame:
    """Adds is_starred. Stars are (lang, item_id), each once; their language is the file's."""
    s = stars.select(F.col("lang").alias("file_lang"), F.col("item_id").alias("id"), F.lit(True).alias("is_starred"))
    return phrases.join(s, ["file_lang", "id"], "left").withColumn("is_starred", F.coalesce("is_starred", F.lit(False)))


def cards(phrases: DataFrame, stars: DataFrame) -> DataFrame:
    rows = marked(numbered(phrases, ["file_lang", "theme"], "ord"), stars)
    shown = lambda c: F.when(~is_blank(F.col(c)), F.col(c))
    return rows.select(
        "file_lang", "theme", "id", "rn", F.format_string("%d. %s", "rn", "english").alias("title"), "you_say", shown("sound_tip").alias("tip"), shown("note").alias("note"),
        F.when(F.col("is_starred"), F.lit("Hard ★")).otherwise(F.lit("Mark hard")).alias("star_label"),
    )


def glue_line() -> Column:
    return F.concat_ws(" — ", "english", "you_say")


def hard_deck(catalog: DataFrame, phrases: DataFrame, stars: DataFrame) -> DataFrame:
    """Starred phrases of catalog languages; a star without a phrase is left out. A language that the catalog lists twice comes once, at its first place."""
    s = stars.select(F.col("lang").alias("file_lang"), F.col("item_id").alias("id"))
    listed = catalog.groupBy(F.col("code").alias("file_lang")).agg(F.min("ord").alias("cat_ord"))
    rows = phrases.join(s, ["file_lang", "id"], "left_semi").join(listed, "file_lang")
    return rows.select("cat_ord", "ord", "file_lang", "id", "english", "you_say", F.concat(F.upper("lang"), F.lit(" · "), F.col("id")).alias("caption"))


def star_count(catalog: DataFrame, stars: DataFrame) -> DataFrame:
    """All stars of catalog languages, with or without a phrase."""
    return stars.join(catalog.select("code"), stars.lang == F.col("code"), "left_semi").agg(F.count("*").alias("stars"))


def search(catalog: DataFrame, phrases: DataFrame, term: str, limit: int = SOFT_LIMIT) -> DataFrame:
    """Hits in catalog order. A language is searched only if those before it brought at most `limit` hits; a language isn't cut. A blank term finds nothing.

    Only counts per language meet in the running sum; the hits are read once more with the languages that count."""
    hits = phrases.filter(_hit(term) if term.strip() else F.lit(False))
    have = hits.groupBy("file_lang").agg(F.count("*").alias("n"))
    listed = catalog.join(have, catalog.code == have.file_lang).select("file_lang", F.col("ord").alias("cat_ord"), "n")
    before = F.coalesce(F.sum("n").over(Window.orderBy("cat_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = listed.withColumn("before", before).filter(F.col("before") <= limit).select("file_lang", "cat_ord")
    return hits.join(F.broadcast(open_), "file_lang")


def search_rows(hits: DataFrame) -> DataFrame:
    return hits.select("id", "english", "you_say", F.upper("lang").alias("lang_label"))


def numbers_grid(numbers: DataFrame) -> DataFrame:
    """The first numbers by place. Numbers are (ord from 0, value, you_say, note)."""
    return numbers.filter(F.col("ord") < FIRST_NUMBERS).select("ord", "value", "you_say", "note")


def numbers_tail(numbers: DataFrame, values: tuple[str, ...] = LATER_NUMBERS) -> DataFrame:
    """Of the rest, only these values."""
    return numbers.filter((F.col("ord") >= FIRST_NUMBERS) & F.col("value").isin(*values)).select("ord", "value", "you_say")


def titles(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Names of (code): the catalog's first, else the code in capitals."""
    first = catalog.groupBy("code").agg(F.min_by("name", "ord").alias("name"))
    title = F.when(F.col("code").isNotNull(), F.coalesce("name", F.upper("code")))
    return codes.join(first, "code", "left").select("code", title.alias("title"))


def shown_title(title: Column, code: Column) -> Column:
    """A blank title is shown as the code in capitals."""
    return F.when(is_blank(title), F.upper(code)).otherwise(title)


def briefing(sounds: DataFrame, acks: DataFrame) -> DataFrame:
    """Sound checks of languages that aren't acknowledged, with the briefing's lines."""
    rows = sounds.join(acks, "lang", "left").filter(~F.coalesce("acked", F.lit(False)))
    return rows.select("lang", "new_sounds", F.concat_ws(" — ", "rhythm", "register_first").alias("rhythm_line"), "trap")
