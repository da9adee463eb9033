"""Queries over what is stored: the state log with its snapshots and its stream, phrases by language; and over places, folds and blanks that the others don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_fold, prev_index
from ..operators import lint, phrases, state, stored
from ..operators.ranking import numbered
from ..sources import files
from ..sources.folders import shared_folder
from ..streaming import state as streamed
from . import content
from . import driver_tables as d
from .driver_tables import CAT_SQL, EV_SQL, LANGS, P_SQL, POS_SQL, STAR_SQL

TERM, LATE_TERM, ONE_LANG = "que", "que la", "fr"
#: Rows of a piece in the queries on places, so that the given tables make several.
PIECE = 500
#: Letters that fold to others one by one, and what they fold to: dotted I, dotless i, long s, Kelvin sign. Sharp s folds to itself.
ODD, PLAIN = "\u0130\u0131\u017f\u212a", "iisk"


def _written(spark, sf, parts: int = 3, again: bool = False) -> str:
    """The state log of the events, in as many batches; `again` appends the first once more."""
    log, rows = shared_folder(spark, "log"), d.state_log(spark, sf)
    for part in [*range(parts), *([0] if again else [])]:
        state.append(rows.filter(F.col("seq") % parts == part), log)
    return log


def state_appended_twice(spark, sf):
    """A batch that is appended twice counts once."""
    return state.stars(state.read_log(spark, _written(spark, sf, again=True)))


def state_snapshot(spark, sf):
    """Two snapshots and a batch after them, folded: places and stars of all languages."""
    log, rows = shared_folder(spark, "log"), d.state_log(spark, sf)
    for part in range(3):
        state.append(rows.filter(F.col("seq") % 3 == part), log)
        if part < 2:
            state.compact(spark, log)
    now = state.as_log(state.current(spark, log))
    places = state.positions(now).select("lang", F.col("theme").cast("string").alias("item"), F.col("position").cast("string").alias("value"))
    return places.unionByName(state.stars(now).select("lang", F.concat(F.lit("*"), "item_id").alias("item"), F.lit("on").alias("value")))


def state_point_read(spark, sf):
    """One language's places, of the snapshot's partitions for it and the batch after it."""
    log, rows = shared_folder(spark, "log"), d.state_log(spark, sf)
    state.append(rows.filter("seq % 2 = 0"), log)
    state.compact(spark, log)
    state.append(rows.filter("seq % 2 = 1"), log)
    return state.positions(state.as_log(state.current(spark, log, state.POSITION, ONE_LANG)))


def state_observed(spark, sf):
    """What a stream over the log tells last of each place and star: the later half of the log comes first, the stream is then started anew for the rest."""
    log, out, checkpoint = (shared_folder(spark, x) for x in ("log", "told", "stream"))
    rows = d.state_log(spark, sf).filter(F.col("op").isin(state.POSITION, state.STAR))
    for part in (1, 0):
        state.append(rows.filter(F.col("seq") % 2 == part), log)
        streamed.follow(streamed.read_log(spark, log), out, checkpoint).awaitTermination()
    held = streamed.told(spark, out).filter("op <> 'star_toggle' OR value = 'on'")
    return held.select("op", "lang", "theme", "item_id", "value")


def state_notes_written(spark, sf):
    log = shared_folder(spark, "log")
    bought = d.events(spark, sf).filter("event_type = 'purchase'").select("seq", "lang", "item_id", F.when(F.col("seq") % 4 > 0, F.concat(F.lit("note "), F.floor("value").cast("string"))).alias("text"))
    for part in range(2):
        state.append(state.save_notes(bought.filter(F.col("seq") % 2 == part)), log)
    return state.notes(state.read_log(spark, log))


def _stored(spark, sf) -> str:
    path = shared_folder(spark, "phrases")
    stored.store(d.phrases(spark, sf), path)
    return path


def search_stored(spark, sf):
    return stored.search(d.catalog(spark), _stored(spark, sf), TERM).select("cat_ord", "ord", "id", "file_lang")


def search_stored_on(spark, sf):
    """A term of fewer hits: further languages are opened."""
    return stored.search(d.catalog(spark), _stored(spark, sf), LATE_TERM).select("cat_ord", "ord", "id", "file_lang")


def deck_stored(spark, sf):
    deck = stored.hard_deck(d.catalog(spark), _stored(spark, sf), state.stars(d.state_log(spark, sf)))
    return deck.select("cat_ord", "ord", "file_lang", "id", "caption")


def search_without_catalog(spark, sf):
    """Hits by language with the catalog, and with one whose file is missing: none, and no error."""
    none, status = files.load_catalog(spark, shared_folder(spark, "none"))
    rows = d.phrases(spark, sf)
    count = lambda name, found: found.groupBy("file_lang").agg(F.count("*").alias("hits")).select(F.lit(name).alias("catalog"), "file_lang", "hits")
    told = status.select(F.lit("gone").alias("catalog"), F.col("status").alias("file_lang"), F.col("rows").alias("hits"))
    return count("there", phrases.search(d.catalog(spark), rows, LATE_TERM)).unionByName(count("gone", phrases.search(none, rows, LATE_TERM))).unionByName(told)


def step_back_visible(spark, sf):
    """The place before of each open theme: it wraps over the phrases that the query leaves, and is kept against the theme."""
    open_ = state.positions(d.state_log(spark, sf))
    hits = d.phrases(spark, sf).filter(phrases._hit(content.STEP_TERM)).groupBy(F.col("file_lang").alias("lang"), "theme").agg(F.count("*").cast("int").alias("visible"))
    n = F.coalesce("visible", F.lit(0))
    rows = open_.join(hits, ["lang", "theme"], "left").select(F.lit(0).cast("long").alias("seq"), "lang", "theme", prev_index(F.col("position"), n).alias("wanted"), n.alias("n"))
    return state.positions(state.save_positions(rows))


def source_detail(spark, sf):
    """What is said of content files that can't be shown."""
    return content._phrases(spark, sf)[1].filter("status <> 'ok'").select("asset", "status", "detail")


def source_lint_summary(spark, sf):
    """Every content file, with or without lines."""
    folder = content._folder(spark, sf)
    lines = files.lines_of(spark, folder)
    return lint.summary(lines, lint.violations(lines), files.files_of(spark, folder))


def _blank_lines(spark, sf) -> DataFrame:
    """Documents as content lines whose youSay and checked are white space, an empty array, empty, null, zero or sound, in turns."""
    docs = d.table(spark, sf, "documents")
    odd = lambda c, sound: F.element_at(F.array(*(F.lit(x) for x in ('"  "', "[]", '""', "null", "0", f'"{sound}"'))), (c % 6 + 1).cast("int"))
    head = '{"id":"i","lang":"l","theme":1,"english":"e","romanization":"r","soundTip":"t","note":"n","source":"s","youSay":'
    line = F.concat(F.lit(head), odd(F.col("doc_id"), "OH"), F.lit(',"checked":'), odd(F.floor(F.col("doc_id") / 6), "2026-01-02"), F.lit("}"))
    return docs.select(F.concat("lang", F.lit(".jsonl")).alias("file"), F.col("doc_id").alias("line_no"), line.alias("line"))


def lint_blank_values(spark, sf):
    return lint.violations(_blank_lines(spark, sf))


def phrase_tips(spark, sf):
    """Cards whose tips and notes are now blank, now not."""
    rows = d.phrases(spark, sf).withColumn("sound_tip", F.when(F.col("ord") % 3 == 0, F.col("romanization")).otherwise(F.lit(" \t"))).withColumn("note", F.when(F.col("ord") % 2 == 0, F.concat(F.lit(" "), "id")).otherwise(F.lit("")))
    return phrases.cards(rows, d.label_stars(spark, sf)).select("id", "tip", "note", "star_label")


def price_places(spark, sf):
    """Places within a key by two columns, over cuts."""
    rows = d.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return numbered(rows, ["o_orderstatus"], ["o_totalprice", "o_orderkey"], "place", PIECE).select("o_orderkey", "o_orderstatus", "place")


def customer_places(spark, sf):
    """Places in a whole table by text and number, over cuts."""
    rows = d.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return numbered(rows, [], ["c_mktsegment", "c_acctbal", "c_custkey"], "place", PIECE).select("c_custkey", "place")


def far_places(spark, sf):
    """Numbers that crowd, with a few very far off."""
    far = F.when(F.col("event_id") % 1000 == 7, F.col("event_id") * 1_000_000_000_000).otherwise(F.col("event_id"))
    rows = d.table(spark, sf, "events").select("event_id", "event_type", far.alias("at"))
    return numbered(rows, ["event_type"], "at", "place", PIECE).select("event_id", "place")


def search_fold(spark, sf):
    """Names spelled with letters that fold one by one, and terms likewise."""
    letters = F.translate("n_name", "ISK", ODD[0] + ODD[2] + ODD[3])
    names = d.table(spark, sf, "nation").select("n_nationkey", F.concat(letters, F.lit("\u00df"), F.translate(F.lower("n_name"), "i", ODD[1])).alias("name"))
    found = {"plain": "ia", "dotted": ODD[0] + "N", "dotless": "n" + ODD[1], "long_s": "u" + ODD[2], "kelvin": ODD[3] + "e", "double_s": "ss", "sharp_s": "\u00df"}
    return names.select("n_nationkey", *(contains_fold(F.col("name"), term).alias(k) for k, term in found.items()))


def _folded(x: str) -> str:
    return f"lower(translate({x}, '{ODD}', '{PLAIN}'))"


_NAME = f"translate(n_name, 'ISK', '{ODD[0]}{ODD[2]}{ODD[3]}') || '\u00df' || translate(lower(n_name), 'i', '{ODD[1]}')"
_HITS = "SELECT * FROM p WHERE contains(lower(english), '{t}') OR contains(lower(romanization), '{t}') OR contains(lower(you_say), '{t}')"
_SEARCH = """WITH {p}, {c}, h AS ({h}), n AS (SELECT file_lang, count(*) AS n FROM h GROUP BY 1),
  o AS (SELECT file_lang, cat.ord AS cat_ord, coalesce(sum(n) OVER (ORDER BY cat.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n JOIN cat ON code = file_lang)"""
_search = lambda term: _SEARCH.format(p=P_SQL, c=CAT_SQL, h=_HITS.format(t=term))
_OPEN = " SELECT cat_ord, h.ord, id, h.file_lang FROM h JOIN o ON o.file_lang = h.file_lang WHERE before <= 60"
_ODD = """x AS (SELECT lang || '.jsonl' AS file, doc_id AS line_no, doc_id % 6 AS y, doc_id // 6 % 6 AS c FROM documents)"""
SQL = {
    "state_appended_twice": f"WITH {EV_SQL}, {STAR_SQL} SELECT lang, item_id FROM st",
    "state_snapshot": f"""WITH {P_SQL}, {EV_SQL}, {POS_SQL}, {STAR_SQL} SELECT lang, CAST(theme AS VARCHAR) AS item, CAST(position AS VARCHAR) AS value FROM pos
      UNION ALL SELECT lang, '*' || item_id, 'on' FROM st""",
    "state_point_read": f"WITH {P_SQL}, {EV_SQL}, {POS_SQL} SELECT lang, theme, CAST(position AS INTEGER) AS position FROM pos WHERE lang = '{ONE_LANG}'",
    "state_observed": f"""WITH {P_SQL}, {EV_SQL}, {POS_SQL}, {STAR_SQL} SELECT 'position' AS op, lang, theme, CAST(NULL AS VARCHAR) AS item_id, CAST(position AS VARCHAR) AS value FROM pos
      UNION ALL SELECT 'star_toggle', lang, NULL, item_id, 'on' FROM st""",
    "state_notes_written": f"""WITH {EV_SQL} SELECT lang, item_id, max_by(CASE WHEN seq % 4 > 0 THEN 'note ' || CAST(floor("value") AS BIGINT) ELSE '' END, seq) AS note
      FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2""",
    "search_stored": _search(TERM) + _OPEN,
    "search_stored_on": _search(LATE_TERM) + _OPEN,
    "deck_stored": f"""WITH {P_SQL}, {CAT_SQL}, {EV_SQL}, {STAR_SQL} SELECT cat.ord AS cat_ord, p.ord, file_lang, id, upper(file_lang) || ' \u00b7 ' || id AS caption
      FROM p JOIN st ON st.lang = file_lang AND st.item_id = id JOIN cat ON code = file_lang""",
    "search_without_catalog": _search(LATE_TERM) + """ SELECT 'there' AS catalog, o.file_lang, count(*) AS hits FROM h JOIN o ON o.file_lang = h.file_lang WHERE before <= 60 GROUP BY ALL
      UNION ALL SELECT 'gone', 'missing', 0""",
    "step_back_visible": f"""WITH {P_SQL}, {EV_SQL}, {POS_SQL}, v AS (SELECT file_lang, theme, count(*) AS visible FROM ({_HITS.format(t=content.STEP_TERM)}) GROUP BY ALL)
      SELECT lang, pos.theme, CAST(CASE WHEN coalesce(visible, 0) = 0 THEN 0 ELSE least(greatest((position - 1 + visible) % visible, 0), visible - 1) END AS INTEGER) AS position
      FROM pos LEFT JOIN v ON file_lang = lang AND v.theme = pos.theme""",
    "source_detail": f"""SELECT {LANGS}[r_regionkey + 1] || '.jsonl' AS asset, CASE WHEN r_regionkey = 3 THEN 'malformed' ELSE 'empty' END AS status,
      CASE WHEN r_regionkey = 3 THEN 'line 2' ELSE 'phrases:' || {LANGS}[5] END AS detail FROM region WHERE r_regionkey > 2 UNION ALL SELECT 'pt.jsonl', 'missing', NULL""",
    "source_lint_summary": f"""WITH f AS (SELECT {LANGS}[n_regionkey + 1] || '.jsonl' AS file, n_nationkey AS i, n_regionkey AS r FROM nation WHERE n_regionkey < 4),
      c AS (SELECT file, count(*) + any_value(CAST(r = 3 AS INT)) AS rows,
        sum(CAST(i % 7 = 5 AS INT) + 2 * CAST(i % 2 = 0 AS INT) + CAST(i % 3 = 0 AS INT) + CAST(i % 2 = 1 AND i % 5 = 0 AS INT)) + any_value(CAST(r = 3 AS INT)) AS errors FROM f GROUP BY 1)
      SELECT {LANGS}[r_regionkey + 1] || '.jsonl' AS file, CAST(coalesce(rows, 0) AS BIGINT) AS rows, CAST(coalesce(errors, 0) AS BIGINT) AS errors, coalesce(errors, 0) = 0 AS ok
      FROM region LEFT JOIN c ON c.file = {LANGS}[r_regionkey + 1] || '.jsonl'""",
    "lint_blank_values": f"""WITH {_ODD} SELECT file, line_no, 'missing' AS rule, 'youSay' AS key FROM x WHERE y < 5 UNION ALL SELECT file, line_no, 'missing', 'checked' FROM x WHERE c < 5
      UNION ALL SELECT file, line_no, 'no_caps', 'youSay' FROM x WHERE y < 2 UNION ALL SELECT file, line_no, 'bad_date', 'checked' FROM x WHERE c < 2""",
    "phrase_tips": f"""WITH {P_SQL}, s AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1)
      SELECT p.id, CASE WHEN ord % 3 = 0 THEN romanization END AS tip, CASE WHEN ord % 2 = 0 THEN ' ' || p.id END AS note, CASE WHEN s.id IS NULL THEN 'Mark hard' ELSE 'Hard \u2605' END AS star_label
      FROM p LEFT JOIN s ON s.id = p.id""",
    "price_places": "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS place FROM orders",
    "customer_places": "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal, c_custkey) AS place FROM customer",
    "far_places": """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 1000 = 7 THEN event_id * 1000000000000 ELSE event_id END) AS place FROM events""",
    "search_fold": "SELECT n_nationkey, " + ", ".join(f"contains({_folded(_NAME)}, {_folded(repr(t))}) AS {k}" for k, t in (("plain", "ia"), ("dotted", ODD[0] + "N"), ("dotless", "n" + ODD[1]), ("long_s", "u" + ODD[2]), ("kelvin", ODD[3] + "e"), ("double_s", "ss"), ("sharp_s", "\u00df"))) + " FROM nation",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict:
    return dict(SQL)
