"""Content files made of the given tables, read back by the loaders: `region` as languages, `nation` as phrases and numbers.

Both tables have a fixed size, so the driver writes the files. The file of region r is that of LANGS[r]: of regions 0 to 2 it is sound, that of region 3 has a
broken line among good ones, and that of region 4 blank lines only; `pt` has none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import next_index
from ..operators import lint, phrases, state
from ..sources import files
from ..sources.folders import put, shared_folder
from . import driver_tables as d
from .driver_tables import EV_SQL, LANGS, P_SQL, POS_SQL

STEP_TERM = "que"
_LANG = f"{LANGS}[n_regionkey + 1]"
NATION_SQL = f"f AS (SELECT *, {_LANG} AS file_lang, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation)"


def _folder(spark: SparkSession, sf: str) -> str:
    folder = shared_folder(spark, "content")
    regions = sorted(d.table(spark, sf, "region").collect())
    nations = sorted(d.table(spark, sf, "nation").collect())
    for key, name in regions:
        lines = []
        for i, n_name, r in nations:
            row = {"id": f"n{i}", "lang": LANGS[r], "theme": i % 8 + 1, "english": n_name, "romanization": n_name.lower(), "youSay": n_name if i % 3 else n_name.lower(), "soundTip": "" if i % 7 == 5 else "tip", "note": "n", "more": i}
            if i % 2:
                row |= {"source": "own", "checked": "2026-01-02" if i % 5 else "soon"}
            if r == key:
                lines += [json.dumps(row), " " * (i % 3)]
        if key == 3:
            lines.insert(2, '{"id": ')
        put(spark, f"{folder}/{LANGS[key]}.jsonl", ("\r\n" if key == 1 else "\n").join(lines if key < 4 else ["", " \t"]))
        if key % 2 == 0:
            put(spark, f"{folder}/soundcheck-{LANGS[key]}.json", json.dumps({"lang": LANGS[key], "newSounds": name.lower(), "rhythm": name, "registerFirst": "formal", "trap": f"trap {key}"}))
    put(spark, f"{folder}/catalog.json", json.dumps([{"code": LANGS[k], "name": n, "status": "bench" if k % 2 else "committed", **({"kitTotal": 10 * k} if k > 1 else {})} for k, n in regions]))
    put(spark, f"{folder}/numbers-es.json", json.dumps([{"value": str(i), "word": n.lower(), "youSay": n, **({"note": f"note {r}"} if r else {})} for i, n, r in nations]))
    return folder


def _phrases(spark, sf) -> tuple[DataFrame, DataFrame]:
    return files.load_phrases(spark, _folder(spark, sf), [*LANGS, "pt"])


def source_phrases(spark, sf):
    rows, _ = _phrases(spark, sf)
    return rows.select("file_lang", "ord", "id", "lang", "theme", "english", "romanization", "you_say", "sound_tip", "note", "source", "checked")


def source_status(spark, sf):
    return files.page_state(_phrases(spark, sf)[1]).select("asset", "status", "rows", "page")


def source_catalog(spark, sf):
    return files.load_catalog(spark, _folder(spark, sf))[0].select("code", "name", "status", "kit_total", "ord")


def source_numbers(spark, sf):
    return files.load_numbers(spark, _folder(spark, sf), "es")[0].select("ord", "value", "word", "you_say", "note", "source", "checked")


def _sounds(spark, sf) -> DataFrame:
    folder = _folder(spark, sf)
    found = None
    for lang in LANGS:
        rows, _ = files.load_sound_check(spark, folder, lang)
        found = rows if found is None else found.unionByName(rows)
    return found


def source_sound_checks(spark, sf):
    return _sounds(spark, sf).select("lang", "new_sounds", "rhythm", "register_first", "trap")


def source_briefing(spark, sf):
    """The briefings that are shown: of languages that have a sound check, until it is acknowledged (by the sign-ups of odd seq)."""
    signed = d.events(spark, sf).filter("event_type = 'signup' AND seq % 2 = 1 AND lang <> 'fr'").select("seq", "lang")
    return phrases.briefing(_sounds(spark, sf), state.acks(state.save_acks(signed)))


def _lines(spark, sf) -> DataFrame:
    lines = files.lines_of(spark, _folder(spark, sf))
    return lines.select(F.regexp_extract("file", r"([^/]+)\z", 1).alias("file"), "line_no", F.regexp_replace("line", r"\r\z", "").alias("line"))


def source_lines(spark, sf):
    """Lines that aren't blank, by number, with the phrase they hold (none in a broken line)."""
    return _lines(spark, sf).select("file", F.col("line_no").cast("long").alias("line_no"), F.try_variant_get(F.try_parse_json("line"), "$.id", "string").alias("id"))


def source_lint(spark, sf):
    return lint.violations(_lines(spark, sf)).select("file", F.col("line_no").cast("long").alias("line_no"), "rule", "key")


def source_catalog_files(spark, sf):
    """Each catalog language with the file its code leads to, and what became of that."""
    folder = _folder(spark, sf)
    catalog, _ = files.load_catalog(spark, folder)
    status = files.load_phrases(spark, folder, [*LANGS, "pt"])[1].drop("detail")
    asset = F.concat("code", F.lit(".jsonl"))
    return catalog.join(status.withColumnRenamed("status", "loaded"), asset == F.col("asset")).select("ord", "code", "asset", "loaded", "rows")


def deck_without_catalog(spark, sf):
    """No catalog file: no language, so an empty deck and no error."""
    catalog, status = files.load_catalog(spark, shared_folder(spark, "none"))
    deck = phrases.hard_deck(catalog, d.phrases(spark, sf), d.label_stars(spark, sf))
    one = status.select("status", F.lit(0).cast("long").alias("cards"))
    return one.unionByName(deck.select(F.lit(None).cast("string").alias("status"), F.lit(1).cast("long").alias("cards"))).agg(F.max("status").alias("status"), F.sum("cards").alias("cards"))


def _view_rows(spark, sf, log: str) -> None:
    """Opens themes: the log gets the odd views first, then the even ones."""
    sizes = d.phrases(spark, sf).groupBy(F.col("file_lang").alias("lang"), "theme").agg(F.count("*").alias("n"))
    views = d.events(spark, sf).filter("event_type = 'view'").join(F.broadcast(sizes), ["lang", "theme"], "left").withColumn("wanted", F.floor("value").cast("int"))
    for part in (1, 0):
        state.append(state.save_positions(views.filter(F.col("seq") % 2 == part)), log)


def state_positions_written(spark, sf):
    log = shared_folder(spark, "log")
    _view_rows(spark, sf, log)
    return state.positions(state.read_log(spark, log))


def state_toggles_written(spark, sf):
    log = shared_folder(spark, "log")
    clicks = d.events(spark, sf).filter("event_type = 'click'")
    for part in range(3):
        state.append(state.changes(clicks.filter(F.col("seq") % 3 == part), state.STAR, F.col("lang"), item_id=F.col("item_id")), log)
    return state.stars(state.read_log(spark, log))


def step_visible(spark, sf):
    """The next place of each open theme: it wraps over the phrases that the query leaves, and is kept against the theme."""
    open_ = state.positions(d.state_log(spark, sf))
    hits = d.phrases(spark, sf).filter(phrases._hit(STEP_TERM)).groupBy(F.col("file_lang").alias("lang"), "theme").agg(F.count("*").cast("int").alias("visible"))
    n = F.coalesce("visible", F.lit(0))
    rows = open_.join(F.broadcast(hits), ["lang", "theme"], "left").select(F.lit(0).cast("long").alias("seq"), "lang", "theme", next_index(F.col("position"), n).alias("wanted"), n.alias("n"))
    return state.positions(state.save_positions(rows))


_SOUND = "n_regionkey < 3"
_ROWS = f"""r AS (SELECT file_lang || '.jsonl' AS file, ord, n_nationkey AS i, n_regionkey AS r, n_name,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + CASE WHEN n_regionkey = 3 AND ord > 0 THEN 1 ELSE 0 END AS line_no FROM f WHERE n_regionkey < 4)"""
SQL = {
    "source_phrases": f"""WITH {NATION_SQL} SELECT file_lang, ord, 'n' || n_nationkey AS id, file_lang AS lang, n_nationkey % 8 + 1 AS theme, n_name AS english, lower(n_name) AS romanization,
      CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS you_say, CASE WHEN n_nationkey % 7 = 5 THEN '' ELSE 'tip' END AS sound_tip, 'n' AS note,
      CASE WHEN n_nationkey % 2 = 1 THEN 'own' ELSE 'curated' END AS source, CASE WHEN n_nationkey % 2 = 0 THEN '2026-11-06' WHEN n_nationkey % 5 = 0 THEN 'soon' ELSE '2026-01-02' END AS checked
      FROM f WHERE {_SOUND}""",
    "source_status": f"""WITH {NATION_SQL}, c AS (SELECT file_lang, count(*) AS n FROM f WHERE {_SOUND} GROUP BY 1), l AS (SELECT unnest({[*LANGS, "pt"]}) AS lang)
      SELECT lang || '.jsonl' AS asset, CASE WHEN n IS NOT NULL THEN 'ok' WHEN lang = '{LANGS[3]}' THEN 'malformed' WHEN lang = 'pt' THEN 'missing' ELSE 'empty' END AS status,
      CAST(coalesce(n, 0) AS BIGINT) AS rows, CASE WHEN n IS NOT NULL THEN 'ready' WHEN lang = '{LANGS[3]}' THEN 'failed' ELSE 'empty' END AS page FROM l LEFT JOIN c ON file_lang = lang""",
    "source_catalog": f"""SELECT {LANGS}[r_regionkey + 1] AS code, r_name AS name, CASE WHEN r_regionkey % 2 = 1 THEN 'bench' ELSE 'committed' END AS status,
      CASE WHEN r_regionkey > 1 THEN 10 * r_regionkey ELSE 40 END AS kit_total, CAST(r_regionkey AS BIGINT) AS ord FROM region""",
    "source_numbers": """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, CAST(n_nationkey AS VARCHAR) AS value, lower(n_name) AS word, n_name AS you_say,
      CASE WHEN n_regionkey > 0 THEN 'note ' || n_regionkey ELSE '' END AS note, 'curated' AS source, '2026-11-06' AS checked FROM nation""",
    "source_sound_checks": f"SELECT {LANGS}[r_regionkey + 1] AS lang, lower(r_name) AS new_sounds, r_name AS rhythm, 'formal' AS register_first, 'trap ' || r_regionkey AS trap FROM region WHERE r_regionkey % 2 = 0",
    "source_briefing": f"""WITH {EV_SQL}, s AS (SELECT *, {LANGS}[r_regionkey + 1] AS lang FROM region WHERE r_regionkey % 2 = 0)
      SELECT lang, lower(r_name) AS new_sounds, r_name || ' — formal' AS rhythm_line, 'trap ' || r_regionkey AS trap FROM s
      WHERE lang NOT IN (SELECT lang FROM ev WHERE event_type = 'signup' AND seq % 2 = 1 AND lang <> 'fr')""",
    "source_lint": f"""WITH {NATION_SQL}, {_ROWS} SELECT '{LANGS[3]}.jsonl' AS file, CAST(2 AS BIGINT) AS line_no, 'bad_json' AS rule, '' AS key
      UNION ALL SELECT file, line_no, 'missing', 'soundTip' FROM r WHERE i % 7 = 5
      UNION ALL SELECT file, line_no, 'missing', unnest(['source', 'checked']) FROM r WHERE i % 2 = 0
      UNION ALL SELECT file, line_no, 'no_caps', 'youSay' FROM r WHERE i % 3 = 0
      UNION ALL SELECT file, line_no, 'bad_date', 'checked' FROM r WHERE i % 2 = 1 AND i % 5 = 0""",
    "source_catalog_files": f"""WITH {NATION_SQL}, c AS (SELECT file_lang, count(*) AS n FROM f WHERE {_SOUND} GROUP BY 1), g AS (SELECT r_regionkey AS k, {LANGS}[r_regionkey + 1] AS code FROM region)
      SELECT CAST(k AS BIGINT) AS ord, code, code || '.jsonl' AS asset, CASE WHEN k < 3 THEN 'ok' WHEN k = 3 THEN 'malformed' ELSE 'empty' END AS loaded, CAST(coalesce(n, 0) AS BIGINT) AS rows FROM g LEFT JOIN c ON file_lang = code""",
    "deck_without_catalog": "SELECT 'missing' AS status, CAST(0 AS BIGINT) AS cards",
    "state_positions_written": f"WITH {P_SQL}, {EV_SQL}, {POS_SQL} SELECT lang, theme, position FROM pos",
    "state_toggles_written": f"WITH {EV_SQL} SELECT lang, item_id FROM ev WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1",
    "step_visible": f"""WITH {P_SQL}, {EV_SQL}, {POS_SQL}, v AS (SELECT file_lang, theme, count(*) AS visible FROM p
      WHERE contains(lower(english), '{STEP_TERM}') OR contains(lower(romanization), '{STEP_TERM}') OR contains(lower(you_say), '{STEP_TERM}') GROUP BY ALL)
      SELECT lang, pos.theme, CAST(CASE WHEN coalesce(visible, 0) = 0 THEN 0 ELSE (position + 1) % visible END AS INTEGER) AS position FROM pos LEFT JOIN v ON file_lang = lang AND v.theme = pos.theme""",
}
SQL["source_lines"] = f"WITH {NATION_SQL}, {_ROWS} SELECT file, line_no, 'n' || i AS id FROM r UNION ALL SELECT '{LANGS[3]}.jsonl', 2, NULL"


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict:
    return {name: sql for name, sql in SQL.items() if sql}
