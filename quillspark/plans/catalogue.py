"""All queries of the engine by name, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.themes import THEMES
from ..operators import lint, phrases, state
from ..operators.ranking import numbered
from . import content, stored
from . import driver_tables as d
from .driver_tables import CAT_SQL, EV_SQL, P_SQL, POS_SQL, STAR_SQL

LANG, THEME, TERM, SMALL_TERM, LATER = "en", 2, "que", "que la", ("10", "20")
_all: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

_PROGRESS = f"""WITH {P_SQL}, {CAT_SQL}, {EV_SQL}, {POS_SQL},
g AS (SELECT code, name, status, cat.ord, CAST(coalesce(seen, 0) AS BIGINT) AS viewed, CAST(greatest(coalesce(have, 0), kit_total) AS BIGINT) AS total
  FROM cat LEFT JOIN (SELECT file_lang, count(*) AS have FROM p GROUP BY 1) a ON a.file_lang = code
  LEFT JOIN (SELECT lang, sum(position + 1) AS seen FROM pos GROUP BY 1) b ON b.lang = code),
h AS (SELECT *, CAST(viewed AS FLOAT) / CAST(total AS FLOAT) AS f FROM g),
t AS (SELECT code, name, status, ord, viewed, total, CAST(CAST(f AS FLOAT) AS FLOAT) AS fraction, CAST(trunc(CAST(f AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER) AS percent FROM h)"""


def query(sql: str):
    def add(f):
        _all[f.__name__] = (f, sql)
        return f

    return add


def _positions(spark, sf):
    return state.positions(d.state_log(spark, sf))


def _stars(spark, sf):
    return state.stars(d.state_log(spark, sf))


def _progress(spark, sf):
    return phrases.progress(d.catalog(spark), d.phrases(spark, sf), _positions(spark, sf))


@query(_PROGRESS + " SELECT *, format('[{}/{}]', viewed, total) AS counts, CASE WHEN viewed = 0 THEN 'START' ELSE percent || '%' END AS label FROM t")
def home_progress(spark, sf):
    return phrases.tiles(_progress(spark, sf))


@query(_PROGRESS + """ SELECT code, name, status, status <> 'committed' AS bench,
  CAST(row_number() OVER (ORDER BY status <> 'committed', name, ord) AS INTEGER) AS place, viewed, total FROM t""")
def home_sorted(spark, sf):
    return phrases.home_order(_progress(spark, sf)).select("code", "name", "status", "bench", "place", "viewed", "total")


@query("""SELECT n_nationkey AS ord, n_name AS name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'committed' ELSE 'bench' END AS status,
  CAST(row_number() OVER (ORDER BY r_name NOT IN ('ASIA', 'EUROPE'), n_name, n_nationkey) AS INTEGER) AS place
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def nations_sorted(spark, sf):
    both = d.table(spark, sf, "nation").join(d.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.when(F.col("r_name").isin("ASIA", "EUROPE"), "committed").otherwise("bench").alias("status"))
    return phrases.home_order(rows).select("ord", "name", "status", "place")


_NAMES = "th AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in THEMES) + ") t(theme, theme_name))"


@query(f"""WITH {P_SQL}, {_NAMES}, c AS (SELECT theme, count(*) AS n FROM p WHERE file_lang = '{LANG}' GROUP BY 1)
  SELECT theme, theme_name, CAST(coalesce(n, 0) AS BIGINT) AS n, printf('%02d', theme) AS no,
  CASE WHEN theme = 3 THEN 'OPEN' ELSE format('[{{}} PHRASES]', coalesce(n, 0)) END AS button FROM th LEFT JOIN c USING (theme)""")
def lesson_counts(spark, sf):
    return phrases.lesson_counts(d.phrases(spark, sf), LANG)


@query(f"""WITH {P_SQL}, {_NAMES} SELECT file_lang, theme, printf('%02d %s', theme, coalesce(any_value(theme_name), '')) AS title,
  format('[{{}} PHRASES]', count(*)) AS shown FROM p LEFT JOIN th USING (theme) GROUP BY 1, 2""")
def theme_headers(spark, sf):
    return phrases.theme_header(d.phrases(spark, sf))


@query(f"""WITH {P_SQL}, s AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY file_lang, theme ORDER BY ord) AS rn FROM p)
  SELECT file_lang, theme, r.id, rn, rn || '. ' || english AS title, you_say, CAST(NULL AS VARCHAR) AS tip, CAST(NULL AS VARCHAR) AS note,
  CASE WHEN s.id IS NULL THEN 'Mark hard' ELSE 'Hard ★' END AS star_label FROM r LEFT JOIN s ON s.id = r.id""")
def phrase_cards(spark, sf):
    return phrases.cards(d.phrases(spark, sf), d.label_stars(spark, sf))


@query(f"""WITH {P_SQL} SELECT id, theme, english || ' — ' || you_say AS line FROM p WHERE theme = 8""")
def glue_strip(spark, sf):
    return d.phrases(spark, sf).filter("theme = 8").select("id", "theme", phrases.glue_line().alias("line"))


@query(f"""WITH {P_SQL}, s AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1)
  SELECT p.id, file_lang, s.id IS NOT NULL AS is_starred FROM p LEFT JOIN s ON s.id = p.id""")
def star_marker(spark, sf):
    return phrases.marked(d.phrases(spark, sf), d.label_stars(spark, sf)).select("id", "file_lang", "is_starred")


@query(f"""WITH {P_SQL}, {CAT_SQL}, {EV_SQL}, {STAR_SQL}
  SELECT cat.ord AS cat_ord, p.ord, file_lang, id, english, you_say, upper(file_lang) || ' · ' || id AS caption
  FROM p JOIN st ON st.lang = file_lang AND st.item_id = id JOIN cat ON code = file_lang""")
def hard_deck(spark, sf):
    return phrases.hard_deck(d.catalog(spark), d.phrases(spark, sf), _stars(spark, sf))


@query(f"WITH {CAT_SQL}, {EV_SQL}, {STAR_SQL} SELECT count(*) AS stars FROM st WHERE lang IN (SELECT code FROM cat)")
def star_count(spark, sf):
    return phrases.star_count(d.catalog(spark), _stars(spark, sf))


@query(f"WITH {EV_SQL}, {STAR_SQL} SELECT * FROM st")
def toggle_fold(spark, sf):
    return _stars(spark, sf)


@query(f"""WITH {CAT_SQL}, {EV_SQL}, {STAR_SQL} SELECT code, ord, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS ids, count(item_id) AS n
  FROM cat LEFT JOIN st ON lang = code GROUP BY 1, 2""")
def star_sets(spark, sf):
    sets = state.star_sets(d.catalog(spark), _stars(spark, sf))
    return sets.select("code", "ord", F.concat_ws(",", "ids").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(f"""WITH {CAT_SQL}, {EV_SQL}, {STAR_SQL}, a AS (SELECT code, coalesce(list(item_id) FILTER (item_id IS NOT NULL), []) AS ids FROM cat LEFT JOIN st ON lang = code GROUP BY 1)
  SELECT code, CAST(len(list_distinct(list_append(ids, '7'))) AS BIGINT) AS with_7, CAST(len(list_filter(ids, lambda x: x <> '8')) AS BIGINT) AS without_8 FROM a""")
def star_edits(spark, sf):
    sets = state.star_sets(d.catalog(spark), _stars(spark, sf))
    return sets.select("code", F.size(state.add_star(F.col("ids"), F.lit("7"))).cast("long").alias("with_7"), F.size(state.drop_star(F.col("ids"), F.lit("8"))).cast("long").alias("without_8"))


@query(f"WITH {P_SQL}, {EV_SQL}, {POS_SQL} SELECT lang, theme, CAST(position AS INTEGER) AS position FROM pos")
def position_fold(spark, sf):
    return _positions(spark, sf)


@query("""SELECT p_partkey, p_size AS raw_size, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS INTEGER) END AS position FROM part""")
def positions_parse(spark, sf):
    spoilt = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return d.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("raw_size"), X.int_or_null(spoilt).alias("position"))


@query(f"""WITH {P_SQL}, {EV_SQL}, c AS (SELECT file_lang, theme, count(*) AS n FROM p GROUP BY 1, 2)
  SELECT seq, least(greatest(CAST(floor("value") AS INTEGER) - 5, 0), greatest(coalesce(n, 0) - 1, 0)) AS position FROM ev LEFT JOIN c ON file_lang = lang AND c.theme = ev.theme WHERE event_type = 'view'""")
def clamp_theme(spark, sf):
    sizes = d.phrases(spark, sf).groupBy(F.col("file_lang").alias("lang"), "theme").agg(F.count("*").alias("n"))
    rows = d.events(spark, sf).filter("event_type = 'view'").join(F.broadcast(sizes), ["lang", "theme"], "left")
    return rows.select("seq", X.clamped(F.floor("value").cast("int") - 5, F.coalesce("n", F.lit(0))).alias("position"))


@query(f"""WITH {P_SQL}, {CAT_SQL}, {EV_SQL}, {POS_SQL}, c AS (SELECT file_lang, count(*) AS n FROM p GROUP BY 1)
  SELECT code, least(greatest(coalesce(position, 0), 0), greatest(coalesce(c.n, 0) - 1, 0)) AS start FROM cat LEFT JOIN c ON file_lang = code
  LEFT JOIN pos ON pos.lang = code AND pos.theme = 1""")
def clamp_load(spark, sf):
    """A language opens at theme 1's stored position, clamped by all its phrases."""
    sizes = d.phrases(spark, sf).groupBy(F.col("file_lang").alias("code")).agg(F.count("*").alias("n"))
    first = _positions(spark, sf).filter("theme = 1").select(F.col("lang").alias("code"), "position")
    rows = d.catalog(spark).join(sizes, "code", "left").join(first, "code", "left")
    return rows.select("code", X.clamped(F.coalesce("position", F.lit(0)), F.coalesce("n", F.lit(0))).alias("start"))


@query("""SELECT p_partkey, CASE WHEN t <= 0 THEN 0 ELSE (c + 1) % t END AS next, CASE WHEN t <= 0 THEN 0 ELSE (c - 1 + t) % t END AS prev, c || '/' || t AS label
  FROM (SELECT p_partkey, p_size - 10 AS c, p_size % 7 AS t FROM part)""")
def next_prev(spark, sf):
    rows = d.table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 10).alias("c"), (F.col("p_size") % 7).alias("t"))
    return rows.select("p_partkey", X.next_index(F.col("c"), F.col("t")).alias("next"), X.prev_index(F.col("c"), F.col("t")).alias("prev"), X.progress_label(F.col("c"), F.col("t")).alias("label"))


def _hits_sql(term: str) -> str:
    t = term.replace("'", "''")
    return f"(contains(lower(english), lower('{t}')) OR contains(lower(romanization), lower('{t}')) OR contains(lower(you_say), lower('{t}')))"


def _search_sql(term: str) -> str:
    return f"""WITH {P_SQL}, {CAT_SQL}, h AS (SELECT * FROM p WHERE {_hits_sql(term)}), c AS (SELECT file_lang, count(*) AS n FROM h GROUP BY 1),
  o AS (SELECT file_lang, cat.ord AS cat_ord, coalesce(sum(n) OVER (ORDER BY cat.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c JOIN cat ON code = file_lang)"""


@query(_search_sql(TERM) + " SELECT cat_ord, h.ord, id, h.file_lang FROM h JOIN o ON o.file_lang = h.file_lang WHERE before <= 60")
def search_global(spark, sf):
    return phrases.search(d.catalog(spark), d.phrases(spark, sf), TERM).select("cat_ord", "ord", "id", "file_lang")


@query(_search_sql(SMALL_TERM) + " SELECT id, english, you_say, upper(h.file_lang) AS lang_label FROM h JOIN o ON o.file_lang = h.file_lang WHERE before <= 60")
def search_rows(spark, sf):
    return phrases.search_rows(phrases.search(d.catalog(spark), d.phrases(spark, sf), SMALL_TERM))


@query(f"WITH {P_SQL} SELECT file_lang, count(*) AS visible FROM p WHERE theme = {THEME} AND {_hits_sql(TERM)} GROUP BY 1")
def search_in_theme(spark, sf):
    return phrases.in_theme(d.phrases(spark, sf), THEME, TERM).groupBy("file_lang").agg(F.count("*").alias("visible"))


@query(f"WITH {P_SQL} SELECT file_lang, count(*) AS visible FROM p WHERE theme = {THEME} GROUP BY 1")
def theme_visible(spark, sf):
    return phrases.in_theme(d.phrases(spark, sf), THEME, " ").groupBy("file_lang").agg(F.count("*").alias("visible"))


_NUM = "x AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, CAST(p_size AS VARCHAR) AS value, p_name AS you_say FROM part)"


@query(f"WITH {_NUM} SELECT ord, value, you_say, '' AS note FROM x WHERE ord < 21")
def numbers_grid(spark, sf):
    return phrases.numbers_grid(d.numbers(spark, sf))


@query(f"WITH {_NUM} SELECT ord, value, you_say FROM x WHERE ord >= 21 AND value IN {LATER}")
def numbers_tail(spark, sf):
    return phrases.numbers_tail(d.numbers(spark, sf), LATER)


@query(f"""WITH {CAT_SQL}, {EV_SQL}, l AS (SELECT max_by(lang, seq) AS last_lang FROM ev WHERE event_type = 'view' AND lang IN (SELECT lang FROM documents))
  SELECT last_lang AS code, coalesce(name, upper(last_lang)) AS title FROM l LEFT JOIN cat ON code = last_lang""")
def continue_name(spark, sf):
    return phrases.titles(state.last_lang(d.last_lang_log(spark, sf)).select(F.col("last_lang").alias("code")), d.catalog(spark))


@query(f"""WITH {CAT_SQL}, u AS (SELECT lang AS code FROM documents UNION SELECT lower(left(c_mktsegment, 2)) FROM customer)
  SELECT u.code, coalesce(name, upper(u.code)) AS title FROM u LEFT JOIN cat ON cat.code = u.code""")
def title_lookup(spark, sf):
    codes = d.table(spark, sf, "documents").select(F.col("lang").alias("code")).union(d.table(spark, sf, "customer").select(F.lower(F.substring("c_mktsegment", 1, 2)))).distinct()
    titled = phrases.titles(codes, d.catalog(spark))
    return titled.withColumn("title", phrases.shown_title(F.col("title"), F.col("code")))


@query(f"WITH {CAT_SQL}, {EV_SQL}, a AS (SELECT DISTINCT lang FROM ev WHERE event_type = 'signup') SELECT code, a.lang IS NOT NULL AS acked, a.lang IS NULL AS show_briefing FROM cat LEFT JOIN a ON lang = code")
def ack_flags(spark, sf):
    flags = state.acks(d.state_log(spark, sf)).withColumnRenamed("lang", "code")
    acked = F.coalesce("acked", F.lit(False))
    return d.catalog(spark).join(flags, "code", "left").select("code", acked.alias("acked"), (~acked).alias("show_briefing"))


@query(f"""WITH {EV_SQL} SELECT lang, item_id, max_by('note ' || CAST(floor("value") AS BIGINT), seq) AS note FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2""")
def note_latest(spark, sf):
    return state.notes(d.state_log(spark, sf))


def _per_text(spark, sf, **columns: Column):
    return d.table(spark, sf, "documents").select("doc_id", *(c.alias(k) for k, c in columns.items()))


@query("""SELECT doc_id, length(trim("text", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 2 AND regexp_matches("text", '\\p{Lu}') AS valid FROM documents""")
def valid_you_say(spark, sf):
    return _per_text(spark, sf, valid=X.valid_you_say(F.col("text")))


@query("""SELECT doc_id, regexp_matches("text", '[A-ZÀ-Ý]') AS caps FROM documents""")
def lint_caps(spark, sf):
    return _per_text(spark, sf, caps=X.lint_caps(F.col("text")))


@query(r"""SELECT o_orderkey, regexp_matches(c, '^\d{4}-\d{2}-\d{2}$') AS is_date FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS c FROM orders)""")
def lint_date(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return d.table(spark, sf, "orders").select("o_orderkey", X.lint_date(text).alias("is_date"))


def _lint_lines(spark, sf):
    """Documents as content lines: some lack a key, some have no capitals, some no JSON."""
    docs = d.table(spark, sf, "documents")
    said = F.when(F.col("doc_id") % 5 == 0, F.lower("source")).otherwise(F.upper("source"))
    row = F.struct(
        F.col("doc_id").cast("string").alias("id"), "lang", (F.col("doc_id") % 3).cast("int").alias("theme"), F.lit("x").alias("english"), F.lit("x").alias("romanization"), said.alias("youSay"),
        F.when(F.col("doc_id") % 7 != 0, F.lit("tip")).alias("soundTip"), F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.lit("n")).alias("note"), F.lit("curated").alias("source"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("2026-1-1")).otherwise(F.lit("2026-11-06")).alias("checked"),
    )
    line = F.when(F.col("doc_id") % 17 == 0, F.lit("{bad")).otherwise(F.to_json(row))
    return docs.select(F.concat(F.col("lang"), F.lit(".jsonl")).alias("file"), F.col("doc_id").alias("line_no"), line.alias("line"))


_LINT = """WITH v AS (
  SELECT lang || '.jsonl' AS file, doc_id AS line_no, 'bad_json' AS rule, '' AS key FROM documents WHERE doc_id % 17 = 0
  UNION ALL SELECT lang || '.jsonl', doc_id, 'missing', k FROM documents, (VALUES ('theme', 3), ('soundTip', 7), ('note', 11)) t(k, m) WHERE doc_id % 17 <> 0 AND doc_id % m = 0
  UNION ALL SELECT lang || '.jsonl', doc_id, 'no_caps', 'youSay' FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 5 = 0
  UNION ALL SELECT lang || '.jsonl', doc_id, 'bad_date', 'checked' FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 13 = 0)"""


@query(_LINT + " SELECT * FROM v")
def lint_missing(spark, sf):
    return lint.violations(_lint_lines(spark, sf))


@query(_LINT + """, n AS (SELECT lang || '.jsonl' AS file, count(*) AS rows FROM documents GROUP BY 1), e AS (SELECT file, count(*) AS errors FROM v GROUP BY 1)
  SELECT file, rows, coalesce(errors, 0) AS errors, coalesce(errors, 0) = 0 AS ok FROM n LEFT JOIN e USING (file)""")
def lint_summary(spark, sf):
    lines = _lint_lines(spark, sf)
    return lint.summary(lines, lint.violations(lines))


@query(_LINT + " SELECT (SELECT count(DISTINCT lang) FROM documents) AS files, count(*) AS errors, count(*) = 0 AND (SELECT count(*) FROM documents) > 0 AS ok FROM v")
def lint_gate(spark, sf):
    lines = _lint_lines(spark, sf)
    return lint.passes(lint.summary(lines, lint.violations(lines)))


@query(f"""WITH {P_SQL}, {CAT_SQL}, c AS (SELECT file_lang, count(*) AS n FROM p GROUP BY 1)
  SELECT code || '.jsonl' AS asset, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS rows, CASE WHEN n IS NULL THEN 'empty' ELSE 'ready' END AS page
  FROM cat LEFT JOIN c ON file_lang = code""")
def load_status(spark, sf):
    from ..sources.files import MISSING, OK, page_state

    have = d.phrases(spark, sf).groupBy(F.col("file_lang").alias("code")).agg(F.count("*").alias("n"))
    rows = d.catalog(spark).join(have, "code", "left")
    n = F.col("n")
    return page_state(rows.select(F.concat("code", F.lit(".jsonl")).alias("asset"), F.when(n.isNull(), MISSING).otherwise(OK).alias("status"), F.coalesce(n, F.lit(0)).cast("long").alias("rows")))


@query("""SELECT 'documents' AS origin, CAST(doc_id AS BIGINT) AS id, length("text") AS n FROM documents
  UNION ALL SELECT 'conversations', conv_id, length("text") FROM conversations UNION ALL SELECT 'benchmark', item_id, length("text") FROM benchmark""")
def union_sources(spark, sf):
    part = lambda name, key: d.table(spark, sf, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.char_length("text").cast("long").alias("n"))
    return part("documents", "doc_id").unionByName(part("conversations", "conv_id")).unionByName(part("benchmark", "item_id"))


@query(f"WITH {P_SQL} SELECT id, file_lang, theme, row_number() OVER (PARTITION BY file_lang, theme ORDER BY ord) AS rn FROM p")
def row_numbers(spark, sf):
    return numbered(d.phrases(spark, sf), ["file_lang", "theme"], "ord").select("id", "file_lang", "theme", "rn")


def queries() -> dict:
    return {name: f for name, (f, _) in _all.items()} | content.queries() | stored.queries()


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all.items()} | content.oracle_sql() | stored.oracle_sql()
