"""What the pages show, on small tables."""

import pytest

from quillspark.operators import phrases as P
from quillspark.operators.ranking import numbered

CATALOG = [("a", "Beta", "committed", 40, 0), ("b", "Alpha", "bench", 40, 1), ("c", "Alpha", "other", 2, 2), ("d", "Alpha", "committed", 40, 3)]


def catalog(spark, rows=CATALOG):
    return spark.createDataFrame(rows, "code string, name string, status string, kit_total int, ord int")


def phrases(spark, counts, english="que"):
    rows = [(f"{lang}{i}", lang, lang, i % 8 + 1, english, "r", "y", " ", "n", i) for lang, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, file_lang string, lang string, theme int, english string, romanization string, you_say string, sound_tip string, note string, ord long")


def test_search_stops_after_a_language(spark):
    for first, langs in ((60, {"a", "b"}), (61, {"a"})):
        hits = P.search(catalog(spark), phrases(spark, {"a": first, "b": 1}), "QUE")
        assert {r.file_lang for r in hits.collect()} == langs
    assert P.search(catalog(spark), phrases(spark, {"a": 3}), " ").count() == 0
    assert P.search(catalog(spark), phrases(spark, {"a": 3}), "q%e").count() == 0


def test_home(spark):
    positions = spark.createDataFrame([("a", 1, 40), ("c", 1, 0)], "lang string, theme int, position int")
    got = P.home_order(P.tiles(P.progress(catalog(spark), phrases(spark, {"a": 3, "c": 5}), positions))).orderBy("place").collect()
    assert [(r.code, r.viewed, r.total, r.label, r.bench) for r in got] == [("d", 0, 40, "START", False), ("a", 41, 40, "102%", False), ("b", 0, 40, "START", True), ("c", 1, 5, "20%", True)]


def test_stars(spark):
    stars = spark.createDataFrame([("a", "a1"), ("a", "gone"), ("z", "z1")], "lang string, item_id string")
    rows = phrases(spark, {"a": 3, "z": 2})
    assert [r.caption for r in P.hard_deck(catalog(spark), rows, stars).collect()] == ["A · a1"]
    assert P.star_count(catalog(spark), stars).first().stars == 2
    shown = {r.id: (r.title, r.tip, r.note, r.star_label) for r in P.cards(rows, stars).collect()}
    assert shown["a1"] == ("1. que", None, "n", "Hard ★") and shown["a0"][3] == "Mark hard"


def test_lessons(spark):
    got = {r.theme: (r.n, r.no, r.button) for r in P.lesson_counts(phrases(spark, {"a": 2}), "a").collect()}
    assert got[1] == (1, "01", "[1 PHRASES]") and got[3] == (0, "03", "OPEN") and got[8] == (0, "08", "[0 PHRASES]") and len(got) == 8


def test_numbers(spark):
    values = [*map(str, range(21)), *(str(10 * i) for i in range(3, 10)), "100", "1000"]
    rows = spark.createDataFrame([(i, v, "y", "") for i, v in enumerate(values)], "ord long, value string, you_say string, note string")
    assert P.numbers_grid(rows).count() == 21
    assert [r.value for r in P.numbers_tail(rows).orderBy("ord").collect()] == ["100", "1000"]


def test_titles(spark):
    codes = spark.createDataFrame([("a",), ("zz",), (None,)], "code string")
    assert {r.code: r.title for r in P.titles(codes, catalog(spark)).collect()} == {"a": "Beta", "zz": "ZZ", None: None}


def test_briefing(spark):
    sounds = spark.createDataFrame([("a", "s", "r", "f", "t"), ("b", "s", "r", "f", "t")], "lang string, new_sounds string, rhythm string, register_first string, trap string")
    acks = spark.createDataFrame([("a", True)], "lang string, acked boolean")
    assert [tuple(r) for r in P.briefing(sounds, acks).collect()] == [("b", "s", "r — f", "t")]


@pytest.mark.parametrize("order", ["id * 7", "xxhash64(id)", "id - 50", "9223372036854775807 - id"])
@pytest.mark.parametrize("block", [7, 50, 65536])
def test_numbered_over_blocks(spark, order, block):
    rows = spark.range(100).selectExpr("id % 3 AS k", f"{order} AS o")
    assert numbered(rows.limit(0), ["k"], "o", block=block).count() == 0
    got = {(r.k, r.o): r.rn for r in numbered(rows, ["k"], "o", block=block).collect()}
    for k in range(3):
        assert [got[x] for x in sorted(x for x in got if x[0] == k)] == list(range(1, len([x for x in got if x[0] == k]) + 1))
