"""Lines read in byte ranges, places by cuts, and phrases stored by language."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import lint, phrases, stored
from quillspark.operators import ranking
from quillspark.sources import files

from .test_phrases import catalog
from .test_phrases import phrases as some_phrases
from .test_sources import phrase

random.seed(4)


@pytest.fixture
def ranges(spark):
    """Byte ranges of a given size."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def of(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield of
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize("size, ends", [(997, ["\r\n"]), (1501, ["\r"]), (1103, ["\n", "\r\n", "\n \t\n", "\r\n\r\n"])])
def test_phrases_over_ranges(spark, tmp_path, ranges, size, ends):
    text = "".join(json.dumps(phrase(i, note="é" * random.randint(0, 40)), ensure_ascii=False) + random.choice(ends) for i in range(30))
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    (tmp_path / "b.jsonl").write_bytes(text.rstrip().encode())
    (tmp_path / "c.jsonl").write_bytes((text + "{oops" + random.choice(ends) + text).encode())
    ranges(size)
    assert files._ranges(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    rows, status = files.load_phrases(spark, str(tmp_path), ["a", "b", "c", "d"])
    assert {r.asset: (r.status, r.rows, r.detail) for r in status.collect()} == {"a.jsonl": ("ok", 30, None), "b.jsonl": ("ok", 30, None), "c.jsonl": ("malformed", 0, "line 31"), "d.jsonl": ("missing", 0, None)}
    got = rows.collect()
    assert sorted((r.file_lang, r.ord, r.id) for r in got) == sorted((f, i, f"p{i}") for f in "ab" for i in range(30))


@pytest.mark.parametrize("size", [211, 300])
def test_lines_over_ranges(spark, tmp_path, ranges, size):
    want = []
    for name in ("x", "y"):
        lines = [random.choice(["", " ", "\t\r", f"line {i}", f"é {i}\r", f"a\rb {i}"]) for i in range(200)]
        (tmp_path / f"{name}.jsonl").write_bytes("\n".join(lines).encode())
        want += [(f"{name}.jsonl", i + 1, line) for i, line in enumerate(x for x in lines if x.strip())]
    (tmp_path / "z.jsonl").write_bytes(b"")
    (tmp_path / "w.json").write_bytes(b"{}")
    ranges(size)
    assert sorted(map(tuple, files.lines_of(spark, str(tmp_path)).collect())) == sorted(want)
    assert sorted(r.file for r in files.files_of(spark, str(tmp_path)).collect()) == ["x.jsonl", "y.jsonl", "z.jsonl"]


def test_lint_as_released(spark, tmp_path):
    """White space and an empty array are missing and break the pattern; what is absent is missing only; a file without lines passes."""
    odd = {"white": "  ", "array": [], "empty": "", "null": None, "zero": 0, "false": False, "gone": ...}
    for k, v in odd.items():
        (tmp_path / f"{k}.jsonl").write_text(json.dumps(phrase(1, note="n", youSay=v, checked=v)))
    (tmp_path / "blank.jsonl").write_text("\n \n")
    lines = files.lines_of(spark, str(tmp_path))
    found = lint.violations(lines)
    got = Counter((r.file.removesuffix(".jsonl"), r.key) for r in found.collect())
    assert got == {(k, key): 2 if k in ("white", "array") else 1 for k in odd for key in ("youSay", "checked")}
    summed = {r.file: (r.rows, r.errors, r.ok) for r in lint.summary(lines, found, files.files_of(spark, str(tmp_path))).collect()}
    assert summed["blank.jsonl"] == (0, 0, True) and summed["white.jsonl"] == (1, 4, False) and len(summed) == 8
    alone = tmp_path / "alone"
    alone.mkdir()
    (alone / "blank.jsonl").write_text("\n \n")
    none = files.lines_of(spark, str(alone))
    assert tuple(lint.passes(lint.summary(none, lint.violations(none), files.files_of(spark, str(alone)))).first()) == (1, 0, True)


def pieces(frame, keys, order, block):
    """The largest piece that one task numbers."""
    total = frame.count()
    cuts, many = ranking._cuts(frame, [*keys, *order], min(-(-total // block), ranking.MOST), total)
    return frame.groupBy(*keys, ranking._piece(F.struct(*keys, *order), cuts, many).alias("piece")).count().agg(F.max("count")).first()[0], many + 1


@pytest.mark.parametrize("case", ["far", "crowd", "even", "one_key"])
def test_places_leave_no_piece_large(spark, case):
    order = {"far": "IF(id = 7, 1L << 60, id)", "crowd": "IF(id % 2 = 0, id * 1000003, 500000000 + id)", "even": "id", "one_key": "id - 9999"}[case]
    frame = spark.range(20000).selectExpr("IF(id % 10 < 9, 'a', CAST(id % 7 AS STRING)) AS k" if case == "one_key" else "'a' AS k", f"{order} AS o")
    largest, many = pieces(frame, ["k"], ["o"], 1000)
    assert largest < 2500 and many >= 18
    got = {(r.k, r.o): r.rn for r in ranking.numbered(frame, ["k"], "o", block=1000).collect()}
    for k in {k for k, _ in got}:
        assert [got[x] for x in sorted(x for x in got if x[0] == k)] == list(range(1, sum(x[0] == k for x in got) + 1))


@pytest.mark.parametrize("block", [3, 20, 1000])
def test_places_by_several_columns(spark, block):
    rows = [(random.choice([None, True, False]), random.choice(["", "b", "a\"'", "é", "Z"]), i, random.random()) for i in range(120)]
    frame = spark.createDataFrame(rows, "g boolean, name string, ord int, x double")
    first = lambda v: (v is not None, v)
    for keys, order in (([], ["g", "name", "ord"]), (["g"], ["name", "ord"]), (["name", "g"], ["x"])):
        place = lambda r: tuple(first(r[frame.columns.index(c)]) for c in order)
        got = [tuple(r) for r in ranking.numbered(frame, keys, order, "place", block).collect()]
        groups = {}
        for r in got:
            groups.setdefault(tuple(r[frame.columns.index(k)] for k in keys), []).append(r)
        assert len(got) == 120
        for g in groups.values():
            assert [r[-1] for r in sorted(g, key=place)] == list(range(1, len(g) + 1))


def test_home_order_over_cuts(spark, monkeypatch):
    rows = spark.createDataFrame([(f"n{i * 7 % 50:02}", random.choice(["committed", "bench", None, "x"]), i) for i in range(200)], "name string, status string, ord int")
    want = [r.ord for r in sorted(rows.collect(), key=lambda r: (r.status != "committed", r.name, r.ord))]
    numbered = ranking.numbered
    monkeypatch.setattr(phrases, "numbered", lambda df, keys, order, name: numbered(df, keys, order, name, 30))
    got = phrases.home_order(rows)
    assert [r.ord for r in got.orderBy("place").collect()] == want
    assert pieces(rows.withColumn("bench", F.coalesce(F.col("status") != "committed", F.lit(True))), [], ["bench", "name", "ord"], 30)[0] < 75


def test_a_repeated_code_comes_once(spark):
    twice = catalog(spark, [("a", "Beta", "committed", 40, 3), ("b", "Alpha", "bench", 40, 1), ("a", "Later", "bench", 40, 2)])
    stars = spark.createDataFrame([("a", "a1"), ("b", "gone")], "lang string, item_id string")
    got = phrases.hard_deck(twice, some_phrases(spark, {"a": 3, "b": 1}), stars).collect()
    assert [(r.cat_ord, r.id) for r in got] == [(2, "a1")]


def spoil(path, lang):
    """Whoever opens this language's files fails."""
    for file in (path / f"file_lang={lang}").glob("*.parquet"):
        file.write_bytes(b"not a table")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)


def test_stored_search_opens_what_it_needs(spark, tmp_path):
    for first, langs in ((60, {"a", "b"}), (61, {"a"})):
        path = tmp_path / str(first)
        stored.store(some_phrases(spark, {"a": first, "b": 1, "c": 2, "d": 3, "elsewhere": 4}), str(path))
        spoil(path, "elsewhere")
        if first == 61:
            spoil(path, "b")
        hits = stored.search(catalog(spark), str(path), "QUE").collect()
        whole = phrases.search(catalog(spark), some_phrases(spark, {"a": first, "b": 1, "c": 2, "d": 3}), "QUE")
        assert {r.file_lang for r in hits} == langs
        assert sorted((r.cat_ord, r.ord, r.id) for r in hits) == sorted((r.cat_ord, r.ord, r.id) for r in whole.collect())
        spoil(path, "a")
        assert stored.search(catalog(spark), str(path), " ").count() == 0


def test_stored_deck_opens_starred_languages_only(spark, tmp_path):
    path = tmp_path / "p"
    rows = some_phrases(spark, {"a": 3, "b": 3, "z": 2})
    stored.store(rows, str(path))
    stars = spark.createDataFrame([("a", "a1"), ("a", "gone"), ("z", "z1")], "lang string, item_id string")
    want = sorted(map(tuple, phrases.hard_deck(catalog(spark), rows, stars).collect()))
    spoil(path, "b"), spoil(path, "z")
    assert sorted(map(tuple, stored.hard_deck(catalog(spark), str(path), stars).collect())) == want
    assert stored.hard_deck(catalog(spark), str(path), stars.limit(0)).count() == 0


@pytest.mark.parametrize("said, term, ok", [
    ("İstanbul", "istan", True), ("istanbul", "İSTAN", True), ("ILIK", "ılık", True), ("straße", "STRASSE", False), ("STRAẞE", "straße", True),
    ("meſſage", "MESSAGE", True), ("300 K", "k", True), ("Ångström", "åNGSTRÖM", True), ("Σίσυφος", "σΊς", True), ("ﬁn", "fin", False),
    ("\U00010400", "\U00010428", False), ("\U00010400x", "\U00010400X", True), ("a.b", "A.B", True), ("axb", "a.b", False), ("\\Qa\\E", "\\qA\\e", True), ("x\n y", "X\n Y", True),
])
def test_fold_character_by_character(spark, said, term, ok):
    assert spark.createDataFrame([(said,)], "t string").select(X.contains_fold(F.col("t"), term).alias("x")).first().x is ok


def test_fold_agrees_with_the_platform(spark):
    """Every character of the first planes: it is found by what Java's upper and then lower case make of it, and by no neighbour of another fold."""
    character = spark._jvm.java.lang.Character
    some = [*range(0x41, 0x250), 0x345, 0x3C2, 0x3F4, 0x1C5, 0x1E9E, 0x1FB3, 0x1FBE, 0x2126, 0x212A, 0x212B, 0x10D0, 0xAB70]
    fold = {c: character.toLowerCase(character.toUpperCase(c)) for c in some}
    frame = spark.createDataFrame([(chr(c), chr(f)) for c, f in fold.items()], "c string, f string")
    found = frame.select("c", *(X.contains_fold(F.col("c"), chr(c)).alias(f"x{c}") for c in some[:140])).collect()
    for r in found:
        assert [r[f"x{c}"] for c in some[:140]] == [fold[ord(r.c)] == fold[c] for c in some[:140]]


@pytest.mark.parametrize("said, ok", [("\U00010400", True), ("É", False), (" \U00010400 ", True), ("\U0001f600", False)])
def test_you_say_counts_wide_characters_twice(spark, said, ok):
    assert spark.createDataFrame([(said,)], "t string").select(X.valid_you_say(F.col("t")).alias("x")).first().x is ok
