"""Content files, lint and the streamed state, on rows of our own."""

import json

from pyspark.sql import functions as F

from quillspark.functions.schemas import LOG
from quillspark.operators import lint, state
from quillspark.sources import files
from quillspark.streaming import state as streamed


def phrase(i, **more):
    row = {"id": f"p{i}", "lang": "xx", "theme": 1, "english": "Hello", "romanization": "ola", "youSay": "OH-la", "soundTip": "soft h", "note": "", "source": "ours", "checked": "2026-01-02"}
    return {k: v for k, v in (row | more).items() if v is not ...}


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())


def test_phrases(spark, tmp_path):
    good = [phrase(1), phrase(2, source=..., checked=..., extra=[1]), phrase(3, theme="2", lang="yy")]
    put(tmp_path, "good.jsonl", "\r\n".join(["", *map(json.dumps, good), " \t ", ""]))
    put(tmp_path, "bad.jsonl", json.dumps(phrase(1)) + "\n{oops\n")
    put(tmp_path, "null.jsonl", json.dumps(phrase(1, note=None)))
    put(tmp_path, "lacks.jsonl", json.dumps(phrase(1, english=...)))
    put(tmp_path, "typed.jsonl", json.dumps(phrase(1, english=5)))
    put(tmp_path, "blank.jsonl", "\n \n")
    put(tmp_path, "zero.jsonl", "")
    rows, status = files.load_phrases(spark, str(tmp_path), ["good", "bad", "null", "lacks", "typed", "blank", "zero", "none"])
    seen = {r.asset.removesuffix(".jsonl"): (r.status, r.rows, r.page) for r in files.page_state(status).collect()}
    bad = ("malformed", 0, "failed")
    assert seen == {"good": ("ok", 3, "ready"), "bad": bad, "null": bad, "lacks": bad, "typed": bad, "blank": ("empty", 0, "empty"), "zero": ("empty", 0, "empty"), "none": ("missing", 0, "empty")}
    got = rows.orderBy("ord").collect()
    assert [(r.id, r.file_lang, r.lang, r.theme, r.source, r.checked, r.ord) for r in got] == [
        ("p1", "good", "xx", 1, "ours", "2026-01-02", 0), ("p2", "good", "xx", 1, "curated", "2026-11-06", 1), ("p3", "good", "yy", 2, "ours", "2026-01-02", 2)
    ]


def test_arrays_and_sound(spark, tmp_path):
    put(tmp_path, "catalog.json", json.dumps([{"code": "b", "name": "B", "status": "bench"}, {"code": "a", "name": "A", "status": "committed", "kitTotal": 7, "x": 1}]))
    rows, status = files.load_catalog(spark, str(tmp_path))
    assert [(r.code, r.kit_total, r.ord) for r in rows.orderBy("ord").collect()] == [("b", 40, 0), ("a", 7, 1)]
    assert status.first().status == "ok"
    assert files.load_numbers(spark, str(tmp_path), "q")[1].first().status == "missing"
    put(tmp_path, "numbers-q.json", "[]")
    assert files.load_numbers(spark, str(tmp_path), "q")[1].first()[1:] == ("ok", 0)
    put(tmp_path, "numbers-r.json", "{")
    assert files.load_numbers(spark, str(tmp_path), "r")[1].first().status == "malformed"
    rows, status = files.load_sound_check(spark, str(tmp_path), "q")
    assert rows.count() == 0 and status.first().status == "ok"
    put(tmp_path, "soundcheck-q.json", json.dumps({"lang": "q", "newSounds": "ñ", "rhythm": "even", "registerFirst": "formal", "trap": "t"}))
    rows, status = files.load_sound_check(spark, str(tmp_path), "q")
    assert rows.first().new_sounds == "ñ"
    put(tmp_path, "soundcheck-r.json", json.dumps({"lang": "q"}))
    assert files.load_sound_check(spark, str(tmp_path), "r")[1].first().status == "malformed"


def test_lint(spark, tmp_path):
    lines = [phrase(1, note="n"), phrase(2, note="n", theme=0), phrase(3, note=" "), phrase(4, note="n", youSay="low"), phrase(5, note="n", checked="2026-1-1"), phrase(6, note="n", english=..., soundTip=None, source=False)]
    put(tmp_path, "x.jsonl", "\n".join(["", *map(json.dumps, lines), "{bad", ""]))
    put(tmp_path, "y.jsonl", json.dumps(phrase(1, note="n", youSay="×")))
    put(tmp_path, "z.json", "{bad")
    found = lint.violations(files.lines_of(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("x.jsonl", 2, "missing", "theme"), ("x.jsonl", 3, "missing", "note"), ("x.jsonl", 4, "no_caps", "youSay"), ("x.jsonl", 5, "bad_date", "checked"),
        ("x.jsonl", 6, "missing", "english"), ("x.jsonl", 6, "missing", "soundTip"), ("x.jsonl", 6, "missing", "source"), ("x.jsonl", 7, "bad_json", ""),
    ]
    summed = lint.summary(files.lines_of(spark, str(tmp_path)), found)
    assert {r.file: (r.rows, r.errors, r.ok) for r in summed.collect()} == {"x.jsonl": (7, 8, False), "y.jsonl": (1, 0, True)}
    assert lint.passes(summed).first().ok is False
    assert lint.passes(summed.filter("ok")).first().ok is True
    assert lint.passes(summed.filter("file = ''")).first().ok is False


LOG_ROWS = [(1, "position", "a", 1, None, "3"), (2, "position", "a", 1, None, "x"), (3, "position", "a", 2, None, "5"), (4, "position", "a", 9, None, "5"), (5, "position", "a", 3, None, " 7 "),
            (6, "star_toggle", "a", None, "i", None), (7, "star_toggle", "a", None, "i", None), (8, "star_toggle", "a", None, "i", None), (9, "star_toggle", "a", None, "j", None), (10, "star_toggle", "a", None, "j", None),
            (11, "ack", "a", None, None, "1"), (12, "ack", "b", None, None, "0"), (13, "last_lang", None, None, None, "zz")]


def test_state(spark, tmp_path):
    log = spark.createDataFrame(LOG_ROWS, LOG)
    assert [tuple(r) for r in state.positions(log).collect()] == [("a", 2, 5)]
    assert [tuple(r) for r in state.stars(log).collect()] == [("a", "i")]
    assert {tuple(r) for r in state.acks(log).collect()} == {("a", True), ("b", False)}
    assert state.last_lang(log).first().last_lang == "zz" and state.last_lang(log.limit(3)).first().last_lang is None
    log.write.parquet(str(tmp_path / "log"))
    stream = streamed.read_log(spark, str(tmp_path / "log"))
    for frame, name in ((streamed.toggles(stream, state.STAR), "toggles"), (streamed.latest(stream, state.POSITION, "lang", "theme"), "latest")):
        q = frame.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("toggles").collect()} == {("a", "i", True), ("a", "j", False)}
    want = {tuple(r) for r in state.latest(log, state.POSITION, "lang", "theme").select("lang", "theme", "payload").collect()}
    assert {tuple(r) for r in spark.table("latest").select("lang", "theme", "payload").collect()} == want


def test_written_state(spark, tmp_path):
    """Rows are only added: the last write wins, a place is clamped, a language that didn't load isn't noted."""
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "es", 1, 9, 4), (2, "es", 1, -3, 4), (3, "it", 2, 5, None), (4, "es", 2, 7, 5)], "seq long, lang string, theme int, wanted int, n int")
    state.append(state.save_positions(rows.filter("seq > 1")), log)
    state.append(state.save_positions(rows.filter("seq = 1")), log)  # late, but not the last change
    status = spark.createDataFrame([("es", "ok"), ("it", "malformed")], "lang string, status string")
    state.append(state.save_opened(rows, status), log)
    state.append(state.save_acks(rows.filter("seq = 3")), log)
    read = spark.read.schema(LOG).parquet(log)
    assert {tuple(r) for r in state.positions(read).collect()} == {("es", 1, 0), ("it", 2, 0), ("es", 2, 4)}
    assert state.last_lang(read).first().last_lang == "es" and state.latest(read, state.LAST).first().seq == 4
    assert [tuple(r) for r in state.acks(read).collect()] == [("it", True)]
    assert state.positions(state.save_positions(rows.filter("seq = 4"), F.lit(2))).first().position == 1
