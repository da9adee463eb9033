"""The stored log: batches that count once, snapshots with what came after, and the stream."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from quillspark.functions.schemas import LOG
from quillspark.operators import state
from quillspark.sources.folders import listed
from quillspark.streaming import state as streamed

random.seed(9)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def rows(n, first=0):
    out = []
    for i in range(first, first + n):
        op = random.choice([state.POSITION, state.STAR, state.NOTE, state.LAST, state.ACK])
        lang = random.choice(["a", "b", "ü/x"])
        payload = {state.POSITION: str(random.randint(-1, 9)), state.NOTE: random.choice(["", "n", None]), state.LAST: lang, state.ACK: "1"}.get(op)
        out.append((i, op, lang, random.randint(1, 9), random.choice("ij"), payload))
    random.shuffle(out)
    return out


def folds(log):
    return [rows_of(f(log)) for f in (state.positions, state.stars, state.notes, state.acks, state.last_lang)]


def test_a_batch_counts_once(spark, tmp_path):
    log = str(tmp_path / "log")
    some = rows(200)
    frame = spark.createDataFrame(some, LOG)
    want = folds(frame)
    name = state.append(frame, log)
    assert state.append(spark.createDataFrame(some[::-1], LOG).repartition(3), log) == name  # the same rows in another order are the same batch
    assert state.batches(spark, log) == [name] and folds(state.read_log(spark, log)) == want
    assert state.append(frame.filter("seq < 50"), log, "named") == "named"  # rows met in two batches are the same changes
    assert state.append(frame.limit(0), log, "named") == "named"
    assert folds(state.read_log(spark, log)) == want
    assert state.read_log(spark, str(tmp_path / "none")).count() == 0


def test_an_unfinished_batch_isnt_there(spark, tmp_path):
    log = str(tmp_path / "log")
    frame = spark.createDataFrame(rows(40), LOG)
    name = state.append(frame, log)
    (tmp_path / "log" / f"batch={name}" / "_SUCCESS").unlink()
    assert state.read_log(spark, log).count() == 0
    assert state.append(frame, log) == name and state.read_log(spark, log).count() == 40


def test_snapshots_and_what_came_after(spark, tmp_path):
    log = str(tmp_path / "log")
    parts = [rows(150, 150 * i) for i in range(4)]
    late = [(700 + i, *r[1:]) for i, r in enumerate(rows(50))]
    everything = spark.createDataFrame([*sum(parts, []), *late], LOG)
    for i in (2, 0, 3):  # not in the order of seq
        state.append(spark.createDataFrame(parts[i], LOG), log)
        assert state.compact(spark, log) == (2, 0, 3).index(i) + 1
    assert state.compact(spark, log) == 3  # nothing new
    for i, more in enumerate((parts[1], late)):
        state.append(spark.createDataFrame(more, LOG), log, f"late{i}")
    now = state.current(spark, log)
    assert rows_of(now) == rows_of(state.folded(everything).select(*now.columns))
    assert folds(state.as_log(now)) == folds(everything)
    for lang in ("a", "ü/x", "zz"):
        one = state.current(spark, log, state.POSITION, lang)
        assert rows_of(state.positions(state.as_log(one))) == rows_of(state.positions(everything).filter(F.col("lang") == lang))
    (tmp_path / "log" / "snapshot-3.json").unlink()  # a snapshot that didn't get done doesn't count
    assert rows_of(state.current(spark, log)) == rows_of(now)
    assert state.compact(spark, log) == 3 and rows_of(state.current(spark, log)) == rows_of(now)


def test_what_a_snapshot_covers_can_go(spark, tmp_path):
    log = str(tmp_path / "log")
    some = spark.createDataFrame(rows(200), LOG)
    first = state.append(some.filter("seq < 120"), log)
    state.compact(spark, log)
    state.append(some.filter("seq >= 120 AND seq < 160"), log, "two")
    state.compact(spark, log)
    state.append(some.filter("seq >= 160"), log, "three")
    state.retire(spark, log)
    assert state.batches(spark, log) == ["three"] and sorted(n for n, _, _ in listed(spark, log)) == ["batch=three", "snapshot-2.json", "snapshot=2"]
    assert folds(state.as_log(state.current(spark, log))) == folds(some)
    assert state.append(some.filter("seq < 120"), log) == first and state.batches(spark, log) == ["three"]  # a covered batch stays one that was
    assert state.compact(spark, log) == 3 and folds(state.as_log(state.current(spark, log))) == folds(some)


def test_a_point_read_opens_its_partitions_only(spark, tmp_path):
    log = str(tmp_path / "log")
    state.append(spark.createDataFrame(rows(300), LOG), log)
    state.compact(spark, log)
    want = rows_of(state.current(spark, log, state.POSITION, "a"))
    top = tmp_path / "log" / "snapshot=1"
    for op, is_folder, _ in listed(spark, str(top)):
        for lang, _, _ in listed(spark, str(top / op)) if is_folder else []:
            if (op, lang) != ("op=position", "file_lang=a"):
                for file in (top / op / lang).glob("*.parquet"):
                    file.write_bytes(b"not a table")
                    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert rows_of(state.current(spark, log, state.POSITION, "a")) == want
    with pytest.raises(Exception):  # noqa: B017
        state.current(spark, log, state.POSITION, "b").collect()


def test_stream_tells_changes_only_and_resumes(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    put = lambda *found: state.append(spark.createDataFrame(list(found), LOG), log)
    run = lambda: streamed.follow(streamed.read_log(spark, log), out, checkpoint).awaitTermination()
    told = lambda: {(r.op, r.lang, r.theme, r.item_id): (r.value, r.version) for r in streamed.told(spark, out).collect()}
    place = (state.POSITION, "a", 1, None)
    star = (state.STAR, "a", None, "i")
    put((10, state.POSITION, "a", 1, "x", "3"), (11, state.STAR, "a", 5, "i", None), (11, state.STAR, "a", 5, "i", None))
    run()
    assert told() == {place: ("3", 1), star: ("on", 1)}
    put((4, state.POSITION, "a", 1, "y", "9"))  # late: the last write stays
    run()
    assert told()[place] == ("3", 1)
    put((20, state.POSITION, "a", 1, "x", "3"))  # a change to the same value isn't told
    run()
    put((15, state.POSITION, "a", 1, "x", "7"))  # later than the first, but before the last
    run()
    assert told()[place] == ("3", 1)
    put((21, state.POSITION, "a", 1, "x", "8"), (5, state.STAR, "a", 2, "i", None))  # a late toggle turns over
    run()
    assert told() == {place: ("8", 2), star: ("off", 2)}
    again = state.batches(spark, log)
    put((21, state.POSITION, "a", 1, "x", "8"), (5, state.STAR, "a", 2, "i", None))  # the same batch again
    run()
    assert state.batches(spark, log) == again and told() == {place: ("8", 2), star: ("off", 2)}


def test_stream_agrees_with_the_folds(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    everything = rows(300)
    for i in range(3):
        state.append(spark.createDataFrame(everything[i::3], LOG), log)
        streamed.follow(streamed.read_log(spark, log, 1), out, checkpoint).awaitTermination()
    frame = spark.createDataFrame(everything, LOG)
    held = streamed.told(spark, out).cache()
    assert rows_of(held.filter("op = 'star_toggle' AND value = 'on'").select("lang", "item_id")) == rows_of(state.stars(frame))
    assert rows_of(held.filter("op = 'position'").select("lang", "theme", "value")) == rows_of(state.latest(frame, state.POSITION, "lang", "theme").select("lang", "theme", "payload"))
    assert held.filter("op = 'last_lang'").first().value == state.last_lang(frame).first().last_lang
    shutil.rmtree(checkpoint)


def test_notes(spark, tmp_path):
    said = spark.createDataFrame([(1, "a", "i", "one"), (3, "a", "i", None), (2, "a", "j", "two"), (0, "b", "i", "old")], "seq long, lang string, item_id string, text string")
    assert rows_of(state.notes(state.save_notes(said))) == [("a", "i", ""), ("a", "j", "two"), ("b", "i", "old")]
