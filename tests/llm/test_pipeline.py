"""The pipeline's stages, each on all that the one before kept."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm.common import written

from .test_text_ops import join_brute, lines_brute, sha, words_brute


def test_pipeline(spark, tmp_path):
    import random

    random.seed(3)
    words = {"en": "the and that with from this have been which their would about", "fr": "le la des avec pour dans être une par plus sans nous"}
    say = lambda lang, n: " ".join(random.choice(words[lang].split()) for _ in range(n))
    passage, short = say("en", 120), say("en", 51)
    assert len(short) < 400
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = "\n".join(say(lang, 60) for _ in range(3))
        if i % 10 == 4:
            text += "\n" + passage + " " + say(lang, 5)
        if i % 10 == 6:
            text += "\n" + say("en", 3) + " " + short + " " + say(lang, 4)
        if i % 15 == 7:
            text = rows[0][1]
        if i % 12 == 5:
            text += "\nA shared footer line"
        rows.append((i, text, lang, "s", len(text)))
    rows += [(60, None, None, "s", 0), (61, "12 34", None, "s", 5), (62, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = written(stage(spark, docs, str(tmp_path / "sf")), f"test-{name}")
        if n == 4:
            break
        assert done.dtypes == docs.dtypes
        got = {r.doc_id: r.text for r in done.collect()}
        assert all(r.n_chars == len(r.text) for r in done.collect())
        ids = sorted(texts)
        before = [texts[i] for i in ids]
        if name == "language_id":
            assert set(got) == set(range(60)) and got == {i: texts[i] for i in got}
        elif name == "line_dedup":
            assert {i: sha(t) for i, t in got.items()} == {ids[r[0]]: r[3] for r in lines_brute(before)}
        elif name == "ngram_join":
            assert got == {ids[i]: before[i] for i, _, c in join_brute(before) if i == c}
        else:
            assert {i: t.encode() for i, t in got.items()} == {ids[i]: t for i, t in words_brute(before, 50).items()}
            assert all(re.search(re.escape(passage), t) is None and re.search(re.escape(short), t) is None for t in got.values())
        texts, docs = got, done
    packed = done.collect()
    assert {r.doc_id for r in packed} == set(texts) and all(r.offset + r.length <= 1024 for r in packed)
    run = sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path / "sf")).collect())
    assert run == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    assert zlib.crc32((2).to_bytes(4, "little")) in {r.ids_crc32 for r in packed} or "" not in texts.values()


def test_rejects_unsure_texts(spark):
    import random

    random.seed(5)
    words = {"en": "the and that with from this", "fr": "le la des avec pour dans"}
    rows = [(i, " ".join(random.choice(words[lang].split()) for _ in range(40)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    rows += [(200, "漢字 漢字 漢字 漢字", None), (201, "12 34", None), (202, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == set(range(200))
    one = docs.filter("lang = 'fr' OR doc_id > 199")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, one, "").collect()} == {*range(1, 200, 2), 200}


@pytest.mark.parametrize("rows", [0, 6])
def test_stages_with_clashing_columns(spark, tmp_path, rows):
    """Extra columns of any name, null and repeated ids and texts, empty tables."""
    text = "the same line of text\n" + " ".join(f"w{i}" for i in range(80))
    some = [(1, text, "en"), (1, text, "en"), (None, text, None), (2, None, "en"), (None, "", "en"), (3, "the and that", "en")][:rows]
    names = ["TEXT", "kept_text", "n_dropped", "n_bytes", "n_lines", "runs", "lines", "dk", "th", "ranges", "bytes", "score", "length", "body", "_0"]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(some, schema)
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names), F.lit(0).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns and [t for _, t in done.dtypes] == [t for _, t in docs.dtypes]
        assert all(list(r)[3:-1] == [f"own {n}" for n in names] for r in done.collect())
        docs = done
    left = sorted(((r[0], r[1]) for r in docs.collect()), key=repr)
    assert left == ([] if not rows else [(1, text), (3, "the and that"), (None, "")])  # the null id's lines are those of document 1
    assert corpus_pipeline.pack(spark, docs, "").count() == len(left)
