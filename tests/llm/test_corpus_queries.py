"""Each query opN_ over the smallest tables: its columns, and its rows against its SQL where it has one."""

import os

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages".split()
COLUMNS = {
    "op1_html_extract": "page_id url text n_chars",
    "op2_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_sentencepiece": "doc_id",
    "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_ngram_join": "doc_id n_shingles component_id",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_top_k": "query_id rank vec_id score",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_quality_crf": "doc_id held_out score predicted",
    "op13_centroid_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    frame = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    rows = frame.collect()
    assert rows
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        theirs = con.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted(tuple(map(str, r)) for r in theirs.fetchall()) == sorted(tuple(str(r[n]) for n in names) for r in rows)
