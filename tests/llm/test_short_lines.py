"""Exact repeats of lines of any length."""

import corpus_pipeline
from framegauge.llm.line_dedup import line_dedup

ROWS = [(1, "Menu\n\nread more\none two three four five\n\u5168\u884c\u4e2d\u6587"), (2, "Menu\n\n read  more \nnew here\n\u5168\u884c\u4e2d\u6587"),
        (3, "Menu\nmenu\nMenu"), (4, None), (5, "one two three four five\nread less"), (None, "new here"), (6, "read more")]
KEPT = {1: ROWS[0][1], 2: "\nnew here", 3: "menu", 4: None, 5: "read less", None: "", 6: ""}


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    got = line_dedup(docs).collect()
    assert {r["doc_id"]: r["text"] for r in got} == KEPT
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {1: 0, 2: 3, 3: 2, 4: 0, 5: 1, None: 1, 6: 1}


def test_pipeline_leaves_no_stub_of_a_copy(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ROWS + [(7, ROWS[0][1])]],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == KEPT | {7: ""}
