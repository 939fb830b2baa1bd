"""Every registered query over tables with nulls, empty and very long texts, repeated rows, ties, clashing extra columns, and over empty ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tolparse.llm.queries import QUERIES

LONG = "wörd " * 60000
DOCS = [
    (1, "Hello there world again", None, "a", None), (2, None, "en", None, 5), (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 3), (5, LONG, "en", "b", len(LONG)), (6, "x" * 50000, "en", "a", 1),
    (1, "Hello there world again", None, "a", None), (None, "null id", "en", "c", 7), (8, "\0 nul \x1c ü 🙂 é", "fr", "é", 9),
]
PAGES = [(1, "http://A.com/en/7x", "<p>hi</p>"), (2, None, None), (2, None, None), (3, "x", ""), (4, "://", "<div>" * 3000 + "deep"), (5, "http://x.org/es/", "<" * 3000 + "a")]
VECTORS = [(0, [1.0, 2.0]), (50, None), (50, [0.5, 1.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0])]
ITEMS = [(1, "Hello wörd"), (1, "Hello wörd"), (None, "null"), (4, None), (5, ""), (6, "?!")]
LABELS = [(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1), (6, 0, 0), (1, 0, 0)]
ROWS = {"op1_html_text": len(PAGES), "op7_url_filter": len(PAGES), "op3_multi_index": 4, "op11_ranked_search": 7} | dict.fromkeys(("op2_quality", "op4_gif_media", "op6_simhash", "op8_hidden_markov", "op9_piece_counts", "op10_systematic_mix", "op12_merkle", "op13_line_dedup"), len(DOCS))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    clash = {c: F.lit("clash") for c in ("size", "score", "key", "row", "copies", "held_out", "target", "host", "rule", "class", "quality_", "_row", "_bucket", "n", "fp", "media", "payload", "frames", "symbols", "sequence_id", "offset", "salt", "vector", "component_id")}
    for name, rows, schema in (
        ("documents", DOCS, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", LABELS, "doc_id long, quality int, toxic int"),
        ("benchmark", ITEMS, "item_id long, text string"), ("pages", PAGES, "page_id long, url string, html string"), ("embeddings", VECTORS, "vec_id long, embedding array<float>"),
    ):
        df = spark.createDataFrame(rows, schema).withColumns(clash)
        df.write.parquet(f"{path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty(spark, odd, name):
    rows = QUERIES[name](spark, f"{odd}/full").collect()
    assert name not in ROWS or len(rows) == ROWS[name]
    assert QUERIES[name](spark, f"{odd}/empty").count() == 0


def test_packing_has_every_document(spark, odd):
    rows = QUERIES["op5_harmonic_packing"](spark, f"{odd}/full").collect()
    assert sum(r.start == 0 for r in rows) == len(DOCS) and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sorted(r.doc_tokens for r in rows if r.start == 0)[:3] == [1, 1, 1]


def test_pipeline(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd}/full").count() > 0 and corpus_pipeline.run(spark, f"{odd}/empty").count() == 0
