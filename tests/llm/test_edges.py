"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.decontaminate import drop_leaks, find_leaks
from tidemark.llm.html_text import extract_main_text
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.lm_score import score_documents
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import keep_good, score_quality
from tidemark.llm.simhash import keep_one_of_each, near_duplicates
from tidemark.llm.substring_dedup import remove_repeats, without_repeats
from tidemark.llm.suffix_dedup import remove_earlier_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, size string, root long, rank int, score string, kept int, target string"
LONG = " ".join(f"word{k % 997}x{k}" for k in range(60_000))
ROWS = [
    (None, None, None, None, None),
    (None, "no id here at all but some words", "en", "s1", 5),
    (1, "", "en", "s1", 0),
    (2, " \t\n ", None, "s2", 3),
    (3, LONG, "en", None, len(LONG)),
    (4, "one two three four five six seven", "en", "s1", 33),
    (4, "one two three four five six seven", "en", "s1", 33),
    (5, "one two three four five six seven", "en", "s2", 33),
    (5, "same id with another text 😀 é", "fr", "s2", 20),
    (6, "Released under the MIT License.", "en", "s3", 31),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "c", 7, "z", 1, 2, "q", 0, "t") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, None), (4, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (None, ""), (3, "...")], "item_id long, text string")


def each(labels, benchmark):
    return {
        "simhash": near_duplicates,
        "quality": lambda d: score_quality(d, labels),
        "licenses": scan_licenses,
        "substrings": remove_repeats,
        "leaks": lambda d: find_leaks(d, benchmark),
        "mix": mix_sources,
        "lm": score_documents,
        "suffix": remove_earlier_repeats,
    }


@pytest.mark.parametrize("name", ["simhash", "quality", "licenses", "substrings", "leaks", "mix", "lm", "suffix"])
def test_every_operator_keeps_every_row(docs, labels, benchmark, name):
    run = each(labels, benchmark)[name]
    rows = run(docs).collect()
    if name == "licenses":
        assert [(r.doc_id, r.license, r.coverage) for r in rows] == [(6, "MIT-notice", 1.0)]
    elif name == "leaks":
        assert {(r.doc_id, r.item_id) for r in rows} == {(4, 1), (5, 1)} and len(rows) == 3
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert run(docs.limit(0)).count() == 0


def test_empty_side_tables(docs, labels, benchmark):
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert find_leaks(docs, benchmark.limit(0)).count() == 0
    assert drop_leaks(docs, benchmark.limit(0)).count() == len(ROWS)
    assert keep_good(docs, labels.limit(0)).count() == len(ROWS)


def test_values_of_edge_rows(docs):
    lm = {(r.doc_id, r.n_words): r.log_score for r in score_documents(docs).collect()}
    assert lm[1, 0] == 0 and lm[2, 0] == 0 and lm[None, 0] == 0
    prints = {(r.doc_id, r.fingerprint): r.component_id for r in near_duplicates(docs).collect()}
    assert prints[1, 0] == prints[2, 0] == prints[None, 0] == 1
    cut = {(r.doc_id, r.n_bytes): r for r in remove_earlier_repeats(docs).collect()}
    assert cut[3, len(LONG)].n_removed == 0 and cut[None, 0].n_spans == 0
    words = {(r.doc_id, r.n_words): r.n_removed for r in remove_repeats(docs).collect()}
    assert words[3, 60_000] == 0 and words[4, 7] == 0


def test_stages_return_the_columns_of_documents(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert name == "mixing" or out.dtypes == rows.dtypes
            out.collect()


def test_filtering_stages(docs):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in kept.select("doc_id").collect())
    assert ids == [0, 1, 3, 4, 5, 6]
    whole = without_repeats(docs.select("doc_id", "text", "n_chars", "chunk"), window=5)
    assert {r.text for r in whole.filter("doc_id = 4").collect()} == {""}
    assert {r.n_chars for r in whole.filter("doc_id = 4").collect()} == {0}


def test_pages(spark):
    rows = [(None, None, None, 1), (1, None, "", 1), (1, "http://a.b/", "<article>x &amp; <b>y</b></article>", 1), (1, "http://a.b/", "<article>x &amp; <b>y</b></article>", 1), (2, "::odd", "<p>" + "long " * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract_main_text(pages).collect())
    assert got == [(0, 0), (1, 0), (1, 5), (1, 5), (2, 249_999)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (51, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (52, [])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, query string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert nearest(vectors.limit(0)).count() == 0
    assert nearest(vectors.filter(F.col("vec_id") == 4)).count() == 0
