"""What grows with the input is neither shuffled nor computed twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import index, search, vectors
from quillspark.plans import catalog

ODD = ["Pain; FEVER, x1 Kelvin İx", "", None, "café naïve_7", "a" * 300 + " b", "One. Two!  Three?\tFour", "\u0001x. y", " . ! ", "x. y. z", "No end"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_and_sentences_of_bytes_are_those_of_columns(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", text.tokens(F.col("t")).alias("w"), text.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [w.decode() for w in text.byte_tokens((r["t"] or "").encode())] == r["w"]
        if r["t"] is not None:
            assert [s.decode() for s in text.byte_sentences(r["t"].encode())] == r["s"]


def test_index_is_built_without_a_shuffle(spark):
    built = index.build(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"))
    assert "Exchange" not in plan(built.postings) and "Exchange" not in plan(built.doc_stats)


def test_corpus_stats_writes_no_index(spark, tiny, monkeypatch):
    monkeypatch.setattr(catalog, "_index", lambda *_: pytest.fail("no index is needed"))
    assert catalog.corpus_stats(spark, tiny).first()["n_docs"] == spark.read.parquet(f"{tiny}/documents.parquet").count()


def test_postings_are_not_shuffled_by_term_and_documents_not_for_the_found(spark, tiny):
    i, q = catalog._index(spark, tiny), catalog._questions(spark, tiny)
    assert "hashpartitioning(term" not in plan(search.score(i, search.asked_terms(i, q)))
    found = search.search(i, q, 3, documents=spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"))
    assert "hashpartitioning(doc_id" not in plan(found)


def test_sparse_scores_are_the_candidates_alone(spark):
    q = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0)], "query_id long, term string, q double")
    d = spark.createDataFrame([(7, "a", 1.0), (7, "b", 1.0), (8, "a", 5.0)], "doc_id long, term string, d double")
    asked = spark.createDataFrame([(1, 7), (2, 8), (2, 9)], "query_id long, doc_id long")
    assert sorted(map(tuple, vectors.sparse_dot(q, d, asked).collect())) == [(1, 7, 5.0), (2, 8, 5.0)]


@pytest.mark.parametrize("name", ["rrf_fusion", "cascade_topk", "sparse_dot_rerank", "dense_rerank", "cascade_all_stages", "pairwise_rerank"])
def test_stages_do_not_search_again(spark, tiny, name):
    files = [f for f in catalog.QUERIES[name](spark, tiny).inputFiles() if "/postings/" in f]
    once = [f for f in catalog._index(spark, tiny).postings.inputFiles()]
    # at most the sparse stage reads postings, those of its candidates
    assert set(files) <= set(once) and plan(catalog.QUERIES[name](spark, tiny)).count("/postings") <= 1


def test_cells_and_blocks_leave_few_rows_a_query(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(3000)] + [(9000, None), (9001, [1.0, None, 0.0, 0.0]), (9002, [1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    cells = vectors.cell_index(v.filter("id < 3000"), 5)
    exact = sorted(map(tuple, vectors.nearest(v.filter("id < 200"), v, 3, "l2").collect()))
    assert len(exact) == 600
    ranked, top_k = [], vectors.top_k
    monkeypatch.setattr(vectors, "top_k", lambda df, *a, **b: ranked.append(df) or top_k(df, *a, **b))
    for least in (vectors.BROADCAST_BYTES, 0):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", least)
        assert sorted(map(tuple, cells.search(v.filter("id < 200"), 3, 5).collect())) == exact
    # before the ranking a block of vectors leaves three rows a query, not one for each of its vectors
    assert ranked[0].count() < 200 * 3000 / 3


def test_chunks_of_a_long_document_take_one_pass(spark):
    import time

    from quillspark.operators import prep

    long = "one two three four five. " * 40_000
    began = time.time()
    made = prep.chunk_texts(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    assert made.agg(F.count("*"), F.sum(F.length("chunk"))).first()[0] == 3334
    assert time.time() - began < 30


def test_log_lines_are_numbered_across_the_splits_of_a_file(spark, tmp_path):
    from quillspark.sources import readers

    lines = [f"2025-01-01 00:00:00,000 - INFO - line {n}" if n % 7 else "" for n in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("\n".join(lines[:3000]) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        got = readers.log_lines(spark, str(tmp_path))
        # no row holds a file
        assert "posexplode" not in plan(got)
        assert got.select(F.spark_partition_id()).distinct().count() > 4
        for name, want in (("a.txt", lines), ("b.txt", [*lines[:3000], ""])):
            mine = got.filter(F.endswith("file", F.lit(name))).orderBy("line_no").collect()
            assert [r["line_no"] for r in mine] == list(range(len(want)))
            assert [r["message"] for r in mine] == [x[33:] if x else "" for x in want]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
