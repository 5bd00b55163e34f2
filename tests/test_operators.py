"""Operators on small fixtures, and properties that hold whatever the data."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import analysis, evaluation, index, prep, retrieval, search, vectors
from quillspark.shared import new_path, shared_dir
from quillspark.sources import readers, sinks
from quillspark.streaming import maintenance

WORDS = ["pain", "fever", "cough", "the", "rare", "dose"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def bm25_by_hand(texts, query, k):
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = []
    for d, words in enumerate(toks):
        score = 0.0
        for w in query.split():
            tf, df = words.count(w), sum(w in t for t in toks)
            if tf and w != "the":
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        if score:
            out.append((-round(score, 6), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join), min_size=2, max_size=8).filter(lambda t: any(t)))
def test_search_equals_brute_force_pruned_or_not(spark, texts):
    i, q = index.build(docs(spark, texts)), asked(spark, "pain the pain rare", "cough fever")
    path = new_path(spark, "t")
    i.save(path)
    saved = index.load(spark, path)
    for found in (search.search(i, q, 3), search.search(saved, q, 3), search.pruned_search(i, q, 3), search.pruned_search(saved, q, 3)):
        for n, said in enumerate(("pain the pain rare", "cough fever")):
            got = [(r["doc_id"], r["score"]) for r in found.filter(F.col("query_id") == n).orderBy("rank").collect()]
            want = bm25_by_hand(texts, said, 3)
            assert [d for d, _ in got] == [d for d, _ in want]
            assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_pruning_leaves_postings_out_and_rows_as_they_are(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["pain", "fever"], k=6) + rng.choices([f"x{n}" for n in range(200)], k=4)) for _ in range(400)]
    path = new_path(spark, "t")
    index.build(docs(spark, texts)).save(path)
    i, q = index.load(spark, path), asked(spark, "pain fever x1 x2", "pain x7", "fever")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    scored = []
    whole = search._parts
    monkeypatch.setattr(search, "_parts", lambda *a: scored.append(df := whole(*a)) or df)
    assert rows(search.pruned_search(i, q, 3)) == rows(search.search(i, q, 3))
    essential = scored[1].count()
    assert essential < scored[-1].count() / 2


def test_search_edges(spark):
    i = index.build(docs(spark, ["pain", "pain", "", None]))
    assert [r["doc_id"] for r in search.search(i, asked(spark, "pain"), 5).orderBy("rank").collect()] == [0, 1]
    assert search.search(i, asked(spark, "the of and", "unknown"), 5).count() == 0
    assert search.search(i, asked(spark, "pain"), 0).count() == 0
    with pytest.raises(ValueError):
        search.search(i, asked(spark, "pain"), -1)
    once, twice = (search.search(i, asked(spark, q), 1).first()["score"] for q in ("pain", "pain pain"))
    assert twice == pytest.approx(2 * once, abs=2e-6)


def test_index_of_a_union_is_the_merge(spark, tmp_path):
    texts = ["pain fever", "cough", "pain pain the", ""]
    d = docs(spark, texts)
    whole, merged = index.build(d), index.merge(index.build(d.filter("doc_id < 2")), index.build(d.filter("doc_id >= 2")))
    rows = lambda df: sorted(map(tuple, df.select("term", "doc_id", "tf", "doc_len").collect()))
    assert rows(whole.postings) == rows(merged.postings)
    merged.save(str(tmp_path / "i"))
    loaded = index.load(spark, str(tmp_path / "i"))
    assert rows(loaded.postings) == rows(whole.postings)
    assert loaded.corpus_stats().first()["n_docs"] == 4


def test_fusion_by_hand_and_whatever_the_order(spark):
    rows = [(0, 7, "a", 1), (0, 7, "b", 3), (0, 8, "b", 1), (0, 9, "c", 1)]
    for r in (rows, rows[::-1]):
        fused = retrieval.fuse(spark.createDataFrame(r, "query_id long, doc_id long, stage string, rank int"), {"a": 0.8, "b": 1.0})
        got = {x["doc_id"]: x["score"] for x in fused.collect()}
        assert got == pytest.approx({7: round(0.8 / 61 + 1 / 63, 9), 8: round(1 / 61, 9)})


def ranked(spark, scores):
    return spark.createDataFrame([(0, i, s, i + 1) for i, s in enumerate(scores)], "query_id long, doc_id long, score double, rank int")


def test_thresholds_nth_and_gate(spark):
    r = ranked(spark, [0.9, 0.8, 0.8, 0.7])
    assert retrieval.over_threshold(r, 0.8).count() == 1
    assert retrieval.over_threshold(r, 0.8, strict=False).count() == 3
    assert retrieval.nth(r, 2).first()["doc_id"] == 2
    assert retrieval.nth(r, 9).count() == 0
    gated = retrieval.gate(r.withColumns({"useful": F.col("doc_id") > 0, "confidence": F.lit(0.5)}))
    assert gated.first()["doc_id"] == 1
    assert retrieval.gate(r.withColumns({"useful": F.lit(False), "confidence": F.lit(0.5)})).count() == 0


def test_rerank_keeps_the_order_of_ties(spark):
    r = ranked(spark, [3.0, 2.0, 1.0])
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 5.0)], "query_id long, doc_id long, score double")
    assert [x["doc_id"] for x in retrieval.rerank(r, scores).orderBy("rank").collect()] == [2, 0, 1]


def test_votes(spark):
    def voted(*answers):
        rows = [(1, i, a) for i, a in enumerate(answers)]
        return evaluation.vote(spark.createDataFrame(rows, "question_no long, run_id int, answer string")).first()["answer"]

    assert voted("A", "B", "B", "A") == "A"
    assert voted("[invalid]", "[invalid]", "A") == "[invalid]"


def test_confidence_interval(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    row = evaluation.confidence_interval(df, "x").first()
    assert (row["mean"], row["high"]) == pytest.approx((0.2, round(0.2 + 1.96 * 0.1 / math.sqrt(3), 6)))


def test_normalised_questions(spark):
    df = spark.createDataFrame([({"B": "two", "A": "one"}, "B", ["c1", "c2"], "no")], "options map<string,string>, answer string, contexts array<string>, decision string")
    assert [c["letter"] for c in evaluation.normalise_map(df, "options", "answer").first()["choices"]] == ["A", "B"]
    yes = evaluation.normalise_yes_no(df, "contexts", "decision").first()
    assert (yes["answer_key"], yes["context"]) == ("B", "c1\nc2")


def test_balance_keeps_all_false_and_the_first_true(spark):
    df = spark.createDataFrame(list(enumerate([1, 1, 0, 1, 0, 1])), "n long, label int")
    assert sorted(r["n"] for r in prep.balance(df, "label", "n").collect()) == [0, 1, 2, 4]


def test_sequential_split_over_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "n")
    split = prep.sequential_split(df, "n").groupBy("split").agg(F.min("n"), F.max("n")).collect()
    assert {r[0]: (r[1], r[2]) for r in split} == {"train": (0, 699), "valid": (700, 849), "test": (850, 999)}


def test_places_hold_whatever_partitions_are_joined(spark):
    """With these settings adaptive execution joins other partitions when rows are counted than when they are read."""
    chosen = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in chosen}
    try:
        for k, v in chosen.items():
            spark.conf.set(k, v)
        df = spark.range(200_000).select("id", F.rpad(F.md5(F.col("id").cast("string")), 128, "x").alias("s"))
        placed, n = prep.positions(df, "id")
        assert n == 200_000 and placed.filter("place is null or place <> id + 1").count() == 0
        assert [r["id"] for r in prep.row_range(df, "id", 100_000, 100_010).orderBy("id").collect()] == list(range(100_000, 100_010))
        split = prep.sequential_split(df, "id").groupBy("split").agg(F.min("id"), F.max("id")).collect()
        assert {r[0]: (r[1], r[2]) for r in split} == {"train": (0, 139_999), "valid": (140_000, 169_999), "test": (170_000, 199_999)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_places_of_no_rows_nulls_and_ties(spark):
    df = spark.createDataFrame([(2,), (None,), (1,), (1,)], "n long")
    assert sorted((r["place"], r["n"]) for r in prep.positions(df, "n")[0].collect()) == [(1, None), (2, 1), (3, 1), (4, 2)]
    assert prep.positions(df.limit(0), "n")[1] == 0 and prep.row_range(df.limit(0), "n", 0, 5).count() == 0


def test_stratified_split_keeps_shares_of_every_label(spark):
    rows = [(i, None if i % 10 == 9 else "ab"[i % 10 > 5]) for i in range(1000)]
    got = prep.stratified_split(spark.createDataFrame(rows, "k long, label string"), "label", "k").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in got} == {(label, split): round(n * share) for label, n in (("a", 600), ("b", 300), (None, 100)) for split, share in (("train", 0.7), ("valid", 0.15), ("test", 0.15))}


def test_every_nth_goes_by_place(spark):
    df = spark.createDataFrame([(x,) for x in (50, 7, 3, 101, 22)], "n long")
    assert sorted(r["n"] for r in prep.every_nth(df, 2, "n").collect()) == [3, 22, 101]


def test_passages_of_few_words(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "alpha beta"), (3, "one two three four five six seven"), (4, None), (5, "!!!")], "item_id long, text string")
    texts = ["x one two three y", "xalpha betax", "one two three four five six seven", "one two  three", None, "wow!!!"]
    got = {r["item_id"]: r["n_docs"] for r in prep.contaminated_passage(items, docs(spark, texts)).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 5: 1}
    assert {r["item_id"]: r["n_docs"] for r in prep.contaminated_passage(items, docs(spark, texts), 7).collect()} == {1: 3, 2: 1, 3: 3, 5: 1}


def test_chunks_hold_all_sentences_in_order(spark):
    text = " ".join(f"This is sentence {n} of some." for n in range(40))
    got = prep.chunk_texts(docs(spark, [text, "", None, "one " * 90 + "end. Next."]), 60).orderBy("doc_id", "chunk_no").collect()
    assert " ".join(r["chunk"] for r in got if r["doc_id"] == 0) == text
    counts = {(r["doc_id"], r["chunk_no"]) for r in prep.sentence_chunks(docs(spark, [text, "", None, "one " * 90 + "end. Next."]), 60).collect()}
    assert counts == {(r["doc_id"], r["chunk_no"]) for r in got}


def test_vote_combinations_ties_go_to_the_first(spark):
    rows = [(r, 1, a, "B", a == "B") for r, a in enumerate("BCD")]
    facts = spark.createDataFrame(rows, "run_id int, question_no long, answer string, correct_answer string, is_correct boolean")
    assert analysis.vote_combinations(facts, [0, 1, 2], 3).first()["accuracy"] == 1.0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_with_nulls_over_many_blocks(spark, monkeypatch, metric):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    odd = [(None, [1.0] * 4), (100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0]), (103, [])]
    v = spark.createDataFrame(rows + odd, "id long, vector array<double>").repartition(3)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 11)
    got = {}
    for r in vectors.nearest(v.filter("id % 3 = 0 or id is null"), v, 4, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]

    def far(a, b):
        if metric == "l2":
            return sum((x - y) ** 2 for x, y in zip(a, b))
        return -sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = {i: {r + 1: j for r, (_, j) in enumerate(sorted((round(far(a, b), 6), j) for j, b in rows if j != i)[:4])} for i, a in rows if i % 3 == 0}
    assert got == want


def test_cells_are_saved_and_searched(spark, tmp_path):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(5)]) for i in range(200)] + [(None, [1.0] * 5), (500, None)], "id long, vector array<double>")
    vectors.cell_index(v, 6).save(str(tmp_path / "cells"))
    loaded, asked_for = vectors.CellIndex.load(spark, str(tmp_path / "cells")), v.filter("id < 20")
    exact = vectors.nearest(asked_for, v, 3, "l2")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(loaded.search(asked_for, 3, 6)) == rows(exact)
    some = [vectors.recall(loaded.search(asked_for, 3, n), exact).first()["recall"] for n in (1, 3, 6)]
    assert some[0] < some[2] == 1.0 and some[0] <= some[1]
    none = vectors.cell_index(v.limit(0))
    assert none.search(asked_for, 3, 2).count() == 0


def test_embeddings_come_from_a_model_and_score_candidates(spark):
    made = vectors.embed(docs(spark, ["aab", None]), lambda: lambda texts: [[t.count("a"), len(t)] for t in texts])
    assert {r["id"]: r["vector"] for r in made.collect()} == {0: [2.0, 3.0], 1: [0.0, 0.0]}
    found = spark.createDataFrame([(0, 0), (0, 1), (0, 9)], "query_id long, doc_id long")
    assert {r["doc_id"]: r["score"] for r in vectors.cosine_scores(found, made, made).collect()} == {0: 1.0, 1: None, 9: None}


def test_fusion_of_the_surviving_list(spark):
    ranked = spark.createDataFrame([(0, d, r, s) for s, order in (("a", [1, 2, 3, 4]), ("b", [4, 3, 2, 1])) for r, d in enumerate(order, 1)], "query_id long, doc_id long, rank int, stage string")
    left = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 2, 3)], "query_id long, doc_id long, rank int")
    fused = retrieval.fuse_surviving(left, ranked, {"a": 1.0, "b": 2.0})
    assert [r["doc_id"] for r in fused.orderBy("rank").collect()] == [3, 2, 1]
    assert [r["doc_id"] for r in retrieval.best_only(fused).collect()] == [3]
    assert [r["doc_id"] for r in retrieval.fuse_surviving(left, ranked.limit(0), {"a": 1.0}).orderBy("rank").collect()] == [3, 1, 2]


def test_nearest_keeps_ties_at_the_border(spark):
    v = spark.createDataFrame([(i, [float(x), 1.0]) for i, x in enumerate([1, 1, 1, 1, 5])], "id long, vector array<double>")
    got = vectors.nearest(v.filter("id = 3"), v, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 1]


def test_pairwise_and_listwise(spark):
    r = ranked(spark, [1.0, 3.0]).withColumn("strength", F.col("score"))
    assert retrieval.pairwise(r).orderBy("rank").first()["doc_id"] == 1
    turned = retrieval.listwise(ranked(spark, [4.0, 3.0, 2.0, 1.0]).select("query_id", "doc_id", "rank"), lambda _, d: list(range(len(d)))[::-1], 2)
    assert {x["doc_id"] for x in turned.collect()} == {0, 1, 2, 3}


LOG = """2025-01-01 00:00:00,000 - INFO - use_RAG: True
2025-01-01 00:00:01,000 - INFO - RAG data: [{'docId': 'x1', 'BM25_score': 2.5, 'MonoT5_score': 0.5}]
2025-01-01 00:00:02,000 - INFO - question 1/4 num:5 answer:C correct_answer:B False
2025-01-01 00:00:03,000 - INFO - question 2/4 num:6 answer:D correct_answer:D True
2025-01-01 00:00:04,000 - INFO - question 4/4 num:9 answer:D correct_answer:D True
2025-01-01 00:00:05,000 - INFO - use_RAG: False
a line without a stamp
2025-01-01 00:00:06,000 - INFO - question 1/1 answer:A correct_answer:A True
"""


def test_logs_end_at_a_gap_and_restart_at_a_header(spark, tmp_path):
    (tmp_path / "run.txt").write_text(LOG)
    got = readers.answers_from_log(readers.log_lines(spark, str(tmp_path))).orderBy("run_no", "question_no").collect()
    assert [(r["run_no"], r["question_no"], r["answer"], r["is_correct"]) for r in got] == [(1, 1, "C", False), (1, 2, "D", True), (2, 1, "A", True)]
    assert got[0]["rag"][0]["docId"] == "x1" and got[1]["rag"] is None


def test_sections(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Context:\nc1\nc2\nQuestion:\nq1\n[output]True\nContext:\nd\nQuestion:\nq2\n[output]False\nContext:\nopen")
    got = readers.sections(readers.log_lines(spark, str(tmp_path)), {"Context:": "context", "Question:": "question"}, "[output]").orderBy("record").collect()
    assert [(r["context"], r["question"], r["output"]) for r in got] == [("c1\nc2", "q1", "True"), ("d", "q2", "False")]


def test_tagged_documents_keep_angle_brackets(spark, tmp_path):
    record = "<DOC>\n<DOCNO>\n{}\n</DOCNO>\n<TEXT>\n{}\n</TEXT>\n</DOC>\n"
    (tmp_path / "c.xml").write_text(record.format("d1", "a < b\nc") + record.format("d2", "x"))
    assert sorted(map(tuple, readers.tagged_documents(spark, str(tmp_path)).collect())) == [("d1", "a < b\nc"), ("d2", "x")]


def test_small_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 ||| good ||| film\n0 ||| bad\nno label\n")
    assert sorted(map(tuple, readers.delimited_labels(spark, str(tmp_path / "l.txt")).collect())) == [(0, "bad"), (1, "good ||| film")]
    (tmp_path / "q.json").write_text('{"quiz": {"s": {"q1": {"question": "x?", "options": ["a", "b"], "answer": "a"}}}}')
    row = readers.json_questions(spark, str(tmp_path / "q.json")).first()
    assert (row["section"], row["name"], row["options"], row["answer"]) == ("s", "q1", ["a", "b"], "a")


def test_readers_of_whole_files_see_whole_files(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"quiz": {\n"s": {"q1": {"question": "x?",\n "options": ["a"], "answer": "a"}}}}\n')
    assert readers.json_questions(spark, str(tmp_path / "q.json")).count() == 1
    (tmp_path / "c.json").write_text('{"a": {"0": "x",\n"1": "y"}, "n": {"1": 5, "2": 6}}')
    assert sorted(map(tuple, readers.json_columns(spark, str(tmp_path / "c.json"), {"a": "string", "n": "bigint", "z": "string"}).collect())) == [("0", "x", None, None), ("1", "y", 5, None), ("2", None, 6, None)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\n\nb\n")
    (tmp_path / "docs" / "b.html").write_text("<p>\n</p>")
    assert {(r["file"][-4:], r["text"]) for r in readers.whole_files(spark, str(tmp_path / "docs")).collect()} == {("a.md", "# A\n\nb\n"), ("html", "<p>\n</p>")}
    assert tuple(readers.folder_size(spark, str(tmp_path / "docs")).first()) == (2, 7 + 8)
    assert [r["line_no"] for r in readers.log_lines(spark, str(tmp_path / "docs" / "a.md")).collect()] == [0, 1, 2, 3]


def test_records_whose_markers_carry_values(spark, tmp_path):
    (tmp_path / "t.txt").write_text("before\n[question index:] 7\n[question_and_options:]Q\nA. x\n[rag_doc:]0:one: two\nlost\n[rag_doc:]1:\n[expected_output:] out\nmore\n\n[question index:]8\n[question_and_options:]R\n")
    got = readers.keyed_sections(spark, str(tmp_path), "[question index:]", {"[question_and_options:]": "question", "[expected_output:]": "output"}, ("[rag_doc:]", "docs")).orderBy("record").collect()
    assert [(r["number"], r["question"], r["docs"], r["output"]) for r in got] == [(7, "Q\nA. x", ["one: two", ""], "out\nmore"), (8, "R", [], "")]


def test_a_shared_folder_must_be_named_off_a_local_master(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    assert shared_dir(spark)


def test_streamed_index_equals_the_batch_one(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    d = docs(spark, ["pain fever", "cough pain", "rare"])
    d.filter("doc_id < 2").write.parquet(source)
    schema = d.schema
    for _ in range(2):
        maintenance.maintain_index(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
        if not (tmp_path / "done").exists():
            d.filter("doc_id = 2").write.mode("append").parquet(source)
            (tmp_path / "done").write_text("")
    got = spark.read.parquet(*map(str, sorted(tmp_path.glob("out/batch=*/postings"))))
    rows = lambda df: sorted(map(tuple, df.select("term", "doc_id", "tf").collect()))
    assert rows(got) == rows(index.build(d).postings)
    assert rows(maintenance.merge_parts(spark, out).postings) == rows(got)


def test_sinks_write_what_readers_read(spark, tmp_path):
    df = spark.createDataFrame([("d1", "a <b> c"), ("d2", "x")], "doc_no string, content string")
    sinks.write_tagged(df, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.tagged_documents(spark, str(tmp_path / "t")).collect())) == [("d1", "a <b> c"), ("d2", "x")]
    lines = spark.sql("select timestamp'2025-01-01 00:00:00' as ts, 'INFO' as level, 'use_RAG: True' as message")
    sinks.append_log(lines, str(tmp_path / "l"))
    assert readers.log_lines(spark, str(tmp_path / "l")).filter("level = 'INFO'").first()["message"] == "use_RAG: True"
    sinks.append_run(df, str(tmp_path / "r"), "a")
    sinks.append_run(df.limit(1), str(tmp_path / "r"), "b")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    sinks.write_results_json(df, str(tmp_path / "j"), model="m")
    assert spark.read.json(str(tmp_path / "j")).filter("model = 'm'").count() == 2


def test_the_last_row_without_documents_is_dropped(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, [])], "n int, docs array<string>")
    assert sorted(r["n"] for r in prep.drop_incomplete(df, "docs", "n").collect()) == [1, 2]
    assert prep.drop_incomplete(df.filter("n = 1"), "docs", "n").count() == 1


def test_model_scores_by_batch(spark):
    r = ranked(spark, [2.0, 1.0])
    asked_, texts = spark.createDataFrame([(0, "ab")], "query_id long, query string"), spark.createDataFrame([(0, "abc"), (1, "x")], "doc_id long, text string")
    model = lambda: lambda queries, docs: [float(len(set(q) & set(d))) for q, d in zip(queries, docs)]
    got = {x["doc_id"]: x["score"] for x in retrieval.score_pairs(r, asked_, texts, model).collect()}
    assert got == {0: 2.0, 1: 0.0}
