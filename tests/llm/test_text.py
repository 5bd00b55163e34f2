"""Language identification, decontamination, chat formatting."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, langid, latent, queries
from quillspark.llm.scratch import Scratch

TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "", "odd\nrole<|"]), st.text(alphabet=st.sampled_from("ab<|\\>né🎉 \n"), max_size=30))


@settings(max_examples=120, deadline=None)
@given(st.lists(TURN, max_size=6))
def test_renderings_parse_back_and_masks_cover_assistant_texts(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    coded = chat._tokenizer(queries.tokenizer_file(queries.BYTE_BPE)).encode(formatted, add_special_tokens=False)
    clipped = chat.loss_spans(np.array(coded.offsets, np.int64).reshape(-1, 2), spans)
    covered = [x for a, b in clipped for x in range(a, b)]
    assert covered == [x for a, b in spans for x in range(a, b)]


def test_conversations_with_nulls_ties_and_control_strings(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "assistant", None), (3, 0, None, "x"), (None, 0, "user", "y"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (5, 0, "assistant", "long " * 20000), (5, None, "user", "first")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, queries.tokenizer_file(queries.BYTE_BPE))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[1]["loss_sha256"] == sha(said)
    assert (got[2]["loss_chars"], got[2]["n_turns"]) == (0, 1) and got[3]["turns_sha256"] == sha("\nx\n")
    assert got[None]["n_turns"] == 1 and got[4]["loss_sha256"] == sha("ab")
    assert got[5]["loss_chars"] == 100000 and got[5]["turns_sha256"] == sha("user\nfirst\nassistant\n" + "long " * 20000 + "\n")
    assert chat.read_back(chat.format_conversations(df.limit(0), queries.tokenizer_file(queries.BYTE_BPE))).count() == 0


def test_conversations_beside_a_null_id_stay_apart(spark):
    ids = [None, 1 << 53, (1 << 53) + 1, (1 << 53) + 2]
    df = spark.createDataFrame([(i, 0, "assistant", str(i)) for i in ids], "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.read_back(chat.format_conversations(df, queries.tokenizer_file(queries.BYTE_BPE)).coalesce(1)).collect()
    assert {(r["conv_id"], r["n_turns"], r["loss_sha256"]) for r in got} == {(i, 1, hashlib.sha256(str(i).encode()).hexdigest()) for i in ids}


def test_held_out_is_the_remainder_of_the_crc(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", langid.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_languages_of_held_out_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = langid.identify_languages(docs, Scratch(spark, "t")).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count() > 0
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the hat", "en"), ("der Hund und die Katze", "de")] * 30)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!! 🎉", None), (1003, "der Hund " * 50000, None), (None, "the cat", None), (1000, None, "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = langid.identify_languages(df, Scratch(spark, "t")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "de" and by[None]["lang_pred"] == "en" and by[None]["held_out"] is False
    none = langid.identify_languages(df.withColumn("lang", F.lit(None).cast("string")), Scratch(spark, "t"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.identify_languages(df.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("others", [0, 40])
def test_a_language_of_one_repeated_row_is_learned(spark, others):
    rows = [(1, "the cat and the hat", "en")] * 1500 + [(i, f"der Hund {i} und die Katze", "de") for i in range(others)] + [(None, "le chat est la", "fr")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~langid.held_out(F.col("doc_id")) | F.lit(True))
    model = langid.train(docs.select(F.col("doc_id").alias("id"), "lang", "text"), Scratch(spark, "t"))
    assert model.languages == (("de", "en", "fr") if others else ("en", "fr"))
    best, _, _ = langid.score_texts(model, ["the cat", "le chat"])
    assert [model.languages[k] for k in best] == ["en", "fr"]


def test_the_sample_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(15)
    rows = [(int(i), " ".join(rng.choice(["a", "bc", "def", "gh"], 6)), "xy"[i % 2]) for i in rng.integers(0, 300, 700)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").select("id", "lang", "text")
    small = langid.Training(per_language=60)
    one, many = (langid.train(docs.repartition(n), Scratch(spark, "t"), small) for n in (1, 7))
    assert np.array_equal(one.table, many.table) and one.temperature == many.temperature


def test_ftrl_against_a_dense_reference():
    """Each step by the formulas of FTRL-proximal over dense vectors, coordinate by coordinate."""
    rng = np.random.default_rng(16)
    chosen = langid.Training(epochs=2, l1=0.6, l2=0.1)
    x = rng.random((40, 6)) * (rng.random((40, 6)) < 0.5)
    truth = rng.integers(0, 3, 40)
    rows = [(int(k), np.flatnonzero(v), v[v > 0]) for k, v in zip(truth, x)]
    got, bias = langid.fit_ftrl(rows, 3, 6, chosen)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(i, k):
        if abs(z[i][k]) <= chosen.l1:
            return 0.0
        sign = 1 if z[i][k] > 0 else -1
        return -(z[i][k] - sign * chosen.l1) / ((chosen.beta + n[i][k] ** 0.5) / chosen.alpha + chosen.l2)

    order = np.random.default_rng(7)
    for _ in range(chosen.epochs):
        for r in order.permutation(40):
            dense = [*x[r], 1.0]
            w = [[weight(i, k) for k in range(3)] for i in range(7)]
            logits = [sum(dense[i] * w[i][k] for i in range(7)) for k in range(3)]
            p = [np.exp(v) / sum(np.exp(u) for u in logits) for v in logits]
            for i in range(7):
                for k in range(3):
                    g = dense[i] * (p[k] - (truth[r] == k))
                    sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / chosen.alpha
                    z[i][k] += g - sigma * w[i][k]
                    n[i][k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(7)])
    assert np.allclose(got, want[:-1]) and np.allclose(bias, want[-1])
    assert (got == 0).any() and (got != 0).any()


def test_tfidf_of_the_sample_against_counting_by_hand(spark):
    texts = ["aba", "ab", "b"]
    model = langid.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang string"), Scratch(spark, "t"))
    # one language: all weights stay 0, so the table shows none; document frequencies are seen through two
    assert model.languages == ("x",) and not model.table.any()
    orders, borders, _ = langid.ngrams(texts)
    present = [set(np.concatenate([o[a:b] for o in orders])) - {-1} for a, b in zip(borders, borders[1:])]
    assert [len(p) for p in present] == [len({*t} | {t[i : i + 2] for i in range(len(t) - 1)} | {t[i : i + 3] for i in range(len(t) - 2)}) for t in (" aba ", " ab ", " b ")]


def test_every_labelled_language_is_learned(spark):
    rng = np.random.default_rng(14)
    text = lambda k: " ".join("".join(chr(0x4E00 + 40 * k + c) for c in rng.integers(0, 20, 4)) for _ in range(8))
    rows = [(f"l{k:02d}", text(k)) for k in range(70) for _ in range(16 if k < 69 else 1)]
    model = langid.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lang string, text string"), Scratch(spark, "t"))
    assert model.languages == tuple(f"l{k:02d}" for k in range(70))
    best, _, _ = langid.score_texts(model, [text(k) for k in range(69)] + [rows[-1][1]])
    assert best.tolist() == list(range(70))


def test_sample_of_many_languages_is_smaller_for_each():
    chosen = langid.Training()
    assert [chosen.rows_of(n) for n in (1, 64, 80, 128, 5000)] == [500, 500, 320, 125, 50]


def test_ngrams_by_hand():
    orders, borders, letters = langid.ngrams(["Ab1c", "", "é"])
    assert letters.tolist() == [3, 0, 1]
    assert np.diff(borders).tolist()[0] == len(" ab c ") and all(len(o) == borders[-1] for o in orders)
    again, edges, _ = langid.ngrams(["x", "Ab1c"])
    for a, b in zip(orders, again):
        assert a[: borders[1]].tolist() == b[edges[1] : edges[2]].tolist()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 400)
    logits = rng.standard_normal((400, 3)) * 3
    logits[np.arange(400), truth] += 2
    t = langid.fit_temperature(logits * 5, truth)
    assert 3 < t < 20


ITEMS = [
    (1, "The seventh quartz lantern was moved below the harbour bridge before winter came. Which lantern was moved? The quartz lantern."),
    (2, "Violet engines rarely hum when copper valves are closed. Name the colour of rare engines."),
    (3, None),
    (4, "!!!"),
]


def filler(rng, n):
    return " ".join(f"{a}{b}" for a, b in zip(rng.choice(["ra", "to", "mi", "se"], n), rng.choice(["ling", "ver", "dan", "pol", "x"], n)))


def test_planted_items_are_found_and_clean_documents_left_alone(spark):
    rng = np.random.default_rng(6)
    clean = [(i, filler(rng, 200), "c") for i in range(60)]
    whole = ITEMS[0][1]
    paraphrase = whole.replace("below", "under").replace("winter", "the winter").replace("before", "shortly before")
    planted = [(100, filler(rng, 90) + " " + whole + " " + filler(rng, 60), "p"), (101, whole.upper().replace(" ", "!! "), "p"), (102, filler(rng, 33) + " " + paraphrase + " " + filler(rng, 20), "p"), (103, ITEMS[1][1], "p"), (104, filler(rng, 30000) + " " + ITEMS[1][1], "p")]
    odd = [(200, None, "o"), (201, "", "o"), (202, "the the the " * 500, "o"), (None, whole, "o"), (100, planted[0][1], "again")]
    docs = spark.createDataFrame(clean + planted + odd, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = latent.contaminated(docs, bench, Scratch(spark, "t")).collect()
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["item_id"]) for r in got) == [(-1, 1), (100, 1), (100, 1), (101, 1), (102, 1), (103, 2), (104, 2)]
    assert latent.contaminated(docs.limit(0), bench, Scratch(spark, "t")).count() == 0
    assert latent.contaminated(docs, bench.limit(0), Scratch(spark, "t")).count() == 0


def test_every_verbatim_item_is_found_and_nothing_else(spark, tiny):
    docs, bench = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    shown = lambda t: " " + " ".join(latent.words_of(t)) + " "
    items = {r["item_id"]: shown(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], k) for r in docs.collect() for k, t in items.items() if t in shown(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(docs, bench, Scratch(spark, "t")).collect()}
    assert want and got == want


def test_short_items_are_found_at_every_offset(spark):
    rng = np.random.default_rng(12)
    rare = lambda n: " ".join(f"x{k}" for k in rng.integers(0, 1 << 40, n))
    items = [(n, " ".join(f"item{n}word{i}" for i in range(n, 0, -1))) for n in range(1, 9)]
    planted = [(100 * n + offset, rare(40 + offset) + " " + text + " " + rare(50)) for n, text in items for offset in range(8)]
    docs = spark.createDataFrame([*planted, (1, rare(300)), (2, "item2word1"), (3, items[7][1].replace("item8word3", "other"))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()}
    assert got == {(100 * n + offset, n) for n, _ in items for offset in range(8)} | {(3, 8)}


def test_short_items_against_checks_of_every_stretch():
    rng = np.random.default_rng(13)
    own = [f"w{i}" for i in range(40)]
    tokens = latent.Columns(own, 64)
    texts = [(k, " ".join(rng.choice(own, n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 11, 15, 16])]
    chosen = latent.Decontamination()
    idf = rng.random(tokens.width) + 1
    items = latent.prepare(texts, tokens, idf, np.linalg.qr(rng.standard_normal((tokens.width, 4)))[0], chosen)
    counts = np.array([70, 0, 3, 90, 1] * 12)
    columns = rng.integers(0, tokens.width, counts.sum()).astype("<u2")
    ends = np.cumsum(counts)
    for k in range(200):  # pieces of items with some of their words replaced
        item = np.array(items.words[int(rng.integers(len(texts)))].words)
        at = int(rng.integers(len(columns) - len(item)))
        columns[at : at + len(item)] = np.where(rng.random(len(item)) < 0.75, item, columns[at : at + len(item)])
    want = set()
    for d, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
        for k, item in enumerate(items.words):
            size = latent.stretch(item.size)
            if n and any(latent.verify(item, items.answers[k], columns[i : min(end, i + size)].tolist(), chosen)[0] for i in range(end - n, end)):
                want.add((d, k))
    near = {(d, k) for d, k, *_ in latent._short_candidates(items, columns, counts, chosen)}
    assert len(want) > 50 and want <= near


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=15))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert latent.Pattern(a).common(b) == table[-1][-1]


def test_words_are_runs_of_letters_and_digits():
    assert latent.words_of("A-b's ÉTÉ 12x, 日本 🎉") == ["a", "b", "s", "été", "12x", "日本"]
    words, index, counts = latent.word_lists(pa.array([None, "", "b a b"]))
    assert counts.tolist() == [0, 0, 3] and words.take(pa.array(index)).to_pylist() == ["b", "a", "b"]


def invented(rng, n, common=0.5):
    """Words of which half are drawn from forty frequent ones and half from many rare ones."""
    rare = [f"{a}{b}{c}" for a, b, c in zip(rng.choice(["ka", "lo", "vi", "du"], n), rng.integers(0, 3000, n), rng.choice(["n", "r", "st"], n))]
    return [f"w{int(40 * x * x)}" if y < common else r for x, y, r in zip(rng.random(n), rng.random(n), rare)]


def paraphrases(rng, items, rates):
    """(item, text) with a share of an item's words left out, put for others, or moved between strangers."""
    for k, text in items:
        own = text.split()
        for rate in rates:
            for kind in ("left out", "others", "inserted"):
                gone = rng.random(len(own)) < rate
                said = [x for x, g in zip(own, gone) if not g] if kind == "left out" else [o if g else x for x, g, o in zip(own, gone, invented(rng, len(own)))]
                if kind == "inserted":
                    for word in invented(rng, len(own) // 6):
                        said.insert(int(rng.integers(len(said))), word)
                yield k, " ".join(invented(rng, int(rng.integers(0, 90))) + said + invented(rng, int(rng.integers(0, 90))))


def accepted_by_every_stretch(pattern, answer, text, chosen):
    size = latent.stretch(pattern.size)
    return any(latent.verify(pattern, answer, text[i : i + size], chosen)[0] for i in range(max(1, len(text) - pattern.size // 2)))


def test_paraphrases_that_checks_of_every_stretch_accept_are_found(spark):
    rng = np.random.default_rng(21)
    items = [(k, " ".join(invented(rng, int(rng.integers(17, 70))))) for k in range(60)]
    planted = list(paraphrases(rng, items, (0.1, 0.2, 0.3, 0.4)))
    docs = [(1000 + i, t) for i, (_, t) in enumerate(planted)] + [(i, " ".join(invented(rng, 300))) for i in range(300)]
    chosen = latent.Decontamination()
    tokens = latent.Columns(sorted({w for _, t in items for w in latent.words_of(t)}), 1 << 20)
    patterns = {k: [latent.Pattern(tokens.of_text(w)) for w in (latent.words_of(t), latent.answer_of(t, chosen.answer_words))] for k, t in items}
    want = {(1000 + i, k) for i, (k, t) in enumerate(planted) if accepted_by_every_stretch(*patterns[k], tokens.of_text(latent.words_of(t)), chosen)}
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(frame, bench, Scratch(spark, "t")).collect()}
    assert len(want) > 300 and len(want & got) >= 0.97 * len(want)
    assert all(d >= 1000 and planted[d - 1000][0] == k for d, k in got)


def test_candidates_come_from_the_latent_space():
    rng = np.random.default_rng(22)
    items = [(k, " ".join(invented(rng, 40))) for k in range(30)]
    tokens = latent.Columns(sorted({w for _, t in items for w in latent.words_of(t)}), 512)
    idf = np.log(1000 / (1 + np.arange(tokens.width) % 97)) + 1
    planted = list(paraphrases(rng, items, (0.25,)))
    columns, counts = tokens.encode(pa.array([t for _, t in planted]))
    corpus = np.linalg.qr(rng.standard_normal((tokens.width, 8)) * (np.arange(tokens.width) % 97 > 60)[:, None])[0]

    def found(**other):
        chosen = latent.Decontamination(**other)
        return {(d, k) for d, k, *_ in latent._candidates(latent.prepare(items, tokens, idf, corpus, chosen), columns, counts, chosen)}

    whole = found()
    assert sum((d, k) in whole for d, (k, _) in enumerate(planted)) >= 0.97 * len(planted)
    # without the decomposition's directions of the items, or with few of them, others are candidates
    assert found(item_rank=0) != whole and found(item_rank=4) != whole
    dense = latent.prepare(items, tokens, idf, corpus, latent.Decontamination())
    space = dense.directions[:-1] * dense.quantum / idf[:, None]
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=0.02)


def test_candidates_are_all_windows_over_the_cosine():
    rng = np.random.default_rng(23)
    chosen = latent.Decontamination(cosine=0.3)
    items = [(k, " ".join(invented(rng, int(n)))) for k, n in enumerate(rng.integers(17, 60, 25))]
    tokens = latent.Columns(sorted({w for _, t in items for w in latent.words_of(t)}), 256)
    idf = rng.random(tokens.width) * 5 + 1
    made = latent.prepare(items, tokens, idf, np.linalg.qr(rng.standard_normal((tokens.width, 6)))[0], chosen)
    texts = [" ".join(invented(rng, int(n))) for n in rng.integers(0, 150, 40)] + ["", items[3][1], items[4][1] + " " + items[5][1]]
    columns, counts = tokens.encode(pa.array(texts))
    want, ends = {}, np.cumsum(counts)
    directions = made.directions.astype(float)
    for d, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
        own = columns[end - n : end]
        own = own[np.concatenate(([True], own[1:] != own[:-1]))] if n else own
        for group in made.groups:
            for at in range(-(-len(own) // 8)):
                z = directions[own[8 * at : 8 * (at + group.span)]].sum(axis=0)
                for k in group.items.tolist():
                    want[d, k] = max(want.get((d, k), -1), z @ made.latent[k] / max(1e-12, np.linalg.norm(z)))
    got = {}
    for d, k, _, _, cosine in latent._candidates(made, columns, counts, chosen):
        got[d, k] = max(got.get((d, k), -1), cosine)
    assert got and all(abs(want[pair] - c) < 0.02 or c < want[pair] for pair, c in got.items())
    strong = [pair for pair, c in want.items() if c > 0.75]
    assert len(strong) >= 3 and all(pair in got for pair in strong)


def test_leading_directions_are_those_of_a_dense_svd():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 80)) * 3 + 0.01 * rng.standard_normal((300, 80))
    sketch = rng.standard_normal((80, 12))
    got = latent.leading_directions(a.T @ (a @ sketch), sketch)
    right = np.linalg.svd(a)[2][:5]
    assert np.linalg.norm(right @ got) ** 2 == pytest.approx(5, abs=0.01)


def test_pipeline_stages(spark):
    rng = np.random.default_rng(9)
    text = [filler(rng, 120) for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(text)] + [(20, text[0], "en"), (21, text[0], None), (22, "12 !!", "en"), (23, None, "en"), (24, text[3] + " " + ITEMS[1][1], "en"), (5, text[5], "en"), (None, text[6], "en")]
    docs = spark.createDataFrame([(*r, "s", 1, "x", 0.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    path = Scratch(spark, "t").path("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES, ([*range(12), 5, 20, 21, 24, None], [*range(12), 24, None], [*range(12), None], [*range(12), None])):
        kept = Scratch(spark, "t").table(stage(spark, kept, path), name)
        key = lambda i: (i is None, i or 0)
        assert sorted((r["doc_id"] for r in kept.collect()), key=key) == sorted(ids, key=key), name
        assert name == "bpe_coding" or kept.columns == docs.columns
    assert corpus_pipeline.run(spark, path).count() == 13
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
