"""Byte-pair coding and the token store against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe, queries, tokenstore, wordstream
from quillspark.llm.scratch import Scratch

PATH = queries.tokenizer_file(queries.WORD_BPE)
ODD = [
    "", None, "Σας ΟΔΟΣ Σ", "don't I'M we'LL x'd", "été näive", "<|endoftext|>a<|startoftext|> b <|endoftext|>", "a\x1cb \x85 c　d", "日本語 🎉🎉!!", "12 3a4 $$5%%",
    "İstanbul ﬁ ǅ", "a'sb'tc ''s", "x" * 300, "ha" * 3000, "ͅ ́ a ́b", "À<|x|>é", "힣가", "***", "a***b%%%c", "the the the " * 200,
]
ROWS = [(i, t, "extra") for i, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", "x")]


@lru_cache(maxsize=1)
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@lru_cache(maxsize=1)
def _pieces():
    return tokenstore.LibraryPieces(PATH)


@pytest.fixture(scope="module")
def library():
    return _library()


@pytest.fixture(scope="module")
def coder():
    return bpe.ForcedBoundaryBPE(PATH)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeéST'’<|>0 \n\té")), max_size=60))
def test_any_text_is_coded_as_by_the_library(library, coder, text):
    want = ids_of(library, text)
    assert coder.encode(text) == want
    ids, counts = wordstream.WordEncoder(coder.encode_pieces).encode(pa.array([text, None]))
    assert ids.tolist() == want and counts.tolist() == [len(want), 0]
    assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abnst*é", min_size=1, max_size=90).map(str.encode))
def test_cut_or_not_and_by_heap_or_not_the_merges_are_the_same(coder, raw):
    ids = [coder.inner_id[b] for b in raw[:-1]] + [coder.final_id[raw[-1]]]
    assert coder._pretoken(raw) == coder._merge_long(list(ids))
    if len(raw) <= 40:
        assert coder._merge(raw, True) == coder._merge_long(list(ids))


def test_cuts_are_all_borders_between_bytes_that_no_token_joins(coder):
    raw = "zq%%é$x€".encode()
    assert coder.cuts(raw) == [i for i in range(1, len(raw)) if not coder.together[raw[i - 1], raw[i]]]
    assert coder.cuts("x€".encode()) and not coder.cuts(b"the")


def test_caches_start_anew(coder, library, monkeypatch):
    monkeypatch.setattr(wordstream, "CACHE_PIECES", 3)
    encoder = wordstream.WordEncoder(coder.encode_pieces)
    for text in ("one two three four", "five two six", "one seven"):
        assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(library, text)


def test_documents_round_trip(spark, docs, library):
    got = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    want = [(i, library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t, _ in ROWS]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_digests(spark, docs, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.coded_digests(docs, PATH).collect()}
    want = set()
    for i, t, _ in ROWS:
        ids = ids_of(library, t)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.coded_digests(docs.limit(0), PATH).count() == 0


def test_store_reads_back_every_document(spark, docs, library):
    scratch = Scratch(spark, "t")
    store = tokenstore.write_store(docs, PATH, scratch)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_digests(store, scratch).collect())
    coded = [(i, np.array(ids_of(library, t) + [2], "<u4")) for i, t, _ in ROWS]
    assert {(i, n, c) for _, i, n, c in got} == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in coded}
    assert [i for _, i, _, _ in got] == sorted((i for i, _ in coded), key=lambda i: (i is not None, i or 0))
    starts = [s for s, *_ in got]
    assert starts == np.concatenate(([0], np.cumsum([n for _, _, n, _ in got])))[:-1].tolist()
    whole = {(r["doc_id"], bytes(r["ids"])) for r in tokenstore.reconstruct(store).collect()}
    assert whole == {(i, x.tobytes()) for i, x in coded}
    assert tokenstore.reconstruct(store, spark.createDataFrame([(12,)], "doc_id long")).count() == 1


def test_equal_passages_share_chunks(spark):
    rng = np.random.default_rng(3)
    words = [" ".join(f"w{x}" for x in rng.integers(0, 500, 1500)) for _ in range(2)]
    texts = [words[0] + " x " + words[1], "y " + words[1]]
    store = tokenstore.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, Scratch(spark, "t"))
    listed = sum(len(r["digests"]) // tokenstore.DIGEST for r in store.recipes().collect())
    assert store.chunks().count() < listed


def test_a_damaged_chunk_is_found(spark, docs):
    scratch = Scratch(spark, "t")
    store = tokenstore.write_store(docs, PATH, scratch)
    bad = store.chunks().selectExpr("digest", "cast(concat(ids, X'0000') as binary) as ids")
    scratch.table(bad, "other")
    broken = tokenstore.TokenStore(spark, scratch.uri, store.width, store.id_type)
    rows = spark.read.parquet(scratch.path("other")).collect()
    spark.createDataFrame(rows, "digest binary, ids binary").write.mode("overwrite").parquet(scratch.path("chunks"))
    with pytest.raises(Exception, match="StoreDamaged"):
        tokenstore.read_digests(broken, scratch).collect()


def _stored(spark, docs):
    scratch = Scratch(spark, "t")
    store = tokenstore.write_store(docs, PATH, scratch)

    def change(name, how):
        stored = spark.read.parquet(scratch.path(name))
        rows = spark.createDataFrame(how([r.asDict() for r in stored.collect()]), stored.schema)
        rows.write.mode("overwrite").parquet(scratch.path(name))

    return store, scratch, change


def test_damage_to_recipes_and_manifest_is_found(spark, docs):
    def other_root(recipes):
        return [recipes[0] | {"root": tokenstore.digest_of(b"other")}, *recipes[1:]]

    def other_order(recipes):
        return [r | {"pos": 1000 - r["pos"]} for r in recipes]

    changes = {"recipes": [other_root, other_order, lambda r: r[1:]], "manifest": [lambda m: m[1:], lambda m: [m[0] | {"n_docs": m[0]["n_docs"] + 1}, *m[1:]]]}
    for name, ways in changes.items():
        for how in ways:
            store, scratch, change = _stored(spark, docs)
            change(name, how)
            with pytest.raises(tokenstore.StoreDamaged, match="part"):
                tokenstore.read_digests(store, scratch)


def test_a_missing_chunk_is_found(spark, docs):
    store, scratch, change = _stored(spark, docs)
    change("chunks", lambda c: c[1:])
    with pytest.raises(Exception, match="chunks missing of document"):
        tokenstore.read_digests(store, scratch).collect()


def test_a_recipe_that_disagrees_with_its_root_is_found(spark, docs):
    store, scratch, change = _stored(spark, docs)

    change("recipes", lambda recipes: [r | {"digests": r["digests"][:-1] + bytes([r["digests"][-1] ^ 1])} for r in recipes])
    with pytest.raises(Exception, match="StoreDamaged"):
        tokenstore.read_digests(store, scratch).collect()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeéİǅﬁ'12")), min_size=1, max_size=12), max_size=12))
def test_pieces_together_are_coded_as_alone(pieces):
    own = [p for p in pieces if not any(c.isspace() or ord(c) < 33 for c in p)]
    ids, n = _pieces()(own)
    want = [_library().encode(p, add_special_tokens=False).ids for p in own]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_an_empty_store(spark, docs):
    scratch = Scratch(spark, "t")
    assert tokenstore.read_digests(tokenstore.write_store(docs.limit(0), PATH, scratch), scratch).count() == 0


def test_crcs_move_over_words():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 70000):
        a, b = rng.bytes(33), rng.bytes(4 * n)
        moved = tokenstore.shift_crc(np.array([zlib.crc32(a)]), np.array([n]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_merkle_roots_depend_on_order():
    a, b, c = (tokenstore.digest_of(x) for x in (b"a", b"b", b"c"))
    roots = {tokenstore.merkle_root(x) for x in ([a, b, c], [b, a, c], [a, b], [a], [])}
    assert len(roots) == 5
