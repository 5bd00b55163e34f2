"""SimHash and embedding near-duplicates against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillspark.llm import rotcodes, simhash
from quillspark.llm.components import connected_components, forest
from quillspark.llm.scratch import Scratch


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(ids, linked):
    comp = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


TEXTS = ["", None, "a", "a b", " A  b\tC\nd ", "É Ab c d", "\x1cx y\tz", "a b c " * 400, "   "]


def test_fingerprints():
    got = simhash.majority_bits(*simhash.shingle_hashes(pa.array(TEXTS)))
    assert got.tolist() == [fingerprint_by_hand(t) for t in TEXTS]
    assert simhash.majority_bits(*simhash.shingle_hashes(pa.array([], pa.string()))).tolist() == []


def test_documents_with_copies_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 300, 400)) for _ in range(6)]
    texts = TEXTS + base + base[:2] + [b.replace(" w7 ", " w8 ", 1) for b in base] + [base[0] + " end"]
    rows = [(i + 10, t, "x", 1) for i, t in enumerate(texts)] + [(None, base[0], "x", 1), (10, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    fps = {i: fingerprint_by_hand(t) for i, t, *_ in rows if i is not None}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = components_by_hand(sorted(fps), pairs)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == want[10 + len(TEXTS)]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["fp"] & (2**64 - 1) == fps[r["doc_id"]]
    assert simhash.near_duplicates(docs.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_links_lose_nothing_in_hot_buckets(spark, hot):
    rng = np.random.default_rng(1)
    fps = set()
    for b in rng.integers(-(2**62), 2**62, 12).tolist():
        for _ in range(25):
            x = b
            for k in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << k
            fps.add(np.uint64(x & (2**64 - 1)).astype(np.int64).item())
        fps |= {b ^ i for i in range(20)}
    a = np.array(sorted(fps))
    i, j = np.nonzero(np.triu(np.bitwise_count((a[:, None] ^ a[None]).view(np.uint64)) <= 3, 1))
    want = dict(zip(*(x.tolist() for x in forest(a[i], a[j]))))
    scratch = Scratch(spark, "t")
    links = simhash.near_links(spark.createDataFrame([(x,) for x in a.tolist()], "fp long"), scratch, hot_bucket=hot, block=20)
    got = {r["node"]: r["component"] for r in connected_components(links, scratch).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def test_components_of_long_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1050))
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def brute(vectors, ids, threshold=0.9):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(np.triu(linked, 1))
    comp = dict(zip(*(x.tolist() for x in forest(ids[a], ids[b]))))
    return {int(i): (int(n), comp.get(int(i), int(i))) for i, n in zip(ids, linked.sum(axis=1))}


@pytest.mark.parametrize("search", [rotcodes.Search(), rotcodes.Search(bucket=30, block=64)])
def test_embeddings_recall_and_exactness(spark, search):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((800, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((800, 64))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.895, 0.95, (800, 1))
    group = base[:1] + 0.03 * rng.standard_normal((300, 64))
    vectors = np.concatenate((base, c * base + np.sqrt(1 - c * c) * other, group, base[:5], base[:5] * 3.0))
    ids = np.arange(len(vectors)) + 7
    want = brute(vectors, ids)
    odd = [(90001, None), (90002, [0.0] * 64), (90003, [float("nan")] * 64), (90004, [1.0, None]), (None, base[0].tolist()), (90005, [1.0, 2.0]), (90006, [2.0, 4.0]), (90007, [])]
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)] + [(i, v, 1) for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rotcodes.near_duplicates(df, Scratch(spark, "t"), search).collect()}
    assert len(got) == len(rows)
    total = sum(n for n, _ in want.values())
    found = sum(got[i][0] for i in want)
    assert 0.9 * total <= found <= total
    assert all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i][2] == (got[i][1] == i) for i in want)
    for i in (90001, 90002, 90003, 90004, 90007):
        assert got[i] == (0, i, True)
    assert got[90006] == (1, 90005, False) and got[None] == (0, None, True)
    assert rotcodes.near_duplicates(df.limit(0), Scratch(spark, "t"), search).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    search = rotcodes.Search().plan(5000)
    units = rng.standard_normal((400, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    signs, factors, _ = rotcodes.encode(units, search)
    found, half = rotcodes.estimates(signs, factors, search)
    true = units @ units.T
    off = ~np.eye(400, dtype=bool)
    assert abs((found - true)[off].mean()) < 0.005
    assert (np.abs(found - true) <= half)[off].mean() > 0.9999
    # pairs at the threshold stay open
    other = rng.standard_normal((400, 64))
    other -= (other * units).sum(axis=1, keepdims=True) * units
    near = 0.9 * units + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    signs, factors, _ = rotcodes.encode(np.concatenate((units, near)), search)
    a, b = rotcodes.open_pairs(signs, factors, search)
    assert {(i, i + 400) for i in range(400)} <= set(zip(a.tolist(), b.tolist()))
    assert len(a) < 0.05 * 800 * 799 / 2


def test_few_pairs_are_computed_again_and_codes_alone_are_shuffled(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((3000, 64)).astype(np.float32)
    vectors[1500:1600] = vectors[:100] + 0.02 * rng.standard_normal((100, 64))
    search, scratch = rotcodes.Search(bucket=64).plan(3000), Scratch(spark, "t")
    distinct = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(vectors)], "id long, copies long, vector binary")
    found = rotcodes.near_links(distinct, search, scratch, "<f4").collect()
    again = sum(r["n"] for r in found if r["u"] is None)
    links = sum(r["n"] for r in found if r["u"] is not None and r["v"] is None)
    assert links == 200 and 100 <= again < 0.02 * 3000 * 2999 / 2
    assert "vector" not in spark.read.parquet(scratch.path("codes")).columns
    # rows with an open pair are few, so few vectors go into cells
    assert spark.read.parquet(scratch.path("open")).count() < 0.3 * 3000 * search.tables
