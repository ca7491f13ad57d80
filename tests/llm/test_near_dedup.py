import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskline.llm.hashing import shingle_sets
from duskline.llm.near_dedup import _block_links, near_duplicates, superminhash


def brute(rows, k=4):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        s = frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))) if words else frozenset()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_equal_brute_force_with_a_hot_group(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(0, 7))) for i in range(150)]  # one bucket larger than a block of pairs
    rows += [(1000 + i, edited(rng, [f"s{g}_{j}" for j in range(60)], rng.randrange(0, 3))) for g in range(10) for i in range(g, 200, 40)]
    rows += [(5000 + i, f"short {i}") for i in range(5)] + [(6000, "Short 1"), (6001, ""), (6002, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got}[6001] == 0


def test_odd_rows(odd, none, odd_rows):
    got = near_duplicates(odd.withColumnRenamed("source", "component_id"), k=4).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 6 and by[5].component_id == 4 and by[2].n_shingles == by[3].n_shingles == 0
    assert by[None].component_id is None and by[None].kept
    assert near_duplicates(none).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\nÉx", max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, k):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in raw]))).astype(np.int64)
    hashes, doc = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, k)
    seen = {}
    for i, b in enumerate(raw):
        w = b.lower().split()
        want = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        own = frozenset(hashes[doc == i].tolist())
        assert len(own) == len(want)
        assert seen.setdefault(own, want) == want


def test_words_that_polynomial_hashes_confuse_are_not_linked(spark):
    from .test_texts import thue_morse

    rows = [(i, thue_morse(*p, 2048)) for i, p in enumerate(("th", "ht", "on", "no", "xe", "ex"))]
    rows += [(10 + i, f"a {t} b c d") for i, (_, t) in enumerate(rows)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}


def test_signature_estimates_similarity_with_low_variance():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        est = []
        for _ in range(300):
            both = rng.integers(1, 2**60, 60, dtype=np.uint64)
            n = int(60 * share)
            a, b = both, np.concatenate((both[:n], rng.integers(1, 2**60, 60 - n, dtype=np.uint64)))
            sig = superminhash(np.concatenate((a, b)), np.repeat([0, 1], 60), 2, 96)
            est.append((sig[0] == sig[1]).mean())
        true = n / (120 - n)
        assert abs(np.mean(est) - true) < 0.02 and np.std(est) < 0.9 * np.sqrt(true * (1 - true) / 96)


@pytest.mark.parametrize("n", [1, 3, 40, 900])
def test_signature_fills_every_slot_and_ignores_order(n):
    e = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = superminhash(e, np.zeros(n, int), 1, 96), superminhash(e[::-1].copy(), np.zeros(n, int), 1, 96)
    assert (one == two).all() and (one < 0xFFFFFFFF).all()


def test_block_links_join_each_component_once():
    import pandas as pd

    s = np.arange(50, dtype=np.uint64)
    row = lambda node, side, elements: {"bucket": 1, "node": node, "comp": node, "side": side, "i": 0, "j": 0, "elements": elements.tobytes()}
    group = pd.DataFrame([row(1, 0, s), row(2, 1, s), row(3, 1, s[:45]), row(4, 1, s + np.uint64(1000))])
    assert sorted(map(tuple, _block_links(group, 80, 100).to_numpy().tolist())) == [(1, 2), (1, 3)]


def test_one_id_with_two_texts_is_one_document(spark):
    words = lambda t: " ".join(f"{t}{i}" for i in range(30))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, ""), (7, c), (7, None), (8, c + " end"), (9, words("d"))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: {x.component_id for x in got if x.doc_id == r.doc_id} for r in got} == {1: {1}, 2: {1}, 3: {1}, 7: {7}, 8: {7}, 9: {9}}
    assert {r.doc_id: r.component_id for r in got} == brute(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
