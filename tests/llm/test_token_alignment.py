import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskline.llm import token_alignment as ta

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return ta.Tokenizers(A, B)


def library(both, text):
    """Token ids and bytes of both sides by the libraries on the whole text, None where they do not give it back."""
    if not text:
        return None
    ids = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = [[table[i] or b"" for i in side] for table, side in zip(both.bytes, ids, strict=True)]
    return list(zip(ids, raw, strict=True)) if all(b"".join(r) == (" " + text).encode() for r in raw) else None


def brute(both, texts):
    """{row: the fields of the contract}, by sets of ends and all pairs of overlapping ranges."""
    links, parts = {}, {}
    for row, text in texts.items():
        sides = library(both, text)
        links[row] = parts[row] = None
        if sides is None:
            continue
        ranges = []
        for ids, raw in sides:
            ends = np.cumsum([len(r) for r in raw]).tolist()
            ranges.append([(i, s, e) for i, s, e in zip(ids, [0, *ends[:-1]], ends, strict=True)])
        cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        parts[row] = [([], []) for _ in cuts]
        for side, r in enumerate(ranges):
            for i, _, e in r:
                parts[row][bisect_left(cuts, e)][side].append(i)
        found, at = [], 0
        for i, s, e in ranges[0]:
            while ranges[1][at][2] <= s:
                at += 1
            k = at
            while k < len(ranges[1]) and ranges[1][k][1] < e:
                found.append((i, ranges[1][k][0]))
                k += 1
        links[row] = found, [len(r) for r in ranges]
    count = Counter(p for x in links.values() if x for p in x[0])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = {}
    for row in texts:
        if not links[row]:
            out[row] = (0, 0, 0, 0, 0, 0, "")
            continue
        (found, sizes), written = links[row], ";".join("|".join(",".join(map(str, side)) for side in g) for g in parts[row])
        out[row] = (*sizes, len(parts[row]), len(found), sum(count[p] == top[p[1]] for p in found), sum(count[p] for p in found), hashlib.sha256(written.encode()).hexdigest())
    return out


TRICKY = ["", " ", "  two  spaces ", "a\n b", "a \n b\n", "x\t y", "▁ in text ▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "漢字 かな 🙂🙂", "naïve café", " nbsp　wide", "a" * 3000, " " * 300 + "x", "it's we'll DON'T", "\x00 nul\x1f ", "\r\n\r\n", "é ﬁ ½"]


def test_pieces_give_the_tokens_of_the_whole_text(both):
    for text in TRICKY:
        assert text == " ".join(both.pieces(text)) or not text
    check_tokens(both, TRICKY)


def check_tokens(both, texts):
    (a, n_a), (b, n_b) = both.encode(texts)
    for text, p, q in zip(texts, np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]), strict=True):
        want = library(both, text)
        assert (p.tolist(), q.tolist()) == ((want[0][0], want[1][0]) if want else ([], []))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sab.1▁é"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_tokens_equal_the_libraries_on_random_text(texts):
    check_tokens(ta.load(A, B), texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 40), max_size=30), st.sets(st.integers(1, 40), max_size=30)), max_size=4))
def test_divide_and_conquer_finds_every_cut(texts):
    a, b, last, want, at = [], [], [], [], 0
    for x, y in texts:  # texts of 41 bytes
        want += [len(a) + k for k, e in enumerate(sorted(x | {41})) if e in y | {41}]
        a += [at + e for e in sorted(x | {41})]
        b += [at + e for e in sorted(y | {41})]
        last.append(len(a) - 1)
        at += 41
    assert ta.shared_cuts(*(np.array(v, np.int64) for v in (a, b, last))).tolist() == want


def test_query_equals_brute_force(spark, small, both):
    from duskline.llm import queries as q

    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = q.op11_token_alignment(spark, small).select("doc_id", *FIELDS).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(both, texts) and len(got) == len(texts)


@pytest.mark.parametrize("head", [ta.HEAD, 30, 0])
def test_odd_rows_with_and_without_a_table_of_frequent_pairs(spark, both, odd_rows, head):
    rows = [*[(r[0], r[1]) for r in odd_rows], *enumerate(TRICKY, 1000), (None, "a null id here")]
    docs = spark.createDataFrame([(*r, 1, b"p", "x") for r in rows], "doc_id long, text string, row long, pairs binary, n_best string").repartition(3)
    want = brute(both, {k: t for k, (_, t) in enumerate(rows)})
    got = ta.align(docs, A, B, head=head).select("doc_id", *FIELDS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((rows[k][0], *v) for k, v in want.items()), key=repr)


def test_empty_table_and_written_groups(spark, none):
    assert ta.align(none, A, B).collect() == []
    (row,) = ta.align_texts(spark.createDataFrame([(1, "naïve words")], "doc_id long, text string"), A, B, groups=True).collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_counts_are_handed_on_in_parts(spark, small):
    aligned = ta.align_texts(spark.read.parquet(f"{small}/documents.parquet").limit(40), A, B).cache()
    assert sorted(map(tuple, ta.pair_counts(aligned, held=100).collect())) == sorted(map(tuple, ta.pair_counts(aligned).collect()))


def test_memory_starts_afresh(both, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 5) for _ in range(50)) for _ in range(20)]
    monkeypatch.setattr(ta, "PIECES", 5)
    for t in texts:
        check_tokens(both, [t])
