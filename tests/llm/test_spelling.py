import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from duskline.llm import spelling as sp

LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))


def brute_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_groups(n):
    out = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS}
        near = sorted((v for v in edits - {w} if v in n), key=lambda v: (-n[v], v))
        out[w] = (near[0] if near and n[near[0]] >= 5 * n[w] else None, len(near))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {(w, f, root(w), n[w], k, n.get(f)) for w, (f, k) in out.items()}


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_brute_force(spark, small):
    from duskline.llm import queries as q

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = q.op13_spelling_variants(spark, small)
    assert result(got) == brute_groups(brute_counts(rows)) and got.where("form is not null").count()


def test_odd_rows(spark, odd, none, odd_rows):
    odd = odd.withColumnsRenamed({"lang": "word", "source": "n", "n_chars": "root"})
    assert {(r.word, r.n) for r in sp.count_words(odd).collect()} == set(brute_counts([(r[0], r[1]) for r in odd_rows]).items())
    assert sp.count_words(none).collect() == [] and sp.group_variants(sp.count_words(none)).collect() == []


def dense(rng, size):
    """Words with many near ones: few letters, chains of forms, equal counts, and one very long run."""
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))): rng.choice([5, 5, 25, 130, 700]) for _ in range(size)}
    long = "ab" * 150
    return words | {"chainaa": 5, "chainab": 25, "chainbb": 125, "chaincbb": 625, "chaincbbx": 4000, long: 5, long + "a": 30, long[:-1] + "c": 30, long + "ac": 400}


@pytest.mark.parametrize("part", [sp.PART, 37])
def test_forms_and_roots_in_parts_of_any_size(spark, part):
    n = dense(random.Random(3), 400)
    got = sp.group_variants(spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n long, form string"), part)
    want = brute_groups(n)
    assert result(got) == want and any(r == "chaincbbx" and w == "chainaa" for w, _, r, *_ in want)


def test_one_side_meets_itself_from_both_ends():
    words = pd.DataFrame({"word": ["".join(random.Random(i).choices("bdfh", k=6)) for i in range(3000)], "n": 5}).drop_duplicates("word")
    a = sp._Side(words.word.tolist(), words.n.to_numpy())
    i, j = sp.near_pairs(a, a)
    some = set(words.word)
    want = sum(w[:k] + c + w[k + 1 :] in some for w in some for k in range(6) for c in "bdfh" if c != w[k])
    assert len(i) == len(j) == want


def test_gram_filter_finds_all_edits_and_verifies():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abcxé÷"), size)) for size in (6, 7) for _ in range(300)})
    short, long = ([w for w in words if len(w) == k] for k in (6, 7))
    a, b = (sp._Side(w, np.full(len(w), 5)) for w in (short, long))
    got = {(a.words[i], b.words[j]) for i, j in zip(*sp.near_pairs(a, b), strict=True)}
    assert got == {(v[:k] + v[k + 1 :], v) for v in long for k in range(7) if v[:k] + v[k + 1 :] in set(short)}
