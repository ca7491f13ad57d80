"""Token counts, secrets, languages, fingerprints, quality, toxicity: against libraries, brute force or held-out labels."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from duskline.llm import fingerprints as fp
from duskline.llm import language_id, quality, secret_scan, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
from .conftest import SCHEMA, prose  # noqa: E402


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = " \n\t'abstreLL.!12²éß३漢😀\u0301\u00a0\u2003\x1c\x85"
    texts = ["", " ", "a<|endoftext|>b", "<|endoftext|>", "it's I'll 's'x", "x \n", "a" * 3000, "word " * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)]
    counter = token_counts.load(P.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count_all(texts).tolist() == want
    assert [counter.count(t) for t in texts] == want


def thue_morse(a, b, n):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_token_counts_of_words_that_polynomial_hashes_confuse(monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [thue_morse(x, y, 2048) for p in ("th", "on", "xe", "ab") for x, y in (p, p[::-1])]
    texts += [" ".join(texts), "the theme of the thing the then"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.load(P.path("byte_bpe_50k.json"))
    assert counter.count_all(texts).tolist() == want
    monkeypatch.setattr(token_counts, "segment_hashes", lambda codes, starts, stops, parts: np.zeros((parts, len(starts)), np.uint64))
    assert counter.count_all(texts).tolist() == want  # whatever the hash


def test_word_memory_forgets_but_never_errs():
    import numpy as np

    rng = np.random.default_rng(1)
    memory, every = token_counts.WordMemory(500), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 1 << 11, 90).astype(np.uint64) << np.uint64(53))  # many share a home slot
        keys = np.stack((keys, keys ^ np.uint64(rng.integers(0, 3))))
        tokens, at = memory.find(keys)
        for k, t in zip(keys.T.tolist(), tokens.tolist(), strict=True):
            assert t in (-1, every.get(tuple(k)))
        new = np.flatnonzero(tokens < 0)
        fresh = rng.integers(1, 99, len(new)).astype(np.int32)
        memory.add(keys[:, new], fresh, at[new])
        every |= {tuple(k): t for k, t in zip(keys[:, new].T.tolist(), fresh.tolist(), strict=True)}
        assert memory.find(keys[:, new])[0].tolist() == fresh.tolist() and memory.n <= 500


def test_token_count_rows(odd, none, odd_rows):
    got = token_counts.count_tokens(odd.withColumnRenamed("n_chars", "N_Tokens"), P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_tokens, by[2].n_bytes, by[2].n_tokens) == (0, 0, 0) and by[4].over_limit and by[4].n_bytes == len(odd_rows[3][1].encode())
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0


def test_window_entropy_equals_recomputation():
    from collections import Counter
    from math import log2

    rng = random.Random(1)
    for _ in range(50):
        s = "".join(rng.choice("abc1") for _ in range(rng.randrange(5, 60)))
        want = [-sum(c / 5 * log2(c / 5) for c in Counter(s[i : i + 5]).values()) for i in range(len(s) - 4)]
        assert secret_scan.window_entropy(s, 5) == pytest.approx(want)


def base_by_definition(text):
    spans = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(s for _, _, s in sorted(spans))


def test_base_spans_by_definition(spark):
    rng = random.Random(9)
    parts = ["password", "PassWd", "apiKey", "API_KEY", "token", "=", ": ", '"', "'", " ", "abc", "abcdef1", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "İ", "K", "é", "\n", "xyz."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(800)]
    got = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    for r in got.collect():
        assert r.base_sha256 == hashlib.sha256(base_by_definition(r.text).encode()).hexdigest(), r.text


def entropy_by_definition(text):
    """Hot windows of candidate runs, every window's entropy computed anew."""
    from collections import Counter
    from math import log2

    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        forms = [f.span() for f in secret_scan.ALLOWED.finditer(run)]
        hot = []
        for i in range(len(run) - 19):
            w = run[i : i + 20]
            least = 3.0 if w.isdigit() else 4.0 if not re.search("[0-9]", w) else 3.0 if re.fullmatch("[0-9A-Fa-f]+", w) else 3.8
            if -sum(c / 20 * log2(c / 20) for c in Counter(w).values()) >= least - 1e-12 and not any(a <= i and i + 20 <= b for a, b in forms):
                hot.append(i)
        if hot:
            out.append((m.start() + hot[0], m.start() + hot[-1] + 20))
    return out


def test_entropy_spans_by_definition():
    rng = random.Random(10)
    parts = ["Zk3vQ9xT7mLp", "deadbeef0123", "aaaaaaaaaaaa", "word-of-mouth", "_id", "==", "/", " ", "\n", "9", "example", "é", "0f1e2d3c4b5a69788796", "qWmZrTyUbHpLxK", "8041592635371"]
    found = 0
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert secret_scan.entropy_spans(text) == entropy_by_definition(text), text
        found += len(entropy_by_definition(text))
    assert found > 200


def test_entropy_adds_and_allow_list_suppresses():
    hot = "Zk3vQ9xT7mLp2RwY8bNcD4fH6jKs"
    assert [k for _, _, k in secret_scan.scan(f"see {hot} here")] == ["entropy"]
    for quiet in ("123e4567-e89b-12d3-a456-426614174000", "this_is_a_long_identifier_name_2024", "YOUR_API_KEY_EXAMPLE_1234567890", "aaaaaaaaaaaaaaaaaaaaaaaa1", "ordinarilylongsyntheticword"):
        assert secret_scan.entropy_spans(quiet) == []  # base patterns are never suppressed
    for around in ("example{}", "{}/your_token", "example/{}", "placeholder-{}-changeme", "src/main/{}"):
        (a, b), text = *secret_scan.entropy_spans(around.format(hot)), around.format(hot)
        assert a <= text.index(hot) + 10 and b >= text.index(hot) + len(hot) - 10  # what stands beside a secret hides none of it
    for found in ("qWmZrTyUbHpLxKcVnDsGfJaEoIQw", "80415926353718972946028315"):
        assert secret_scan.entropy_spans(found)  # letters only, digits only
    for quiet in ("AbstractSingletonProxyFactoryBean", "src/main/java/com/example/Handler", "00000000000000000000000000", "donaudampfschifffahrtsgesellschaft"):
        assert not secret_scan.entropy_spans(quiet)
    text = f"a token = {hot} b"
    assert secret_scan.redact(text, secret_scan.scan(text)) == "a [SECRET] b"


def test_secret_rows(odd, none, odd_rows):
    got = secret_scan.scan_secrets(odd.withColumnRenamed("source", "Spans"), redacted=True).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[2].text is None and by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest() and by[4].text == odd_rows[3][1]
    assert secret_scan.scan_secrets(none).count() == 0


def test_language_code_lengths_equal_a_plain_tree(spark):
    """The tables give the same code length as walking counts by hand."""
    from math import log2

    rows = [(1, "abracadabra abra", "x"), (2, "banana bandana", "x"), (3, "qqq zzz qz", "y"), (4, "zq zq zq", "y")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_lang=10**6)
    counts = {}
    for _, text, lang in rows:
        b = bytes(3) + text.encode()
        for i in range(3, len(b)):
            for order in range(4):
                counts.setdefault((lang, b[i - order : i]), {}).setdefault(b[i], 0)
                counts[lang, b[i - order : i]][b[i]] += 1

    def cost(lang, context, byte):
        seen = counts.get((lang, context))
        if seen is None:
            return cost(lang, context[1:], byte) if context else 8.0
        n, q = sum(seen.values()), len(seen)
        return -log2(seen[byte] / (n + q)) if byte in seen else -log2(q / (n + q)) + (cost(lang, context[1:], byte) if context else 8.0)

    import numpy as np

    texts = [t.encode() for t in ("abra", "", "bandana q", "zzzq", "Ω?", "a", "", "abra" * 30_000, "abra")]
    got = model.bits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, bits in zip(texts, got, strict=True):
        b = bytes(3) + text
        want = [sum(cost(lang, b[i - 3 : i], b[i]) for i in range(3, len(b))) for lang in ("x", "y")]
        assert bits == pytest.approx(want, rel=1e-5)
        assert (model.bits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] == bits).all()


def test_language_tables_stay_small():
    """All 256 byte values, 70 languages, 20 kB of noise each: no context is dropped and no table of contexts x symbols built."""
    import numpy as np

    rng = np.random.default_rng(3)
    lang, grams = np.repeat([f"l{i:02d}" for i in range(70)], 20_000), rng.integers(0, 1 << 32, 1_400_000)
    pair = np.unique(np.char.add(lang, "|").astype("U4").astype(object) + grams.astype(str).astype(object))
    lang, grams = np.array([p[:3] for p in pair]), np.array([int(p[4:]) for p in pair])
    model = language_id.ByteContexts(lang, grams, np.ones(len(grams), np.int64))
    assert model.size() < 150 * len(grams)
    for x in (0, 63, 64, 69):  # a string of its own is coded directly: one of two, the other being the escape
        g = int(grams[lang == f"l{x:02d}"][7])
        rows = model.direct[3].rows(np.array([g], np.uint32))
        assert model.direct[3].of(rows, x) == (True, pytest.approx(1.0, abs=1.6))


def test_language_held_out_and_rows(spark, odd, none, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = language_id.held_out("doc_id", 5, 0)
    model = language_id.fit(docs.where(~apart))
    r = language_id.identify(docs, model).where(apart).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97
    got = language_id.identify(odd.withColumnRenamed("source", "Score"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(odd_rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3)) and 0 < by[4].score <= 1
    assert language_id.identify(none, model).count() == 0 and language_id.fit(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def embedded(text, tables):
    """The embedding by its definition: step by step, one random bit for each place and character."""
    bit = [[0] * fp.PERIOD for _ in range(256)]  # 1: the walk moves on after this step
    for c in range(256):
        for at in range(fp.PERIOD):
            if tables.next[c][at] == (at + 1) % fp.PERIOD:
                bit[c][at] = 1
    out, step = [], 0
    for c in fp._codes(text).tolist():
        while True:
            out.append(c)
            step += 1
            if bit[c][(step - 1) % fp.PERIOD]:
                break
    return out


def test_fingerprints_equal_a_plain_walk():
    rng = random.Random(8)
    tables = fp.embedding()
    for text in ("", "a", "aaaa", "é漢😀 x", prose(rng, 3), prose(rng, 200), "ab" * 3000):
        walk = embedded(text, tables)
        want = "0" * fp.SLOTS
        if walk:
            places = [max(int(r) for r in tables.records[k] if r < len(walk)) for k in range(fp.SLOTS)]
            want = "".join("0123456789abcdef"[tables.nibble[(walk[p] + 37 * k) % 256]] for k, p in enumerate(places))
        assert fp.fingerprint(text) == want


def test_edits_equal_brute_force(spark, odd, none, odd_rows):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    order = sorted(((-(10**30) if i is None else i), t or "") for i, t, *_ in odd_rows)
    want = []
    for at, (_, text) in enumerate(order):
        then = order[(at + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 4] + then[: len(text) // 4]
        own, other = fp.fingerprint(text), fp.fingerprint(edited)
        want.append((hashlib.sha256(edited.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, fp.fingerprint(then))))
    try:
        for n in (1, 4, 90):  # 90: ranges of one row and of none
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = fp.fingerprint_edits(odd.withColumnRenamed("source", "range")).collect()
            assert sorted((r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)
        one = fp.fingerprint_edits(odd.where("doc_id = 1")).collect()
        assert len(one) == 1 and one[0].n_chars == 0 and one[0].near_next == 1
        assert fp.fingerprint_edits(none).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_likeness_follows_edits(spark):
    rng = random.Random(5)
    text = prose(rng, 400)
    other = prose(rng, 380)
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text)) == 1
    few = text[:900] + "!" + text[900:]
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(few)) > 0.5 > 0.2 > fp.likeness(fp.fingerprint(text), fp.fingerprint(other))
    rows = [(i, text) for i in range(20)] + [(50, few), (60, other)]
    pairs = fp.candidate_pairs(fp.add_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id for r in pairs} == {*range(1, 20), 50} and {r.center_id for r in pairs} == {0}


def test_near_groups_equal_brute_force(spark, monkeypatch):
    """Copies that are not the smallest id of a bucket are found, in small and in large buckets; recall at the threshold."""
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 16, (30, fp.SLOTS))
    base[:, : fp.SLOTS - 40] = base[0, : fp.SLOTS - 40]  # strangers share most bands: 40 slots differ, likeness below 0.75
    rows = []
    for g, b in enumerate(base):
        for edits in (0, 0, 3, 6):
            one = b.copy()
            one[rng.choice(fp.SLOTS, edits, replace=False)] = rng.integers(0, 16, edits)
            rows.append((100 * g + len(rows) % 4, "".join("0123456789abcdef"[v] for v in one)))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, fingerprint string")
    group = {i: i for i, _ in rows}
    for i, x in rows:
        for j, y in rows:
            if fp.likeness(x, y) >= 0.8 and group[i] != group[j]:
                group = {k: min(group[i], group[j]) if g in (group[i], group[j]) else g for k, g in group.items()}
    assert len(set(group.values())) == 30
    for small, block in ((1000, 512), (4, 7)):
        monkeypatch.setattr(fp, "SMALL_BUCKET", small)
        monkeypatch.setattr(fp, "BLOCK", block)
        got = fp.add_near_groups(docs, least=0.8).collect()
        assert len(got) == len(rows) + 1 and {r.doc_id: r.near_group for r in got} == group | {None: None}
    pairs = []
    for i in range(300):  # just above the threshold: 106 of 128 slots agree, likeness 0.805
        a = rng.integers(0, 16, fp.SLOTS)
        b = a.copy()
        at = rng.choice(fp.SLOTS, 22, replace=False)
        b[at] = (b[at] + rng.integers(1, 16, 22)) % 16
        pairs += [(2 * i, "".join("0123456789abcdef"[v] for v in a)), (2 * i + 1, "".join("0123456789abcdef"[v] for v in b))]
    links = {(r.doc_id, r.center_id) for r in fp.candidate_pairs(spark.createDataFrame(pairs, "doc_id long, fingerprint string")).collect()}
    assert links <= {(2 * i + 1, 2 * i) for i in range(300)} and len(links) >= 0.97 * 300


def test_quality_held_out_and_rows(spark, odd, none, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    grade = F.expr("case when quality = 0 then 0 when toxic = 1 then 1 else 2 end")
    ratings = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", grade.alias("grade"))
    apart = language_id.held_out("doc_id", 5, 0)
    model = quality.fit(docs, ratings.where(~apart))
    assert all(a < b for a, b in zip(model.thresholds[:-1], model.thresholds[1:], strict=True))
    kept = quality.grade_texts(docs.join(ratings.where(apart), "doc_id"), model).groupBy((F.col("grade") > 0).alias("good")).agg(F.avg(F.col("selected").cast("int")).alias("s"))
    share = {r.good: r.s for r in kept.collect()}
    assert share[True] > 0.97 and share[False] < 0.1
    got = quality.grade_texts(odd.withColumnRenamed("source", "Selected"), model).collect()
    assert len(got) == len(odd_rows) and not any(r.selected for r in got if r.doc_id in (1, 2)) and all(0 <= r.p_top <= r.p_pass <= 1 for r in got)
    assert quality.grade_texts(none, model).count() == 0 and quality.fit(none.select("doc_id", "text"), ratings.limit(0)) is None


def test_quality_score_is_of_the_text_alone():
    import numpy as np

    rng = random.Random(3)
    weights = np.random.default_rng(4)
    model = quality.OrdinalModel(weights.normal(size=quality.BUCKETS).astype(np.float32), weights.normal(size=quality.SURFACE), np.array([0.0, 1.0]))
    texts = [t.encode() for t in ("", "a", "ab", "abc", "é", prose(rng, 50), "", "ab", prose(rng, 300), "abcd", "a", "")]

    def latent(batch):
        return model.latent(np.frombuffer(b"".join(batch), np.uint8), np.cumsum([0, *map(len, batch)])).tolist()

    alone = [latent([t])[0] for t in texts]
    assert latent(texts) == alone and latent(texts[::-1]) == alone[::-1]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bucket, inside, count = quality._trigrams(data, np.cumsum([0, *map(len, texts)]))
    assert count.tolist() == [max(len(t) - 2, 0) for t in texts] and inside.sum() == count.sum()
    whole = [t[i : i + 3] for t in texts for i in range(len(t) - 2)]
    assert bucket[inside].tolist() == [quality._trigrams(np.frombuffer(g, np.uint8), np.array([0, 3]))[0][0] for g in whole]


def test_quality_fit_is_a_maximum_of_the_likelihood(spark):
    """No move of weights or thresholds raises the cumulative-link likelihood, computed by its definition."""
    import numpy as np

    rng = random.Random(5)
    kinds = [["!!", "##", "BUY"], ["river", "stone", "#"], ["river", "stone", "field"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(12)), i % 3) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 2), (2, 2)], "doc_id long, grade int").selectExpr("*", "1 as _share")
    model, again = quality.fit(docs, ratings, ridge=1e-3), quality.fit(docs.repartition(3), ratings.repartition(2), ridge=1e-3)
    assert np.allclose(model.buckets, again.buckets, atol=1e-4)
    data = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(r[1].encode()) for r in rows)])

    def loss(m):
        tails = np.hstack((np.ones((60, 1)), m.tails(m.latent(data, offsets)), np.zeros((60, 1))))
        grade = np.array([r[2] for r in rows])
        return -np.log(tails[range(60), grade] - tails[range(60), grade + 1]).mean() + 1e-3 / 2 * (((m.buckets / quality._SCALE) ** 2).sum() + (m.surface**2).sum())

    at, some = loss(model), np.random.default_rng(2)
    for _ in range(30):
        moved = quality.OrdinalModel(model.buckets + some.normal(0, 2, model.buckets.shape).astype(np.float32), model.surface + some.normal(0, 0.3, model.surface.shape), model.thresholds + some.normal(0, 0.2, 2))
        assert loss(moved) > at - 5e-3


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp, log

    import numpy as np

    field = toxicity.ToxicField(-1.0, {"bad": 2.0, "^worse": 1.5}, np.array([[0.0, -0.7], [0.2, 0.9]]))
    odds, live = field.odds(["a", "bad", "worsen", "b"])
    assert live
    weight = lambda y: exp(sum(log(o) for o, s in zip(odds, y, strict=True) if s) + sum(field.transitions[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
    every = {y: weight(y) for y in product((0, 1), repeat=4)}
    want = [sum(w for y, w in every.items() if y[t]) / sum(every.values()) for t in range(4)]
    assert field.marginals(odds) == pytest.approx(want)


@pytest.mark.parametrize("bias", [-9.0, -3.0, 0.5])
def test_texts_without_features_are_scored_at_their_length(bias):
    import numpy as np

    for transitions in (np.zeros((2, 2)), np.array([[0.0, -1.2], [0.4, 1.5]])):
        field = toxicity.ToxicField(bias, {"bad": 2.0}, transitions)
        for n in (1, 2, 63, 64, 65, 500, 3000):
            clean, p = 1.0, field.marginals([np.exp(bias)] * n)
            for x in p:
                clean *= 1 - x if x >= toxicity.COUNTED else 1
            assert field.evidence("word " * n)[0] == pytest.approx(max(1 - clean, max(p)), rel=1e-9)


def test_chain_fit_is_a_maximum_of_the_likelihood():
    """No move of the weights raises the penalised likelihood, computed by enumeration of all labellings."""
    from itertools import product

    import numpy as np

    rng = random.Random(7)
    ids, labels = [], []
    for _ in range(30):
        words = [rng.choice(["0", "1", "", ""]) for _ in range(rng.randrange(2, 6))]
        ids.append(words)
        labels.append("".join("1" if (w == "0" and rng.random() < 0.9) or rng.random() < 0.1 else "0" for w in words))
    weight = np.ones(len(ids))

    def loss(field):
        total = 0.0
        for words, text in zip(ids, labels, strict=True):
            emission = [field.bias + field.weights.get(f"w{w}", 0.0) if w else field.bias for w in words]
            value = lambda y: sum(e for e, s in zip(emission, y, strict=True) if s) + sum(field.transitions[a, b] for a, b in zip(y[:-1], y[1:], strict=True))  # noqa: B023, E731
            total += np.log(sum(np.exp(value(y)) for y in product((0, 1), repeat=len(words)))) - value([int(c) for c in text])
        return total / len(ids) + 2e-5 * sum(map(abs, field.weights.values()))

    field = toxicity._fit_chain(ids, labels, weight, ["w0", "w1"], steps=400)
    at = loss(field)
    for _ in range(40):
        moved = toxicity.ToxicField(field.bias + rng.gauss(0, 0.3), {k: v + rng.gauss(0, 0.3) for k, v in field.weights.items()}, field.transitions + np.array([[0, rng.gauss(0, 0.3)], [rng.gauss(0, 0.3), rng.gauss(0, 0.3)]]))
        assert loss(moved) > at - 2e-3


def test_calibration_solves_the_logistic_equations():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.8 * x - 1)))).astype(float)
    slope, shift = toxicity._calibrate(x, y, np.ones(4000))
    p = 1 / (1 + np.exp(-slope * x - shift))
    assert abs((p - y).sum()) < 1e-3 and abs(((p - y) * x).sum() + 1e-2 * slope) < 1e-3 and (slope, shift) == pytest.approx((0.8, -1), abs=0.15)


def test_contradicting_labels_are_settled(spark):
    rows = [(i, f"calm words number {i} here and there") for i in range(40)] + [(100 + i, f"you vile{i % 3} person number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows + [(200, rows[50][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows] + [(100, 0), (200, 0)], "doc_id long, toxic int").selectExpr("*", "1 as _share", "2 as count")
    fits = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert fits[0].weights == fits[1].weights and fits[0].bias == fits[1].bias and fits[0].slope == pytest.approx(fits[1].slope)


def test_toxicity_held_out_and_rows(spark, odd, none, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    apart = language_id.held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, labels.where(~apart))
    r = toxicity.score_toxicity(docs.join(labels.where(apart), "doc_id"), model).agg(F.sum("predicted").alias("p"), F.sum("toxic").alias("t"), F.sum(F.col("predicted") * F.col("toxic")).alias("both")).first()
    assert r.both / r.p > 0.85 and r.both / r.t > 0.85
    got = toxicity.score_toxicity(odd.withColumnRenamed("source", "Score"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(odd_rows) and by[1].score == by[2].score == by[3].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    spans = toxicity.score_toxicity(spark.createDataFrame([(1, "You IDIOT, é clown!")], "doc_id int, text string"), model).first()
    assert spans.predicted == 1 and spans.toxic_spans.startswith("4:")
    assert toxicity.score_toxicity(none, model).count() == 0 and toxicity.fit(none.select("doc_id", "text"), labels.limit(0)) is None
    assert SCHEMA


def test_a_language_of_long_texts_only_is_learnt(spark):
    from duskline.llm import language_id

    rows = [(i, f"the quick brown fox number {i} walks over the hill", "en") for i in range(20)] + [(100 + i, "lorem ipsum dolor sit amet consectetur " * (40 + i), "la") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, longest=500)
    assert model.langs == ["en", "la"]
    got = language_id.identify(spark.createDataFrame([(1, "dolor sit amet lorem"), (2, "the brown hill")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["la", "en"]


def test_toxic_spans_are_the_planted_words(spark):
    """Invented words and stems mark toxic texts; on texts not learnt from, the spans are those words and little else."""
    from duskline.llm.toxicity import fit, score_toxicity

    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdeilmnorstu", k=rng.randrange(3, 9))) for _ in range(400)]
    rows, planted = [], {}
    for i in range(1200):
        words, bad = rng.choices(plain, k=rng.randrange(20, 90)), i % 4 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zorgul", "blatfink", "quoxpa" + rng.choice(plain)])
        at = 0
        for w in words:
            if w.startswith(("zorgul", "blatfink", "quoxpa")):
                planted.setdefault(i, set()).update(range(at, at + len(w)))
            at += len(w) + 1
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(docs.select("doc_id", "text"), docs.where("doc_id % 8 < 5").select("doc_id", "toxic"))
    found = {r.doc_id: {c for s in r.toxic_spans.split(",") if s for c in range(*map(int, s.split(":")))} for r in score_toxicity(docs.where("doc_id % 8 >= 5"), model).collect()}
    want = {i: {c for c in planted.get(i, ())} for i in found}
    hit = sum(len(found[i] & want[i]) for i in found)
    assert hit >= 0.9 * sum(map(len, want.values())) and hit >= 0.9 * sum(map(len, found.values()))
