"""The registered queries on the smallest tables, against brute force, libraries or SQL."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from duskline.llm import fingerprints as fp
from duskline.llm import queries as q

from .test_near_dedup import brute
from .test_texts import base_by_definition

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def base(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def texts(base):
    return dict(base.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_names():
    assert sorted(q.queries(), key=lambda n: int(n[2:].split("_")[0])) == [
        "op1_toxicity", "op2_decontaminate", "op3_token_counts", "op4_quality", "op5_best_fit_packing", "op6_fingerprints", "op7_url_filter", "op8_near_dedup", "op9_language_id", "op10_secret_scan", "op11_token_alignment", "op12_exact_dedup", "op13_spelling_variants"]


def test_toxicity(spark, small, texts):
    rows = q.op1_toxicity(spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_decontamination_equals_sql(spark, small, base):
    got = {tuple(r) for r in q.op2_decontaminate(spark, small).select("doc_id", "item_id", "n_item", "n_common").collect()}
    assert got == set(base.execute(f"SELECT doc_id, item_id, n_item, n_common FROM ({q.SQL_op2_decontaminate})").fetchall()) and got


def test_token_counts_equal_the_library(spark, small, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in q.op3_token_counts(spark, small).collect()} == want


def test_quality_and_language(spark, small, texts):
    rows = q.op4_quality(spark, small).collect()
    assert len(rows) == len(texts) and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.expected_grade <= 2 for r in rows)
    langs = q.op9_language_id(spark, small).collect()
    assert len(langs) == len(texts) and all(r.held_out == (crc(r.doc_id, 5) == 0) and r.lang_pred in {"de", "en", "es", "fr", "und"} and 0 <= r.score <= 1 for r in langs)


def test_packing_keeps_every_token(spark, small):
    tokens = {r.doc_id: r.n_tokens for r in q.op3_token_counts(spark, small).collect()}
    packed = {}
    for r in q.op5_best_fit_packing(spark, small).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + (r.piece_tokens or 0)
    assert packed == tokens


def test_fingerprints_equal_brute_force(spark, small, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in q.op6_fingerprints(spark, small).collect()}
    assert sorted(got) == ids
    for i, then in zip(ids, [*ids[1:], ids[0]], strict=True):
        t = texts[i]
        edited = t[: len(t) - len(t) // 4] + texts[then][: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.fingerprint(t), fp.fingerprint(edited))
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fp.likeness(r.fingerprint, got[then].fingerprint)


def test_urls(spark, small, base):
    urls = dict(base.execute("SELECT page_id, url FROM pages").fetchall())
    for r in q.op7_url_filter(spark, small).collect():
        rest = urls.pop(r.page_id).split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (rest[:cut].lower(), path) and r.verdict in ("allow", "block") and (r.rule is None or r.host.endswith(r.rule.split("/")[0]))
    assert not urls


def test_near_duplicates_equal_brute_force(spark, small, texts):
    assert {r.doc_id: r.component_id for r in q.op8_near_dedup(spark, small).collect()} == brute(list(texts.items()))


def test_secrets(spark, small, texts):
    rows = q.op10_secret_scan(spark, small).collect()
    assert {r.doc_id: r.base_sha256 for r in rows} == {i: hashlib.sha256(base_by_definition(t).encode()).hexdigest() for i, t in texts.items()}
    for r in rows:
        written = [s for s in r.spans.split(",") if s and not s.startswith("entropy")]
        assert hashlib.sha256(",".join(written).encode()).hexdigest() == r.base_sha256 and r.n_assign + r.n_access + r.n_hex == len(written)


def test_exact_dedup_equals_sql(spark, small, base):
    got = q.op12_exact_dedup(spark, small).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(base.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({q.SQL_op12_exact_dedup})").fetchall())
