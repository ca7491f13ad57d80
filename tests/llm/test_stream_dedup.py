import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duskline.llm.stream_dedup import deduplicate

SCHEMA = "doc_id long, text string, file string, digest int, _metadata string, kept int"
CLASHES = ("f", 1, "m", 7)


def brute(rows):
    """{(doc_id, text): [(keep_id, size)]} and how many rows of each text stay."""
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def rows(n=300):
    rng = random.Random(5)
    out = [(i, rng.choice(["same text", f"text {rng.randrange(n)}", f"tail {rng.randrange(40)}"])) for i in range(n)]
    long = "word " * 40_000
    out += [(900, None), (901, ""), (902, long), (903, long), (904, long + "."), (905, "twice"), (905, "twice"), (None, "twice"), (None, "nobody"), (None, "nobody"), (906, "é"), (907, "é")]
    return [(*r, *CLASHES) for r in out]


def check(got, table):
    want = brute(table)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    assert sorted((repr(r.doc_id), r.text_sha256) for r in got) == sorted((repr(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in table)
    assert all((r.keep_id, r.group_size) == want[texts[r.text_sha256]] for r in got)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("digest", [F.unhex, lambda sha: F.substring(sha, 1, 1), lambda sha: F.lit(b"")], ids=["sha256", "four bits", "constant"])
def test_equal_to_brute_force_whatever_the_digest(spark, tmp_path, digest):
    table = rows()
    spark.createDataFrame(table, SCHEMA).repartition(5).write.parquet(path := f"{tmp_path}/docs.parquet")
    check(deduplicate(spark, path, digest=digest).collect(), table)


def test_state_outlives_the_call_and_reads_new_files_only(spark, tmp_path):
    first, second = rows()[:150], rows()[150:]
    path, state = f"{tmp_path}/docs.parquet", f"{tmp_path}/state"
    spark.createDataFrame(first, SCHEMA).repartition(3).write.parquet(path)
    check(deduplicate(spark, path, state).collect(), first)
    spark.createDataFrame(second, SCHEMA).repartition(2).write.mode("append").parquet(path)
    check(deduplicate(spark, path, state, batch_bytes=1).collect(), first + second)
    check(deduplicate(spark, path, state).collect(), first + second)  # nothing new: nothing is counted twice


def test_empty_table_and_one_file(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(path := f"{tmp_path}/none.parquet")
    assert deduplicate(spark, path).collect() == []
    table = rows(20)
    spark.createDataFrame(table, SCHEMA).coalesce(1).write.parquet(path := f"{tmp_path}/one.parquet")
    (file,) = [f for f in (tmp_path / "one.parquet").iterdir() if f.suffix == ".parquet"]
    check(deduplicate(spark, str(file)).collect(), table)


def test_no_python_workers(spark, small):
    plan = deduplicate(spark, f"{small}/documents.parquet")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
