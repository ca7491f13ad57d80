"""Exact deduplication by stateful streaming: keyed state on disk remembers each text it has seen, for ever.

The rows of a folder are read as a stream. State is keyed by the digest and the size of the text and has no watermark and no
expiry; it lies in RocksDB on the executors' disks and is written to the shared folder after every micro-batch. Each key
retains the stable identifier (the largest id seen), the locator of that row's content (file and row number) and how many
rows were seen. A stream that is started again on the same state folder reads new files only.

A digest that was met more than once is a hit, and a hit is only believed after the full bytes are compared: the texts under
such digests are grouped by their whole content, copies being combined before they are moved, and a digest with two contents
is taken apart by content. All of it is DataFrame work inside the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.arrow_map import MAX_BROADCAST_IDS
from duskline.session import checkpoint_dir, cut, remove

#: Bytes of files that one micro-batch takes, about.
BATCH_BYTES = 1 << 40
#: Digests with at least this share of all rows are handed to every task: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Keyed state on disk, with one memory limit for all stores of an executor.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each of many small stores sets 4 MB of disk aside.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _rows(files: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, content, text_sha256, digest, size, file, row)`` of each row of parquet files read as a table or a stream."""
    place = files.metadataColumn("_metadata")
    rows = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"), place.getField("file_path").alias("file"), place.getField("row_index").alias("row"))
    return rows.withColumn("text_sha256", F.sha2(F.col("content").cast("binary"), 256)).withColumns({"digest": digest(F.col("text_sha256")), "size": F.octet_length("content")})


def absorb(rows: DataFrame, folder: str) -> None:
    """Take all that the stream ``rows`` (as of ``_rows``) holds now into the state in ``folder``."""
    spark = rows.sparkSession
    seen = rows.groupBy("digest", "size").agg(F.max(F.struct("doc_id", "file", "row")).alias("last"), F.count("*").alias("seen"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """``(digest, size, keep_id, keep_file, keep_row, group_size)`` of every key of the state in ``folder``."""
    state = spark.read.format("statestore").load(folder)
    last = F.col("value.max")
    return state.select("key.digest", "key.size", last.getField("doc_id").alias("keep_id"), last.getField("file").alias("keep_file"), last.getField("row").alias("keep_row"), F.col("value.count").alias("group_size"))


def deduplicate(spark: SparkSession, path: str, state_folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, digest: Callable[[Column], Column] = F.unhex) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of the parquet file or folder at ``path``.

    Rows are equal if their texts have the same bytes; a null text counts as empty. Of equal rows the one with the largest
    id stays, and ``keep_id`` is its id. Ties (rows that repeat an id and a text): the last row by file name and row number
    stays, exactly one of a group. Rows without an id come after all others: one of them stays only where no row of the
    group has an id. Texts of any length are compared whole. An empty table gives an empty result. Other columns, whatever
    their names, are not read.

    ``state_folder`` keeps the state between calls: a later call reads only files that are new; files must not change.
    Without it the state lives as long as the call. ``digest`` makes the key of the hexadecimal SHA-256; a weaker one gives
    the same result.
    """
    kinds = spark.read.parquet(path).schema
    schema = T.StructType([kinds[id_col], kinds[text_col]])
    folder = state_folder or f"{checkpoint_dir(spark)}/stream-dedup-{uuid.uuid4().hex}"
    # As a pattern, the path may be of one file as well as of a folder.
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
    absorb(_rows(stream, id_col, text_col, digest), folder)
    state = cut(remembered(spark, folder))
    docs = _rows(spark.read.schema(schema).parquet(path), id_col, text_col, digest)

    total, hits = state.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count_if(F.col("group_size") > 1)).first()
    met, at = state.where("group_size > 1"), ["digest", "size"]
    candidates = docs
    if hits <= MAX_BROADCAST_IDS:
        candidates = docs.join(F.broadcast(met.select(F.xxhash64("digest").alias("hit"))), F.xxhash64("digest") == F.col("hit"), "left_semi")
    contents = candidates.groupBy(*at, "content").agg(F.count("*").alias("copies"))
    confused = cut(contents.groupBy(at).agg(F.count("*").alias("contents")).where("contents > 1").select(at))

    # Hot digests are joined in place, so that no task gets all rows of one text.
    hot = F.col("group_size") >= F.lit(total * HOT_SHARE)
    placed = cut(docs.drop("content").join(F.broadcast(met.where(hot)), at, "left"))
    rest = placed.where("group_size is null").select("doc_id", "file", "row", "text_sha256", *at).join(met.where(~hot), at, "left")
    placed = placed.where("group_size is not null").unionByName(rest)
    met_once = F.col("group_size").isNull()
    here = lambda last: (F.col(last.format("file")) == F.col("file")) & (F.col(last.format("row")) == F.col("row"))
    out = placed.select(*at, "doc_id", F.when(met_once, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (met_once | here("keep_{}")).alias("kept"), "text_sha256")
    if not confused.isEmpty():
        mixed = docs.join(confused, at, "left_semi")
        groups = mixed.groupBy(*at, "content").agg(F.max(F.struct("doc_id", "file", "row")).alias("last"), F.count("*").alias("group_size"))
        mixed = mixed.join(groups, [*at, "content"]).select(*at, "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", here("last.{}").alias("kept"), "text_sha256")
        out = out.join(confused, at, "left_anti").unionByName(mixed)
    if state_folder is None:
        remove(spark, folder)
    return out.drop(*at)
