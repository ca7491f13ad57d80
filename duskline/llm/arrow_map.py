"""Arrow helpers: append computed columns to a DataFrame, and view texts as byte buffers in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.session import cut

#: Ids that may be broadcast: 1,000,000 longs stay under 32 MB as a hash table. Beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
#: Rows and bytes in a batch of texts for a Python worker, which bounds what worker and executor hold off the heap; a
#: longer text makes a batch of its own.
STEP_ROWS, STEP_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession, rows: int = STEP_ROWS, size: int = STEP_BYTES) -> None:
    """Hand texts to Python workers in batches of at most ``rows`` rows and about ``size`` bytes. Spark reads both settings
    when a plan runs, so they are the session's from then on; smaller ones that it had stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spare_name(df: DataFrame, like: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while like.lower() in taken:
        like += "_"
    return like


def append_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``fields`` computed batch by batch; a column of ``df`` with the same name (any case) is replaced.

    Columns named in ``without`` are computed on but do not come back from the Python workers.
    """
    bound_batches(df.sparkSession)
    taken = {n.lower() for n in [*without, *(f.name for f in fields)]}
    kept = [c for c in df.columns if c.lower() not in taken]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *compute(batch)], names=names)

    return df.mapInArrow(run, schema)


def byte_slices(texts: pa.Array, max_bytes: int = 1 << 19, max_rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of consecutive rows; a null text counts as empty.

    A slice holds at most ``max_rows`` rows and ``max_bytes`` bytes, or one row where a single text is longer. Offsets
    start at 0 and have ``last - first + 1`` entries.
    """
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    starts = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(starts, starts[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), first + max_rows, len(texts))
        yield first, last, raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        first = last


def filter_by_ids(df: DataFrame, ids: DataFrame, column: str, keep: bool, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (or is not). ``ids`` is broadcast only if counted under ``limit``."""
    ids = cut(ids.select(F.col(ids.columns[0]).alias(column)).distinct())
    few = ids.count() <= limit
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi" if keep else "left_anti").select(df.columns)


def hashed_sample(df: DataFrame, by: str, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of each value of ``by``, chosen by a hash of ``doc_id``: the bound of a classifier's fit."""
    share = spare_name(df, "_share")
    sizes = df.groupBy(by).agg((F.lit(float(rows)) / F.count("*")).alias(share))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(sizes), by).where(draw < F.col(share)).drop(share)
