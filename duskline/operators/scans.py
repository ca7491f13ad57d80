"""Ranks, running aggregates and counts in trailing windows of a key, without a task for all rows of the key.

Rows are dealt by Spark's range partitioner on the key and the order together, so a key with very many rows lies in many
ranges. A range is scanned on its own. Of each range one row remains, the aggregates of the rows of its last key; what a range
inherits are those of the earlier ranges that ended with the key it begins with. There are as many ranges as the session has
shuffle partitions (16 at least), whatever the number of keys or rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.session import cut

_MERGED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def scan(df: DataFrame, by: list[str], order: list[Column], out: dict[str, tuple[str, Column]], before: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with running aggregates: ``out`` maps new names to ("sum", "max" or "min", column).

    Rows run in ``order`` (which should be total) inside each group of ``by``; null keys are a group. A row sees the rows up to
    itself, or with ``before`` those before itself (a sum is then 0 at first, max and min null).
    """
    ranges = ranges or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = {f"_in_{n}": c for n, (_, c) in out.items()}
    dealt = df.withColumns(named).repartitionByRange(ranges, *[F.asc_nulls_first(c) for c in by], *order)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))

    agg = {n: getattr(F, kind) for n, (kind, _) in out.items()}
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("_all"))
    held = dealt.groupBy("_range", key.alias("_key")).agg(*[f(f"_in_{n}").alias(f"_to_{n}") for n, f in agg.items()])
    ends = cut(held.groupBy("_range").agg(F.min("_key").alias("_first"), F.max(F.struct("_key", *[f"_to_{n}" for n in out])).alias("_last")))
    tails = ends.select("_range", F.col("_last._key").alias("_key"), *[F.col(f"_last._to_{n}").alias(f"_to_{n}") for n in out], F.lit(False).alias("_head"))
    heads = ends.select("_range", F.col("_first").alias("_key"), F.lit(True).alias("_head"))
    earlier = Window.partitionBy("_key").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)  # one or two rows a range
    carried = tails.unionByName(heads, allowMissingColumns=True).select("_range", "_key", "_head", *[f(f"_to_{n}").over(earlier).alias(f"_from_{n}") for n, f in agg.items()])
    carried = carried.where("_head").select(F.col("_range").alias("_of"), F.col("_key").alias("_of_key"), *[f"_from_{n}" for n in out])

    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ran = dealt.select("*", *[f(f"_in_{n}").over(inside).alias(f"_run_{n}") for n, f in agg.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_of_key")[c]) for c in by], F.col("_range") == F.col("_of"))
    joined = ran.join(F.broadcast(carried), same, "left")
    return joined.select(*df.columns, *[_MERGED[kind](F.col(f"_run_{n}"), F.col(f"_from_{n}")).alias(n) for n, (kind, _) in out.items()])


def ranks(df: DataFrame, by: list[str], order: list[Column], out: str = "rank", ranges: int | None = None) -> DataFrame:
    """``out``: place from 1 of each row in its group of ``by``, in the total ``order``."""
    return scan(df, by, order, {out: ("sum", F.lit(1).cast("long"))}, ranges=ranges)


def count_in_ranges(events: DataFrame, probes: DataFrame, key: str, at: str, ident: list[str], low: str, high: str, out: str, ranges: int | None = None) -> DataFrame:
    """``(key, *ident, out)`` per row of ``probes``: how many events of its key have ``low <= at < high`` (all of one type).

    Events are counted by key and time first. Each probe then reads a running count off at both its ends, so an event meets no
    probe. ``ident`` with the key should tell probes apart. Null keys meet each other; a probe with a null or reversed range,
    and events without a time, count nothing.
    """
    counted = events.where(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("_t")).agg(F.count("*").alias("_c"))
    good = F.coalesce(F.col(low) < F.col(high), F.lit(False))
    ends = F.explode(F.array(F.struct(F.col(low).alias("_t"), F.lit(-1).alias("_sign")), F.struct(F.col(high).alias("_t"), F.lit(1).alias("_sign"))))
    asked = probes.where(good).select(key, *ident, ends.alias("_e")).select(key, *ident, "_e.*")
    points = counted.withColumn("_sign", F.lit(0)).unionByName(asked.withColumn("_c", F.lit(0).cast("long")), allowMissingColumns=True)
    # Probes come before the events of their time.
    order = [F.col("_t"), F.desc(F.abs("_sign")), *[F.col(c) for c in ident], F.col("_sign")]
    ran = scan(points, [key], order, {"_seen": ("sum", F.col("_c"))}, ranges=ranges).where("_sign <> 0")
    none = probes.where(~good).select(key, *ident, F.lit(0).cast("long").alias("_n"))
    found = ran.select(key, *ident, (F.col("_sign") * F.col("_seen")).alias("_n")).unionByName(none)
    return found.groupBy(key, *ident).agg(F.sum("_n").alias(out))


def meets_another(df: DataFrame, key: str, start: str, end: str, ident: str, ranges: int | None = None) -> DataFrame:
    """Rows whose closed interval meets another one of the same key: an earlier one that ends at or after its start, or a
    later one that starts at or before its end."""
    earlier = scan(df, [key], [F.col(start), F.col(ident)], {"_latest": ("max", F.col(end))}, before=True, ranges=ranges)
    both = scan(earlier, [key], [F.desc(start), F.desc(ident)], {"_next": ("min", F.col(start))}, before=True, ranges=ranges)
    return both.where((F.col("_latest") >= F.col(start)) | (F.col("_next") <= F.col(end))).drop("_latest", "_next")


def mark_runs(df: DataFrame, by: list[str], start: str, end: str, ident: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_run``: the start of the stretch without a break that the closed interval belongs to, among those of its key.
    Intervals of a stretch are chained by meeting; ``by`` and ``_run`` name it. Rows need start <= end."""
    order = [F.col(start), F.col(ident)]
    ran = scan(df, by, order, {"_latest": ("max", F.col(end))}, before=True, ranges=ranges)
    fresh = F.when(F.col("_latest").isNull() | (F.col("_latest") < F.col(start)), F.col(start))
    return scan(ran, by, order, {"_run": ("max", fresh)}, ranges=ranges).drop("_latest")
