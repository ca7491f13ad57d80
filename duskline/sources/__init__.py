"""Sources and sinks with pruned, typed reads and guarded writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header as the DDL ``schema``: columns found by name, others pruned; text that does not parse is null."""
    want = T._parse_datatype_string(schema)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in want])


def read_parquet_cols(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of the DDL ``schema``; those the files lack are null."""
    df = spark.read.parquet(path)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema)])


def read_json_doc(spark: SparkSession, path: str) -> DataFrame:
    """One nested document as one row."""
    return spark.read.json(path, multiLine=True)


def union_sources(sources: list[tuple[str, DataFrame, int | None]]) -> DataFrame:
    """Named sources of one schema appended, with ``source``; ValueError where a stated row count differs."""
    wrong = [(name, n, found) for name, df, n in sources if n is not None and (found := df.count()) != n]
    if wrong:
        raise ValueError("; ".join(f"{name}: {n} rows expected, {found} found" for name, n, found in wrong))
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df, _ in sources])


def write_parquet(df: DataFrame, path: str, schema: str) -> None:
    """Fixed column order and types; the output committer makes it all or nothing."""
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema)]).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a header; fractions rounded half-even."""
    df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON document; NaN becomes null."""
    safe = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def backup_if_legacy(spark: SparkSession, path: str, backup: str, column: str) -> bool:
    """Copy the table at ``path`` to ``backup`` if it lacks ``column``; whether it did."""
    old = spark.read.parquet(path)
    if column in old.columns:
        return False
    old.write.mode("overwrite").parquet(backup)
    return True
