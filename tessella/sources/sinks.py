"""Sinks: tables with their schema, transposed tables, delimited files, reductions of what is written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import Schema


def write_table(df: DataFrame, path: str, schema: Schema | None = None, mode: str = "overwrite", partition_by_range: list[str] | None = None) -> None:
    """Parquet; a schema travels in the field metadata of the files. partition_by_range keeps files apart by key."""
    if schema is not None:
        df = df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.spark().fields])
    if partition_by_range:
        df = df.repartitionByRange(*partition_by_range)
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, Schema | None]:
    df = spark.read.parquet(path)
    return df, Schema.from_spark(df.schema) if any("role" in f.metadata for f in df.schema.fields) else None


def write_with_reduction(df: DataFrame, path: str, reductions: Mapping[str, Column] | None = None, transposed: str | None = None, most_rejected: int | None = None, rejects: Column | None = None) -> dict:
    """Write df, and (row, col, val) transposed too if asked; gives entries and the reductions of what was written.

    One pass over the input counts, reduces and writes; the transposed table is made of what was written. rejects: rows
    for which it holds are not written but counted as rejected; more than most_rejected of them fail the write.
    """
    seen = Observation()
    bad = F.coalesce(rejects, F.lit(False)) if rejects is not None else F.lit(False)
    good = lambda c: c if rejects is None else F.when(~bad, c)
    counts = [F.count(good(F.lit(1))).alias("entries"), F.count(F.when(bad, 1)).alias("rejected")]
    observed = df.observe(seen, *counts, *[c.alias(n) for n, c in (reductions or {}).items()])
    (observed.where(~bad) if rejects is not None else observed).write.mode("overwrite").parquet(path)
    found = seen.get
    if most_rejected is not None and found["rejected"] > most_rejected:
        raise ValueError(f"{found['rejected']} rows rejected, more than {most_rejected}")
    if transposed:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        written.select(F.col("col").alias("row"), F.col("row").alias("col"), "val").write.mode("overwrite").parquet(transposed)
    return found if rejects is not None else {k: v for k, v in found.items() if k != "rejected"}


def write_delimited(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", single: bool = False) -> None:
    """Delimited text; missing values are empty. single: one file, for small results."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", header).option("sep", delimiter).option("emptyValue", "").option("nullValue", "").csv(path)


def table_name(user: str, program: str, relation: str) -> str:
    """The name under which a stored relation is kept."""
    return "_".join((user, program, relation)).replace(":", "_")


def clone_table(spark: SparkSession, old: str, new: str) -> None:
    spark.table(old).write.mode("overwrite").saveAsTable(new)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def attach(df: DataFrame, name: str) -> None:
    """A view: what is computed anew whenever the table is read."""
    df.createOrReplaceTempView(name)
