"""Running sums over streams of triples: new entries add to what a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def running_sums(stream: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """The sum of value for each key over all entries so far (output mode "update" or "complete")."""
    return stream.groupBy(*keys).agg(F.sum(value).alias(value))


def windowed_means(stream: DataFrame, time: str, key: str, value: str, size: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Means by time window and key; entries later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.avg(value).alias(value))


def write_running(sums: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch replaces the table at path by the sums so far."""
    return sums.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
