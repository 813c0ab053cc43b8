"""Text sources: delimited files with strict rules, sensor logs, edge lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER, _REAL = r"^[+-]?[0-9]+$", r"^\s*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\s*$"


def parsed(c: Column, kind: T.DataType) -> Column:
    """c as kind, null where the text is no such value; integers admit no spaces."""
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.when(c.rlike(_INTEGER), c.try_cast(kind))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.rlike(_REAL), c.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.lower(F.trim(c)).eqNullSafe("true")
    return c.try_cast(kind)


#: Most splits of files whose offsets a join broadcasts, about 100 bytes each; more are shuffled.
BROADCAST_SPLITS = 1_000_000


def numbered_lines(spark: SparkSession, path: str, each_file: bool = False) -> DataFrame:
    """(value, n): the lines of a file or of several, numbered from 0 in the order of paths and lines; each_file: in each file anew.

    A first pass counts the lines of every split that Spark reads; the counts before a split are its offset.
    """
    split = ["file", "start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy(*split).agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    if each_file:
        order = Window.partitionBy("file").orderBy("start")
    else:  # a row for each split, in one task
        order = Window.orderBy("file", "start")
    before = F.coalesce(F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*split, (before - F.col("first")).alias("offset"))
    few = sizes.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    return lines.join(F.broadcast(offsets) if few else offsets, split).select("value", (F.col("at") + F.col("offset")).alias("n"))


def read_delimited(
    spark: SparkSession, path: str, columns: list[tuple[str, T.DataType | None]], skip: int = 0, delimiter: str = ",", quote: str = '"', escape: str = "\\", with_dropped: bool = False
) -> DataFrame:
    """Rows of a delimited file whose wanted fields all parse; other rows are dropped.

    columns: name and type of every field in order; type None: the field is not read. A row with another number of
    fields fails the query. skip: lines left out at the head of each file. with_dropped: instead, all rows, with a
    boolean column dropped; to count them.
    """
    names, bad = [f"_{i}" for i in range(len(columns))], "__line"
    lines = numbered_lines(spark, path, each_file=True).where(F.col("n") >= skip).select("value") if skip else spark.read.text(path)
    options = {"sep": delimiter, "quote": quote, "escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    fields = lines.select(F.from_csv("value", ", ".join(f"`{n}` STRING" for n in (*names, bad)), options).alias("r")).select("r.*")
    checked = F.when(F.col(bad).isNotNull(), F.raise_error(F.lit(f"a row does not have {len(columns)} fields")).cast("string"))
    wanted = [(n, name, kind) for n, (name, kind) in zip(names, columns, strict=True) if kind is not None]
    out = fields.select(*[parsed(checked.otherwise(F.col(n)), kind).alias(name) for n, name, kind in wanted])
    dropped = reduce(lambda a, b: a | b, [F.col(f"`{name}`").isNull() for _, name, _ in wanted])
    if with_dropped:
        return out.withColumn("dropped", dropped)
    return out.where(~dropped).select(*[F.col(f"`{name}`") for _, name, _ in wanted])


def sensor_time(c: Column, legacy_millis: bool = False) -> Column:
    """Milliseconds of "yyyy-MM-dd HH:mm:ss[.f]" or "yyyy-MM-dd", in UTC.

    legacy_millis: the digits after the point are read as a number of milliseconds, so ".976000" adds 976 s.
    """
    whole = F.unix_millis(F.to_timestamp(F.substring_index(c, ".", 1)))
    if legacy_millis:
        return whole + F.coalesce(F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", -1)).try_cast("long"), F.lit(0))
    return F.unix_millis(F.to_timestamp(c))


def read_sensor(spark: SparkSession, path: str, legacy_millis: bool = False) -> DataFrame:
    """(t, c, v, file_date) of sensor logs "time;node;class;family;value;unit", a file or a glob.

    Lines of fewer than six parts are left out, as are identifiers (class Chemsense ID, family mac_address) and
    values that are no numbers. c is "class;family"; file_date is the last date in the file's name, if any.
    """
    parts = F.split("value", ";")
    lines = spark.read.text(path).select(parts.alias("p"), F.regexp_extract(F.input_file_name(), r".*(\d{4}-\d{2}-\d{2})", 1).alias("file_date"))
    rows = lines.where(F.size("p") >= 6).where(~((F.col("p")[2] == "Chemsense ID") & (F.col("p")[3] == "mac_address")))
    out = rows.select(sensor_time(F.col("p")[0], legacy_millis).alias("t"), F.concat_ws(";", F.col("p")[2], F.col("p")[3]).alias("c"), parsed(F.col("p")[4], T.DoubleType()).alias("v"), "file_date")
    return out.where(F.col("v").isNotNull())


def read_triples(spark: SparkSession, rows: str, cols: str, vals: str | None = None, delimiter: str = ",", numbered: bool = False) -> DataFrame:
    """(row, col, val): the n-th item of one file with the n-th of the others; without vals, 1. Files may be gzipped.

    Each path may name several files, taken in the order of their names. Items are numbered by line and place in the
    line; line ends end items, too. Files that do not have the same number of items in every line fail the query.
    numbered: with a column n that follows the order of the items, from 1 and without gaps where every line has one.
    """

    def items(path: str, name: str) -> DataFrame:
        every = numbered_lines(spark, path).select("n", F.posexplode(F.split("value", delimiter)).alias("place", name))
        return every.where(F.length(name) > 0)

    names = ["row", "col", *(["val"] if vals else [])]
    parts = [items(path, name) for path, name in zip([rows, cols, *([vals] if vals else [])], names, strict=True)]
    out = reduce(lambda a, b: a.join(b, ["n", "place"], "full"), parts)
    uneven = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in names])
    out = out.withColumn("row", F.when(uneven, F.raise_error(F.lit("row, col and val files do not have the same number of items")).cast("string")).otherwise(F.col("row")))
    out = out.withColumn("val", F.col("val").cast("long") if vals else F.lit(1).cast("long"))
    if not numbered:
        return out.select("row", "col", "val")
    return out.select("row", "col", "val", "n", "place").withColumn("n", _places(out))


def _places(items: DataFrame) -> Column:
    """Numbers from 1 that follow (n, place); a row for each line is looked at, to see how many places lines have."""
    most = items.agg(F.coalesce(F.max("place"), F.lit(0)).alias("most")).first()["most"] + 1
    return F.col("n") * most + F.col("place") + 1


def sensor_files(paths: list[str], pattern: str = r"(\w+)-(\d{4}-\d{2}-\d{2})[^/]*$") -> list[tuple[str, str, str]]:
    """(path, type, date) of sensor logs by their names, in the order of dates; a name that does not match, or comes twice, is an error."""
    found = []
    for path in paths:
        m = re.search(pattern, path)
        if m is None:
            raise ValueError(f"no type and date in the name of {path}")
        found.append((path, m[1], m[2]))
    check_distinct_names(paths)
    return sorted(found, key=lambda f: f[2])


def check_distinct_names(paths: list[str]) -> None:
    """Files that are worked on once each are told apart by their names."""
    names = [path.rstrip("/").rsplit("/", 1)[-1] for path in paths]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"files of the same name: {sorted(twice)}")


def split_points(dates: list[str]) -> list[str]:
    """Where the table of a list of sensor files is split: every third date but for the first two."""
    return sorted(set(sorted(dates)[1:][1::3]))
