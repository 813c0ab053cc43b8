"""Matrix kernels on tables (row, col, val), and the covariance pipeline with its switchable rewrites."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import binned

Product = Callable[[Column, Column], Column]


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def ewise(a: DataFrame, b: DataFrame, product: Product, keep_zero: bool = True) -> DataFrame:
    """product of the values at (row, col) that both have."""
    out = a.join(b.withColumnRenamed("val", "__b"), ["row", "col"]).select("row", "col", product(F.col("val"), F.col("__b")).alias("val"))
    return out if keep_zero else discard_zeros(out)


def discard_zeros(m: DataFrame) -> DataFrame:
    return m.where(F.col("val") != 0)


def row_cartesian(a: DataFrame, b: DataFrame, product: Product) -> DataFrame:
    """(row, col_a, col_b, val) for every two entries of equal rows."""
    left = a.select("row", F.col("col").alias("col_a"), F.col("val").alias("__a"))
    right = b.select("row", F.col("col").alias("col_b"), F.col("val").alias("__b"))
    return left.join(right, "row").select("row", "col_a", "col_b", product(F.col("__a"), F.col("__b")).alias("val"))


def table_mult(a: DataFrame, b: DataFrame, product: Product = lambda x, y: x * y, plus: Callable[[Column], Column] = F.sum, upper_triangle: bool = False, keep_zero: bool = True, keep_row: bool = False) -> DataFrame:
    """Transpose of a times b: joined on row, multiplied, summed by the two columns.

    upper_triangle: only col_a <= col_b (the join stays an equality on row); keep_row: not summed, the row stays.
    """
    out = row_cartesian(a, b, product)
    if upper_triangle:
        out = out.where(F.col("col_a") <= F.col("col_b"))
    if not keep_zero:
        out = discard_zeros(out)
    return out if keep_row else sum_products(out, plus)


def sum_products(products: DataFrame, plus: Callable[[Column], Column] = F.sum) -> DataFrame:
    return products.groupBy(F.col("col_a").alias("row"), F.col("col_b").alias("col")).agg(plus(F.col("val")).alias("val"))


def row_means(m: DataFrame) -> DataFrame:
    """(row, col, val): the mean of equal (row, col), by partial sums and counts."""
    return m.groupBy("row", "col").agg(F.sum("val").alias("s"), F.count("val").alias("n")).select("row", "col", F.try_divide("s", "n").alias("val"))


def count_rows(m: DataFrame) -> DataFrame:
    """One row (n): distinct rows; no rows of an empty matrix."""
    return m.groupBy(F.lit(1).alias("__all")).agg(F.countDistinct("row").cast("long").alias("n")).drop("__all")


def reduce_rows(m: DataFrame, plus: Callable[[Column], Column] = F.sum) -> DataFrame:
    return m.groupBy("row").agg(plus(F.col("val")).alias("val"))


def divide(m: DataFrame, by: Column | float, keep_zero: bool = True) -> DataFrame:
    """Values by a number; by zero: null."""
    out = m.withColumn("val", F.try_divide("val", F.lit(by) if isinstance(by, (int, float)) else by))
    return out if keep_zero else discard_zeros(out)


def dense(m: DataFrame, columns: list[str]) -> DataFrame:
    """A column for each of columns, a row for each row; for reading."""
    return m.groupBy("row").pivot("col", columns).agg(F.first("val"))


#: Switches of the covariance pipeline, by letter: A aggregate while multiplying, D no intermediate tables, E typed
#: instead of string values, F filter on the time before binning, M no second sort, P partitioning kept, R one source
#: for both sides, S upper triangle only, Z zeros dropped.
SWITCHES = "ADEFMPRSZ"


def parse_switches(s: str) -> frozenset[str]:
    """"none", or letters of SWITCHES."""
    if s.lower() == "none":
        return frozenset()
    if unknown := set(s) - set(SWITCHES):
        raise ValueError(f"unknown switches: {sorted(unknown)}")
    return frozenset(s)


def covariance(a: DataFrame, b: DataFrame, switches: str = "none", bin_size: int = 60_000, least: int = 0, most: int = 2**63 - 1, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(row, col, val): covariances of the classes c of the binned difference of two tables (t, c, v).

    All switches give the same values; S leaves out what lies below the diagonal, Z what is zero. Catalyst does A,
    D, E, F, M, P and R by itself, so that they change the plan's form only: A the place of the sum, F the filter's
    place, P an explicit repartitioning; without D, and for R, keep is applied to what is used twice: a function that
    caches or writes a table, whose end is the caller's to say.
    """
    on = parse_switches(switches)

    def filtered(x: DataFrame) -> DataFrame:
        early = "F" in on  # else the filter comes after the renaming; Catalyst pushes either down to the scan
        x = x.where(F.col("t").between(least, most)) if early else x
        x = x.select(F.col("t").alias("row"), F.col("c").alias("col"), F.col("v").alias("val")).where("val IS NOT NULL")
        x = x if early else x.where(F.col("row").between(least, most))
        x = row_means(x.withColumn("row", binned(F.col("row"), bin_size)))
        return x.repartition("row") if "P" in on else x

    keep_zero = "Z" not in on
    x = ewise(filtered(a), filtered(b), lambda l, r: l - r)
    x = x if "D" in on else keep(x)
    n = count_rows(x).withColumnRenamed("n", "__n")
    means = x.groupBy("col").agg(F.avg("val").alias("__m"))
    u = x.join(means, "col").select("row", "col", (F.col("val") - F.col("__m")).alias("val"))
    u = u if keep_zero else discard_zeros(u)
    u = keep(u) if "R" in on else u
    if "A" in on:
        c = table_mult(u, u, upper_triangle="S" in on, keep_zero=keep_zero)
    else:
        c = sum_products(table_mult(u, u, upper_triangle="S" in on, keep_zero=keep_zero, keep_row=True))
    return divide(c.crossJoin(F.broadcast(n)), F.col("__n") - 1, keep_zero).drop("__n")  # n has one row at most


def mirror(upper: DataFrame) -> DataFrame:
    """The whole symmetric matrix of its upper triangle."""
    return upper.unionByName(transpose(upper.where(F.col("row") != F.col("col"))))


def joined_on(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda x, y: x.join(y, keys), tables)
