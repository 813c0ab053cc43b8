"""Worked queries: word count, a replacement, the covariance of two sensors, and netflow plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.algebra import ANY, NULL_SUM, SUM, Ext, Map, Times, bin_key, keep_where
from .plans.nodes import Load, Node
from .plans.rewrite import symmetric_product
from .plans.schema import NDOUBLE, STRING, UINT, ULONG, Key, Schema, Val

WORDS = Schema([Key("docid", STRING)], [Val("text", STRING)])
TOKENIZE = Ext(
    "tokenize",
    Schema([Key("word", STRING)], [Val("count", UINT)]),
    lambda row: F.transform(F.split(row["text"], " "), lambda w: F.struct(w.alias("word"), F.lit(1).alias("count"))),
)


def word_count(table: str = "documents") -> Node:
    """(word) -> count; words are what single spaces separate, empty ones too."""
    return Load(table, WORDS).ext(TOKENIZE).sort(["word", "docid"]).agg(["word"], {"count": SUM})


MESSAGES = Schema([Key("k", STRING)], [Val("v", STRING)])


def replaced(old: str, new: str, table: str = "messages") -> Node:
    return Load(table, MESSAGES).map(Map("replace", MESSAGES.vals, lambda row: {"v": F.replace(row["v"], F.lit(old), F.lit(new))}))


MEASURES = Schema([Key("t", ULONG), Key("c", STRING)], [Val("v", NDOUBLE)])
_V, _CNT = Val("v", NDOUBLE), Val("cnt", UINT)
COUNTED = Map("count", (_V, _CNT), lambda row: {"v": row["v"], "cnt": F.when(row["v"].isNotNull(), 1).otherwise(0)})
MEAN = Map("mean", (_V,), lambda row: {"v": F.try_divide(row["v"], row["cnt"])})
SUBTRACT = Times.of_nulls("-", NDOUBLE, lambda a, b: a - b)
MULTIPLY = Times.of_nulls("*", NDOUBLE, lambda a, b: a * b)
#: a / (b - 1); of one row: not a number, or infinite.
OVER_LESS_ONE = Times.annihilating("/(n-1)", None, 0, NDOUBLE, lambda a, b: F.when(b == 1, F.when(a == 0, float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))).otherwise(F.try_divide(a, b - 1)), None)
NOT_NULL = Map("not null", (Val("v", UINT),), lambda row: {"v": F.when(row["v"].isNotNull(), 1).otherwise(0)})


def binned_means(table: str, bin_size: int = 120_000, least: int = 0, most: int = 2**63 - 1) -> Node:
    """(t', c) -> mean of v; times in [least, most]."""
    kept = Load(table, MEASURES).map(keep_where("time", (_V,), lambda row: row["t"].between(least, most)))
    counted = kept.ext(bin_key("t", "t'", bin_size, (_V,))).map(COUNTED)
    return counted.sort(["t'", "c", "t"]).agg(["t'", "c"], {"v": NULL_SUM, "cnt": SUM}).map(MEAN)


def covariance(bin_size: int = 120_000, symmetric: bool = False) -> Node:
    """(c, c') -> covariance of the classes of sensorA - sensorB over time bins; of loads sensorA and sensorB."""
    x = binned_means("sensorA", bin_size).join(binned_means("sensorB", bin_size), {"v": SUBTRACT})
    n = x.map(NOT_NULL).agg(["t'"], {"v": ANY}).agg([], {"v": SUM})
    x0 = x.sort(["c", "t'"])
    m = x0.map(COUNTED).agg(["c"], {"v": NULL_SUM, "cnt": SUM}).map(MEAN)
    u = x0.join(m, {"v": SUBTRACT}).sort(["t'", "c"])
    product = u.join(u.rename({"c": "c'"}), {"v": MULTIPLY})
    if symmetric:
        product = symmetric_product(product, "c", "c'")
    return product.sort(["c", "c'", "t'"]).agg(["c", "c'"], {"v": NULL_SUM}).join(n, {"v": OVER_LESS_ONE})
