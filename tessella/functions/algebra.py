"""User-defined functions of the algebra, written as column expressions so that they stay in the JVM.

Plus adds up the values of equal keys, Times multiplies the values of joined rows, Map and Ext turn a row into one
or several. A Python function is possible for each, as the slow way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import Key, Kind, Schema, SchemaError, Val


def _lit(value: Any, kind: Kind | None = None) -> Column:
    return F.lit(value) if kind is None else F.lit(value).cast(kind.spark)


@dataclass(frozen=True)
class Plus:
    """A commutative monoid; aggregate turns a column into the sum of a group's values."""

    name: str
    identity: Any
    aggregate: Callable[[Column], Column] = field(compare=False)
    #: The values of a group are gathered, so that groups are summed in parts of bounded size first.
    gathers: bool = False

    @staticmethod
    def of(name: str, identity: Any, plus: Callable[[Column, Column], Column]) -> Plus:
        """Any commutative, associative function of two columns. Values are gathered into arrays, in parts of bounded size, so a built-in one is faster."""

        def aggregate(c: Column) -> Column:
            values = F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"])  # structs, as null values would be dropped
            return F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.get(values, 0), plus)

        return Plus(name, identity, aggregate, True)

    @staticmethod
    def python(name: str, identity: Any, plus: Callable[[Any, Any], Any], spark_type: str) -> Plus:
        """A Python function of two values, as a grouped-aggregate pandas function."""

        def fold(values: pd.Series) -> Any:
            total = identity
            for v in values:
                total = plus(total, v)
            return total

        fold.__annotations__ = {"values": pd.Series, "return": Any}
        return Plus(name, identity, F.pandas_udf(fold, spark_type, F.PandasUDFType.GROUPED_AGG))

    def with_identity(self, identity: Any) -> Plus:
        """The same addition with another neutral value: it is left out, and is the sum where nothing else is."""
        inner = self.aggregate
        return Plus(self.name, identity, lambda c: F.coalesce(inner(F.when(~c.eqNullSafe(F.lit(identity)), c)), F.lit(identity)), self.gathers)

    def verify_identity(self, kind: Kind, values: Iterable[Any] = ()) -> None:
        """Check on values, and on the identity itself, that adding the identity changes nothing; one small job."""
        tried = list(dict.fromkeys([self.identity, *values]))
        data = [(n, v) for n, v in enumerate(tried) for v in (v, self.identity)]
        df = SparkSession.active().createDataFrame(data, T.StructType([T.StructField("n", T.LongType()), T.StructField("v", kind.spark)]))
        for r in df.groupBy("n").agg(self.aggregate(F.col("v")).cast(kind.spark).alias("s")).collect():
            if r["s"] != tried[r["n"]]:
                raise SchemaError(f"{self.name}: {self.identity!r} is no identity, as {tried[r['n']]!r} becomes {r['s']!r}")


def total(name: str = "+", identity: Any = 0) -> Plus:
    """Addition of numbers; the sum of no values, or of nulls only, is the identity (null: null)."""
    return Plus(name, identity, lambda c: F.sum(c) if identity is None else F.coalesce(F.sum(c), F.lit(identity)))


SUM, NULL_SUM = total(), total("null +", None)
MAX, MIN = Plus("max", None, F.max), Plus("min", None, F.min)
#: 1 if any value is not 0.
ANY = Plus("any", 0, lambda c: F.max(F.when(F.coalesce(c, F.lit(0)) != 0, 1).otherwise(0)))


def only(identity: Any = None) -> Plus:
    """At most one value other than the identity in a group, else the query fails."""

    def aggregate(c: Column) -> Column:
        other = F.when(~c.eqNullSafe(F.lit(identity)), c)
        clash = F.raise_error(F.lit("several values for one key, and no addition for them"))
        return F.when(F.count(other) > 1, clash).otherwise(F.coalesce(F.max(other), F.lit(identity)))

    return Plus("only", identity, aggregate)


@dataclass(frozen=True)
class Times:
    """A product of two values that is zero if either side is its annihilator."""

    name: str
    left: Any
    right: Any
    kind: Kind
    times: Callable[[Column, Column], Column] = field(compare=False)
    zero: Any = None

    @staticmethod
    def annihilating(name: str, left: Any, right: Any, kind: Kind, times: Callable[[Column, Column], Column], zero: Any) -> Times:
        """times, but zero where an input is its annihilator."""

        def product(a: Column, b: Column) -> Column:
            return F.when(a.eqNullSafe(F.lit(left)) | b.eqNullSafe(F.lit(right)), _lit(zero, kind)).otherwise(times(a, b))

        return Times(name, left, right, kind, product, zero)

    def verify_annihilator(self, left_kind: Kind, right_kind: Kind, lefts: Iterable[Any] = (), rights: Iterable[Any] = ()) -> None:
        """Check on values, and on the annihilators themselves, that a product with an annihilator is zero; one small job."""
        pairs = [(a, self.right) for a in [self.left, *lefts]] + [(self.left, b) for b in rights]
        df = SparkSession.active().createDataFrame(pairs, T.StructType([T.StructField("a", left_kind.spark), T.StructField("b", right_kind.spark)]))
        for r in df.select("a", "b", self.times(F.col("a"), F.col("b")).cast(self.kind.spark).alias("c")).collect():
            if r["c"] != self.zero:
                raise SchemaError(f"{self.name}: {r['a']!r} times {r['b']!r} is {r['c']!r}, not {self.zero!r}")

    @staticmethod
    def of_nulls(name: str, kind: Kind, times: Callable[[Column, Column], Column]) -> Times:
        """times, but null where an input is null."""
        return Times.annihilating(name, None, None, kind, times, None)


@dataclass(frozen=True)
class Map:
    """One row from each row, without new keys. f takes the row's columns by name and gives those of vals."""

    name: str
    vals: tuple[Val, ...]
    f: Callable[[Mapping[str, Column]], Mapping[str, Column]] = field(compare=False)

    def as_ext(self) -> Ext:
        return Ext(self.name, Schema((), self.vals), lambda row: [self.f(row)])


@dataclass(frozen=True)
class Ext:
    """Any number of rows from each row, under new keys. f gives a list of rows as column dicts, or one column: an array of structs."""

    name: str
    schema: Schema
    f: Callable[[Mapping[str, Column]], Iterable[Mapping[str, Column]] | Column] = field(compare=False)
    python: bool = False

    @staticmethod
    def of_python(name: str, schema: Schema, f: Callable[[dict[str, Any]], list[dict[str, Any]]]) -> Ext:
        """f takes a row as a dict and gives a list of dicts; it runs in Python workers, batch by batch."""
        return Ext(name, schema, f, True)


def ext_of(function: Map | Ext) -> Ext:
    return function.as_ext() if isinstance(function, Map) else function


def check_times(times: Times, left: Val, right: Val) -> None:
    if times.left != left.default or times.right != right.default:
        raise SchemaError(f"{times.name}: annihilators {times.left!r}, {times.right!r} are not the defaults {left.default!r}, {right.default!r} of {left.name}")


def reduced(values: Column, default: Any = None, plus: Callable[[Column, Column], Column] | None = None) -> Column:
    """One value of an array: its elements by plus, default if there are none (None: an error); without plus, more than one is an error."""
    none = F.raise_error(F.lit("a value is missing and has no default")) if default is None else F.lit(default)
    many = F.raise_error(F.lit("one value was expected")) if plus is None else F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.get(values, 0), plus)
    return F.when(F.size(values) > 1, many).otherwise(F.when(F.size(values) == 1, F.get(values, 0)).otherwise(none))


def keep_where(name: str, vals: Iterable[Val], predicate: Callable[[Mapping[str, Column]], Column]) -> Map:
    """The filter of the algebra: rows outside the predicate get default values and stay."""
    vals = tuple(vals)
    return Map(name, vals, lambda row: {v.name: F.when(predicate(row), row[v.name]).otherwise(v.default_column()) for v in vals})


def binned(t: Column, size: int) -> Column:
    """t rounded to the nearest multiple of size, halves up."""
    rest = t % size
    return t - rest + F.when(rest >= size // 2, size).otherwise(0)


def bin_key(old: str, new: str, size: int, vals: Iterable[Val]) -> Ext:
    """An additional key, the rounded old one; values stay."""
    vals = tuple(vals)
    kind = Key(new, _ulong())
    return Ext("bin", Schema([kind], vals), lambda row: [{new: binned(row[old], size)} | {v.name: row[v.name] for v in vals}])


def _ulong() -> Kind:
    from ..plans.schema import ULONG

    return ULONG
