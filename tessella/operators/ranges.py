"""Intervals over one column or over a tuple of key columns, and range strings; all become filter columns.

A range string lists rows and ranges with its last character as the separator: ":,r1,r3,r5,:,r7,r9,:," means
up to r1, r3, r5 to r7, and r9 and up, all ends included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """From lo to hi (None: unbounded); a tuple bounds several columns in lexicographic order."""

    lo: Any = None
    hi: Any = None
    lo_open: bool = False
    hi_open: bool = False

    @staticmethod
    def point(x: Any) -> Interval:
        return Interval(x, x)

    @staticmethod
    def at_least(x: Any) -> Interval:
        return Interval(x)

    @staticmethod
    def greater_than(x: Any) -> Interval:
        return Interval(x, lo_open=True)

    @staticmethod
    def at_most(x: Any) -> Interval:
        return Interval(None, x)

    @staticmethod
    def less_than(x: Any) -> Interval:
        return Interval(None, x, hi_open=True)

    def is_empty(self) -> bool:
        if self.lo is None or self.hi is None:
            return False
        return self.lo > self.hi or self.lo == self.hi and (self.lo_open or self.hi_open)

    def contains(self, x: Any) -> bool:
        low = self.lo is None or x > self.lo or x == self.lo and not self.lo_open
        return low and (self.hi is None or x < self.hi or x == self.hi and not self.hi_open)

    def contains_all(self, xs: Iterable[Any]) -> bool:
        return all(self.contains(x) for x in xs)

    def encloses(self, other: Interval) -> bool:
        return other.is_empty() or self.intersection(other) == other

    def intersection(self, other: Interval) -> Interval:
        lo = max((i for i in (self, other) if i.lo is not None), key=lambda i: (i.lo, i.lo_open), default=self)
        hi = min((i for i in (self, other) if i.hi is not None), key=lambda i: (i.hi, not i.hi_open), default=self)
        return Interval(lo.lo, hi.hi, lo.lo is not None and lo.lo_open, hi.hi is not None and hi.hi_open)

    def span(self, other: Interval) -> Interval:
        """The smallest interval around both."""
        lo, hi = min(self, other, key=lambda i: (i.lo is not None, i.lo, i.lo_open) if i.lo is not None else (False,)), None
        hi = max(self, other, key=lambda i: (i.hi is None,) if i.hi is None else (False, i.hi, not i.hi_open))
        return Interval(lo.lo, hi.hi, lo.lo is not None and lo.lo_open, hi.hi is not None and hi.hi_open)

    @staticmethod
    def around(xs: Iterable[Any]) -> Interval:
        xs = list(xs)
        return Interval(min(xs), max(xs))

    def transform(self, f: Callable[[Any], Any]) -> Interval:
        """The interval with its ends turned by a monotone f."""
        return Interval(None if self.lo is None else f(self.lo), None if self.hi is None else f(self.hi), self.lo_open, self.hi_open)

    def column(self, *columns: Column) -> Column:
        """Whether the columns lie in the interval; bounds of fewer values bound the first columns."""
        parts = []
        if self.lo is not None:
            parts.append(_beyond(columns, _tuple(self.lo), not self.lo_open, True))
        if self.hi is not None:
            parts.append(_beyond(columns, _tuple(self.hi), not self.hi_open, False))
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def _tuple(x: Any) -> tuple:
    return x if isinstance(x, tuple) else (x,)


def _beyond(columns: Sequence[Column], bound: tuple, equal: bool, up: bool) -> Column:
    """Lexicographic comparison written out, so that its first part can be pushed down to a scan."""
    out = F.lit(equal)
    for c, x in reversed(list(zip(columns, bound))):
        strict = c > F.lit(x) if up else c < F.lit(x)
        out = strict | ((c == F.lit(x)) & out)
    first, x = columns[0], bound[0]
    return (first >= F.lit(x) if up else first <= F.lit(x)) & out if len(bound) > 1 else ((first >= F.lit(x)) if up else (first <= F.lit(x))) if equal else out


class RangeSet:
    """A union of intervals over strings or numbers, kept disjoint and in order."""

    def __init__(self, intervals: Iterable[Interval] = ()):
        todo = sorted((i for i in intervals if not i.is_empty()), key=lambda i: (i.lo is not None, i.lo, i.lo_open) if i.lo is not None else (False,))
        self.intervals: list[Interval] = []
        for i in todo:
            if self.intervals and _touch(self.intervals[-1], i):
                self.intervals[-1] = self.intervals[-1].span(i)
            else:
                self.intervals.append(i)

    def contains(self, x: Any) -> bool:
        return any(i.contains(x) for i in self.intervals)

    def intersection(self, other: RangeSet | Interval) -> RangeSet:
        others = [other] if isinstance(other, Interval) else other.intervals
        return RangeSet(a.intersection(b) for a in self.intervals for b in others)

    def column(self, c: Column) -> Column:
        """Points as one IN, ranges as comparisons, joined by OR."""
        points = [i.lo for i in self.intervals if i.lo is not None and i.lo == i.hi]
        parts = [i.column(c) for i in self.intervals if i.lo is None or i.lo != i.hi]
        return reduce(lambda a, b: a | b, [c.isin(points)] * bool(points) + parts) if self.intervals else F.lit(False)

    def to_string(self, separator: str = ",") -> str:
        """The range string; only closed intervals have one."""
        out = []
        for i in self.intervals:
            if i.lo is not None and i.lo_open or i.hi is not None and i.hi_open:
                raise ValueError("an open interval has no range string")
            out += [i.lo] if i.lo is not None and i.lo == i.hi else [*([i.lo] if i.lo is not None else []), ":", *([i.hi] if i.hi is not None else [])]
        return separator.join(out) + separator if out else ""


def _touch(a: Interval, b: Interval) -> bool:
    if a.hi is None or b.lo is None:
        return True
    return b.lo < a.hi or b.lo == a.hi and not (a.hi_open and b.lo_open)


def split_range_string(s: str) -> list[str]:
    """The parts of a range string between separators."""
    return s[:-1].split(s[-1]) if s else []


def parse_range_string(s: str, prefixes: bool = False) -> RangeSet:
    """prefixes: a single row stands for all rows that start with it."""
    parts = split_range_string(s)
    out, i = [], 0
    while i < len(parts):
        if parts[i] == ":":
            if i + 1 < len(parts) and parts[i + 1] == ":":
                raise ValueError(f"two range marks in a row: {s!r}")
            out.append(Interval(None, parts[i + 1] if i + 1 < len(parts) else None))
            i += 2
        elif i + 1 < len(parts) and parts[i + 1] == ":":
            if i + 2 < len(parts) and parts[i + 2] == ":":
                raise ValueError(f"two range marks in a row: {s!r}")
            out.append(Interval(parts[i], parts[i + 2] if i + 2 < len(parts) else None))
            i += 3
        else:
            out.append(prefix_interval(parts[i]) if prefixes else Interval.point(parts[i]))
            i += 1
    return RangeSet(out)


def prefix_interval(p: str) -> Interval:
    """All strings that start with p."""
    for n in range(len(p), 0, -1):
        if (code := ord(p[n - 1])) < 0x10FFFF:
            after = 0xE000 if code == 0xD7FF else code + 1  # what lies between stands for no character
            return Interval(p, p[: n - 1] + chr(after), hi_open=True)
    return Interval(p or None)


def points_string(rows: Iterable[str], separator: str = ",") -> str:
    return "".join(r + separator for r in rows)


def count_points(s: str) -> int:
    """How many single rows a range string names; -1 if it has a range."""
    parts = split_range_string(s)
    return -1 if ":" in parts else len(parts)


def prepend(prefix: str, s: str) -> RangeSet:
    """The intervals of a range string with prefix before every row; open ends become the ends of the prefix, the upper one exclusive."""
    end = prefix_interval(prefix)

    def one(i: Interval) -> Interval:
        if i.hi is None:
            return Interval(prefix + (i.lo or "") or None, end.hi, lo_open=i.lo_open, hi_open=end.hi_open)
        return Interval(prefix + (i.lo or "") or None, prefix + i.hi, lo_open=i.lo_open, hi_open=i.hi_open)

    return RangeSet(one(i) for i in parse_range_string(s).intervals)


def pad(s: str, prefix: str = "", suffix: str = "") -> str:
    """The range string with prefix before and suffix after every row that it names; marks of ranges stay."""
    return "".join((part if part == ":" else prefix + part + suffix) + s[-1] for part in split_range_string(s))


def contains_empty(s: str) -> bool:
    """Whether a range string names the empty row; an empty one is an error."""
    if not s:
        raise ValueError("no range string")
    return "" in split_range_string(s)


def range_filter(df: DataFrame, column: str, ranges: str, negate: bool = False, prefixes: bool = False) -> DataFrame:
    """Rows whose column lies in the range string; negate: those that do not, nulls among them."""
    inside = parse_range_string(ranges, prefixes).column(F.col(column))
    return df.where(~F.coalesce(inside, F.lit(False)) if negate else inside)


def min_max_filter(df: DataFrame, column: str, least: int, most: int) -> DataFrame:
    return df.where(F.col(column).between(least, most))


def column_filter(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """None or "": all rows; else a range string of points, of one slice, or of any ranges."""
    return range_filter(df, column, wanted) if wanted else df
