"""Textual logical plans in the notation of Python literals and calls: parser, plan nodes, compiler, command line.

    Store(RelationKey('public','adhoc','out'), Apply([('x', NamedAttributeRef('a'))], Scan(...)))
"""

from __future__ import annotations

import argparse
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import read_delimited
from ..sources.sinks import table_name, write_delimited
from .schema import check_identifier


class PlanTextError(ValueError):
    """Text that is no plan."""


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Opaque:
    """An object that the text shows as <...>."""

    content: str


_TOKEN = re.compile(
    r"""\s*(?:(?P<string>[uU]?(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"))|(?P<number>-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<opaque><[^>]*>)|(?P<mark>[\[\](){},:]))"""
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def parse(text: str) -> Any:
    """Strings, numbers, lists, pairs (as tuples), maps (as dicts), None, Call and Opaque."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanTextError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(mark: str | None = None) -> tuple[str, str]:
        nonlocal place
        kind, value = tokens[place]
        if mark is not None and value != mark or kind == "end" and mark is None:
            raise PlanTextError(f"expected {mark or 'more'}, found {value or 'the end'!r}")
        place += 1
        return kind, value

    def sequence(close: str, item: Callable[[], Any]) -> list:
        out = []
        while tokens[place][1] != close:
            out.append(item())
            if tokens[place][1] != close:
                take(",")
        take(close)
        return out

    def entry() -> tuple[str, Any]:
        key = one()
        take(":")
        return key, one()

    def one() -> Any:
        kind, value = take()
        if kind == "string":
            body = value.lstrip("uU")[1:-1]
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.DOTALL)
        if kind == "number":
            return float(value) if re.search(r"[.eE]", value) else int(value)
        if kind == "opaque":
            return Opaque(value[1:-1])
        if kind == "name":
            if value == "None":
                return None
            take("(")
            return Call(value, tuple(sequence(")", one)))
        if value == "[":
            return sequence("]", one)
        if value == "(":
            pair = tuple(sequence(")", one))
            if len(pair) != 2:
                raise PlanTextError(f"a pair of {len(pair)}")
            return pair
        if value == "{":
            return dict(sequence("}", entry))
        raise PlanTextError(f"unexpected {value!r}")

    out = one()
    if tokens[place][0] != "end":
        raise PlanTextError(f"text after the plan: {tokens[place][1]!r}")
    return out


#: Arguments that each node takes: fixed values of the notation.
ARITY = {
    "Store": 2, "Dump": 1, "Apply": 2, "FileScan": 4, "FileStore": 4, "Select": 2, "Scan": 4, "RelationKey": 3, "RepresentationProperties": 3,
    "frozenset": 1, "Scheme": 1, "NumericLiteral": 1, "StringLiteral": 1, "NamedAttributeRef": 1, "UnnamedAttributeRef": 2, "PLUS": 2, "DIVIDE": 2, "GT": 2,
}
TYPES = {"LONG": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DATETIME": T.TimestampType()}
#: Attributes that place others in storage; they hold no data.
MARKS = ("__DAP__", "__LAP__", "$__DAP__", "$__LAP__")
FAMILY, VISIBILITY, STAMP = "__FAMILY__", "__VIS", "__TS"


def check(node: Any) -> Any:
    """node, if every call in it is known and has its number of arguments."""
    if isinstance(node, Call):
        if node.name not in ARITY:
            raise PlanTextError(f"unknown node {node.name}")
        if len(node.args) != ARITY[node.name]:
            raise PlanTextError(f"{node.name} takes {ARITY[node.name]} arguments, not {len(node.args)}")
        for a in node.args:
            check(a)
    elif isinstance(node, (list, tuple)):
        for a in node:
            check(a)
    elif isinstance(node, dict):
        for a in node.values():
            check(a)
    return node


def _is(node: Any, *names: str) -> Call:
    if not isinstance(node, Call) or node.name not in names:
        raise PlanTextError(f"expected {' or '.join(names)}, found {node!r}")
    return node


def scheme(node: Any) -> list[tuple[str, T.DataType]]:
    out = []
    for name, kind in _is(node, "Scheme").args[0]:
        short = kind.removesuffix("_TYPE")
        if short not in TYPES:
            raise PlanTextError(f"unknown type {kind}")
        out.append((name, TYPES[short]))
    return out


@dataclass
class Relation:
    """A compiled plan: keys in distributed order, keys in local order, and values are parts of the columns of df."""

    df: DataFrame
    distributed: list[str]
    local: list[str]
    values: list[str]

    @property
    def names(self) -> list[str]:
        return [*self.distributed, *self.local, *self.values]

    def plain(self) -> DataFrame:
        """Without the columns for visibility and time."""
        return self.df.select([F.col(f"`{n}`") for n in self.names])


_NUMBERS = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)


class Compiler:
    """Plans to DataFrames. tables: relation name (user_program_relation) to DataFrame, else the session's tables."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})
        self._writes: list[Callable[[], DataFrame | None]] = []

    def run(self, text: str) -> DataFrame:
        """Compile and carry out: stores are written; the result is the table stored last, else what the last operator gave."""
        self._writes.clear()
        out = self.compile(check(parse(text))).df
        for write in self._writes:
            out = write() or out
        return out

    def compile(self, node: Any) -> Relation:
        node = _is(node, "Store", "Dump", "Apply", "FileScan", "FileStore", "Select", "Scan")
        return getattr(self, f"_{node.name.lower()}")(*node.args)

    def _dump(self, source: Any) -> Relation:
        return self.compile(source)

    def _store(self, key: Any, source: Any) -> Relation:
        out, name = self.compile(source), table_name(*_is(key, "RelationKey").args)
        for n in out.names:
            check_identifier(n)

        def write() -> DataFrame:
            out.df.write.mode("overwrite").saveAsTable(name)
            return self.spark.table(name)

        self._writes.append(write)
        return out

    def _filestore(self, file: str, form: str, options: dict, source: Any) -> Relation:
        self._csv(form)
        out = self.compile(source)
        self._writes.append(lambda: write_delimited(out.plain(), file, str(options.get("header", "true")).lower() == "true", single=str(options.get("single", "true")).lower() == "true"))
        return out

    def _filescan(self, file: str, form: str, of: Any, options: dict) -> Relation:
        self._csv(form)
        columns = scheme(of)
        data = [(n, t) for n, t in columns if n not in MARKS]
        df = read_delimited(self.spark, file, data, int(float(options.get("skip", 0) or 0)), options.get("delimiter", ","), options.get("quote", '"'), options.get("escape", "\\"))
        return self._placed(df, [n for n, _ in columns])

    @staticmethod
    def _csv(form: str) -> None:
        if form.upper() != "CSV":
            raise PlanTextError(f"unknown format {form}")

    @staticmethod
    def _placed(df: DataFrame, names: list[str], first: list[str] = ()) -> Relation:
        """Marks end the keys in distributed and in local order; without marks all are keys."""
        parts: list[list[str]] = [[]]
        marked = False
        for n in names:
            if n in MARKS:
                marked = True
                while len(parts) <= (1 if n.strip("$") == "__LAP__" else 0):
                    parts.append([])
                parts.append([])
            else:
                parts[-1].append(n)
        if not marked:
            rest = [n for n in names if n not in first]
            return Relation(df, [*first, *rest] if not first else list(first), [] if not first else rest, [])
        has_local = any(n.strip("$") == "__LAP__" for n in names)
        distributed = parts[0]
        local = parts[1] if has_local and len(parts) > 1 else []
        return Relation(df, distributed, local, [n for p in parts[2 if has_local else 1 :] for n in p])

    def _scan(self, key: Any, of: Any, _size: Any, layout: Any) -> Relation:
        name, columns = table_name(*_is(key, "RelationKey").args), scheme(of)
        hashed = _is(layout, "RepresentationProperties").args[0]
        attributes = (_is(hashed, "frozenset").args[0] or []) if hashed is not None else []
        names = [n for n, _ in columns]
        first = [a if isinstance(a, str) else a.args[0] if _is(a, "NamedAttributeRef", "UnnamedAttributeRef").name == "NamedAttributeRef" else names[a.args[0]] for a in attributes]
        df = self.tables[name] if name in self.tables else self.spark.table(name)
        extra = [c for c in df.columns if c.endswith((VISIBILITY, STAMP))]
        df = df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in columns if n not in MARKS], *extra)
        return self._placed(df, names, first)

    def _select(self, condition: Any, source: Any) -> Relation:
        out = self.compile(source)
        column, kind = self.expression(_is(condition, "GT"), out)
        assert isinstance(kind, T.BooleanType)
        return Relation(out.df.where(column), out.distributed, out.local, out.values)

    def _apply(self, emitters: list, source: Any) -> Relation:
        """Columns for the emitters; <v>__VIS and <v>__TS set a value's visibility and time, else they are carried along."""
        old = self.compile(source)
        made = {name: self.expression(e, old) for name, e in emitters if name not in MARKS}
        plain = [n for n, _ in emitters if n not in MARKS and n != FAMILY and not n.endswith((VISIBILITY, STAMP))]
        used = {n: self._inputs(e, old) for n, e in emitters if n not in MARKS}
        if any(n in MARKS for n, _ in emitters):
            placed = self._placed(old.df, [n for n, _ in emitters if n in MARKS or n in plain])
            distributed, local, values = placed.distributed, placed.local, placed.values
        else:
            distributed, local, values = [], [], []
            for n in plain:
                inputs = used[n]
                if n in old.distributed:
                    distributed.append(n)
                elif n in old.local:
                    local.append(n)
                elif n in old.values or not inputs:
                    values.append(n)
                elif inputs <= set(old.distributed):
                    distributed.append(n)
                elif inputs <= {*old.distributed, *old.local}:
                    local.append(n)
                else:
                    values.append(n)
        if not distributed:
            (distributed, local) = (local[:1], local[1:]) if local else (values[:1], [])
            values = [v for v in values if v not in distributed]
        columns = [made[n][0].alias(n) for n in (*distributed, *local, *values)]
        for v in values:
            for suffix, kind in ((VISIBILITY, "string"), (STAMP, "long")):
                if v + suffix in made:
                    columns.append(made[v + suffix][0].cast(kind).alias(v + suffix))
                elif v + suffix in old.df.columns:
                    columns.append(F.col(f"`{v + suffix}`"))
        if FAMILY in made:
            columns.append(made[FAMILY][0].alias(FAMILY))
        return Relation(old.df.select(columns), distributed, local, values)

    def _name(self, node: Call, of: Relation) -> str:
        """Named, or by position among keys and then values."""
        name = node.args[0] if node.name == "NamedAttributeRef" else of.names[node.args[0]]
        if name not in of.df.columns:
            raise PlanTextError(f"no attribute {name}")
        return name

    def _inputs(self, node: Any, of: Relation) -> set[str]:
        if not isinstance(node, Call):
            return set()
        if node.name in ("NamedAttributeRef", "UnnamedAttributeRef"):
            return {self._name(node, of)}
        return set().union(*(self._inputs(a, of) for a in node.args)) if node.args else set()

    def expression(self, node: Any, of: Relation) -> tuple[Column, T.DataType]:
        """A column and its type."""
        node = _is(node, "NamedAttributeRef", "UnnamedAttributeRef", "NumericLiteral", "StringLiteral", "PLUS", "DIVIDE", "GT")
        if node.name.endswith("AttributeRef"):
            name = self._name(node, of)
            return F.col(f"`{name}`"), of.df.schema[name].dataType
        if node.name.endswith("Literal"):
            x = node.args[0]
            return F.lit(x), T.StringType() if isinstance(x, str) else T.DoubleType() if isinstance(x, float) else T.LongType()
        (a, left), (b, right) = (self.expression(x, of) for x in node.args)
        numbers = isinstance(left, _NUMBERS) and isinstance(right, _NUMBERS)
        if node.name == "GT":
            if left != right and not numbers:
                raise PlanTextError(f"GT of {left} and {right}")
            return a > b, T.BooleanType()
        if node.name == "PLUS":
            if left != right:
                raise PlanTextError(f"PLUS of {left} and {right}")
            if isinstance(left, T.BooleanType):
                return a | b, left
            return (F.concat(a, b), left) if isinstance(left, (T.StringType, T.BinaryType)) else (a + b, left)
        if not numbers or left != right and {type(left), type(right)} != {T.LongType, T.DoubleType}:
            raise PlanTextError(f"DIVIDE of {left} and {right}")
        if isinstance(left, (T.LongType, T.IntegerType)) and left == right:
            return F.when(b != 0, F.call_function("div", a, b)).cast(left), left  # truncates; by zero: null
        kind = left if left == right else T.DoubleType()
        by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b == 0, by_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double"))).cast(kind), kind


def main(args: list[str] | None = None) -> None:
    """python -m tessella.plans.plantext [--plan FILE | TEXT]"""
    p = argparse.ArgumentParser(prog="tessella", description="Run a textual plan and show its result.")
    p.add_argument("text", nargs="?", help="the plan")
    p.add_argument("--plan", help="a file that holds the plan")
    p.add_argument("--rows", type=int, default=20)
    given = p.parse_args(args)
    if bool(given.text) == bool(given.plan):
        p.error("give a plan, or --plan and a file")
    text = given.text
    if given.plan:
        with open(given.plan, encoding="utf-8") as f:
            text = f.read()
    Compiler(SparkSession.builder.getOrCreate()).run(text).show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
