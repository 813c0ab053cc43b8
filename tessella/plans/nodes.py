"""Logical plans: immutable trees, checked against their schemas as they are built."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame

from ..functions.algebra import Ext, Map, Plus, Times, check_times, ext_of, only
from .schema import Key, Schema, SchemaError, Val


@dataclass(frozen=True, eq=False)
class Node:
    """A plan. Methods build larger plans; schema is the result's."""

    schema: Schema = field(init=False, repr=False)

    def _set(self, schema: Schema) -> None:
        object.__setattr__(self, "schema", schema)

    @property
    def inputs(self) -> list[Node]:
        return [getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name, None), Node)]

    def ext(self, function: Ext | Map) -> Node:
        return Extend(self, ext_of(function))

    map = ext

    def union(self, other: Node, plus: Mapping[str, Plus] | None = None, strict: bool = False) -> Node:
        return Union(self, other, dict(plus or {}), strict)

    def agg(self, keys: Iterable[str] = (), plus: Mapping[str, Plus] | None = None) -> Node:
        return Aggregate(self, tuple(keys), dict(plus or {}))

    def join(self, other: Node, times: Mapping[str, Times] | None = None, symmetric: tuple[str, str] | None = None) -> Node:
        return Join(self, other, dict(times or {}), symmetric)

    def rename(self, names: Mapping[str, str]) -> Node:
        return Rename(self, dict(names))

    def sort(self, keys: Iterable[str]) -> Node:
        return Sort(self, tuple(keys))

    def where(self, predicate: Callable[[Mapping[str, Column]], Column]) -> Node:
        """Rows that satisfy predicate: what a seek to a range of keys gives."""
        return Where(self, predicate)

    def dedup_keys(self) -> Node:
        """One row for each key; which of several is not said."""
        return Distinct(self)

    def store(self, table: str) -> Node:
        return Store(self, table)

    def transform(self, f: Callable[[Node], Node]) -> Node:
        """The tree with f applied to every node, inputs first; a node met twice is turned once."""
        done: dict[int, Node] = {}

        def go(node: Node) -> Node:
            if id(node) not in done:
                new = {x.name: go(v) for x in fields(node) if isinstance(v := getattr(node, x.name, None), Node)}
                done[id(node)] = f(replace(node, **new) if any(new[k] is not getattr(node, k) for k in new) else node)
            return done[id(node)]

        return go(self)

    def fold(self, f: Callable[[Any, Node], Any], start: Any, stop: Callable[[Node], bool] = lambda _: False) -> Any:
        """f over all nodes, inputs first; below a node for which stop holds nothing is visited."""
        if not stop(self):
            for x in self.inputs:
                start = x.fold(f, start, stop)
        return f(start, self)

    def transform_fold(self, start: Any, f: Callable[[Any, Node, int, list], tuple[Any, bool]], replace_with: Callable[[Node, list], Node] | None = None) -> tuple[Any, Node]:
        """A walk that sees a node before its inputs, between and after them, and may rewrite the tree; (result, tree).

        f(given, node, position, results) is called with position inputs visited, whose results are given; it returns
        (value, stop): what the next input is given, or, with stop or after the last input, the node's result, on which
        inputs not yet visited are left alone. replace_with(node, results) then gives the node's replacement.
        """
        node, results = self, []
        names = [x.name for x in fields(node) if isinstance(getattr(node, x.name, None), Node)]
        while True:
            value, stop = f(start, node, len(results), results)
            if stop or len(results) == len(names):
                return value, replace_with(node, results) if replace_with else node
            name = names[len(results)]
            result, new = getattr(node, name).transform_fold(value, f, replace_with)
            results.append(result)
            if new is not getattr(node, name):
                node = replace(node, **{name: new})

    def base_tables(self) -> set[str]:
        return self.fold(lambda s, n: s | ({n.table} if isinstance(n, Load) else set()), set())

    def written_tables(self) -> set[str]:
        return self.fold(lambda s, n: s | ({n.table} if isinstance(n, Store) else set()), set())

    def bind(self, tables: Mapping[str, DataFrame | Node]) -> Node:
        """The plan with its Loads bound to tables; names that tables lacks stay."""

        def one(node: Node) -> Node:
            if isinstance(node, Load) and node.table in tables:
                found = tables[node.table]
                return found if isinstance(found, Node) else Frame(found, node.schema)
            return node

        return self.transform(one)

    def frame(self) -> DataFrame:
        from .lower import lower

        return lower(self)

    def run(self) -> DataFrame:
        """Carry out the plan: a Store writes its table."""
        from .lower import run

        return run(self)

    def to_dot(self) -> str:
        """The tree in the DOT language."""
        names: dict[int, str] = {}
        lines: list[str] = []

        def go(node: Node) -> str:
            if id(node) not in names:
                names[id(node)] = f"n{len(names)}"
                lines.append(f'  {names[id(node)]} [label="{type(node).__name__}\\n{", ".join(node.schema.key_names)} | {", ".join(node.schema.val_names)}"];')
                lines.extend(f"  {go(x)} -> {names[id(node)]};" for x in node.inputs)
            return names[id(node)]

        go(self)
        return "\n".join(["digraph plan {", *lines, "}"])


@dataclass(frozen=True, eq=False)
class Load(Node):
    """A named base table, to be bound before the plan runs."""

    table: str
    of: Schema

    def __post_init__(self) -> None:
        self._set(self.of)


@dataclass(frozen=True, eq=False)
class Frame(Node):
    """A DataFrame with the columns of a schema."""

    df: DataFrame
    of: Schema

    def __post_init__(self) -> None:
        if missing := set(self.of.names) - set(self.df.columns):
            raise SchemaError(f"columns are missing: {sorted(missing)}")
        self._set(self.of)


@dataclass(frozen=True, eq=False)
class Data(Node):
    """Rows in memory, as dicts or tuples in the order of the schema; an iterator is read once, here."""

    of: Schema
    rows: tuple = ()

    def __post_init__(self) -> None:
        names = self.of.names
        rows = tuple(tuple(r.get(n) for n in names) if isinstance(r, Mapping) else tuple(r) for r in self.rows)
        object.__setattr__(self, "rows", rows)
        self._set(self.of)


def Empty(schema: Schema) -> Data:
    return Data(schema)


@dataclass(frozen=True, eq=False)
class Extend(Node):
    input: Node
    function: Ext

    def __post_init__(self) -> None:
        old, new = self.input.schema, self.function.schema
        if shared := set(old.key_names) & set(new.names):
            raise SchemaError(f"{self.function.name}: new attributes are keys already: {sorted(shared)}")
        self._set(Schema([*old.keys, *new.keys], new.vals))


@dataclass(frozen=True, eq=False)
class Union(Node):
    left: Node
    right: Node
    plus: dict[str, Plus]
    strict: bool = False

    def __post_init__(self) -> None:
        a, b = self.left.schema, self.right.schema
        keys = [k for k in a.keys if k.name in b.key_names]
        if self.strict:
            n = next((i for i, (x, y) in enumerate(zip(a.keys, b.keys)) if x.name != y.name), min(len(a.keys), len(b.keys)))
            if {k.name for k in keys} != set(a.key_names[:n]):
                raise SchemaError("a shared key lies outside the common prefix of the keys")
        if any(b.key(k.name).kind != k.kind for k in keys):
            raise SchemaError("shared keys differ in type")
        vals: dict[str, Val] = {}
        for v in (*a.vals, *b.vals):
            if vals.setdefault(v.name, v) != v:
                raise SchemaError(f"{v.name} differs in type or default")
        self._set(_summed(Schema(keys, vals.values()), self.plus))
        object.__setattr__(self, "plus", {v.name: self.plus.get(v.name) or only(v.default) for v in self.schema.vals})


@dataclass(frozen=True, eq=False)
class Aggregate(Node):
    input: Node
    keys: tuple[str, ...]
    plus: dict[str, Plus]

    def __post_init__(self) -> None:
        old = self.input.schema
        if missing := set(self.keys) - set(old.key_names):
            raise SchemaError(f"not keys: {sorted(missing)}")
        self._set(_summed(Schema([k for k in old.keys if k.name in self.keys], old.vals), self.plus))
        object.__setattr__(self, "plus", {v.name: self.plus.get(v.name) or only(v.default) for v in old.vals})


def _summed(schema: Schema, plus: Mapping[str, Plus]) -> Schema:
    for name, p in plus.items():
        if name not in schema.val_names:
            raise SchemaError(f"an addition for {name}, which is no value")
        if p.identity != schema.val(name).default and p.name not in ("max", "min"):
            raise SchemaError(f"{p.name}: identity {p.identity!r} is not the default {schema.val(name).default!r} of {name}")
    return schema


@dataclass(frozen=True, eq=False)
class Join(Node):
    """Natural join on the common keys. symmetric (a, b): only rows whose key a is b at most are wanted."""

    left: Node
    right: Node
    times: dict[str, Times]
    symmetric: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        a, b = self.left.schema, self.right.schema
        if any(b.key(k.name).kind != k.kind for k in a.keys if k.name in b.key_names):
            raise SchemaError("common keys differ in type")
        vals = []
        for v in a.vals:
            if v.name in b.val_names:
                if v.name not in self.times:
                    raise SchemaError(f"no product for {v.name}")
                t = self.times[v.name]
                check_times(t, v, b.val(v.name))
                vals.append(Val(v.name, t.kind, t.zero))
        if extra := set(self.times) - {v.name for v in vals}:
            raise SchemaError(f"products for what is no value of both: {sorted(extra)}")
        self._set(Schema([*a.keys, *(k for k in b.keys if k.name not in a.key_names)], vals))


@dataclass(frozen=True, eq=False)
class Rename(Node):
    """All renames at once, so that names may be swapped."""

    input: Node
    names: dict[str, str]

    def __post_init__(self) -> None:
        old = self.input.schema
        if missing := set(self.names) - set(old.names):
            raise SchemaError(f"no such attributes: {sorted(missing)}")
        new = lambda a: replace(a, name=self.names.get(a.name, a.name))
        self._set(Schema([new(k) for k in old.keys], [new(v) for v in old.vals]))


@dataclass(frozen=True, eq=False)
class Sort(Node):
    """Another order of the same keys. Rows are ordered only where a result is read in order."""

    input: Node
    keys: tuple[str, ...]

    def __post_init__(self) -> None:
        old = self.input.schema
        if sorted(self.keys) != sorted(old.key_names):
            raise SchemaError(f"{self.keys} is no order of {old.key_names}")
        self._set(Schema([old.key(k) for k in self.keys], old.vals))


@dataclass(frozen=True, eq=False)
class Where(Node):
    input: Node
    predicate: Callable[[Mapping[str, Column]], Column]

    def __post_init__(self) -> None:
        self._set(self.input.schema)


@dataclass(frozen=True, eq=False)
class Distinct(Node):
    input: Node

    def __post_init__(self) -> None:
        self._set(self.input.schema)


@dataclass(frozen=True, eq=False)
class Store(Node):
    """A sink; only at the end of a plan."""

    input: Node
    table: str

    def __post_init__(self) -> None:
        if self.input.fold(lambda s, n: s or isinstance(n, Store), False):
            raise SchemaError("a store is the end of a plan")
        self._set(self.input.schema)


def reset_to_defaults(schema: Schema) -> Map:
    """Same keys, every value at its default."""
    return Map("defaults", schema.vals, lambda row: {v.name: v.default_column() for v in schema.vals})


__all__ = ["Aggregate", "Data", "Distinct", "Empty", "Extend", "Frame", "Join", "Key", "Load", "Node", "Rename", "Sort", "Store", "Union", "Where", "reset_to_defaults"]
