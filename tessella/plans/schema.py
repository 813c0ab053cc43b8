"""Schemas of associative tables: an ordered list of key attributes, and value attributes with defaults.

A table maps each key to values; a key that is absent has every value at its default.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A plan or table that does not fit its schema; raised when the plan is built."""


@dataclass(frozen=True)
class Kind:
    """A logical type: its Spark type, whether it may be null, its smallest and largest value, its natural default."""

    name: str
    spark: T.DataType
    nullable: bool = False
    least: Any = None
    most: Any = None
    default: Any = None

    def valid(self, column: Column) -> Column:
        """Whether a value of the Spark type is one of this type."""
        ok = F.lit(True) if self.nullable else column.isNotNull()
        return ok & (column >= 0) if self.name in ("ULONG", "UINT") else ok


_INF = math.inf
KINDS = {
    k.name: k
    for k in (
        Kind("NDOUBLE", T.DoubleType(), True, -_INF, _INF, None),
        Kind("DOUBLE", T.DoubleType(), False, -_INF, _INF, 0.0),
        Kind("FLOAT", T.FloatType(), False, -_INF, _INF, 0.0),
        Kind("ULONG", T.LongType(), False, 0, 2**63 - 1, 0),
        Kind("LONG", T.LongType(), False, -(2**63), 2**63 - 1, 0),
        Kind("UINT", T.IntegerType(), False, 0, 2**31 - 1, 0),
        Kind("INT", T.IntegerType(), False, -(2**31), 2**31 - 1, 0),
        Kind("BOOLEAN", T.BooleanType(), False, False, True, False),
        Kind("STRING", T.StringType(), False, "", None, ""),
        Kind("BINARY", T.BinaryType(), False, b"", None, b""),
        Kind("DATETIME", T.TimestampType(), False, None, None, None),
    )
}
NDOUBLE, DOUBLE, FLOAT, ULONG, LONG, UINT, INT, BOOLEAN, STRING, BINARY, DATETIME = KINDS.values()


def nullable(kind: Kind) -> Kind:
    """The type that also has null, which sorts first."""
    return kind if kind.nullable else Kind(f"NULLABLE_{kind.name}", kind.spark, True, kind.least, kind.most, None)


@dataclass(frozen=True)
class Key:
    name: str
    kind: Kind


@dataclass(frozen=True)
class Val:
    name: str
    kind: Kind
    default: Any = None

    def __post_init__(self) -> None:
        if self.default is None and not self.kind.nullable and self.kind.default is not None:
            object.__setattr__(self, "default", self.kind.default)

    def default_column(self) -> Column:
        return F.lit(self.default).cast(self.kind.spark)


@dataclass(frozen=True)
class Schema:
    keys: tuple[Key, ...]
    vals: tuple[Val, ...]

    def __init__(self, keys: Iterable[Key] = (), vals: Iterable[Val] = ()):
        object.__setattr__(self, "keys", tuple(keys))
        object.__setattr__(self, "vals", tuple(vals))
        names = self.names
        if len(set(names)) != len(names):
            raise SchemaError(f"attributes repeat: {names}")

    @property
    def key_names(self) -> list[str]:
        return [k.name for k in self.keys]

    @property
    def val_names(self) -> list[str]:
        return [v.name for v in self.vals]

    @property
    def names(self) -> list[str]:
        return [a.name for a in (*self.keys, *self.vals)]

    def key(self, name: str) -> Key:
        return next(k for k in self.keys if k.name == name)

    def val(self, name: str) -> Val:
        return next(v for v in self.vals if v.name == name)

    def spark(self) -> T.StructType:
        """The Spark schema; a value's default is in its field's metadata."""
        fields = [T.StructField(k.name, k.kind.spark, k.kind.nullable, {"kind": k.kind.name, "role": "key"}) for k in self.keys]
        fields += [T.StructField(v.name, v.kind.spark, True, {"kind": v.kind.name, "role": "val"} | ({"default": v.default} if isinstance(v.default, (int, float, str, bool)) else {})) for v in self.vals]
        return T.StructType(fields)

    @staticmethod
    def from_spark(schema: T.StructType) -> Schema:
        """The schema that spark() wrote into the metadata of schema's fields."""

        def kind(f: T.StructField) -> Kind:
            name = f.metadata["kind"]
            return nullable(KINDS[name[9:]]) if name.startswith("NULLABLE_") else KINDS[name]

        keys = [Key(f.name, kind(f)) for f in schema.fields if f.metadata.get("role") == "key"]
        return Schema(keys, [Val(f.name, kind(f), f.metadata.get("default")) for f in schema.fields if f.metadata.get("role") == "val"])


def check_identifier(name: str) -> str:
    """name, if it is a letter or "_" and then letters, digits and "_" (the rule of stored relations)."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII):
        raise SchemaError(f"not a name: {name!r}")
    return name
