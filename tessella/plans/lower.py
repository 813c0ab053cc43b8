"""From logical plans to DataFrames. A node used twice becomes one DataFrame, so Spark can reuse its exchange."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nodes as N
from .schema import Schema, SchemaError


def _in_schema(df: DataFrame, schema: Schema) -> DataFrame:
    return df.select([F.col(f"`{a.name}`").cast(a.kind.spark).alias(a.name) for a in (*schema.keys, *schema.vals)])


def _row(schema: Schema) -> dict[str, Column]:
    return {n: F.col(f"`{n}`") for n in schema.names}


def _extend(node: N.Extend, df: DataFrame) -> DataFrame:
    old, function = node.input.schema, node.function
    new = function.schema
    if function.python:
        keys, names, f = old.key_names, old.names, function.f

        def work(batches):
            for pdf in batches:
                rows = []
                for values in pdf[names].itertuples(index=False, name=None):
                    row = dict(zip(names, values, strict=True))
                    rows += [{**out, **{k: row[k] for k in keys}} for out in f(row)]
                yield pd.DataFrame(rows, columns=node.schema.names)

        return df.mapInPandas(work, T.StructType([T.StructField(a.name, a.kind.spark) for a in (*node.schema.keys, *node.schema.vals)]))
    made = function.f(_row(old))
    keys = [F.col(f"`{k}`") for k in old.key_names]
    if isinstance(made, Column):
        return df.select(*keys, F.inline(made))
    made = list(made)
    if len(made) == 1:
        return df.select(*keys, *[made[0][n].alias(n) for n in new.names])
    structs = [F.struct(*[m[a.name].cast(a.kind.spark).alias(a.name) for a in (*new.keys, *new.vals)]) for m in made]
    return df.select(*keys, F.inline(F.array(*structs)))


#: Rows, as a power of two, of the parts in which groups are summed whose values an addition gathers.
PART_BITS = 12


def _aggregate(df: DataFrame, schema: Schema, plus: dict) -> DataFrame:
    keys = [F.col(f"`{k}`") for k in schema.key_names]
    if any(plus[v.name].gathers for v in schema.vals):
        part = F.shiftright(F.monotonically_increasing_id(), PART_BITS)
        sums = [plus[v.name].aggregate(F.col(f"`{v.name}`")).cast(v.kind.spark).alias(v.name) for v in schema.vals]
        df = df.withColumn("__part", part).groupBy(*keys, "__part").agg(*sums).drop("__part")
    sums = [plus[v.name].aggregate(F.col(f"`{v.name}`")).cast(v.kind.spark).alias(v.name) for v in schema.vals]
    if not sums:
        return df.select(*keys).distinct()
    if keys:
        return df.groupBy(*keys).agg(*sums)
    # grouped by a constant: no rows of no rows
    return df.groupBy(F.lit(1).alias("__all")).agg(*sums).drop("__all")


def _padded(df: DataFrame, of: Schema, schema: Schema) -> DataFrame:
    have = set(of.val_names)
    vals = [F.col(f"`{v.name}`").cast(v.kind.spark).alias(v.name) if v.name in have else v.default_column().alias(v.name) for v in schema.vals]
    return df.select(*[F.col(f"`{k}`") for k in schema.key_names], *vals)


def _one_row(node: N.Node) -> bool:
    """Whether the plan gives at most one row, as an aggregation without keys does."""
    while isinstance(node, (N.Rename, N.Sort, N.Where, N.Distinct)):
        node = node.input
    return isinstance(node, N.Aggregate) and not node.keys


def _join(node: N.Join, left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = node.left.schema, node.right.schema
    right = right.select([F.col(f"`{n}`").alias(f"__r_{n}") for n in b.names])
    l, r = (lambda n: F.col(f"`{n}`")), (lambda n: F.col(f"`__r_{n}`"))
    common = [k for k in a.keys if k.name in b.key_names]
    on = [l(k.name).eqNullSafe(r(k.name)) if k.kind.nullable else l(k.name) == r(k.name) for k in common]
    if on:
        joined = left.join(right, reduce(lambda x, y: x & y, on), "inner")
    else:
        joined = (F.broadcast(left) if _one_row(node.left) else left).crossJoin(F.broadcast(right) if _one_row(node.right) else right)
    keys = [l(k.name) if k.name in a.key_names else r(k.name).alias(k.name) for k in node.schema.keys]
    vals = [node.times[v.name].times(l(v.name), r(v.name)).cast(v.kind.spark).alias(v.name) for v in node.schema.vals]
    out = joined.select(*keys, *vals)
    if node.symmetric:
        out = out.where(F.col(f"`{node.symmetric[0]}`") <= F.col(f"`{node.symmetric[1]}`"))
    return out


def lower(plan: N.Node, done: dict[int, DataFrame] | None = None) -> DataFrame:
    """The plan as a DataFrame with the columns of its schema, keys first; of a Store, what it would write."""
    done = {} if done is None else done

    def go(node: N.Node) -> DataFrame:
        if id(node) not in done:
            done[id(node)] = one(node)
        return done[id(node)]

    def one(node: N.Node) -> DataFrame:
        match node:
            case N.Frame():
                return _in_schema(node.df, node.schema)
            case N.Data():
                return SparkSession.active().createDataFrame(list(node.rows), T.StructType([T.StructField(a.name, a.kind.spark, True) for a in (*node.schema.keys, *node.schema.vals)]))
            case N.Load():
                raise SchemaError(f"{node.table} is not bound to a table")
            case N.Extend():
                return _in_schema(_extend(node, go(node.input)), node.schema)
            case N.Union():
                both = [_padded(go(x), x.schema, node.schema) for x in (node.left, node.right)]
                return _aggregate(both[0].unionByName(both[1]), node.schema, node.plus)
            case N.Aggregate():
                return _aggregate(go(node.input), node.schema, node.plus)
            case N.Join():
                return _join(node, go(node.left), go(node.right))
            case N.Rename():
                old = node.input.schema
                return go(node.input).select([F.col(f"`{n}`").alias(node.names.get(n, n)) for n in old.names])
            case N.Sort():
                return go(node.input).select([F.col(f"`{n}`") for n in node.schema.names])
            case N.Where():
                return go(node.input).where(node.predicate(_row(node.schema)))
            case N.Distinct():
                return go(node.input).dropDuplicates(node.schema.key_names)
            case N.Store():
                return go(node.input)
        raise TypeError(node)

    return go(plan)


def run(plan: N.Node) -> DataFrame:
    """Carry out the plan: a Store writes its table, which is the result; other plans only give their DataFrame."""
    df = lower(plan)
    if not isinstance(plan, N.Store):
        return df
    df.write.mode("overwrite").saveAsTable(plan.table)
    return SparkSession.active().table(plan.table)


def ordered(plan: N.Node) -> DataFrame:
    """The result in the order of its keys, nulls first."""
    return lower(plan).orderBy([F.col(f"`{k}`").asc_nulls_first() for k in plan.schema.key_names])
