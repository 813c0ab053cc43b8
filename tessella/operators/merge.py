"""Alignment of several tables on common keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(tables: list[DataFrame], keys: list[str], emit_no_matches: Iterable[int] = ()) -> DataFrame:
    """Natural join of tables on keys (null keys match); other columns must differ in name.

    Rows of the tables numbered in emit_no_matches also come without a match in the others, as in an outer join.
    Without keys: the Cartesian product.
    """
    if not keys:
        return reduce(lambda x, y: x.crossJoin(y), tables)
    alone = set(emit_no_matches)

    def step(left: DataFrame, numbered: tuple[int, DataFrame]) -> DataFrame:
        n, right = numbered
        right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
        how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[bool(alone & set(range(n))), n in alone]
        joined = left.join(right, on, how)
        own = [F.coalesce(k, f"__r_{k}").alias(k) if how != "inner" else F.col(k) for k in keys]
        return joined.select(*own, *[c for c in left.columns if c not in keys], *[c for c in right.columns if not c.startswith("__r_")])

    if len(alone) in (0, len(tables)) or len(tables) == 2:
        return reduce(step, list(enumerate(tables))[1:], tables[0])
    # rows of some tables: a full alignment, then only what has all tables or one of those
    marked = [t.withColumn(f"__in{i}", F.lit(True)) for i, t in enumerate(tables)]
    full = merge(marked, keys, range(len(tables)))
    here = [F.coalesce(f"__in{i}", F.lit(False)) for i in range(len(tables))]
    wanted = reduce(lambda x, y: x & y, here) | reduce(lambda x, y: x | y, [here[i] for i in sorted(alone)])
    return full.where(wanted).drop(*[f"__in{i}" for i in range(len(tables))])


def align(tables: list[DataFrame], on: str = "row", ranges=None, families: Iterable[str] | None = None) -> DataFrame:
    """Cells (row, family, qualifier, value) of several tables aligned on "row", "row+qualifier" or "all" three keys.

    The values are value_0, value_1, ...; ranges filters rows, families keeps only cells of these families.
    """
    keys = {"row": ["row"], "row+qualifier": ["row", "qualifier"], "all": ["row", "family", "qualifier"]}[on]
    rest = [c for c in ("family", "qualifier") if c not in keys]
    ready = []
    for i, t in enumerate(tables):
        if ranges is not None:
            t = t.where(ranges.column(F.col("row")))
        if families is not None:
            t = t.where(F.col("family").isin(list(families)))
        ready.append(t.select(*keys, *[F.col(c).alias(f"{c}_{i}") for c in rest], F.col("value").alias(f"value_{i}")))
    return merge(ready, keys)
