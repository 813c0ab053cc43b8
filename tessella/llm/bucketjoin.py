"""Brute-force verification inside buckets of candidate items, shared by the similarity joins.

Buckets hold similar items found by hashing. Units of work are blocks of a bucket and pairs of blocks, cut by item
hash and of bounded size, so that no task ever holds a whole bucket. What leaves a unit is linear in its items: a
number of links per item, and links that span the components inside the unit. Items that are known to be connected
carry a label; a unit then gives at most one link between two labels, so that the links between the blocks of one
large component number as many as pairs of blocks, whatever the blocks hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize, trim
from .components import connected_components

#: Items of a block in which candidates are sought: NEAR, or up to NEAR_MAX where blocks of a large bucket meet in pairs.
NEAR, NEAR_MAX = 64, 512
#: Items and bytes of a block of a group whose pairs are all verified; a single item may be larger.
BLOCK, BLOCK_BYTES = 2048, 24_000_000
FOUND = "u long, v long, links long"
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

#: Index arrays of the linked pairs of two blocks of payload; right None: pairs within left, i < j.
Matches = Callable[[pa.Array, pa.Array | None], tuple[np.ndarray, np.ndarray]]


def fixed(data: pa.Array, kind: str) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    size = len(data[0].as_py())
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(data), size).view(kind)


def distinct_buckets(members: DataFrame) -> DataFrame:
    """members(bucket, id) without buckets of one item, and one only of buckets with the same items; adds n."""
    sized = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("m")).where("n > 1")
    kept = materialize(sized.groupBy("n", "x", "m").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    return materialize(members.join(kept, "bucket"), "members")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (bucket, a, b) at a time, two or more, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    key = None

    def whole() -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("bucket", "a", "b")]
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
            now = tuple(c[lo] for c in cols)
            if held and now != key:
                yield from whole()
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    yield from whole()


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest node that the links i, j reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(rows: DataFrame, matches: Matches, count: bool, span: bool) -> DataFrame:
    """(u, null, links): links of item u, weights counted; (u, v, null): links of labels that span what is connected.

    rows(bucket, a, b, own, id, label, weight, data): a unit is a bucket's blocks a and b, own is the row's block.
    """
    rows = rows.select("bucket", "a", "b", "own", "id", "label", "weight", "data")
    rows = rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            item, links, u, v = (np.concatenate(c) for c in zip(*held, strict=True))
            n, m = len(item), len(u)
            columns = [
                pa.array(np.concatenate([item, u])),
                pa.array(np.concatenate([np.zeros(n, np.int64), v]), mask=np.arange(n + m) < n),
                pa.array(np.concatenate([links, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
            ]
            return pa.record_batch(columns, schema=_FOUND)

        none = np.zeros(0, np.int64)
        for unit in _units(batches):
            a, b = unit.column("a")[0].as_py(), unit.column("b")[0].as_py()
            data = unit.column("data")
            ids, label, weight = (unit.column(c).to_numpy() for c in ("id", "label", "weight"))
            if a == b:
                i, j = matches(data, None)
            else:
                first = unit.column("own").to_numpy() == a
                order = np.argsort(~first, kind="stable")
                left = int(first.sum())
                if left in (0, len(ids)):
                    continue
                data, ids, label, weight = data.take(pa.array(order)), ids[order], label[order], weight[order]
                i, j = matches(data[:left], data[left:])
                j = j + left
            if not len(i):
                continue
            found = [none] * 4
            if count:
                links = (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
                some = np.flatnonzero(links)
                found[:2] = ids[some], links[some]
            if span:
                names, at = np.unique(label, return_inverse=True)
                low = _lowest(len(names), at[i], at[j])
                moved = np.flatnonzero(low != np.arange(len(names)))
                found[2:] = names[low[moved]], names[moved]
            held.append(tuple(found))
            if len(held) >= 2048:
                yield out()
                held = []
        if held:
            yield out()
        trim()

    return rows.mapInArrow(work, FOUND)


def _pairs_of_blocks(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows once for each block from first to last, as units of the own block (column own) with that one."""
    rows = rows.withColumn("other", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, component) after links(u, v) of components; a node without a label is its own component."""
    links = materialize(links.where("v IS NOT NULL").select("u", "v").distinct(), "between")
    if not links.limit(1).count():
        return labels
    top = connected_components(links)
    alone = top.select("node").join(labels.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    nodes = labels.select("node", "component").union(alone.select("node", F.col("node").alias("component")))
    moved = nodes.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return materialize(moved.select("node", F.coalesce("top", "component").alias("component")), "labels")


def joined_groups(members: DataFrame, payload: DataFrame, matches: Matches) -> DataFrame:
    """(bucket, id): what the matches of all pairs of all buckets connect, a bucket for each connected group.

    members(bucket, id, n) as distinct_buckets gives them; payload(id, data binary), a row per item. Each item is
    first compared in one bucket, the largest that holds it, and in one block of it: that joins most near copies, at
    a cost linear in items. Then every bucket that still holds items of different groups is compared whole, a pair of
    blocks at a time, but for pairs that are joined already: the items of a large bucket's most common group are only
    compared with the others.
    """
    weighed = payload.withColumn("weight", F.lit(1).cast("long"))
    largest = members.groupBy("id").agg(F.max(F.struct("n", "bucket")).alias("x")).select("id", "x.bucket", "x.n")
    units = largest.withColumn("own", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / NEAR))).select("id", "bucket", "own", F.col("own").alias("a"), F.col("own").alias("b"), F.col("id").alias("label"))
    labels = connected_components(_compared(units.join(weighed, "id"), matches, count=False, span=True))

    named = members.join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("bucket", "id", "n", F.coalesce("component", "id").alias("label")), "labelled")
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("top"), F.first("n").alias("n")).where("top.m < n")
    small = F.col("n") <= NEAR
    blocks = lambda n: F.ceil(n / NEAR_MAX)
    mixed = mixed.select("bucket", F.when(~small, F.col("top.label")).alias("core"), F.when(small, 0).otherwise(blocks(F.col("top.m"))).alias("nc"), F.when(small, 1).otherwise(blocks(F.col("n") - F.col("top.m"))).alias("nr"))
    rows = named.join(materialize(mixed, "mixed"), "bucket").withColumn("is_core", F.col("label").eqNullSafe(F.col("core")))
    # blocks 0 to nc - 1 hold the most common group, the nr after them the others
    own = F.pmod(F.xxhash64("id", F.lit(17)), F.when(F.col("is_core"), F.col("nc")).otherwise(F.col("nr"))) + F.when(F.col("is_core"), 0).otherwise(F.col("nc"))
    rows = rows.withColumn("own", own).select("bucket", "id", "label", "own", "is_core", "nc", "nr")
    units = _pairs_of_blocks(rows, F.when(F.col("is_core"), F.col("nc")).otherwise(F.lit(0)), F.col("nc") + F.col("nr") - 1)
    more = _compared(units.join(weighed, "id"), matches, count=False, span=True)
    return materialize(_merged(labels, more).select(F.col("component").alias("bucket"), F.col("node").alias("id")), "groups")


def compare(groups: DataFrame, payload: DataFrame, matches: Matches, span: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(id, links) and (node, component): the matches of all pairs of each group, weights counted, and what they connect.

    groups(bucket, id), an item in one group only; payload(id, weight, data binary), a row per item. Blocks are first
    compared within themselves, and then each pair of blocks of a group. span False: no components are wanted.
    """
    rows = materialize(groups.select("bucket", "id").join(payload, "id"), "payload")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("data")) / BLOCK_BYTES))
    large = materialize(rows.groupBy("bucket").agg(blocks.alias("nb")).where("nb > 1"), "large")
    rows = join_small(rows, large, "bucket", "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("id", F.lit(17)), F.col("nb")))
    within = rows.withColumn("a", F.col("own")).withColumn("b", F.col("own")).withColumn("label", F.col("id"))
    found = materialize(_compared(within, matches, count=True, span=span), "within")
    labels = connected_components(found.where("v IS NOT NULL").select("u", "v")) if span else None
    links = found.where("links IS NOT NULL").select("u", "links")
    if large.limit(1).count():
        across = rows.where("nb > 1")
        if span:
            across = across.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        else:
            across = across.withColumn("label", F.col("id"))
        across = _pairs_of_blocks(across, F.lit(0), F.col("nb") - 1).where("a < b")
        more = materialize(_compared(across, matches, count=True, span=span), "across")
        links = links.union(more.where("links IS NOT NULL").select("u", "links"))
        labels = _merged(labels, more) if span else None
    return links.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links")), labels
