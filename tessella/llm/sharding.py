"""Minimax contiguous sharding with DataFrame operations only.

Rows are put in the order of a 64-bit hash of their text, so that equal texts are neighbours. The atomic groups are
the UNITS ranges of that hash: a unit holds all rows of its texts and is never cut. The smallest capacity with
which a greedy walk over the ordered unit sizes needs no more than the given shards is found by binary search, and
the walk with it gives the cuts. A row's slot is its place in the shard's order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Units, a fixed number: their sizes are what the driver reads, and what is broadcast has at most twice as many rows.
UNITS = 1 << 16


def cuts_at(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of the greedy contiguous parts of at most capacity each, None if they are more than shards."""
    total = np.cumsum(sizes)
    ends, done = [], 0
    while done < len(sizes):
        if len(ends) == shards:
            return None
        end = int(np.searchsorted(total, (total[done - 1] if done else 0) + capacity, "right"))
        if end == done:
            return None
        ends.append(end)
        done = end
    return ends


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which cuts_at finds enough room; 0 without sizes."""
    if not len(sizes):
        return 0
    lo, hi = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if cuts_at(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), a row per row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1; the law is "bytes": shard sizes near equal, as far as equal
    texts, which share a shard, allow. Null and empty texts count as equal; texts of any length are taken whole. slot
    counts from 0 in each shard without gaps; a unit of many rows is numbered in cells, in which rows are in the order
    of ids. Ids may repeat or be null, also in all rows: the cells do not depend on them. An empty table gives no rows.
    Other columns are not looked at.
    """
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(units)).cast("int").alias("unit"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(base, "digests")
    sized = materialize(base.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "units")
    rows = sorted(sized.collect())  # at most as many rows as units
    sizes = np.array([r["bytes"] for r in rows], np.int64)
    ends = cuts_at(sizes, smallest_capacity(sizes, shards), shards) or []
    number = F.lit(0)
    for k, end in enumerate(ends[:-1]):
        number = F.when(F.col("unit") >= rows[end]["unit"], k + 1).otherwise(number)
    # a unit with many rows is numbered in cells, so that copies of one text do not meet in one task, whatever their ids
    per_cell = max(1, -(-sum(r["n"] for r in rows) // units))
    cells_of = sized.select("unit", F.ceil(F.col("n") / per_cell).alias("cells"))
    celled = base.join(F.broadcast(cells_of), "unit").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells"))).drop("cells")
    counts = celled.groupBy("unit", "cell").agg(F.count("*").alias("n")).withColumn("shard", number.cast("int"))
    before = Window.partitionBy("shard").orderBy("unit", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("unit", "cell", "shard", "start"), "starts")
    place = F.row_number().over(Window.partitionBy("unit", "cell").orderBy("id", "row")) - 1
    placed = celled.withColumn("place", place).join(F.broadcast(starts), ["unit", "cell"])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
