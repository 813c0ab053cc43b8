"""N-gram Jaccard join of texts by chosen paths.

Every text is the set of its n-word shingles. A run of the join sends each set down a path: at every node the
path draws coordinates of the sets' minhashes (a minhash is a token that sets of Jaccard similarity s share with
probability s) and splits the node's sets by the token drawn, until a bucket is small enough to compare all its
pairs. Runs are repeated until a pair at the threshold is missed with a probability below 1 - recall.

Buckets are compared by minhashes, all pairs of each, which joins their items into candidate groups. All pairs of a
group are then verified once on the whole shingle sets, so no false link is returned, and links between any items of
a group are found. Texts with the same words in the same order are joined first and carried as one weighted item.
Large groups (of near copies) are compared in blocks, see bucketjoin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucketjoin import Matches, compare, distinct_buckets, fixed, joined_groups
from .common import join_small, materialize, one_row_per_id, sliced
from .texthash import chunks, mix, sequence_keys, shingles, word_hashes

#: Minhashes of a text: what paths draw from.
COORDINATES = 48
#: Share of equal minhashes that makes a pair a candidate; at a similarity of 0.8 it is missed by more than 5 standard deviations.
CANDIDATE = 0.5
#: Times in 4 that a node draws a second coordinate: 1.25 a node, the inverse of the threshold 0.8.
SECOND = 1


def repetitions(threshold: float, recall: float, depth: int) -> int:
    """Runs until a pair at the threshold, which keeps to one path of depth nodes with probability threshold**depth, is found with probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _minhash_columns(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
    for batch in sliced(batches):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for first, part in chunks(texts):
            words, offsets = word_hashes(part)
            grams, at = shingles(words, offsets, n)
            keys = sequence_keys(words, offsets).view(np.int64)
            full = np.flatnonzero(np.diff(at))
            sig = np.zeros((len(part), COORDINATES), np.int32)
            if len(full):
                for k in range(COORDINATES):
                    with np.errstate(over="ignore"):
                        h = ((grams * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32)
                    sig[full, k] = np.minimum.reduceat(h, at[:-1][full]).view(np.int32)
            yield pa.record_batch(
                [
                    ids.slice(first, len(part)).cast(pa.int64()),
                    pa.array(np.diff(offsets)),
                    pa.array(keys[:, 0].copy()),
                    pa.array(keys[:, 1].copy()),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                names=["id", "n_words", "key1", "key2", "sig"],
            )


def _set_columns(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids = batch.column(0)
        for first, part in chunks(batch.column(1).to_pylist()):
            grams, at = shingles(*word_hashes(part), n)
            sets = [np.unique(grams[lo:hi]).tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([ids.slice(first, len(part)).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "data"])


def jaccard_matches(threshold: Fraction) -> Matches:
    """Pairs of shingle sets (bytes of sorted unique 64-bit hashes) whose Jaccard similarity is threshold or more, exactly."""
    p, q = threshold.numerator, threshold.denominator

    def matches(left: pa.Array, right: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in left.to_pylist() + (right.to_pylist() if right is not None else [])]
        sizes = np.array([len(x) for x in sets], np.int64)
        cut = len(left) if right is not None else len(sets)
        if len(sets) == 2:
            common = np.array([[len(np.intersect1d(sets[0], sets[1], assume_unique=True))]])
            a, b, tri = sizes[:1], sizes[1:], None
        else:
            _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            new = np.cumsum(df > 1) - 1
            often = df[token] > 1
            token, owner = new[token[often]], owner[often]
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            a, b = sizes[:cut], sizes[cut:] if right is not None else sizes
            common = np.zeros((len(a), len(b)), np.int64)
            for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
                here = slice(*np.searchsorted(token, [lo, lo + 4096]))
                x = np.zeros((len(sets), 4096), np.float32)
                x[owner[here], token[here] - lo] = 1
                common += (x[:cut] @ (x[cut:] if right is not None else x).T).astype(np.int64)
        linked = (p + q) * common >= p * (a[:, None] + b[None, :])
        linked &= (a[:, None] > 0) & (b[None, :] > 0)
        if right is None and len(sets) != 2:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        return (i, j + 1) if right is None and len(sets) == 2 else (i, j)

    return matches


def _minhash_matches(left: pa.Array, right: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    x = fixed(left, "<i4")
    y = x if right is None else fixed(right, "<i4")
    equal = np.zeros((len(x), len(y)), np.int8)
    for k in range(COORDINATES):
        equal += x[:, k, None] == y[None, :, k]
    near = equal >= CANDIDATE * COORDINATES
    return np.nonzero(np.triu(near, 1) if right is None else near)


def _drawn(path, level: int):
    """Coordinates that the node at path draws: one, and a second one SECOND times in 4."""
    pick = lambda salt: F.pmod(F.xxhash64(path, F.lit(level), F.lit(salt)), F.lit(COORDINATES)).cast("int")
    more = F.pmod(F.xxhash64(path, F.lit(level), F.lit(2)), F.lit(4)) < SECOND
    return F.when(more, F.array_distinct(F.array(pick(0), pick(1)))).otherwise(F.array(pick(0)))


def _step(df: DataFrame, level: int) -> DataFrame:
    """df(path, id, sig) one level down."""
    drawn = df.withColumn("c", F.explode(_drawn(F.col("path"), level)))
    return drawn.select(F.xxhash64("path", F.lit(level), "c", F.substring("sig", 4 * F.col("c") + 1, F.lit(4))).alias("path"), "id", "sig")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, limit: int = 64, max_depth: int = 3) -> DataFrame:
    """One row per row of docs: (id, class_id, n_links).

    class_id is the smallest id that links reach; n_links counts the other ids linked directly, copies included.
    Links: Jaccard similarity of the n-word shingle sets >= threshold. Words are lower-cased runs of letters,
    digits and "_"; a text of fewer than n words has one shingle of all its words; a null, empty or wordless text
    links with nothing, so that it is its own class. Texts of any length are taken whole. Rows that repeat an id count
    as one, with the smallest of their texts, and get equal results; a row with a null id has a null class and no
    links. Ties need no rule, the result does not depend on any order. Other columns of docs are not looked at. An
    empty table gives no rows.

    limit: buckets with more items are split further, down to max_depth nodes; those still larger (items that share
    all minhashes drawn) are compared whole, a pair of blocks at a time. recall: see repetitions.
    """
    exact = Fraction(threshold).limit_denominator(1000)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = every.where("id IS NOT NULL")
    source = one_row_per_id(named, "id", "text")
    sketch = materialize(
        source.mapInArrow(lambda it: _minhash_columns(it, n), "id long, n_words long, key1 long, key2 long, sig binary"), "sketch"
    )
    worded = sketch.where("n_words > 0")
    items = materialize(worded.groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "items")
    sigs = materialize(worded.join(items.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "sig"), "sigs")

    runs = F.sequence(F.lit(1), F.lit(repetitions(threshold, recall, max_depth)))
    level = _step(sigs.select(F.explode(runs).alias("path"), "id", "sig"), 0)
    final = []
    for depth in range(1, max_depth + 1):
        nodes = materialize(level.select(F.col("path").alias("bucket"), "id"), f"nodes{depth}")
        sized = nodes.groupBy("bucket").count()
        if depth == max_depth:
            final.append(nodes)
            break
        large = materialize(sized.where(F.col("count") > limit).select("bucket"), f"large{depth}")
        if not large.limit(1).count():
            final.append(nodes)
            break
        final.append(join_small(nodes, large, "bucket", "left_anti"))
        down = join_small(nodes, large, "bucket", "left_semi").join(sigs, "id")
        level = _step(down.select(F.col("bucket").alias("path"), "id", "sig"), depth)
    members = final[0]
    for more in final[1:]:
        members = members.union(more)
    groups = joined_groups(distinct_buckets(members), sigs.withColumnRenamed("sig", "data"), _minhash_matches)

    sets = join_small(source, groups.select("id"), "id", "left_semi").mapInArrow(lambda it: _set_columns(it, n), "id long, data binary")
    links, labels = compare(groups, sets.join(items.select(F.col("rep").alias("id"), "weight"), "id"), jaccard_matches(exact))
    classes = items.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(
        classes.select("key1", "key2", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "classes"
    )
    none = F.lit(0).cast("long").alias("n_links")
    lone = sketch.where("n_words = 0").select("id", F.col("id").alias("class_id"), none)
    out = worded.select("id", "key1", "key2").join(classes, ["key1", "key2"]).select("id", "class_id", "n_links").union(lone)
    if source is not named:
        out = named.select("id").join(materialize(out, "results"), "id")
    return out.union(every.where("id IS NULL").select("id", F.col("id").alias("class_id"), none)).withColumnRenamed("id", id_col)


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that are not the smallest id of their class; rows with a null id stay, and rows that repeat an id stay or go together. Columns as they were."""
    classes = jaccard_join(docs, id_col, text_col, **options)
    later = materialize(classes.where(F.col("class_id") != F.col(id_col)).select(id_col), "later")
    return join_small(docs, later, id_col, "left_anti").select(*docs.columns)


