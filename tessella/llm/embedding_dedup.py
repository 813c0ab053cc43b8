"""Near-duplicate embeddings by cross-polytope hashing.

A vector is padded to a power of two, and turned three times by random signs and the fast Hadamard transform; its
hash is the signed axis nearest to the turned vector. Several such hashes make the bucket of one table. Besides
its own bucket a vector enters the buckets next best for it (multiprobe). All pairs that meet in a bucket are
compared by components rounded to 8 bits, with the error of rounding allowed for, which joins vectors into candidate
groups. All pairs of a group are verified once by their cosine in double precision, so that no false link is returned
and a link is missed only if nothing at all joins its two sides.

Equal vectors are joined first and carried as one weighted item; large buckets are compared whole, a pair of blocks
at a time, see bucketjoin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucketjoin import Matches, compare, distinct_buckets, fixed, joined_groups
from .common import materialize, one_row_per_id

#: Least tables, probes of a vector in each besides its own bucket, and hashes that make a bucket.
TABLES, PROBES, HASHES = 12, 2, 2
#: Vectors that a bucket should hold on average at most; more vectors take more hashes to a bucket.
BUCKET = 32
#: Share of the pairs at the threshold that meet in a bucket; tables are added for it where buckets take more hashes.
RECALL = 0.999


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row by the fast algorithm; the row length is a power of two."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_ids(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES, seed: int = 7) -> np.ndarray:
    """(vectors, tables * (1 + probes)) bucket ids of unit vectors: of each table the own bucket and the next best."""
    n, dim = vectors.shape
    width = max(2, 1 << max(0, dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        best = np.zeros((n, hashes, 2), np.int64)
        lost = np.zeros((n, hashes))
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            both = np.concatenate([y, -y], axis=1)
            two = np.argpartition(-both, 1, axis=1)[:, :2]
            value = np.take_along_axis(both, two, axis=1)
            swap = value[:, 0] < value[:, 1]
            two[swap] = two[swap][:, ::-1]
            best[:, k] = two
            lost[:, k] = np.abs(value[:, 0] - value[:, 1])
        code = lambda picks: ((t + 1) * (2 * width + 1) ** hashes + sum(picks[:, k] * (2 * width) ** k for k in range(hashes)))  # noqa: B023,E731
        out[:, t, 0] = code(best[:, :, 0])
        order = np.argsort(lost, axis=1, kind="stable")
        for p in range(probes):
            picks = best[:, :, 0].copy()
            k = order[:, min(p, hashes - 1)]
            picks[np.arange(n), k] = best[np.arange(n), k, 1]
            out[:, t, 1 + p] = code(picks)
    return out.reshape(n, -1)


def tables_needed(dim: int, threshold: float, hashes: int, probes: int = PROBES, recall: float = RECALL) -> int:
    """Tables, TABLES at least, in which a pair at the threshold meets with probability recall, from the share of tables in which random pairs meet."""
    rng = np.random.default_rng(3)
    length = lambda v: np.sqrt((v * v).sum(axis=1, keepdims=True))
    a, r = rng.normal(size=(2, 400, max(2, dim)))
    a /= length(a)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * r / length(r)
    x, y = (bucket_ids(v, TABLES, probes, hashes).reshape(len(v), TABLES, 1 + probes) for v in (a, b))
    share = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean()
    share = min(max(share, 1 / x[:, :, 0].size), 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _valid(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Rows whose vector is not null, empty or zero and has only finite components, and their components as double precision bytes."""
    rows, data = [], []
    for i, x in enumerate(batch.column(1)):
        if not x.is_valid or x.values.null_count or not len(x.values):
            continue
        v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0.0 becomes 0.0
        if np.isfinite(v).all() and v.any():
            rows.append(i)
            data.append(v.tobytes())
    return np.array(rows, np.int64), data


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, data = _valid(batch)
        yield pa.record_batch([batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array(data, pa.binary())], names=["id", "data"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(matches: Matches) -> Matches:
    """matches for values of equal length, applied to values of any length; those of different lengths do not match."""

    def of_any(left: pa.Array, right: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        sizes = [np.asarray(pc.binary_length(x)) for x in (left, left if right is None else right)]
        if all((s == sizes[0][0]).all() for s in sizes):
            return matches(left, right)
        found = []
        for size in np.intersect1d(*sizes):
            i, j = (np.flatnonzero(s == size) for s in sizes)
            a, b = matches(left.take(pa.array(i)), None if right is None else right.take(pa.array(j)))
            found.append((i[a], j[b]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    return of_any


def cosine_matches(threshold: float) -> Matches:
    def matches(left: pa.Array, right: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        a = unit(fixed(left, "<f8"))
        linked = a @ (a if right is None else unit(fixed(right, "<f8"))).T >= threshold
        return np.nonzero(np.triu(linked, 1) if right is None else linked)

    return _by_size(matches)


def rounded(x: np.ndarray) -> list[bytes]:
    """Unit vectors with components of 8 bits, after their unit and the length of what rounding took, as 32-bit floats."""
    step = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
    q = np.rint(x / step).astype(np.int8)
    error = np.sqrt(((x - q * step.astype(np.float64)) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
    return [r.tobytes() for r in np.concatenate([step.view(np.int8), error.view(np.int8), q], axis=1)]


def rounded_matches(threshold: float) -> Matches:
    """All pairs at the threshold and those that rounding cannot tell from them."""

    def read(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = fixed(data, "i1")
        head = np.ascontiguousarray(x[:, :8]).view(np.float32)
        return x[:, 8:] * head[:, :1], head[:, 1]

    def matches(left: pa.Array, right: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        a, ea = read(left)
        b, eb = (a, ea) if right is None else read(right)
        linked = a @ b.T + ea[:, None] * (1 + eb) + eb >= threshold - 1e-4
        return np.nonzero(np.triu(linked, 1) if right is None else linked)

    return _by_size(matches)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int | None = None, probes: int = PROBES, hashes: int | None = None) -> DataFrame:
    """One row per row of table: (id, n_links, component_id, kept).

    n_links: other vectors linked directly (cosine >= threshold in double precision), equal vectors included;
    component_id: the smallest id that links reach; kept: it is the own id. A vector that is null, empty or zero,
    or holds a null or non-finite component links with nothing. Vectors of different lengths do not link. Rows that
    repeat an id count as one, with the smallest of their vectors, and get equal results; a row with a null id links
    with nothing and is kept. Ties need no rule. Other columns are not looked at. An empty table gives no rows.
    hashes: None for HASHES, or as many as the number of vectors asks for. tables: None for as many as tables_needed
    says.
    """
    every = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    present = every.where("id IS NOT NULL")
    named = one_row_per_id(present, "id", "vector")
    valid = materialize(named.mapInArrow(_read, "id long, data binary").withColumn("key", F.sha2("data", 256)), "vectors")
    items = materialize(valid.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "items")
    # the key is a digest of the vector, so the data of any row with the smallest id of a key are the item's
    payload = materialize(valid.join(items.select(F.col("rep").alias("id"), "weight"), "id").select("id", "weight", "data"), "payload")

    size = payload.agg(F.count("*").alias("n"), F.max(F.length("data")).alias("size")).first()
    dim = (size["size"] or 8) // 8
    if hashes is None:
        axes = 2 * max(2, 1 << max(0, dim - 1).bit_length())
        hashes = max(HASHES, math.ceil(math.log(max(1, size["n"] / BUCKET)) / math.log(axes)))
    if tables is None:
        tables = tables_needed(dim, threshold, hashes, probes)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column("id").to_numpy(), batch.column("data")
            sizes = np.asarray(pc.binary_length(data))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), 2048):
                    some = at[lo : lo + 2048]
                    codes = bucket_ids(unit(fixed(data.take(pa.array(some)), "<f8")), tables, probes, hashes) * 8191 + int(size) // 8
                    codes.sort(axis=1)
                    new = np.ones(codes.shape, bool)
                    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    yield pa.record_batch([pa.array(codes[new]), pa.array(np.repeat(ids[some], new.sum(axis=1)))], names=["bucket", "id"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data")
            sizes = np.asarray(pc.binary_length(data))
            out = np.empty(len(sizes), object)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                out[at] = rounded(unit(fixed(data.take(pa.array(at)), "<f8")))
            yield pa.record_batch([batch.column("id"), pa.array(out.tolist(), pa.binary())], names=["id", "data"])

    met = distinct_buckets(materialize(payload.select("id", "data").mapInArrow(buckets, "bucket long, id long"), "entries"))
    groups = joined_groups(met, materialize(payload.select("id", "data").mapInArrow(small, "id long, data binary"), "rounded"), rounded_matches(threshold))
    links, labels = compare(groups, payload, cosine_matches(threshold))
    classes = items.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(
        classes.select("key", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "classes"
    )
    none = F.lit(0).cast("long").alias("n_links")
    out = valid.select("id", "key").join(classes, "key").select("id", "n_links", "component_id")
    out = out.union(named.select("id").join(valid.select("id"), "id", "left_anti").select("id", none, F.col("id").alias("component_id")))
    if named is not present:
        out = present.select("id").join(materialize(out, "results"), "id")
    out = out.union(every.where("id IS NULL").select("id", none, F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
