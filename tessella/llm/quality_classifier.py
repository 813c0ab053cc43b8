"""Quality classifier by importance resampling.

Two bag models of hashed n-grams (words and runs of symbols, and pairs of neighbours) are fitted: one on target
text, documents labelled as good, and one on the raw text, all documents. The sum of the log ratios of a document's
n-grams under the two is the log of its importance weight. With Gumbel noise added it is the document's key, and the
k largest keys are kept: a sample of k documents without replacement by importance weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize, sliced
from .texthash import chunks, mix, word_hashes

#: Hash buckets of single tokens, and as many of pairs, the last for a token that follows itself.
BUCKETS = 1 << 13
#: Labelled documents used; pseudo-counts per bucket.
LABELLED, SMOOTHING = 20_000, 10.0
#: Keys that the last step of the top-k selection may read at once.
LAST = 1024


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket) of every n-gram of the texts."""
    tokens, offsets = word_hashes(texts, symbols=True)
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), count)
    second = np.ones(len(tokens), bool)
    second[offsets[:-1][count > 0]] = False
    at = np.flatnonzero(second)
    with np.errstate(over="ignore"):
        pair = BUCKETS + (mix(tokens[at - 1] * np.uint64(3) + tokens[at]) % np.uint64(BUCKETS - 1)).astype(np.int64)
    pair[tokens[at] == tokens[at - 1]] = 2 * BUCKETS - 1
    return np.concatenate([doc, doc[at]]), np.concatenate([(tokens % np.uint64(BUCKETS)).astype(np.int64), pair])


def _count(batches: Iterator[pa.RecordBatch], target: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets in all documents and in those with the ids in target, once per task."""
    raw, good = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in sliced(batches):
        ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for first, part in chunks(batch.column(1).to_pylist()):
            doc, bucket = features(part)
            raw += np.bincount(bucket, minlength=2 * BUCKETS)
            chosen = np.isin(ids[first : first + len(part)], target) & named[first : first + len(part)]
            if chosen.any():
                good += np.bincount(bucket[chosen[doc]], minlength=2 * BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "target"])


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise, a function of id and seed."""
    with np.errstate(over="ignore"):
        u = ((mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    return -np.log(-np.log(u))


def log_weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of every bucket from its counts in the raw and the target text; 0 without target text."""
    prior = SMOOTHING * len(raw) * raw / max(raw.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.log((target + prior) / (target.sum() + prior.sum())) - np.log(raw / raw.sum())
    return np.where(np.isfinite(weight), weight, 0.0) if target.any() else np.zeros(len(raw))


def _scores(batches: Iterator[pa.RecordBatch], weight: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
        score = np.zeros(batch.num_rows)
        for first, part in chunks(batch.column(1).to_pylist()):
            doc, bucket = features(part)
            score[first : first + len(part)] = np.bincount(doc, weight[bucket], len(part))
        yield pa.record_batch([batch.column(0), pa.array(score), pa.array(score + gumbel(ids, seed))], names=["id", "log_weight", "key"])


def key_of_rank(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column key, by histograms that narrow down on it; k from 1 to the rows of keys."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    above = 0  # rows with keys over hi
    while n > LAST and lo < hi:
        bins = 4096
        at = F.least(F.floor((F.col("key") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        inside = keys.where(F.col("key").between(lo, hi))
        rows = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in rows:
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    if lo == hi:
        return lo
    rows = keys.where(F.col("key").between(lo, hi)).orderBy(F.desc("key")).limit(LAST).collect()
    return rows[k - above - 1]["key"]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", budget: int | None = None, seed: int = 11) -> DataFrame:
    """(id, log_weight, key, kept) of every row of docs.

    labels(id, quality 0 or 1): the target text is that of documents with quality 1 among the LABELLED rows with the
    smallest hashes of their ids; rows with a null do not count, and of several labels of an id the smallest does.
    budget: k, the rows to keep; None for as many as have an importance weight of 1 or more (their text is at least as
    likely under the target model as under the raw one), or for the share that is good among the labelled rows, if
    that is more. Without target text all weights are 1 and all is kept. A null, empty or blank text has no n-grams and a weight of 1; texts of any length are taken whole. Rows
    that repeat an id are scored each on its own with equal noise, rows with a null id with that of -1. Documents with
    equal keys at the cut are all kept. Other columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).dropna()
    named = named.groupBy("id").agg(F.min("good").alias("good"))
    labelled = named.orderBy(F.xxhash64("id"), "id").limit(LABELLED).collect()
    target = np.array([r["id"] for r in labelled if r["good"] == 1], np.int64)

    counts = rows.mapInArrow(lambda it: _count(it, target), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, good = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for r in counts.collect():  # as many rows as buckets at most
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["target"]
    weight = log_weights(raw, good)
    scored = materialize(rows.mapInArrow(lambda it: _scores(it, weight, seed), "id long, log_weight double, key double"), "scores")
    n, heavy = scored.agg(F.count("*"), F.count_if(F.col("log_weight") >= 0)).first()
    expected = -(-n * len(target) // max(1, len(labelled)))
    k = min(n, max(heavy, expected) if budget is None else budget)
    cut = -np.inf if k == n else key_of_rank(scored, k) if k else np.inf
    return scored.withColumn("kept", F.col("key") >= F.lit(float(cut))).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that the classifier rejects; rows with a null id stay, rows that repeat an id go if one of them is rejected. Columns as they were."""
    verdict = classify(docs, labels, id_col, text_col, **options)
    rejected = materialize(verdict.where("NOT kept").select(id_col), "rejected")
    return join_small(docs, rejected, id_col, "left_anti").select(*docs.columns)
