"""Token counts of texts by a two-tier lookup on the map side.

The first tier is a compact table of the token counts of frequent pre-tokens, broadcast to all workers. A pre-token
is a maximal run without white space, which no token of the vocabularies in question crosses. What the table lacks
is encoded, a batch of distinct ones at a time, and kept in the worker's cache, the second tier. No pre-token is
ever shuffled, and no document leaves its task.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BATCH_WORDS, Cache, WordBpe, batches, load
from .common import sliced

#: The table holds so many pre-tokens of so many characters at most: 5 MB or less. It only saves work: what is not
#: in it is encoded, so it is filled from about SAMPLE_ROWS rows of the whole table, drawn by a hash, at most
#: SAMPLE_LIMIT of them, each cut to SAMPLE_CHARS for this alone.
TABLE_ROWS, TABLE_CHARS, SAMPLE_ROWS, SAMPLE_LIMIT, SAMPLE_CHARS = 65_536, 64, 2_048, 4_096, 20_000
#: Counts of further pre-tokens that a worker keeps, twice (a young and an old generation).
KEPT = 100_000


class FrequentLengths:
    """Pre-tokens as one string, their token counts as 16-bit integers; a dict in each worker."""

    def __init__(self, lengths: dict[str, int]):
        self.keys, self.values = "\n".join(lengths), np.array(list(lengths.values()), "<u2").tobytes()

    def table(self) -> dict[str, int]:
        return dict(zip(self.keys.split("\n"), np.frombuffer(self.values, "<u2").tolist(), strict=True)) if self.values else {}


def frequent_lengths(docs: DataFrame, bpe: WordBpe, text_col: str) -> FrequentLengths:
    seen: Counter[str] = Counter()
    share = max(1, docs.count() // SAMPLE_ROWS)
    drawn = docs.where(F.pmod(F.xxhash64("id", F.length(text_col)), F.lit(share)) == 0)
    for (text,) in drawn.select(F.substring(text_col, 1, SAMPLE_CHARS)).limit(SAMPLE_LIMIT).collect():
        seen.update(c for c in bpe.split(text or "") if len(c) <= TABLE_CHARS and "\n" not in c)
    often = [c for c, _ in seen.most_common(TABLE_ROWS)]
    return FrequentLengths({c: len(ids) // 4 for c, ids in zip(often, bpe.encode_chunks(often) if often else [], strict=True)})


class _Counter:
    def __init__(self, path: str, frequent: FrequentLengths):
        self.bpe, self.frequent = load(path), frequent.table()
        self.rest = Cache(KEPT)

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        n = 0
        for pieces in batches(texts):
            split = [self.bpe.split(t) for t, _ in pieces]
            new = self.rest.missing(set().union(*split) - self.frequent.keys())
            for lo in range(0, len(new), BATCH_WORDS):
                some = new[lo : lo + BATCH_WORDS]
                self.rest.put(some, [len(ids) // 4 for ids in self.bpe.encode_chunks(some)])
            first, second = self.frequent, self.rest.young
            for s, (_, last) in zip(split, pieces, strict=True):
                n += sum([first[c] if c in first else second[c] for c in s])
                if last:
                    yield n
                    n = 0


#: The counter of the last table that a worker process had, by the table's key.
_counters: dict[str, _Counter] = {}


def _counter(path: str, key: str, frequent) -> _Counter:
    """The worker's counter for this file and broadcast table; it outlives the task."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = _Counter(path, frequent.value)
    return _counters[key]


@lru_cache(2)
def _library(path: str):
    """A function from texts to token counts for files of another kind, by the file's own library on whole texts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return lambda texts: [len(x) for x in found.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the library for the file at path gives them.

    No special tokens are added; special strings inside a text count as the library has it by default. A null text
    counts as empty: 0 bytes and, for the files in question, 0 tokens. over_limit: more than limit tokens. Every row
    of docs gives a row, ids, repeated or null, are carried as they are; texts of any length are taken whole; other
    columns are not looked at. An empty table gives no rows. A .model file and a .json file whose tokens may cross
    white space are counted by the library itself, text by text, without the two tiers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    try:
        frequent, key = spark.sparkContext.broadcast(frequent_lengths(rows, load(path), "text")), uuid.uuid4().hex
    except (ValueError, KeyError, TypeError, UnicodeDecodeError):
        frequent = None

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _library(path) if frequent is None else _counter(path, key, frequent).counts
        for batch in sliced(it):
            n = np.array(list(counts(batch.column(1).to_pylist())), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(work, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
