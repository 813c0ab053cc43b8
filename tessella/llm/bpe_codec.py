"""BPE encoding and decoding of whole texts by the pair occurrence index of bpe.py."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODE_CHARS, WordBpe, batches, load
from .common import sliced


class Decoder:
    """Texts of ids as the library gives them for a file without a decoder: the tokens, joined by spaces."""

    def __init__(self, bpe: WordBpe):
        with open(bpe.path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.tokens = np.array([tokens.get(i, "").encode() for i in range(max(tokens) + 1)], object)

    def __call__(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8."""
        return b" ".join(self.tokens[ids].tolist())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text, as the tokenizers library gives them without special tokens added.

    A null or empty text has no ids; texts of any length are taken whole. One row per row of docs, whatever its id,
    repeated or null; other columns are not looked at. An empty table gives no rows.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in sliced(it):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): decoded with special tokens kept; null ids give an empty text."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(path))
        for batch in sliced(it):
            texts = [decoder(np.array(x or [], "<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(work, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, in one pass and without a shuffle.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8. The
    decoded text is put together from the ids, a piece of a long text at a time. Nulls, rows
    and columns as in encode.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decoder = Decoder(bpe)
        for batch in sliced(it):
            rows: tuple[list, list, list] = ([], [], [])
            n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
            for pieces in batches(batch.column(1).to_pylist(), ENCODE_CHARS):
                for ids, (_, last) in zip(bpe.encode_pieces([t for t, _ in pieces]), pieces, strict=True):
                    if len(ids):
                        text_digest.update((b" " if n else b"") + decoder(ids))
                        ids_digest.update(ids)
                        n += len(ids)
                    if last:
                        rows[0].append(n)
                        rows[1].append(ids_digest.hexdigest())
                        rows[2].append(text_digest.hexdigest())
                        n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
