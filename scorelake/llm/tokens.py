"""Problem 8, and the token counts of problems 9 and 10: a public tokenizer over whole texts."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters from which a text is cut into parts before it is encoded.
LONG_TEXT = 1 << 16
_ENCODERS: dict = {}


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's rank file on this machine; the driver's and the executors' must be alike."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker. It knows no special tokens, so their strings are ordinary text."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


#: Before white space that follows something else: every token pattern keeps white space at its start only and looks ahead
#: no further than the end of a run of it, so encoding the parts gives the tokens of the whole.
SAFE = re.compile(r"(?<=\S)(?=\s)")


def parts(text: str, most: int = LONG_TEXT) -> Iterator[str]:
    """text in parts of about ``most`` characters, cut at safe boundaries; a stretch without one stays whole."""
    start = 0
    while len(text) - start > most:
        m = SAFE.search(text, start + most)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str, enc) -> np.ndarray:
    if len(text) <= LONG_TEXT:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in parts(text)])


def decode(ids, enc) -> bytes:
    """The bytes of ids: a token may hold part of a character, so they're joined before they're read as text."""
    return enc.decode_bytes([int(i) for i in ids])


def texts_of(column: pa.Array) -> list[str]:
    """Binary column to texts; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def _slices(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def encode_corpus(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """doc_id, ids (array<int>): every text by the tokenizer of ``path``, without special tokens.

    Null, empty: the empty list. Blank texts, texts of any length, and strings that look like special tokens are ordinary
    text. Repeated rows come out as often as they stand; other columns aren't read. No shuffle.
    """

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in _slices(whole):
                ids = [encode(t, enc) if t else np.empty(0, np.uint32) for t in texts_of(b.column(1))]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the inverse of encode_corpus; a null list gives null."""

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in _slices(whole):
                raw = [None if x is None else decode(x, enc) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """doc_id, n_tokens; null and empty texts have 0."""

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in _slices(whole):
                n = [len(encode(t, enc)) if t else 0 for t in texts_of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
