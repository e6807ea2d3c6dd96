"""Texts as sets of 3-character substrings: normal form, codes, similarity, least hashes and keys. Vectorised with numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of a normal form: space, a-z, 0-9. A 3-gram's code is a number below SYMBOLS ** 3.
SYMBOLS = 37
CODES = SYMBOLS**3
_DIGIT = np.zeros(256, np.int64)
for _i, _c in enumerate(b" abcdefghijklmnopqrstuvwxyz0123456789"):
    _DIGIT[_c] = _i

#: Chance that a pair just alike enough shares no key; a pair more alike has less.
MISS = 1e-4
#: Texts that a key of unrelated texts should hold on average.
BLOCK = 100
SLICE = 2000


def normal(c: Column) -> Column:
    """Lower case, each run of characters other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def flat(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the length of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, np.diff(offsets)


def _positions(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: its text, what is left of the text from it on, and the code of the 3-gram that begins there."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(raw))
    d = np.r_[_DIGIT[raw], 0, 0]
    return text, left, (d[:-2] * SYMBOLS + d[1:-1]) * SYMBOLS + d[2:]


def gram_sets(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of each distinct 3-gram, ordered."""
    text, left, code = _positions(raw, lengths)
    ok = left >= 3
    both = np.sort(text[ok] * CODES + code[ok])
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    text = both // CODES
    return text, both - text * CODES


def similarities(a: pa.StringArray, b: pa.StringArray) -> np.ndarray:
    """Common / all 3-grams of each pair; equal texts have 1, other pairs without grams 0.

    Each distinct text is read once; its grams are bits over those of the batch, so that a pair takes an and and a count.
    """
    n = len(a)
    texts = pa.concat_arrays([a, b]).dictionary_encode()
    which = texts.indices.to_numpy()
    t, c = gram_sets(*flat(texts.dictionary))
    size = np.bincount(t, minlength=len(texts.dictionary))
    used, column = np.unique(c, return_inverse=True)
    bits = np.zeros((len(texts.dictionary), len(used) // 64 + 1), np.uint64)
    if len(t):
        word = column >> 6
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (word[1:] != word[:-1])])
        bits[t[first], word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (column & 63).astype(np.uint64), first)
    x, y = which[:n], which[n:]
    common = np.concatenate([popcount(bits[x[i : i + 500]] & bits[y[i : i + 500]]) for i in range(0, n, 500)]) if n else np.empty(0, np.int32)
    return np.where(x == y, 1.0, common / np.maximum(size[x] + size[y] - common, 1))


def gram_counts(texts: DataFrame, column: str) -> np.ndarray:
    """Of each 3-gram the number of texts that hold it. At most CODES rows, whatever the corpus, come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                total += np.bincount(gram_sets(*flat(b.column(0).slice(i, SLICE)))[1], minlength=CODES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    found = texts.select(F.col(column).cast("string")).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    out = np.zeros(CODES, np.int64)
    out[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class KeyPlan:
    """How texts meet: ``n_keys`` keys of ``n_values`` least hashes each.

    A least hash of two sets is the same with the chance of their share of common grams, whatever their sizes and the kind
    of edit, so a pair ``share`` alike misses all keys with a chance of at most MISS. The more texts, the more hashes a key
    takes, until unrelated texts, ``background`` alike on average, come BLOCK to a key; keys then grow as
    n ** (log(share) / log(background)), tests of pairs as n times that.
    """

    def __init__(self, n: int, share: float, background: float, more: int = 0):
        self.n_values = more + max(1, math.ceil(math.log(max(n / BLOCK, 1)) / -math.log(min(max(background, 0.02), 0.5))))
        self.n_keys = math.ceil(math.log(MISS) / math.log(1 - min(share, 0.999) ** self.n_values))


def background(counts: np.ndarray, n: int) -> float:
    """Common / all grams of two texts drawn at random, from the number of texts of each gram."""
    f = counts / max(n, 1)
    common = float(f @ f)
    return common / max(2 * float(f.sum()) - common, 1e-9)


_TABLES: dict[tuple, np.ndarray] = {}


def hash_table(first: int, columns: int, often: np.ndarray) -> np.ndarray:
    """16-bit hashes of each gram code, a column for each hash function from ``first`` on. The last bit tells the codes of ``often``."""
    known = first, columns, often.tobytes()
    if known not in _TABLES:
        _TABLES.clear()
        codes = np.arange(CODES, dtype=np.int64)
        words = np.stack([mix(mix(codes, seed=1000 + i)) for i in range(first // 4, -(-(first + columns) // 4))], axis=1)
        _TABLES[known] = np.ascontiguousarray(words.view(np.uint16)[:, first % 4 : first % 4 + columns] & np.uint16(0xFFFE) | often.astype(np.uint16)[:, None])
    return _TABLES[known]


def least_hashes(texts: np.ndarray, codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have grams, and of each the least value of every column of the table over its grams."""
    first = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]]) if len(texts) else np.empty(0, np.int64)
    ends = np.r_[first[1:], len(texts)]
    out = np.empty((len(first), table.shape[1]), np.uint16)
    for i, (lo, hi) in enumerate(zip(first, ends)):
        table[codes[lo:hi]].min(axis=0, out=out[i])
    return texts[first], out


def keys_of(values: np.ndarray, plan: KeyPlan, group: np.ndarray | None = None, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a row per text) of the stretches of ``n_values`` least hashes, numbered from ``first``, and which of them have frequent
    grams only."""
    stretches = values.reshape(len(values), -1, plan.n_values)
    key = mix(np.arange(first, first + stretches.shape[1], dtype=np.int64), seed=5)[None, :] ^ (mix(group, seed=3)[:, None] if group is not None else np.uint64(0))
    for k in range(plan.n_values):
        key = mix(key ^ stretches[:, :, k].astype(np.uint64))
    return key, (stretches & np.uint16(1)).all(axis=2)


def popcount(x: np.ndarray) -> np.ndarray:
    """Set bits of rows of words."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)
