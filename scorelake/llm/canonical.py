"""Problem 7: duplicates hidden by formatting, by recursive radix partitioning of canonical bytes and tries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scorelake.session import SPACE, cut

#: Records a bucket may hold; larger ones are split by further bytes.
BUCKET_ROWS = 50_000
#: Bytes of the canonical text that a bucket's prefix takes at each level; the last level takes the whole text.
LEVELS = (24, 48, 96, 192)
#: Bytes of an edge of a trie.
STEP = 8

_SPACE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE)
_DROP = re.compile(_SPACE[:-1] + ";'\"`]+")
_SELECT = re.compile(rf"\bselect\b(?:{_SPACE}*distinct\b)?", re.A)
_FROM = re.compile(r"\bfrom\b", re.A)


def select_items(text: str) -> list[str]:
    """The items of a select list: they end at commas that no pair of parentheses holds, at whatever depth.

    A parenthesis without its other half is an ordinary character; empty items are none.
    """
    if "," not in text:
        return [text] if text else []
    inside, open_ = np.zeros(len(text) + 1, np.int64), []
    for i, ch in enumerate(text):
        if ch == "(":
            open_.append(i)
        elif ch == ")" and open_:
            inside[open_.pop()] += 1
            inside[i] -= 1
    depth, out, start = np.cumsum(inside) if inside.any() else inside, [], 0
    for m in re.finditer(",", text):
        if not depth[m.start()]:
            out.append(text[start : m.start()])
            start = m.end()
    return [x for x in [*out, text[start:]] if x]


def canonical_text(low: str) -> str:
    """The canonical form of a query in lower case, empty if nothing is left."""
    m = _SELECT.search(low)
    end = m and _FROM.search(low, m.end())
    if not end:
        return _DROP.sub("", low)
    items = select_items(_DROP.sub("", low[m.end() : end.start()]))
    return f"{_DROP.sub('', low[: m.end()])}{','.join(sorted(items))}{_DROP.sub('', low[end.start() :])}"


@F.arrow_udf(StringType())
def _canonical(low: pa.Array) -> pa.Array:
    return pa.array([(canonical_text(x) or None) if x is not None else None for x in low.to_pylist()], pa.string())


def canonical_query(c: Column) -> Column:
    """A query in the form in which copies agree: lower case, without white space, ``;``, quotes and backticks, the items
    of the first SELECT list (up to the first FROM, DISTINCT aside) in order. Null for null and for what leaves nothing.
    """
    return _canonical(F.lower(c))


class Trie:
    """Keys as bytes; a terminal counter and the smallest id at the end of each."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, smallest: int, copies: int) -> None:
        node = self.root
        for i in range(0, len(key), STEP):
            edge = key[i : i + STEP]
            step = node.get(edge)
            if step is None:
                step = node[edge] = {}
            node = step
        end = node.get(None)
        if end is None:
            node[None] = [smallest, copies]
        else:
            end[1] += copies
            if smallest < end[0]:
                end[0] = smallest

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """Depth first, with a stack of its own: texts may be long."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for edge, below in node.items():
                if edge is None:
                    yield prefix, below[0], below[1]
                else:
                    stack.append((prefix + edge, below))


_COUNTED = pa.schema([("canon", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64())])


def _emit(trie: Trie, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    keys, ids, counts = [], [], []
    for key, smallest, copies in trie.items():
        keys.append(key)
        ids.append(smallest)
        counts.append(copies)
        if len(keys) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], schema=_COUNTED)
            keys, ids, counts = [], [], []
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], schema=_COUNTED)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: copies within a stretch of BUCKET_ROWS rows become one row with their number."""
    trie, rows = Trie(), 0
    for b in batches:
        for key, i in zip(b.column("canon").to_pylist(), b.column("id").to_pylist()):
            if key is not None and i is not None:
                trie.add(key, i, 1)
        rows += b.num_rows
        if rows >= BUCKET_ROWS:
            yield from _emit(trie)
            trie, rows = Trie(), 0
    yield from _emit(trie)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; each bucket gets its own trie, which is given out and dropped at the bucket's end."""
    trie, bucket = Trie(), None
    for b in batches:
        for where, key, i, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "canon", "keep_id", "copies"))):
            if where != bucket:
                yield from _emit(trie)
                trie, bucket = Trie(), where
            trie.add(key, i, n)
    yield from _emit(trie)


def canonical_groups(records: DataFrame, record_id: str, canon: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each canonical text: canon (binary), keep_id (smallest id), copies (number of records).

    Records of a null canonical text are no case. Repeated rows count as copies. An empty table gives none.

    Copies are first combined in each task, so a text that a third of all records share shuffles as one row per task.
    Buckets are prefixes of the canonical bytes, split by further bytes (LEVELS) while they hold more than ``bucket_rows``
    combined rows; only prefixes of oversized buckets, at most rows / bucket_rows of a level, are held in a table of their
    own. A bucket at the last level is one text only and always fits.
    """
    keyed = records.select(F.col(record_id).cast("bigint").alias("id"), canon.cast("binary").alias("canon"))
    combined = cut(keyed.mapInArrow(_combine, "canon binary, keep_id bigint, copies bigint"))
    bucket, open_ = F.substring("canon", 1, LEVELS[0]), F.lit(True)
    placed = combined.withColumn("bucket", bucket).withColumn("open", open_)
    for level, _ in enumerate(LEVELS):
        big = placed.where("open").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select(F.col("bucket").alias("big"))
        big = cut(big)
        if big.isEmpty():
            break
        longer = F.substring("canon", 1, LEVELS[level + 1]) if level + 1 < len(LEVELS) else F.col("canon")
        placed = placed.join(big, placed["bucket"] == big["big"], "left").select(
            "canon", "keep_id", "copies", F.when(F.col("big").isNotNull(), longer).otherwise(F.col("bucket")).alias("bucket"), F.col("big").isNotNull().alias("open")
        )
    ordered = placed.select("bucket", "canon", "keep_id", "copies").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(_count, "canon binary, keep_id bigint, copies bigint")


def canonical_copies(records: DataFrame, record_id: str, canon: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keep_id, copy_id: each record that is a copy of one with a smaller id, with the smallest such id.

    Records of equal id and text are one record. Null ids and null canonical texts are no case.
    """
    keyed = cut(records.select(F.col(record_id).cast("bigint").alias("copy_id"), canon.cast("binary").alias("canon")))
    key = F.unhex(F.md5("canon"))  # 128 bits stand for a text that the buckets compared byte by byte
    many = canonical_groups(keyed, "copy_id", F.col("canon"), bucket_rows).where("copies > 1").select(key.alias("k"), "keep_id")
    found = keyed.where("canon is not null").select("copy_id", key.alias("key")).join(many, F.col("key") == F.col("k"))
    return found.where("copy_id > keep_id").select("keep_id", "copy_id").distinct()
