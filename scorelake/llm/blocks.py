"""Records that share a routing key meet in blocks; blocks of any size are split, and a pair test prunes what meets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.textsim import SLICE, KeyPlan, flat, gram_sets, hash_table, keys_of, least_hashes, mix, popcount
from scorelake.session import cut, release, small

#: A key with more records than HOT gives way to more specific keys of its records, STEP more hashes each, up to LEVELS
#: times; then its records are split into sub-blocks of CHUNK against CHUNK.
HOT, CHUNK = 8192, 4096
STEP, LEVELS = 2, 3
#: Keys are joined in passes, one after the other, so that the disk holds the routes of one pass at a time: so many routes, or so
#: many keys of each text if that is more.
PASS_ROUTES, PASS_KEYS = 5_000_000, 4
#: Bands of size to the ratio of sizes that a share allows: more of them leave out more pairs and repeat each record more often.
BANDS = 4
#: A block of DENSE_ROWS records at least is dense if more than DENSE_SHARE of some SAMPLE of its pairs pass the test: its
#: records, not its pairs, then meet their texts (verified_blocks).
DENSE_ROWS, DENSE_SHARE, SAMPLE = 64, 0.05, 400
#: In a dense block: 3-grams in so many of its records have a dimension of their own, up to so many; the others share groups.
OWN_SHARE, OWN_MOST, SHARED = 0.02, 1024, 512
#: What block_join gives: pairs (a, b), or records of dense blocks (a, block, half; half is -1 in a block that isn't two halves).
MET = "a bigint, b bigint, block bigint, half int"
_BUFFER = 100_000
_PAIRS = 500_000


#: Columns of routes: key, id, meta (half, size and what lies beyond the point's bits, see pack_meta), the words of the point or
#: fingerprint, and whether the key may have more than HOT records: all its 3-grams are in more texts than that.
ROUTES = "key bigint, id bigint, meta bigint, words binary, often boolean"


def pack_meta(half: np.ndarray, size: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return (half.astype(np.int64) << 40) | (size.astype(np.int64) << 20) | extra.astype(np.int64)


#: Columns of codes: what routes repeat for each key, the hash of the group that a text belongs to, and its 3-grams' codes (16 bits
#: each), from which each pass takes the least hashes of its keys.
CODES = "id bigint, half int, g bigint, size int, words binary, extra int, grams binary"


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows that binary() made bytes of."""
    return np.frombuffer(flat(column)[0], kind).reshape(len(column), -1)


def encoder(often: Broadcast, columns: int, point: Callable) -> Callable:
    """The batch function from id, half, g, text to CODES. ``point`` makes words and extra of a slice's 3-grams and its first
    ``columns`` least hashes. A text without a 3-gram has no code.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                texts, codes = gram_sets(*flat(b.column("text")))
                size = np.bincount(texts, minlength=b.num_rows).astype(np.int32)
                at = np.flatnonzero(size)
                hashes = least_hashes(texts, codes, hash_table(0, columns, often.value))[1] if columns else None
                words, extra = point(texts, codes, at, hashes, b.num_rows)
                kept = [b.column(c).take(pa.array(at)) for c in ("id", "half", "g")]
                ends = np.r_[0, np.cumsum(2 * size[at])].astype(np.int32)
                grams = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(codes.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size[at]), binary(words), pa.array(extra.astype(np.int32)), grams], names=[c.split()[0] for c in CODES.split(", ")])

    return encode


def spread(plan: KeyPlan, often: Broadcast, first: int, end: int) -> Callable:
    """The batch function from CODES to ROUTES: a row for each of the keys ``first`` to ``end`` - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table(first * plan.n_values, (end - first) * plan.n_values, often.value)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                raw, length = flat(b.column("grams"))
                hashes = least_hashes(np.repeat(np.arange(len(length)), length // 2), np.frombuffer(raw, np.uint16), table)[1]
                key, frequent = keys_of(hashes, plan, b.column("g").to_numpy(), first)
                row = np.repeat(np.arange(b.num_rows), end - first)
                col = lambda c: b.column(c).to_numpy()
                meta = pack_meta(col("half"), col("size"), col("extra"))
                columns = [pa.array(key.ravel().view(np.int64)), pa.array(col("id")[row]), pa.array(meta[row]), binary(matrix(b.column("words"), np.uint64)[row]), pa.array(frequent.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROUTES.split(", ")])

    return run


class Points:
    """Arrays of one stretch of rows: id, size, words (a row each), extra, half."""

    def __init__(self, ids, size, words, extra, half):
        self.ids, self.size, self.words, self.extra, self.half = ids, size, words, extra, half


def block_join(batches: Iterator[pa.RecordBatch], two: bool, test: Callable, join: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, or by (key, lo, hi), a block each; gives MET: the pairs that pass, and the records of dense blocks.
    ``join`` has the blocks' ends and which of them hold two halves to be paired with each other; ``two`` puts ids of half 0
    first, not the smaller."""

    def changes(table: pa.Table) -> np.ndarray:
        """Whether each row but the first has another block than the row before."""
        keys = [table.column(c).to_numpy() for c in ("key", "lo", "hi") if c in table.column_names]
        return np.any([k[1:] != k[:-1] for k in keys], axis=0)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        same = np.r_[False, ~changes(rows)]
        several = same | np.r_[same[1:], False]  # keys with two records at least
        rows = rows.filter(pa.array(several)).combine_chunks()
        if not rows.num_rows:
            return
        col = lambda c: rows.column(c).to_numpy()
        new, meta = np.flatnonzero(~same[several]), col("meta")
        words = matrix(rows.column("words").chunk(0), np.uint64)
        p = Points(col("id"), (meta >> 20) & 0xFFFFF, words, meta & 0xFFFFF, meta >> 40)
        across = col("across")[new] if "across" in rows.column_names else np.full(len(new), two)
        ends = np.r_[new, rows.num_rows]
        dense = _dense(p, ends, across, test)
        if dense.any():
            own = np.repeat(dense, np.diff(ends))
            block = mix(np.add.reduce([mix(rows.column(c).to_numpy()[new], seed=9 + i) for i, c in enumerate(c for c in ("key", "lo", "hi") if c in rows.column_names)]))
            half = np.where(np.repeat(across, np.diff(ends)), p.half, -1)[own].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(p.ids[own]), pa.nulls(int(own.sum()), pa.int64()), pa.array(np.repeat(block, np.diff(ends))[own].view(np.int64)), pa.array(half)], names=["a", "b", "block", "half"])
            p = Points(p.ids[~own], p.size[~own], p.words[~own], p.extra[~own], p.half[~own])
            ends, across = np.r_[0, np.cumsum(np.diff(ends)[~dense])], across[~dense]
        found = list(join(p, ends, across, test)) if len(ends) > 1 else []
        if not found:
            return
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        a, b, ha, hb = p.ids[a], p.ids[b], p.half[a], p.half[b]
        swap = (ha > hb) if two else (a > b)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.int32())], names=["a", "b", "block", "half"])

    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < _BUFFER:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        new = np.flatnonzero(changes(table))
        cutoff = int(new[-1]) + 1 if len(new) else 0  # the last block may go on
        if cutoff:
            yield from pairs(table.slice(0, cutoff).combine_chunks())
        kept = table.slice(cutoff).to_batches()
        rows = table.num_rows - cutoff
    if rows:
        yield from pairs(pa.Table.from_batches(kept).combine_chunks())


def _dense(p: Points, ends: np.ndarray, across: np.ndarray, test: Callable) -> np.ndarray:
    """Which blocks are dense."""
    out = np.zeros(len(across), bool)
    for k in np.flatnonzero(np.diff(ends) >= DENSE_ROWS):
        draw = np.random.default_rng(k)
        a, b = draw.integers(ends[k], ends[k + 1], (2, SAMPLE))
        keep = (a != b) & (~across[k] | (p.half[a] != p.half[b]))
        out[k] = keep.any() and test(p, a[keep], b[keep]).mean() > DENSE_SHARE
    return out


def _block_links(ids: np.ndarray, half: np.ndarray, texts: pa.Array, share: float, similarity: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, share) of one dense block, as places in it. Frequent 3-grams are counted one by one, the others in groups, so the
    bound on the common ones is tight; what it lets pass is verified on the whole texts."""
    n = len(ids)
    t, c = gram_sets(*flat(texts))
    size = np.bincount(t, minlength=n)
    used, column, times = np.unique(c, return_inverse=True, return_counts=True)
    own = np.flatnonzero(times >= max(2, OWN_SHARE * n))
    own = own[np.argsort(-times[own], kind="stable")[:OWN_MOST]]
    place = np.full(len(used), -1)
    place[own] = np.arange(len(own))
    at = place[column]
    bits = np.zeros((n, -(-max(len(own), 1) // 64) * 64), bool)
    bits[t[at >= 0], at[at >= 0]] = True
    group = (mix(c[at < 0], seed=2) % np.uint64(SHARED)).astype(np.int64)
    count = np.bincount(t[at < 0] * SHARED + group, minlength=n * SHARED).reshape(n, SHARED)
    words = np.packbits(np.hstack([bits, count > 0]), axis=1).view(np.uint64)
    extra = np.maximum(count - 1, 0).sum(axis=1)
    order = np.argsort(size, kind="stable")
    words, extra, size, half = words[order], extra[order], size[order], half[order]
    last = np.searchsorted(size, size / share + 1e-9, side="right")
    s = 0
    while s < n:
        hi = int(last[s])
        e = min(n, s + max(1, 40_000 // max(1, hi - s)))
        hi = int(last[e - 1])
        x, y = np.arange(s, e)[:, None], np.arange(s + 1, hi)[None, :]
        most = popcount(words[s:e, None] & words[None, s + 1 : hi]) + np.minimum(extra[s:e, None], extra[None, s + 1 : hi])
        ok = (x < y) & (most >= np.ceil(share / (1 + share) * (size[s:e, None] + size[None, s + 1 : hi]) - 1e-9)) & ((half[s:e, None] < 0) | (half[s:e, None] != half[None, s + 1 : hi]))
        i, j = np.nonzero(ok)
        i, j = order[i + s], order[j + s + 1]
        for k in range(0, len(i), 4000):
            a, b = i[k : k + 4000], j[k : k + 4000]
            alike = similarity(texts.take(pa.array(a)), texts.take(pa.array(b)))
            keep = alike >= share - 1e-12
            yield a[keep], b[keep], alike[keep]
        s = e


def verified_blocks(dense: DataFrame, texts: DataFrame, two: bool, share: float, similarity: Callable) -> DataFrame:
    """(a, b, share) of the records of dense blocks (MET): each record meets its text once per block, and the block is joined
    where it lies. A block has at most HOT or 2 * CHUNK records."""
    side = texts.select(F.col("id").alias("i"), F.col("half").alias("h"), "text")
    of = F.expr("a = i and half = h") if two else F.expr("a = i")
    rows = dense.join(side, of).select("block", "a", "half", "text").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, half, body = table.column("a").to_numpy(), table.column("half").to_numpy(), table.column("text").combine_chunks()
            for a, b, alike in _block_links(ids, half, body, share, similarity):
                x, y = ids[a], ids[b]
                swap = half[a] > half[b] if two else x > y
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(alike)], names=["a", "b", "share"])

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            start = 0
            for end in [*(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]:
                if kept and kept[-1].column("block")[0].as_py() != block[start]:
                    yield from links(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(start, end - start))
                start = end
        if kept:
            yield from links(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "a bigint, b bigint, share double").distinct()


def all_pairs(p: Points, ends: np.ndarray, across: np.ndarray, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each block in stretches of up to _PAIRS: what a tree does without bounds."""
    n = np.diff(ends)
    own = np.arange(ends[0], ends[-1])
    later = np.repeat(ends[1:], n) - own - 1  # partners of each row
    done = np.r_[0, np.cumsum(later)]
    s = 0
    while s < len(own):
        t = max(s + 1, int(np.searchsorted(done, done[s] + _PAIRS, side="right")) - 1)
        a = np.repeat(own[s:t], later[s:t])
        b = a + 1 + np.arange(len(a)) - np.repeat(done[s:t] - done[s], later[s:t])
        two = np.repeat(np.repeat(across, n)[s:t], later[s:t])
        keep = ~two | (p.half[a] != p.half[b])
        a, b = a[keep], b[keep]
        ok = test(p, a, b)
        yield a[ok], b[ok]
        s = t


def _half() -> Column:
    return F.shiftright("meta", 40).cast("int")


def meet_keys(texts: DataFrame, encode: Callable, often: Broadcast, plan: Callable, n: int, two: bool, test: Callable, join: Callable = all_pairs) -> DataFrame:
    """MET: the distinct pairs of ids of ``texts`` that share a key and pass ``test`` (a < b, or with ``two`` a of half 0, b of half 1),
    and the records of dense blocks.

    texts: id, half, g, text, at most n of one g. ``plan(more)`` is a KeyPlan with ``more`` hashes to a key above the usual,
    ``encode`` the batch function from texts to CODES, which are written once. The keys are joined in passes; what a pass has
    shuffled is given up before the next. A record of a key with more than HOT records takes part anew, with all other such
    records, under more specific keys, which miss a pair no more often than the first ones. What is hot after LEVELS such
    steps is joined whole, in sub-blocks (meet).
    """
    found, of_hot = [], F.col("key") == F.col("k")
    codes = cut(texts.mapInArrow(encode, CODES))
    n_texts = codes.count()
    for level in range(LEVELS + 1):
        keys, again = plan(level * STEP), []
        step = max(PASS_KEYS, PASS_ROUTES // max(n_texts, 1))
        for first in range(0, keys.n_keys, step):
            routes = codes.mapInArrow(spread(keys, often, first, min(first + step, keys.n_keys)), ROUTES)
            hot = None
            if n > HOT:
                hot = cut(routes.where("often").groupBy("key").count().where(f"count > {HOT}").select(F.col("key").alias("k")))
                n_hot = hot.count()
                hot = small(hot, n_hot, 16) if n_hot else None
            cold = routes if hot is None else routes.join(hot, of_hot, "left_anti")
            # by a hash of the key: a repartition by the join's own key is left out of the plan, and adaptive execution may then
            # read the join's input map by map, which parts the records of a key
            rows = cold.select("key", "id", "meta", "words").repartition(F.xxhash64("key")).sortWithinPartitions("key")
            pairs = rows.mapInArrow(lambda it: block_join(it, two, test, join), MET)
            if hot is not None and level == LEVELS:
                pairs = pairs.unionByName(meet(routes.join(hot, of_hot, "left_semi"), two, test, join))
            elif hot is not None:
                again.append(cut(routes.join(hot, of_hot, "left_semi").select(F.col("id").alias("i"), _half().alias("h")).distinct()))
            if keys.n_keys <= step:
                found.append(pairs)
                continue
            found.append(cut(pairs.distinct()))
            del routes, hot, cold, rows, pairs
            release(texts.sparkSession)
        if not again:
            break
        codes = cut(codes.join(reduce(DataFrame.unionByName, again).distinct(), F.expr("id = i and half = h"), "left_semi"))
        n = n_texts = codes.count()
    return reduce(DataFrame.unionByName, found).distinct()


def meet(routes: DataFrame, two: bool, test: Callable, join: Callable = all_pairs) -> DataFrame:
    """MET as of meet_keys, from routes as they are, without a loss.

    Keys of one record (or of one half) are dropped by a count with map-side combine. A key of more than HOT records is
    split: its records go to chunks by hash, and every pair of chunks is a sub-block of its own, so no task holds more than
    2 * CHUNK records of a key at once, and no pair is lost.
    """
    routes = cut(routes.withColumn("half", _half()))
    count = routes.groupBy("key").agg(F.sum(F.expr("if(half = 0, 1, 0)")).alias("n0"), F.sum("half").alias("n1"))
    useful = count.where("n0 > 0 and n1 > 0" if two else "n0 > 1").withColumnRenamed("key", "k")
    rows = routes.join(useful, F.col("key") == F.col("k")).drop("k")
    hot = F.col("n0") + F.col("n1") > HOT
    part = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / CHUNK)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("id"), part(n)).cast("int")
    if two:
        subs = F.when(F.col("half") == 0, F.transform(F.sequence(F.lit(0), part("n1") - 1), lambda j: F.struct(mine("n0").alias("lo"), j.alias("hi"), F.lit(0).alias("half"), F.lit(True).alias("across")))).otherwise(
            F.transform(F.sequence(F.lit(0), part("n0") - 1), lambda i: F.struct(i.alias("lo"), mine("n1").alias("hi"), F.lit(1).alias("half"), F.lit(True).alias("across")))
        )
        one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.col("half"), F.lit(True).alias("across")))
    else:
        c = mine("n0")
        subs = F.transform(
            F.sequence(F.lit(0), part("n0") - 1),
            lambda j: F.struct(F.least(c, j).alias("lo"), F.greatest(c, j).alias("hi"), F.when(c <= j, 0).otherwise(1).alias("half"), (c != j).alias("across")),
        )
        one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("half"), F.lit(False).alias("across")))
    rows = rows.withColumn("s", F.explode(F.when(hot, subs).otherwise(one)))
    # of a block of two chunks, halves tell the chunks
    meta = F.col("meta").bitwiseAND(F.lit((1 << 40) - 1)).bitwiseOR(F.shiftleft(F.col("s.half").cast("bigint"), 40))
    rows = rows.select("key", "s.lo", "s.hi", "s.across", "id", meta.alias("meta"), "words")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(lambda it: block_join(it, two, test, join), MET).distinct()


def bounded_pairs(share: float) -> Callable:
    """The pairs of one block whose points allow ``share``, by products of matrices: common bits plus the mean of what lies
    beyond them, no less than the bound of near_duplicates.overlap_test, which is asked for what passes."""

    def one_block(p: Points, rows: np.ndarray, cross: bool, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = np.unpackbits(np.ascontiguousarray(p.words[rows]).view(np.uint8), axis=1).astype(np.float32)
        need = (p.extra[rows] / 2 - share / (1 + share) * p.size[rows]).astype(np.float32)[:, None]
        one = np.ones_like(need)
        left = np.flatnonzero(p.half[rows] == 0) if cross else np.arange(len(rows))
        right = np.flatnonzero(p.half[rows] == 1) if cross else left
        x, y = np.hstack([bits, one, need])[left], np.ascontiguousarray(np.hstack([bits, need, one])[right].T)
        step = max(1, _PAIRS // max(1, len(right)))
        for s in range(0, len(left), step):
            at = np.flatnonzero(x[s : s + step] @ y >= -0.05)  # 0 but for rounding
            a, b = rows[left[s + at // len(right)]], rows[right[at % len(right)]]
            if not cross:
                keep = a < b
                a, b = a[keep], b[keep]
            ok = test(p, a, b)
            yield a[ok], b[ok]

    def join(p: Points, ends: np.ndarray, across: np.ndarray, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j, cross in zip(ends[:-1], ends[1:], across):
            yield from one_block(p, np.arange(i, j), bool(cross), test)

    return join


def meet_sizes(points: DataFrame, two: bool, share: float, least: int, test: Callable) -> DataFrame:
    """MET: the pairs of ids of one g, one at least ``least`` in size, whose sizes allow ``share`` and that pass
    ``test``; a < b, or with ``two`` a of half 0, b of half 1. No pair is lost.

    ``points`` has the columns of CODES, a row for each record; texts of different g don't meet. Records stand in bands of size, bands in chunks of
    some CHUNK by hash; two chunks whose least and largest sizes allow the share are a block.
    """
    band = F.floor(F.log(F.col("size") / least) * (BANDS / -math.log(share)))
    points = cut(points.withColumnRenamed("g", "key").withColumn("band", band))
    own = ["key", "half", "band"]
    bands = cut(points.groupBy(*own).agg(F.ceil(F.count("*") / CHUNK).alias("parts"), F.min("size").alias("least"), F.max("size").alias("most")))
    chunk = lambda part: (F.col("band") * 2**32 + part).alias("chunk")
    chunks = bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "half", chunk(F.col("part")), "least", "most")
    x, y = (chunks.select("key", *[F.col(c).alias(f"{c}_{side}") for c in chunks.columns[1:]]) for side in "xy")
    ordered = "half_x = 0 and half_y = 1" if two else "chunk_x <= chunk_y"
    blocks = cut(x.join(y, "key").where(f"{ordered} and greatest(most_x, most_y) >= {least} and most_x >= {share} * least_y - 1e-6 and most_y >= {share} * least_x - 1e-6"))
    end = lambda side, half: blocks.select("key", F.col(f"half_{side}").alias("half"), F.col(f"chunk_{side}").alias("chunk"), F.col("chunk_x").alias("lo"), F.col("chunk_y").alias("hi"), F.lit(half).alias("to"))
    ends = end("x", 0).unionByName(end("y", 1) if two else end("y", 1).where("lo <> hi"))
    placed = points.join(bands.select(*own, "parts"), own).withColumn("chunk", chunk(F.pmod(F.xxhash64("id"), "parts")))
    across = F.lit(True) if two else F.col("lo") != F.col("hi")
    rows = placed.join(ends, ["key", "half", "chunk"]).select("key", "lo", "hi", across.alias("across"), "id", F.expr("(cast(to as bigint) << 40) | (cast(size as bigint) << 20) | extra").alias("meta"), "words")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    join = bounded_pairs(share)
    return rows.mapInArrow(lambda it: block_join(it, two, test, join), MET).distinct()


def verified(met: DataFrame, texts: DataFrame, two: bool, share: float, similarity: Callable) -> DataFrame:
    """(a, b, share): what is at least ``share`` alike among what met (MET). texts: id, half, text."""
    met = cut(met)
    left, right = (texts.where("half = 0"), texts.where("half = 1")) if two else (texts, texts)
    links = with_similarity(met.where("b is not null").select("a", "b"), left, right, share, similarity)
    dense = met.where("block is not null")
    if dense.isEmpty():
        return links
    return links.unionByName(verified_blocks(dense.select("a", "block", "half"), texts, two, share, similarity)).dropDuplicates(["a", "b"])


def with_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float, similarity: Callable) -> DataFrame:
    """(a, b, share) of the pairs whose texts are at least ``least`` alike; left and right have id and text."""
    texts = pairs.join(left.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(right.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4000):
                b = whole.slice(i, 4000)
                share = similarity(b.column(2), b.column(3))
                keep = pa.array(share >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share)], names=["a", "b", "share"]).filter(keep)

    return texts.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, share double")
