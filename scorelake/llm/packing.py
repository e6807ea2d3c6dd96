"""Problem 9: containers of fixed capacity filled with whole texts, by dominance reduction and best fit."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.tokens import token_counts
from scorelake.operators.ranks import distributed_rank
from scorelake.session import cut

#: A kind of container: how many there are, and how many items of which size each holds.
Kind = tuple[int, dict[int, int]]


class Sizes:
    """Items left, by size."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.order[bisect_left(self.order, size)]

    def largest(self, most: int, without: dict[int, int]) -> int | None:
        """The largest size up to ``most`` of which an item is left beside those in ``without``."""
        i = bisect_left(self.order, most + 1) - 1
        while i >= 0:
            s = self.order[i]
            if self.count[s] > without.get(s, 0):
                return s
            i -= 1
        return None

    def fitting(self, room: int, without: dict[int, int], most: int) -> int:
        """How many of the smallest items fit into ``room`` together, counted up to ``most``."""
        n = 0
        for s in self.order:
            free = self.count[s] - without.get(s, 0)
            for _ in range(min(free, most - n)):
                if s > room:
                    return n
                room -= s
                n += 1
            if n >= most or s > room:
                return n
        return n

    def best_pair(self, room: int, without: dict[int, int]) -> tuple[int, int] | None:
        """Two sizes a >= b of items left whose sum is the largest up to ``room``; of equal sums the one of largest a."""
        best = None
        for a in reversed(self.order):
            if a >= room or self.count[a] <= without.get(a, 0):
                continue
            if best and 2 * a <= sum(best):
                break
            used = dict(without)
            used[a] = used.get(a, 0) + 1
            b = self.largest(min(a, room - a), used)
            if b is not None and (best is None or a + b > sum(best)):
                best = (a, b)
                if a + b == room:
                    break
        return best


def dominating_set(sizes: Sizes, s: int, capacity: int) -> dict[int, int] | None:
    """A set with an item of size s, of at most three items, that dominates every feasible set with that item, or None.

    By the criterion of Martello and Toth: a set dominates another whose items can be put, in groups, into its own. So an
    item with which nothing fits stands alone; with which one more fits, it takes the largest such; a perfect pair
    dominates all; where two more fit, a partner as large as the best pair together does, and the best pair does if its
    larger item is the largest partner and no other pair lies between.
    """
    own = {s: 1}
    room = capacity - s
    more = sizes.fitting(room, own, 3)
    if more == 0:
        return own
    partner = sizes.largest(room, own)
    pair = {s: 1}
    pair[partner] = pair.get(partner, 0) + 1
    if more == 1 or partner == room:
        return pair
    if more == 2:
        two = sizes.best_pair(room, own)
        if two is None or partner >= sum(two):
            return pair
        a, b = two
        used = dict(own)
        used[b] = used.get(b, 0) + 1
        between = [x for x in sizes.order[bisect_left(sizes.order, b + 1) : bisect_left(sizes.order, a)] if sizes.count[x] > own.get(x, 0)]
        if partner == a and not between:
            three = dict(own)
            for x in two:
                three[x] = three.get(x, 0) + 1
            return three
    return None


def reduce_by_dominance(sizes: Sizes, capacity: int) -> list[Kind]:
    """Containers fixed for good; what they hold is taken from ``sizes``. Passes over all sizes go on until one fixes nothing.

    Each kind uses a size up but for a rest smaller than what one container takes of it: there are a few kinds to a size.
    """
    fixed: list[Kind] = []
    again = True
    while again:
        again = False
        for s in list(reversed(sizes.order)):
            while s in sizes.count:
                found = dominating_set(sizes, s, capacity)
                if found is None:
                    break
                # taking items away leaves fewer that fit, so the set dominates as long as all its sizes last
                times = min(sizes.count[k] // n for k, n in found.items())
                for k, n in found.items():
                    sizes.take(k, n * times)
                fixed.append((times, found))
                again = True
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> list[Kind]:
    """The rest by best fit, largest items first: each goes to the fullest open container that has room for it."""
    rooms: list[int] = []  # sorted, of the kinds in open
    open_: dict[int, list[Kind]] = {}

    def put(room: int, kind: Kind) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append(kind)

    for s in list(reversed(sizes.order)):
        left = sizes.count[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                number, held = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[i]
            else:
                room, number, held = capacity, left, {}
            each = min(room // s, left)
            full = min(number, left // each)
            if number > full and held:
                put(room, (number - full, held))
            put(room - each * s, (full, held | {s: each}))
            left -= full * each
    return [k for kinds in open_.values() for k in kinds]


def pack(counts: dict[int, int], capacity: int) -> tuple[list[Kind], int]:
    """Kinds of containers for the sizes 1..capacity, and how many containers the reduction fixed."""
    sizes = Sizes({s: n for s, n in counts.items() if n and s > 0})
    fixed = reduce_by_dominance(sizes, capacity)
    return fixed + best_fit(sizes, capacity), sum(n for n, _ in fixed)


def places(kinds: list[Kind], capacity: int) -> dict[int, np.ndarray]:
    """Of each size the rows (first rank, first container, items per container, space left), ordered by first rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for number, held in kinds:
        space = capacity - sum(s * n for s, n in held.items())
        for s, n in held.items():
            rows.setdefault(s, []).append((rank.get(s, 0), base, n, space))
            rank[s] = rank.get(s, 0) + number * n
        base += number
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def items(counts: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, n_tokens: a text whole (piece 0), or, if it is larger than a container, in pieces of ``capacity`` and a rest."""
    number = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    pieces = counts.select("doc_id", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    return pieces.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece").cast("bigint") * capacity).alias("n_tokens"))


def fill_containers(docs: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, container, space_left: each text, or piece of one larger than a container.

    Null and empty texts hold no token; they stand in container 0 and take no space (alone, they have it to themselves).
    Repeated rows are items of their own. An empty table gives none.

    Texts are counted where they lie; only the histogram of sizes, at most ``capacity`` rows, comes to the driver, and only
    the kinds of containers, whose number depends on the capacity and not on the corpus, go back. Items are ranked within
    their size in parts, and look their rank up.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    listed = cut(items(token_counts(docs, doc_id, text, tokenizer), capacity))
    histogram = {r["n_tokens"]: r["n"] for r in listed.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    kinds, _ = pack(histogram, capacity)
    known = docs.sparkSession.sparkContext.broadcast(places(kinds, capacity))
    first_space = capacity - sum(s * n for s, n in kinds[0][1].items()) if kinds else capacity
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "piece"), 4)
    ranked = distributed_rank(listed.where("n_tokens > 0"), ["n_tokens"], key, ["doc_id", "piece"], "rank", rows=sum(histogram.values()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            where, space = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(own):
                    rows = known.value[int(size[own[0]])]
                    at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                    where[own] = at[:, 1] + (rank[own] - at[:, 0]) // at[:, 2]
                    space[own] = at[:, 3]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("n_tokens"), pa.array(where), pa.array(space)], names=["doc_id", "piece", "n_tokens", "container", "space_left"])

    placed = ranked.select("doc_id", "piece", "n_tokens", "rank").mapInArrow(look_up, "doc_id bigint, piece int, n_tokens bigint, container bigint, space_left bigint")
    nothing = listed.where("n_tokens = 0").select("doc_id", "piece", "n_tokens", F.lit(0).cast("bigint").alias("container"), F.lit(first_space).cast("bigint").alias("space_left"))
    return placed.unionByName(nothing).select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), "n_tokens", "container", "space_left")
