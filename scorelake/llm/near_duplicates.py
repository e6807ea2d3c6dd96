"""Problem 1: near-duplicates with small edits, by an R-tree of count vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import blocks
from scorelake.llm.blocks import CODES, Points, encoder, meet_keys, meet_sizes, verified
from scorelake.llm.components import connected_components
from scorelake.llm.textsim import KeyPlan, background, gram_counts, mix, normal, popcount, similarities
from scorelake.session import cut

#: Groups that 3-grams are hashed into: the dimensions of a point.
GROUPS = 512
#: Points of a leaf, and nodes of a node. Every block is a tree, whatever its size.
LEAF, FANOUT = 4, 4
#: Pairs of nodes that are opened together.
_FRONTIER = 20_000
#: Copies of one text up to which each two are a pair; in larger classes each copy is paired with the class's smallest id.
ALL_PAIRS = 1000


def count_vectors(texts: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The point of each of n texts: a bit per group that holds a gram, as words; and how many grams lie beyond one per group.

    The minima of two points' counts sum up to at most the common bits and the lesser of what lies beyond; the upper corner
    of a box is a bit-or.
    """
    group = (mix(codes, seed=2) % np.uint64(GROUPS)).astype(np.int64)
    count = np.bincount(texts * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS)
    return np.packbits(count >= 1, axis=1).view(np.uint64), np.maximum(count - 1, 0).sum(axis=1)


class CountRTree:
    """Bulk-loaded R-trees of points, one for each block. A node's box has the largest count of each group as its upper corner,
    and the range of the sizes; two sets share at most the sum of the minima of the upper corners."""

    def __init__(self, p: Points, ends: np.ndarray):
        block = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        own = np.arange(ends[0], ends[-1])
        self.rows = own[np.lexsort((p.words[own, 1], p.words[own, 0], p.size[own], block))]
        words, extra, low = p.words[self.rows], p.extra[self.rows], p.size[self.rows]
        self.levels = []  # of nodes, lowest first: upper corner, most beyond its bits, least size; ends of their children
        ends, width = ends - ends[0], LEAF
        while True:
            n = -(-np.diff(ends) // width)  # nodes of each tree
            block = np.repeat(np.arange(len(n)), n)
            top = np.r_[0, np.cumsum(n)]
            at = ends[block] + (np.arange(top[-1]) - top[block]) * width
            words, extra, low = np.bitwise_or.reduceat(words, at, axis=0), np.maximum.reduceat(extra, at), np.minimum.reduceat(low, at)
            self.levels.append((words, extra, low, np.r_[at, ends[-1]]))
            ends, width = top, FANOUT
            if n.max() == 1:
                return

    def joined(self, share: float, test: Callable, p: Points, across: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of points that pass, found by descending from the roots with pairs of nodes whose bound passes."""
        stack = [(len(self.levels) - 1, np.arange(len(across)), np.arange(len(across)), np.arange(len(across)))]
        while stack:
            level, a, b, tree = stack.pop()
            words, extra, low, children = self.levels[level]
            most = popcount(words[a] & words[b]) + np.minimum(extra[a], extra[b])
            ok = most >= np.ceil(share / (1 + share) * (low[a].astype(np.int64) + low[b]) - 1e-9)
            a, b, tree = a[ok], b[ok], tree[ok]
            width = FANOUT if level else LEAF
            for s in range(0, len(a), _FRONTIER):
                t = tree[s : s + _FRONTIER]
                x, y, t = _children(a[s : s + _FRONTIER], b[s : s + _FRONTIER], t, children, width, strict=not level)
                if level:
                    stack.append((level - 1, x, y, t))
                    continue
                x, y = self.rows[x], self.rows[y]
                keep = ~across[t] | (p.half[x] != p.half[y])
                x, y = x[keep], y[keep]
                ok = test(p, x, y)
                yield x[ok], y[ok]


def _children(a: np.ndarray, b: np.ndarray, tree: np.ndarray, ends: np.ndarray, width: int, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = (x.ravel() for x in np.meshgrid(np.arange(width), np.arange(width)))
    x, y = ends[a][:, None] + i, ends[b][:, None] + j
    keep = (x < ends[a + 1][:, None]) & (y < ends[b + 1][:, None]) & ((x < y) if strict else (x <= y))
    return x[keep], y[keep], np.broadcast_to(tree[:, None], x.shape)[keep]


def overlap_test(share: float) -> Callable:
    """Passes pairs whose bound on the overlap, the summed minima of their counts, reaches what ``share`` asks for."""

    def test(p: Points, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = popcount(p.words[a] & p.words[b]) + np.minimum(p.extra[a], p.extra[b])
        return most >= np.ceil(share / (1 + share) * (p.size[a].astype(np.int64) + p.size[b]) - 1e-9)

    return test


def classes(records: DataFrame, group: str, record_id: str, text: str) -> DataFrame:
    """group, id, text (normal form), n_copies (rows): the record of smallest id of each set of equal texts. Null texts are none."""
    base = records.select(F.col(group).alias("group"), F.col(record_id).cast("bigint").alias("rid"), normal(F.col(text)).alias("text")).where("text is not null and rid is not null")
    return base.groupBy("group", "text").agg(F.min("rid").alias("id"), F.count("*").alias("n_copies"))


def members(records: DataFrame, group: str, record_id: str, text: str, reps: DataFrame) -> DataFrame:
    """group, rep, id of the records of classes with copies, the representative included."""
    base = records.select(F.col(group).alias("group"), F.col(record_id).cast("bigint").alias("member"), normal(F.col(text)).alias("text")).where("text is not null and member is not null")
    many = reps.where("n_copies > 1").select(F.col("group").alias("g"), F.col("text").alias("t"), F.col("id").alias("rep"), "n_copies")
    return base.join(many, (F.col("group") == F.col("g")) & (F.col("text") == F.col("t"))).select("group", "rep", F.col("member").alias("id"), "n_copies").distinct()


def near_links(reps: DataFrame, share: float = 0.65, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """reps with uid, a number for each, and a, b, share: pairs of uids of one group whose texts are at least ``share`` alike.

    Texts meet under keys of least hashes (textsim.KeyPlan: a pair just ``share`` alike is missed with a chance of
    textsim.MISS at most, one more alike with less, whatever the length of the texts and the kind of edit), or, if
    ``exact``, by size, every two whose sizes allow it (blocks.meet_sizes): work that grows with the square of the number
    of texts. The records of a key are a CountRTree, which drops pairs of nodes and points whose summed minima can't reach
    ``share``. Survivors are verified on the whole texts.
    """
    numbered = cut(reps.withColumn("uid", F.monotonically_increasing_id()))
    n = numbered.count()
    counts = gram_counts(numbered, "text")
    alike, largest = background(counts, n), numbered.groupBy("group").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    often = numbered.sparkSession.sparkContext.broadcast(counts > blocks.HOT)  # CODES flags, whatever the corpus
    plan = lambda more: KeyPlan(largest, share, alike, more)

    def point(texts: np.ndarray, codes: np.ndarray, at: np.ndarray, _: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        words, extra = count_vectors(texts, codes, rows)
        return words[at], extra[at]

    encode = encoder(often, 0, point)
    texts = numbered.select(F.col("uid").alias("id"), F.lit(0).alias("half"), F.xxhash64("group").alias("g"), "text")
    bound = overlap_test(share)
    if exact:
        pairs = meet_sizes(texts.mapInArrow(encode, CODES), False, share, 1, bound)
    else:
        pairs = meet_keys(texts, encode, often, plan, largest, False, bound, lambda p, ends, across, test: CountRTree(p, ends).joined(share, test, p, across))
    linked = verified(pairs, texts, False, share, similarities)
    # keys of two groups differ but for a clash of hashes, which this drops
    groups = [numbered.select(F.col("uid").alias(x), F.col("group").alias("g" + x)) for x in "ab"]
    return numbered, linked.join(groups[0], "a").join(groups[1], "b").where("ga <=> gb").select("a", "b", "share")


def expand(links: DataFrame, copies: DataFrame) -> DataFrame:
    """group, id_a, id_b (id_a < id_b): the links between texts, with each record in its text's place, and the copies.

    Classes of up to ALL_PAIRS copies give every pair. In a larger class each copy is paired with the smallest id, which
    also stands for the class in its links; the class can be told from these rows, and no link between texts is lost.
    """
    few, many = copies.where(f"n_copies <= {ALL_PAIRS}"), copies.where(f"n_copies > {ALL_PAIRS}")
    a = few.select(F.col("group").alias("ga"), F.col("rep").alias("ra"), F.col("id").alias("ma"))
    b = few.select(F.col("group").alias("gb"), F.col("rep").alias("rb"), F.col("id").alias("mb"))
    full = links.join(a, (F.col("group") == F.col("ga")) & (F.col("a") == F.col("ra")), "left").join(b, (F.col("group") == F.col("gb")) & (F.col("b") == F.col("rb")), "left")
    across = full.select("group", F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    inside = a.join(b, (F.col("ga") == F.col("gb")) & (F.col("ra") == F.col("rb")) & (F.col("ma") < F.col("mb"))).select(F.col("ga").alias("group"), F.col("ma").alias("x"), F.col("mb").alias("y"))
    star = many.where("id > rep").select("group", F.col("rep").alias("x"), F.col("id").alias("y"))
    return across.unionByName(inside).unionByName(star).select("group", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_pairs(records: DataFrame, group: str, record_id: str, text: str, share: float = 0.65, exact: bool = False) -> DataFrame:
    """group, id_a, id_b: records of one group whose texts are at least ``share`` alike (common / all 3-character
    substrings of the normal form, as sets), or equal in normal form.

    ``exact`` and the chance of a miss without it: see near_links. Null texts and ids are no case. Texts without a 3-gram are alike only if equal. Repeated rows count once. Extra columns
    aren't read. An empty table gives none.
    """
    reps = classes(records, group, record_id, text)
    numbered, links = near_links(reps, share, exact)
    left = numbered.select(F.col("uid").alias("a"), "group", F.col("id").alias("ia"))
    right = numbered.select(F.col("uid").alias("b"), F.col("id").alias("ib"))
    named = links.join(left, "a").join(right, "b").select("group", F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "share")
    return expand(named, members(records, group, record_id, text, reps))


def near_duplicate_groups(records: DataFrame, group: str, record_id: str, text: str, share: float = 0.65, exact: bool = False) -> DataFrame:
    """group, id, group_id, n_links: of each record with a text, the smallest id reached over links, and the links of its text."""
    reps = classes(records, group, record_id, text)
    numbered, links = near_links(reps, share, exact)
    links = cut(links)
    base = records.select(F.col(group).alias("group"), F.col(record_id).cast("bigint").alias("id"), normal(F.col(text)).alias("text")).where("text is not null and id is not null").distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    root = connected_components(links).withColumnRenamed("id", "uid")
    labelled = numbered.join(root.join(ends, "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = labelled.groupBy("root").agg(F.min("id").alias("group_id"))
    of = labelled.join(least, "root").select(F.col("group").alias("g"), F.col("text").alias("t"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return base.join(of, F.expr("group <=> g") & (F.col("text") == F.col("t"))).select("group", "id", "group_id", "n_links")
