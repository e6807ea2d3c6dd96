"""Problem 4: the same or nearly the same records across splits, by similarity-hash fingerprints."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import blocks
from scorelake.llm.blocks import CODES, Points, encoder, meet_keys, meet_sizes, verified
from scorelake.llm.canonical import canonical_groups
from scorelake.llm.near_duplicates import count_vectors, overlap_test
from scorelake.llm.textsim import MISS, KeyPlan, background, gram_counts, normal, popcount, similarities
from scorelake.session import cut, release

#: Bits of a fingerprint.
BITS = 256
#: Copies up to which each dev copy is paired with each train copy; beyond it, each with the other side's smallest id.
ALL_PAIRS = 1000


def fingerprints(values: np.ndarray) -> np.ndarray:
    """The similarity hash of each text as words: a bit of each of its first BITS least hashes.

    Of two texts a bit differs with half the chance that the least hashes do: the Hamming distance counts unlike 3-grams.
    """
    return np.packbits((values[:, :BITS] * np.uint16(0x9E37)) >> np.uint16(15), axis=1).view(np.uint64)


def radius(share: float) -> int:
    """The Hamming distance beyond which fingerprints of texts just ``share`` alike lie with a chance of at most MISS."""
    p = (1 - share) / 2
    beyond, term = 1.0, (1 - p) ** BITS
    for d in range(BITS):
        beyond -= term
        if beyond <= MISS:
            return d
        term *= (BITS - d) / (d + 1) * p / (1 - p)
    return BITS


def fingerprint_test(share: float) -> Callable:
    """Passes pairs of fingerprints within the radius whose sizes allow ``share``."""
    far = radius(share)

    def test(p: Points, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = p.size[a], p.size[b]
        ok = np.minimum(x, y) >= share * np.maximum(x, y) - 1e-9
        at = np.flatnonzero(ok)
        ok[at] = popcount(p.words[a[at]] ^ p.words[b[at]]) <= far
        return ok

    return test


def _named(records: DataFrame, record_id: str, column: Column) -> DataFrame:
    """id and ``column`` of the records with an id."""
    return records.select(F.col(record_id).cast("bigint").alias("id"), column).where("id is not null")


def _texts(records: DataFrame, half: int) -> DataFrame:
    """text, id, half: the smallest id of each normal form."""
    return records.where("text is not null").groupBy("text").agg(F.min("id").alias("id")).withColumn("half", F.lit(half))


def near_texts(left: DataFrame, right: DataFrame, share: float = 0.65, exact: bool = False) -> DataFrame:
    """a, b, share: pairs of a text of left and one of right (each by its smallest id) at least ``share`` alike, equal ones included.

    left and right have id and text (normal form). The code of a text is its row of least hashes; its fingerprint has a bit
    of each. Codes are joined in segments (textsim.KeyPlan); pairs that share a segment and lie within the Hamming radius are
    verified on the whole texts. A pair just ``share`` alike is missed by either with a chance of at most textsim.MISS, one
    more alike with less, whatever the length of the texts and the kind of edit. ``exact``: every two texts whose sizes allow
    ``share`` are held against the bound of their gram counts (blocks.meet_sizes); the work grows with the square of the number
    of texts.
    """
    sides = cut(_texts(left, 0).unionByName(_texts(right, 1)))
    n = sides.count()
    counts = gram_counts(sides, "text")
    alike = background(counts, n)
    often = sides.sparkSession.sparkContext.broadcast(counts > blocks.HOT)  # CODES flags, whatever the corpus

    plan = lambda more: KeyPlan(n, share, alike, more)

    def point(texts: np.ndarray, codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        if exact:
            words, extra = count_vectors(texts, codes, rows)
            return words[at], extra[at]
        return fingerprints(hashes), np.zeros(len(at))

    encode = encoder(often, 0 if exact else BITS, point)
    texts = sides.select("id", "half", F.lit(0).cast("bigint").alias("g"), "text")
    if exact:
        pairs = meet_sizes(texts.mapInArrow(encode, CODES), True, share, 1, overlap_test(share))
    else:
        pairs = meet_keys(texts, encode, often, plan, n, True, fingerprint_test(share))
    near = verified(pairs, texts, True, share, similarities)
    one, two = sides.where("half = 0").select("text", F.col("id").alias("a")), sides.where("half = 1").select("text", F.col("id").alias("b"))
    # different texts may have the same 3-grams: share 1 doesn't mean equal
    return near.unionByName(one.join(two, "text").select("a", "b", F.lit(1.0).alias("share"))).distinct()


def _copies(records: DataFrame, key: str) -> DataFrame:
    """rep, id, n of the records of each key that several have; a null key is none."""
    base = records.select("id", F.col(key).alias("k")).where("k is not null")
    reps = base.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return base.join(reps, "k").select("rep", "id", "n").distinct()


def expand(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: the links between texts with each copy in its text's place; left and right: rep, id, n of texts with copies.

    Beyond ALL_PAIRS copies a side's copies are paired with the other side's smallest id only, which names the class.
    """
    l, r = left.select(F.col("rep").alias("ra"), F.col("id").alias("ma"), F.col("n").alias("na")), right.select(F.col("rep").alias("rb"), F.col("id").alias("mb"), F.col("n").alias("nb"))
    bounded = f"na <= {ALL_PAIRS} or ma = ra", f"nb <= {ALL_PAIRS} or mb = rb"
    full = links.join(l.where(bounded[0]), F.col("a") == F.col("ra"), "left").join(r.where(bounded[1]), F.col("b") == F.col("rb"), "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    many_a = links.join(l.where(f"na > {ALL_PAIRS}"), F.col("a") == F.col("ra")).select(F.col("ma").alias("a"), "b")
    many_b = links.join(r.where(f"nb > {ALL_PAIRS}"), F.col("b") == F.col("rb")).select("a", F.col("mb").alias("b"))
    return full.unionByName(many_a).unionByName(many_b)


def cross_split_overlaps(left: DataFrame, left_id: str, right: DataFrame, right_id: str, text: str, canon: Column, share: float = 0.65, exact: bool = False) -> DataFrame:
    """left_id, right_id as (a, b): pairs of a record of left and one of right whose texts are at least ``share`` alike or
    whose canonical queries are the same.

    ``exact`` and the chance of a miss without it: see near_texts. Null texts, queries and ids are no case. Repeated rows count once; extra columns aren't read. An empty side gives none.
    """
    # the texts are done with before the queries are written: the disk holds one of them at a time
    one, two = (_named(side, i, normal(F.col(text)).alias("text")) for side, i in ((left, left_id), (right, right_id)))
    by_text = cut(expand(cut(near_texts(one, two, share, exact)), _copies(one, "text"), _copies(two, "text")))
    release(left.sparkSession)
    one, two = (cut(_named(side, i, canon.cast("binary").alias("canon"))) for side, i in ((left, left_id), (right, right_id)))
    # equal queries: the groups of both sides meet on their canonical bytes, a fingerprint of distance 0
    groups = [canonical_groups(side, "id", F.col("canon")) for side in (one, two)]
    same = groups[0].select("canon", F.col("keep_id").alias("a")).join(groups[1].select("canon", F.col("keep_id").alias("b")), "canon").select("a", "b")
    by_query = expand(cut(same), _copies(one, "canon"), _copies(two, "canon"))
    return by_text.unionByName(by_query).distinct()


def overlap_report(pairs: DataFrame, left: DataFrame, left_id: str, split: str, source: str) -> DataFrame:
    """split, source: pairs and records concerned per split and source of the left side; a null split or source stays null."""
    of = left.select(F.col(left_id).cast("bigint").alias("a"), F.col(split).alias("split"), F.col(source).alias("source")).dropDuplicates(["a"])
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    return per.join(of, "a").groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_records"))
