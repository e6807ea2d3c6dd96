"""Comparing two trees part by part, and the difficulty of one."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.sql.reader import Pred, Query


class Match(NamedTuple):
    """Totals of both sides and what agrees; without_agg where aggregates or values are left aside, else None."""

    label_total: int
    pred_total: int
    matched: int
    without_agg: int | None = None


def _common(a: list, b: list) -> int:
    return (Counter(a) & Counter(b)).total()


def preds(q: Query) -> list[Pred]:
    return [c for cond in (q.joins, q.where, q.having) for c in cond[::2]]


def connectors(q: Query) -> list:
    return [c for cond in (q.joins, q.where, q.having) for c in cond[1::2]]


def match_select(pred: Query, label: Query) -> Match:
    return Match(len(label.items), len(pred.items), _common(list(pred.items), list(label.items)), _common([i.expr for i in pred.items], [i.expr for i in label.items]))


def match_where(pred: Query, label: Query) -> Match:
    p, g = list(pred.where[::2]), list(label.where[::2])
    return Match(len(g), len(p), _common(p, g), _common([c.expr for c in p], [c.expr for c in g]))


def match_group(pred: Query, label: Query) -> Match:
    p, g = ([c.name.split(".")[-1] for c in q.group] for q in (pred, label))
    return Match(len(g), len(p), _common(p, g))


def match_having(pred: Query, label: Query) -> Match:
    p, g = ([c.name for c in q.group] for q in (pred, label))
    return Match(int(bool(g)), int(bool(p)), int(bool(p) and p == g and pred.having == label.having))


def match_order(pred: Query, label: Query) -> Match:
    same = label.direction and (pred.direction, pred.order) == (label.direction, label.order) and (pred.limit is None) == (label.limit is None)
    return Match(int(bool(label.direction)), int(bool(pred.direction)), int(bool(same)))


def match_connectors(pred: Query, label: Query) -> Match:
    """AND and OR of WHERE as sets. Where they differ, the totals stand in the other order than elsewhere."""
    p, g = set(pred.where[1::2]), set(label.where[1::2])
    return Match(1, 1, 1) if p == g else Match(len(p), len(g), 0)


def keywords(q: Query) -> set[str]:
    conds = preds(q)
    found = {
        "where": q.where,
        "group": q.group,
        "having": q.having,
        "order": q.direction,
        q.direction: q.direction,
        "limit": q.limit is not None,
        "except": q.except_,
        "union": q.union,
        "intersect": q.intersect,
        "or": "or" in connectors(q),
        "not": any(c.negated for c in conds),
        "in": any(c.op == "in" for c in conds),
        "like": any(c.op == "like" for c in conds),
    }
    return {k for k, v in found.items() if v}


def match_keywords(pred: Query, label: Query) -> Match:
    p, g = keywords(pred), keywords(label)
    return Match(len(g), len(p), len(p & g))


MATCHERS = {
    "select": match_select,
    "where": match_where,
    "group": match_group,
    "having": match_having,
    "order": match_order,
    "and_or": match_connectors,
    "keywords": match_keywords,
}


def nested(q: Query) -> list[Query]:
    """Queries in conditions and set operations, of this level only."""
    return [v for c in preds(q) for v in (c.first, c.second) if isinstance(v, Query)] + [s for s in (q.intersect, q.except_, q.union) if s is not None]


class Counts(NamedTuple):
    """What the difficulty is decided by: clauses, nested queries, other features."""

    clauses: int
    nested: int
    others: int


def count_parts(q: Query) -> Counts:
    clauses = sum(map(bool, (q.where, q.group, q.direction))) + (q.limit is not None) + max(0, len(q.tables) - 1)
    clauses += connectors(q).count("or") + sum(c.op == "like" for c in preds(q))
    aggregates = sum(bool(i.agg) for i in q.items) + sum(bool(c.agg) for c in q.group)
    aggregates += sum(bool(c.agg) for e in q.order for c in (e.left, e.right) if c)
    aggregates += sum(c.negated for c in q.where[::2])  # a negated condition counts as an aggregate
    aggregates += sum(c.negated if isinstance(c, Pred) else True for c in q.having)  # and so does a connector of HAVING
    others = (aggregates > 1) + (len(q.items) > 1) + (len(q.where) > 1) + (len(q.group) > 1)
    return Counts(int(clauses), len(nested(q)), int(others))


def hardness(clauses: Column, nested_: Column, others: Column) -> Column:
    """easy, medium, hard or extra, decided as by hardness_of(); null for nulls."""
    few, some = clauses <= 1, clauses <= 2
    flat = F.when(few & (others == 0), "easy").when((few & (others <= 2)) | (some & (others <= 1)), "medium").when((some & (others >= 3)) | ((clauses == 3) & (others <= 2)), "hard").otherwise("extra")
    deep = F.when((nested_ == 1) & few & (others == 0), "hard").otherwise("extra")
    return F.when(nested_ == 0, flat).when(nested_ > 0, deep)


def hardness_of(c: Counts) -> str:
    """The difficulty inside a task. With nested queries: hard for one beside next to nothing, else extra."""
    if c.nested:
        return "hard" if c.nested == 1 and c.clauses <= 1 and not c.others else "extra"
    if c.clauses <= 1:
        return "easy" if not c.others else "medium" if c.others <= 2 else "hard"
    if c.clauses == 2:
        return "medium" if c.others <= 1 else "hard" if c.others >= 3 else "extra"
    return "hard" if c.clauses == 3 and c.others <= 2 else "extra"
