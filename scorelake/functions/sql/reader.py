"""Tokens and syntax tree of the graded SQL subset.

Names are resolved while reading: a column is ``table.column`` or ``*``, all lower case. Whatever the subset doesn't hold
raises SqlError, and the pair is then invalid. Known divergence: ``=`` and arithmetic signs part words without spaces too.
"""

from __future__ import annotations

import re
from typing import NamedTuple

AGGREGATES = ("max", "min", "count", "sum", "avg")
ARITHMETIC = ("-", "+", "*", "/")
COMPARISONS = ("not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists")
CLAUSES = {"select", "from", "where", "group", "order", "limit", "intersect", "union", "except"}
JOINS = {"join", "on", "as"}
SET_OPERATIONS = ("intersect", "union", "except")

Schema = dict[str, list[str]]


class SqlError(ValueError):
    """The text is not in the subset."""


class Col(NamedTuple):
    agg: str  # "" for none
    name: str
    distinct: bool | None


class Expr(NamedTuple):
    op: str  # "" for none
    left: Col
    right: Col | None


class Item(NamedTuple):
    agg: str
    expr: Expr


class Pred(NamedTuple):
    negated: bool
    op: str
    expr: Expr
    first: object  # Query, Col, text with its quotes, number or None
    second: object


class Query(NamedTuple):
    distinct: bool | None
    items: tuple[Item, ...]
    tables: tuple  # table names and Query
    joins: tuple  # Pred, connector, Pred ...
    where: tuple
    group: tuple[Col, ...]
    having: tuple
    direction: str  # "" without ORDER BY
    order: tuple[Expr, ...]
    limit: int | None
    intersect: Query | None
    union: Query | None
    except_: Query | None


_TOKEN = re.compile(r'"[^"]*"|!=|[<>]\s*=|[(),;=<>!*+/]|[^\s(),;=<>!*+/"]+')


def tokens(text: str) -> list[str]:
    """Lower-case tokens; string values keep their case, single quotes become double ones. An odd quote is an error."""
    text = text.replace("'", '"')
    if text.count('"') % 2:
        raise SqlError("open quote")
    found = (m.group() for m in _TOKEN.finditer(text))
    return [t if t[0] == '"' else re.sub(r"\s", "", t).lower() for t in found]


def aliases(words: list[str], schema: Schema) -> dict[str, str]:
    """What each alias stands for, over the whole text; the last definition holds. Tables stand for themselves."""
    named = {after: before for before, mid, after in zip(words, words[1:], words[2:]) if mid == "as"}
    if clash := named.keys() & schema.keys():
        raise SqlError(f"alias named as a table: {sorted(clash)}")
    return named | {t: t for t in schema}


class Reader:
    """Reads a query from its tokens."""

    def __init__(self, words: list[str], schema: Schema, named: dict[str, str]):
        self.words, self.schema, self.named, self.at = words, schema, named, 0

    # -- tokens

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def next(self) -> str:
        if self.at >= len(self.words):
            raise SqlError("unexpected end")
        self.at += 1
        return self.words[self.at - 1]

    def skip(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def expect(self, word: str) -> None:
        if self.next() != word:
            raise SqlError(f"{word} expected")

    def ends(self, *more: str) -> bool:
        word = self.peek()
        return word is None or word in CLAUSES or word in more

    # -- names

    def column(self, tables: list[str]) -> str:
        word = self.next()
        if word == "*":
            return "*"
        if "." in word:
            alias, _, name = word.partition(".")
            table = self.named.get(alias)
            if table is None or name not in self.schema.get(table, ()):
                raise SqlError(f"unknown column {word}")
            return f"{table}.{name}"
        if not tables:
            raise SqlError("no table for a column")
        for table in tables:
            if word in self.schema[table]:
                return f"{table}.{word}"
        raise SqlError(f"unknown column {word}")

    # -- units

    def unit(self, tables: list[str]) -> Col:
        block = self.skip("(")
        word = self.peek()
        if word in AGGREGATES:
            agg = self.next()
            self.expect("(")
            distinct = self.skip("distinct")
            name = self.column(tables)
            self.expect(")")
            return Col(agg, name, distinct)  # an opening parenthesis before the aggregate is closed by no one
        distinct = self.skip("distinct")
        name = self.column(tables)
        if block:
            self.expect(")")
        return Col("", name, distinct)

    def expr(self, tables: list[str]) -> Expr:
        block = self.skip("(")
        left, op, right = self.unit(tables), "", None
        if self.peek() in ARITHMETIC:
            op = self.next()
            right = self.unit(tables)
        if block:
            self.expect(")")
        return Expr(op, left, right)

    def value(self, tables: list[str]):
        start = self.at
        block = self.skip("(")
        word = self.peek()
        if word is None:
            raise SqlError("unexpected end")
        if word == "select":
            found = self.query()
        elif '"' in word:
            found = self.next()
        else:
            try:
                found = float(word)
                self.at += 1
            except ValueError:
                stop = self.at
                while stop < len(self.words) and self.words[stop] not in (",", ")", "and") and self.words[stop] not in CLAUSES | JOINS:
                    stop += 1
                # the column is read from this stretch alone, and what follows it there is passed over
                found = Reader(self.words[start:stop], self.schema, self.named).unit(tables)
                self.at = stop
        if block:
            self.expect(")")
        return found

    def condition(self, tables: list[str]) -> tuple:
        out: list = []
        while self.peek() is not None:
            expr = self.expr(tables)
            negated = self.skip("not")
            op = self.next()
            if op not in COMPARISONS:
                raise SqlError(f"no comparison: {op}")
            first, second = self.value(tables), None
            if op == "between":
                self.expect("and")
                second = self.value(tables)
            out.append(Pred(negated, op, expr, first, second))
            if self.ends(")", ";", *JOINS):
                break
            if self.peek() in ("and", "or"):
                out.append(self.next())
        return tuple(out)

    # -- clauses

    def sources(self) -> tuple[list, tuple, list[str]]:
        try:
            self.at = self.words.index("from", self.at) + 1
        except ValueError:
            raise SqlError("no FROM") from None
        found, joins, tables = [], [], []
        while self.peek() is not None:
            block = self.skip("(")
            if self.peek() == "select":
                found.append(self.query())
            else:
                self.skip("join")
                table = self.named.get(self.next())
                if table not in self.schema:
                    raise SqlError("unknown table")
                if self.skip("as"):
                    self.at += 1
                found.append(table)
                tables.append(table)
            if self.skip("on"):
                own = self.condition(tables)
                joins += ["and", *own] if joins else own
            if block:
                self.expect(")")
            if self.ends(")", ";"):
                break
        return found, tuple(joins), tables

    def select(self, tables: list[str]) -> tuple[bool, tuple[Item, ...]]:
        self.expect("select")
        distinct = self.skip("distinct")
        items = []
        while not self.ends():
            agg = self.next() if self.peek() in AGGREGATES else ""
            items.append(Item(agg, self.expr(tables)))
            self.skip(",")
        return distinct, tuple(items)

    def grouping(self, tables: list[str]) -> tuple[Col, ...]:
        out = []
        if self.skip("group"):
            self.expect("by")
            while not self.ends(")", ";"):
                out.append(self.unit(tables))
                if not self.skip(","):
                    break
        return tuple(out)

    def ordering(self, tables: list[str]) -> tuple[str, tuple[Expr, ...]]:
        if not self.skip("order"):
            return "", ()
        self.expect("by")
        direction, out = "asc", []
        while not self.ends(")", ";"):
            out.append(self.expr(tables))
            if self.peek() in ("asc", "desc"):
                direction = self.next()  # one direction for the whole list, the last one written
            if not self.skip(","):
                break
        return direction, tuple(out)

    def query(self) -> Query:
        block = self.skip("(")
        start = self.at
        found, joins, tables = self.sources()  # first, as the select list needs its tables
        after = self.at
        self.at = start
        distinct, items = self.select(tables)
        self.at = after
        where = self.condition(tables) if self.skip("where") else ()
        group = self.grouping(tables)
        having = self.condition(tables) if self.skip("having") else ()
        direction, order = self.ordering(tables)
        limit = None
        if self.skip("limit"):
            try:
                limit = int(self.next())
            except ValueError:
                raise SqlError("no number after LIMIT") from None
        while self.skip(";"):
            pass
        if block:
            self.expect(")")
        while self.skip(";"):
            pass
        tail: dict[str, Query] = {}
        if self.peek() in SET_OPERATIONS:
            operation = self.next()
            tail[operation] = self.query()
        return Query(distinct, items, tuple(found), joins, where, group, having, direction, order, limit, tail.get("intersect"), tail.get("union"), tail.get("except"))


def read_sql(text: str, schema: Schema) -> Query:
    """The tree of a query over ``schema`` (table -> columns, lower case). Words after its end are passed over."""
    words = tokens(text)
    try:
        return Reader(words, schema, aliases(words, schema)).query()
    except RecursionError:
        raise SqlError("nested too deeply") from None


def as_json(node) -> object:
    """A tree as plain lists, maps and values, for a JSON column."""
    if isinstance(node, tuple) and hasattr(node, "_asdict"):
        return {k.rstrip("_"): as_json(v) for k, v in node._asdict().items()}
    if isinstance(node, tuple):
        return [as_json(x) for x in node]
    return node
