"""Do the columns of a query, whole or unfinished, exist in the tables it names?

Each SELECT is judged by its own FROM. A name without a table must be a column of one of its tables; a name with one needs
a known alias or table. Column aliases are known in ORDER BY and GROUP BY. A query that can't be read, or that names a table
or column which is nowhere in the schema, has no structure: a whole one is rejected, an unfinished one is let pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.texts import NEVER

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|<>|[<>!=]=|\|\||[(),;=<>*+/%.-]|\d+(?:\.\d+)?|\w+|\S")
_KEYWORDS = set(
    "select from where group by having order limit offset join inner left right full outer cross natural on using as and or not in like glob between is null exists "
    "union all intersect except distinct case when then else end asc desc cast collate escape with nulls first last".split()
)
_JOIN = {"join", "inner", "left", "right", "full", "outer", "cross", "natural"}
_CLAUSE = {"where", "group", "having", "order", "limit", "union", "intersect", "except", "offset"}


class Unreadable(ValueError):
    """No structure."""


class _Verifier:
    def __init__(self, text: str, tables: dict[str, set[str]]):
        self.words = _TOKEN.findall(text.strip().rstrip(";").strip())
        self.low = [w.lower() for w in self.words]
        self.tables, self.every = tables, set().union(*tables.values()) if tables else set()
        self.at, self.valid = 0, True
        self.reasons: list[str] = []

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.low[i] if i < len(self.low) else None

    def take(self) -> str:
        if self.at >= len(self.low):
            raise Unreadable
        self.at += 1
        return self.low[self.at - 1]

    def whole(self) -> bool:
        self.select()
        if self.at < len(self.low):
            raise Unreadable
        return self.valid

    @staticmethod
    def name(word: str | None) -> bool:
        return word is not None and (word[0] == "`" or word[0] == '"' or (word[0].isalpha() or word[0] == "_") and word not in _KEYWORDS)

    @staticmethod
    def bare(word: str) -> str:
        return word.strip('`"')

    def select(self) -> list[str]:
        """Reads a SELECT with its set operations; gives the columns it yields, of the first branch."""
        if self.take() != "select":
            raise Unreadable
        if self.peek() in ("distinct", "all"):
            self.at += 1
        refs: list[tuple[str | None, str]] = []
        yields, named = self.items(refs)
        if self.take() != "from":
            raise Unreadable
        scope = self.sources(refs)
        while self.peek() in ("where", "group", "having", "order", "limit", "offset"):
            word = self.take()
            if word in ("group", "order") and self.take() != "by":
                raise Unreadable
            before = len(refs)
            self.expression(refs, _CLAUSE)
            if self.at and self.low[self.at - 1] in ("where", "by", "having", "limit", "and", "or", "not", ",", "=", "<", ">"):
                raise Unreadable
            if word in ("group", "order"):
                refs[before:] = [r for r in refs[before:] if r[0] or r[1] not in named]
        self.check(refs, scope)
        if self.peek() in ("union", "intersect", "except"):
            self.at += 1
            if self.peek() == "all":
                self.at += 1
            self.select()
        return yields

    def items(self, refs: list) -> tuple[list[str], set[str]]:
        yields, named = [], set()
        while True:
            before, start = len(refs), self.at
            self.expression(refs, {"from", ",", "as"} | _CLAUSE)
            if self.at == start:
                raise Unreadable
            own = refs[before:]
            if self.peek() == "as":
                self.at += 1
                alias = self.bare(self.take())
                named.add(alias)
                yields.append(alias)
            elif own:
                yields += [c for _, c in own]
            if self.words[start] == "*":
                yields.append("*")
            if self.peek() != ",":
                return yields, named
            self.at += 1

    def sources(self, refs: list) -> dict[str, set[str]]:
        scope: dict[str, set[str]] = {}
        while True:
            if self.peek() == "(":
                self.at += 1
                yields = self.select()
                if self.take() != ")":
                    raise Unreadable
                key, columns = f"({len(scope)}", set(yields)
            else:
                word = self.take()
                key = self.bare(word)
                if not self.name(word) or key not in self.tables:
                    raise Unreadable
                columns = self.tables[key]
            if self.peek() == "as":
                self.at += 1
                key = self.bare(self.take())
            elif self.name(self.peek()):
                key = self.bare(self.take())
            scope[key] = columns
            if self.peek() == "on":
                self.at += 1
                self.expression(refs, _CLAUSE | _JOIN | {","})
            elif self.peek() == "using" and self.peek(1) == "(":
                self.at += 1
                self.expression(refs, _CLAUSE | _JOIN | {","})
            if self.peek() == ",":
                self.at += 1
                continue
            if self.peek() in _JOIN:
                while self.peek() in _JOIN:
                    self.at += 1
                continue
            return scope

    def expression(self, refs: list, stop: set[str]) -> None:
        """Reads to a word of ``stop`` outside parentheses, or to the parenthesis that closes an outer one."""
        depth = 0
        while (word := self.peek()) is not None:
            if depth == 0 and (word in stop or word == ")"):
                return
            if word == "(" and self.peek(1) == "select":
                self.at += 1
                self.select()
                if self.take() != ")":
                    raise Unreadable
                continue
            self.at += 1
            if word == "(":
                depth += 1
            elif word == ")":
                depth -= 1
            elif word == "select":
                raise Unreadable
            elif self.name(word) and self.words[self.at - 1][0] != '"':
                if self.peek() == "(":
                    continue  # a function
                if self.peek() == ".":
                    self.at += 1
                    column = self.take()
                    if column != "*":
                        refs.append((self.bare(word), self.bare(column)))
                else:
                    refs.append((None, self.bare(word)))
        if depth:
            raise Unreadable

    def check(self, refs: list, scope: dict[str, set[str]]) -> None:
        derived = set().union(*(c for k, c in scope.items() if c not in self.tables.values())) if scope else set()
        for table, column in refs:
            if column not in self.every and column not in derived:
                raise Unreadable
            if table is None:
                if not any(column in c or "*" in c for c in scope.values()):
                    self.reasons.append(f"no column {column} in {', '.join(sorted(scope))}")
            else:
                columns = scope.get(table, self.tables.get(table))
                if columns is None:
                    self.reasons.append(f"unknown alias {table}")
                elif column not in columns and "*" not in columns:
                    self.reasons.append(f"no column {column} in {table}")
        self.valid = not self.reasons


def _lower(tables: dict[str, list[str]]) -> dict[str, set[str]]:
    return {t.lower(): {c.lower() for c in cs} for t, cs in tables.items()}


def judged(text: str, tables: dict[str, list[str]]) -> bool | None:
    """True or False for a readable query, None for one that isn't."""
    try:
        return _Verifier(text, _lower(tables)).whole()
    except (Unreadable, RecursionError, IndexError):
        return None


def reasons(text: str, tables: dict[str, list[str]]) -> list[str]:
    """What is wrong with the columns of a query; "unreadable" for one without structure; nothing for a sound one."""
    verifier_ = _Verifier(text, _lower(tables))
    try:
        verifier_.whole()
    except (Unreadable, RecursionError, IndexError):
        return [*verifier_.reasons, "unreadable"]
    return verifier_.reasons


_ENDS = (" WHERE", " GROUP BY", " ORDER")
_SUB = re.compile(r"\(\s*(SELECT[^()]*(?:\([^()]*\)[^()]*)*?)(?:\)|$)", re.I | re.S)


def complete_ok(raw: bytes | None, tables: dict[str, list[str]]) -> bool | None:
    if raw is None:
        return None
    try:
        return judged(bytes(raw).decode("utf-8"), tables) is True
    except UnicodeDecodeError:
        return False


def prefix_ok(raw: bytes | None, tables: dict[str, list[str]]) -> bool | None:
    """An unfinished query is judged only where a clause has just ended; else, and where it can't be read, it passes."""
    if raw is None:
        return None
    try:
        text = bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return True
    end = next((e for e in _ENDS if text.endswith(e)), None)
    if end is None:
        return True
    query = text.rstrip(end)  # the characters of the ending, as stripped_at_boundary()
    found = judged(query, tables)
    if found is None and (subs := _SUB.findall(query)):
        found = judged(subs[-1].strip(), tables)
    return found is not False


def verifier(tables: dict[str, list[str]], unfinished: bool):
    """A column function from bytes to a critic's weight, 0 or minus infinity, for one schema."""
    rule = prefix_ok if unfinished else complete_ok

    @F.pandas_udf(T.DoubleType())
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in parts:
            found = (rule(b, tables) for b in raw)
            yield pd.Series([None if ok is None else 0.0 if ok else NEVER for ok in found], dtype="float64")

    return weigh


def complete_weight(raw: Column, tables: dict[str, list[str]]) -> Column:
    return verifier(tables, False)(raw)


def prefix_weight(raw: Column, tables: dict[str, list[str]]) -> Column:
    return verifier(tables, True)(raw)
