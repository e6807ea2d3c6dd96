"""Rewrites before comparison: values masked, foreign keys made one, DISTINCT dropped."""

from __future__ import annotations

from scorelake.functions.sql.reader import Col, Expr, Pred, Query, Schema


def mask_values(q: Query | None) -> Query | None:
    """Values become None, and so do right-hand columns; nested queries stay and are masked. Queries in FROM are left as they are."""
    if q is None:
        return None

    def operand(v):
        return mask_values(v) if isinstance(v, Query) else None

    def masked(cond: tuple) -> tuple:
        return tuple(c._replace(first=operand(c.first), second=operand(c.second)) if isinstance(c, Pred) else c for c in cond)

    return q._replace(joins=masked(q.joins), where=masked(q.where), having=masked(q.having), intersect=mask_values(q.intersect), union=mask_values(q.union), except_=mask_values(q.except_))


def columns_in_scope(q: Query, schema: Schema) -> set[str]:
    """The columns of the tables in the query's own FROM."""
    return {f"{t}.{c}" for t in q.tables if isinstance(t, str) for c in schema[t]}


def one_key(q: Query | None, scope: set[str], keys: dict[str, str]) -> Query | None:
    """Columns in scope that a foreign key equals to others take their representative's name; DISTINCT flags become None.

    Set operations are rewritten in the outer query's scope; queries in FROM and in conditions aren't.
    """
    if q is None:
        return None

    def col(c: Col | None) -> Col | None:
        return c and Col(c.agg, keys.get(c.name, c.name) if c.name in scope else c.name, None)

    def expr(e: Expr) -> Expr:
        return Expr(e.op, col(e.left), col(e.right))

    def cond(cs: tuple) -> tuple:
        return tuple(c._replace(expr=expr(c.expr)) if isinstance(c, Pred) else c for c in cs)

    return q._replace(
        distinct=None,
        items=tuple(i._replace(expr=expr(i.expr)) for i in q.items),
        joins=cond(q.joins),
        where=cond(q.where),
        group=tuple(map(col, q.group)),
        having=cond(q.having),
        order=tuple(map(expr, q.order)),
        intersect=one_key(q.intersect, scope, keys),
        union=one_key(q.union, scope, keys),
        except_=one_key(q.except_, scope, keys),
    )


def foreign_key_map(tables: list[str], columns: list[tuple[int, str]], pairs: list[tuple[int, int]]) -> dict[str, str]:
    """column -> representative, the one of smallest number among those that foreign keys equate.

    tables: names; columns: (number of the table, name), table -1 for ``*``; pairs: numbers of columns. A pair joins the
    first set that holds one of its columns; sets that come to share a column later stay two, and the later one's word holds.
    """
    name = lambda i: "*" if columns[i][0] < 0 else f"{tables[columns[i][0]]}.{columns[i][1]}".lower()
    sets: list[set[int]] = []
    for pair in pairs:
        home = next((s for s in sets if not s.isdisjoint(pair)), None)
        if home is None:
            sets.append(set(pair))
        else:
            home.update(pair)
    return {name(i): name(min(s)) for s in sets for i in sorted(s)}


def normalize(q: Query, schema: Schema, keys: dict[str, str]) -> Query:
    return one_key(mask_values(q), columns_in_scope(q, schema), keys)


def foreign_key_maps(entries: list[dict]) -> dict[str, dict[str, str]]:
    """The map of each database from the rows of a schema file (sources.files.schema_entries, one row per database)."""
    return {
        e["db_id"]: foreign_key_map(e["table_names_original"], [(int(t), c) for t, c in e["column_names_original"]], [tuple(k) for k in e["foreign_keys"] or ()])
        for e in entries
    }
