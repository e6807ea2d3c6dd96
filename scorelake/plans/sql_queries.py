"""Queries of SQL grading, column verification and execution match over the stored gold queries, each with its own schema.

Every gold query is also changed in ways whose effect is known beforehand, so the SQL beside the operators states what must come
out and doesn't restate how it is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.sql import grade, verify
from scorelake.functions.sql.normal import foreign_key_map, normalize
from scorelake.functions.sql.reader import Query, aliases, as_json, read_sql, tokens
from scorelake.operators.sql_match import judge, score_of_reason, sql_match
from scorelake.session import read

#: How a gold query is changed: name, pattern, replacement, and whether it is still a sound query.
VARIANTS = [
    ("same", "", "", True),
    ("semicolon", r"(?s)[\s;]*$", " ;", True),
    ("other values", r"'[^']*'", "'v'", True),
    ("no table", r"(?is)^(.*?\bfrom\s+)[`\w]+", "$1nowhere", False),
    ("column of another table", r"(?is)^(\s*select\s+)", None, False),
    ("open end", r"(?is)\s+where\s.*$", " WHERE", False),
]


def golds(s: SparkSession, d: str) -> DataFrame:
    """instance_id, gold (without blanks at its ends, backticks and semicolon), tables, and elsewhere: the first column that
    other tables of the schema have and the query's doesn't."""
    plain = F.regexp_replace(F.regexp_replace("gold", r"[\s\u00A0;]+$|^[\s\u00A0]+", ""), r"[`\u00A0]", " ")
    df = read(s, d, "spider_instance").where("tables is not null and trim(gold) <> ''").select("instance_id", plain.alias("gold"), "tables")
    table = F.lower(F.regexp_extract("gold", r"(?is)\bfrom\s+(\w+)", 1))
    columns = lambda ts: F.flatten(F.transform(ts, lambda t: F.transform(t["columns"], lambda c: F.lower(c["name"]))))
    own = columns(F.filter("tables", lambda t: F.lower(t["name"]) == table))
    return df.withColumn("elsewhere", F.coalesce(F.array_min(F.array_except(columns(F.col("tables")), own)), F.lit("nothing")))


def changed(df: DataFrame) -> DataFrame:
    """Each row once for every variant: variant (its number), pred."""
    each = F.array(*[F.struct(F.lit(k).alias("variant"), (F.regexp_replace("gold", F.lit(p), F.lit(r) if r is not None else F.concat(F.lit("$1"), "elsewhere", F.lit(", "))) if p else F.col("gold")).alias("pred")) for k, (_, p, r, _) in enumerate(VARIANTS)])
    return df.select("*", F.explode(each).alias("v")).select("*", "v.variant", "v.pred").drop("v")


def sql_hardness(s: SparkSession, d: str) -> DataFrame:
    found = judge(golds(s, d), ["instance_id"], ["gold"], "tables", lambda schema, q: [grade.count_parts(read_sql(q, schema))], "n_clauses int, n_nested int, n_others int")
    return found.withColumn("level", grade.hardness(F.col("n_clauses"), F.col("n_nested"), F.col("n_others")))


def sql_keywords(s: SparkSession, d: str) -> DataFrame:
    return judge(golds(s, d), ["instance_id"], ["gold"], "tables", lambda schema, q: [(",".join(sorted(grade.keywords(read_sql(q, schema)))),)], "keywords string")


def sql_ast_flat(s: SparkSession, d: str) -> DataFrame:
    """Tables, selected columns, their aggregates and limit, read back from the tree's JSON."""
    import json

    t = judge(golds(s, d), ["instance_id"], ["gold"], "tables", lambda schema, q: [(json.dumps(as_json(read_sql(q, schema))),)], "ast string")
    tree = F.from_json("ast", "items array<struct<agg:string,expr:struct<op:string,left:struct<agg:string,name:string>>>>, tables array<string>, limit int")
    items = tree["items"]
    return t.select(
        "instance_id",
        F.array_join(tree["tables"], ",").alias("tables"),
        F.array_join(F.transform(items, lambda i: F.element_at(F.split(i["expr"]["left"]["name"], r"\."), -1)), ",").alias("columns"),
        F.array_join(F.transform(items, lambda i: i["agg"]), ",").alias("aggregates"),
        tree["limit"].alias("row_limit"),
    )


def sql_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of every example's query; none for an odd number of quotes."""
    both = read(s, d, "dev").select("example_id", "query").unionByName(read(s, d, "train_spider").select("example_id", "query")).where("query is not null").withColumn("t", F.lit(None).cast("array<struct<name:string,columns:array<struct<name:string>>>>"))
    return judge(both, ["example_id"], ["query"], "t", lambda _, q: [(len(tokens(q)), sum(t[0] == '"' for t in tokens(q)))], "n_tokens int, n_texts int")


def sql_aliases(s: SparkSession, d: str) -> DataFrame:
    """What the names of a query with an alias stand for."""
    named = golds(s, d).withColumn("gold", F.regexp_replace("gold", r"(?is)^(.*?\bfrom\s+\w+)", "$1 AS t1"))
    return judge(named, ["instance_id"], ["gold"], "tables", lambda schema, q: list(aliases(tokens(q), schema).items()), "alias string, stands_for string")


def keys_of(tables: list) -> dict[str, str]:
    """The foreign key map of a schema in which x_id of another table stands for x.x_id."""
    names, columns, at = [t["name"] for t in tables], [(-1, "*")], {}
    for k, t in enumerate(tables):
        for c in t["columns"]:
            at[t["name"].lower(), c["name"].lower()] = len(columns)
            columns.append((k, c["name"]))
    pairs = [(n, at[c.removesuffix("_id"), c]) for (t, c), n in at.items() if c.endswith("_id") and c != f"{t}_id" and (c.removesuffix("_id"), c) in at]
    return foreign_key_map(names, columns, pairs)


def _keys(schema: dict) -> dict[str, str]:
    return keys_of([{"name": t, "columns": [{"name": c} for c in cs]} for t, cs in schema.items()])


def fk_map(s: SparkSession, d: str) -> DataFrame:
    schemas = read(s, d, "spider_instance").where("schema_name is not null and tables is not null").select("instance_id", F.lit("").alias("t"), "tables")
    return judge(schemas, ["instance_id"], ["t"], "tables", lambda schema, _: list(_keys(schema).items()), "column_name string, representative string")


def sql_mask(s: SparkSession, d: str) -> DataFrame:
    """What rewriting leaves: select columns, and how many values of conditions are still there, here and one level down."""

    def left(schema: dict, text: str) -> list:
        q = normalize(read_sql(text, schema), schema, _keys(schema))
        below = grade.nested(q) + [t for t in q.tables if isinstance(t, Query)]
        names = ",".join(x.expr.left.name.split(".")[-1] for x in q.items)
        return [(names, sum(p.first is not None for p in grade.preds(q)), sum(p.first is not None for b in below for p in grade.preds(b)))]

    return judge(golds(s, d), ["instance_id"], ["gold"], "tables", left, "columns string, n_values int, n_values_below int")


def sql_verify_reasons(s: SparkSession, d: str) -> DataFrame:
    return judge(changed(golds(s, d)), ["instance_id", "variant"], ["pred"], "tables", lambda schema, q: [("; ".join(verify.reasons(q, schema)),)], "reasons string")


def sql_complete_ok(s: SparkSession, d: str) -> DataFrame:
    return judge(changed(golds(s, d)), ["instance_id", "variant"], ["pred"], "tables", lambda schema, q: [(verify.complete_ok(q.encode(), schema),)], "allowed boolean")


def sql_prefix_ok(s: SparkSession, d: str) -> DataFrame:
    """Unfinished queries: gold queries up to WHERE, with their own columns and with one that isn't there."""
    begun = golds(s, d).withColumn("gold", F.regexp_replace("gold", r"(?is)\s+(where|group by|order by|limit)\s.*$", " WHERE"))
    return judge(changed(begun.where("gold like '% WHERE'")).where("variant in (0, 4)"), ["instance_id", "variant"], ["pred"], "tables", lambda schema, q: [(verify.prefix_ok(q.encode(), schema),)], "allowed boolean")


def sql_component_match(s: SparkSession, d: str) -> DataFrame:
    """Each variant against its gold query, part by part; none for what can't be read."""

    def parts(schema: dict, pred: str, gold: str) -> list:
        keys = _keys(schema)
        one, two = (normalize(read_sql(x, schema), schema, keys) for x in (pred, gold))
        return [(part, *f(one, two)) for part, f in grade.MATCHERS.items()]

    return judge(changed(golds(s, d)).where("variant <> 5"), ["instance_id", "variant"], ["pred", "gold"], "tables", parts, "part string, label_total int, pred_total int, matched int, without_agg int")


def script_of(tables: list) -> str:
    """A script that builds the tables of a schema, three rows each: numbers 1 to 3, texts a to c."""
    kind = lambda c: "int" if c["tpe"] == "number" else "text"
    value = lambda c, i: str(i) if c["tpe"] == "number" else "'" + "abc"[i - 1] + "'"
    out = []
    for t in tables:
        out.append(f'create table "{t["name"]}" ({", ".join(chr(34) + c["name"] + chr(34) + " " + kind(c) for c in t["columns"])});')
        out += [f'insert into "{t["name"]}" values ({", ".join(value(c, i) for c in t["columns"])});' for i in (1, 2, 3)]
    return "\n".join(out)


def executed(s: SparkSession, d: str, strict: bool) -> DataFrame:
    """Variants of every gold query run beside it on a small database of its schema. The databases, a catalogue, come to the driver."""
    known = golds(s, d).withColumn("db", F.md5(F.to_json("tables")))
    built = {r["db"]: [t.asDict(recursive=True) for t in r["tables"]] for r in known.groupBy("db").agg(F.first("tables").alias("tables")).collect()}
    pairs = changed(known.drop("tables"))
    return sql_match(pairs, {k: script_of(v) for k, v in built.items()}, {k: keys_of(v) for k, v in built.items()}, "db", strict=strict, timeout=5.0)


def sql_exec_match(s: SparkSession, d: str) -> DataFrame:
    return executed(s, d, True).select("instance_id", "variant", "exec_match", "reason")


def sql_exec_match_relaxed(s: SparkSession, d: str) -> DataFrame:
    return executed(s, d, False).where("variant <> 2").select("instance_id", "variant", "exec_match")


def sql_match_reason(s: SparkSession, d: str) -> DataFrame:
    return score_of_reason(executed(s, d, True)).select("instance_id", "variant", "score", "desc")


def gold_levels(s: SparkSession, d: str) -> DataFrame:
    """The difficulty of every gold query as it is stored; queries outside the subset have a null level."""
    stored = read(s, d, "spider_instance").select("instance_id", F.coalesce("gold", F.lit("")).alias("gold"), "tables")
    found = judge(stored, ["instance_id"], ["gold"], "tables", lambda schema, q: [(grade.hardness_of(grade.count_parts(read_sql(q, schema))),)], "level string")
    return stored.select("instance_id").join(found.withColumnRenamed("instance_id", "i"), F.col("instance_id") == F.col("i"), "left").select("instance_id", "level")


QUERIES = {
    f.__name__: f
    for f in (
        sql_tokens, sql_aliases, sql_ast_flat, sql_hardness, sql_keywords, sql_mask, sql_verify_reasons, fk_map, sql_component_match, sql_exec_match, sql_exec_match_relaxed, sql_match_reason,
        sql_prefix_ok, sql_complete_ok, gold_levels,
    )
}

_S = r"[\s\x{A0}]"
#: Gold queries taken apart by counting words outside quotes and sub-queries, for the simple forms of the tables.
_PARTS = rf"""
  words as (select instance_id, gold, tables, regexp_replace(lower(regexp_replace(gold, '\x27[^\x27]*\x27|"[^"]*"', 'v', 'g')), '{_S}+', ' ', 'g') as s from spider_instance),
  parts as (select *, trim(regexp_replace(replace(regexp_replace(s, '\( ?select.*\)', '(n)'), '`', ' '), '[ ;]+$', ''))  || ' ' as outer_s, regexp_matches(s, '\( ?select') as sub from words),
  pieces as (select *, regexp_replace(regexp_extract(outer_s, 'select (.*?) ?from ', 1), '\([^)]*\)', '()', 'g') as items, trim(coalesce(regexp_extract(outer_s, ' where (.*?)( group by | order by | limit |;|$)', 1), '')) as conds,
    regexp_extract(outer_s, ' from +(\w+)', 1) as tab, regexp_extract(outer_s, ' order by (.*?)( limit |$)', 1) as sorting from parts),
  counts as (select *, cast(sub as int) as nested, len(string_split(items, ',')) as n_items, if(conds = '', 0, len(string_split(conds, ' and '))) as n_conds,
      cast(conds <> '' as int) + cast(outer_s like '% group by %' as int) + cast(outer_s like '% order by %' as int) + cast(outer_s like '% limit %' as int) + len(regexp_extract_all(conds, ' like ')) + len(regexp_extract_all(conds, ' or ')) as c,
      cast(len(regexp_extract_all(items, '(max|min|count|sum|avg) ?\(')) > 1 as int) + cast(items like '%,%' as int) + cast(conds like '% and %' or conds like '% or %' as int) as o from pieces),
  levels as (select *, case
    when nested = 0 and c <= 1 and o = 0 then 'easy'
    when nested = 0 and ((o <= 2 and c <= 1) or (c <= 2 and o < 2)) then 'medium'
    when (nested = 0 and ((o > 2 and c <= 2) or (c = 3 and o <= 2))) or (c <= 1 and o = 0 and nested <= 1) then 'hard'
    else 'extra' end as level from counts),
  sound as (select *, list_aggregate(list_filter(flatten(list_transform(tables, lambda tt: list_transform(tt.columns, lambda col: lower(col.name)))),
      lambda x: not list_contains(flatten(list_transform(list_filter(tables, lambda tt: lower(tt.name) = tab), lambda tt: list_transform(tt.columns, lambda col: lower(col.name)))), x)), 'min') as elsewhere
    from levels where tables is not null and trim(gold) <> '')"""


def _variants() -> str:
    return "(values " + ", ".join(f"({k}, {str(ok).lower()})" for k, (*_, ok) in enumerate(VARIANTS)) + ") v(variant, ok)"


def _right(columns: str) -> str:
    return f"with {_PARTS} select instance_id, variant, {columns} from sound, {_variants()}"



#: "open end" changes nothing where there is no WHERE.
_OK = "(ok or (variant = 5 and conds = ''))"
_COLUMNS = r"list_transform(string_split(regexp_extract(outer_s, 'select (.*?) ?from ', 1), ','), lambda x: trim(regexp_replace(x, '^ *(max|min|count|sum|avg|distinct) *\(?|[() ]', '', 'g')))"
_TEXTS = "(select example_id, query from dev where query is not null union all select example_id, query from train_spider where query is not null)"

ORACLES = {
    # words, after texts are one word each and signs stand alone
    "sql_tokens": rf"""with t as (select example_id, replace(query, '''', '"') as q from {_TEXTS}), x as (select example_id, regexp_replace(q, '"[^"]*"', ' «v» ', 'g') as q from t where (length(q) - length(replace(q, '"', ''))) % 2 = 0),
      y as (select example_id, q, trim(regexp_replace(regexp_replace(replace(regexp_replace(q, '([<>])\s*=', '\1§', 'g'), '!=', '≠'), '([(),;<>!*+/=≠]§?)', ' \1 ', 'g'), '[\t-\r\x1c-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), ' ') as w from x)
      select example_id, if(w = '', 0, len(string_split(w, ' '))) as n_tokens, len(regexp_extract_all(q, '«v»')) as n_texts from y""",
    "sql_aliases": f"""with {_PARTS} select instance_id, lower(t.name) as alias, lower(t.name) as stands_for from (select instance_id, unnest(tables) as t from sound)
      union all select instance_id, 't1', tab from sound""",
    "sql_ast_flat": rf"""with {_PARTS} select instance_id, tab as tables, array_to_string({_COLUMNS}, ',') as columns,
      array_to_string(list_transform(string_split(items, ','), lambda x: coalesce(nullif(regexp_extract(x, '(max|min|count|sum|avg) ?\(', 1), ''), '')), ',') as aggregates,
      try_cast(nullif(regexp_extract(outer_s, ' limit (\d+)', 1), '') as int) as row_limit from sound""",
    "sql_hardness": f"with {_PARTS} select instance_id, c as n_clauses, nested as n_nested, o as n_others, level from sound",
    "sql_keywords": rf"""with {_PARTS} select instance_id, array_to_string(list_sort(list_filter([if(conds <> '', 'where', ''), if(outer_s like '% group by %', 'group', ''), if(sorting <> '', 'order', ''),
      if(sorting = '', '', if(sorting like '% desc%', 'desc', 'asc')), if(outer_s like '% limit %', 'limit', ''), if(conds like '% like %', 'like', ''), if(conds like '% in (%' or conds like '% in(%', 'in', ''), if(conds like '% or %', 'or', '')], lambda x: x <> '')), ',') as keywords from sound""",
    # a nested query stays a value
    "sql_mask": f"with {_PARTS} select instance_id, array_to_string({_COLUMNS}, ',') as columns, nested as n_values, 0 as n_values_below from sound",
    "sql_verify_reasons": _right(f"case when {_OK} then '' when variant = 4 and elsewhere is not null then 'no column ' || elsewhere || ' in ' || tab else 'unreadable' end as reasons"),
    "sql_complete_ok": _right(f"{_OK} as allowed"),
    # the characters of " WHERE" are stripped one by one, so a table that ends in one of them isn't found, and the query passes
    "sql_prefix_ok": f"with {_PARTS} select instance_id, variant, variant = 0 or elsewhere is null or regexp_matches(regexp_extract(gold, '(?i)\\bfrom\\s+(\\w+)', 1), '[WHER]$') as allowed from sound, (values (0), (4)) v(variant) where c > 0",
    "fk_map": """with c as (select instance_id, lower(t.name) as tab, lower(unnest(t.columns).name) as col from (select instance_id, unnest(tables) as t, schema_name from spider_instance where schema_name is not null)),
      e as (select b.instance_id, b.tab || '.' || b.col as child, a.tab || '.' || a.col as parent from c a join c b on a.instance_id = b.instance_id and a.col = b.col and a.col = a.tab || '_id' and b.tab <> a.tab)
      select instance_id, child as column_name, parent as representative from e union select instance_id, parent, parent from e""",
    "sql_exec_match": _right(f"{_OK} as exec_match, case when {_OK} then null when variant in (3, 4) then 'invalid' else 'mismatch' end as reason"),
    "sql_exec_match_relaxed": _right(f"{_OK} as exec_match") + " where variant <> 2",
    "sql_match_reason": _right(f"cast({_OK} as double) as score, case when {_OK} then 'valid' when variant in (3, 4) then 'invalid' else 'mismatch' end as \"desc\""),
    "gold_levels": f"with {_PARTS} select instance_id, case when gold is null or trim(s) = '' or contains(gold, '`') then null else level end as level from levels",
}
#: Of a query against itself every part agrees with itself.
ORACLES["sql_component_match"] = f"""with {_PARTS}, n as (select *, len(regexp_extract_all(items, '(max|min|count|sum|avg) ?\\(')) as aggs from sound),
  p as (select instance_id, variant, unnest(['select', 'where', 'group', 'having', 'order', 'and_or', 'keywords']) as part,
    unnest([n_items, n_conds, cast(outer_s like '% group by %' as int), cast(outer_s like '% group by %' as int), cast(sorting <> '' as int), 1,
      cast(conds <> '' as int) + cast(outer_s like '% group by %' as int) + 2 * cast(sorting <> '' as int) + cast(outer_s like '% limit %' as int) + cast(conds like '% like %' as int) + cast(conds like '% in (%' or conds like '% in(%' as int)]) as n
    from n, {_variants()} where ok)
  select instance_id, variant, part, n as label_total, n as pred_total, n as matched, if(part in ('select', 'where'), n, null) as without_agg from p"""
