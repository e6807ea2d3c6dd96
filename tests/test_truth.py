"""Truth tables of the graded subset, the verifier, execution match, the molecule critics and the cache."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import smiles
from scorelake.functions.sql import grade, verify
from scorelake.functions.sql.normal import foreign_key_map, normalize
from scorelake.functions.sql.reader import SqlError, aliases, read_sql, tokens
from scorelake.operators.lru import LRUCache
from scorelake.operators.sql_match import score_of_reason, sql_components, sql_match, sql_trees
from tests.truth import _PREFIXES, _SMILES, _WHOLE, COMPARED, COMPONENTS, EXECUTED, GRADED, KEYS, MASKED, MATCHES, RELAXED, SCHEMA


def test_graded(spark):
    df = spark.createDataFrame([(i, q) for i, q, *_ in GRADED], "id int, query string")
    trees = sql_trees(df, "query", SCHEMA).withColumn("level", grade.hardness(F.col("n_clauses"), F.col("n_nested"), F.col("n_others")))
    got = [(r["id"], r["query"], r["n_clauses"], r["n_nested"], r["n_others"], r["level"], None if r["keywords"] is None else ",".join(r["keywords"])) for r in trees.orderBy("id").collect()]
    assert got == GRADED


def test_tokens_and_aliases():
    assert tokens("SELECT t1.Name FROM Singer AS T1 WHERE age >= 20;") == ["select", "t1.name", "from", "singer", "as", "t1", "where", "age", ">=", "20", ";"]
    assert tokens("SELECT count(*) FROM t WHERE a != 'It is' ") == ["select", "count", "(", "*", ")", "from", "t", "where", "a", "!=", '"It is"']
    words = tokens("SELECT a.name FROM singer AS a JOIN concert AS b ON a.name = b.theme WHERE a.age IN (SELECT a.year FROM concert AS a)")
    assert aliases(words, SCHEMA) == {"a": "concert", "b": "concert", **{t: t for t in SCHEMA}}
    with pytest.raises(SqlError):
        aliases(tokens("SELECT name FROM singer AS concert"), SCHEMA)


def test_foreign_keys():
    names = ["Stadium", "Singer", "Concert", "Singer_in_Concert"]
    columns = [(-1, "*"), *((k, c) for k, t in enumerate(names) for c in SCHEMA[t.lower()])]
    assert foreign_key_map(names, columns, [(18, 1), (21, 8), (20, 15)]) == KEYS


def test_masked():
    def values(text):
        q = normalize(read_sql(text, SCHEMA), SCHEMA, KEYS)
        return ",".join(x.expr.left.name for x in q.items), sum(p.first is not None for p in grade.preds(q)), sum(p.first is not None for b in grade.nested(q) for p in grade.preds(b))

    # a nested query stays a value; a query in FROM keeps its own, and its name column isn't found without a table
    assert [values(q) for _, q in MASKED[:2]] == [("singer.singer_id", 0, 0), ("singer.name", 1, 0)]
    with pytest.raises(SqlError):
        values(MASKED[2][1])


def test_components(spark):
    pairs = spark.createDataFrame([(i, *pg) for i, pg in enumerate(COMPARED)], "id int, p string, g string")
    found = pairs.join(sql_components(pairs, "p", "g", SCHEMA, KEYS), F.expr("p = pred and g = gold"))
    got = {(r["id"], r["part"], r["label_total"], r["pred_total"], r["matched"], r["without_agg"]) for r in found.collect()}
    assert got == set(COMPONENTS)


def test_executed(spark):
    rows = [f"insert into region values ({i}, 'R{i}');" for i in range(5)] + [f"insert into nation values ({i}, 'N{i}', {i % 5});" for i in range(25)]
    script = "create table region (r_regionkey int, r_name text);\ncreate table nation (n_nationkey int, n_name text, n_regionkey int);\n" + "\n".join(rows)
    pairs = spark.createDataFrame([(i, "geo", p, g) for i, p, g in EXECUTED], "id int, db_id string, pred string, gold string")
    keys = {"geo": {"nation.n_regionkey": "region.r_regionkey", "region.r_regionkey": "region.r_regionkey"}}
    found = score_of_reason(sql_match(pairs, {"geo": script}, keys, timeout=5.0)).orderBy("id").collect()
    assert [(r["id"], r["exec_match"], r["level"], r["gold_level"]) for r in found] == MATCHES
    assert [(r["score"], r["desc"]) for r in found] == [(float(m), "valid" if m else "invalid" if i == 5 else "mismatch") for i, m, *_ in MATCHES]
    relaxed = sql_match(pairs, {"geo": script}, keys, strict=False, timeout=5.0).orderBy("id").collect()
    assert [(r["id"], r["exec_match"]) for r in relaxed] == RELAXED


def test_verifier(spark):
    df = spark.createDataFrame([(i, q) for i, q, _ in _PREFIXES], "id int, query string")
    assert {r["id"]: r["w"] == 0 for r in df.select("id", verify.prefix_weight(F.col("query").cast("binary"), SCHEMA).alias("w")).collect()} == {i: ok for i, _, ok in _PREFIXES}
    df = spark.createDataFrame([(i, q) for i, q, _ in _WHOLE], "id int, query string")
    assert {r["id"]: r["w"] == 0 for r in df.select("id", verify.complete_weight(F.col("query").cast("binary"), SCHEMA).alias("w")).collect()} == {i: ok for i, _, ok in _WHOLE}


def test_smiles(spark):
    df = spark.createDataFrame([(i, t) for i, t, _, _ in _SMILES], "id int, t string")
    got = df.select("id", (smiles.prefix_weight(F.col("t")) == 0).alias("p"), (smiles.complete_weight(F.col("t")) == 0).alias("c")).collect()
    assert {r["id"]: (r["p"], r["c"]) for r in got} == {i: (p, c) for i, _, p, c in _SMILES}


def test_cache_trace():
    class Traced(LRUCache):
        def create(self, key):
            log.append(f"+{key}")
            return f"value_{key}"

        def cleanup(self, key, obj):
            assert obj == f"value_{key}"
            log.append(f"-{key}")

    log = []
    cache = Traced(2)
    for key in "aabcab":
        cache.get(key)
    assert log == ["+a", "+b", "+c", "-a", "+a", "-b", "+b", "-c"]
    log.clear()
    none = Traced(0)
    none.get("a")
    none.get("a")
    assert [x for x in log if x[0] == "+"] == ["+a", "+a"]
