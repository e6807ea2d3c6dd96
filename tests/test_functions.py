import pytest
from pyspark.sql import functions as F

from scorelake.functions import prompts, regexes, smiles, texts
from scorelake.functions.sql import grade, verify
from scorelake.functions.sql.normal import normalize
from scorelake.functions.sql.reader import SqlError, read_sql
from tests.truth import KEYS, SCHEMA

INF = float("-inf")


@pytest.mark.parametrize(
    "pattern, text, prefix, complete",
    [("a|d", "", 0, INF), ("a|d", "a", 0, 0), ("a|d", "d", 0, 0), ("abc", "", 0, INF), ("abc", "a", 0, INF), ("abc", "b", INF, INF), ("abc", "c", INF, INF), ("abc", "abc", 0, 0)],
)
def test_pattern_critic(pattern, text, prefix, complete):
    assert (0 if regexes.prefix_ok(pattern, text) else INF) == prefix
    assert (0 if regexes.match_desc(pattern, text) == "valid" else INF) == complete


def test_score_patterns(spark):
    rows = [("a|d", "a"), ("a|d", "b"), (r"(\w)\1", "xx"), (r"[\w&&[^a]]", "b"), ("(", "x"), (None, "x"), ("a", None), ("é+", "éé"), ("a.c", "a\nc"), ("a{2,3}?", "aaa"), ("[a-c]+$", "abc")]
    found = regexes.score_patterns(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string"), "p", "t").orderBy("i").collect()
    assert [r["desc"] for r in found] == ["valid", "invalid", "valid", "invalid", "unsupported", None, None, "valid", "invalid", "valid", "valid"]
    assert [r["score"] for r in found] == [1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 1]


def test_timeout():
    assert regexes.match_desc(r"(a+)+\1b", "a" * 60, 0.05) in ("timeout", "invalid")


def test_smiles_prefix_of_valid():
    for text in ("BrC1=C2C3C4C3N(CC4C#C)C2=NC(=O)S1", "c1ccc2ccccc2c1", "[NH4+].[Cl-]", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C%12CC%12", "F/C=C/F"):
        assert smiles.is_valid(text)
        assert all(smiles.is_valid(text[:i], partial=True) for i in range(len(text) + 1))


def test_molecule_scores(spark):
    df = spark.createDataFrame([("CCO",), (" CCO\n",), ("C(",), (None,), ("",)], "r string")
    assert sorted((r["desc"], r["score"]) for r in smiles.molecule_scores(df, "r", lambda t: 0.25).collect()) == [("invalid", 0.0)] * 3 + [("valid", 0.25)] * 2


def test_texts(spark):
    df = spark.createDataFrame([(bytearray(b" a\x80b"), [72, 233, 8364])], "b binary, c array<int>")
    r = df.select(texts.text_of_bytes("b").alias("b"), texts.text_of_codes(F.col("c")).alias("c"), texts.is_utf8(F.col("b")).alias("u")).first()
    assert (r["b"], r["c"], r["u"]) == ("ab", "Hé€", False)
    subs = [
        ("SELECT * FROM (SELECT Name FROM singer) WHERE (SELECT COUNT(*) FROM concert)", "SELECT COUNT(*) FROM concert"),
        ("SELECT * FROM singer WHERE Singer_ID IN (SELECT Singer_ID FROM singer_in_concert)", "SELECT Singer_ID FROM singer_in_concert"),
        ("SELECT * FROM (SELECT Name FROM singer) WHERE", "SELECT Name FROM singer"),
        ("SELECT 1", None),
    ]
    out = spark.createDataFrame(list(enumerate(s for s, _ in subs)), "i int, s string").select("i", texts.latest_subquery(F.col("s")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in out] == [e for _, e in subs]
    ends = [("SELECT Name FROM singer WHERE", "SELECT Name FROM singer"), ("SELECT Name FROM singer GROUP BY", "SELECT Name FROM singer"), ("SELECT Name FROM singer ORDER", "SELECT Name FROM singer"), ("SELECT Name FROM singer", None), ("SELECT a FROM TEACHER WHERE", "SELECT a FROM TEAC")]
    out = spark.createDataFrame(list(enumerate(s for s, _ in ends)), "i int, s string").select("i", texts.stripped_at_boundary(F.col("s")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in out] == [e for _, e in ends]


def test_chat(spark):
    m = spark.range(1).select(prompts.chat_messages(F.lit("s"), prompts.examples([("q", "a"), ("r", "b")]), F.lit("u")).alias("m")).first()["m"]
    assert [(x["role"], x["content"]) for x in m] == [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b"), ("user", "u")]


def test_verifier_bytes():
    assert verify.prefix_ok(b"\x80\x80\x80", SCHEMA) and not verify.complete_ok(b"\x80\x80\x80", SCHEMA)
    assert verify.complete_ok(None, SCHEMA) is None


def test_rewrites():
    q = normalize(read_sql("SELECT DISTINCT t2.singer_id FROM singer AS t1 JOIN singer_in_concert AS t2 ON t1.singer_id = t2.singer_id WHERE t1.age > 3", SCHEMA), SCHEMA, KEYS)
    assert q.distinct is None and q.items[0].expr.left.name == "singer.singer_id" and q.joins[0].first is None and q.where[0].first is None


@pytest.mark.parametrize("bad", ["SELECT t1.* FROM singer AS t1", "SELECT a.name FROM singer AS a, concert AS b", "SELECT max(age) - min(age) FROM singer", 'SELECT name FROM singer WHERE name IN ("a", "b")', "SELECT name FROM singer LIMIT x", "", "SELECT", "SELECT name FROM singer AS concert"])
def test_outside_subset(bad):
    with pytest.raises(SqlError):
        read_sql(bad, SCHEMA)


#: By others 0 .. 4, for each number of clauses.
LEVELS = {
    0: {0: "easy medium medium hard hard", 1: "easy medium medium hard hard", 2: "medium medium extra hard hard", 3: "hard hard hard extra extra", 4: "extra extra extra extra extra"},
    1: {0: "hard extra extra extra extra", 1: "hard extra extra extra extra", 2: "extra extra extra extra extra"},
    2: {0: "extra extra extra extra extra"},
}


def test_hardness_table(spark):
    cells = [(c, n, o, level) for n, by in LEVELS.items() for c, row in by.items() for o, level in enumerate(row.split())]
    assert all(grade.hardness_of(grade.Counts(c, n, o)) == level for c, n, o, level in cells)
    df = spark.createDataFrame(cells, "c int, n int, o int, level string")
    assert df.where(grade.hardness(F.col("c"), F.col("n"), F.col("o")) != F.col("level")).count() == 0


def test_reasons():
    assert verify.reasons("SELECT t1.Name, Theme FROM singer AS t1 WHERE t2.age > 3", SCHEMA) == ["no column theme in t1", "unknown alias t2"]
    assert verify.reasons("SELECT Name FROM nowhere", SCHEMA) == ["unreadable"] and verify.reasons("SELECT Name FROM singer", SCHEMA) == []


def test_exports():
    import scorelake

    assert all(getattr(scorelake, n) is not None for n in scorelake.__all__)
    with pytest.raises(AttributeError):
        scorelake.nothing


def test_foreign_key_maps():
    from scorelake.functions.sql.normal import foreign_key_maps

    entry = {"db_id": "d", "table_names_original": ["A", "B"], "column_names_original": [["-1", "*"], ["0", "Id"], ["1", "A_Id"]], "foreign_keys": [[2, 1]]}
    assert foreign_key_maps([entry]) == {"d": {"a.id": "a.id", "b.a_id": "a.id"}}


def test_spark_backend(spark):
    """The same verdicts as by SQLite on the same rows."""
    import sqlite3
    from collections import Counter

    from scorelake.operators.sql_match import exec_match_on_spark, match_on_spark, sql_match_on_spark
    from scorelake.sources.databases import run_query

    rows = [(1, "Ab", 1.5), (2, "b", None), (2, "b", 4.0), (5, "c'd", 2.0)]
    spark.createDataFrame(rows, "k int, name string, x double").createOrReplaceTempView("things")
    script = "create table things (k int, name text, x real);\n" + "\n".join("insert into things values ({}, '{}', {});".format(k, n.replace("'", "''"), "null" if x is None else x) for k, n, x in rows)
    pairs = [
        ("SELECT name FROM things", "SELECT name FROM things;"), ("SELECT DISTINCT name FROM things", "SELECT name FROM things"), ("SELECT k FROM things WHERE name LIKE 'aB'", "SELECT k FROM things WHERE k = 1"),
        ("SELECT k FROM things ORDER BY k DESC", "SELECT k FROM things ORDER BY k"), ("SELECT k / 2 FROM things", "SELECT (k - k % 2) / 2 FROM things"), ("SELECT k / 2 FROM things WHERE k = 5", "SELECT x FROM things WHERE k = 5"),
        ("SELECT x / 2 FROM things WHERE k = 5", "SELECT count(*) FROM things WHERE k = 5"), ("SELECT k / 0 FROM things", "SELECT k FROM things"), ("SELECT sum(k) / count(*) FROM things", "SELECT max(k) / 2 FROM things"),
        ("SELECT x FROM things", "SELECT x FROM things WHERE k > 0"), ("SELECT name FROM things WHERE k = 1", "SELECT k FROM things WHERE k = 1"), ("SELECT k, name FROM things", "SELECT k FROM things"),
        ("SELECT count(*) FROM things WHERE name LIKE '%/%'", "SELECT count(*) FROM things WHERE k > 9"),
    ]
    con = sqlite3.connect(":memory:", check_same_thread=False)
    con.executescript(script)
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, pred string, gold string")
    ours = {r["i"]: r["exec_match"] for r in sql_match_on_spark(df).collect()}
    for i, (p, g) in enumerate(pairs):
        a, b = run_query(con, p), run_query(con, g)
        assert ours[i] == (a == b if "ORDER" in g else Counter(a) == Counter(b)), (p, g)
    assert match_on_spark(spark, "SELECT nothing FROM things", "SELECT k FROM things") == (False, "invalid") and match_on_spark(spark, "SELECT", "SELECT k FROM things")[1] == "invalid"
    assert exec_match_on_spark(spark, "SELECT k / 2 FROM things", "SELECT (k - k % 2) / 2 FROM things")
    none = sql_match_on_spark(spark.createDataFrame([(None, "SELECT k FROM things")], "pred string, gold string")).first()
    assert (none["exec_match"], none["reason"]) == (False, "invalid")
    slow = "SELECT count(*) FROM (SELECT sum(sqrt(a.id + b.id)) FROM range(200000) a CROSS JOIN range(200000) b)"
    assert match_on_spark(spark, slow, "SELECT count(*) FROM things", timeout=2.0) == (False, "mismatch")


def test_prompt_ids(spark):
    plain, chat = (lambda: lambda text: [len(text)]), (lambda: lambda messages: [len(m["content"]) for m in messages])
    df = spark.createDataFrame([("a+", [("q", "s")], ["C", "CC"])], "p string, e array<struct<input:string,output:string>>, m array<string>")
    r = df.select(
        prompts.pattern_ids(F.col("p"), plain, system="S", shots=[("x", "y")]).alias("a"), prompts.pattern_ids(F.col("p"), chat, True, "S", [("x", "yy")]).alias("b"),
        prompts.sql_ids(F.col("e"), F.col("p"), chat, True, "S").alias("c"), prompts.molecule_ids(F.col("m"), plain, "S").alias("d"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ([len("S\nPattern: x\nOutput: y\na+")], [1, 1, 2, 2], [1, 1, 1, 2], [len("S\nMolecule: C\nMolecule: CC\nMolecule:")])
    with pytest.raises(ValueError):
        prompts.molecule_ids(F.col("m"), plain, "S", True)


def test_full_match_routes(spark):
    df = spark.createDataFrame([("ab",), ("é b",), ("a\nb",), (None,), ("",)], "t string")
    for pattern in ("[a-z ]+", "(?:ab|é b)?", ".*", r"\w+", "[^x]*", r"a\.b|ab"):
        want = [None if t is None else regexes.match_desc(pattern, t) == "valid" for (t,) in df.collect()]
        assert [r[0] for r in df.select(regexes.full_match(pattern, F.col("t"))).collect()] == want
