import json
import os

import pytest
from pyspark.sql import functions as F

from scorelake.functions.sql.normal import foreign_key_map
from scorelake.operators.evaluation import MoleculeEvaluator, PatternEvaluator, SqlEvaluator, nested_results, run_evaluation
from scorelake.operators.statistics import bootstrap_ci
from scorelake.sources.files import molecules_from_list, molecules_from_smiles, patterns_from_csv, patterns_from_list

CALLS = "/tmp/scorelake-test-calls"


def adaptor(instance, replicate):
    with open(CALLS, "a") as f:
        f.write("x")
    return {"responses": [{"response": "a", "weight": 0.5}, {"response": "b", "weight": 0.25}, {"response": "d", "weight": 0.25}], "runtime_seconds": 0.1}


@pytest.fixture
def calls():
    open(CALLS, "w").close()
    return lambda: os.path.getsize(CALLS)


def run(spark, out=None, **kw):
    r = run_evaluation(spark, patterns_from_list(spark, ["a|d", "b"]), adaptor, PatternEvaluator(), out, **kw)
    return r, r.summary.first()


def test_run_and_means(spark, calls):
    r, s = run(spark, n_replicates=3)
    assert (s["average_weighted_accuracy"], s["n_instances"]) == (0.5, 2)
    assert {x["instance_id"]: x["mean"] for x in r.instances.collect()} == {0: 0.75, 1: 0.25}
    lists = {x["instance_id"]: x for x in nested_results(r).collect()}
    assert len(lists[0]["results"]) == 3 and [y["desc"] for y in lists[0]["results"][0]["results"]] == ["valid", "invalid", "valid"]
    assert calls() == 6


def test_limit_keeps_one(spark, calls):
    assert run(spark, max_instances=0)[1]["n_instances"] == 1
    assert run(spark, max_instances=1)[1]["n_instances"] == 1


def test_flags_and_empty(spark):
    with pytest.raises(ValueError):
        run(spark, overwrite_outputs=True)
    with pytest.raises(ValueError):
        run_evaluation(spark, patterns_from_list(spark, []), adaptor, PatternEvaluator())


def test_cache(spark, calls, tmp_path):
    out = str(tmp_path / "c")
    run(spark, out)
    assert calls() == 2 and sorted(os.listdir(out)) == ["0-0-output.json", "0-0-results.json", "1-0-output.json", "1-0-results.json"]
    run(spark, out)
    assert calls() == 2  # both cached
    stored = json.load(open(f"{out}/0-0-results.json"))
    stored["weighted_accuracy"] = 0.0
    json.dump(stored, open(f"{out}/0-0-results.json", "w"))
    assert run(spark, out)[1]["average_weighted_accuracy"] == 0.125  # cached results hold
    assert run(spark, out, overwrite_results=True)[1]["average_weighted_accuracy"] == 0.5 and calls() == 2
    open(f"{out}/0-0-output.json", "w").write("{broken")
    stored["weighted_accuracy"] = 9.0
    json.dump(stored, open(f"{out}/0-0-results.json", "w"))
    assert run(spark, out)[1]["average_weighted_accuracy"] == 0.5 and calls() == 3  # a new output is scored anew
    os.remove(f"{out}/1-0-output.json")
    open(f"{out}/1-0-results.json", "w").write("no json")
    assert run(spark, out)[1]["n_instances"] == 2 and calls() == 4
    assert json.load(open(f"{out}/1-0-results.json"))["weighted_accuracy"] == 0.25
    assert run(spark, out, overwrite_outputs=True, overwrite_results=True)[1]["n_instances"] == 2 and calls() == 6


def test_molecules(spark):
    def two(instance, replicate):
        return {"responses": [{"response": "23r", "weight": 0.5}, {"response": " CCO\n", "weight": 0.5}]}

    s = run_evaluation(spark, molecules_from_list(spark, [["C"], ["CC"]]), two, MoleculeEvaluator()).summary.first()
    assert s["average_weighted_accuracy"] == 0.5


def test_sql(spark):
    script = "create table singer (singer_id int, name text, age int);\ninsert into singer values (1, 'A', 30), (2, 'B', 20);"
    inst = spark.createDataFrame([(0, "db", "SELECT count(*) FROM singer")], "instance_id bigint, schema_name string, gold string")

    def answers(instance, replicate):
        return {"responses": [{"response": "SELECT count(*) FROM singer", "weight": 0.5}, {"response": "SELECT count(*) FROM siner", "weight": 0.5}]}

    r = run_evaluation(spark, inst, answers, SqlEvaluator({"db": script}, {"db": {}}))
    assert r.summary.first()["average_weighted_accuracy"] == 0.5
    found = r.results.first()["result"]["results"]
    assert [(x["score"], x["desc"], x["metadata"]["level"]) for x in found] == [(1.0, "valid", "easy"), (0.0, "invalid", None)]


def test_sources(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('pattern,n\n"a,b ""q""",1\nNA,2\n\\d+,3\n')
    assert [r["pattern"] for r in patterns_from_csv(spark, str(p), "pattern").orderBy("instance_id").collect()] == ['a,b "q"', "NA", "\\d+"]
    with pytest.raises(KeyError):
        patterns_from_csv(spark, str(p), "none")
    m = tmp_path / "m.txt"
    m.write_text("\n".join(f"C{'C' * i}" for i in range(30)) + "\n")
    drawn = molecules_from_smiles(spark, str(m), 5, 3, seed=1).collect()
    assert len(drawn) == 3 and all(len(set(r["molecules"])) == 5 and r["molecules"][0].endswith("\n") for r in drawn)
    import random

    g = random.Random(1)
    assert {r["instance_id"]: r["molecules"][0] for r in drawn} == {i: "C" + "C" * g.sample(range(30), 5)[0] + "\n" for i in range(3)}
    with pytest.raises(ValueError):
        molecules_from_smiles(spark, str(m), 31, 1)


def test_spider_folder(spark, tmp_path):
    from scorelake.operators.datasets import sql_dataset

    (tmp_path / "tables.json").write_text(json.dumps([{"db_id": "d", "table_names": ["one"], "table_names_original": ["One"], "column_names": [[-1, "*"], [0, "a b"]], "column_names_original": [[-1, "*"], [0, "A"]], "column_types": ["text", "number"], "primary_keys": [1], "foreign_keys": []}]))
    data = [{"db_id": "d", "question": "How many?", "query": "SELECT count(*) FROM One", "sql": {}}] * 2
    for f in ("dev.json", "train_spider.json"):
        (tmp_path / f).write_text(json.dumps(data))
    rows = sql_dataset(spark, str(tmp_path), None, [1, 0]).orderBy("instance_id").collect()
    assert len(rows) == 2 and rows[0]["schema_str"] == "One\n* A (number): a b" and rows[0]["lark_grammar"] is None
    assert len(rows[0]["few_shot_examples"]) == 2 and rows[0]["user_message"].startswith("Here is a database schema:\nOne\n")
    with pytest.raises(IndexError):
        sql_dataset(spark, str(tmp_path))


def test_json_sources(spark, tmp_path):
    from scorelake.sources.files import grammars, parser_schema, raw_json

    (tmp_path / "g.json").write_text(json.dumps({"d": "start: /a/\n", "e": "start: \"x\""}, indent=2))
    assert {(r["schema_name"], r["lark_grammar"]) for r in grammars(spark, str(tmp_path / "g.json")).collect()} == {("d", "start: /a/\n"), ("e", 'start: "x"')}
    assert grammars(spark, None).count() == 0
    (tmp_path / "p.json").write_text(json.dumps([{"table": "One", "col_data": [{"column_name": "A"}, {"column_name": "b"}]}]))
    assert parser_schema(str(tmp_path / "p.json")) == {"one": ["a", "b"]} and raw_json(spark, str(tmp_path / "p.json")).first()["table"] == "One"


def test_bootstrap(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "x double")
    m, lo, hi = bootstrap_ci(df, "x", "mean", n_bootstrap=300)
    assert m == 3 and lo <= 3 <= hi
    narrow, wide = (bootstrap_ci(df, "x", "mean", ci, 300) for ci in (0.9, 0.99))
    assert narrow[2] - narrow[1] < wide[2] - wide[1]
    assert bootstrap_ci(df, "x", "median", n_bootstrap=100)[0] == 3
    assert 1 < bootstrap_ci(df, "x", "std", n_bootstrap=100)[0] < 2
    assert bootstrap_ci(df, "x", lambda a: float(a.max()), n_bootstrap=50)[0] == 5
    assert bootstrap_ci(df.where("x = 4"), "x", n_bootstrap=50) == (4, 4, 4)
    with pytest.raises(ValueError):
        bootstrap_ci(df, "x", ci=1.5)
    with pytest.raises(ValueError):
        bootstrap_ci(df.where("x > 9"), "x")


def test_fk_sets_stay_apart():
    found = foreign_key_map(["t"], [(-1, "*"), (0, "a"), (0, "b"), (0, "c"), (0, "d")], [(2, 1), (4, 3), (3, 2)])
    assert found["t.a"] == found["t.b"] == "t.a" and found["t.d"] == found["t.c"]


def test_stream(spark, tmp_path):
    from scorelake.streaming.scoring import first_deliveries, response_stream, score_stream

    rows = [(1, "a", 1.0, "2024-01-01 00:00:00"), (1, "a", 1.0, "2024-01-02 00:00:00"), (2, "b", 0.5, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "response_id bigint, response string, weight double, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = first_deliveries(response_stream(spark, str(tmp_path / "in"), df.schema), "response_id", "at", "30 days")
    score_stream(stream, lambda b: b.withColumn("score", F.length("response")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["response_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_schema_details_and_values(spark, tmp_path):
    import sqlite3

    from scorelake.sources.schemas import load_schemas, schema_values

    entry = [{"db_id": "d", "table_names": ["one"], "table_names_original": ["One"], "column_names": [[-1, "*"], [0, "a"], [0, "b"]], "column_names_original": [[-1, "*"], [0, "A"], [0, "B"]], "column_types": ["text", "text", "number"], "primary_keys": [1], "foreign_keys": []}]
    (tmp_path / "tables.json").write_text(json.dumps(entry + [entry[0] | {"db_id": "absent"}]))
    (tmp_path / "database" / "d").mkdir(parents=True)
    con = sqlite3.connect(tmp_path / "database" / "d" / "d.sqlite")
    con.executescript("create table One (A, B int); insert into One values ('x', 1), ('x', 2), ('10:20:30', 3), ('a:b', 4), (null, 5), (x'e9', 6), (x'c3a9', 7);")
    con.commit()
    con.close()
    schemas = load_schemas(spark, str(tmp_path / "tables.json"), str(tmp_path / "database"))
    assert sorted(r["schema_name"] for r in schemas.collect()) == ["absent", "d"]
    found = schema_values(schemas, str(tmp_path / "database")).collect()
    assert sorted((r["column_name"], r["value"]) for r in found) == [("A", "a:b"), ("A", "x"), ("A", "é")]
    details = {"e": {"name": "e", "tables": [{"name": "T", "nl_name": "t", "columns": [{"name": "C", "tpe": "text", "nl_name": "c"}]}], "primary_keys": [1]}}
    (tmp_path / "database" / "db_schema_details.json").write_text(json.dumps(details))
    r = load_schemas(spark, str(tmp_path / "tables.json"), str(tmp_path / "database")).collect()
    assert [(x["schema_name"], x["tables"][0]["columns"][0]["name"]) for x in r] == [("e", "C")]


def test_statement_timeout():
    import sqlite3
    import time

    from scorelake.sources.databases import run_query

    began = time.time()
    with pytest.raises(sqlite3.OperationalError):
        run_query(sqlite3.connect(":memory:", check_same_thread=False), "with recursive c(x) as (select 1 union all select x + 1 from c) select count(*) from c", 0.3)
    assert time.time() - began < 5


def test_unknown_column_type(spark, tmp_path):
    from scorelake.sources.files import schema_columns, schema_entries

    (tmp_path / "t.json").write_text(json.dumps([{"db_id": "d", "table_names": ["t"], "table_names_original": ["t"], "column_names": [[0, "a"]], "column_names_original": [[0, "a"]], "column_types": ["blob"], "primary_keys": [], "foreign_keys": []}]))
    with pytest.raises(Exception, match="unknown column type"):
        schema_columns(schema_entries(spark, str(tmp_path / "t.json"))).collect()


class Output:
    def __init__(self, text):
        self.responses, self.runtime_seconds, self.metadata = [{"response": text, "weight": 1.0}], 0.5, {"by": "test"}


def test_async_adaptor(spark, tmp_path):
    """Calls of one task run at the same time, no more than the bound, and get the folder; outputs may be objects."""
    log = tmp_path / "log"

    async def slow(instance, output_dir, replicate):
        import asyncio

        with open(log, "a") as f:
            f.write("+")
        await asyncio.sleep(0.3)
        with open(log, "a") as f:
            f.write("-")
        return Output("a" if output_dir == str(tmp_path / "out") else "no folder")

    work = patterns_from_list(spark, ["a"] * 9).coalesce(1)
    r = run_evaluation(spark, work, slow, PatternEvaluator(), str(tmp_path / "out"), concurrency=3)
    assert r.summary.first()["average_weighted_accuracy"] == 1
    open_, most = 0, 0
    for c in log.read_text():
        open_ += 1 if c == "+" else -1
        most = max(most, open_)
    assert 1 < most <= 3 * work.rdd.getNumPartitions() and log.read_text().count("+") == 9


def test_stores(spark, calls, tmp_path):
    from scorelake.operators.evaluation import JsonStore, TableStore, copied

    table, files = TableStore(str(tmp_path / "t")), JsonStore(str(tmp_path / "j"))
    assert table.read(spark, "output").count() == files.read(spark, "results").count() == 0
    run(spark, table, n_replicates=2)
    assert calls() == 4 and run(spark, table, n_replicates=2)[1]["average_weighted_accuracy"] == 0.5 and calls() == 4
    copied(spark, table, files)
    assert len(os.listdir(tmp_path / "j")) == 8 and run(spark, files, n_replicates=2)[1]["n_instances"] == 2 and calls() == 4
    assert run(spark, table, n_replicates=2, overwrite_outputs=True, overwrite_results=True)[1]["n_instances"] == 2 and calls() == 8
    assert table.read(spark, "output").count() == 4


def test_hash_sample(spark):
    from scorelake.sources.files import hash_sample

    df = spark.range(20_000).withColumnRenamed("id", "k")
    got = hash_sample(df, "k", 3, 5, seed=2).collect()
    every = df.crossJoin(spark.range(3).withColumnRenamed("id", "instance_id")).withColumn("h", F.xxhash64(F.lit(2), "instance_id", "k")).toPandas().sort_values(["instance_id", "h"])
    want = {(i, pos, k) for i, part in every.groupby("instance_id") for pos, k in enumerate(part["k"].head(5))}
    assert {(r["instance_id"], r["pos"], r["row_id"]) for r in got} == want
    assert hash_sample(df.limit(3), "k", 2, 5).count() == 6 and hash_sample(df.limit(0), "k", 2, 5).count() == 0
