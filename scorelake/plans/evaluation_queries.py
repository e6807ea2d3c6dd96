"""Queries of the evaluation dataflow: scans, scoring, averages, caching, prompts, statistics, streams."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import prompts, regexes, smiles, texts
from scorelake.operators.datasets import sql_instances
from scorelake.operators.evaluation import RunResult, TableStore, TextEvaluator, instance_means, limited, nested_results, replicated, run_evaluation, running_mean
from scorelake.operators.lru import LRUCache
from scorelake.operators.sql_match import sql_match_on_spark
from scorelake.operators.statistics import METRICS, interval, resampled
from scorelake.session import checkpoint_dir, read
from scorelake.sources.files import distinct_values, grammars, hash_sample, molecules_from_smiles, patterns_from_csv, schema_entries, schema_tables, sql_examples, with_ordinal, without_times
from scorelake.streaming.scoring import complete_table, first_deliveries, per_period, response_stream

PATTERNS = ["[a-z]+ [a-z]+", "(?:blue|green|red) .*", ".*[aeiou]{2}.*", "[^x]+", "\\w+ \\w+"]
UDF_PATTERN = r".*(\w)\1.*"

def deliveries(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each response once, the named columns of its latest delivery; others, such as long texts, aren't shuffled."""
    r = read(s, d, "model_response")
    return r.groupBy("response_id").agg(F.max_by(F.struct(*columns), "loaded_at").alias("r")).select("response_id", "r.*")

def results(s: SparkSession, d: str) -> DataFrame:
    r = read(s, d, "evaluation_result")
    return r.groupBy("response_id").agg(F.max_by(F.struct("score", "reason"), "evaluated_at").alias("r")).select(F.col("response_id").alias("scored_id"), "r.*")

def ensembles(s: SparkSession, d: str) -> DataFrame:
    """instance_id, replicate, result.weighted_accuracy over stored responses and scores; a missing weight or score counts 0."""
    scored = deliveries(s, d, "instance_id", "replicate", "weight").join(results(s, d), F.col("response_id") == F.col("scored_id"), "left")
    total = F.sum(F.coalesce("score", F.lit(0.0)) * F.coalesce("weight", F.lit(0.0)))
    return scored.groupBy("instance_id", "replicate").agg(F.struct(total.alias("weighted_accuracy")).alias("result"), F.count("*").alias("n_responses"))

def ensemble_weighted_accuracy(s: SparkSession, d: str) -> DataFrame:
    return ensembles(s, d).select("instance_id", "replicate", F.round("result.weighted_accuracy", 6).alias("weighted_accuracy"), "n_responses")

def instance_mean(s: SparkSession, d: str) -> DataFrame:
    return instance_means(ensembles(s, d), 3).select("instance_id", F.round("mean", 6).alias("mean"))

def macro_average(s: SparkSession, d: str) -> DataFrame:
    return instance_means(ensembles(s, d), 3).agg(F.round(F.avg("mean"), 6).alias("average_weighted_accuracy"), F.count("*").alias("n_instances"))

def stored_outputs(s: SparkSession, d: str) -> DataFrame:
    """The stored responses as outputs, beside their instance's gold query; a null weight counts 0, a null response is empty."""
    one = F.struct("response_no", F.struct(F.coalesce("response", F.lit("")).alias("response"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(None).cast("map<string,string>").alias("metadata")).alias("r"))
    together = deliveries(s, d, "instance_id", "replicate", "response_no", "response", "weight").where("instance_id is not null").groupBy("instance_id", "replicate").agg(F.collect_list(one).alias("rs"))
    responses = F.transform(F.array_sort("rs", lambda a, b: a["response_no"] - b["response_no"]), lambda x: x["r"])
    output = F.struct(responses.alias("responses"), F.lit(0.5).alias("runtime_seconds"), F.lit(None).cast("map<string,string>").alias("metadata"))
    gold = read(s, d, "spider_instance").select(F.col("instance_id").alias("g"), "gold")
    return together.select("instance_id", "replicate", output.alias("output")).join(gold, F.col("instance_id") == F.col("g")).drop("g")


def ensemble_replay(s: SparkSession, d: str) -> DataFrame:
    """Stored outputs scored by an evaluator, weighted in the order of the responses."""
    r = TextEvaluator().ensembles(stored_outputs(s, d))
    return r.select("instance_id", "replicate", F.round("result.weighted_accuracy", 6).alias("weighted_accuracy"), "result.runtime_seconds", F.size("result.results").alias("n_results"))


def evaluation_run(s: SparkSession, d: str) -> DataFrame:
    """A whole run, five replicates, with an adaptor that gives out each instance's stored responses."""
    stored = stored_outputs(s, d).select(F.col("instance_id").alias("i"), F.struct("replicate", "output").alias("o"))
    lists = stored.groupBy("i").agg(F.to_json(F.collect_list("o")).alias("stored"))
    instances = read(s, d, "spider_instance").select("instance_id", F.col("instance_id").alias("instance_ord"), "gold").join(lists, F.col("instance_id") == F.col("i"), "left").drop("i")

    async def replay(instance: dict, output_dir: str | None, replicate: int) -> dict:
        outputs = {x["replicate"]: x["output"] for x in json.loads(instance["stored"] or "[]")}
        return outputs.get(replicate, {"responses": []})

    return run_evaluation(s, instances, replay, TextEvaluator(), n_replicates=5).summary.select(F.round("average_weighted_accuracy", 6).alias("average_weighted_accuracy"), "n_instances")


def store_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Stored outputs written to a table twice, the second time with other runtimes, and read back: the later ones hold."""
    store = TableStore(f"{checkpoint_dir(s)}/store-{uuid.uuid4().hex}")
    first = stored_outputs(s, d).select("instance_id", "replicate", F.col("output").alias("value"))
    store.write(first, "output")
    store.write(first.where("replicate = 1").withColumn("value", F.col("value").withField("runtime_seconds", F.lit(2.0))), "output")
    found = store.read(s, "output")
    return found.select(F.col("instance_id").cast("bigint").alias("instance_id"), "replicate", "value.runtime_seconds", F.size("value.responses").alias("n_responses"), F.md5(F.array_join(F.array_sort(F.transform("value.responses", lambda r: r["response"])), "|")).alias("responses_md5"))


def cached_run(s: SparkSession, d: str) -> DataFrame:
    """A run that finds its outputs and results in a store: how many of either are there, and the same summary."""
    store = TableStore(f"{checkpoint_dir(s)}/store-{uuid.uuid4().hex}")
    outputs = stored_outputs(s, d)
    store.write(outputs.select("instance_id", "replicate", F.col("output").alias("value")), "output")
    instances = outputs.groupBy("instance_id").agg(F.first("gold").alias("gold")).withColumn("instance_ord", F.col("instance_id"))

    def nothing(instance: dict, replicate: int) -> dict:
        return {"responses": []}

    first = run_evaluation(s, instances, nothing, TextEvaluator(), store, n_replicates=5)
    again = run_evaluation(s, instances, nothing, TextEvaluator(), store, n_replicates=5)
    kept = store.read(s, "results").agg(F.count("*").alias("n_results"), F.sum(F.size("value.results")).alias("n_scored"))
    both = first.summary.select(F.round("average_weighted_accuracy", 6).alias("first_average")).crossJoin(again.summary.select(F.round("average_weighted_accuracy", 6).alias("second_average"), "n_instances"))
    return both.crossJoin(kept)  # a row each


def results_by_instance(s: SparkSession, d: str) -> DataFrame:
    """The lists of results and outputs of every instance, in the order of replicates."""
    outputs = stored_outputs(s, d)
    scored = TextEvaluator().ensembles(outputs)
    lists = nested_results(RunResult(outputs.limit(0), outputs.limit(0), scored, outputs.select("instance_id", "replicate", "output")))
    return lists.select("instance_id", F.size("results").alias("n_replicates"), F.transform("results", lambda r: F.size(r["results"])).cast("string").alias("n_results"), F.transform("outputs", lambda o: F.size(o["responses"])).cast("string").alias("n_responses"))


def code_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts from their code points."""
    codes = F.transform(F.split("n_name", ""), lambda c: F.ascii(c))
    return read(s, d, "nation").select("n_nationkey", texts.text_of_codes(codes).alias("name"))


def byte_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts from bytes, some of which are no UTF-8, without one leading space."""
    raw = F.concat(F.lit(b" "), F.lit(b" "), F.col("p_name").cast("binary"), F.unhex(F.lit("80")))
    return read(s, d, "part").select("p_partkey", texts.text_of_bytes(raw).alias("name"))


def molecules(s: SparkSession, d: str) -> DataFrame:
    """p_partkey, kind, smiles: a string made for every part, of whose kind and length its validity follows."""
    n, k = F.col("p_size").cast("int"), F.pmod("p_partkey", F.lit(8)).cast("int")
    chain = F.repeat(F.lit("C"), n)
    forms = [chain, F.concat(F.lit("C1C"), chain, F.lit("C1")), F.concat(chain, F.lit("(=O)O")), F.concat(F.lit("OC("), chain), F.concat(chain, F.lit(")")), F.concat(F.lit("C(C)(C)(C)(C)"), chain), F.concat(F.lit("C1"), chain), F.concat(F.lit("[NH3+]"), chain, F.lit("c1ccccc1"))]
    return read(s, d, "part").select("p_partkey", k.alias("kind"), F.element_at(F.array(*forms), k + 1).alias("smiles"))


def smiles_prefix(s: SparkSession, d: str) -> DataFrame:
    return molecules(s, d).select("p_partkey", (smiles.prefix_weight(F.col("smiles")) == 0).alias("allowed"))


def smiles_valid(s: SparkSession, d: str) -> DataFrame:
    return molecules(s, d).select("p_partkey", (smiles.complete_weight(F.col("smiles")) == 0).alias("allowed"))


def molecule_score(s: SparkSession, d: str) -> DataFrame:
    """Molecules with a blank before and a line end after them."""
    made = molecules(s, d).select("p_partkey", F.concat(F.lit(" "), "smiles", F.lit("\n")).alias("response"))
    return smiles.molecule_scores(made, "response").select("p_partkey", "score", "desc")


def lru_trace(s: SparkSession, d: str) -> DataFrame:
    """What a cache of two objects makes over every user's events in their order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []

        class Traced(LRUCache):
            def create(self, key: str) -> str:
                made[-1] = True
                return key

            def cleanup(self, key: str, obj: str) -> None:
                pass

        cache = Traced(2)
        for key in pdf.sort_values(["ts", "event_id"])["event_type"]:
            made.append(False)
            cache.get(key)
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "n_events": [len(made)], "n_made": [sum(made)]})

    events = read(s, d, "events").where("user_id is not null and event_type is not null").select("user_id", "ts", "event_id", "event_type")
    return events.groupBy("user_id").applyInPandas(fold, "user_id bigint, n_events bigint, n_made bigint")


def scan_patterns(s: SparkSession, d: str) -> DataFrame:
    from scorelake.sources.files import patterns_from_list

    return patterns_from_list(s, PATTERNS)

def pattern_answers(s: SparkSession, d: str) -> DataFrame:
    """Every part name as an answer to every pattern."""
    from scorelake.sources.files import patterns_from_list

    p = read(s, d, "part").select("p_partkey", F.col("p_name").alias("response"))
    return p.crossJoin(F.broadcast(patterns_from_list(s, PATTERNS)))  # five patterns

def regex_fullmatch_score(s: SparkSession, d: str) -> DataFrame:
    scored = regexes.score_patterns(pattern_answers(s, d), "pattern", "response")
    return scored.groupBy("instance_id").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.sum((F.col("desc") == "valid").cast("int")).alias("n_valid"))

def regex_udf_score(s: SparkSession, d: str) -> DataFrame:
    scored = regexes.score_patterns(read(s, d, "part").withColumn("pattern", F.lit(UDF_PATTERN)), "pattern", "p_name")
    return scored.select("p_partkey", "score", "desc")

def regex_critic_complete(s: SparkSession, d: str) -> DataFrame:
    w = regexes.complete_weight("[a-z ]+", F.col("p_name"))
    return read(s, d, "part").select("p_partkey", (w == 0).alias("allowed"))

def regex_critic_prefix(s: SparkSession, d: str) -> DataFrame:
    w = regexes.prefix_weight(F.lit("[a-m][a-z]* [a-z]+ [a-z]+"), F.col("p_name"))
    return read(s, d, "part").select("p_partkey", (w == 0).alias("allowed"))

def replicate_cross(s: SparkSession, d: str) -> DataFrame:
    return replicated(read(s, d, "spider_instance").select("instance_id"), 3)

def max_instances(s: SparkSession, d: str) -> DataFrame:
    numbered = read(s, d, "spider_instance").select("instance_id", F.col("instance_id").alias("instance_ord"))
    return limited(numbered, 20).select("instance_id").union(limited(numbered, 0).select(F.col("instance_id") - 1000))

def cache_miss_plan(s: SparkSession, d: str) -> DataFrame:
    """(instance, replicate) without a stored response."""
    work = replicated(read(s, d, "spider_instance").select("instance_id"), 3)
    return work.join(read(s, d, "model_response").select("instance_id", "replicate"), ["instance_id", "replicate"], "left_anti")

def eval_needed(s: SparkSession, d: str) -> DataFrame:
    """Responses without a stored result."""
    known = results(s, d).select("scored_id")
    return deliveries(s, d, "instance_id").join(known, F.col("response_id") == F.col("scored_id"), "left_anti").select("response_id")

def running_means(s: SparkSession, d: str) -> DataFrame:
    per = read(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("mean"))
    return running_mean(per, "month").select("month", F.round("running_mean", 4).alias("running_mean"))

def user_messages(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "spider_instance")
    return x.select("instance_id", F.md5(prompts.user_message(F.coalesce("schema_str", F.lit("")), F.col("utterance"))).alias("message_md5"))

def schema_serialize(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "spider_instance").select("instance_id", F.md5(prompts.serialize_schema(F.col("tables"))).alias("schema_md5"))

def chat_messages(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "spider_instance")
    m = prompts.chat_messages(F.lit("S"), F.coalesce("few_shot_examples", prompts.examples([])), F.col("utterance"))
    return x.select("instance_id", F.posexplode(m).alias("pos", "m")).select("instance_id", "pos", "m.role", F.md5(F.coalesce("m.content", F.lit(""))).alias("content_md5"))

def sql_prompts(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "spider_instance")
    p = prompts.sql_prompt(F.coalesce("few_shot_examples", prompts.examples([])), F.col("utterance"), "S")
    return x.select("instance_id", F.md5(p).alias("prompt_md5"))

def pattern_prompts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select("p_partkey", prompts.pattern_prompt(F.col("p_name"), "S", [("a+", "aa"), ("b|c", "c")]).alias("prompt"))

def molecule_prompts(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("m"))
    return x.select("n_regionkey", prompts.molecule_prompt(F.col("m"), "S").alias("prompt"))

def few_shot_select(s: SparkSession, d: str) -> DataFrame:
    """Instances with their examples by number, from a positional list."""
    ids = [10, 0, 25]
    ordered = with_ordinal(read(s, d, "region").unionByName(read(s, d, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))).orderBy("r_name", "r_regionkey"), "at")
    wanted = s.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, wanted bigint")
    return ordered.join(F.broadcast(wanted), F.col("at") == F.col("wanted")).select("pos", "r_name")

def spider_datum(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "dev").select(F.col("example_id").alias("instance_id"), F.col("db_id").alias("schema_name"), F.col("question").alias("utterance"), "query")

def spider_instances(s: SparkSession, d: str) -> DataFrame:
    """Examples joined with the schema of their database; those without one are left out and counted by the oracle alike."""
    tables = read(s, d, "spider_instance").where("schema_name is not null").groupBy("schema_name").agg(F.max(F.size("tables")).alias("n_tables"))
    return spider_datum(s, d).join(tables, "schema_name").select("instance_id", "schema_name", "n_tables")

def schema_columns(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "spider_instance").select("schema_name", F.explode("tables").alias("t")).select("schema_name", F.col("t.name").alias("table_name"), F.explode("t.columns").alias("c"))
    return x.select("schema_name", "table_name", F.col("c.name").alias("column_name"), "c.tpe", "c.nl_name").distinct()

def smiles_sample(s: SparkSession, d: str) -> DataFrame:
    """Three samples of ten documents each: sizes and distinctness, as the hash itself is Spark's own."""
    drawn = hash_sample(read(s, d, "documents"), "doc_id", 3, 10, 7)
    return drawn.groupBy("instance_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_distinct"), F.max("pos").alias("last_pos"))

def column_picklist(s: SparkSession, d: str) -> DataFrame:
    return distinct_values(read(s, d, "events"), "event_type")

def picklist_no_times(s: SparkSession, d: str) -> DataFrame:
    """The picklist of the responses, those with two colons left out."""
    return without_times(distinct_values(read(s, d, "model_response"), "response")).select(F.md5("value").alias("value_md5"))


def pattern_file(s: SparkSession, d: str) -> DataFrame:
    """Part names written as a CSV column with quotes and commas, and read back as patterns."""
    path = f"{checkpoint_dir(s)}/patterns-{uuid.uuid4().hex}"
    names = read(s, d, "part").select(F.concat(F.lit('"'), "p_name", F.lit(', "'), "p_brand").alias("regex"), F.col("p_size").alias("n"))
    names.write.option("escape", '"').option("quoteAll", True).csv(path, header=True)
    found = patterns_from_csv(s, path, "regex")
    return found.groupBy("pattern").agg(F.count("*").alias("n_rows"), F.count_distinct("instance_id").alias("n_ids"))


def molecule_lines(s: SparkSession, d: str) -> DataFrame:
    """Molecules of the parts written as lines, and drawn from by Python's generator: lists of distinct lines."""
    path = f"{checkpoint_dir(s)}/lines-{uuid.uuid4().hex}"
    read(s, d, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).write.text(path)
    drawn = molecules_from_smiles(s, path, 20, 50, seed=1234, keep_line_ends=False)
    return drawn.select("instance_id", F.size("molecules").alias("n"), F.size(F.array_distinct("molecules")).alias("n_distinct"), F.forall("molecules", lambda m: m.rlike("^C[0-9]+$")).alias("sound"))


def sql_folder(s: SparkSession, d: str) -> DataFrame:
    """A folder of examples and schemas, one JSON document a file as its format asks, read back as instances."""
    path = f"{checkpoint_dir(s)}/folder-{uuid.uuid4().hex}"
    known = read(s, d, "spider_instance").where("schema_name is not null and tables is not null").groupBy("schema_name").agg(F.min_by("tables", "instance_id").alias("tables"))
    each = lambda f: F.flatten(F.transform("tables", lambda t, i: F.transform(t["columns"], lambda c: f(t, i, c))))
    star = F.array(F.array(F.lit("-1"), F.lit("*")))
    schema = F.struct(
        F.col("schema_name").alias("db_id"), F.transform("tables", lambda t: t["nl_name"]).alias("table_names"), F.transform("tables", lambda t: t["name"]).alias("table_names_original"),
        F.concat(star, each(lambda t, i, c: F.array(i.cast("string"), c["nl_name"]))).alias("column_names"), F.concat(star, each(lambda t, i, c: F.array(i.cast("string"), c["name"]))).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), each(lambda t, i, c: c["tpe"])).alias("column_types"), F.array().cast("array<bigint>").alias("primary_keys"), F.array().cast("array<array<bigint>>").alias("foreign_keys"),
    )
    example = F.struct(F.col("schema_name").alias("db_id"), F.col("utterance").alias("question"), F.col("gold").alias("query"))
    known.select(schema.alias("x")).agg(F.to_json(F.collect_list("x"))).write.text(f"{path}/tables")
    for name in ("dev", "train"):
        stored = read(s, d, "spider_instance").select("schema_name", "utterance", "gold", "instance_id").join(known.select(F.col("schema_name").alias("k")), F.col("schema_name") == F.col("k"))
        stored.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("instance_id", example.alias("e")))), lambda x: x["e"]))).write.text(f"{path}/{name}")
    dev, train = (sql_examples(s, f"{path}/{name}") for name in ("dev", "train"))
    tables = schema_tables(schema_entries(s, f"{path}/tables"))
    found = sql_instances(dev, tables, train, grammars(s, None), [10, 0, 25])
    shots = F.array_join(F.transform("few_shot_examples", lambda e: F.concat_ws("#", e["input"], e["output"])), "|")
    return found.select("instance_id", "schema_name", F.md5("user_message").alias("message_md5"), F.md5(shots).alias("shots_md5"))


def grammar_file(s: SparkSession, d: str) -> DataFrame:
    """The grammars of the schemas written as one JSON map, and read back."""
    path = f"{checkpoint_dir(s)}/grammars-{uuid.uuid4().hex}"
    known = read(s, d, "spider_instance").where("schema_name is not null and lark_grammar is not null").groupBy("schema_name").agg(F.min("lark_grammar").alias("g"))
    known.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("schema_name", "g"))))).write.text(path)
    return grammars(s, path).select("schema_name", F.md5("lark_grammar").alias("grammar_md5"))


def sql_exec_spark(s: SparkSession, d: str) -> DataFrame:
    """Queries of the subset over the largest tables, run by Spark: what must match, what must not, and what can't be read."""
    for name in ("nation", "customer", "orders"):
        read(s, d, name).createOrReplaceTempView(name)
    return sql_match_on_spark(s.createDataFrame(SPARK_PAIRS, "id int, pred string, gold string"), timeout=120.0).select("id", "exec_match", "reason")


#: id, query, gold query; matches are those of odd numbers.
SPARK_PAIRS = [
    (1, "SELECT count(*) FROM orders", "SELECT count(o_orderkey) FROM orders"),
    (2, "SELECT count(*) FROM orders WHERE o_custkey > 5", "SELECT count(*) FROM orders"),
    (3, "SELECT o_custkey / 2 FROM orders", "SELECT (o_custkey - o_custkey % 2) / 2 FROM orders"),
    (4, "SELECT o_totalprice / 2 FROM orders", "SELECT o_custkey / 2 FROM orders"),
    (5, "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(1.0) FROM orders GROUP BY o_orderstatus"),
    (6, "SELECT nothing FROM orders", "SELECT o_custkey FROM orders"),
    (7, "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'building'", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    (8, "SELECT c_custkey FROM customer ORDER BY c_custkey DESC", "SELECT c_custkey FROM customer ORDER BY c_custkey"),
    (9, "SELECT c_custkey FROM customer ORDER BY c_custkey ASC;", "SELECT c_custkey FROM customer ORDER BY c_custkey"),
    (10, "SELECT DISTINCT o_custkey FROM orders", "SELECT o_custkey FROM orders"),
    (11, "SELECT n_name FROM nation WHERE n_nationkey / 0 = 1", "SELECT n_name FROM nation WHERE n_nationkey < 0"),
]


def subquery_extract(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "train_spider").where("query is not null").select("example_id", texts.latest_subquery(F.col("query")).alias("subquery"))

def boundary_strip(s: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.col("query"), F.element_at(F.array(F.lit(" WHERE"), F.lit(" GROUP BY"), F.lit(" ORDER"), F.lit("")), (F.pmod("example_id", F.lit(4)) + 1).cast("int")))
    return read(s, d, "train_spider").where("query is not null").select("example_id", texts.stripped_at_boundary(q).alias("stripped"))

def utf8_guard(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.pmod("example_id", F.lit(3)) == 0, F.unhex(F.lit("808080"))).otherwise(F.col("query").cast("binary"))
    return read(s, d, "dev").where("query is not null").select("example_id", texts.is_utf8(raw).alias("sound"))

def _index(b, i, n):
    return F.pmod(b * 7919 + i * 104729 + b * i * 31, n)

def _bootstrap(s: SparkSession, d: str, metric: str) -> DataFrame:
    values = with_ordinal(read(s, d, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_suppkey"), "pos")
    n = values.count()
    near = lambda c: F.round(c + F.lit(1e-7), 4)  # noqa: E731 - exact halves, common among means of cents, round up in either engine
    whole = values.agg(near(METRICS[metric]("s_acctbal")).alias("metric"))
    bounds = interval(resampled(values, "s_acctbal", 200, _index, n), metric, 0.95)
    return whole.crossJoin(bounds).select("metric", near(F.col("lower")).alias("lower"), near(F.col("upper")).alias("upper"))

def bootstrap_mean(s: SparkSession, d: str) -> DataFrame:
    return _bootstrap(s, d, "mean")

def bootstrap_median(s: SparkSession, d: str) -> DataFrame:
    return _bootstrap(s, d, "median")

def bootstrap_std(s: SparkSession, d: str) -> DataFrame:
    return _bootstrap(s, d, "std")

def stream_periods(s: SparkSession, d: str) -> DataFrame:
    """Responses per week of creation, from a stream that drops repeated deliveries; late rows are counted in their week."""
    path = f"{d}/model_response.parquet*"
    schema = read(s, d, "model_response").schema
    arrived = response_stream(s, path, schema).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = first_deliveries(arrived, "response_id", "created_at", "3650 days")
    out = f"{checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"
    complete_table(per_period(stream, "created_at", "7 days"), out + "/table", out + "/state").awaitTermination()
    return s.read.parquet(out + "/table").select(F.col("period_start").cast("timestamp_ntz").alias("period_start"), "n_rows")

QUERIES = {
    f.__name__: f
    for f in (
        smiles_prefix, smiles_valid, lru_trace, store_round_trip, cached_run, results_by_instance, pattern_file, molecule_lines, sql_folder, grammar_file, sql_exec_spark, scan_patterns, regex_fullmatch_score, regex_udf_score, regex_critic_complete, regex_critic_prefix, ensemble_weighted_accuracy, instance_mean, macro_average, replicate_cross, max_instances,
        cache_miss_plan, eval_needed, ensemble_replay, evaluation_run, code_texts, byte_texts, molecule_score, user_messages, schema_serialize, chat_messages, sql_prompts, pattern_prompts, molecule_prompts, few_shot_select, spider_datum, spider_instances, schema_columns,
        smiles_sample, column_picklist, picklist_no_times, subquery_extract, boundary_strip, utf8_guard, bootstrap_mean, bootstrap_median, bootstrap_std, stream_periods,
    )
} | {"running_mean": running_means}

_DELIVERIES = "select distinct on (response_id) * from model_response order by response_id, loaded_at desc"
_RESULTS = "select distinct on (response_id) * from evaluation_result order by response_id, evaluated_at desc"
_ENSEMBLES = f"""select r.instance_id, r.replicate, sum(coalesce(e.score, 0) * coalesce(r.weight, 0)) as wa, count(*) as n
  from ({_DELIVERIES}) r left join ({_RESULTS}) e using (response_id) group by 1, 2"""
_MEANS = f"select instance_id, sum(wa) / 3 as mean from ({_ENSEMBLES}) group by 1"
_REPLAY = f"""select r.instance_id, r.replicate, sum(case when regexp_replace(lower(response), '[\\s\\x{{A0}};]+', '', 'g') = regexp_replace(lower(gold), '[\\s\\x{{A0}};]+', '', 'g') then coalesce(weight, 0) else 0 end) as wa, count(*) as n_results
  from ({_DELIVERIES}) r join spider_instance i on i.instance_id = r.instance_id group by 1, 2"""
_MOLECULES = "select p_partkey, p_partkey % 8 as kind from part"
_VALUES = ", ".join("({}, '{}')".format(i, p) for i, p in enumerate(PATTERNS))
_MESSAGE = prompts.SQL_MESSAGE.split("%s")

def _bootstrap_sql(whole: str, per: str) -> str:
    return f"""with v as (select s_acctbal as x, row_number() over (order by s_suppkey) - 1 as pos from supplier), n as (select count(*) as n from v),
      draws as (select b, (b * 7919 + i * 104729 + b * i * 31) % n as nr from range(200) t(b), n, (select pos as i from v)),
      m as (select b, cast({per} as double) as m from draws join v on nr = pos group by b)
      select (select round({whole} + 1e-7, 4) from v) as metric, round(quantile_cont(m, 0.025) + 1e-7, 4) as lower, round(quantile_cont(m, 0.975) + 1e-7, 4) as upper from m"""

ORACLES = {
    "scan_patterns": f"select instance_id, pattern from (values {_VALUES}) t(instance_id, pattern)",
    "regex_fullmatch_score": f"""select instance_id, round(avg(m), 6) as mean_score, cast(sum(m) as bigint) as n_valid from (
        select instance_id, cast(regexp_full_match(p_name, pattern) as int) as m from part, (values {_VALUES}) t(instance_id, pattern)) group by 1""",
    "regex_udf_score": """select p_partkey, case when v then 1.0 else 0.0 end as score, case when v then 'valid' else 'invalid' end as "desc" from (
        select p_partkey, len(list_filter(range(1, length(p_name)), lambda i: p_name[i] = p_name[i + 1] and regexp_matches(p_name[i], '[A-Za-z0-9_]'))) > 0 as v from part)""",
    "regex_critic_complete": "select p_partkey, regexp_full_match(p_name, '[a-z ]+') as allowed from part",
    "regex_critic_prefix": "select p_partkey, regexp_full_match(p_name, '[a-m][a-z]*( ([a-z]+( [a-z]*)?)?)?') as allowed from part",
    "ensemble_weighted_accuracy": f"select instance_id, replicate, round(wa, 6) as weighted_accuracy, n as n_responses from ({_ENSEMBLES})",
    "instance_mean": f"select instance_id, round(mean, 6) as mean from ({_MEANS})",
    "macro_average": f"select round(avg(mean), 6) as average_weighted_accuracy, count(*) as n_instances from ({_MEANS})",
    "replicate_cross": "select instance_id, cast(r as int) as replicate from spider_instance, range(3) t(r)",
    "max_instances": "select instance_id from spider_instance where instance_id < 20 union all select instance_id - 1000 from spider_instance where instance_id < 1",
    "cache_miss_plan": "select instance_id, cast(r as int) as replicate from spider_instance i, range(3) t(r) where not exists (select 1 from model_response m where m.instance_id = i.instance_id and m.replicate = r)",
    "eval_needed": "select distinct response_id from model_response r where not exists (select 1 from evaluation_result e where e.response_id = r.response_id)",
    "running_mean": """select month, round(avg(mean) over (order by month rows unbounded preceding), 4) as running_mean from (
        select cast(date_trunc('month', o_orderdate) as timestamp) as month, avg(o_totalprice) as mean from orders group by 1)""",
    "ensemble_replay": f"""select r.instance_id, r.replicate, round(sum(case when regexp_replace(lower(response), '[\\s\\x{{A0}};]+', '', 'g') = regexp_replace(lower(gold), '[\\s\\x{{A0}};]+', '', 'g') then coalesce(weight, 0) else 0 end), 6) as weighted_accuracy,
        0.5 as runtime_seconds, cast(count(*) as int) as n_results from ({_DELIVERIES}) r join spider_instance i on i.instance_id = r.instance_id group by 1, 2""",
    "evaluation_run": f"""select round(avg(m), 6) as average_weighted_accuracy, count(*) as n_instances from (select instance_id, sum(coalesce(wa, 0)) / 5 as m from spider_instance left join ({_REPLAY}) using (instance_id) group by 1)""",
    "store_round_trip": f"""select r.instance_id, replicate, if(replicate = 1, 2.0, 0.5) as runtime_seconds, cast(count(*) as int) as n_responses, md5(string_agg(coalesce(response, ''), '|' order by coalesce(response, ''))) as responses_md5
        from ({_DELIVERIES}) r join spider_instance i on i.instance_id = r.instance_id group by 1, 2""",
    "cached_run": f"""with m as (select instance_id, sum(wa) / 5 as m, sum(n_results) as n, count(*) as k from ({_REPLAY}) group by 1)
        select round(avg(m), 6) as first_average, round(avg(m), 6) as second_average, count(*) as n_instances, 5 * count(*) as n_results, sum(n) as n_scored from m""",
    "results_by_instance": f"""select instance_id, cast(count(*) as int) as n_replicates, '[' || string_agg(n_results::varchar, ', ' order by replicate) || ']' as n_results, '[' || string_agg(n_results::varchar, ', ' order by replicate) || ']' as n_responses from ({_REPLAY}) group by 1""",
    "smiles_prefix": f"select p_partkey, kind not in (4, 5) as allowed from ({_MOLECULES})",
    "smiles_valid": f"select p_partkey, kind in (0, 1, 2, 7) as allowed from ({_MOLECULES})",
    # an event is a hit if at most one other type came since the same type was last seen
    "lru_trace": """with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and event_type is not null),
        p as (select *, lag(n) over (partition by user_id, event_type order by n) as before from e),
        h as (select p.user_id, p.n, coalesce((select count(distinct event_type) from e x where x.user_id = p.user_id and x.n > p.before and x.n < p.n and x.event_type <> p.event_type) <= 1, false) and before is not null as hit from p)
        select user_id, count(*) as n_events, sum(cast(not hit as int)) as n_made from h group by 1""",
    "pattern_file": """select '"' || p_name || ', "' || p_brand as pattern, count(*) as n_rows, count(*) as n_ids from part group by 1""",
    "molecule_lines": "select i as instance_id, 20 as n, 20 as n_distinct, true as sound from range(50) t(i)",
    "sql_folder": f"""with k as (select schema_name, min_by(tables, instance_id) as ts from spider_instance where schema_name is not null and tables is not null group by 1),
        m as (select row_number() over (order by instance_id) - 1 as id, schema_name, gold, '{_MESSAGE[0]}' || array_to_string(list_transform(ts, lambda t: t.name || array_to_string(list_transform(t.columns, lambda c: chr(10) || '* ' || c.name || ' (' || c.tpe || '): ' || c.nl_name), '')), chr(10) || chr(10)) || '{_MESSAGE[1]}' || utterance || '{_MESSAGE[2]}' as message
          from spider_instance join k using (schema_name))
        select id as instance_id, schema_name, md5(message) as message_md5, md5((select string_agg(concat_ws('#', message, gold), '|' order by case id when 10 then 0 when 0 then 1 else 2 end) from m where id in (10, 0, 25))) as shots_md5 from m""",
    "grammar_file": "select schema_name, md5(min(lark_grammar)) as grammar_md5 from spider_instance where schema_name is not null and lark_grammar is not null group by 1",
    "sql_exec_spark": "select i::int as id, i % 2 = 1 as exec_match, case when i % 2 = 1 then null when i = 6 then 'invalid' else 'mismatch' end as reason from range(1, 12) t(i)",
    "code_texts": "select n_nationkey, n_name as name from nation",
    "byte_texts": "select p_partkey, ' ' || p_name as name from part",
    "molecule_score": f"""select p_partkey, if(kind in (0, 1, 2, 7), 1.0, 0.0) as score, if(kind in (0, 1, 2, 7), 'valid', 'invalid') as "desc" from ({_MOLECULES})""",
    "user_messages": f"select instance_id, md5('{_MESSAGE[0]}' || coalesce(schema_str, '') || '{_MESSAGE[1]}' || utterance || '{_MESSAGE[2]}') as message_md5 from spider_instance",
    "schema_serialize": """select instance_id, md5(array_to_string(list_transform(tables, lambda t: t.name || array_to_string(list_transform(t.columns, lambda c: chr(10) || '* ' || c.name || ' (' || c.tpe || '): ' || c.nl_name), '')), chr(10) || chr(10))) as schema_md5 from spider_instance""",
    "chat_messages": """select instance_id, cast(pos as int) as pos, role, md5(content) as content_md5 from (
        select instance_id, 0 as pos, 'system' as role, 'S' as content from spider_instance
        union all select instance_id, 1 + 2 * k, 'user', few_shot_examples[k + 1].input from spider_instance, range(100) t(k) where k < len(few_shot_examples)
        union all select instance_id, 2 + 2 * k, 'assistant', few_shot_examples[k + 1].output from spider_instance, range(100) t(k) where k < len(few_shot_examples)
        union all select instance_id, 1 + 2 * coalesce(len(few_shot_examples), 0), 'user', utterance from spider_instance)""",
    "sql_prompts": """select instance_id, md5('S' || chr(10) || chr(10) || coalesce(array_to_string(list_transform(few_shot_examples, lambda e: e.input || chr(10) || 'SQL query: ' || e.output), chr(10) || chr(10)), '')
        || chr(10) || chr(10) || utterance || chr(10) || 'SQL query:') as prompt_md5 from spider_instance""",
    "pattern_prompts": "select p_partkey, 'S' || chr(10) || 'Pattern: a+' || chr(10) || 'Output: aa' || chr(10) || 'Pattern: b|c' || chr(10) || 'Output: c' || chr(10) || p_name as prompt from part",
    "molecule_prompts": "select n_regionkey, 'S' || chr(10) || string_agg('Molecule: ' || n_name, chr(10) order by n_name) || chr(10) || 'Molecule:' as prompt from nation group by 1",
    "few_shot_select": """select cast(pos as int) as pos, r_name from (select r_name, row_number() over (order by r_name, k) - 1 as nr from (select r_regionkey as k, r_name from region union all select n_nationkey, n_name from nation))
        join (values (0, 10), (1, 0), (2, 25)) t(pos, nr) using (nr)""",
    "spider_datum": "select example_id as instance_id, db_id as schema_name, question as utterance, query from dev",
    "spider_instances": "select example_id as instance_id, db_id as schema_name, n_tables from dev join (select schema_name, cast(max(len(tables)) as int) as n_tables from spider_instance group by 1) on db_id = schema_name",
    "schema_columns": "select distinct schema_name, t.name as table_name, c.name as column_name, c.tpe as tpe, c.nl_name as nl_name from (select schema_name, t, unnest(t.columns) as c from (select schema_name, unnest(tables) as t from spider_instance))",
    "smiles_sample": "select cast(i as bigint) as instance_id, least(10, (select count(*) from documents)) as n, least(10, (select count(distinct doc_id) from documents)) as n_distinct, least(10, (select count(*) from documents)) - 1 as last_pos from range(3) t(i)",
    "column_picklist": "select distinct event_type as value from events",
    "picklist_no_times": "select distinct md5(response) as value_md5 from model_response where response is not null and length(response) - length(replace(response, ':', '')) <> 2",
    "subquery_extract": r"select example_id, nullif(trim(list_extract(regexp_extract_all(query, '(?is)\(\s*(select[^()]*(?:\([^()]*\)[^()]*)*?)(?:\)|$)', 1), -1), ' ' || chr(10) || chr(9) || chr(13)), '') as subquery from train_spider where query is not null",
    "boundary_strip": """select example_id, case when ends_with(q, ' WHERE') then rtrim(q, ' WHERE') when ends_with(q, ' GROUP BY') then rtrim(q, ' GROUP BY') when ends_with(q, ' ORDER') then rtrim(q, ' ORDER') end as stripped
        from (select example_id, query || [' WHERE', ' GROUP BY', ' ORDER', ''][example_id % 4 + 1] as q from train_spider where query is not null)""",
    "utf8_guard": "select example_id, example_id % 3 <> 0 as sound from dev where query is not null",
    "bootstrap_mean": _bootstrap_sql("avg(x)", "avg(x)"),
    "bootstrap_median": _bootstrap_sql("median(x)", "median(x)"),
    "bootstrap_std": _bootstrap_sql("stddev_pop(x)", "stddev_pop(x)"),
    "stream_periods": "select cast(epoch_ms((epoch_ms(created_at) // 604800000) * 604800000) as timestamp) as period_start, count(distinct response_id) as n_rows from model_response where created_at is not null group by 1",
}
