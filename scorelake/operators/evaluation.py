"""Evaluation runs: instances times replicates, cached outputs and results, scoring, weighted and macro averages."""

from __future__ import annotations

import asyncio
import inspect
import json
import os
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake import types
from scorelake.functions.regexes import score_patterns
from scorelake.functions.smiles import molecule_scores
from scorelake.operators.sql_match import score_of_reason, sql_match
from scorelake.session import cut
from scorelake.sources.files import with_ordinal

KEYS = ["instance_id", "replicate"]
#: (instance as a dict, replicate), or (instance, output folder, replicate), to {"responses": [{"response", "weight", "metadata"}],
#: "runtime_seconds", "metadata"} or an object with these attributes. It may be a coroutine function.
Adaptor = Callable[..., object]
#: Calls of an asynchronous adaptor that a task has open at once.
CONCURRENCY = 8


def weighted_accuracy(scored: Column) -> Column:
    """Sum of score times weight over an array of structs, in its order; weights aren't made to add up to 1."""
    return F.aggregate(scored, F.lit(0.0), lambda total, x: total + x["score"] * x["weight"])


class Evaluator(ABC):
    """Scores responses. Subclasses give score_responses; ensembles are weighted here."""

    @abstractmethod
    def score_responses(self, df: DataFrame) -> DataFrame:
        """df (the instance's columns and response) with score, desc and metadata (map<string,string>)."""

    def ensembles(self, outputs: DataFrame) -> DataFrame:
        """outputs (instance_id, replicate, output, the instance's columns) as instance_id, replicate, result.

        The results of one ensemble, as many as it has responses, are put together in the order of the responses.
        """
        exploded = outputs.select("*", F.posexplode("output.responses").alias("_pos", "_r")).select("*", F.col("_r.response").alias("response"), F.col("_r.weight").alias("_weight")).drop("_r")
        scored = self.score_responses(exploded)
        one = F.struct(F.col("_pos").alias("pos"), F.col("score").cast("double").alias("score"), F.col("_weight").alias("weight"), F.col("desc").alias("desc"), F.col("metadata").cast("map<string,string>").alias("metadata"))
        together = scored.groupBy(*KEYS).agg(F.collect_list(one).alias("rs"))
        ordered = together.select(*KEYS, F.array_sort("rs", lambda a, b: a["pos"] - b["pos"]).alias("rs"))
        results = F.transform("rs", lambda x: F.struct(x["score"].alias("score"), x["desc"].alias("desc"), x["metadata"].alias("metadata")))
        found = ordered.select(*KEYS, weighted_accuracy(F.col("rs")).alias("weighted_accuracy"), results.alias("results"))
        back = outputs.select(F.col("instance_id").alias("_i"), F.col("replicate").alias("_k"), F.col("output.runtime_seconds").alias("runtime_seconds"))
        joined = back.join(found, (F.col("_i") == F.col("instance_id")) & (F.col("_k") == F.col("replicate")), "left")
        none = F.array().cast(types.ENSEMBLE["results"].dataType)
        return joined.select(
            F.col("_i").alias("instance_id"),
            F.col("_k").alias("replicate"),
            F.struct(F.coalesce("weighted_accuracy", F.lit(0.0)).alias("weighted_accuracy"), "runtime_seconds", F.coalesce("results", none).alias("results")).alias("result"),
        )


class PatternEvaluator(Evaluator):
    """score 1 for a response that matches the whole of the instance's pattern."""

    def score_responses(self, df: DataFrame) -> DataFrame:
        return score_patterns(df, "pattern", "response").withColumn("metadata", F.create_map().cast("map<string,string>"))


class MoleculeEvaluator(Evaluator):
    """The scorer's value of a valid molecule, by default 1 for validity; 0 for others."""

    def __init__(self, scorer: Callable[[str], float] | None = None):
        self.scorer = scorer

    def score_responses(self, df: DataFrame) -> DataFrame:
        return molecule_scores(df, "response", self.scorer).withColumn("metadata", F.create_map().cast("map<string,string>"))


class SqlEvaluator(Evaluator):
    """Execution match with the instance's gold query on its database."""

    def __init__(self, sources: dict[str, str], keys: dict[str, dict[str, str]], strict: bool = True, timeout: float | None = None):
        self.sources, self.keys, self.strict, self.timeout = sources, keys, strict, timeout

    def score_responses(self, df: DataFrame) -> DataFrame:
        return score_of_reason(sql_match(df, self.sources, self.keys, "schema_name", "response", "gold", self.strict, self.timeout))


class TextEvaluator(Evaluator):
    """score 1 for a response that is the instance's text ``gold`` but for case, white space and semicolons.

    A small domain of one's own needs no more than this: columns in, score, desc and metadata out.
    """

    def score_responses(self, df: DataFrame) -> DataFrame:
        plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[\s\u00A0;]+", "")
        same = F.coalesce(plain("response") == plain("gold"), F.lit(False))
        return df.withColumn("score", same.cast("double")).withColumn("desc", F.when(same, "valid").otherwise("mismatch")).withColumn("metadata", F.create_map().cast("map<string,string>"))


class Store(ABC):
    """Where outputs and results of runs are kept: kind is output or results. The path must be one that all executors share."""

    def __init__(self, path: str):
        self.path = path

    @abstractmethod
    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """instance_id (text), replicate, value; what isn't sound is passed over, what isn't there is empty."""

    @abstractmethod
    def write(self, df: DataFrame, kind: str) -> None:
        """df: instance_id, replicate, value. A later value takes the place of an earlier one."""

    @staticmethod
    def schema(kind: str):
        return types.OUTPUT if kind == "output" else types.ENSEMBLE

    def none(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.createDataFrame([], f"instance_id string, replicate int, value {self.schema(kind).simpleString()}")

    @staticmethod
    def sound(kind: str) -> Column:
        if kind == "output":
            return F.col("value.responses").isNotNull() & F.forall("value.responses", lambda r: r["response"].isNotNull() & r["weight"].isNotNull())
        return F.col("value.weighted_accuracy").isNotNull()


class TableStore(Store):
    """A parquet table of each kind, to which every write adds a batch; of a key the latest batch holds.

    Any file system of Spark's will do, and the number of files depends on the batches, not on the instances.
    """

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        try:
            rows = spark.read.schema(f"instance_id string, replicate int, batch bigint, value {self.schema(kind).simpleString()}").parquet(f"{self.path}/{kind}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.none(spark, kind)
        return rows.groupBy("instance_id", "replicate").agg(F.max_by("value", "batch").alias("value")).where(self.sound(kind))

    def write(self, df: DataFrame, kind: str) -> None:
        rows = df.select(F.col("instance_id").cast("string").alias("instance_id"), "replicate", F.lit(time.time_ns()).alias("batch"), F.col("value").cast(self.schema(kind)).alias("value"))
        rows.write.mode("append").parquet(f"{self.path}/{kind}.parquet")


class JsonStore(Store):
    """A JSON file for each, ``<instance>-<replicate>-output.json`` and ``-results.json``, in a folder mounted on all machines:
    the form in which others exchange them. Runs of many instances are better kept in a TableStore (see copied)."""

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        try:
            files = spark.read.option("pathGlobFilter", f"*-{kind}.json").text(self.path, wholetext=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.none(spark, kind)
        part = lambda i: F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)-(\d+)-{kind}\.json$", i)
        rows = files.select(F.url_decode(part(1)).alias("instance_id"), part(2).cast("int").alias("replicate"), F.from_json("value", self.schema(kind)).alias("value"))
        return rows.where(self.sound(kind))

    def write(self, df: DataFrame, kind: str) -> None:
        """A file is written beside its place and moved there, so a lost task leaves none half written."""
        folder = self.path

        def save(rows) -> None:
            os.makedirs(folder, exist_ok=True)
            for r in rows:
                target = os.path.join(folder, f"{r['instance_id']}-{r['replicate']}-{kind}.json")
                with open(f"{target}.{os.getpid()}", "w", encoding="utf-8") as f:
                    f.write(json.dumps(json.loads(r["text"]), indent=2, ensure_ascii=False))
                os.replace(f"{target}.{os.getpid()}", target)

        df.select(F.col("instance_id").cast("string"), "replicate", F.to_json("value", {"ignoreNullFields": "false"}).alias("text")).foreachPartition(save)


def copied(spark: SparkSession, source: Store, target: Store) -> None:
    """What source holds, written to target: JSON files made a table, or a table exported as files."""
    for kind in ("output", "results"):
        target.write(source.read(spark, kind), kind)


@dataclass
class RunResult:
    """summary: average_weighted_accuracy, n_instances. instances: the mean of each. results and outputs: per replicate."""

    summary: DataFrame
    instances: DataFrame
    results: DataFrame
    outputs: DataFrame


def replicated(instances: DataFrame, n_replicates: int) -> DataFrame:
    """Each instance with replicate 0 .. n_replicates - 1."""
    return instances.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))))


def limited(instances: DataFrame, max_instances: int | None, ordinal: str = "instance_ord") -> DataFrame:
    """The first max_instances by ordinal; at least one, as a limit of 0 still takes the first."""
    return instances if max_instances is None else instances.where(F.col(ordinal) < max(1, max_instances))


def instance_means(results: DataFrame, n_replicates: int) -> DataFrame:
    return results.groupBy("instance_id").agg((F.sum("result.weighted_accuracy") / n_replicates).alias("mean"))


def running_mean(means: DataFrame, order: str, value: str = "mean") -> DataFrame:
    """means with the mean of all rows up to each, by ``order`` (a report of a run, not a distributed operator)."""
    return means.withColumn("running_mean", F.avg(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def _of(made: object, name: str):
    return made.get(name) if isinstance(made, dict) else getattr(made, name, None)


def generate(missing: DataFrame, adaptor: Adaptor, output_dir: str | None = None, concurrency: int = CONCURRENCY) -> DataFrame:
    """instance_id, replicate, output of the adaptor for every row, in the tasks that hold them.

    A coroutine function has up to ``concurrency`` calls of a task open at once; the others are made one by one.
    """
    columns = missing.columns
    call = adaptor if inspect.isroutine(adaptor) else type(adaptor).__call__
    takes_folder = len([p for p in inspect.signature(adaptor).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]) > 2
    waits = inspect.iscoroutinefunction(call)

    def ask(row: dict):
        instance, replicate = {c: row[c] for c in columns if c != "replicate"}, int(row["replicate"])
        return adaptor(instance, output_dir, replicate) if takes_folder else adaptor(instance, replicate)

    async def ask_all(rows: list[dict]) -> list:
        free = asyncio.Semaphore(concurrency)

        async def one(row: dict):
            async with free:
                return await ask(row)

        return await asyncio.gather(*map(one, rows))

    def run(batches):
        for pdf in batches:
            rows, out = pdf.to_dict("records"), []
            for row, made in zip(rows, asyncio.run(ask_all(rows)) if waits else map(ask, rows)):
                responses = [{"response": _of(r, "response"), "weight": float(_of(r, "weight")), "metadata": _of(r, "metadata")} for r in _of(made, "responses")]
                out.append({"instance_id": row["instance_id"], "replicate": int(row["replicate"]), "output": {"responses": responses, "runtime_seconds": _of(made, "runtime_seconds"), "metadata": _of(made, "metadata")}})
            yield pd.DataFrame(out, columns=["instance_id", "replicate", "output"])

    kind = dict(missing.dtypes)["instance_id"]
    return missing.mapInPandas(run, f"instance_id {kind}, replicate int, output {types.OUTPUT.simpleString()}")


def run_evaluation(
    spark: SparkSession,
    instances: DataFrame,
    adaptor: Adaptor,
    evaluator: Evaluator,
    output_dir: str | Store | None = None,
    n_replicates: int = 1,
    overwrite_results: bool = False,
    overwrite_outputs: bool = False,
    max_instances: int | None = None,
    verbosity: int = 0,
    concurrency: int = CONCURRENCY,
) -> RunResult:
    """Runs the adaptor where no output is cached, scores where no result is (or an output is new), and averages.

    output_dir is a store or the folder of a JsonStore; without one everything is made anew. Overwriting outputs without results is a ValueError, and so is an empty set
    of instances. Outputs and results are written to the checkpoint folder as they are made: the adaptor runs once per
    (instance, replicate) even if executors are lost later.
    """
    if overwrite_outputs and not overwrite_results:
        raise ValueError("overwriting outputs makes their results stale: overwrite results too")
    base = instances if "instance_ord" in instances.columns else with_ordinal(instances, "instance_ord")
    work = replicated(limited(base, max_instances), n_replicates)
    if work.isEmpty():
        raise ValueError("no instances")
    store = output_dir if isinstance(output_dir, Store) else JsonStore(output_dir) if output_dir else None
    key = F.col("instance_id").cast("string")

    def cached(kind: str) -> DataFrame:
        return store.read(spark, kind).select(F.col("instance_id").alias("_i"), F.col("replicate").alias("_k"), "value")

    if store and not overwrite_outputs:
        old = cut(cached("output"))
        hit = work.join(old, (key == F.col("_i")) & (F.col("replicate") == F.col("_k"))).select(*KEYS, F.col("value").alias("output"), F.lit(False).alias("new"))
        missing = work.join(old, (key == F.col("_i")) & (F.col("replicate") == F.col("_k")), "left_anti")
    else:
        hit, missing = None, work
    made = cut(generate(missing.drop("instance_ord"), adaptor, store.path if store else None, concurrency).withColumn("new", F.lit(True)))
    if store:
        store.write(made.select(*KEYS, F.col("output").alias("value")), "output")
    outputs = made if hit is None else hit.unionByName(made)
    full = base.join(outputs.withColumnRenamed("instance_id", "_oi"), F.col("instance_id") == F.col("_oi")).drop("_oi")

    if store and not overwrite_results:
        known = cut(cached("results"))
        same = (key == F.col("_i")) & (F.col("replicate") == F.col("_k"))
        kept = full.where(~F.col("new")).join(known, same).select(*KEYS, F.col("value").alias("result"))
        todo = full.join(known.select(F.col("_i").alias("_ci"), F.col("_k").alias("_ck")), (key == F.col("_ci")) & (F.col("replicate") == F.col("_ck")) & ~F.col("new"), "left_anti")
    else:
        kept, todo = None, full
    scored = cut(evaluator.ensembles(todo))
    if store:
        store.write(scored.select(*KEYS, F.col("result").alias("value")), "results")
    results = scored if kept is None else cut(kept.unionByName(scored))

    means = instance_means(results, n_replicates)
    summary = means.agg(F.avg("mean").alias("average_weighted_accuracy"), F.count("*").alias("n_instances"))
    found = means.join(base.select(F.col("instance_id").alias("_b"), "instance_ord"), F.col("instance_id") == F.col("_b")).drop("_b")
    if verbosity > 0:
        running_mean(found, "instance_ord").orderBy("instance_ord").show(1000, truncate=False)
    return RunResult(summary, found, results, outputs.drop("new"))


def nested_results(run: RunResult) -> DataFrame:
    """instance_id, results, outputs: the lists of one instance in the order of replicates."""
    joined = run.results.join(run.outputs, KEYS)
    lists = joined.groupBy("instance_id").agg(F.collect_list(F.struct("replicate", "result")).alias("r"), F.collect_list(F.struct("replicate", "output")).alias("o"))
    by_replicate = lambda c: F.array_sort(c, lambda a, b: a["replicate"] - b["replicate"])
    return lists.select("instance_id", F.transform(by_replicate("r"), lambda x: x["result"]).alias("results"), F.transform(by_replicate("o"), lambda x: x["output"]).alias("outputs"))
