"""Queries of problems 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.packing import fill_containers
from scorelake.llm.pieces import split_corpus
from scorelake.llm.tokens import token_counts, tokenizer_file
from scorelake.session import cut, read


def budget(spark: SparkSession, sf_dir: str, purpose: str) -> Row:
    return read(spark, sf_dir, "token_budget").where(F.col("purpose") == purpose).first()


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = budget(spark, sf_dir, "container")
    return fill_containers(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file(b["tokenizer"]), b["capacity"])


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number that could hold the tokens, and the share of space left."""
    capacity = budget(spark, sf_dir, "container")["capacity"]
    placed = cut(p9_containers(spark, sf_dir))
    per = placed.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("share_left"),
        F.max("used").alias("fullest"),
    )


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = budget(spark, sf_dir, "piece")
    return split_corpus(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file(b["tokenizer"]), b["capacity"], b["overlap"])


def p10_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, the split ones put together again from their pieces without overlaps."""
    cores = p10_pieces(spark, sf_dir).select(F.col("doc_id").alias("d"), F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("core")).alias("p"))
    joined = cores.groupBy("d").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    whole = F.concat_ws("", F.transform("ps", lambda p: p["core"]))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(joined, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.md5(F.coalesce(F.when(F.col("ps").isNotNull(), whole), F.col("text"), F.lit(""))).alias("text_md5"))


def p9_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their placement, and what may not be: texts lost, pieces given twice, containers over capacity, wrong
    figures of what is left, texts split though a container holds them."""
    capacity = budget(spark, sf_dir, "container")["capacity"]
    placed = cut(p9_containers(spark, sf_dir))
    used = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.min("space_left").alias("least"), F.max("space_left").alias("most"))
    boxes = used.agg(*[F.coalesce(F.sum(F.expr(c).cast("bigint")), F.lit(0)).alias(n) for n, c in (("n_over", f"used > {capacity}"), ("n_wrong", f"least <> most or least <> {capacity} - used"))])
    whole = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("numbers"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    bad = {"n_twice": "pieces <> numbers or last <> pieces - 1", "n_cut": f"pieces > 1 and tokens <= {capacity}", "n_torn": "tokens <> end"}
    texts = whole.agg(F.count("*").alias("n_documents"), *[F.coalesce(F.sum(F.expr(c).cast("bigint")), F.lit(0)).alias(n) for n, c in bad.items()])
    docs = read(spark, sf_dir, "documents").select("doc_id").distinct().join(placed.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_lost"))
    return texts.crossJoin(boxes).crossJoin(docs)  # a row each


def p10_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may not be: pieces over the limit, gaps in the numbers, texts that neither fit nor were split."""
    b = budget(spark, sf_dir, "piece")
    docs = read(spark, sf_dir, "documents")
    pieces = cut(p10_pieces(spark, sf_dir))
    per = pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("piece_no").alias("first"), F.max("piece_no").alias("last"), F.max("n_tokens").alias("largest"))
    bad = {"n_over": f"largest > {b['capacity']}", "n_gaps": "last - first + 1 <> n", "n_whole": "n < 2"}
    found = per.agg(*[F.coalesce(F.sum(F.expr(c).cast("bigint")), F.lit(0)).alias(n) for n, c in bad.items()])
    long = token_counts(docs, "doc_id", "text", tokenizer_file(b["tokenizer"])).where(F.col("n_tokens") > b["capacity"])
    lost = long.join(per, "doc_id", "left_anti").agg(F.count("*").alias("n_lost"))
    return docs.agg(F.count("*").alias("n_documents")).crossJoin(found).crossJoin(lost)  # a row each


QUERIES = {"p9_containers": p9_containers, "p9_report": p9_report, "p9_audit": p9_audit, "p10_pieces": p10_pieces, "p10_rejoined": p10_rejoined, "p10_audit": p10_audit}
ORACLES = {
    "p9_audit": "select count(distinct doc_id) as n_documents, 0 as n_twice, 0 as n_cut, 0 as n_torn, 0 as n_over, 0 as n_wrong, 0 as n_lost from documents",
    "p10_rejoined": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "p10_audit": "select count(*) as n_documents, 0 as n_over, 0 as n_gaps, 0 as n_whole, 0 as n_lost from documents",
}
