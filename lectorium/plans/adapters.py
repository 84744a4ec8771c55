"""The driver's tables in the library's shape. Column lists are pruned by the scans; nothing is collected here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 + F.col("quality") + 2 * F.col("toxic")).cast("int").alias("difficulty"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.lit("").alias("title"), "text", F.col("lang").alias("passage_type"), "difficulty", F.col("source").alias("source_file"))


def passages_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.lit("").alias("title"), F.lit("").alias("text"), F.col("o_orderstatus").alias("passage_type"), level.alias("difficulty"))


def questions_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("passage_id"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("question_type"))


def questions_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("passage_id"), F.col("turn").alias("pos"), F.lit("").alias("number"), F.col("text").alias("stem"), F.col("role").alias("question_type"))


def exams_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by date, and after each tenth part of the keys one that dangles (its negative)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    ids = F.flatten(F.transform("x", lambda e: F.when(e["o_orderkey"] % 10 == 0, F.array(e["o_orderkey"], -e["o_orderkey"])).otherwise(F.array(e["o_orderkey"]))))
    return listed.select(F.col("o_custkey").alias("id"), ids.alias("passage_ids"))


def exam_sets_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As exams_of_customers, with all columns of an exam set."""
    rows = exams_of_customers(spark, sf_dir)
    return rows.select(F.col("id").alias("ord"), "id", F.concat(F.lit("exam "), F.col("id").cast("string")).alias("title"), "passage_ids", F.lit("then").alias("created_at"))


def library_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage for each conversation, its turns as questions."""
    empty = F.lit("")
    question = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), empty.alias("number"), F.col("text").alias("stem"), F.array(F.col("role")).alias("choices"), empty.alias("answer"), empty.alias("explanation"),
        F.col("role").alias("question_type"), (1 + F.col("turn") % 5).cast("int").alias("difficulty"), empty.alias("difficulty_source"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", question.alias("q")).alias("x"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(F.col("conv_id").alias("ord"), F.col("conv_id").alias("id"), F.transform("x", lambda e: e["q"]).alias("questions"), F.lit("then").alias("updated_at"))


def libraries_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a library file's text with one passage and one exam, of loose types."""
    level = F.get(F.array(*map(F.lit, ('"3"', '" 4 "', "9", "-2", "3.7", "true", "null", '"x"'))), (F.col("doc_id") % 8).cast("int"))
    number = F.col("doc_id").cast("string")
    passage = F.concat(
        F.lit('{"id": '), number, F.lit(', "title": "'), F.col("lang"), F.lit('", "difficulty": '), level, F.lit(', "tags": [1, "b"], "source_pages": ['), (F.col("doc_id") % 5).cast("string"),
        F.lit(', "7"], "questions": [{"number": 18, "choices": [2, "c"], "extra": {}}]}'),
    )
    exam = F.concat(F.lit('{"id": "e'), number, F.lit('", "passage_ids": ['), number, F.lit("]"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(', "title": null'), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"passages": ['), passage, F.lit('], "exam_sets": ['), exam, F.lit("]}")).alias("file"))
