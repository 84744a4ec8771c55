"""Import merging, and exam sets: id, passage_ids (ordered), .."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import without
from ..functions.text import one_decimal
from .browse import first_by_id


def merge(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Existing rows, then imported ones whose id is not among them; repeats within the import all stay.

    Imported rows' ord is moved behind the existing ones'.
    """
    new = imported.join(existing.select("id").distinct(), "id", "left_anti")
    last = existing.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_last"))
    return existing.unionByName(new.join(F.broadcast(last), how="cross").withColumn("ord", F.col("ord") + F.col("_last")).select(existing.columns))


def positions(exams: DataFrame) -> DataFrame:
    """exam_id, pos (from 0), passage_id."""
    return exams.select(F.col("id").alias("exam_id"), F.posexplode("passage_ids").alias("pos", "passage_id"))


def resolve(exams: DataFrame, passages: DataFrame) -> DataFrame:
    """exam_id, pos and the passage's columns; unknown ids are left out and the first passage of an id is taken."""
    return positions(exams).join(first_by_id(passages).withColumnRenamed("id", "passage_id"), "passage_id")


def mark_used(passages: DataFrame, exams: DataFrame) -> DataFrame:
    """passages with used: whether any of the exams holds them."""
    used = positions(exams).select(F.col("passage_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return passages.join(used, "id", "left").withColumn("used", F.coalesce("_used", F.lit(False))).drop("_used")


def remove_passage(passages: DataFrame, exams: DataFrame, gone) -> tuple[DataFrame, DataFrame]:
    """Both without that passage, every occurrence in an exam included."""
    return passages.where(F.col("id") != gone), exams.withColumn("passage_ids", without(F.col("passage_ids"), F.lit(gone)))


def prune_dangling(exams: DataFrame, passages: DataFrame) -> DataFrame:
    """exams whose passage_ids are known ones alone, in order."""
    known = positions(exams).join(passages.select(F.col("id").alias("passage_id")).distinct(), "passage_id", "left_semi")
    kept = known.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("pos", "passage_id"))).alias("x")).select(F.col("exam_id").alias("id"), F.transform("x", lambda e: e["passage_id"]).alias("_kept"))
    return exams.join(kept, "id", "left").withColumn("passage_ids", F.coalesce("_kept", F.slice("passage_ids", 1, 0))).drop("_kept")


def summary(exams: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """exam_id, n_passages, n_questions, average: over rated passages to one decimal, '-' if none. Exams without passages are in it.

    Questions are counted by passage before they meet the exams.
    """
    many = questions.groupBy(F.col("passage_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = resolve(exams, passages.select("ord", "id", "difficulty")).join(many, "passage_id", "left")
    sums = rows.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum(F.coalesce("n", F.lit(0))).alias("n_questions"), F.sum("difficulty").alias("s"), F.count("difficulty").alias("c")
    )
    every = exams.select(F.col("id").alias("exam_id")).join(sums, "exam_id", "left")
    zero = F.lit(0).cast("long")
    return every.select("exam_id", F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_questions", zero).alias("n_questions"), one_decimal(F.coalesce("s", zero), F.coalesce("c", zero)).alias("average"))
