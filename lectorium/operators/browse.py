"""Browsing: filters, lookups and facets over passages(ord, id, passage_type, difficulty, title, text, ..) and questions(passage_id, question_type, ..)."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_pdf


def has_type(types: Collection[str] | None, column: str = "passage_type") -> Column | None:
    """A plain IN, which scans can use; null counts as the empty type."""
    if types is None:
        return None
    found = F.col(column).isin(*sorted(types))
    return found | F.col(column).isNull() if "" in types else found


def has_difficulty(levels: Collection[int | None] | None, column: str = "difficulty") -> Column | None:
    """Null is a level of its own: unrated."""
    if levels is None:
        return None
    found = F.col(column).isin(*sorted(x for x in levels if x is not None))
    return found | F.col(column).isNull() if None in levels else found


def searched() -> Column:
    """What keywords are looked for in: title and text in lower case."""
    return F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))


def has_keyword(keyword: str | None) -> Column | None:
    """A literal substring of title and text, in any case; a blank one is no test."""
    wanted = (keyword or "").strip().lower()
    return F.contains(searched(), F.lit(wanted)) if wanted else None


def filter_passages(passages: DataFrame, questions: DataFrame | None = None, *, passage_types=None, question_types=None, difficulties=None, keyword=None) -> DataFrame:
    """Passages that pass every given test. Types and levels are tested first; a test that is None is not in the plan.

    question_types keeps a passage if any of its questions has one of them: a semi-join on the passage.
    """
    for test in (has_type(passage_types), has_difficulty(difficulties), has_keyword(keyword)):
        if test is not None:
            passages = passages.where(test)
    if question_types is not None:
        some = questions.where(has_type(question_types, "question_type")).select(F.col("passage_id").alias("id"))
        passages = passages.join(some, "id", "left_semi")
    return passages


def first_by_id(rows: DataFrame, wanted=None) -> DataFrame:
    """The first row of each id by ord, or of one id alone. Only ids and ords are grouped."""
    if wanted is not None:
        return rows.where(F.col("id") == wanted).orderBy("ord").limit(1)
    first = rows.groupBy("id").agg(F.min("ord").alias("ord"))
    return rows.join(first, ["id", "ord"], "left_semi").select(rows.columns)


def facet(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values, the empty one included. Sort at the edge."""
    return rows.select(F.coalesce(F.col(column), F.lit("")).alias(column)).distinct()


def totals(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """n_passages, n_questions in one row: both are counted in each task, and no column is read."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = passages.select(one.alias("p"), zero.alias("q")).unionByName(questions.select(zero.alias("p"), one.alias("q")))
    return rows.agg(F.coalesce(F.sum("p"), zero).alias("n_passages"), F.coalesce(F.sum("q"), zero).alias("n_questions"))


def level_histogram(passages: DataFrame) -> DataFrame:
    """difficulty, n for 1 to 5 and for null, zeros included."""
    return filled_levels(passages.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n")))


def filled_levels(counts: DataFrame) -> DataFrame:
    """Counts by difficulty with a zero for each level that has none. The domain has six rows; the counts as many at most."""
    domain = counts.sparkSession.range(1, 7).select(F.when(F.col("id") < 6, F.col("id").cast("int")).alias("difficulty"))
    return domain.join(counts.withColumnRenamed("difficulty", "d"), F.col("difficulty").eqNullSafe(F.col("d")), "left").select("difficulty", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def listed_models(models: DataFrame, prefix: str) -> DataFrame:
    """Names of models (name, actions) that can generate and begin with a prefix, without their folder."""
    name = F.regexp_replace("name", "^models/", "")
    able = (F.size(F.coalesce("actions", F.array().cast("array<string>"))) == 0) | F.array_contains("actions", "generateContent")
    return models.where(able & name.startswith(prefix)).select(name.alias("name")).distinct()


def pdf_paths(paths: DataFrame) -> DataFrame:
    """First occurrence of each path that names a PDF file (path, ord)."""
    return paths.where(is_pdf(F.col("path"))).groupBy("path").agg(F.min("ord").alias("ord"))


def numbered(rows: DataFrame, by: str, order: str, name: str = "n") -> DataFrame:
    """Rows with their place from 1 within each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)))
