"""Edits of a library: each gives a new frame of passages (questions nested) or exam sets. Nothing runs until it is saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import add_entries, all_used_recently, swapped, without_rows
from ..functions.text import clamp, new_id, now_iso, strip

MOST_RECENT = 10


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows and then new ones, with ord behind the last."""
    last = rows.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_last"))
    return rows.unionByName(new.join(F.broadcast(last), how="cross").withColumn("ord", F.col("ord") + F.col("_last")).select(rows.columns))


def delete(rows: DataFrame, gone) -> DataFrame:
    return rows.where(F.col("id") != gone)


def _at(rows: DataFrame, wanted, changes: dict[str, Column]) -> DataFrame:
    here = F.col("id") == wanted
    return rows.withColumns({name: F.when(here, value).otherwise(F.col(name)) for name, value in changes.items()})


def update_passage(rows: DataFrame, wanted, *, title: str, passage_type: str, text: str) -> DataFrame:
    """The type is stripped, title and text are not; updated_at moves."""
    return _at(rows, wanted, {"title": F.lit(title), "passage_type": strip(F.lit(passage_type)), "text": F.lit(text), "updated_at": now_iso()})


def rate_passage(rows: DataFrame, wanted, level: int | None) -> DataFrame:
    return _at(rows, wanted, {"difficulty": F.lit(level).cast("int"), "difficulty_source": F.lit("manual"), "updated_at": now_iso()})


def _questions(change) -> Column:
    return F.transform("questions", change)


def update_question(rows: DataFrame, wanted, index: int, *, number: str, question_type: str, answer: str, stem: str, explanation: str, choices: list[str]) -> DataFrame:
    """number, question_type and answer are stripped; the passage's updated_at moves."""
    values = {"number": strip(F.lit(number)), "question_type": strip(F.lit(question_type)), "answer": strip(F.lit(answer)), "stem": F.lit(stem), "explanation": F.lit(explanation), "choices": F.array(*map(F.lit, choices)).cast("array<string>")}
    changed = _questions(lambda q, i: F.when(i == index, _with(q, values)).otherwise(q))
    return _at(rows, wanted, {"questions": changed, "updated_at": now_iso()})


def rate_question(rows: DataFrame, wanted, index: int, level: int | None) -> DataFrame:
    values = {"difficulty": clamp(F.lit(level).cast("int")), "difficulty_source": F.lit("manual")}
    return _at(rows, wanted, {"questions": _questions(lambda q, i: F.when(i == index, _with(q, values)).otherwise(q)), "updated_at": now_iso()})


def _with(row: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        row = row.withField(name, value)
    return row


def add_question(rows: DataFrame, wanted, question: Column) -> DataFrame:
    """question: a struct; its number becomes the place it takes. updated_at stays."""
    new = question.withField("number", (F.size("questions") + 1).cast("string"))
    return _at(rows, wanted, {"questions": F.concat("questions", F.array(new))})


def delete_question(rows: DataFrame, wanted, index: int) -> DataFrame:
    return _at(rows, wanted, {"questions": F.filter("questions", lambda q, i: i != index)})


def move_question(rows: DataFrame, wanted, index: int, step: int) -> DataFrame:
    return _at(rows, wanted, {"questions": swapped(F.col("questions"), F.array(F.lit(index)), step)})


def rename_exam(exams: DataFrame, wanted, title: str) -> DataFrame:
    return _at(exams, wanted, {"title": F.lit(title)})


def default_exam_title(exams: DataFrame) -> DataFrame:
    """title of the next exam, in one row."""
    return exams.agg(F.concat(F.lit("시험지 "), (F.count(F.lit(1)) + 1).cast("string")).alias("title"))


def new_exam(exams: DataFrame, wanted=None) -> DataFrame:
    """exams and a new one behind them, with the default title and a drawn id unless one is wanted; as they are if they hold that id."""
    there = exams.where(F.col("id") == wanted) if wanted is not None else exams.limit(0)
    kind = dict(exams.dtypes)
    values = {"id": F.lit(wanted) if wanted is not None else new_id(), "passage_ids": F.array(), "created_at": now_iso(), "ord": F.lit(0)}
    one = default_exam_title(exams).select(*((values[c] if c in values else F.col("title") if c == "title" else F.lit(None)).cast(kind[c]).alias(c) for c in exams.columns))
    return append(exams, one.join(there.select("id"), "id", "left_anti"))


def add_to_exam(exams: DataFrame, wanted, ids: list, row: int = -1) -> DataFrame:
    """The exam is made if there is none of that id; without ids nothing happens."""
    if not ids:
        return exams
    kind = exams.schema["passage_ids"].dataType
    return _at(new_exam(exams, wanted), wanted, {"passage_ids": add_entries(F.col("passage_ids"), F.array(*map(F.lit, ids)).cast(kind), F.lit(row))})


def remove_from_exam(exams: DataFrame, wanted, rows: list[int]) -> DataFrame:
    return _at(exams, wanted, {"passage_ids": without_rows(F.col("passage_ids"), F.array(*map(F.lit, rows)).cast("array<int>"))})


def move_in_exam(exams: DataFrame, wanted, rows: list[int], step: int) -> DataFrame:
    return _at(exams, wanted, {"passage_ids": swapped(F.col("passage_ids"), F.array(*map(F.lit, rows)).cast("array<int>"), step)})


def reorder_exam(exams: DataFrame, wanted, ids: list) -> DataFrame:
    kind = exams.schema["passage_ids"].dataType
    return _at(exams, wanted, {"passage_ids": F.array(*map(F.lit, ids)).cast(kind)})


def append_results(passages: DataFrame, recent: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """passages with those of results (ord, source_file, passages: array of structs) behind them, in order; recent (one row, files) with the source files used.

    The list of recent files is bounded, so only its last entries are ever needed of all results.
    """
    each = results.select(F.col("ord").alias("_of"), F.posexplode("passages").alias("_pos", "_p"))
    new = each.select("_p.*", (F.col("_of") * (1 << 32) + F.col("_pos")).alias("ord"))  # ord has gaps, and the order of files and places
    last = results.groupBy("source_file").agg(F.max("ord").alias("ord")).orderBy(F.desc("ord")).limit(MOST_RECENT)
    files = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_file"))), lambda x: x["source_file"]).alias("_used"))
    return append(passages, new), recent.join(F.broadcast(files), how="cross").select(all_used_recently(F.col("files"), F.col("_used"), MOST_RECENT).alias("files"))
