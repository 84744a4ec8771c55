"""Types of a library: passages with nested questions, and exam sets."""

from __future__ import annotations

from pyspark.sql import types as T

QUESTION = "struct<id: string, number: string, stem: string, choices: array<string>, answer: string, explanation: string, question_type: string, difficulty: int, difficulty_source: string>"
PASSAGES = (
    "ord long, id string, title string, text string, passage_type string, difficulty int, difficulty_source string, difficulty_reason string, tags array<string>, source_file string, "
    f"source_pages array<int>, questions array<{QUESTION}>, created_at string, updated_at string"
)
EXAMS = "ord long, id string, title string, passage_ids array<string>, created_at string"
SCHEMA_VERSION = 1


def passages() -> T.StructType:
    return T.StructType.fromDDL(PASSAGES)


def exams() -> T.StructType:
    return T.StructType.fromDDL(EXAMS)
