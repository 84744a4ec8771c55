"""Counts of a logged library that are kept up with its log: totals, levels and facets, without the library being read.

Beside a log's bases there are counts, by version: sums (kind, value, n) and a light copy of the passages, with all that is
counted and none of the texts. Counts of a later version are the sums, less what the light rows named by the records since
gave to them, plus what these give after those records (log.py folds them), so they cost what the edits do. Sums are signed
and add up in any order. save() writes the counts of the newest version, which bounds the records to be folded; a
version's counts take their name in one step, so of two writers one is the first and the other's work, which is the same, goes.

Kinds are passages and questions (value null), difficulty (null: unrated), passage_type and question_type (null: empty).

Defined cases. Null lists of questions are empty. Rows that repeat an id count each, as they are each edited. Sums of zero
aren't rows. A version before the first counts is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .browse import filled_levels
from .log import EditLog, folded

COUNTED = ("id", "key", "passage_type", "difficulty")
OF_QUESTION = ("question_type",)


def light(passages: DataFrame) -> DataFrame:
    """The same columns, null but for what is counted."""
    question = passages.schema["questions"].dataType.elementType
    thin = lambda q: F.struct(*((q[f.name] if f.name in OF_QUESTION else F.lit(None).cast(f.dataType)).alias(f.name) for f in question))
    columns = {f.name: F.lit(None).cast(f.dataType) for f in passages.schema if f.name not in (*COUNTED, "questions")}
    return passages.withColumns(columns | {"questions": F.transform("questions", thin).cast(passages.schema["questions"].dataType)})


def _one(kind: str, value: Column, n: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), n.cast("long").alias("n"))


def sums(passages: DataFrame, sign: int = 1) -> DataFrame:
    """kind, value, n of some passages, to be added (1) or taken away (-1)."""
    questions, one, none = F.coalesce("questions", F.array().cast(passages.schema["questions"].dataType)), F.lit(1), F.lit(None)
    own = [_one("passages", none, one), _one("questions", none, F.size(questions)), _one("difficulty", F.col("difficulty"), one), _one("passage_type", F.coalesce("passage_type", F.lit("")), one)]
    types = F.transform(questions, lambda q: _one("question_type", F.coalesce(q["question_type"], F.lit("")), one))
    return _added(passages.select(F.explode(F.concat(F.array(*own), types)).alias("s")).select("s.kind", "s.value", (F.col("s.n") * sign).alias("n")))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")


class Counts:
    def __init__(self, log: EditLog):
        self.log = log

    def _since(self, version: int) -> tuple[int, DataFrame, DataFrame]:
        """The newest saved version up to one, its light rows and its sums."""
        saved = [n for n in self.log.versions("counts") if n <= version]
        if not saved:
            raise ValueError(f"{self.log.path} has no counts up to version {version}")
        read = self.log.spark.read
        return saved[-1], *(read.parquet(f"{self.log.path}/counts/{saved[-1]}/{name}") for name in ("light", "sums"))

    def begin(self) -> int:
        """Count the newest state whole; the only time that the library is read."""
        version = self.log.head()
        self._write(version, *(f(self.log.state(version)[0]) for f in (light, sums)))
        return version

    def _write(self, version: int, rows: DataFrame, counted: DataFrame) -> None:
        if version in self.log.versions("counts"):
            return
        written = self.log.elsewhere()
        rows.write.parquet(f"{written}/light")
        counted.coalesce(1).write.parquet(f"{written}/sums")
        self.log.place(written, f"counts/{version}")

    def counts(self, version: int | None = None) -> DataFrame:
        """kind, value, n as of a version, by default the newest."""
        version = self.log.head() if version is None else version
        saved, rows, counted = self._since(version)
        if saved == version:
            return counted
        records = self.log.records(saved, version).where("of = 'passages'")
        touched = rows.join(records.select("id").distinct(), "id", "left_semi").select(rows.columns)
        return _added(counted.unionByName(sums(touched, -1)).unionByName(sums(folded(touched, records, "passages"))))

    def save(self) -> int:
        """Write the newest version's counts, for later ones to begin at."""
        version = self.log.head()
        saved, rows, _ = self._since(version)
        if saved < version:
            self._write(version, light(folded(rows, self.log.records(saved, version), "passages")), self.counts(version))
        return version

    def totals(self, version: int | None = None) -> DataFrame:
        """n_passages, n_questions in one row."""
        of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long")).alias(f"n_{kind}")
        return self.counts(version).agg(of("passages"), of("questions"))

    def level_histogram(self, version: int | None = None) -> DataFrame:
        """difficulty, n for 1 to 5 and for null, zeros included."""
        rows = self.counts(version).where("kind = 'difficulty'")
        return filled_levels(rows.select(F.col("value").cast("int").alias("difficulty"), "n"))

    def facet(self, column: str, version: int | None = None) -> DataFrame:
        """The values of passage_type or question_type, with n, how often they occur. Sort at the edge."""
        return self.counts(version).where(F.col("kind") == column).select(F.col("value").alias(column), "n")
