"""Change notices of a logged library: which exams a stretch of versions made, changed or took away, and their summaries since.

A notice is about an exam whose title, list or summary differs between two versions; the summary follows its passages, so a
new rating or a deleted passage gives notices of the exams that hold it. Looked at are the exams that records name and those
whose base lists hold a passage that records name, at both versions, folded (log.py) with the passages they list and no others:
lists are read by id alone, and texts not at all. Applied in order, the notices of any split of the versions make of the
summaries at the first version those at the last.

tell() writes the notices since the last told version as a version of its own (notices/N), in one step: of two tellers one
is the first and the other's, the same, go. follow() tells whenever the log has gone on, as a stream; if it is stopped and
started it goes on from what was told, whatever its checkpoint says, so no notice is given twice or left out.

Defined cases. Exams that come and go within a stretch have no notice. A stretch without records has none. An exam's passages
that the library lacks count for nothing. Ids are taken to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from . import exams as sets
from .counts import light
from .log import RECORD, EditLog, folded

SUMMARY = ("title", "n_passages", "n_questions", "average")


def summaries(passages: DataFrame, exams: DataFrame) -> DataFrame:
    """exam_id, title, ids (its list), n_passages, n_questions, average of a state."""
    none = F.array().cast(passages.schema["questions"].dataType)
    questions = passages.select(F.col("id").alias("passage_id"), F.explode(F.coalesce("questions", none)))
    told = sets.summary(exams, passages.select(F.col("key").alias("ord"), "id", "difficulty"), questions)
    return exams.select(F.col("id").alias("exam_id"), "title", F.col("passage_ids").alias("ids")).join(told, "exam_id")


def _named(rows: DataFrame, wanted: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(wanted.select(F.col("id").alias(column)), column, "left_semi").select(rows.columns)


class Changes:
    def __init__(self, log: EditLog):
        self.log = log

    def between(self, after: int, upto: int) -> DataFrame:
        """exam_id, kind (new, changed, gone) and, but for those gone, SUMMARY as of upto."""
        base, passages, exams = self.log._bases(after)
        records = self.log.records(base, upto)
        late = records.where(F.col("version") > after)
        forgotten = records.where("of = 'exams' AND id IS NULL").select(F.element_at("values", "passage").alias("id"))
        moved = late.where("of = 'passages'").select("id").unionByName(forgotten).distinct()
        holding = _named(exams.select("id", F.explode("passage_ids").alias("passage_id")), moved, "passage_id").select("id")
        looked_at = holding.unionByName(records.where("of = 'exams' AND id IS NOT NULL").select("id")).distinct()
        own = records.where("of = 'exams'")
        own = _named(own.where("id IS NOT NULL"), looked_at).unionByName(own.where("id IS NULL"))
        exams, thin = _named(exams, looked_at), light(passages)

        def state(version: int) -> DataFrame:
            some = folded(exams, own.where(F.col("version") <= version), "exams")
            listed = some.select(F.explode("passage_ids").alias("id")).distinct()
            edited = _named(records.where((F.col("of") == "passages") & (F.col("version") <= version)), listed)
            return summaries(folded(_named(thin, listed), edited, "passages"), some)

        packed = lambda rows, name: rows.select("exam_id", F.struct(*(c for c in rows.columns if c != "exam_id")).alias(name))
        both = packed(state(after), "was").join(packed(state(upto), "now"), "exam_id", "full").where(~F.col("was").eqNullSafe(F.col("now")))
        kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed")
        return both.select("exam_id", kind.alias("kind"), *(F.col(f"now.{c}").alias(c) for c in SUMMARY))

    def told(self) -> int:
        """The last version that was told of: the first base where none was."""
        return max(self.log.versions("notices")[-1:] + self.log.versions("base")[:1])

    def tell(self, upto: int | None = None) -> int:
        """Write the notices since the last told version; nothing where the log has not gone on."""
        after, upto = self.told(), self.log.head() if upto is None else upto
        if upto > after:
            written = self.log.elsewhere()
            self.between(after, upto).withColumn("after", F.lit(after).cast("long")).withColumn("upto", F.lit(upto).cast("long")).write.parquet(written)
            self.log.place(written, f"notices/{upto}")
        return upto

    def notices(self, after: int | None = None) -> DataFrame:
        """All written notices with the stretch (after, upto) that each is of, or those of stretches from a version on."""
        kind = T.StructType.fromDDL("exam_id string, kind string, title string, n_passages long, n_questions long, average string, after long, upto long")
        if not self.log.versions("notices"):
            return self.log.spark.createDataFrame([], kind)
        rows = self.log.spark.read.schema(kind).parquet(f"{self.log.path}/notices/*")
        return rows if after is None else rows.where(F.col("after") >= after)

    def follow(self, checkpoint: str, **trigger) -> StreamingQuery:
        """Tell of versions as the log gets them. trigger: as for a stream's trigger(), e.g. availableNow=True."""
        rows = self.log.spark.readStream.schema(T.StructType.fromDDL(f"seq int, {RECORD}, at string")).parquet(f"{self.log.path}/log/*")
        seen = rows.select(_version(F.col("_metadata.file_path")).alias("version"))

        def batch(versions: DataFrame, _: int) -> None:
            newest = versions.agg(F.max("version")).first()[0]
            if newest is not None:
                self.tell(int(newest))

        return seen.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _version(path: Column) -> Column:
    return F.regexp_extract(path, r"/log/(\d+)/[^/]*$", 1).cast("long")


def applied(summary: DataFrame, notices: DataFrame) -> DataFrame:
    """Summaries (exam_id, SUMMARY) after notices with their stretches: each exam's last one decides."""
    last = notices.groupBy("exam_id").agg(F.max_by(F.struct("kind", *SUMMARY), "upto").alias("last"))
    rows = summary.select("exam_id", F.struct(*SUMMARY).alias("own")).join(last, "exam_id", "full").where("last IS NULL OR last.kind <> 'gone'")
    pick = lambda c: F.when(F.col("last").isNull(), F.col(f"own.{c}")).otherwise(F.col(f"last.{c}"))
    return rows.select("exam_id", *(pick(c).alias(c) for c in SUMMARY))
