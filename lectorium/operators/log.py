"""Edits of a library as a log: an edit adds a record, and nothing else is written.

A log is a folder: base/N holds the whole library as of version N, log/N the records that made version N of N - 1. A version's
folder is written elsewhere and takes its name in one step, which fails if that version is there, so of two writers that
started from one version only one goes on, and the other is told (StaleVersion). A state is the newest base below a version and
the records behind it, folded: the records of a row are put in order and applied to it one after the other, in one expression;
rows without any are not touched. compact() writes a state as a base, which bounds what is folded.

The records of one commit are applied in their order. Times are those of the records, so a state is the same whenever it is
read. Rows have an order key (order_keys.py): that of an appended one is made of its version and its place in the commit, so
it needs no look at other rows. What edits do to a row is what the functions of edits.py and exams.py do.

Defined cases. An edit of a row that isn't there does nothing, but add_to_exam makes its exam; a put of one that is there
replaces it, in its place. Levels are clamped. Ids are taken to be unique; of repeated ids each row is edited.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.arrays import add_entries, swapped, without, without_rows
from ..functions.order_keys import LONGEST, WIDTH, appended_key, between, key_of, spread
from ..functions.text import NEW_EXAM, clamp, now_iso, strip
from ..sources.store import at as _at

PASSAGE = schemas.PASSAGES.split(", ", 2)[2]  # without ord and id
#: One record: what is to be done to the row of that id. values: texts by field name; level, index and step: numbers; rows and ids: lists.
RECORD = (
    f"of string, id string, op string, values map<string, string>, level int, index int, step int, rows array<int>, ids array<string>, question {schemas.QUESTION}, "
    f"passage struct<{PASSAGE}>"
)
OPS = {
    "passages": ("put", "delete", "update", "rate", "update_question", "rate_question", "add_question", "delete_question", "move_question", "rekey"),
    "exams": ("new", "delete", "rename", "add", "remove", "move", "reorder", "forget", "rekey"),
}


class StaleVersion(RuntimeError):
    """The log has gone on since the version that an edit started from."""


def edit(of: str, op: str, id_: str | None = None, **given) -> dict:
    """A record. of: passages or exams; an op "forget" of exams has no id and takes a passage (values: passage) out of all of them."""
    if op not in OPS[of]:
        raise ValueError(f"{op} is no edit of {of}")
    return {"of": of, "id": id_, "op": op} | given


def remove_passage(id_: str) -> list[dict]:
    """The passage goes, and all its places in exams."""
    return [edit("passages", "delete", id_), edit("exams", "forget", values={"passage": id_})]


def _with(row: Column, **values: Column) -> Column:
    for name, value in values.items():
        row = row.withField(name, value)
    return row


def _passage_after(row: Column, o: Column, kind: T.StructType) -> Column:
    """A passage (struct, null if there is none) after one record."""
    value = lambda name: F.coalesce(F.element_at(o["values"], name), F.lit(""))
    none = F.lit(None).cast(kind)
    put = F.struct(*((F.coalesce(row["key"], o["key"]) if n == "key" else o["passage"][n]).cast(kind[n].dataType).alias(n) for n in kind.names))
    question = lambda change: F.transform(row["questions"], lambda q, i: F.when(i == o["index"], change(q)).otherwise(q))
    told = lambda q: _with(q, number=strip(value("number")), question_type=strip(value("question_type")), answer=strip(value("answer")), stem=value("stem"), explanation=value("explanation"), choices=F.coalesce(o["ids"], F.array().cast("array<string>")))
    new = o["question"].withField("number", (F.size(row["questions"]) + 1).cast("string"))
    changes = {
        "update": _with(row, title=value("title"), passage_type=strip(value("passage_type")), text=value("text"), updated_at=o["at"]),
        "rate": _with(row, difficulty=clamp(o["level"]), difficulty_source=F.lit("manual"), updated_at=o["at"]),
        "update_question": _with(row, questions=question(told), updated_at=o["at"]),
        "rate_question": _with(row, questions=question(lambda q: _with(q, difficulty=clamp(o["level"]), difficulty_source=F.lit("manual"))), updated_at=o["at"]),
        "add_question": _with(row, questions=F.concat(row["questions"], F.array(new))),
        "delete_question": _with(row, questions=F.filter(row["questions"], lambda q, i: i != o["index"])),
        "move_question": _with(row, questions=F.when(o["step"] < 0, swapped(row["questions"], F.array(o["index"]), -1)).otherwise(swapped(row["questions"], F.array(o["index"]), 1))),
        "rekey": _with(row, key=value("key")),
    }
    out = F.when(o["op"] == "put", put).when(o["op"] == "delete", none).when(row.isNull(), none)
    for name, after in changes.items():
        out = out.when(o["op"] == name, after)
    return out.otherwise(row)


def _exam_after(row: Column, o: Column, kind: T.StructType) -> Column:
    value = lambda name: F.element_at(o["values"], name)
    none, nothing = F.lit(None).cast(kind), F.array().cast("array<string>")
    ids, rows = F.coalesce(o["ids"], nothing), F.coalesce(o["rows"], F.array().cast("array<int>"))
    made = lambda own: F.struct(*({"key": o["key"], "title": F.coalesce(value("title"), F.lit(NEW_EXAM)), "passage_ids": own, "created_at": o["at"]}[n].cast(kind[n].dataType).alias(n) for n in kind.names))
    place = F.coalesce(o["index"], F.lit(-1))
    added = F.when(row.isNull(), made(add_entries(nothing, ids, place))).otherwise(_with(row, passage_ids=add_entries(row["passage_ids"], ids, place)))
    changes = {
        "rename": _with(row, title=value("title")),
        "remove": _with(row, passage_ids=without_rows(row["passage_ids"], rows)),
        "move": _with(row, passage_ids=F.when(o["step"] < 0, swapped(row["passage_ids"], rows, -1)).otherwise(swapped(row["passage_ids"], rows, 1))),
        "reorder": _with(row, passage_ids=ids),
        "forget": _with(row, passage_ids=without(row["passage_ids"], value("passage"))),
        "rekey": _with(row, key=value("key")),
    }
    out = F.when(o["op"] == "new", F.coalesce(row, made(nothing))).when((o["op"] == "add") & (F.size(ids) > 0), added).when(o["op"] == "delete", none).when(row.isNull(), none)
    for name, after in changes.items():
        out = out.when(o["op"] == name, after)
    return out.otherwise(row)


def folded(base: DataFrame, records: DataFrame, of: str) -> DataFrame:
    """base (id, key, ..) after records of that kind (version, seq, at, id, op, ..). Only rows that records name are rebuilt, or, after a "forget", those that hold its passage."""
    names = [c for c in base.columns if c != "id"]
    kind, after = base.select(*names).schema, _passage_after if of == "passages" else _exam_after
    own = records.where(F.col("of") == of).withColumn("key", appended_key(F.col("version"), F.col("seq")))
    packed = F.struct(*(c for c in own.columns if c not in ("of", "id")))
    by_id = own.where("id IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(F.collect_list(packed).alias("ops"))
    rows = base.select("id", F.struct(*names).alias("row")).join(by_id, F.col("id") == F.col("_id"), "full")
    rows = rows.select(F.coalesce("id", "_id").alias("id"), "row", F.coalesce("ops", F.array().cast(by_id.schema["ops"].dataType)).alias("ops"))
    if of == "exams":  # one row: the passages that were taken out of all exams, as many as there are such records since the base
        every = own.where("id IS NULL").agg(F.collect_list(packed).alias("every"))
        listed = F.coalesce(F.col("row.passage_ids"), F.array().cast("array<string>"))
        held = F.filter("every", lambda o: (F.size("ops") > 0) | F.array_contains(listed, F.element_at(o["values"], "passage")))
        rows = rows.join(F.broadcast(every), how="cross").withColumn("ops", F.concat("ops", held)).drop("every")
    changed = F.aggregate(F.array_sort("ops", _by_place), F.col("row"), lambda row, o: after(row, o, kind))
    out = rows.select("id", F.when(F.size("ops") == 0, F.col("row")).otherwise(changed).alias("row")).where("row IS NOT NULL")
    return out.select("id", "row.*").select(base.columns)


def _by_place(a: Column, b: Column) -> Column:
    before = (a["version"] < b["version"]) | ((a["version"] == b["version"]) & (a["seq"] < b["seq"]))
    return F.when(before, -1).when((a["version"] == b["version"]) & (a["seq"] == b["seq"]), 0).otherwise(1)


class EditLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self, what: str) -> list[int]:
        store, folder = _at(self.spark, f"{self.path}/{what}")
        return sorted(int(f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().isdigit()) if store.exists(folder) else []

    def place(self, written: str, name: str) -> bool:
        """Give a folder its name in one step; False if the name is taken."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        (store, source), (_, target) = _at(self.spark, written), _at(self.spark, f"{self.path}/{name}")
        store.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(store.getUri().toString()), conf)
        try:
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if not store.exists(target):
                raise
            store.delete(source, True)
            return False
        return True

    def elsewhere(self) -> str:
        return f"{self.path}/new/{uuid.uuid4().hex}"

    def create(self, passages: DataFrame, exams: DataFrame) -> int:
        """Version 0: a library with ord for its order."""
        self._base(*(rows.withColumn("key", key_of(F.col("ord"))).drop("ord") for rows in (passages, exams)), 0)
        return 0

    def _base(self, passages: DataFrame, exams: DataFrame, version: int) -> None:
        written = self.elsewhere()
        passages.write.parquet(f"{written}/passages")
        exams.write.parquet(f"{written}/exams")
        if not self.place(written, f"base/{version}") and not version:
            raise StaleVersion(f"{self.path} is there")

    def head(self) -> int:
        return max(self.versions("log")[-1:] + self.versions("base")[-1:])

    def append(self, edits: Iterable[dict] | DataFrame, base: int) -> int:
        """The version after base, made by those edits (of edit(), or a frame of RECORD with seq); StaleVersion if there is one already."""
        if base != self.head():
            raise StaleVersion(f"{self.path} is at {self.head()}, not at {base}")
        if not isinstance(edits, DataFrame):
            kind = T.StructType.fromDDL(f"seq int, {RECORD}")
            edits = self.spark.createDataFrame([tuple((e | {"seq": n}).get(c) for c in kind.names) for n, e in enumerate(edits)], kind)
        written = self.elsewhere()
        edits.withColumn("at", now_iso()).write.parquet(written)
        if not self.place(written, f"log/{base + 1}"):
            raise StaleVersion(f"{self.path} has gone on from {base}")
        return base + 1

    def records(self, after: int, upto: int) -> DataFrame:
        """The records of versions after one, up to another, with their version."""
        kind = T.StructType.fromDDL(f"seq int, {RECORD}, at string")
        found = [self.spark.read.schema(kind).parquet(f"{self.path}/log/{n}").withColumn("version", F.lit(n).cast("long")) for n in range(after + 1, upto + 1)]
        out = self.spark.createDataFrame([], T.StructType.fromDDL(f"seq int, {RECORD}, at string, version long"))
        for one in found:
            out = out.unionByName(one)
        return out

    def _bases(self, version: int) -> tuple[int, DataFrame, DataFrame]:
        base = max(n for n in self.versions("base") if n <= version)
        return base, *(self.spark.read.parquet(f"{self.path}/base/{base}/{name}") for name in ("passages", "exams"))

    def state(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """passages and exams (id, key and their columns) as of a version, by default the newest."""
        version = self.head() if version is None else version
        base, passages, exams = self._bases(version)
        if base == version:
            return passages, exams
        records = self.records(base, version)
        return folded(passages, records, "passages"), folded(exams, records, "exams")

    def placed(self, of: str, id_: str, before: str | None) -> list[dict]:
        """The edits that put a row before another (None: at the end): a new key for it, and only where keys got long for its neighbours too."""
        rows = self.state()[0 if of == "passages" else 1].select("id", "key").where(F.col("id") != id_)
        high = rows.where(F.col("id") == before).agg(F.min("key")).first()[0] if before is not None else None
        below = rows.where(F.col("key") < high) if high else rows
        key = between(below.agg(F.max("key")).first()[0], high)
        if len(key) <= LONGEST:
            return [edit(of, "rekey", id_, values={"key": key})]
        short, under = F.length("key") <= WIDTH + 1, F.col("key") < high if high else F.lit(True)
        low, top = rows.agg(F.max(F.when(short & under, F.col("key"))), F.min(F.when(short & ~under, F.col("key")))).first()
        stretch = rows.where(~short & (F.col("key") > (low or "")) & (F.col("key") < (top or "g"))).orderBy("key").collect()
        at = sum(r["key"] < high for r in stretch) if high else len(stretch)
        ids = [r["id"] for r in stretch[:at]] + [id_] + [r["id"] for r in stretch[at:]]
        return [edit(of, "rekey", i, values={"key": k}) for i, k in zip(ids, spread(low, top, len(ids)), strict=True)]

    def compact(self) -> int:
        """Write the newest state as a base; logs up to it stay, for states of older versions."""
        version = self.head()
        if version not in self.versions("base"):
            self._base(*self.state(version), version)
        return version
