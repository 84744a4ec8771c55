"""Library files: one JSON object with passages and exam sets, read into frames and written as one file.

A file is cut into its entries in as many tasks as it has splits (json_splits.py), and each entry is taken apart as a VARIANT
of its own, so that numbers given for text become text, and difficulties keep their JSON type until they are cast. A file is
written by as many tasks, in order; its parts are then put behind each other, and the whole takes its place in one step. Paths
may lie in any store that Spark reaches.

Deviations from loose parsing, all by choice: null for a text or a list is the empty one; an unbounded or unparsable
difficulty is null; a root that is no object is an error like broken JSON.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import NEW_EXAM, clamp, new_id, now_iso
from .json_splits import BrokenJson, lists_of, visible
from .store import at as _store

BUFFER = 1 << 16
LINES = pa.schema([("value", pa.string())])


class BrokenLibrary(ValueError):
    """The file isn't a library."""


def _text(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def _texts(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def _nested(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _id(v: Column) -> Column:
    return F.coalesce(F.nullif(F.try_variant_get(v, "$.id", "string"), F.lit("")), new_id())


def _kind(v: Column, path: str = "$") -> Column:
    """The JSON type at a path; the empty text where nothing is."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def _whole(v: Column, path: str = "$") -> Column:
    """Whole numbers in text, and numbers cut to whole ones; all else is null."""
    said = F.regexp_replace(F.try_variant_get(v, path, "string"), r"^\s+|\s+$|(?<=[0-9])_(?=[0-9])", "")
    whole = F.when(F.regexp_like(said, F.lit(r"^[+-]?[0-9]+$")), said.try_cast("bigint"))
    return F.when(_kind(v, path) == "STRING", whole).otherwise(F.try_variant_get(v, path, "bigint"))


def _level(v: Column) -> Column:
    return clamp(_whole(v, "$.difficulty"))


def _question(v: Column) -> Column:
    return F.struct(
        _id(v).alias("id"), _text(v, "number").alias("number"), _text(v, "stem").alias("stem"), _texts(v, "choices").alias("choices"), _text(v, "answer").alias("answer"),
        _text(v, "explanation").alias("explanation"), _text(v, "question_type").alias("question_type"), _level(v).alias("difficulty"), _text(v, "difficulty_source").alias("difficulty_source"),
    )


def _stamp(v: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")), now_iso())


def _passages(entries: DataFrame) -> DataFrame:
    """entries: ord, v (VARIANT)."""
    v = F.col("v")
    return entries.select(
        F.col("ord").cast("long").alias("ord"), _id(v).alias("id"), _text(v, "title").alias("title"), _text(v, "text").alias("text"),
        _text(v, "passage_type").alias("passage_type"), _level(v).alias("difficulty"), _text(v, "difficulty_source").alias("difficulty_source"),
        _text(v, "difficulty_reason").alias("difficulty_reason"), _texts(v, "tags").alias("tags"), _text(v, "source_file").alias("source_file"),
        F.transform(_nested(v, "source_pages"), lambda p: _whole(p).cast("int")).alias("source_pages"),
        F.transform(_nested(v, "questions"), _question).alias("questions"), _stamp(v, "created_at").alias("created_at"), _stamp(v, "updated_at").alias("updated_at"),
    )


def _exams(entries: DataFrame) -> DataFrame:
    v = F.col("v")
    title = F.when(_kind(v, "$.title") == "", NEW_EXAM).otherwise(_text(v, "title"))
    return entries.select(F.col("ord").cast("long").alias("ord"), _id(v).alias("id"), title.alias("title"), _texts(v, "passage_ids").alias("passage_ids"), _stamp(v, "created_at").alias("created_at"))


def decode(root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """passages and exam sets of the rows of root (root: VARIANT object)."""
    passages, exams = (root.select(F.posexplode(_nested(F.col("root"), name)).alias("ord", "v")) for name in ("passages", "exam_sets"))
    return _passages(passages), _exams(exams)


def _no_object(v: Column) -> Column:
    return ~_kind(v).startswith("OBJECT")


def _no_list(v: Column, name: str) -> Column:
    return ~(_kind(v, f"$.{name}").startswith("ARRAY") | _kind(v, f"$.{name}").isin("", "VOID"))


def _bad_question(q: Column) -> Column:
    return _no_object(q) | _no_list(q, "choices")


def _bad_passage(p: Column) -> Column:
    pages = F.exists(_nested(p, "source_pages"), lambda n: _whole(n).try_cast("int").isNull())
    return _no_object(p) | _no_list(p, "tags") | _no_list(p, "source_pages") | pages | _no_list(p, "questions") | F.exists(_nested(p, "questions"), _bad_question)


def _bad_exam(e: Column) -> Column:
    return _no_object(e) | _no_list(e, "passage_ids")


def broken(root: Column) -> Column:
    """Whether a root (VARIANT, null for broken JSON) is no library, at any level."""
    lists = [~(_kind(root, f"$.{name}").startswith("ARRAY") | (_kind(root, f"$.{name}") == "")) for name in ("passages", "exam_sets")]
    exams = F.exists(_nested(root, "exam_sets"), _bad_exam)
    return root.isNull() | _no_object(root) | lists[0] | lists[1] | F.exists(_nested(root, "passages"), _bad_passage) | exams


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """passages and exam sets of a file; BrokenLibrary if it isn't one. Missing ids are drawn anew at each evaluation: write the frames before using them twice.

    An entry must fit in a VARIANT; one that doesn't is an error of its own, as size breaks no library.
    """
    store, at = _store(spark, path)
    if not store.exists(at):
        raise FileNotFoundError(path)
    if not store.getFileStatus(at).isFile():
        raise BrokenLibrary(f"{path} is no file")
    try:
        root, entries = lists_of(spark, visible(spark, path), store.getFileStatus(at).getLen())
    except BrokenJson as error:
        raise BrokenLibrary(str(error)) from None
    numbers = {}
    for name in ("passages", "exam_sets"):
        if not isinstance(root.get(name, []), list):
            raise BrokenLibrary(f"{name} of {path} is no list")
        numbers[name] = root[name][0] if name in root else -1
    own = entries.withColumn("v", F.try_parse_json("json"))
    v, of_list = F.col("v"), F.col("list")
    bad = F.when(F.col("json").isNull(), "no JSON").when(v.isNull(), "too large").when((of_list == numbers["passages"]) & _bad_passage(v), "no passage").when((of_list == numbers["exam_sets"]) & _bad_exam(v), "no exam set")
    # grouped, as a filter on bad would have the entries taken apart for it once more
    found = own.select(bad.alias("bad"), F.struct("list", "i").alias("at")).groupBy("bad").agg(F.min("at").alias("at")).collect()
    faults = sorted((f["bad"] == "too large", *f["at"], f["bad"]) for f in found if f["bad"])
    if faults:
        large, number, i, what = faults[0]
        raise (ValueError if large else BrokenLibrary)(f"{path}: entry {i} of list {number} is {what}")
    passages, exams = (own.where(of_list == number).select(F.col("i").alias("ord"), "v") for number in numbers.values())
    return _passages(passages), _exams(exams)


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], schemas.passages()), spark.createDataFrame([], schemas.exams())


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As read(), but a missing file is an empty library, and a broken one is copied to <name>.corrupt.json and is empty."""
    store, at = _store(spark, path)
    if not store.exists(at):
        return empty(spark)
    try:
        return read(spark, path)
    except BrokenLibrary:
        aside = spark._jvm.org.apache.hadoop.fs.Path(path.removesuffix(".json") + ".corrupt.json")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, at, store, aside, False, spark.sparkContext._jsc.hadoopConfiguration())
        return empty(spark)


def coded(rows: DataFrame) -> DataFrame:
    """ord, json of each row, nulls written."""
    return rows.select("ord", F.to_json(F.struct(*(c for c in rows.columns if c != "ord")), {"ignoreNullFields": "false"}).alias("json"))


def indented(value, before: str = "\n") -> str:
    """As json.dumps(value, ensure_ascii=False, indent=2), lines beginning as before says. What holds no filled lists or objects is printed by the compiled encoder, which json leaves for a slow one where it indents."""
    if not value or not isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    line, left, right = f"{before}  ", *("{}" if isinstance(value, dict) else "[]")
    of = value.values() if isinstance(value, dict) else value
    if not any(x and isinstance(x, (dict, list)) for x in of):
        return f"{left}{line}{json.dumps(value, ensure_ascii=False, separators=(f',{line}', ': '))[1:-1]}{before}{right}"
    names = [f"{json.dumps(k, ensure_ascii=False)}: " for k in value] if isinstance(value, dict) else [""] * len(value)
    return f"{left}{line}" + f",{line}".join(name + indented(x, line) for name, x in zip(names, of, strict=True)) + f"{before}{right}"


def _printed(batches):
    """Entries of a list in the root, indented by two, each with the comma before it and without its last bracket, which is the line separator."""
    for batch in batches:
        texts = [indented(json.loads(x), "\n    ") for x in batch.column("json").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f",\n    {t[:-1]}" for t in texts], pa.string())], schema=LINES)


def _assembled(passages: DataFrame, exams: DataFrame, path: str) -> None:
    """Write a library's one file. Lists are sorted and printed by tasks, into a folder beside it; then the bytes of their parts are put behind each other.

    One file has one writer, so that last step is a copy of streams through a small buffer; no row is held or decoded by it.
    """
    spark = passages.sparkSession
    store, at = _store(spark, path)
    beside, jvm, conf = f"{path}.{uuid.uuid4().hex}", spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    try:
        lists = {"passages": passages, "exam_sets": exams}
        for name, rows in lists.items():
            coded(rows).orderBy("ord").select("json").mapInArrow(_printed, "value string").write.option("lineSep", "}").text(f"{beside}/{name}")
        store.setWriteChecksum(False)  # a file of checksums beside it would make other programs' changes look like damage
        out = store.create(at, True)
        try:
            out.write(bytearray(f'{{\n  "schema_version": {schemas.SCHEMA_VERSION}'.encode()))
            for name in lists:
                found = [f for f in store.listStatus(_store(spark, f"{beside}/{name}")[1]) if f.getPath().getName().startswith("part-") and f.getLen()]
                found.sort(key=lambda f: int(f.getPath().getName().split("-")[1]))
                out.write(bytearray(f',\n  "{name}": ['.encode()))
                for f in found:
                    source = store.open(f.getPath())
                    try:
                        source.seek(int(f is found[0]))  # behind the comma that is before the first
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BUFFER, False)
                    finally:
                        source.close()
                out.write(bytearray(b"\n  ]" if found else b"]"))
            out.write(bytearray(b"\n}"))
        finally:
            out.close()
    finally:
        store.setWriteChecksum(True)
        store.delete(jvm.org.apache.hadoop.fs.Path(beside), True)


def export(passages: DataFrame, exams: DataFrame, path: str) -> None:
    """Write the library to a file, over what is there."""
    _assembled(passages, exams, path)


def save(passages: DataFrame, exams: DataFrame, path: str) -> None:
    """Write beside the file and then take its place, so a reader sees the old library or the new, and after a failure the old one is there."""
    spark = passages.sparkSession
    try:
        _assembled(passages, exams, f"{path}.tmp")
        _renamed(spark, f"{path}.tmp", path)
    finally:
        store, beside = _store(spark, f"{path}.tmp")
        store.delete(beside, False)


def replace(spark: SparkSession, path: str, text: str, mode: str | None = None) -> None:
    """The file with that text, put there in one step; mode: access rights, where the store has them."""
    _write(spark, f"{path}.tmp", text)
    if mode:
        store, beside = _store(spark, f"{path}.tmp")
        store.setPermission(beside, spark._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))
    _renamed(spark, f"{path}.tmp", path)


def _renamed(spark: SparkSession, path: str, to: str) -> None:
    """Take the place of a file in one step."""
    jvm, (store, at) = spark._jvm, _store(spark, to)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(store.getUri().toString()), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(_store(spark, path)[1], at, overwrite)


def _write(spark: SparkSession, path: str, text: str) -> None:
    store, at = _store(spark, path)
    store.setWriteChecksum(False)  # a file of checksums beside it would make other programs' changes look like damage
    try:
        out = store.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
    finally:
        store.setWriteChecksum(True)
