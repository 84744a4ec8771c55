"""Query catalogue, continued: edits of a library, its file format, settings and outside calls."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import arrays, text
from ..operators import browse, edits
from ..operators.counts import Counts
from ..operators.log import RECORD, EditLog
from ..sources import external, library_file
from ..sources.store import shared_folder
from . import adapters
from .registry import query

C = """c AS (SELECT conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i, '' AS number, text AS stem, role AS question_type, role AS choices, '' AS answer,
  (1 + turn % 5)::INT AS difficulty, '' AS difficulty_source, false AS moved FROM conversations)"""
E = """e AS (SELECT o_custkey AS id, flatten(list(CASE WHEN o_orderkey % 10 = 0 THEN [o_orderkey, -o_orderkey] ELSE [o_orderkey] END ORDER BY o_orderdate, o_orderkey)) AS ids FROM orders GROUP BY 1)"""
Q = "id, i, number, md5(stem) AS stem, question_type, choices, answer, difficulty, difficulty_source, moved"
SHOWN = "id, 'exam ' || id AS title, list_aggregate(ids, 'string_agg', ',') AS ids"


def _questions(rows):
    each = rows.select("id", (F.col("updated_at") != "then").alias("moved"), F.posexplode("questions").alias("i", "q"))
    return each.select("id", "i", "q.number", F.md5("q.stem").alias("stem"), "q.question_type", text.text_of(F.col("q.choices")).alias("choices"), "q.answer", "q.difficulty", "q.difficulty_source", "moved")


def _exams(rows):
    return rows.select("id", "title", F.nullif(F.array_join(F.transform("passage_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("ids"))


@query("SELECT doc_id AS id, doc_id AS ord, lang AS passage_type FROM documents UNION ALL SELECT -1, max(doc_id) + 1, 'new' FROM documents")
def insert_passage(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir).select("id", "ord", "passage_type")
    return edits.append(rows, spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("ord"), F.lit("new").alias("passage_type")))


@query("SELECT doc_id AS id, CASE WHEN doc_id = 5 THEN ' t ' ELSE '' END AS title, CASE WHEN doc_id = 5 THEN 'k' ELSE lang END AS passage_type, md5(CASE WHEN doc_id = 5 THEN ' x ' ELSE text END) AS text, doc_id = 5 AS moved FROM documents")
def update_passage(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir).withColumn("updated_at", F.lit("then"))
    return edits.update_passage(rows, 5, title=" t ", passage_type=" k ", text=" x ").select("id", "title", "passage_type", F.md5("text").alias("text"), (F.col("updated_at") != "then").alias("moved"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 6 THEN 4 ELSE left(o_orderpriority, 1)::INT END AS difficulty, CASE WHEN o_orderkey = 6 THEN 'manual' ELSE '' END AS difficulty_source, o_orderkey = 6 AS moved FROM orders")
def rate_passage(spark, sf_dir):
    rows = adapters.passages_of_orders(spark, sf_dir).withColumns({"updated_at": F.lit("then"), "difficulty_source": F.lit("")})
    return edits.rate_passage(rows, 6, 4).select("id", "difficulty", "difficulty_source", (F.col("updated_at") != "then").alias("moved"))


@query(f"""WITH {C}, u AS (SELECT * REPLACE (CASE WHEN id = 3 AND i = 1 THEN '9' ELSE number END AS number, CASE WHEN id = 3 AND i = 1 THEN ' s ' ELSE stem END AS stem, CASE WHEN id = 3 AND i = 1 THEN 'z' ELSE question_type END AS question_type,
  CASE WHEN id = 3 AND i = 1 THEN 'a' || chr(10) || 'b' ELSE choices END AS choices, CASE WHEN id = 3 AND i = 1 THEN '1' ELSE answer END AS answer, id = 3 AS moved) FROM c) SELECT {Q} FROM u""")
def update_question(spark, sf_dir):
    rows = adapters.library_of_conversations(spark, sf_dir)
    return _questions(edits.update_question(rows, 3, 1, number=" 9 ", question_type=" z ", answer=" 1 ", stem=" s ", explanation=" e ", choices=["a", "b"]))


@query(f"WITH {C}, u AS (SELECT * REPLACE (CASE WHEN id = 3 AND i = 0 THEN 5 ELSE difficulty END AS difficulty, CASE WHEN id = 3 AND i = 0 THEN 'manual' ELSE '' END AS difficulty_source, id = 3 AS moved) FROM c) SELECT {Q} FROM u")
def rate_question(spark, sf_dir):
    return _questions(edits.rate_question(adapters.library_of_conversations(spark, sf_dir), 3, 0, 9))


@query(f"WITH {C} SELECT {Q} FROM c UNION ALL SELECT id, max(i) + 1, (max(i) + 2)::VARCHAR, md5(min_by(stem, i)), min_by(question_type, i), min_by(choices, i), '', min_by(difficulty, i), '', false FROM c WHERE id = 3 GROUP BY id")
def add_question(spark, sf_dir):
    return _questions(edits.add_question(adapters.library_of_conversations(spark, sf_dir), 3, F.get("questions", 0)))


@query(f"WITH {C}, u AS (SELECT * REPLACE (CASE WHEN id = 3 AND i > 1 THEN i - 1 ELSE i END AS i) FROM c WHERE id <> 3 OR i <> 1) SELECT {Q} FROM u")
def delete_question(spark, sf_dir):
    return _questions(edits.delete_question(adapters.library_of_conversations(spark, sf_dir), 3, 1))


@query(f"WITH {C}, u AS (SELECT * REPLACE (CASE WHEN id = 3 AND i = 0 AND (SELECT count(*) FROM c WHERE id = 3) > 1 THEN 1 WHEN id = 3 AND i = 1 THEN 0 ELSE i END AS i) FROM c) SELECT {Q} FROM u")
def move_question(spark, sf_dir):
    return _questions(edits.move_question(adapters.library_of_conversations(spark, sf_dir), 3, 0, 1))


@query(f"WITH {E} SELECT {SHOWN} FROM e UNION ALL SELECT -1, '시험지 ' || (count(*) + 1), NULL FROM e")
def exam_new(spark, sf_dir):
    return _exams(edits.new_exam(adapters.exam_sets_of_customers(spark, sf_dir), -1))


@query(f"WITH {E} SELECT {SHOWN} FROM e WHERE id <> 4")
def exam_delete(spark, sf_dir):
    return _exams(edits.delete(adapters.exam_sets_of_customers(spark, sf_dir), 4))


@query(f"WITH {E} SELECT id, CASE WHEN id = 4 THEN 'new title' ELSE 'exam ' || id END AS title, list_aggregate(ids, 'string_agg', ',') AS ids FROM e")
def exam_rename(spark, sf_dir):
    return _exams(edits.rename_exam(adapters.exam_sets_of_customers(spark, sf_dir), 4, "new title"))


@query(f"WITH {E} SELECT {SHOWN} FROM e UNION ALL SELECT -5, '시험지 ' || (count(*) + 1), '3,3,4' FROM e")
def add_to_new_exam(spark, sf_dir):
    return _exams(edits.add_to_exam(adapters.exam_sets_of_customers(spark, sf_dir), -5, [3, 3, 4], 9))


@query(f"WITH {E} SELECT id, 'exam ' || id AS title, CASE WHEN id = 4 THEN '8,7,9' ELSE list_aggregate(ids, 'string_agg', ',') END AS ids FROM e")
def reorder_exam(spark, sf_dir):
    return _exams(edits.reorder_exam(adapters.exam_sets_of_customers(spark, sf_dir), 4, [8, 7, 9]))


@query(f"WITH {E} SELECT {SHOWN} FROM e WHERE id = 4")
def get_exam(spark, sf_dir):
    return _exams(browse.first_by_id(adapters.exam_sets_of_customers(spark, sf_dir), 4))


@query("SELECT doc_id AS id, true AS id_ok, true AS time_ok FROM documents")
def new_ids(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.new_id().alias("x"), text.now_iso().alias("t"))
    return rows.select("id", F.col("x").rlike("^[0-9a-f]{12}$").alias("id_ok"), F.col("t").rlike("^[0-9]{4}(-[0-9]{2}){2}T[0-9]{2}(:[0-9]{2}){2}[+]00:00$").alias("time_ok"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a=' || event_type || ',' ELSE '' END || 'c=1' AS options, CASE WHEN event_id % 2 = 0 THEN 'a=' || event_type ELSE '' END AS known FROM events")
def given_options(spark, sf_dir):
    options = F.create_map(F.lit("a"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("1"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return adapters.table(spark, sf_dir, "events").select("event_id", shown(arrays.given(options)).alias("options"), shown(arrays.given(options, ["a", "b"])).alias("known"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '(미지정)' ELSE event_type END AS type, CASE event_id % 3 WHEN 0 THEN 'set' WHEN 1 THEN event_type ELSE '' END AS key FROM events")
def placeholders_and_keys(spark, sf_dir):
    at = F.col("event_id") % 3
    kind = F.when(at == 0, F.when(F.col("event_id") % 2 == 0, "")).otherwise(F.col("event_type"))
    key = text.filled(F.when(at == 0, " set ").otherwise(" \t"), F.when(at != 2, F.concat(F.col("event_type"), F.lit("\n"))))
    return adapters.table(spark, sf_dir, "events").select("event_id", text.type_name(kind).alias("type"), key.alias("key"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '.' ELSE '/in/' || event_type END AS folder, event_type || chr(10) || 'b' AS choices, CASE WHEN event_id % 2 = 0 THEN '0,2,9' ELSE '2' END AS rows FROM events")
def folders_choices_and_selections(spark, sf_dir):
    at = F.col("event_id") % 3
    path = F.when(at == 0, "/a.pdf").when(at == 1, "a.pdf").otherwise(F.concat(F.lit("/in/"), F.col("event_type"), F.lit("//a.pdf")))
    rows = F.when(F.col("event_id") % 2 == 0, F.array(*map(F.lit, (9, 2, 0, 2)))).otherwise(F.array(F.lit(2)))
    return adapters.table(spark, sf_dir, "events").select(
        "event_id", text.parent_of(path).alias("folder"), text.text_of(F.array(F.col("event_type"), F.lit("b"))).alias("choices"), F.array_join(F.transform(arrays.selection(rows), lambda x: x.cast("string")), ",").alias("rows")
    )


@query("SELECT doc_id::VARCHAR AS id, lang AS title, [3, 4, 5, 1, 3, 1, NULL, NULL][(doc_id % 8 + 1)::INT]::INT AS difficulty, '1,b' AS tags, (doc_id % 5) || ',7' AS pages, '18' AS number, '2,c' AS choices FROM documents")
def decode_passages(spark, sf_dir):
    files = adapters.libraries_of_documents(spark, sf_dir)
    rows, _ = library_file.decode(files.select(F.try_parse_json("file").alias("root")))
    one = F.get("questions", 0)
    pages = F.array_join(F.transform("source_pages", lambda x: x.cast("string")), ",")
    return rows.select("id", "title", "difficulty", F.array_join("tags", ",").alias("tags"), pages.alias("pages"), one["number"].alias("number"), F.array_join(one["choices"], ",").alias("choices"))


@query("SELECT 'e' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN '새 시험지' ELSE '' END AS title, doc_id::VARCHAR AS ids FROM documents")
def decode_exams(spark, sf_dir):
    files = adapters.libraries_of_documents(spark, sf_dir)
    return _exams(library_file.decode(files.select(F.try_parse_json("file").alias("root")))[1])


@query("SELECT doc_id, doc_id % 5 <> 0 AS broken FROM documents")
def broken_libraries(spark, sf_dir):
    files = adapters.libraries_of_documents(spark, sf_dir)
    at = F.col("doc_id") % 5
    bad = F.when(at == 0, F.col("file")).when(at == 1, F.replace("file", F.lit(', "7"]'), F.lit(', "x"]'))).when(at == 2, F.replace("file", F.lit('"passages": ['), F.lit('"passages": [5, ')))
    bad = bad.when(at == 3, F.replace("file", F.lit('"choices": [2, "c"]'), F.lit('"choices": 2'))).otherwise(F.concat(F.lit("["), "file", F.lit("]")))
    return files.select("doc_id", library_file.broken(F.try_parse_json(bad)).alias("broken"))


@query(f"""WITH {E} SELECT id AS ord, '{{"id":' || id || ',"title":"exam ' || id || '","passage_ids":[' || list_aggregate(ids, 'string_agg', ',') || '],"created_at":' || CASE WHEN id % 2 = 0 THEN 'null' ELSE '"then"' END || '}}' AS json FROM e""")
def encode_exams(spark, sf_dir):
    rows = adapters.exam_sets_of_customers(spark, sf_dir)
    return library_file.coded(rows.withColumn("created_at", F.when(F.col("id") % 2 == 1, F.col("created_at"))))


def _library(spark, sf_dir):
    """documents and customers' exams with all columns of a library, ids as texts."""
    docs = adapters.passages_of_documents(spark, sf_dir).withColumnRenamed("id", "_id")
    lists = {f.name: F.array().cast(f.dataType) for f in schemas.passages() if f.dataType.simpleString().startswith("array")}
    texts = {f.name: F.lit("") for f in schemas.passages() if f.name not in docs.columns and f.name not in lists}
    passages = docs.withColumns(texts | lists | {"id": F.col("_id").cast("string")}).select(*(f.name for f in schemas.passages()))
    exams = adapters.exam_sets_of_customers(spark, sf_dir).withColumns({"id": F.col("id").cast("string"), "passage_ids": F.col("passage_ids").cast("array<string>")})
    return passages, exams


def _filed(spark, sf_dir):
    """The library, saved as a file in the shared folder and read from it."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/library.json"
    library_file.save(*_library(spark, sf_dir), path)
    return library_file.load(spark, path)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id::VARCHAR AS id, lang AS passage_type, 1 + quality + 2 * toxic AS difficulty, md5(text) AS text, source AS source_file FROM documents LEFT JOIN labels USING (doc_id)")
def saved_passages(spark, sf_dir):
    return _filed(spark, sf_dir)[0].select("ord", "id", "passage_type", "difficulty", F.md5("text").alias("text"), "source_file")


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY id) - 1 AS ord, {SHOWN.replace('id,', 'id::VARCHAR AS id,', 1)} FROM e")
def saved_exams(spark, sf_dir):
    rows = _filed(spark, sf_dir)[1]
    return rows.select("ord", "id", "title", F.array_join("passage_ids", ",").alias("ids"))


def _logged(spark, sf_dir, begin=lambda log: None):
    """The library after two commits: rates and deletions from labels, and edits of exams. begin is called before them."""
    edits_log = EditLog(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    edits_log.create(*_library(spark, sf_dir))
    begin(edits_log)
    kind = T.StructType.fromDDL(f"seq int, {RECORD}")
    filled = lambda frame, **given: frame.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))
    labels = adapters.table(spark, sf_dir, "labels")
    level = F.when(F.col("quality") == 1, 9).otherwise(F.lit(None))
    rated = filled(labels, seq=F.lit(0), of=F.lit("passages"), id=F.col("doc_id"), op=F.when(F.col("toxic") == 1, "delete").otherwise("rate"), level=level)
    edits_log.append(rated, 0)
    exams, at = adapters.exam_sets_of_customers(spark, sf_dir).select("id"), F.col("id") % 3
    op = F.when(at == 0, "remove").when(at == 1, "move").otherwise("rename")
    edits_log.append(filled(exams, seq=F.lit(0), of=F.lit("exams"), id=F.col("id"), op=op, rows=F.array(F.lit(0)), step=F.lit(1), values=F.create_map(F.lit("title"), F.lit("renamed"))), 1)
    return edits_log


@query(
    """SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id::VARCHAR AS id, lang AS passage_type, CASE WHEN quality = 1 THEN 5 END AS difficulty, CASE WHEN quality IS NOT NULL THEN 'manual' ELSE '' END AS difficulty_source, md5(text) AS text
FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0"""
)
def logged_passages(spark, sf_dir):
    rows = _logged(spark, sf_dir).state()[0]
    first = rows.select("key").repartitionByRange("key").sortWithinPartitions("key").withColumn("p", F.spark_partition_id())
    before = first.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    places = first.join(before, "p").withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("key")) + F.col("before"))
    return rows.join(places.select("key", "n"), "key").select("n", "id", "passage_type", "difficulty", "difficulty_source", F.md5("text").alias("text"))


@query(
    f"""WITH {E} SELECT id::VARCHAR AS id, CASE WHEN id % 3 = 2 THEN 'renamed' ELSE 'exam ' || id END AS title,
list_aggregate(CASE WHEN id % 3 = 0 THEN ids[2:] WHEN id % 3 = 1 AND len(ids) > 1 THEN [ids[2], ids[1]] || ids[3:] ELSE ids END, 'string_agg', ',') AS ids FROM e"""
)
def logged_exams(spark, sf_dir):
    return _exams(_logged(spark, sf_dir).state()[1])


@query(
    """WITH s AS (SELECT lang, CASE WHEN quality = 1 THEN 5 END AS difficulty FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)
SELECT 'passages' AS kind, NULL AS value, count(*) AS n FROM s UNION ALL SELECT 'passage_type', coalesce(lang, ''), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty::VARCHAR, count(*) FROM s GROUP BY 2"""
)
def logged_counts(spark, sf_dir):
    return Counts(_logged(spark, sf_dir, lambda log: Counts(log).begin())).counts()


class _Missing(Exception):
    code = 404


def _service():
    """Stands for an outside service: it repeats the prompt, and knows no model of the name "missing"."""

    def call(prompt: str, **options) -> str:
        if prompt == "missing":
            raise _Missing(prompt)
        return f" {prompt} "

    return call


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 4 < 2 THEN props END AS json, [NULL, NULL, 'bad_json', 'not_found'][(event_id % 4 + 1)::INT] AS error FROM events")
def json_answers(spark, sf_dir):
    at = F.col("event_id") % 4
    prompt = F.when(at == 0, F.col("props")).when(at == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(at == 2, "no json").otherwise("missing")
    return external.json_answers(adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), prompt.alias("prompt")), _service, 0)


@query("SELECT DISTINCT event_type AS model, true AS ok, 'Say OK' AS message, true AS timed FROM events")
def probes(spark, sf_dir):
    models = adapters.table(spark, sf_dir, "events").select(F.col("event_type").alias("model")).distinct()
    return external.probes(models, _service, "Say OK").select("model", "ok", "message", (F.col("latency_ms") >= 0).alias("timed"))


def _results(spark, sf_dir):
    turns = adapters.table(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    passages = F.transform("x", lambda e: F.struct((-e["turn"] - 1).alias("id"), e["role"].alias("passage_type")))
    return listed.select(F.col("conv_id").alias("ord"), F.concat(F.lit("/in/f"), (F.col("conv_id") % 13).cast("string"), F.lit(".pdf")).alias("source_file"), passages.alias("passages"))


def _appended(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir).select("ord", "id", "passage_type")
    recent = spark.range(1).select(F.array(F.lit("/in/f3.pdf"), F.lit("/in/old.pdf")).alias("files"))
    return edits.append_results(rows, recent, _results(spark, sf_dir))


@query(
    """SELECT doc_id AS id, doc_id AS ord, lang AS passage_type FROM documents UNION ALL
SELECT -turn - 1, (SELECT max(doc_id) + 1 FROM documents) + conv_id * 4294967296 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role FROM conversations"""
)
def append_results(spark, sf_dir):
    return _appended(spark, sf_dir)[0].select("id", "ord", "passage_type")


@query(
    """WITH f AS (SELECT '/in/f' || conv_id % 13 || '.pdf' AS f, max(conv_id) AS n FROM conversations GROUP BY 1), a AS (SELECT f, -n AS k FROM f UNION ALL SELECT x, y FROM (VALUES ('/in/f3.pdf', 1), ('/in/old.pdf', 2)) AS t(x, y) WHERE x NOT IN (SELECT f FROM f))
SELECT string_agg(f, ',' ORDER BY k) AS files FROM (SELECT * FROM a ORDER BY k LIMIT 10)"""
)
def recent_after_results(spark, sf_dir):
    return _appended(spark, sf_dir)[1].select(F.array_join("files", ",").alias("files"))
