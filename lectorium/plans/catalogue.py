"""Query catalogue: the library's operations over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays, errors, text
from ..operators import browse, exams
from ..operators.keyword_index import KeywordIndex
from ..sources.store import shared_folder
from . import adapters
from .registry import ORACLES, QUERIES, query  # noqa: F401

D = """d AS (SELECT doc_id AS ord, doc_id AS id, '' AS title, text, lang AS passage_type, (1 + quality + 2 * toxic)::INT AS difficulty, source AS source_file
  FROM documents LEFT JOIN labels USING (doc_id))"""
O = """o AS (SELECT o_orderkey AS id, o_orderkey AS ord, o_orderstatus AS passage_type, left(o_orderpriority, 1)::INT AS difficulty FROM orders)"""
E = """e AS (SELECT o_custkey AS id, flatten(list(CASE WHEN o_orderkey % 10 = 0 THEN [o_orderkey, -o_orderkey] ELSE [o_orderkey] END ORDER BY o_orderdate, o_orderkey)) AS ids
  FROM orders GROUP BY 1)"""
TITLE = r"""CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN '(제목 없음)' ELSE
  (SELECT CASE WHEN length(l) > 30 THEN left(l, 30) || '…' ELSE l END FROM (SELECT split_part(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), 1) AS l)) END"""
LEVEL = "CASE WHEN difficulty IS NULL THEN '미분류' ELSE 'Lv.' || difficulty END"
COLOUR = "CASE difficulty WHEN 1 THEN '#43a047' WHEN 2 THEN '#7cb342' WHEN 3 THEN '#fbc02d' WHEN 4 THEN '#fb8c00' WHEN 5 THEN '#e53935' ELSE '#9e9e9e' END"
KEPT = "id, passage_type, difficulty"

def _shown(rows):
    return rows.select("id", "passage_type", "difficulty")


def _joined(column, separator=","):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), separator)


@query(f"WITH {D} SELECT {KEPT} FROM d WHERE passage_type IN ('en', 'fr')")
def filter_type(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_documents(spark, sf_dir), passage_types={"en", "fr"}))


@query(f"WITH {D} SELECT {KEPT} FROM d WHERE false")
def filter_type_empty_set(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_documents(spark, sf_dir), passage_types=set()))


@query(f"WITH {O} SELECT {KEPT} FROM o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag IN ('R', 'A'))")
def filter_question_type(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_orders(spark, sf_dir), adapters.questions_of_orders(spark, sf_dir), question_types={"R", "A"}))


@query(f"WITH {D} SELECT {KEPT} FROM d WHERE difficulty IN (1, 4) OR difficulty IS NULL")
def filter_difficulty_with_unrated(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_documents(spark, sf_dir), difficulties={1, 4, None}))


@query(f"WITH {D} SELECT {KEPT} FROM d WHERE contains(lower(title || chr(10) || text), '%')")
def filter_keyword_literal(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_documents(spark, sf_dir), keyword="%"))


@query(f"WITH {D} SELECT {KEPT} FROM d WHERE contains(lower(title || chr(10) || text), 'über')")
def filter_keyword_unicode(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_documents(spark, sf_dir), keyword=" ÜBER "))


@query(f"WITH {D} SELECT {KEPT} FROM d WHERE contains(lower(title || chr(10) || text), 'license')")
def filter_keyword_indexed(spark, sf_dir):
    """As above, from the files that an index names."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    adapters.passages_of_documents(spark, sf_dir).repartitionByRange(32, "ord").write.parquet(f"{folder}/passages")
    index = KeywordIndex(spark, f"{folder}/passages", f"{folder}/index")
    index.refresh()
    return _shown(index.search("LICENSE"))


@query(
    f"WITH {D} SELECT id, passage_type, difficulty, {TITLE} AS display_title FROM d WHERE passage_type IN ('en', 'fr') AND (difficulty IN (1, 2) OR difficulty IS NULL) AND contains(lower(title || chr(10) || text), 'the')"
)
def filter_all(spark, sf_dir):
    found = browse.filter_passages(adapters.passages_of_documents(spark, sf_dir), passage_types={"en", "fr"}, difficulties={1, 2, None}, keyword="the")
    return found.select("id", "passage_type", "difficulty", text.display_title(F.col("title"), F.col("text")).alias("display_title"))


@query(f"WITH {O} SELECT {KEPT} FROM o WHERE passage_type IN ('F', 'P') AND difficulty IN (1, 3) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'N')")
def filter_all_orders(spark, sf_dir):
    return _shown(browse.filter_passages(adapters.passages_of_orders(spark, sf_dir), adapters.questions_of_orders(spark, sf_dir), passage_types={"F", "P"}, difficulties={1, 3}, question_types={"N"}))


@query(
    """WITH d AS (SELECT doc_id AS ord, doc_id // 3 AS id, lang AS passage_type, text FROM documents)
SELECT id, ord, passage_type, length(text)::INT AS n FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1"""
)
def get_passage_first(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir).select("ord", F.floor(F.col("id") / 3).cast("long").alias("id"), "passage_type", F.char_length("text").alias("n"))
    return browse.first_by_id(rows).select("id", "ord", "passage_type", "n")


@query("SELECT DISTINCT lang AS passage_type FROM documents")
def facet_passage_types(spark, sf_dir):
    return browse.facet(adapters.passages_of_documents(spark, sf_dir), "passage_type").orderBy("passage_type")


@query("SELECT DISTINCT l_returnflag AS question_type FROM lineitem")
def facet_question_types(spark, sf_dir):
    return browse.facet(adapters.questions_of_orders(spark, sf_dir), "question_type").orderBy("question_type")


@query("SELECT (SELECT count(*) FROM orders) AS n_passages, (SELECT count(*) FROM lineitem) AS n_questions")
def stats_totals(spark, sf_dir):
    return browse.totals(adapters.passages_of_orders(spark, sf_dir), adapters.questions_of_orders(spark, sf_dir))


@query(f"WITH {D}, l AS (SELECT unnest([1, 2, 3, 4, 5, NULL])::INT AS difficulty), c AS (SELECT difficulty AS x, count(*) AS n FROM d GROUP BY 1) SELECT difficulty, coalesce(n, 0)::BIGINT AS n FROM l LEFT JOIN c ON difficulty IS NOT DISTINCT FROM x")
def stats_difficulty_histogram(spark, sf_dir):
    return browse.level_histogram(adapters.passages_of_documents(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id AS ord, doc_id AS id, text FROM documents), a AS (SELECT * FROM d WHERE id % 3 <> 0), b AS (SELECT ord, id, text || '!' AS text FROM d WHERE id % 2 = 0 UNION ALL SELECT ord, id, 'again' FROM d WHERE id % 6 = 0)
SELECT id, ord, length(text)::INT AS n FROM a UNION ALL SELECT id, ord + (SELECT max(ord) + 1 FROM a), length(text)::INT FROM b WHERE id NOT IN (SELECT id FROM a)"""
)
def merge_passages(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir).select("ord", "id", "text")
    existing = rows.where("id % 3 <> 0")
    imported = rows.where("id % 2 = 0").withColumn("text", F.concat("text", F.lit("!"))).unionByName(rows.where("id % 6 = 0").withColumn("text", F.lit("again")))
    return exams.merge(existing, imported).select("id", "ord", F.char_length("text").alias("n"))


@query(f"WITH {E}, a AS (SELECT * FROM e WHERE id % 3 <> 0) SELECT id, len(ids)::INT AS n, 0 AS side FROM a UNION ALL SELECT id, len(ids)::INT, 1 FROM e WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM a)")
def merge_exams(spark, sf_dir):
    rows = adapters.exams_of_customers(spark, sf_dir).select("id", F.size("passage_ids").alias("n"), F.col("id").alias("ord"))
    merged = exams.merge(rows.where("id % 3 <> 0").withColumn("side", F.lit(0)), rows.where("id % 2 = 0").withColumn("side", F.lit(1)))
    return merged.select("id", "n", "side")


@query(f"WITH {O}, {E}, p AS (SELECT id AS exam_id, unnest(ids) AS passage_id, unnest(range(len(ids)))::INT AS pos FROM e) SELECT exam_id, pos, passage_id, passage_type, difficulty FROM p JOIN o ON passage_id = o.id")
def resolve_exam(spark, sf_dir):
    return exams.resolve(adapters.exams_of_customers(spark, sf_dir), adapters.passages_of_orders(spark, sf_dir)).select("exam_id", "pos", "passage_id", "passage_type", "difficulty")


@query("SELECT o_orderkey AS id, o_custkey % 5 = 0 AS used FROM orders")
def mark_in_exam(spark, sf_dir):
    some = adapters.exams_of_customers(spark, sf_dir).where("id % 5 = 0")
    return exams.mark_used(adapters.passages_of_orders(spark, sf_dir), some).select("id", "used")


@query(f"WITH {E} SELECT id, list_aggregate(list_filter(ids, lambda x: x <> 100), 'string_agg', ',') AS ids FROM e")
def remove_cascade(spark, sf_dir):
    _, left = exams.remove_passage(adapters.passages_of_orders(spark, sf_dir), adapters.exams_of_customers(spark, sf_dir), 100)
    return left.select("id", F.nullif(_joined("passage_ids"), F.lit("")).alias("ids"))


@query(f"WITH {E} SELECT id, list_aggregate(list_filter(ids, lambda x: x >= 0), 'string_agg', ',') AS ids FROM e")
def prune_dangling(spark, sf_dir):
    left = exams.prune_dangling(adapters.exams_of_customers(spark, sf_dir), adapters.passages_of_orders(spark, sf_dir))
    return left.select("id", F.nullif(_joined("passage_ids"), F.lit("")).alias("ids"))


@query(
    f"""WITH {O}, {E}, p AS (SELECT id AS exam_id, unnest(ids) AS passage_id FROM e), q AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT exam_id, count(*) AS n_passages, coalesce(sum(n), 0)::BIGINT AS n_questions, coalesce(printf('%.1f', avg(difficulty)), '-') AS average FROM p JOIN o ON passage_id = o.id LEFT JOIN q ON k = passage_id GROUP BY 1"""
)
def exam_summary(spark, sf_dir):
    return exams.summary(adapters.exams_of_customers(spark, sf_dir), adapters.passages_of_orders(spark, sf_dir), adapters.questions_of_orders(spark, sf_dir))


NEW = "[ids[1], id, -id, id, 7]"


@query(f"WITH {E}, n AS (SELECT id, ids, list_filter({NEW}, lambda x: NOT list_contains(ids, x)) AS w FROM e) SELECT id, list_aggregate(list_concat(list_concat(ids[:1], w), ids[2:]), 'string_agg', ',') AS ids, (5 - len(w))::INT AS skipped FROM n")
def add_to_exam(spark, sf_dir):
    rows = adapters.exams_of_customers(spark, sf_dir)
    new = F.array(F.get("passage_ids", 0), F.col("id"), -F.col("id"), F.col("id"), F.lit(7).cast("long"))
    added = arrays.add_entries(F.col("passage_ids"), new, F.lit(1))
    return rows.select("id", _joined(added).alias("ids"), (F.lit(5) - F.size(arrays.not_yet_in(new, F.col("passage_ids")))).alias("skipped"))


@query(
    f"""WITH {E}, n AS (SELECT id, ids, (id % 6 - 1)::INT AS r FROM e), m AS (SELECT id, ids, CASE WHEN r >= 0 AND r <= len(ids) THEN r ELSE len(ids) END AS r FROM n)
SELECT id, list_aggregate(list_concat(list_concat(ids[:r], [0, 0]), ids[r + 1:]), 'string_agg', ',') AS ids FROM m"""
)
def insert_at(spark, sf_dir):
    rows = adapters.exams_of_customers(spark, sf_dir)
    zero = F.lit(0).cast("long")
    return rows.select("id", _joined(arrays.insert_at(F.col("passage_ids"), F.array(zero, zero), (F.col("id") % 6 - 1).cast("int"))).alias("ids"))


@query(f"WITH {E} SELECT id, list_aggregate([x for x, i in ids if i NOT IN (1, 3)], 'string_agg', ',') AS ids FROM e")
def remove_rows(spark, sf_dir):
    rows = adapters.exams_of_customers(spark, sf_dir)
    return rows.select("id", F.nullif(_joined(arrays.without_rows(F.col("passage_ids"), F.array(F.lit(0), F.lit(2)))), F.lit("")).alias("ids"))


@query(f"WITH {E} SELECT id, list_aggregate(CASE WHEN len(ids) > 2 THEN list_concat(list_concat(ids[:1], [ids[3], ids[2]]), ids[4:]) ELSE ids END, 'string_agg', ',') AS ids FROM e")
def swap_rows(spark, sf_dir):
    rows = adapters.exams_of_customers(spark, sf_dir)
    return rows.select("id", _joined(arrays.swapped(F.col("passage_ids"), F.array(F.lit(1)), 1)).alias("ids"))


@query(f"WITH {E} SELECT id, list_aggregate(list_concat([ids[len(ids)]], list_filter(ids, lambda x: x <> ids[len(ids)]))[:10], 'string_agg', ',') AS ids FROM e")
def mru_list(spark, sf_dir):
    rows = adapters.exams_of_customers(spark, sf_dir)
    return rows.select("id", _joined(arrays.used_recently(F.col("passage_ids"), F.element_at("passage_ids", -1))).alias("ids"))


@query(f"WITH {D} SELECT id, {TITLE} AS display_title FROM d")
def display_title(spark, sf_dir):
    return adapters.passages_of_documents(spark, sf_dir).select("id", text.display_title(F.col("title"), F.col("text")).alias("display_title"))


@query(f"WITH {D} SELECT id, '[' || {LEVEL} || '] ' || {TITLE} || ' · ' || passage_type || '  (' || id % 4 || '문항)' AS label, '[' || {LEVEL} || '] ' || {TITLE} || '  (' || id % 4 || '문항)' AS editor_label FROM d")
def passage_label(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir)
    title, n = text.display_title(F.col("title"), F.col("text")), F.col("id") % 4
    return rows.select("id", text.passage_label(F.col("difficulty"), title, F.col("passage_type"), n).alias("label"), text.editor_label(F.col("difficulty"), title, n).alias("editor_label"))


@query(
    r"""WITH s AS (SELECT conv_id AS id, turn AS pos, replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS s FROM conversations)
SELECT id, pos, (pos + 1) || '. ' || CASE WHEN s = '' THEN '(발문 없음)' WHEN length(s) > 24 THEN left(s, 24) || '…' ELSE s END AS label FROM s"""
)
def question_label(spark, sf_dir):
    rows = adapters.questions_of_conversations(spark, sf_dir)
    return rows.select(F.col("passage_id").alias("id"), "pos", text.question_label(F.col("number"), F.col("pos"), F.col("stem")).alias("label"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '직접 입력' WHEN doc_id % 3 = 1 THEN source ELSE source || ' (p.' || (doc_id % 7) || ', ' || (doc_id % 5 + 7) || ')' END AS label FROM documents")
def source_label(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir)
    file = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("source_file"))
    pages = F.when(F.col("id") % 3 == 2, F.array((F.col("id") % 7).cast("int"), (F.col("id") % 5 + 7).cast("int")))
    return rows.select("id", text.source_label(file, pages).alias("label"))


@query(f"WITH {D} SELECT id, '<span style=\"background:' || {COLOUR} || ';color:white;padding:1px 6px;border-radius:3px;\">' || {LEVEL} || '</span>' AS badge, CASE difficulty WHEN 1 THEN '1단계 (최하)' WHEN 2 THEN '2단계 (하)' WHEN 3 THEN '3단계 (중)' WHEN 4 THEN '4단계 (상)' WHEN 5 THEN '5단계 (최상)' ELSE '미분류' END AS name FROM d")
def difficulty_badge(spark, sf_dir):
    return adapters.passages_of_documents(spark, sf_dir).select("id", text.badge(F.col("difficulty")).alias("badge"), text.level_name(F.col("difficulty")).alias("name"))


@query(f"WITH {D} SELECT id, CASE WHEN difficulty IS NOT NULL THEN greatest(1, least(5, (difficulty - 3) * 4))::INT END AS level FROM d")
def clamp(spark, sf_dir):
    return adapters.passages_of_documents(spark, sf_dir).select("id", text.clamp((F.col("difficulty") - 3) * 4).alias("level"))


@query(
    r"""SELECT conv_id AS id, turn AS pos, coalesce(list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> ''), 'string_agg', '|'), '') AS choices FROM conversations"""
)
def choices_split(spark, sf_dir):
    rows = adapters.questions_of_conversations(spark, sf_dir)
    return rows.select(F.col("passage_id").alias("id"), "pos", F.array_join(text.choices_of(F.col("stem")), "|").alias("choices"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>')) AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    return adapters.table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS json FROM events")
def extract_json(spark, sf_dir):
    p = F.col("props")
    form = F.col("event_id") % 4
    said = (
        F.when(form == 0, F.concat(F.lit("Here:\n```JSON\n"), p, F.lit("\n```\nDone.")))
        .when(form == 1, F.concat(F.lit("The answer is "), p, F.lit(" as asked")))
        .when(form == 2, p)
        .otherwise(F.concat(F.lit("none ("), F.col("event_type"), F.lit(")")))
    )
    return adapters.table(spark, sf_dir, "events").select("event_id", text.extract_json(said).alias("json"))


@query("SELECT DISTINCT event_type AS name FROM events WHERE event_id % 5 IN (0, 1) AND event_type LIKE 'c%'")
def model_list(spark, sf_dir):
    at = F.col("event_id") % 5
    actions = F.when(at == 0, F.array().cast("array<string>")).when(at == 1, F.array(F.lit("embed"), F.lit("generateContent"))).otherwise(F.array(F.lit("embed")))
    models = adapters.table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "models/").otherwise(""), F.col("event_type")).alias("name"), actions.alias("actions"))
    return browse.listed_models(models, "c").orderBy("name")


@query(
    """WITH c AS (SELECT event_id, [400, 400, 401, 403, 404, 429, 500, 503, NULL, NULL, 418][(event_id % 11 + 1)::INT] AS code, event_id % 11 AS k FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'bad_key' WHEN code IN (401, 403) THEN 'forbidden' WHEN code = 404 THEN 'not_found' WHEN code = 429 THEN 'rate_limited' WHEN code >= 500 THEN 'server' WHEN k = 8 THEN 'network' ELSE 'other' END AS kind,
  k IN (5, 6, 7, 8) AS again, least(pow(2, k) * 2, 30)::DOUBLE AS delay, 60.0::DOUBLE / (k + 1) AS spacing FROM c"""
)
def error_class(spark, sf_dir):
    k = (F.col("event_id") % 11).cast("int")
    code = F.get(F.array(*(F.lit(x).cast("int") for x in (400, 400, 401, 403, 404, 429, 500, 503, None, None, 418))), k)
    kind = errors.error_class(code, F.when(k == 0, "Invalid API Key").otherwise("no"), F.when(k == 8, "ReadTimeout").otherwise("ValueError"))
    return adapters.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), errors.retryable(kind).alias("again"), errors.backoff_seconds(k).alias("delay"), errors.spacing_seconds(k + 1).alias("spacing"))


@query("WITH c AS (SELECT user_id, '/in/' || event_type || CASE WHEN event_id % 3 = 0 THEN '.txt' ELSE '.PDF' END AS path, event_id FROM events) SELECT path, min(event_id) AS ord, regexp_replace(path, '^.*/', '') AS name FROM c WHERE lower(path) LIKE '%.pdf' GROUP BY 1")
def pdf_files(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events")
    paths = events.select(F.concat(F.lit("/in/"), "event_type", F.when(F.col("event_id") % 3 == 0, ".txt").otherwise(".PDF")).alias("path"), F.col("event_id").alias("ord"))
    return browse.pdf_paths(paths).select("path", "ord", text.base_name(F.col("path")).alias("name"))


@query("SELECT conv_id AS passage_id, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations")
def question_numbers(spark, sf_dir):
    return browse.numbered(adapters.questions_of_conversations(spark, sf_dir).select("passage_id", "pos"), "passage_id", "pos")


@query(
    f"""WITH {D} SELECT id, md5('<h3>' || replace(replace(replace(replace(replace({TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || ' <span style="background:' || {COLOUR} || ';color:white;padding:1px 6px;border-radius:3px;">' || {LEVEL} || '</span></h3>'
  || '<div style="color:#607d8b;">' || passage_type || '</div><div style="border:1px solid #cfd8dc;padding:8px;margin:6px 0;line-height:150%;">'
  || replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') || '</div>'
  || '<p style="margin-top:10px;"><b>1.</b> ' || source_file || ' <span style="background:#fbc02d;color:white;padding:1px 6px;border-radius:3px;">Lv.3</span></p><div style=''margin-left:14px;''>a&amp;b<br>c</div>') AS html FROM d"""
)
def passage_preview(spark, sf_dir):
    rows = adapters.passages_of_documents(spark, sf_dir)
    question = F.struct(F.lit("").alias("number"), F.col("source_file").alias("stem"), F.lit(3).alias("difficulty"), F.array(F.lit("a&b"), F.lit("c")).alias("choices"))
    page = text.preview(text.display_title(F.col("title"), F.col("text")), F.col("difficulty"), F.col("passage_type"), F.col("text"), F.array(question))
    return rows.select("id", F.md5(page).alias("html"))


from . import edit_queries  # noqa: E402, F401  more of the catalogue
