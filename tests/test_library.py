"""Library files, edits, merging and exams on small libraries."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lectorium import schemas
from lectorium.functions import errors
from lectorium.operators import browse, edits, exams
from lectorium.sources import external, library_file, settings

LEVELS = [(0, 1), (9, 5), (-3, 1), (3, 3), (" 3 ", 3), ("3.7", None), ("abc", None), ("", None), (3.7, 3), (True, 1), (None, None), (99999999999, 5)]


def written(tmp_path, root):
    path = str(tmp_path / "library.json")
    with open(path, "w") as f:
        f.write(root if isinstance(root, str) else json.dumps(root, ensure_ascii=False))
    return path


def test_decode(spark, tmp_path):
    root = {"passages": [{"id": f"p{i}", "difficulty": d, "extra": 1} for i, (d, _) in enumerate(LEVELS)] + [{"questions": [{"number": 18, "choices": [2, "b"], "answer": None}], "title": None, "source_pages": [1, 2]}]}
    passages, sets = library_file.read(spark, written(tmp_path, root))
    rows = passages.orderBy("ord").collect()
    assert [r["difficulty"] for r in rows[:-1]] == [e for _, e in LEVELS]
    last = rows[-1]
    assert len(last["id"]) == 12 and last["title"] == "" and last["source_pages"] == [1, 2]
    assert (last["questions"][0]["number"], last["questions"][0]["choices"], last["questions"][0]["answer"]) == ("18", ["2", "b"], "")
    assert sets.count() == 0


def library(passage=None, question=None, exam=None):
    return json.dumps({"passages": [{"id": "p", "questions": [{"id": "q"} | (question or {})]} | (passage or {})], "exam_sets": [{"id": "e"} | (exam or {})]})


BROKEN = ['{"passages": [', "[]", "", "5", "null", '{"passages": {"a": 1}}', '{"passages": null}', '{"passages": "x"}', '{"exam_sets": 3}', '{"passages": ["x"]}', '{"passages": [null]}', '{"exam_sets": [[]]}']
BROKEN += [library(passage={k: v}) for k, v in (("source_pages", ["x"]), ("source_pages", [None]), ("source_pages", [1, "3.7"]), ("source_pages", 3), ("source_pages", [[1]]), ("tags", "a"), ("questions", {}), ("questions", ["q"]), ("questions", [1]))]
BROKEN += [library(question={"choices": {"a": 1}}), library(question={"choices": "ab"}), library(exam={"passage_ids": "p"}), library(exam={"passage_ids": {}})]


@pytest.mark.parametrize("broken", BROKEN)
def test_broken(spark, tmp_path, broken):
    path = written(tmp_path, broken)
    with pytest.raises(library_file.BrokenLibrary):
        library_file.read(spark, path)
    passages, sets = library_file.load(spark, path)
    assert passages.count() == sets.count() == 0
    assert open(path.replace(".json", ".corrupt.json")).read() == broken


@pytest.mark.parametrize("whole", ["{}", library(), library(passage={"source_pages": [1, "2", 3.7, True], "tags": None, "questions": None}), library(question={"choices": None}), library(exam={"title": None, "passage_ids": None})])
def test_whole(spark, tmp_path, whole):
    path = written(tmp_path, whole)
    passages, sets = library_file.load(spark, path)
    assert passages.count() == len(json.loads(whole).get("passages", [])) and not os.path.exists(path.replace(".json", ".corrupt.json"))
    assert [r["source_pages"] for r in passages.collect() if r["source_pages"]] in ([], [[1, 2, 3, 1]])
    assert [r["title"] for r in sets.collect()] == (["" if '"title"' in whole else "새 시험지"] if "exam_sets" in whole else [])


def test_missing(spark, tmp_path):
    assert library_file.load(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_round_trip(spark, tmp_path):
    question = {"id": "q", "number": "1", "stem": "é\n", "choices": ["a"], "answer": "", "explanation": "", "question_type": "x", "difficulty": None, "difficulty_source": ""}
    passage = {"id": "p", "title": "제목", "text": "t", "passage_type": "", "difficulty": 2, "difficulty_source": "ai", "difficulty_reason": "", "tags": ["x"], "source_file": "", "source_pages": [3], "questions": [question], "created_at": "c", "updated_at": "u"}
    root = {"schema_version": 1, "passages": [passage, passage | {"id": "o", "questions": []}], "exam_sets": [{"id": "e", "title": "", "passage_ids": ["p", "gone", "o"], "created_at": "c"}]}
    path = written(tmp_path, root)
    frames = library_file.read(spark, path)
    again = str(tmp_path / "again.json")
    for _ in range(2):
        library_file.save(*frames, again)
    assert json.load(open(again)) == root
    assert "제목" in open(again).read() and not os.path.exists(again + ".tmp")
    library_file.export(*frames, path)
    assert json.load(open(path)) == root


def passages_of(spark, rows):
    return spark.createDataFrame(rows, "ord long, id string, passage_type string, difficulty int, title string, text string")


def test_filters(spark):
    rows = passages_of(spark, [(0, "a", "x", 3, "a", "b 100x"), (1, "b", "", None, "", "100%"), (2, "c", "y", 5, "t", None)])
    questions = spark.createDataFrame([("a", "k"), ("a", None), ("c", "l")], "passage_id string, question_type string")
    ids = lambda **k: sorted(r["id"] for r in browse.filter_passages(rows, questions, **k).collect())
    assert ids() == ids(keyword="  ") == ["a", "b", "c"]
    assert ids(keyword="100%") == ["b"] and ids(keyword="A\nB") == ["a"]
    assert ids(difficulties={3, None}) == ["a", "b"] and ids(difficulties=set()) == [] and ids(difficulties={None}) == ["b"]
    assert ids(passage_types={""}) == ["b"] and ids(passage_types=set()) == []
    assert ids(question_types={"k"}) == ["a"] and ids(question_types=set()) == []


def test_first_and_histogram(spark):
    rows = passages_of(spark, [(1, "a", "second", 1, "", ""), (0, "a", "first", None, "", ""), (2, "b", "", 1, "", "")])
    assert [r["passage_type"] for r in browse.first_by_id(rows).orderBy("id").collect()] == ["first", ""]
    assert browse.first_by_id(rows, "a").collect()[0]["passage_type"] == "first"
    assert {r["difficulty"]: r["n"] for r in browse.level_histogram(rows).collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0, None: 1}


def test_merge_and_exams(spark):
    old = passages_of(spark, [(0, "p1", "", 1, "old", ""), (1, "p2", "", 2, "", "")])
    new = passages_of(spark, [(0, "p1", "", 1, "new", ""), (1, "n", "", None, "x", ""), (2, "n", "", 4, "y", "")])
    merged = exams.merge(old, new)
    assert [(r["ord"], r["id"], r["title"]) for r in merged.orderBy("ord").collect()] == [(0, "p1", "old"), (1, "p2", ""), (3, "n", "x"), (4, "n", "y")]
    sets = spark.createDataFrame([("e", ["p2", "gone", "p1", "n"]), ("none", [])], "id string, passage_ids array<string>")
    assert [r["passage_id"] for r in exams.resolve(sets, merged).orderBy("exam_id", "pos").collect()] == ["p2", "p1", "n"]
    questions = spark.createDataFrame([("p1",), ("p1",)], "passage_id string")
    assert [tuple(r) for r in exams.summary(sets, merged, questions).orderBy("exam_id").collect()] == [("e", 3, 2, "1.5"), ("none", 0, 0, "-")]
    assert [r["passage_ids"] for r in exams.prune_dangling(sets, merged).orderBy("id").collect()] == [["p2", "p1", "n"], []]
    left, without = exams.remove_passage(merged, sets, "p2")
    assert left.count() == 3 and without.orderBy("id").collect()[0]["passage_ids"] == ["gone", "p1", "n"]
    assert {r["id"]: r["used"] for r in exams.mark_used(old, sets.where("id = 'none'")).collect()} == {"p1": False, "p2": False}


def test_edits(spark, tmp_path):
    path = written(tmp_path, {"passages": [{"id": "p", "updated_at": "then", "questions": [{"id": "q1", "stem": "a"}, {"id": "q2", "stem": "b"}]}], "exam_sets": [{"id": "e", "passage_ids": ["p"]}]})
    passages, sets = library_file.read(spark, path)
    one = lambda rows: rows.collect()[0]
    r = one(edits.update_passage(passages, "p", title=" t ", passage_type=" k ", text=" x "))
    assert (r["title"], r["passage_type"], r["text"]) == (" t ", "k", " x ") and r["updated_at"] != "then"
    r = one(edits.rate_passage(passages, "p", 4))
    assert (r["difficulty"], r["difficulty_source"]) == (4, "manual")
    r = one(edits.update_question(passages, "p", 1, number=" 9 ", question_type=" z ", answer=" 1 ", stem=" s ", explanation=" e ", choices=["c"]))
    assert (r["questions"][1]["number"], r["questions"][1]["stem"], r["questions"][1]["choices"], r["questions"][0]["stem"]) == ("9", " s ", ["c"], "a")
    assert one(edits.rate_question(passages, "p", 0, None))["questions"][0]["difficulty_source"] == "manual"
    r = one(edits.move_question(passages, "p", 0, 1))
    assert [q["id"] for q in r["questions"]] == ["q2", "q1"] and r["updated_at"] == "then"
    assert [q["id"] for q in one(edits.delete_question(passages, "p", 0))["questions"]] == ["q2"]
    r = one(edits.add_question(passages, "p", F.col("questions")[0]))
    assert r["questions"][2]["number"] == "3"
    assert one(edits.add_to_exam(sets, "e", ["x", "p"], 0))["passage_ids"] == ["x", "p"]
    assert one(edits.default_exam_title(sets))["title"] == "시험지 2"
    made = edits.add_to_exam(sets, "new", ["b", "b"]).orderBy("ord").collect()
    assert [(r["id"], r["passage_ids"]) for r in made] == [("e", ["p"]), ("new", ["b", "b"])] and made[1]["title"] == "시험지 2"
    assert edits.add_to_exam(sets, "new", []).count() == 1 and len(edits.new_exam(sets).orderBy("ord").collect()[1]["id"]) == 12
    assert one(edits.reorder_exam(sets, "e", ["b", "a"]))["passage_ids"] == ["b", "a"]
    assert one(edits.remove_from_exam(sets, "e", [0]))["passage_ids"] == []
    assert edits.append(sets, sets).orderBy("ord").collect()[1]["ord"] == 1
    assert edits.delete(sets, "e").count() == 0


class Clock:
    """Time that passes only in rest()."""

    def __init__(self, at):
        self.at = at

    def __call__(self):
        return self.at

    def rest(self, seconds):
        self.at += seconds


@pytest.mark.parametrize("lanes", [1, 4, 16])
def test_slots_of_all_lanes_keep_the_rate(lanes):
    """No two calls of any lanes are closer than the rate allows, lanes that begin late or again included."""
    begun, rng = [], random.Random(lanes)
    for lane in range(lanes):
        clock = Clock(1000 + rng.random() * 20)
        for _ in range(2):
            slots = external.Slots(30, lane, lanes, clock, clock.rest)
            for _ in range(10):
                slots.next()
                begun.append(clock.at)
                clock.rest(rng.random() * 3 * lanes)
    begun.sort()
    assert min(b - a for a, b in zip(begun, begun[1:])) > 1.999 and len(begun) == 20 * lanes


def test_measured_rate(spark):
    """At several numbers of tasks, calls begin at most so often on the clock on the wall."""
    rows = spark.range(12).selectExpr("id", "'p' AS prompt")
    for lanes in (1, 4):
        began = sorted(float(r["answer"]) for r in external.answers(rows, lambda: lambda prompt: repr(__import__("time").time()), 240, lanes=lanes).collect())
        assert all(b - a > 0.19 for a, b in zip(began, began[1:])) and len(began) == 12


def test_ledger_asks_once(spark, tmp_path):
    """A task that fails after its calls and is run again, and a second run, take what is noted; one that was broken off while it held a lease is asked again."""
    folder, log = str(tmp_path / "ledger"), tmp_path / "calls"
    log.mkdir()

    def client():
        import uuid

        def call(prompt, **options):
            (log / uuid.uuid4().hex).write_text(prompt)
            return prompt.upper()

        return call

    rows = spark.range(20).selectExpr("id", "concat('p', id % 10) AS prompt").unionByName(spark.range(5).selectExpr("id", "concat('p', id) AS prompt"))
    first = external.answers(rows, client, 0, ledger=folder)
    with pytest.raises(Exception, match="lost"):
        first.withColumn("x", F.when(F.col("id") == "19", F.raise_error(F.lit("lost"))).otherwise(F.lit(1).cast("void"))).collect()
    again = {r["id"]: r["answer"] for r in external.answers(rows, client, 0, ledger=f"file://{folder}").collect()}
    assert again == {str(i): f"P{i % 10}" for i in range(20)} and len(os.listdir(log)) == 20
    with pytest.raises(ValueError):
        external.answers(rows, client, 0, ledger="hdfs://somewhere/x")
    clock = Clock(0.0)
    ledger = external.FolderLedger(str(tmp_path / "other"), 5, lambda: __import__("time").time() + clock.at, clock.rest)
    assert ledger.take("ab") is None and ledger.take("ab") is None and clock.at > 4  # the first one's lease ran out
    ledger.note("ab", ["x", None, 1])
    assert ledger.take("ab") == ["x", None, 1] and sorted(os.listdir(tmp_path / "other" / "ab")) == ["ab.json"]


def test_calls(spark):
    class Busy(Exception):
        code = 429

    waits, left = [], [Busy(), Busy()]

    def call(prompt):
        if left:
            raise left.pop()
        return prompt.upper()

    paced, free = external.Slots(60, now=Clock(100.0), rest=lambda s: None), external.Slots(0)
    paced.rest = paced.now.rest
    assert external.called(call, "x", paced, sleep=waits.append) == ("X", None) and waits == [2.0, 4.0] and paced.now() == 102.0
    left += [Busy() for _ in range(9)]
    assert external.called(call, "x", free, sleep=lambda s: None) == (None, "rate_limited") and len(left) == 5

    def bad(prompt):
        raise ValueError("no")

    assert external.called(bad, "x", paced, sleep=waits.append) == (None, "other")
    rows = spark.createDataFrame([("1", "a"), ("2", None)], "id string, prompt string")
    assert {r["id"]: r["answer"] for r in external.answers(rows, lambda: str.upper, 6e6).collect()} == {"1": "A", "2": ""}
    said = lambda: lambda prompt, **options: f"{prompt}{sorted(options.items())}"
    assert external.answers(rows, said, 0, system_instruction="s", temperature=None).orderBy("id").collect()[0]["answer"] == "a[('system_instruction', 's')]"
    assert [tuple(r) for r in external.json_answers(rows, said, 0, temperature=None).orderBy("id").collect()] == [("1", None, "bad_json"), ("2", None, "bad_json")]
    assert [tuple(r)[:3] for r in external.probes(spark.createDataFrame([("m",)], "model string"), lambda: lambda p, **o: f" {p * 30} ", "yes ").collect()] == [("m", True, ("yes " * 30)[:40])]


def test_error_kinds_agree(spark):
    """The table as an expression and of one error."""

    def error(name, code, message):
        made = type(name, (Exception,), {})(message)
        made.code = code
        return made

    cases = [(n, c, m) for n in ("ValueError", "ReadTimeout", "ConnectError") for c in (None, 200, 400, 401, 402, 403, 404, 429, 499, 500, 503, 599) for m in ("", "API key not valid", "bad API_KEY", "network")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, name string, code int, message string")
    kinds = [r["k"] for r in rows.orderBy("i").select(errors.error_class(F.col("code"), F.col("message"), F.col("name")).alias("k")).collect()]
    assert kinds == [errors.kind_of(error(*c)) for c in cases] and set(kinds) == {r[0] for r in errors.RULES} | {"other"}
    assert errors.kind_of(error("X", "429", "")) == "other"


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings.json")
    assert settings.load(spark, path, {"a": 1}) == {"a": 1}
    settings.save(spark, path, {"a": "키", "b": 2})
    assert settings.load(spark, path, {"a": 1, "c": 3}) == {"a": "키", "c": 3} and os.stat(path).st_mode & 0o777 == 0o600
    for bad in ("{", "[]"):
        open(path, "w").write(bad)
        assert settings.load(spark, path, {"a": 1}) == {"a": 1}
    assert (settings.key(" k ", "V", {"V": "e"}), settings.key(" ", "V", {"V": " e "}), settings.key(None, "V", {})) == ("k", "e", "")
    folder = lambda platform, **e: settings.data_folder("app", "DIR", platform, e)
    assert folder("linux", HOME="/h") == "/h/.local/share/app" and folder("linux", HOME="/h", XDG_DATA_HOME="/x") == "/x/app"
    assert folder("darwin", HOME="/h") == "/h/Library/Application Support/app" and folder("win32", USERPROFILE="/u") == "/u/AppData/Roaming/app" and folder("win32", APPDATA="/a") == "/a/app"
    assert folder("linux", HOME="/h", DIR="~/d") == "/h/d" and folder("win32", DIR="/d") == "/d"


def test_filters_reach_the_scan(spark, tmp_path):
    rows = passages_of(spark, [(0, "a", "x", 3, "", ""), (1, "b", "", None, "", "")])
    rows.write.parquet(str(tmp_path / "p"))
    rows.select(F.col("id").alias("passage_id"), F.col("passage_type").alias("question_type")).write.parquet(str(tmp_path / "q"))
    stored, questions = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "q"))
    plan = lambda **k: browse.filter_passages(stored, questions, **k)._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert "PushedFilters:[In(passage_type,[x,y])" in plan(passage_types={"x", "y"}) and "PushedFilters:[Or(EqualTo(passage_type,),IsNull(passage_type))" in plan(passage_types={""})
    assert "PushedFilters:[In(difficulty,[1,3])" in plan(difficulties={1, 3}) and "PushedFilters:[Or(EqualTo(difficulty,3),IsNull(difficulty))" in plan(difficulties={None, 3})
    assert "In(question_type,[k,l])" in plan(question_types={"k", "l"})


def reference_rows(text):
    """What Python's decoder makes of a library's lists."""
    root = json.loads(text)
    level = lambda d: None if d is None or isinstance(d, float) and not math.isfinite(d) else max(1, min(5, int(d)))
    return [(i, p["id"], p.get("title", ""), level(p.get("difficulty")), [q["stem"] for q in p.get("questions", [])]) for i, p in enumerate(root.get("passages", []))], [(i, e["id"], e.get("passage_ids", [])) for i, e in enumerate(root.get("exam_sets", []))]


def read_rows(spark, path):
    passages, sets = library_file.read(spark, path)
    return [(r["ord"], r["id"], r["title"], r["difficulty"], [q["stem"] for q in r["questions"]]) for r in passages.orderBy("ord").collect()], [(r["ord"], r["id"], r["passage_ids"]) for r in sets.orderBy("ord").collect()]


def nasty_library(rng):
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "日本", "\U0001f600", "plain words ", "\\\\", '\\"', "},{", '"passages": [']
    text = lambda: "".join(rng.choices(bits, k=rng.randrange(0, 25)))
    passages = [{"id": f"p{i}", "title": text(), "text": text(), "difficulty": rng.choice([None, 3, 9]), "questions": [{"id": "q", "stem": text()} for _ in range(rng.randrange(3))]} for i in range(rng.randrange(0, 60))]
    root = {"before": {text(): [text(), [1, {}]]}, "schema_version": 1, "passages": passages, "other": [[], {}, text()], "exam_sets": [{"id": f"e{i}", "passage_ids": [text()] * i} for i in range(rng.randrange(0, 5))], "end": text()}
    return json.dumps(root, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + rng.choice(["", "\n", "  \n\n"])


@pytest.mark.parametrize("split", [97, 1009, 1 << 20])
def test_splits_anywhere(spark, tmp_path, split):
    """Bounds of splits within strings, escapes, brackets and characters change nothing."""
    rng = random.Random(split)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        for _ in range(1 if split < 100 else 3):
            text = nasty_library(rng)
            assert read_rows(spark, written(tmp_path, text)) == reference_rows(text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", ["_under.json", ".dot.json", "lib[1].json", "{a,b}*?.json", "k=1.json"])
def test_any_name(spark, tmp_path, name):
    path = tmp_path / name
    path.write_text(library())
    assert [r["id"] for r in library_file.load(spark, str(path))[0].collect()] == ["p"]
    library_file.save(*library_file.load(spark, str(path)), str(path))
    assert [r["id"] for r in library_file.read(spark, str(path))[1].collect()] == ["e"]


def test_loose_values(spark, tmp_path):
    """Repeated keys: the last counts; NaN and Infinity are no level."""
    entry = '{"id": "a", "id": "b", "difficulty": %s, "title": "\\ud800x", "questions": [{"id": "q", "stem": "s", "stem": "t"}]}'
    text = '{"passages": 3, "exam_sets": [], "passages": [%s]}' % ",".join(entry % d for d in ("NaN", "Infinity", "-Infinity", "1e400", "2", '"4"'))
    passages, _ = library_file.read(spark, written(tmp_path, text))
    rows = passages.orderBy("ord").collect()
    assert [r["difficulty"] for r in rows] == [None, None, None, None, 2, 4]
    assert {(r["id"], r["title"], r["questions"][0]["stem"]) for r in rows} == {("b", "?x", "t")}


@pytest.mark.parametrize("broken", ["{}x", '{"passages": [{},]}', '{"passages": [,{}]}', '{"passages": [{} {}]}', '{"passages": [{}}', '{"passages": [{"a": 1]]}', '{"other": [01]}', '{"passages": []', '{"a": "}', '{"passages": [{"id": "a\nb"}]}', "﻿{}", "{}{}", '{"passages": [{}]}]'])
def test_broken_structure(spark, tmp_path, broken):
    with pytest.raises(library_file.BrokenLibrary):
        library_file.read(spark, written(tmp_path, broken))


def test_bytes_that_are_no_text(spark, tmp_path):
    path = tmp_path / "library.json"
    path.write_bytes(b'{"passages": [{"id": "a\xff"}]}')
    assert library_file.load(spark, str(path))[0].count() == 0 and (tmp_path / "library.corrupt.json").read_bytes() == path.read_bytes()


def test_written_as_python_writes(spark, tmp_path):
    """The same bytes, in order, from many tasks; a failing task leaves the old file and nothing beside it."""
    passages, sets = library_file.read(spark, written(tmp_path, {"passages": [{"id": f"p{i}", "title": "제목\n", "created_at": "c", "updated_at": "u"} for i in range(200)], "exam_sets": []}))
    path = str(tmp_path / "saved.json")
    library_file.save(passages.repartition(7), sets, path)
    text = open(path).read()
    assert text == json.dumps(json.loads(text), ensure_ascii=False, indent=2) and [p["id"] for p in json.loads(text)["passages"]] == [f"p{i}" for i in range(200)]
    failing = passages.withColumn("title", F.when(F.col("ord") == 150, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        library_file.save(failing, sets, path)
    assert open(path).read() == text and sorted(os.listdir(tmp_path)) == ["library.json", "saved.json"]


def test_large_library(spark, tmp_path):
    """Beyond what one VARIANT holds: 140 MB, in many tasks, there and back."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), (i * F.col("n") % 9973).cast("string"))), ' "} ')
    rows = spark.range(7000).withColumnRenamed("id", "n").select(F.col("n").alias("ord"), F.concat(F.lit("p"), "n").alias("id"), F.lit("t").alias("title"), words.alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) if f.name == "difficulty" else F.lit("").alias(f.name) if f.dataType.simpleString() == "string" else F.array().cast(f.dataType).alias(f.name) for f in schemas.passages() if f.name not in ("ord", "id", "title", "text")))
    path = str(tmp_path / "large.json")
    library_file.save(rows, library_file.empty(spark)[1], path)
    assert os.path.getsize(path) > 128 << 20
    again, _ = library_file.read(spark, path)
    assert again.rdd.getNumPartitions() > 1
    same = again.join(rows.select("ord", F.col("text").alias("was")), "ord").where(F.col("text") == F.col("was"))
    assert again.count() == same.count() == 7000


def test_entries_are_cut_once(spark, tmp_path):
    path = written(tmp_path, {"passages": [{"id": "a", "text": "}{"}, {"id": "b"}], "exam_sets": [{"id": "e", "passage_ids": ["a", "b"]}]})
    passages, sets = library_file.read(spark, path)
    os.remove(path)  # frames that cut the file again at each use would fail here
    assert [(r["id"], r["text"]) for r in passages.orderBy("ord").collect()] == [("a", "}{"), ("b", "")]
    assert [r["passage_ids"] for r in sets.collect()] == [["a", "b"]]


def test_indented_as_json_does():
    odd = {"a": "\n\"\\é", "b": [], "c": {}, "d": [1, 2.5, None, True], "e": [[], [1], {"x": {}}, {"y": [1, {"z": "{,}"}]}], "": {"f": {"g": [""]}}, "h": "[1, 2]"}
    for value in (odd, [odd, odd], [], {}, "x", None, [[[]]], [1], {"a": 1}):
        assert library_file.indented(value) == json.dumps(value, ensure_ascii=False, indent=2)


def test_first_fault_is_told(spark, tmp_path):
    path = written(tmp_path, {"passages": [{"id": "a"}, {"questions": 1}, 5], "exam_sets": [7]})
    with pytest.raises(library_file.BrokenLibrary, match="entry 1 of list 0 is no passage"):
        library_file.read(spark, path)


def test_signs_behind_backslashes():
    from lectorium.sources import json_splits

    draw = random.Random(7)
    for n in range(400):
        text = "".join(draw.choice('\\\\"{}[],a') for _ in range(n % 40)).encode()
        inside, depth, ends, odd = [False, True], [0, 0], [], 0
        for k in (0, 1):
            quoted = inside[k]
            for i, c in enumerate(text):
                run = len(text[:i]) - len(text[:i].rstrip(b"\\"))
                if c == 0x22 and run % 2 == 0:
                    quoted = not quoted
                elif not quoted:
                    depth[k] += (c in b"{[") - (c in b"]}")
            ends.append(quoted)
            odd = ends[0]
        import numpy as np

        assert json_splits._ends(np.frombuffer(text, np.uint8)) == (odd, *depth)
