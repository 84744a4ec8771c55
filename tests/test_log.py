"""The log of edits against the edits themselves, and order keys against lists."""

import random

import pytest
from pyspark.sql import functions as F

from lectorium import schemas
from lectorium.functions import order_keys
from lectorium.functions.order_keys import LONGEST, WIDTH, between, spread
from lectorium.operators import edits, exams
from lectorium.operators.log import EditLog, StaleVersion, edit, remove_passage

QUESTION = dict(id="q", number="", stem="s", choices=["a"], answer="", explanation="", question_type="k", difficulty=None, difficulty_source="")


def library(spark, n=6):
    passage = lambda i: (i, f"p{i}", f"t{i}", "x", "k", None, "", "", [], "", [], [QUESTION | {"id": f"q{j}"} for j in range(3)], "then", "then")
    return spark.createDataFrame([passage(i) for i in range(n)], schemas.passages()), spark.createDataFrame([(i, f"e{i}", f"exam {i}", ["p1", "p2", "p1", "gone", "p3"], "then") for i in range(3)], schemas.exams())


def rows_of(frames, order):
    passages, sets = frames
    shown = passages.orderBy(order).select("id", "title", "text", "passage_type", "difficulty", "difficulty_source", "questions", (F.col("updated_at") != "then").alias("moved")).collect()
    return [r.asDict(True) for r in shown], [tuple(r) for r in sets.orderBy(order).select("id", "title", "passage_ids").collect()]


def random_edit(rng, n):
    p, e, i = f"p{rng.randrange(n + 1)}", f"e{rng.randrange(4)}", rng.randrange(4)
    level, ids, rows, step = rng.choice([None, 0, 3, 9]), rng.choices(["p0", "p1", "new", "p5"], k=rng.randrange(1, 4)), rng.sample(range(6), rng.randrange(1, 3)), rng.choice([-1, 1])
    told = {"number": " 9 ", "question_type": " z ", "answer": " 1 ", "stem": " s ", "explanation": " e "}
    return rng.choice([
        ([edit("passages", "update", p, values={"title": " t ", "passage_type": " y ", "text": " z "})], lambda a, b: (edits.update_passage(a, p, title=" t ", passage_type=" y ", text=" z "), b)),
        ([edit("passages", "rate", p, level=level)], lambda a, b: (edits.rate_passage(a, p, level and max(1, min(5, level)) if level != 0 else 1), b)),
        ([edit("passages", "update_question", p, index=i, values=told, ids=["c"])], lambda a, b: (edits.update_question(a, p, i, choices=["c"], **told), b)),
        ([edit("passages", "rate_question", p, index=i, level=level)], lambda a, b: (edits.rate_question(a, p, i, level), b)),
        ([edit("passages", "add_question", p, question=QUESTION)], lambda a, b: (edits.add_question(a, p, F.struct(*(F.lit(v).cast(t).alias(k) if k != "choices" else F.array(F.lit("a")).alias(k) for (k, v), t in zip(QUESTION.items(), ["string"] * 7 + ["int", "string"], strict=True)))), b)),
        ([edit("passages", "delete_question", p, index=i)], lambda a, b: (edits.delete_question(a, p, i), b)),
        ([edit("passages", "move_question", p, index=i, step=step)], lambda a, b: (edits.move_question(a, p, i, step), b)),
        (remove_passage(p), lambda a, b: exams.remove_passage(a, b, p)),
        ([edit("exams", "delete", e)], lambda a, b: (a, edits.delete(b, e))),
        ([edit("exams", "rename", e, values={"title": "r"})], lambda a, b: (a, edits.rename_exam(b, e, "r"))),
        ([edit("exams", "remove", e, rows=rows)], lambda a, b: (a, edits.remove_from_exam(b, e, rows))),
        ([edit("exams", "move", e, rows=rows, step=step)], lambda a, b: (a, edits.move_in_exam(b, e, rows, step))),
        ([edit("exams", "reorder", e, ids=ids)], lambda a, b: (a, edits.reorder_exam(b, e, ids))),
        ([edit("exams", "add", "e1", index=i, ids=ids), edit("exams", "delete", "e1")], lambda a, b: (a, edits.delete(b, "e1"))),
    ])


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_state_is_that_of_the_edits(spark, tmp_path, seed):
    rng = random.Random(seed)
    now = library(spark)
    log = EditLog(spark, str(tmp_path / "log"))
    version = log.create(*now)
    for turn in range(2):
        for _ in range(4):
            some = [random_edit(rng, 6) for _ in range(3)]
            version = log.append([r for records, _ in some for r in records], version)
            for _, apply in some:
                now = apply(*now)
        now = tuple(spark.createDataFrame(x.collect(), x.schema) for x in now)
        assert rows_of(log.state(), "key") == rows_of(now, "ord")
        if not turn:
            assert log.compact() == version == log.head()
    assert rows_of(log.state(4), "key") == rows_of(EditLog(spark, str(tmp_path / "log")).state(4), "key")


def test_one_record_and_stale_versions(spark, tmp_path):
    log = EditLog(spark, str(tmp_path / "log"))
    log.create(*library(spark))
    assert log.append([edit("passages", "rate", "p2", level=4)], 0) == 1
    assert spark.read.parquet(str(tmp_path / "log/log/1")).count() == 1
    with pytest.raises(StaleVersion):
        log.append([edit("passages", "rate", "p2", level=1)], 0)
    other = EditLog(spark, str(tmp_path / "log"))
    other.head = lambda: 0  # looked before the first one's edit was there
    with pytest.raises(StaleVersion):
        other.append([edit("passages", "rate", "p2", level=1)], 0)
    with pytest.raises(StaleVersion):
        log.create(*library(spark))
    with pytest.raises(ValueError):
        edit("passages", "rename", "p1")
    new = {f.name: None for f in schemas.passages() if f.name not in ("ord", "id")} | {"title": "new", "questions": []}
    log.append([edit("passages", "put", "new", passage=new), edit("passages", "put", "p1", passage=new | {"title": "again"}), edit("exams", "add", "made", ids=["p1"]), edit("exams", "new", "e9", values={"title": "시험지 4"})], 1)
    passages, sets = log.state()
    assert [(r["id"], r["title"]) for r in passages.orderBy("key").collect()] == [("p0", "t0"), ("p1", "again"), ("p2", "t2"), ("p3", "t3"), ("p4", "t4"), ("p5", "t5"), ("new", "new")]
    assert [(r["id"], r["title"], r["passage_ids"]) for r in sets.orderBy("key").collect()][3:] == [("made", "새 시험지", ["p1"]), ("e9", "시험지 4", [])]
    assert [r["difficulty"] for r in log.state(1)[0].where("id = 'p2'").collect()] == [4] and log.state(0)[0].where("difficulty IS NOT NULL").count() == 0
    for wanted, before in (("p5", "p0"), ("p0", None), ("new", "p3")):
        log.append(log.placed("passages", wanted, before), log.head())
    assert [r["id"] for r in log.state()[0].orderBy("key").collect()] == ["p5", "p1", "p2", "new", "p3", "p4", "p0"]


def test_order_keys():
    """Any sequence of moves is that of a list; keys are bounded as long ones are spread."""
    rng = random.Random(7)
    rows = [(f"{(1 << 62) + i:016x}", i) for i in range(50)]
    wanted = list(range(50))
    for turn in range(3000):
        i, to = (rng.randrange(50), rng.randrange(50)) if turn % 3 else (49, 10)
        wanted.insert(to, wanted.pop(i))
        _, own = rows.pop(i)
        low, high = rows[to - 1][0] if to else None, rows[to][0] if to < len(rows) else None
        key = between(low, high)
        assert (low or "") < key < (high or "g") and len(key) >= WIDTH
        rows.insert(to, (key, own))
        if len(key) > LONGEST:
            a = next((k for k in range(to, -1, -1) if len(rows[k][0]) <= WIDTH + 1), -1)
            b = next((k for k in range(to, len(rows)) if len(rows[k][0]) <= WIDTH + 1), len(rows))
            fresh = spread(rows[a][0] if a >= 0 else None, rows[b][0] if b < len(rows) else None, b - a - 1)
            rows[a + 1 : b] = [(k, r) for k, (_, r) in zip(fresh, rows[a + 1 : b], strict=True)]
        assert rows == sorted(rows) and [r for _, r in rows] == wanted and max(len(k) for k, _ in rows) <= LONGEST
    with pytest.raises(ValueError):
        between("8", "8")


def test_keys_of_ords(spark):
    rows = spark.createDataFrame([(-5,), (0,), (7,), (1 << 40,)], "ord long").select("ord", order_keys.key_of(F.col("ord")).alias("key"), order_keys.appended_key(F.lit(1), F.lit(0)).alias("new"))
    found = rows.orderBy("key").collect()
    assert [r["ord"] for r in found] == [-5, 0, 7, 1 << 40] and all(len(r["key"]) == WIDTH and r["key"] < r["new"] for r in found)
