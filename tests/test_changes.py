"""Change notices: replayed in any split they give the summaries, told once, by calls or by a stream."""

import random

from pyspark.sql import functions as F

from lectorium.operators.changes import SUMMARY, Changes, applied, summaries
from lectorium.operators.log import EditLog, edit, remove_passage

from .test_log import library, random_edit


def told(rows):
    return {r["exam_id"]: tuple(r) for r in rows.select("exam_id", *SUMMARY).collect()}


def grown(spark, path, versions=3, seed=7):
    rng = random.Random(seed)
    log = EditLog(spark, str(path))
    log.create(*library(spark))
    for v in range(versions):
        some = [r for _ in range(6) for r in random_edit(rng, 6)[0]]
        some += [edit("exams", "add", f"n{v}", ids=["p1", "p4"], values={"title": "n"}), edit("passages", "rate", "p4", level=v + 1)]
        log.append(some + ([edit("exams", "delete", "n0")] if v == 1 else []) + (remove_passage("p1") if v == 2 else []), v)
    return log


def test_any_split_gives_the_summaries(spark, tmp_path):
    log = grown(spark, tmp_path / "log")
    changes = Changes(log)
    wanted = {v: told(summaries(*log.state(v))) for v in (0, 1, 3)}
    stretches = {(a, b): changes.between(a, b).withColumn("upto", F.lit(b)).collect() for a, b in ((0, 1), (1, 3), (0, 3))}
    for (a, b), rows in stretches.items():
        before, after, got = wanted[a], wanted[b], {r["exam_id"]: r["kind"] for r in rows}
        for e in before.keys() | after.keys():
            if before.get(e) != after.get(e):
                assert got[e] == ("new" if e not in before else "gone" if e not in after else "changed")
    start = spark.createDataFrame([wanted[0][e] for e in wanted[0]], "exam_id string, title string, n_passages long, n_questions long, average string")
    kind = "exam_id string, kind string, title string, n_passages long, n_questions long, average string, upto int"
    for split in (((0, 3),), ((0, 1), (1, 3))):
        rows = spark.createDataFrame([tuple(r) for s in split for r in stretches[s]], kind)
        assert told(applied(start, rows)) == wanted[3]


def test_told_once(spark, tmp_path):
    log = grown(spark, tmp_path / "log", versions=1)
    changes = Changes(log)
    assert changes.notices().isEmpty() and changes.told() == 0
    for checkpoint in ("check", "check", "another"):  # the last has seen nothing, and tells nothing again
        query = changes.follow(str(tmp_path / checkpoint), availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None and log.versions("notices") == [1]
    assert changes.tell() == changes.told() == 1
    assert told(applied(summaries(*log.state(0)), changes.notices())) == told(summaries(*log.state(1)))
