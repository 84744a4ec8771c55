"""Counts kept up with a log against a recount, and that the library isn't read for them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectorium import schemas
from lectorium.operators import browse
from lectorium.operators.counts import Counts, sums
from lectorium.operators.log import EditLog, edit

from .test_log import QUESTION, library, random_edit


def told(rows):
    return sorted((tuple(r) for r in rows.select("kind", "value", "n").collect()), key=str)


def recount(spark, log, version=None):
    return told(sums(log.state(version)[0]))


def test_a_thousand_edits(spark, tmp_path):
    rng = random.Random(5)
    log = EditLog(spark, str(tmp_path / "log"))
    log.create(*library(spark, 40))
    kept = Counts(log)
    assert kept.begin() == 0 and told(kept.counts()) == recount(spark, log, 0)
    new = {f.name: None for f in schemas.passages() if f.name not in ("ord", "id")}
    for turn in range(2):
        some = []
        while len(some) < 500:
            if rng.random() < 0.1:
                some.append(edit("passages", "put", f"p{rng.randrange(60)}", passage=new | {"passage_type": rng.choice([None, "k", "m"]), "difficulty": rng.choice([None, 2]), "questions": rng.choice([None, [], [QUESTION | {"question_type": None}]])}))
            else:
                some += random_edit(rng, 60)[0]
        log.append(some, turn)
        if turn == 0:
            assert kept.save() == 1 and kept.save() == 1
            middle = recount(spark, log)
    wanted, earlier = recount(spark, log), told(kept.counts(1))
    state = log.state()[0]
    level = sorted(map(tuple, browse.level_histogram(state).collect()), key=str)
    total = state.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.size(F.coalesce("questions", F.array().cast(state.schema["questions"].dataType))), F.lit(0)))).first()
    types = {r[0] for r in browse.facet(state, "passage_type").collect()}
    os.rename(tmp_path / "log/base", tmp_path / "away")  # the library itself is out of reach
    log.head = lambda: 2
    assert told(kept.counts()) == wanted and told(kept.counts(1)) == earlier == middle
    assert sorted(map(tuple, kept.level_histogram().collect()), key=str) == level
    assert tuple(kept.totals().first()) == tuple(total)
    assert {r["passage_type"] for r in kept.facet("passage_type").collect()} == types
    assert kept.save() == 2 and told(kept.counts()) == wanted
    light = spark.read.parquet(str(tmp_path / "log/counts/2/light"))
    assert light.where("text IS NOT NULL OR title IS NOT NULL").isEmpty() and light.select(F.explode("questions").alias("q")).where("q.stem IS NOT NULL").isEmpty()


def test_empty_and_missing(spark, tmp_path):
    log = EditLog(spark, str(tmp_path / "log"))
    log.create(*(rows.limit(0) for rows in library(spark)))
    kept = Counts(log)
    with pytest.raises(ValueError):
        kept.counts()
    kept.begin()
    assert told(kept.counts()) == [] and tuple(kept.totals().first()) == (0, 0) and len(kept.level_histogram().collect()) == 6
    log.append([edit("passages", "rate", "nobody", level=3)], 0)
    assert told(kept.counts()) == []
