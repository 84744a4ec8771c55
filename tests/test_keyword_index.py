"""Keyword search by index: the rows of a whole scan, from fewer files."""

import pytest
from pyspark.sql import functions as F

from lectorium.operators.browse import has_keyword
from lectorium.operators.keyword_index import KeywordIndex, grams_of

ROWS = [(1, "Title", "plain words"), (2, None, "ÜBER alles"), (3, "x", None), (4, "", ""), (5, "ends in ab", "c starts"), (6, "a", "100% sure"), (7, None, "rare zebra"), (8, "t", "ZEBRA crossing " * 500)]
WORDS = (" ÜBER", "%", "ab\nc", "zebra", "absent", "ra", "ebra crossing z", None, "a\n100%")


def table(spark, path, rows, files=8):
    spark.createDataFrame(rows, "id long, title string, text string").repartitionByRange(files, "id").write.mode("append").parquet(path)


def same(spark, index, words=WORDS):
    for word in words:
        test = has_keyword(word)
        every = spark.read.parquet(index.table)
        assert sorted(r["id"] for r in index.search(word).collect()) == sorted(r["id"] for r in (every if test is None else every.where(test)).collect()), word


def test_same_rows_from_fewer_files(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "t"), str(tmp_path / "index"))
    table(spark, index.table, ROWS)
    assert len(index.candidates("zebra")) == 8  # nothing indexed: all are read
    same(spark, index, ("zebra",))
    assert index.refresh() == 8 and index.refresh() == 0
    same(spark, index)
    assert len(index.candidates("zebra")) == 2 and index.candidates("absent") == [] and len(index.candidates("ra")) == 8
    assert len(index.search("ZEBRA").inputFiles()) == 2
    table(spark, index.table, [(9, "new", "a zebra, and quokka")], 1)  # the index is behind
    assert len(index.candidates("quokka")) == 1 and len(index.candidates("zebra")) == 3
    same(spark, index, ("quokka",))
    assert index.refresh() == 1
    table(spark, index.table, [], 1)
    same(spark, index, ("quokka", "zebra"))


def test_columns_that_name_folders(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "t"), str(tmp_path / "index"))
    spark.createDataFrame([(*row, f"k{row[0] % 2}") for row in ROWS], "id long, title string, text string, kind string").write.partitionBy("kind").parquet(index.table)
    index.refresh()
    assert [tuple(r) for r in index.search("rare").select("id", "kind").collect()] == [(7, "k1")]


def test_files_that_change_or_go_and_broken_refreshes(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "t"), str(tmp_path / "index"))
    table(spark, index.table, ROWS)
    index.refresh()
    spark.read.parquet(index.table).where("id = 7").select("id", "title", F.lit("walrus instead").alias("text")).coalesce(1).write.parquet(str(tmp_path / "other"))
    (held,) = (tmp_path / "t").glob(index.search("rare zebra").inputFiles()[0].rsplit("/", 1)[1])
    (new,) = (tmp_path / "other").glob("*.parquet")
    for path in (held, new):  # their sums of old bytes are beside them
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    held.write_bytes(new.read_bytes())
    same(spark, index, ("walrus", "zebra"))
    held.unlink()
    same(spark, index, ("walrus", "plain"))
    index.spark.createDataFrame([(0, g) for g in grams_of(b"plain").tolist()], "file int, gram int").write.parquet(f"{index.path}/postings/batch=brokenoff")
    same(spark, index, ("plain",))
    assert len(index.candidates("plain")) == 1


def test_plan_reads_the_grams_alone(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "t"), str(tmp_path / "index"))
    table(spark, index.table, ROWS, 2)
    index.refresh()
    found = spark.read.schema("file int, gram int, batch string").parquet(f"{index.path}/postings").where(F.col("gram").isin(*grams_of(b"zebra").tolist()))
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("data, wanted", [(b"", 0), (b"ab", 0), (b"aaaa", 1), ("über".encode(), 3)])
def test_grams(data, wanted):
    assert len(grams_of(data)) == wanted
