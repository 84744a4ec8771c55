"""Text expressions against what Python's own functions say."""

import html
import json

import pytest
from pyspark.sql import functions as F

from lectorium.functions import arrays, errors, text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


ODD = ["", " ", "a", " a ", "\x1ca\x1d", "\xa0a b　", "a\n", "a\r\nb\x0bc", "\n\n", "x\x85y z"]


def test_strip_and_lines(spark):
    assert column(spark, ODD, text.strip) == [s.strip() for s in ODD]
    assert column(spark, ODD, text.lines) == [s.splitlines() for s in ODD]


def test_choices(spark):
    assert column(spark, ["① a\n\n ② b \n", ""], text.choices_of) == [["① a", "② b"], []]


def test_display_title(spark):
    rows = [(" T ", "x"), ("", "a" * 30), ("", "a" * 31), (" ", "\n one\ntwo"), (None, None), ("", " ")]
    found = spark.createDataFrame(rows, "t string, x string").select(text.display_title(F.col("t"), F.col("x")).alias("y")).collect()
    assert [r["y"] for r in found] == ["T", "a" * 30, "a" * 30 + "…", "one", "(제목 없음)", "(제목 없음)"]


def test_question_label(spark):
    rows = [("", 0, "s" * 24), ("7", 1, "s" * 25), ("", 2, " a\nb "), ("", 3, None)]
    found = spark.createDataFrame(rows, "n string, i int, s string").select(text.question_label(F.col("n"), F.col("i"), F.col("s")).alias("y")).collect()
    assert [r["y"] for r in found] == ["1. " + "s" * 24, "7. " + "s" * 24 + "…", "3. a b", "4. (발문 없음)"]


def test_clamp(spark):
    assert column(spark, [0, 9, -3, 3, None], text.clamp, "long") == [1, 5, 1, 3, None]


def test_html_escape(spark):
    given = ['<a href="x">\'&\n', None, ""]
    assert column(spark, given, text.html_escape) == [html.escape(g or "").replace("\n", "<br>") for g in given]


def test_one_decimal(spark):
    pairs = [(s, n) for n in range(0, 45) for s in range(n, 5 * n + 1)]
    rows = spark.createDataFrame(pairs, "s long, n long").select("s", "n", text.one_decimal(F.col("s"), F.col("n")).alias("y")).collect()
    assert all(r["y"] == (f"{r['s'] / r['n']:.1f}" if r["n"] else "-") for r in rows)


def test_extract_json(spark):
    given = ['```JSON\n{"a": 1}\n```', 'so: {"a": 1} ok', "[1, 2]", "x [1] y", "none", None, "} {"]
    found = column(spark, given, text.extract_json)
    assert [f and json.loads(f) for f in found] == [{"a": 1}, {"a": 1}, [1, 2], [1], None, None, None]


@pytest.mark.parametrize(("row", "expected"), [(1, ["a", "c", "c", "b"]), (-1, ["a", "b", "c", "c"]), (0, ["c", "c", "a", "b"]), (2, ["a", "b", "c", "c"]), (3, ["a", "b", "c", "c"])])
def test_add_entries(spark, row, expected):
    current, new = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("c"))
    assert spark.range(1).select(arrays.add_entries(current, new, F.lit(row)).alias("y")).collect()[0]["y"] == expected


def test_swaps_and_recent(spark):
    a = F.array(*map(F.lit, "abc"))
    rows = lambda *r: F.array(*map(F.lit, r)).cast("array<int>")
    got = spark.range(1).select(
        arrays.swapped(a, rows(0), -1), arrays.swapped(a, rows(2), 1), arrays.swapped(a, rows(0, 1), 1), arrays.swapped(a, rows(1), 1), arrays.without_rows(a, rows(0, 2)), arrays.used_recently(a, F.lit("c"), 2)
    ).collect()[0]
    assert [list(x) for x in got] == [list("abc"), list("abc"), list("abc"), list("acb"), ["b"], ["c", "a"]]


def test_errors(spark):
    rows = [(400, "bad API key", ""), (400, "x", ""), (403, "", ""), (404, "", ""), (429, "", ""), (503, "", ""), (None, "", "ConnectError"), (None, "", "ValueError")]
    kind = errors.error_class(F.col("c"), F.col("m"), F.col("n"))
    found = spark.createDataFrame(rows, "c int, m string, n string").select(kind.alias("k"), errors.retryable(kind).alias("r")).collect()
    assert [r["k"] for r in found] == ["bad_key", "other", "forbidden", "not_found", "rate_limited", "server", "network", "other"]
    assert [r["r"] for r in found] == [False, False, False, False, True, True, True, False]


def test_recent_after_several(spark):
    for entries in (list("xyx"), list("abcab"), [], list("zzzz")):
        kept = list("abc")
        for e in entries:
            kept = [e, *(x for x in kept if x != e)][:4]
        got = spark.range(1).select(arrays.all_used_recently(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, entries)).cast("array<string>"), 4).alias("y")).collect()[0]["y"]
        assert got == kept


def test_folders(spark):
    import posixpath

    given = ["/a/b.pdf", "b.pdf", "/b.pdf", "a/b/c", "/a//b"]
    assert column(spark, given, text.parent_of) == [posixpath.dirname(x) or "." for x in given]
