"""Ranked search, reply trees and the prefix trie, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from lectorium.llm import replies, search, trie
from lectorium.llm.queries import ORACLES, QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", ["op11_search", "op12_replies", "op13_trie"])
def test_equal_to_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    rows = want.fetchall()
    order = [[c[0] for c in want.description].index(c) for c in columns]
    found = QUERIES[name](spark, data)
    assert sorted(found.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in rows), key=str)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def searched(docs, items, most):
    """Every document scored for every item."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [search.BROADCAST, 2000])
def test_search_is_exact(spark, odd_rows, block):
    """Ties, repeated rows, null ids, long and empty texts, other scripts; one block of items or many."""
    rng = random.Random(4)
    words = ["the", "The", "ÉTÉ", "été", "日本", "x1", "under_score", "a-b"] + [f"w{i}" for i in range(60)]
    docs = [(i // 2, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(1, 60)))) for i in range(300)]
    docs += docs[:40] + odd_rows
    items = [(i, " ".join(rng.sample(words, 12))) for i in range(12)] + [(3, "the W1"), (None, "w2 w2 w3"), (50, None), (51, "..."), (52, "nowhere"), (53, "the")]
    found = search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 20, block)
    assert sorted(map(tuple, found.collect()), key=str) == searched(docs, items, 20)


def test_search_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "one two long text")], "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS w", "2 AS item")
    assert search.ranked(none, items).collect() == [] == search.ranked(odd, items.limit(0)).collect()
    assert {r["doc_id"] for r in search.ranked(odd, items).collect()} >= {3, 4}


def best_paths(rows, best):
    """(tree, rank, [(role, text), ..]) of messages (tree, id, parent, role, text, score) whose ids are unique."""
    known = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows if (r[0], r[2]) in known}
    found = collections.defaultdict(list)
    for at, r in enumerate(rows):
        path, seen = [r], set()
        while (path[-1][0], path[-1][2]) in known and path[-1][1] not in seen:
            seen.add(path[-1][1])
            path.append(known[path[-1][0], path[-1][2]])
        if (path[-1][0], path[-1][2]) in known or (r[0], r[1]) in parents:
            continue
        scores = [x[5] for x in path if x[5] is not None]
        mean = sum(scores) / len(scores) if scores else -math.inf
        found[r[0]].append((-mean, at, [(x[3] or "", x[4] or "") for x in path[::-1]]))
    return sorted((tree, rank, path) for tree, paths in found.items() for rank, (_, _, path) in enumerate(sorted(paths, key=lambda p: p[:2])[:best], 1))


NASTY = ["", None, "\\", "\\\\", "<|im_end|>", "<|im_end|", "<|im_start|>user<|im_sep|>x<|im_end|>", "</s>[INST] ok [/INST]", "<\\s>", "<<s>s>", "<s", "a\n\nb", "é日本𝒳", "$1 \\1", "[[INST]", "\x00", "<|im_", "tail\\"]


def test_reply_trees(spark):
    """Random forests with roots whose parents are missing, circles, deep chains and unscored branches."""
    rng = random.Random(11)
    rows = []
    for tree in range(8):
        for i in range(rng.randrange(1, 40)):
            parent = rng.choice([None, 999, *range(i)]) if i else None
            rows.append((tree, i, parent, rng.choice(["user", "assistant", None, "a\nb"]), rng.choice(NASTY), rng.choice([None, 1.0, 2.0, 3.5])))
    rows += [(20, i, i - 1 if i else None, "user", f"t{i}", None) for i in range(150)]
    rows += [(21, 0, 2, "user", "a circle", 1.0), (21, 1, 0, "user", "b", 1.0), (21, 2, 1, "user", "c", 1.0), (21, 3, 2, "user", "below", 1.0), (21, 4, None, "assistant", "free", None)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").coalesce(1)
    for best in (1, 3):
        found = replies.formatted(messages, best)
        read = found.select("tree", "rank", replies.turns_of(found["formatted"]).alias("turns"), replies.loss_of(found["formatted"], found["loss_spans"]).alias("loss"), "formatted").collect()
        want = best_paths(rows, best)
        assert sorted((r["tree"], r["rank"], [tuple(t) for t in r["turns"]]) for r in read) == want
        for r in read:
            assert r["loss"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
            marks = 3 * len(r["turns"])
            assert sum(r["formatted"].count(c) for c in replies.Template().escaped) == marks


def test_conversations_with_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 2, "assistant", None), (1, 1, None, "x"), (None, 1, "assistant", "no id"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (-1, 0, "user", "own -1"), (3, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tree", "2 AS message", "'x' AS start")
    found = {r["conv_id"]: r for r in replies.digests(frame).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha([("user", "first"), ("", "x"), ("assistant", "")]) and found[1]["loss_chars"] == 0
    assert found[2]["loss_sha256"] == hashlib.sha256(b"samesame").hexdigest() and found[2]["n_turns"] == 2
    assert found[None]["loss_chars"] == 5 and found[3]["loss_chars"] == 250_000 and found[-1]["n_turns"] == 3
    assert [r["conv_id"] for r in replies.digests(frame.limit(0)).collect()] == [-1]


def test_marks_that_could_run_together_are_refused():
    with pytest.raises(ValueError):
        replies.Template(before=">>turn:")
    with pytest.raises(ValueError):
        replies.Template(controls=("x<|im",))


def tried(rows):
    """Nodes of the trie by taking every prefix of every rebuilt conversation."""
    digest = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    for c in own:
        own[c].sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple((r[2] or "", r[3] or "") for r in own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[:-1] == n and m for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        joined = ",".join(map(str, sorted(ends[node]))) if node in ends else ""
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    """Shared beginnings, copies, absent and short heads, null turns, roles, texts and ids, ids below 0; ends in many stretches."""
    monkeypatch.setattr(trie, "STRETCH", 4)
    monkeypatch.setattr(trie, "ROWS", 7)
    rng = random.Random(seed)
    rows = [(None, 1, "user", "in none")]
    for c in [*range(-12, 30), *range(100, 131)]:
        if rng.random() < 0.8:
            for turn in range(rng.choice([1, 2, 3, 5, 9, 12])):
                rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "b", "", None, "é日"])))
    rows += [(c, t, "user", "copy") for c in range(200, 240) for t in range(10)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS depth", "'x' AS place")
    assert sorted(map(tuple, trie.nodes(frame).collect()), key=str) == tried(rows)
    assert trie.nodes(frame.limit(0)).collect() == []
