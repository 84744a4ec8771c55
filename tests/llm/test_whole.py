"""Operators that once did less than the whole job, against brute force."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from lectorium.llm import licenses, shingles, tokenfile


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_links_near_copies(spark):
    """Kept are the first of each class of texts linked at five words and 0.8; 3 bits of a simhash miss most such links."""
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append(base)
        for edits in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append(copy)
    rows = [" ".join(r) for r in rows]
    sets = [grams(t) for t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.classes(docs).collect()} == dict(enumerate(label))
    assert {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, "").collect()} == set(label)


def classes_by_pairs(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_texts_that_share_a_passage(spark, monkeypatch):
    """A family of texts with one long passage, near copies among them: the classes are those of all pairs, and no table holds pairs."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(130)]
    rows = [passage + [f"w{rng.randrange(10**6)}" for _ in range(70)] for _ in range(150)]
    for at in range(0, 40, 4):
        copy = list(rows[at])
        copy[rng.randrange(140, 190)] = "changed"
        rows += [copy, copy[:-3]]
    check_classes(spark, monkeypatch, rows)


@pytest.mark.parametrize("block", [64, shingles.BLOCK])
def test_near_copies_about_the_threshold(spark, monkeypatch, block):
    """1,200 near copies whose similarities lie on both sides of 0.8, in one block or in many: the classes of all pairs, and at most 10 rows a node."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for _ in range(1200):
        copy = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4])):
            copy[at] = f"x{rng.randrange(3000)}"
        rows.append(copy)
    monkeypatch.setattr(shingles.links, "__defaults__", (shingles.SIMILARITY, block, shingles.ENTRIES))
    check_classes(spark, monkeypatch, rows, 10 if block > 64 else 40)


def check_classes(spark, monkeypatch, rows, most=10):
    rows = [" ".join(r) for r in rows]
    label = classes_by_pairs([grams(t) for t in rows])
    sizes = {}
    keep = shingles.stored

    def counting(df, what, *more):
        out = keep(df, what, *more)
        sizes[what] = out.count()
        return out

    monkeypatch.setattr(shingles, "stored", counting)
    find = shingles.links

    def counted(*given, **named):
        out = find(*given, **named)
        sizes["links"] = out.count()
        return out

    monkeypatch.setattr(shingles, "links", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.classes(docs).collect()} == dict(enumerate(label))
    assert max(sizes.values()) <= most * len(rows) and 1 < len(set(label)) < len(rows)


def test_common_entries():
    """Frequent and rare ones, sets that are empty, against Python's sets."""
    rng = np.random.default_rng(3)
    for n, m, names in ((30, 40, 20), (5, 7, 3000), (60, 60, 200)):
        xs, ys = ([np.unique(rng.zipf(1.2, rng.integers(0, 60)) % names).astype(np.uint64) for _ in range(k)] for k in (n, m))
        flat = lambda sets: (np.concatenate(sets), np.array([len(s) for s in sets]))
        found = shingles.common(*flat(xs), *flat(ys))
        assert found.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in ys] for x in xs]


def test_pairs_are_replaced_until_a_rule_does_not_pay():
    """No pair is left that occurs often enough, and random access holds."""
    rng = np.random.default_rng(7)
    docs = [rng.zipf(1.3, 3000).clip(0, 900).astype(np.uint32) for _ in range(8)] + [np.zeros(333, np.uint32)]
    row = np.concatenate([x for d in docs for x in (d, [tokenfile.NO_PAIR])]).astype(np.uint32)
    symbols, rules = tokenfile.compress(row, 901)
    at = 0
    counts = collections.Counter()
    while at < len(symbols) - 1:  # without overlaps
        a, b = int(symbols[at]), int(symbols[at + 1])
        if tokenfile.NO_PAIR not in (a, b):
            counts[a, b] += 1
            at += a == b and at + 2 < len(symbols) and symbols[at + 2] == a
        at += 1
    assert max(counts.values()) < 9 and len(rules)
    payload = tokenfile.write_shard(list(range(9)), np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])])
    shard = tokenfile.Shard(payload)
    assert all((shard.document(i) == d).all() and (shard.ids(i, 5, 200) == d[5:200]).all() for i, d in enumerate(docs))


def test_every_copy_of_a_license_has_a_row():
    """Copies close together, whole and edited, at every alignment of the windows."""
    rng = random.Random(6)
    templates = licenses.Templates(licenses.TEMPLATES)
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0", "MIT-notice"):
        own = licenses.TEMPLATES[name].split()
        for shift in range(0, 256, 17):
            for gap in (0, 3, 40):
                words, spans = [f"a{rng.randrange(9999)}" for _ in range(shift)], []
                for _ in range(rng.choice((2, 3))):
                    copy = list(own)
                    if len(own) > 40:
                        copy[rng.randrange(10, len(own) - 10)] = "changed"
                    spans.append((len(" ".join([*words, ""])), len(" ".join([*words, *copy]).rstrip("./"))))
                    words += copy + [f"b{rng.randrange(9999)}" for _ in range(gap)]
                got = [m for m in licenses.matches([" ".join(words)], templates)[0] if m[2] == name]
                assert [m[:2] for m in got] == spans, (name, shift, gap)


def test_a_shard_that_needs_more_rules_than_two_bytes_have():
    """Repeated log lines: four bytes a symbol are taken where they are fewer bytes in all, and every document comes back."""
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 50_000, 22).astype(np.uint32) for _ in range(1000)]
    docs = [np.concatenate([lines[k] for k in rng.integers(0, len(lines), 60)]) for _ in range(800)]
    row = np.concatenate([x for d in docs for x in (d, [tokenfile.NO_PAIR])]).astype(np.uint32)
    narrow, rules = tokenfile.compress(row, 50_257)
    assert len(rules) == (1 << 16) - 1 - 50_257
    payload = tokenfile.write_shard(list(range(len(docs))), np.concatenate([*docs, [50_256]]).astype(np.uint32), np.r_[0, np.cumsum([len(d) for d in docs])[:-1], sum(map(len, docs)) + 1])
    shard = tokenfile.Shard(payload)
    assert shard.symbols.dtype.itemsize == 4 and len(payload) < 0.7 * (2 * len(narrow) + 16 * len(rules))
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs[:-1]))
    assert (shard.ids(7, 100, 140) == docs[7][100:140]).all()
    counts = collections.Counter(zip(shard.symbols[:-1].tolist(), shard.symbols[1:].tolist(), strict=True))
    assert sum(n >= 9 for n in counts.values()) < 50  # but for those across documents


def test_notices_in_many_wordings():
    templates = licenses.by_size(licenses.known())
    wanted = {
        "Licensed under the MIT license": "MIT-notice",
        "This project is released under the Apache License 2.0, see below": "Apache-2.0-notice",
        "# SPDX-License-Identifier: MIT": "MIT-notice",
        "// SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1-notice",
        "it may be distributed under the terms of the GNU General Public License, version 2": "GPL-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice",
        "photos are available under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0-notice",
        "text licensed under CC BY-SA 4.0 only": "CC-BY-SA-4.0-notice",
        "covered by the 3-Clause BSD License": "BSD-3-Clause-notice",
    }
    for text, name in wanted.items():
        assert {m[2] for m in licenses.matches([text], templates)[0]} == {name}, text
        assert len(licenses.matches([f"{text}. And {text}"], templates)[0]) == 2
    for text in ("MIT License", "he was licensed under the new law of the state", "licensed under the GNU General Public License", "", "a \ud800 b"):
        assert licenses.matches([text], templates) == [[]]


def test_whole_licenses_and_their_containment():
    templates = licenses.by_size(licenses.known())
    r = random.Random(9)
    for name, text in ((n, t) for n, t in licenses.known().items() if n.endswith("-text")):
        words = licenses.words_of(text)
        shingles = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for changes in (0, len(words) // 40, len(words) // 20):  # to a containment of some 0.8
            own = [w.decode() for w in words]
            for at in r.sample(range(len(own)), changes):
                own[at] = "changed"
            held = [w.encode() for w in own]
            exact = len(shingles & {tuple(held[i : i + 5]) for i in range(len(held) - 4)}) / len(shingles)
            got = [m for m in licenses.matches(["before it " * 30 + " ".join(own) + " and after" * 30], templates)[0] if m[2] == name]
            assert len(got) == (exact >= 0.8), (name, exact)
            assert not got or abs(got[0][3] - exact) < 1e-9


def test_wordings_go_in_passes_and_short_ones_need_all_words(spark):
    rows = spark.createDataFrame([(1, "one two three"), (2, "one two four"), (None, "so one two three four five six"), (3, None), (4, "")], "doc_id long, text string")
    named = {"a": ("one two three", "two three four five six"), "b": "one two four"}
    for size in (1, 1 << 20):
        got = sorted(((x["doc_id"] or 0, x["license"], x["start"], x["end"]) for x in licenses.scan(rows, named, pass_bytes=size).collect()))
        assert got == [(0, "a", 3, 16), (0, "a", 7, 30), (1, "a", 0, 13), (2, "b", 0, 12)]
