"""The pipeline's stages, one after the other, against what they promise."""

import corpus_pipeline
from lectorium.llm import common, packing, quality, rules, secrets, shingles, simhash


def first_of_each(texts):
    """The smallest id reachable over links of five-word shingles at 0.8, by all pairs."""
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))}
    label = {i: i for i in texts}
    for i, own in sets.items():
        for j, other in sets.items():
            if j < i and label[i] != label[j] and 5 * len(own & other) >= 4 * len(own | other):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def test_stages(spark, docs, data):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, rows, data), name)
        assert after.columns == docs.columns
        before, kept = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (rows, after))
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{data}/labels.parquet")
            assert kept.keys() == {r["doc_id"] for r in quality.judged(rows, labels).where("kept").collect()}
        elif name == "quality_rules":
            assert kept.keys() == {r["doc_id"] for r in rules.judged(rows).where("kept").collect()}
        elif name == "simhash_near_dedup":
            assert kept.keys() == set(first_of_each(before).values())
        else:
            found = {r["doc_id"]: r["spans"] for r in secrets.scan(rows).collect()}
            assert kept.keys() == before.keys()
            for i, t in before.items():
                spans = [(int(s), 0, int(e)) for _, s, e in (x.split(":") for x in found[i].split(",") if x)]
                assert kept[i] == secrets.redact(t, spans)
        rows = after
    last = corpus_pipeline.STAGES[-1][1](spark, rows, data)
    assert sorted(map(tuple, last.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packing.pack(rows).select("doc_id", "piece", "ids_crc32").collect()))


def test_odd_and_empty_tables(spark, odd, none, data):
    for rows in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, rows, data)
            if after.columns == rows.columns:
                assert after.count() <= rows.count()
            else:
                assert (after.count() == 0) == (rows.count() == 0)


def test_near_duplicates_come_through_the_tree_first(spark, monkeypatch):
    """What the tree of fingerprints connects is not compared in blocks; links that it gives and that are under 0.8 don't count; those that it can't see are found."""
    words = [f"w{i}" for i in range(4000)]
    text = lambda begin, n, *changed: " ".join(f"x{i}" if i in changed else words[begin + i] for i in range(n))
    texts = {1: text(0, 900), 2: text(0, 900, 400), 3: text(0, 900, 895), 4: text(1000, 60), 5: text(1000, 60, 30), 6: text(1000, 60, 3, 33), 7: text(2000, 900), 8: text(3000, 5), 9: text(3000, 5, 4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compared, planned = [], []
    links, plan = shingles.links, simhash.plan_tree
    monkeypatch.setattr(shingles, "links", lambda rows, *more: compared.extend(r["node"] for r in rows.collect()) or links(rows, *more))
    monkeypatch.setattr(simhash, "plan_tree", lambda *a, **k: planned.append(a) or plan(*a, **k))
    found = {r["doc_id"]: r["component_id"] for r in shingles.classes(docs).collect()}
    assert found == first_of_each(texts)
    assert planned and not set(compared) & {shingles.node_of(shingles.shingle_set(texts[i])) for i in (1, 2, 3)}
    sets = spark.createDataFrame([(n, list(range(10 - k))) for n, k in ((-5, 0), (7, 1), (9, 3))], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(-5, 6), (7, 7), (9, 6)], "node long, fp long")
    assert [tuple(r) for r in shingles.tree_links(nodes, sets).collect()] == [(7, -5)]
