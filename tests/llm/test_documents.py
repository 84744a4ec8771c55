"""Rules, secrets, near-duplicates, digests, licenses and the classifier against brute force."""

import collections
import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
import xxhash

from lectorium.llm import digest, licenses, quality, rules, secrets, simhash


def test_rules(odd, odd_rows, none):
    def counts(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {p for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)

    rows = rules.judged(odd).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted((i or 0, *counts(t or "")) for i, t in odd_rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert rules.judged(none).count() == 0
    kept = rules.kept(odd)
    assert kept.columns == odd.columns and rules.kept(none).count() == 0
    assert kept.count() == sum(r["kept"] for r in rows)


def test_rules_agree_with_their_sql(spark, docs, data):
    duckdb = pytest.importorskip("duckdb")
    cursor = duckdb.connect().execute(rules.ORACLE_SQL.replace("FROM documents", f"FROM '{data}/documents.parquet'"))
    names = [c[0] for c in cursor.description]
    plain = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(rules.judged(docs).select(names).collect()) == plain(cursor.fetchall())
    assert rules.kept(docs).count() == rules.judged(docs).where("kept").count()


BASE = {
    "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_of(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}[kind](m):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_secrets_base(odd, odd_rows, docs, none):
    for frame, rows in ((odd, odd_rows), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        found = sorted((r["doc_id"] or 0, r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.scan(frame).collect())
        expected = []
        for i, t in rows:
            spans = base_of(t or "")
            text = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)
            expected.append((i or 0, hashlib.sha256(text.encode()).hexdigest(), *(sum(k == n for _, k, _ in spans) for n in range(3))))
        assert found == sorted(expected)
    assert secrets.scan(none).count() == 0 and secrets.redacted(none).count() == 0


@pytest.mark.parametrize("text", ["secret: token: abcdefghijklmnop", "SECRET=token=abcdefghijklmnop", "ſecret: abcdefghijklmnop", "api_key = 'abcdefghijkl'", "AKIAAKIAABCDEFGHIJ", "aKey=abcdef0123456789abcdef"])
def test_secrets_corners(text):
    assert secrets.base_spans(text) == base_of(text)


def test_random_runs_are_found_and_words_are_not(spark):
    r = random.Random(5)
    planted = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (18, 24, 32, 40, 64)] + ["".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(40))]
    plain = ["internationalisationalised", "abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "getUserNameFromDatabaseById", "some_long_name_of_a_python_function_here", "12345678901234567890123456789"]
    words = "it was the best of times and it was the worst of times in the age of reason "
    rows = [(i, f"{words * 3}{x} {words}") for i, x in enumerate(planted + plain)]
    found = {x["doc_id"]: x["n_random"] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(rows))] == [1] * len(planted) + [0] * len(plain)
    text = secrets.redacted(spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [planted[i] in text[i]["text"] for i in range(len(planted))] == [False] * len(planted) and "[SECRET]" in text[0]["text"]
    assert all(x["n_chars"] == len(x["text"]) for x in text)


def brute_battery(run):
    """The three tests by their definitions."""
    alphabets = {16: "0123456789abcdef", 26: string.ascii_lowercase, 32: string.ascii_uppercase + "234567", 36: string.digits + string.ascii_lowercase, 62: string.digits + string.ascii_uppercase + string.ascii_lowercase}
    alphabets[64] = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
    k = secrets.encoding(run)
    text = run.replace("-", "+").replace("_", "/") if k == 64 else run.lower() if k in (16, 26, 36) else run
    x = [alphabets[k].index(c) for c in text]
    n, expected = len(x), len(x) / k
    chi = sum((x.count(v) - expected) ** 2 / expected for v in range(k))
    normal = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    uniform = normal((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))  # exact mean and variance under uniformity
    high = [v >= k / 2 for v in x]
    a, b = high.count(True), high.count(False)
    if not a or not b:
        return k, chi, uniform, 0.0, 0.0
    runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    mean, variance = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    m = sum(x) / n
    r = sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False)) / sum((p - m) ** 2 for p in x)
    return k, chi, uniform, 2 * normal(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0, 2 * normal(abs(r + 1 / n) * math.sqrt(n))


def test_battery_is_the_three_tests():
    r = random.Random(8)
    kinds = ["0123456789abcdef", "ABCDEF0123456789", string.ascii_lowercase, string.ascii_uppercase, string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/_-"]
    runs = ["".join(r.choice(k) for _ in range(n)) for k in kinds for n in (16, 19, 24, 64, 300) for _ in range(4)] + ["a" * 20, "ab" * 12, "internationalisation"]
    for run in runs:
        assert secrets.battery(run) == pytest.approx(brute_battery(run), rel=1e-6, abs=1e-9), run
    assert secrets.battery("1" * 20)[0] == 0


def test_moments_of_an_ordinary_run():
    """The chi-squared statistic's mean and variance under letter frequencies, against draws; and the turns' tail against the sum."""
    letters = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1]) * 1e6
    n, rng = 24, np.random.default_rng(3)
    draws = rng.multinomial(n, letters / letters.sum(), 40_000)
    chi = 26 / n * (draws**2).sum(1) - n
    for at in (chi.mean() - 2 * chi.std(), chi.mean(), chi.mean() + chi.std()):
        z = (at - chi.mean()) / chi.std()
        even = 0.5 * math.erfc(-z / math.sqrt(2))
        turning = sum(math.comb(n - 1, i) * secrets.ORDINARY_TURNS**i * (1 - secrets.ORDINARY_TURNS) ** (n - 1 - i) for i in range(5, n))
        product = even * turning
        assert secrets.log_p(n, 26, at, 5, letters) == pytest.approx(-math.log10(product * (1 - math.log(product))), rel=0.05)
    assert secrets.log_p(n, 26, math.inf, 5, letters) == 0.0


@pytest.mark.parametrize("seed", range(5))
def test_threshold_is_benjamini_hochberg(seed):
    r = random.Random(seed)
    values = [r.expovariate(0.9) for _ in range(r.randint(0, 400))] + [r.uniform(4, 9) for _ in range(r.randint(0, 30))]
    bins = collections.Counter(int(v / secrets.PER_BIN) for v in values)
    p = sorted(10 ** (-b * secrets.PER_BIN) for b in bins.elements())
    accepted = [x for n, x in enumerate(p, 1) if len(p) * x <= secrets.FDR * n]
    assert 10 ** -secrets.threshold(bins) == pytest.approx(max(accepted, default=0.0))


def test_runs_around_base_spans():
    r = random.Random(1)
    tail = "".join(r.choice(string.ascii_letters) for _ in range(20))
    text = f"{tail}-0123456789abcdef0-{tail[:15]} x {tail[:16]} y {tail[:15]}"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b in secrets.free_runs(text, base)] == [f"{tail}-", f"-{tail[:15]}", tail[:16]]
    covered = {i for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text) for i in range(*m.span())} - {i for s, _, e in base for i in range(s, e)}
    assert {i for a, b in secrets.free_runs(text, base) for i in range(a, b)} <= covered


def test_redaction_joins_overlaps():
    assert secrets.redact("abcdefgh", [(1, 0, 3), (2, 2, 5), (6, 1, 7)], "*") == "a*f*h"


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Smallest index reachable, by every pair."""
    x = np.array(prints, np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        new = np.array([label[row].min() for row in near]) if len(x) else label
        if (new == label).all():
            return label
        label = new


def test_simhash(docs, odd, odd_rows, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for frame, texts in ((docs, rows), (odd, odd_rows)):
        known = [(i, fingerprint(t or "")) for i, t in texts]
        label = classes([f for _, f in known])
        smallest = {}
        for (i, _), at in zip(known, label, strict=True):
            if i is not None:
                smallest[at] = min(i, smallest.get(at, i))
        expected = sorted((i or 0, f"{f:016x}", smallest.get(at)) for (i, f), at in zip(known, label, strict=True))
        assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()) == expected
    assert simhash.near_duplicates(none).count() == 0 and simhash.kept(none).count() == 0
    kept = simhash.kept(odd)
    assert kept.columns == odd.columns
    assert len({r["doc_id"] for r in kept.collect()}) == kept.count() == len({e[2] for e in expected})


@pytest.mark.parametrize("leaf", [40, 4000])
def test_tree_loses_no_link(spark, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 30)
    rng = np.random.default_rng(leaf)
    prints = rng.integers(0, 2**63, 900).astype(np.uint64)
    for _ in range(600):  # chains and balls of near ones
        prints = np.append(prints, prints[rng.integers(0, len(prints))] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 5)).tolist()))))
    prints = np.unique(prints)
    rows = spark.createDataFrame([(int(f), i) for i, f in enumerate(prints.view(np.int64))], "fp long, node long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(rows, leaf=leaf)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == classes(prints).tolist()


@pytest.mark.parametrize("levels", [0, 1, 8])
def test_full_leaves_go_on_splitting(spark, levels, monkeypatch):
    """Trees of trees, and blocks where no cut makes a leaf smaller, lose no link; no group is much fuller than it may be."""
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = np.random.default_rng(levels)
    bits = lambda n: np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, n).tolist())))
    prints = np.append(rng.integers(0, 2**63, 700).astype(np.uint64), [np.uint64(12345) ^ bits(3) for _ in range(400)])  # a ball that no cut divides
    prints = np.unique(np.append(prints, [f ^ bits(int(rng.integers(1, 5))) for f in prints[rng.integers(0, len(prints), 300)]]))
    rows = spark.createDataFrame([(int(f), i) for i, f in enumerate(prints.view(np.int64))], "fp long, node long")
    edges = simhash.links(rows, leaf=300, largest=120, most=3, sub_leaves=4)
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == classes(prints).tolist()
    routed = rows.selectExpr("1L AS leaf", "fp", "node")
    sizes = [r["count"] for frame in simhash._split_further(routed, 3, 120, 4) for r in frame.groupBy("leaf").count().collect()]
    assert max(sizes) <= (120 if levels == 8 else 160) and (levels == 0 or len(sizes) > 10)  # at the last level blocks are as even as hashes are


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400), (500, 450)], "u long, v long")
    assert {(r["node"], r["component"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(201)} | {(n, 400) for n in (400, 450, 500)}


def signed_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def test_ids_with_many_rows_fill_several_ranges(spark):
    """A third of the rows have one doc_id, a third none: each row is in the range that the order calls for, and no range has much more than its share."""
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} {'x' * (i % 40)}") for i in range(1200)]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        dealt = [r for r in digest.in_order(frame).collect() if not r["carried"]]
        found = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in digest.fingerprints(frame).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda i, t: (i is not None, i or 0, signed_hash(t))
    placed = sorted(dealt, key=lambda r: key(r["doc_id"], r["text"]))
    assert [r["bucket"] for r in placed] == sorted(r["bucket"] for r in placed)
    sizes = collections.Counter(r["bucket"] for r in dealt)
    assert len(sizes) >= 10 and max(sizes.values()) < 3 * 1200 / 12
    order = sorted(rows, key=lambda r: key(*r))
    edits = [(i, len(t), hashlib.sha256(digest.edited(t, order[n - 1][1]).encode()).hexdigest()) for n, (i, t) in enumerate(order)]
    assert sorted(found, key=str) == sorted(edits, key=str)


def test_digest_in_order(odd, odd_rows, docs, none):
    for frame, rows in ((odd, odd_rows), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]), r[1]))
        expected = []
        rank = digest.ranks(digest.tally(frame))
        own = [digest.digests([t], rank)[0] for _, t in order]
        for n, (i, t) in enumerate(order):
            changed = t[: len(t) - len(t) // 2] + order[n - 1][1][: len(t) // 2]
            other = digest.digests([changed], rank)[0]
            expected.append((i or 0, len(t), hashlib.sha256(changed.encode()).hexdigest(), own[n].text(), other.text(), round(own[n].likeness(other), 9), round(own[n].likeness(own[n - 1]), 9)))
        got = [(r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in digest.fingerprints(frame).collect()]
        assert sorted(got) == sorted(expected)
    assert digest.fingerprints(none).count() == 0


M64 = (1 << 64) - 1


def brute_mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def brute_digest(text, rank):
    """(features, set of bits) of each filter of the chain, by the definitions."""
    data, w = text.encode(), digest.WINDOW
    windows = [data[i : i + w] for i in range(len(data) - w + 1)]
    level = [rank[sum(x[i] == x[j] for i in range(w) for j in range(i))] for x in windows]
    if len(windows) >= digest.POPULAR:
        wins = collections.Counter(min(range(s, s + digest.POPULAR), key=lambda i: (level[i], i)) for s in range(len(windows) - digest.POPULAR + 1))
        chosen = [i for i in sorted(wins) if wins[i] >= digest.LEAST and level[i] < len(rank)]
    else:
        chosen = list(range(0, len(windows), 4))
    own = [windows[i] for i in chosen]
    hashes = [brute_mixed((int.from_bytes(x[:8], "little") * 0x9E3779B97F4A7C15 & M64) ^ brute_mixed(int.from_bytes(x[8:], "little"))) for x in own]
    if data and not hashes:
        hashes = [brute_mixed(xxhash.xxh64_intdigest(data))]
    chain = [hashes[a : a + digest.CAPACITY] for a in range(0, len(hashes), digest.CAPACITY)]
    return [(len(part), {(h >> (11 * i)) % digest.FILTER for h in part for i in range(digest.HASHES)}) for part in chain]


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = sorted((a, b), key=lambda c: (len(c), sum(n for n, _ in c)))
    total = 0.0
    for n, bits in a:
        best = 0.0
        for _, other in b:
            chance, most = len(bits) * len(other) / digest.FILTER, min(len(bits), len(other))
            best = max(best, min(1.0, max(0.0, (len(bits & other) - chance) / max(most - chance, 1e-9))))
        total += n * best
    return total / sum(n for n, _ in a)


def test_digest_by_its_definitions():
    r = random.Random(9)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 2, 4, 9, 12, 60, 900)] + ["é" * 30, "a" * 400, "0123456789abcdef", "ab" * 23]
    texts.append(texts[7][:2000] + texts[6] + texts[7][2500:])
    pairs = collections.Counter(sum(x[i] == x[j] for i in range(16) for j in range(i)) for t in texts for x in (t.encode()[k : k + 16] for k in range(len(t.encode()) - 15)))
    counts = np.array([pairs.get(i, 0) for i in range(digest.ALL_PAIRS + 1)])
    order = sorted(range(len(counts)), key=lambda i: (counts[i], i))
    rank = [order.index(i) if i <= digest.MAX_PAIRS else len(counts) for i in range(len(counts))]
    assert digest.ranks(counts).tolist() == rank
    found, expected = digest.digests(texts, digest.ranks(counts)), [brute_digest(t, rank) for t in texts]
    for own, chain in zip(found, expected, strict=True):
        assert own.features.tolist() == [n for n, _ in chain]
        assert [set(np.flatnonzero(np.unpackbits(b)).tolist()) for b in own.bits] == [bits for _, bits in chain]
    assert max(len(c) for c in expected) > 1
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert found[i].likeness(found[j]) == pytest.approx(brute_likeness(expected[i], expected[j]))
            if i == j:
                assert found[i].likeness(found[j]) == pytest.approx(1.0)


def test_digest_tells_near_from_far(docs):
    rows = digest.fingerprints(docs).where("n_chars > 400").collect()
    assert np.median([r["near_edited"] for r in rows]) > 0.4 > 0.1 > np.median([r["near_next"] for r in rows])


def test_equal_pairs():
    data = np.random.default_rng(2).integers(97, 101, 200).astype(np.uint8)
    w = digest.WINDOW
    assert digest.equal_pairs(data).tolist() == [sum(x[i] == x[j] for i in range(w) for j in range(i)) for x in (data[k : k + w] for k in range(len(data) - w + 1))]
    assert len(digest.equal_pairs(data[: w - 1])) == 0


def brute_licenses(text):
    """Templates that some window of a text holds to the threshold, with a notice's own words."""
    words, out = licenses.words_of(text), set()
    grams = {k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] for k in (3, 4, 5)}
    for name, wordings in licenses.known().items():
        for t in [wordings] if isinstance(wordings, str) else wordings:
            own = licenses.words_of(t)
            k = min(len(own), 5)
            wanted = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
            have = [i for i, g in enumerate(grams[k]) if g in wanted]
            for a in have:
                inside = [i for i in have if a <= i < a + len(own)]
                if len({grams[k][i] for i in inside}) >= 0.8 * len(wanted) and licenses.needed(name, own) <= set(words[a : inside[-1] + k]):
                    out.add(name)
    return out


def test_licenses(spark, docs, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    r = random.Random(4)
    for n in range(60):
        own = r.choice(list(licenses.TEMPLATES.values())).split()
        if len(own) > 40:
            own[r.randrange(len(own))] = "changed"
        a, b = r.choice(rows)[1].split(), r.choice(rows)[1].split()
        rows.append((1000 + n, " ".join(a[: r.randrange(len(a) + 1)] + own + b[:40])))
    found = collections.defaultdict(set)
    texts = dict(rows)
    for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[x["doc_id"]].add(x["license"])
        assert 0.8 <= x["containment"] <= 1 and len(licenses.words_of(texts[x["doc_id"]][x["start"] : x["end"]])) >= 5
    assert {i: found[i] for i, _ in rows} == {i: brute_licenses(t) for i, t in rows}
    assert [(x["doc_id"], x["license"]) for x in licenses.scan(odd).collect()] == [(11, "MIT-notice")] and licenses.scan(none).count() == 0
    several = licenses.scan(odd, {"a": "one two three four five six", "MIT": licenses.TEMPLATES["MIT-notice"]}, pass_bytes=10)
    assert [x["license"] for x in several.collect()] == ["MIT"]
    with pytest.raises(ValueError):
        licenses.scan(odd, {"short": "one two"})


def kneser_ney(trusted, order, discounts):
    """Probabilities by the textbook, with given discounts for each order."""
    levels = {order: collections.Counter(k for t in trusted for k in grams_of(t, order))}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(k[1:] for k in levels[n + 1])

    def p(k):
        if not k:
            return 1.0 / (1 << quality.BITS)
        level, d = levels[len(k)], discounts[len(k)]
        own = {x: c for x, c in level.items() if x[:-1] == k[:-1]}
        total = sum(own.values())
        if not total:
            return p(k[1:])
        take = lambda c: d[min(c, 3) - 1] if c else 0.0
        return max(level[k] - take(level[k]), 0) / total + sum(map(take, own.values())) / total * p(k[1:])

    return p


def grams_of(t, order):
    points = [0] * (order - 1) + [ord(c) for c in t]
    return [tuple(points[i : i + order]) for i in range(len(t))]


def brute_discounts(counter):
    n1, n2, n3, n4 = (sum(c == i for c in counter.values()) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)]


def half_of(text):
    return xxhash.xxh64_intdigest(text.encode(), 42) & 1


def brute_models(trusted):
    """For each half of texts, the probabilities from the trusted texts of the other half."""
    out = []
    for half in (0, 1):
        levels = {4: collections.Counter(k for t in trusted if half_of(t) != half for k in grams_of(t, 4))}
        for n in (3, 2, 1):
            levels[n] = collections.Counter(k[1:] for k in levels[n + 1])
        out.append(kneser_ney([t for t in trusted if half_of(t) != half], 4, {n: brute_discounts(c) for n, c in levels.items()}))
    return out


def test_perplexity(spark):
    trusted, asked = ["abracadabra", "abra cadabra", "barbara", "cabal", "bar"], ["abra", "zz", "", "cadab ra", "cabal", "barbara"]
    rows = spark.createDataFrame([(i, None, t) for i, t in enumerate(asked)], "doc_id long, lang string, text string")
    models = brute_models(trusted)
    assert {half_of(t) for t in trusted} == {half_of(t) for t in asked if t} == {0, 1}
    for r in quality.scored(rows, spark.createDataFrame([(t,) for t in trusted], "text string")).collect():
        text = asked[r["doc_id"]]
        own = grams_of(text, 4)
        assert r["n_grams"] == len(own)
        if own:
            assert r["log_ppl"] == pytest.approx(-sum(math.log(models[half_of(text)](k)) for k in own) / len(own), rel=1e-5)
        else:
            assert r["log_ppl"] is None


@pytest.mark.parametrize("hot", [0, 40, 1 << 20])
def test_whole_classifier(spark, hot):
    """Discounts, perplexities, bounds and verdicts, each document by the other half's counts, with n-grams known to the tasks and joined."""
    r = random.Random(11)
    vocabulary = {"en": ["the", "cat", "sat", "on", "mats"], "fr": ["le", "chat", "est", "là"]}
    rows = [(i, lang, " ".join(r.choice(vocabulary[lang]) for _ in range(r.randint(3, 12)))) for i, lang in enumerate(r.choice(["en", "fr"]) for _ in range(120))]
    rows += [(200 + i, "en", "".join(r.choice("xyzqkw ") for _ in range(30))) for i in range(10)] + [(300, None, "the cat"), (301, "fr", ""), (302, "de", None), (7, rows[7][1], rows[7][2])]
    labels = [(i, 1, 0) for i in range(100)] + [(200, 0, 0), (201, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models, known = brute_models([t for i, _, t in rows if i < 100]), {}

    def score(t):
        half = half_of(t)
        for k in grams_of(t, 4):
            if (half, k) not in known:
                known[half, k] = math.log(models[half](k))
        return -sum(known[half, k] for k in grams_of(t, 4)) / len(t)

    expected = [(i, lang, score(t) if t else None) for i, lang, t in rows]
    bounds = {}
    for lang in ("en", "fr", None):
        bins = sorted(math.floor(s * 1000 + 1e-9) for i, own, s in expected if i < 100 and s is not None and lang in (own, None))
        share = lambda q: next(b for n, b in enumerate(bins, 1) if n / len(bins) >= q)  # noqa: B023, E731
        bounds[lang] = share(quality.LOW) / 1000, (share(quality.HIGH) + 1) / 1000
    found = collections.defaultdict(list)
    for x in quality.judged(docs, marks, hot=hot).collect():
        found[x["doc_id"]].append(x)
    for i, lang, s in expected:
        least, most = bounds[lang if lang in ("en", "fr") else None]
        x = found[i][0]
        assert (x["least"], x["most"]) == pytest.approx((least, most), abs=0.0011)
        if s is None:
            assert x["log_ppl"] is None and not x["kept"]
            continue
        assert x["log_ppl"] == pytest.approx(s, rel=1e-5)
        if min(abs(s - least), abs(s - most)) > 0.002:
            assert x["kept"] == (least <= s <= most)
    assert len(found[7]) == 2 and found[7][0] == found[7][1]
    assert not any(found[i][0]["kept"] for i in range(200, 210)) and sum(found[i][0]["kept"] for i in range(100)) > 95


def test_classifier(spark, docs, odd, odd_rows, none, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    known = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect()]
    assert np.mean([k for k, q in known if q]) > 0.97 and np.mean([k for k, q in known if not q]) < 0.5
    some = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (3, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept(odd, some)
    assert kept.columns == odd.columns and 5 in {r["doc_id"] for r in kept.collect()}
    assert quality.judged(odd, some).count() == len(odd_rows)
    assert quality.judged(odd, some.limit(0)).where("kept").count() == sum(bool(t) for _, t in odd_rows)
    assert quality.kept(none, some).count() == 0


def test_lookup():
    keys = np.random.default_rng(0).integers(0, 1 << 60, 5000)
    known = np.unique(keys)
    assert (known[quality.Lookup(known)(keys)] == keys).all()
