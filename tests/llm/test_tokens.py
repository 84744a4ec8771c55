"""Pieces, token files and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from lectorium.llm import packing, pieces, tokenfile, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def random_texts(n):
    parts = random.Random(3)
    alphabet = [" ", "\n", "a", "b", "'s", "é", "1", "!", "\t", "\xa0", "  ", "The", "<|endoftext|>", "　", "日", "\x1c", "\r\n", "'re", "_", "²", "tion", "▁"]
    return ["".join(parts.choice(alphabet) for _ in range(parts.randint(0, 12))) for _ in range(n)]


def test_encoder_is_the_library(tokenizer, docs):
    texts = random_texts(4000) + [r["text"] for r in docs.limit(100).collect()]
    ids, bounds = tokens.Encoder(tokens.default_path()).encode(texts)
    for i, found in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert found.ids == ids[bounds[i] : bounds[i + 1]].tolist(), texts[i]


def test_encoder_with_a_small_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    own = tokens.Encoder(tokens.default_path())
    for turn in range(6):
        texts = [f"w{turn}{i} the and of{i % 3}\nline{i}, end" for i in range(40)]
        ids, bounds = own.encode(texts)
        assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(40)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_marks_at_the_end_of_a_word_make_no_new_word(tokenizer):
    """A word is computed once, whatever marks follow it."""
    given, own = [], tokens.Encoder(tokens.default_path())
    compute = own._ids
    own._ids = lambda texts: given.extend(texts) or compute(texts)
    ends = ["", ".", ",", "!!", ".,", "&&&"]
    texts = [" ".join(f"{a}one{b}{end}" for a in "bcdfgh" for b in "aeiou\u00e9") for end in ends]
    ids, bounds = own.encode(texts)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sum(text.count("one") for text in given) == 36


def test_marks_after_odd_characters(tokenizer):
    parts = random.Random(8)
    alphabet = [" ", "\n", ".", ",", "!?", "#", "&", "'", "'s", "'re", "-", "\u00d7", "\u00f7", "\u0301", "\u00aa", "\u00b2", "\u01c5", "\u0250", "\u0416", "\u65e5", "\u0660", "7", "a", "\u00e9", "Tion", "\t", "\U0001f600", "_"]
    texts = ["".join(parts.choice(alphabet) for _ in range(parts.randint(0, 9))) for _ in range(20_000)]
    own = tokens.Encoder(tokens.default_path())
    for a in (0, 10_000):
        ids, bounds = own.encode(texts[a : a + 10_000])
        for i, e in enumerate(tokenizer.encode_batch(texts[a : a + 10_000], add_special_tokens=False)):
            assert e.ids == ids[bounds[i] : bounds[i + 1]].tolist(), repr(texts[a + i])
    assert [x.tolist() for x in own.encode([])] == [[], [0]] and own.encode([""])[1].tolist() == [0, 0]


def test_pieces_are_the_library_at_rate_zero():
    texts = [t for t in random_texts(4000) if "▁" not in t]
    own = pieces.Encoder(pieces.default_path(), 0.0, 0)
    ids, bounds = own.encode(texts, [0] * len(texts))
    for i, t in enumerate(texts):
        assert own.model.processor.encode(t) == ids[bounds[i] : bounds[i + 1]].tolist(), repr(t)


def slow_pieces(model, text_unit, key, dropout):
    """One word's agenda step by step."""
    symbols = [(int(model.first[ord(c)]), i, i + 1) for i, c in enumerate(text_unit.replace(" ", "▁"))]
    least = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
    while True:
        best = None
        for n, ((a, s, m), (b, _, e)) in enumerate(zip(symbols, symbols[1:], strict=False)):
            merged = int(model._merge(np.array([a]), np.array([b]))[0])
            span = np.array([s << 42 | m << 21 | e], np.uint64)
            if merged < 0 or dropout and pieces._mixed(key ^ pieces._mixed(span))[0] < least:
                continue
            if best is None or (model.rank[merged], n) < best[:2]:
                best = (model.rank[merged], n, (merged, s, e))
        if best is None:
            return [s for s, _, _ in symbols]
        symbols[best[1] : best[1] + 2] = [best[2]]


def test_dropout_is_the_agenda_and_varies():
    model = pieces.Model(pieces.default_path())
    words = [" tokenization", " untranslatable", " aaaaaaaa", " thonononereshtion", " a", " internationalisation"] * 5
    keys = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for rate in (0.0, 0.1, 0.6):
        ids, sizes = model.segment(words, keys, rate)
        bounds = np.r_[0, np.cumsum(sizes)]
        for i, w in enumerate(words):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == slow_pieces(model, w, keys[i : i + 1], rate)
    seen = {tuple(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(0, len(words), 6)}
    assert len(seen) > 1


def test_every_occurrence_has_draws_of_its_own():
    """A word over many documents takes hundreds of segmentations, each that of its own agenda."""
    own = pieces.Encoder(pieces.default_path(), 0.3, 7)
    rows = ["a internationalisation\nunderstanding  of \n"] * 600
    seen = set()
    for a in (0, 300):
        ids, bounds = own.encode(rows[a : a + 300], list(range(a, a + 300)))
        for i in range(300):
            words = [u if u[:1] == "\n" else " " + u for u in own.units(rows[i])]
            salt = pieces._mixed(np.array([a + i], np.uint64) ^ np.uint64(7 * 0x9E3779B97F4A7C15 & 2**64 - 1))
            keys = pieces._mixed(salt + np.arange(len(words), dtype=np.uint64))
            parts = [slow_pieces(own.model, w, keys[n : n + 1], 0.3) for n, w in enumerate(words)] if i < 40 else None
            found = ids[bounds[i] : bounds[i + 1]].tolist()
            if parts:
                space = [own.model.byte_ids[10] if p == pieces.OUTSIDE + 10 else p for w in parts for p in w]
                assert found == space
            seen.add(tuple(found))
    assert len(seen) > 500
    assert len({tuple(own.encode(["government"], [i])[0].tolist()) for i in range(1500)}) > 40


def test_pieces_decode_without_loss(odd, odd_rows, none):
    rows = pieces.round_trip(odd, dropout=0.3, seed=9).collect()
    assert len(rows) == len(odd_rows) and all(r["lossless"] for r in rows)
    again = {tuple(r) for r in pieces.round_trip(odd, dropout=0.3, seed=9).collect()}
    assert again == {tuple(r) for r in rows} != {tuple(r) for r in pieces.round_trip(odd, dropout=0.3, seed=10).collect()}
    assert pieces.round_trip(none).count() == 0
    back = pieces.decoded(pieces.encoded(odd, dropout=0.3, seed=9)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t in odd_rows)


def test_token_file(tokenizer, odd, odd_rows, none):
    rows = sorted(tokenfile.round_trip(odd, shard=1000).collect(), key=lambda r: r["start"])
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64), r[1] or ""))
    ids = [ids_of(tokenizer, t) for _, t in order]
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [
        (i, sum(map(len, ids[:n])), len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for n, ((i, _), own) in enumerate(zip(order, ids, strict=True))
    ]
    assert tokenfile.round_trip(none).count() == 0


@pytest.mark.parametrize("top", [3, 300, 70_000])
def test_grammar_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    docs = [rng.integers(0, top, n).astype(np.uint32) for n in (0, 1, 5000, 0, 3000)] + [np.zeros(999, np.uint32), np.tile(np.arange(7, dtype=np.uint32), 400)]
    bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
    payload = tokenfile.write_shard([4, None, 6, 7, 8, 9, 10], np.concatenate(docs), bounds)
    shard = tokenfile.Shard(payload)
    assert (shard.all()[0] == np.concatenate(docs)).all() and (shard.all()[1] == bounds).all()
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
        for a, b in ((0, 1), (7, 19), (2, len(d))):
            assert (shard.ids(i, a, min(b, len(d))) == d[a:b]).all() if len(d) > a else True
    if top == 3:
        assert len(payload) < 2 * len(np.concatenate(docs))
    with pytest.raises(ValueError):
        tokenfile.Shard(b"XXXX" + payload[4:])


def test_batches_of_pairs_equal_single_replacements():
    """A round's pairs share no symbol, so replacing them one after the other gives the same symbols."""
    row = np.random.default_rng(1).integers(0, 6, 4000).astype(np.uint32)
    got, rules = tokenfile.compress(row, 6, least=50, rounds=1)
    out = row.tolist()
    for n, (a, b) in enumerate(rules.tolist()):
        i, new = 0, []
        while i < len(out):
            if i + 1 < len(out) and out[i] == a and out[i + 1] == b:
                new.append(6 + n)
                i += 2
            else:
                new.append(out[i])
                i += 1
        out = new
    assert got.tolist() == out and len(rules)


def test_shards_have_the_bytes_they_had():
    """Of two and of four bytes a symbol: by the code of round 3, which scanned the symbols otherwise."""
    rng = np.random.default_rng(11)
    words = [rng.integers(0, 300, rng.integers(1, 6)) for _ in range(400)]
    for row, crc in ((np.concatenate([words[i] for i in rng.integers(0, 400, 30_000) ** 2 // 400]), 3558916856), (np.tile(rng.integers(0, 70_000, 900), 40), 1302456591)):
        bounds = np.unique(np.r_[0, rng.integers(0, len(row), 50), len(row)])
        payload = tokenfile.write_shard(list(range(len(bounds) - 1)), row.astype(np.uint32), bounds)
        assert zlib.crc32(payload) == crc


def test_packing(tokenizer, odd, odd_rows, none):
    rows = packing.pack(odd, size=64).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    expected = []
    for i, t in odd_rows:
        ids = ids_of(tokenizer, t)
        first = len(ids) % 64 or 64
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 64)], [*range(first, len(ids), 64), len(ids)], strict=True)):
            expected.append((i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    assert len(sequences) == -(-sum(e[3] for e in expected) // 64)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_every_piece_once_and_packs_as_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 2048])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 3000))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.plan(counts, size)
    fill = {}
    for n, first, copies, sequence, offset in slots.tolist():
        later = [s[1] for s in slots.tolist() if s[0] == n and s[1] > first]
        for rank in range(first, min(later, default=counts[n])):
            fill.setdefault(sequence + (rank - first) // copies, []).append((offset + n * ((rank - first) % copies), n))
    assert sorted(n for own in fill.values() for _, n in own) == sorted(lengths)
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    rooms = []
    for n in sorted(lengths, reverse=True):  # best fit on pieces
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    assert len(fill) <= len(rooms) * 1.01 + 1
