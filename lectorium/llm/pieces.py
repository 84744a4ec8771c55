"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model's merges run as an agenda: of a word's neighbouring symbols whose concatenation is a piece, the pair with the best
score, the leftmost of equals, is merged next, until no pair is left. A candidate is skipped when the hash of seed, document,
position of the word and span of the candidate falls below the dropout rate: every occurrence of a word has draws of its
own, and a seed always gives the same pieces. Words are merged many at a time, one step of each word's agenda in each round.
No piece of the model reaches across the space before a word or across a line feed, so words are independent of each other.
Known words are kept with their pieces where nothing is skipped and with the merges that lead to these: an occurrence of
which none of those is skipped has the same pieces, all others go through the agenda. The table is emptied when it is full.
At rate zero the pieces are the library's own. Characters that the model lacks, and its own sign for spaces, fall back to bytes: decoding always gives
the text back.

Defined cases. Null and empty texts have no pieces and decode to the empty text. Repeated rows with one doc_id get the same
pieces; a null doc_id counts as 0 in the hash. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, kept_one, of, text_slices, texts
from .quality import Lookup

DROPOUT = 0.1
SEED = 1
CACHE = 250_000
OUTSIDE = 1 << 16
SIGN, HIDDEN = "▁", "\udc81"
NONE = np.int64(1) << np.int64(62)
SLICE = 2 << 20
UNITS = re.compile(r"\n[^ \n]*| +[^ \n]*")
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
CHECKED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_hash(dropout: float) -> np.uint64:
    """A candidate is skipped if its hash lies below."""
    return np.uint64(min(int(dropout * 2**64), 2**64 - 1))


class Model:
    """The model's pieces as tables: merges by pair of symbols, bytes by piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        if n > OUTSIDE or any(SIGN in p.lstrip(SIGN) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("this model's pieces reach across words")
        self.first = np.arange(0x110000, dtype=np.int32) + OUTSIDE  # symbol of each character; those that are no pieces follow
        for p, i in pieces.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.first[ord(SIGN)] = pieces.get(SIGN, OUTSIDE + ord(SIGN))
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = np.full(n, 0, np.int64)
        keys, merged = [], []
        for p, i in pieces.items():
            self.rank[i] = order[sp.get_score(i)]
            for cut in range(1, len(p)):
                halves = [pieces.get(h, int(self.first[ord(h)]) if len(h) == 1 else None) for h in (p[:cut], p[cut:])]
                if None not in halves:
                    keys.append(halves[0] << 21 | halves[1])
                    merged.append(i)
        by = np.argsort(keys)
        self.pair_keys, self.merged = np.array(keys, np.int64)[by], np.array(merged, np.int64)[by]
        self.look = Lookup(self.pair_keys)
        self.byte_ids = np.zeros(256, np.int32)
        coded = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], coded[i] = i, bytes([value])
        for p, i in pieces.items():
            coded[i] = p.replace(SIGN, " ").encode()
        self.sizes = np.fromiter(map(len, coded), np.int64, n)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 21 | right
        at = np.minimum(self.look(key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.merged[at], -1)

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each character of all units, and how many each unit has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        return self.first[np.frombuffer("".join(units).replace(" ", SIGN).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64), sizes

    def segment(self, units: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units one after the other, and how many each has. keys: the occurrences' hashes."""
        return self.agenda(*self.symbols(units), keys, dropout)[:2]

    def _ranks(self, symbol: np.ndarray, word: np.ndarray, place: np.ndarray, end: np.ndarray, at: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at these places; NONE for no piece and for skipped candidates."""
        merged = self._merge(symbol[at], symbol[at + 1])
        rank = np.where(merged >= 0, self.rank[merged], NONE)
        if dropout:
            some = np.flatnonzero(merged >= 0)
            one = at[some]
            span = (place[one] << 42 | end[one] << 21 | end[one + 1]).astype(np.uint64)
            rank[some[_mixed(keys[word[one]] ^ _mixed(span)) < least_hash(dropout)]] = NONE
        return rank, merged

    def agenda(self, symbol: np.ndarray, sizes: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all words one after the other and how many each has; hashes of the spans that were merged, and how many each word has."""
        n = len(sizes)
        word = np.repeat(np.arange(n), sizes)
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = place + 1
        rank, merged = np.full(len(symbol), NONE), np.full(len(symbol), -1)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at], merged[at] = self._ranks(symbol, word, place, end, at, keys, dropout)
        done_symbol, done_word, done_place, spans, owners = [], [], [], [], []
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.where(rank < NONE, rank << 40 | np.arange(len(rank)), NONE), begin)
            open_ = best < NONE
            chosen = best[open_] & ((1 << 40) - 1)
            keep = np.repeat(open_, np.diff(np.r_[begin, len(symbol)]))
            closed = ~keep
            done_symbol.append(symbol[closed])
            done_word.append(word[closed])
            done_place.append(place[closed])
            spans.append(place[chosen] << 42 | end[chosen] << 21 | end[chosen + 1])
            owners.append(word[chosen])
            symbol[chosen], end[chosen] = merged[chosen], end[chosen + 1]
            rank[chosen] = NONE
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, place, end, rank, merged = symbol[keep], word[keep], place[keep], end[keep], rank[keep], merged[keep]
            at = moved[chosen]
            at = np.r_[at, at[at > 0] - 1]  # pairs with the new symbol on either side
            inside = (at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])
            rank[at[~inside]] = NONE
            at = at[inside]
            rank[at], merged[at] = self._ranks(symbol, word, place, end, at, keys, dropout)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        by = np.argsort(owner, kind="stable")
        span = _mixed((np.concatenate(spans) if spans else owner)[by].astype(np.uint64))
        return *self._ids(done_symbol, done_word, done_place, n), span, np.bincount(owner, minlength=n)

    def _ids(self, done_symbol: list[np.ndarray], done_word: list[np.ndarray], done_place: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        symbol, word, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbol, done_word, done_place))
        by = np.argsort(word << 32 | place, kind="stable")
        symbol, word = symbol[by], word[by]
        outside = np.flatnonzero(symbol >= OUTSIDE)
        if len(outside):
            points, index = np.unique(symbol[outside] - OUTSIDE, return_inverse=True)
            coded = [SIGN.encode() if chr(p) == HIDDEN else chr(p).encode("utf-8", "surrogatepass") for p in points.tolist()]
            length = np.ones(len(symbol), np.int64)
            length[outside] = np.fromiter(map(len, coded), np.int64, len(coded))[index]
            start = np.cumsum(length) - length
            out = np.repeat(symbol, length)
            for c in range(len(points)):
                ids = self.byte_ids[np.frombuffer(coded[c], np.uint8)]
                for k, i in enumerate(ids):
                    out[start[outside[index == c]] + k] = i
            symbol, word = out, np.repeat(word, length)
        return symbol.astype(np.int32), np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids[bounds[i]:bounds[i + 1]]."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes() if total else b""
        at = np.r_[0, ends][bounds].tolist()
        return [data[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(at, at[1:], strict=False)]


class Arena:
    """Rows of numbers, found by their own number."""

    def __init__(self, kind: type):
        self.data, self.used, self.starts, self.sizes, self.filled = np.zeros(1 << 16, kind), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def room(self, rows: int, numbers: int) -> None:
        while self.used + numbers > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.filled + rows > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])

    def add(self, numbers: np.ndarray, sizes: np.ndarray) -> None:
        self.room(len(sizes), len(numbers))
        self.data[self.used : self.used + len(numbers)] = numbers
        own = slice(self.filled, self.filled + len(sizes))
        self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.filled = self.used + len(numbers), self.filled + len(sizes)

    def rows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after the other, and how many each has."""
        return gathered(self.data, self.starts[wanted], self.sizes[wanted]), self.sizes[wanted]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """encode(texts, doc_ids) with a table of known words: their symbols, their pieces where nothing is skipped, and the merges that these take."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.model, self.dropout, self.seed = Model(path), dropout, seed
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.symbols, self.ids, self.merges = Arena(np.int32), Arena(np.int32), Arena(np.uint64)

    @staticmethod
    def units(text: str) -> list[str]:
        """Words without the space before each; a word that begins with a line feed has none."""
        if SIGN in text:
            text = text.replace(SIGN, HIDDEN)
        if text[0] == " " or "  " in text or " \n" in text:
            return [u[1:] if u[0] == " " else u for u in UNITS.findall(" " + text)]
        if text[0] == "\n":
            return ["", *text.replace("\n", " \n").split(" ")[1:]]
        return text.replace("\n", " \n").split(" ")

    def _learn(self, units: list[str]) -> None:
        symbols, sizes = self.model.symbols([u if u[:1] == "\n" else " " + u for u in units])
        self.symbols.add(symbols, sizes)
        ids, n_ids, merges, n_merges = self.model.agenda(symbols, sizes, np.zeros(len(units), np.uint64), 0.0)
        self.ids.add(ids, n_ids)
        self.merges.add(merges, n_merges)

    def encode(self, rows: list[str], doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and their bounds."""
        if len(self.known) > CACHE:
            self._clear()
        lists = [self.units(t) if t else [] for t in rows]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = list(chain.from_iterable(lists))
        known, before = self.known, len(self.known)
        code = np.fromiter((known.setdefault(u, len(known)) for u in flat), np.int64, len(flat))
        if len(known) > before:
            self._learn(list(islice(known, before, None)))
        starts, sizes, data = self.ids.starts[code], self.ids.sizes[code], self.ids.data
        ends = np.cumsum(counts)
        if self.dropout:
            salt = _mixed(np.array([(d or 0) & (2**64 - 1) for d in doc_ids], np.uint64) ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & 2**64 - 1))
            turn = np.arange(len(flat)) - np.repeat(ends - counts, counts)
            keys = _mixed(np.repeat(salt, counts) + turn.astype(np.uint64))
            # an occurrence takes its word's own pieces unless one of the merges that lead to them is skipped
            merges, n_merges = self.merges.rows(code)
            skipped = _mixed(np.repeat(keys, n_merges) ^ merges) < least_hash(self.dropout)
            before = np.r_[0, np.cumsum(skipped)]
            stops = np.cumsum(n_merges)
            other = np.flatnonzero(before[stops] > before[stops - n_merges])
            ids, n_ids, _, _ = self.model.agenda(*map(np.ndarray.astype, self.symbols.rows(code[other]), (np.int64, np.int64)), keys[other], self.dropout)
            self.ids.room(0, len(ids))  # they lie behind the known ones until the next call
            data = self.ids.data
            data[self.ids.used : self.ids.used + len(ids)] = ids
            starts[other], sizes[other] = self.ids.used + np.cumsum(n_ids) - n_ids, n_ids
        return gathered(data, starts, sizes), np.r_[0, np.cumsum(sizes)][np.r_[0, ends]]


def encoder(path: str, dropout: float, seed: int) -> Encoder:
    """One for each Python worker, file, rate and seed."""
    return kept_one(("pieces", path, dropout, seed), lambda: Encoder(path, dropout, seed))


def encoded(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, ids of every row."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, most=SLICE):
                ids, bounds = encoder(path, dropout, seed).encode(texts(piece), piece.column("doc_id").to_pylist())
                yield of(ENCODED, doc_id=piece.column("doc_id"), ids=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids). Null ids decode to the empty text."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            bounds = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
            text = encoder(path, 0.0, 0).model.decode(np.fromiter(chain.from_iterable(ids), np.int64, int(bounds[-1])), bounds)
            yield of(DECODED, doc_id=batch.column("doc_id"), text=text)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, n_pieces, ids_crc32 (ids as little-endian 32-bit integers), and whether decoding gave the text back."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, most=SLICE):
                rows = texts(piece)
                own = encoder(path, dropout, seed)
                ids, bounds = own.encode(rows, piece.column("doc_id").to_pylist())
                back = own.model.decode(ids, bounds)
                data = ids.astype("<i4")
                crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield of(CHECKED, doc_id=piece.column("doc_id"), n_chars=[len(t) for t in rows], n_pieces=np.diff(bounds), ids_crc32=crc, lossless=[a == b for a, b in zip(rows, back, strict=True)])

    return documents(docs).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean")
