"""Token-id files: shards compressed by a Re-Pair grammar, with random access.

A table of shards is the file format; Spark writes and reads it, so it can lie in any store. Documents are in ascending
doc_id order within and across shards (spread by range). A shard holds whole documents of about SHARD ids. In it the most
frequent pair of neighbouring symbols is replaced by a new nonterminal, again and again, until no pair occurs MIN_COUNT
times. Where the nonterminals of two bytes run out before that, it is also done with four, and what has fewer bytes is kept. Each round over the shard replaces all pairs down to 1 / SPREAD of the
highest count; where two overlap the more frequent one goes first, so the result is that of one after the other. No rule
spans two documents. Stored are the rules, the length that each expands to, each document's place among the symbols and
its number of ids: a document, or a range of its ids, is decoded from its own symbols alone.

Payload, little-endian: magic "RPG1"; u32 documents, symbols, rules, first nonterminal; u8 bytes a symbol (2 or 4), 3 bytes of zero;
per document i64 doc_id, u8 known (0: doc_id is null), u64 ids, u64 place of its first symbol; per rule u32 left, u32 right, u64 length of expansion;
the symbols. The end token is not stored: readers give it back.

Defined cases. Null and empty texts are the end token alone. Rows with the same doc_id are all kept, in the order of a
hash of their texts; null doc_ids come first. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, of, partitions, stored, text_slices, texts
from .tokens import default_path, encoder

END = 0
SHARD = 1 << 20
MIN_COUNT = (9, 5)  # fewer replacements, at 2 and 4 bytes a symbol, save no more than the 16 bytes of their rule
SPREAD = 4
SLOT_BITS = 16
STRETCH = 1 << 15
NO_PAIR = np.uint32(0xFFFFFFFF)
MAGIC = b"RPG1"
DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_ids", "<u8"), ("place", "<u8")])
RULES = np.dtype([("left", "<u4"), ("right", "<u4"), ("length", "<u8")])
SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
READ = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("position", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _apart(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places of pairs, in order, those to replace, and their ranks: the best rank first, without overlaps."""
    places, ranks = at, rank
    chosen, left = np.zeros(len(at), bool), np.arange(len(at))
    while len(at):
        near, better = at[1:] - at[:-1] == 1, rank[1:] < rank[:-1]
        win = np.ones(len(at), bool)
        win[1:] &= ~near | better
        win[:-1] &= ~(near & better)
        chosen[left[win]] = True
        keep = ~win
        keep[1:] &= ~(near & win[:-1])
        keep[:-1] &= ~(near & win[1:])
        at, rank, left = at[keep], rank[keep], left[keep]
    return places[chosen], ranks[chosen]


def _every_other(at: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """Which places to keep, so that in a stretch of one symbol every other pair is replaced, from its left. twin: where both symbols are one."""
    keep, own = np.ones(len(at), bool), np.flatnonzero(twin)
    runs = at[own]
    begin = runs[np.maximum.accumulate(np.where(np.diff(runs, prepend=-2) != 1, np.arange(len(runs)), 0))]
    keep[own] = (runs - begin) % 2 == 0
    return keep


def _one_at_a_time(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs to take in one round: a pair of one symbol shares it with no other pair of that symbol."""
    take, seen, alone = np.ones(len(left), bool), set(), set()
    twins = np.unique(left[left == right])
    for i in np.flatnonzero(np.isin(left, twins) | np.isin(right, twins)).tolist() if len(twins) else []:
        own = {int(left[i]), int(right[i])}
        take[i] = not own & (seen if len(own) == 1 else alone)
        if take[i] and len(own) == 1:
            alone |= own
        seen |= own
    return take


def compress(symbols: np.ndarray, first: int, least: int | None = None, rounds: int | None = None, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after replacement, and the rules as rows (left, right); NO_PAIR in symbols parts what no rule may span.

    Counts are kept from round to round: a pair of older symbols only loses occurrences, and pairs of a new nonterminal all
    come up in its own round, so a pair found below least is never needed again. A pair that keeps fewer than least
    occurrences beside the better ones of its round waits for the next. Symbols are of two bytes, or of four where they must be or wide says so.
    """
    wide |= first >= 1 << 16
    least = least or MIN_COUNT[wide]
    limit = len(symbols) // 2 if wide else (1 << 16) - 1 - first
    limit = max(limit, (1 << 16) - first) if wide else limit  # so that marks don't fit in two bytes
    mark = first + limit
    symbol, half, code = (np.uint16, 16, np.uint32) if mark < 1 << 16 else (np.uint32, 32, np.uint64)
    row = np.where(symbols == NO_PAIR, np.uint32(mark), symbols).astype(symbol)

    def coded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(code)
        keys <<= code(half)
        keys |= right
        return keys

    def counted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs at these places that no mark parts, and how often each is there."""
        at = at[(at >= 0) & (at < len(row) - 1)]
        left, right = row[at], row[at + 1]
        inside = (left != mark) & (right != mark)
        return np.unique(coded(left[inside], right[inside]), return_counts=True)

    def slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * factor) >> code(2 * half - SLOT_BITS)).astype(np.intp)

    factor = code(0x9E3779B1 if half == 16 else 0x9E3779B97F4A7C15)
    filled, first_of = np.zeros(1 << SLOT_BITS, bool), np.zeros(1 << SLOT_BITS, np.int64)  # by slot: if a pair of this round is in it, and the first
    table, count = counted(np.arange(len(row) - 1))
    rules: list[np.ndarray] = []
    total = 0
    while total < limit and (rounds is None or len(rules) < rounds):
        live = count >= least
        table, count = table[live], count[live]
        if not len(table):
            break
        high = np.flatnonzero(count >= max(least, count.max() // SPREAD))
        order = high[np.argsort(-count[high], kind="stable")]
        order = order[_one_at_a_time(table[order] >> code(half), table[order] & code((1 << half) - 1))][: limit - total]
        left, right = table[order] >> code(half), table[order] & code((1 << half) - 1)
        by = np.argsort(table[order])
        wanted = table[order][by]
        taken = slots(wanted)
        filled[taken], first_of[taken[::-1]] = True, np.arange(len(wanted))[::-1]
        some = []
        for a in range(0, len(row) - 1, STRETCH):  # so that what is in between stays in the processor's cache
            keys = coded(row[a : min(a + STRETCH, len(row) - 1)], row[a + 1 : a + 1 + STRETCH])
            places = slots(keys)
            hit = np.flatnonzero(filled.take(places))
            some.append((hit + a, keys[hit], first_of[places[hit]]))
        filled[taken] = False
        at, keys, where = (np.concatenate(x) for x in zip(*some, strict=True))
        found = wanted[where] == keys
        others = np.flatnonzero(~found)  # not wanted, or behind another pair of the slot
        where[others] = np.minimum(np.searchsorted(wanted, keys[others]), len(wanted) - 1)
        found[others] = wanted[where[others]] == keys[others]
        at, rank = at[found], by[where[found]]
        keep = _every_other(at, (left == right)[rank])
        at, rank = at[keep], rank[keep]
        good = np.bincount(rank, minlength=len(order)) >= least
        count[order[~good]] = 0  # pairs of one symbol that overlap themselves
        while good.any():
            keep = good[rank]
            at, rank = at[keep], rank[keep]
            chosen, own = _apart(at, rank)
            few = good & (np.bincount(own, minlength=len(order)) < least)
            if not few.any():
                break
            good &= ~few
        if not good.any():
            continue
        touched = np.stack([chosen - 1, chosen, chosen + 1], 1)
        apart = np.ones(touched.shape, bool)
        apart[1:, 0] = touched[1:, 0] != touched[:-1, 2]  # else the pair between two chosen ones, once
        lost, times = counted(touched[apart])
        where = np.minimum(np.searchsorted(table, lost), len(table) - 1)
        found = table[where] == lost
        count[where[found]] -= times[found]
        row[chosen] = (first + total + (np.cumsum(good) - 1)[own]).astype(symbol)
        keep = np.ones(len(row), bool)
        keep[chosen + 1] = False
        row = row[keep]
        placed = chosen - np.arange(len(chosen))
        touched = np.stack([placed - 1, placed], 1)
        apart = np.ones(touched.shape, bool)
        apart[1:, 0] = touched[1:, 0] != touched[:-1, 1]
        new, times = counted(touched[apart])
        table, count = np.r_[table, new[times >= least]], np.r_[count, times[times >= least]]
        by = np.argsort(table, kind="stable")  # two ascending stretches
        table, count = table[by], count[by]
        rules.append(np.stack([left[good], right[good]], 1).astype(np.int64))
        total += int(good.sum())
    return np.where(row == mark, NO_PAIR, row.astype(np.uint32)), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for. A rule refers to terminals and earlier rules only."""
    size = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):  # as many at once as refer to rules that are done
        rest = rules[done:]
        ready = (rest < first + done).all(1)
        n = len(rest) if ready.all() else int(np.argmin(ready))
        part = rest[:n]
        known = np.r_[size, 1]
        size[done : done + n] = np.where(part >= first, known[np.where(part >= first, part - first, -1)], 1).sum(1)
        done += n
    return size


def write_shard(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """The payload of documents whose ids, without end tokens, are ids[bounds[i]:bounds[i + 1]]."""
    n = len(doc_ids)
    first = int(ids.max()) + 1 if len(ids) else 1
    row = np.full(len(ids) + n, NO_PAIR, np.uint32)  # a mark after each document
    row[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    symbols, rules = compress(row, first)
    if first + len(rules) == (1 << 16) - 1:  # two bytes are used up, so four may give fewer bytes in all
        others = compress(row, first, wide=True)
        if 4 * len(others[0]) + RULES.itemsize * len(others[1]) < 2 * len(symbols) + RULES.itemsize * len(rules):
            symbols, rules = others
    marks = np.flatnonzero(symbols == NO_PAIR)
    docs = np.zeros(n, DOCS)
    docs["doc_id"], docs["known"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids]
    docs["n_ids"], docs["place"] = np.diff(bounds), np.r_[0, marks[:-1] - np.arange(n - 1)] if n else []
    table = np.zeros(len(rules), RULES)
    if len(rules):
        table["left"], table["right"], table["length"] = rules[:, 0], rules[:, 1], expansions(rules, first)
    symbols = symbols[symbols != NO_PAIR]
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = struct.pack("<4s4IB3x", MAGIC, n, len(symbols), len(rules), first, width)
    return head + docs.tobytes() + table.tobytes() + symbols.astype(f"<u{width}").tobytes()


class Shard:
    """A payload, opened."""

    def __init__(self, payload: bytes):
        magic, n, n_symbols, n_rules, self.first, width = struct.unpack_from("<4s4IB3x", payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<4s4IB3x")
        self.docs = np.frombuffer(payload, DOCS, n, at)
        self.rules = np.frombuffer(payload, RULES, n_rules, at := at + n * DOCS.itemsize)
        self.symbols = np.frombuffer(payload, f"<u{width}", n_symbols, at + n_rules * RULES.itemsize)
        self.places = np.r_[self.docs["place"].astype(np.int64), n_symbols]
        self.lengths = np.r_[np.ones(self.first, np.int64), self.rules["length"].astype(np.int64)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        row = symbols.astype(np.int64)
        left, right = self.rules["left"].astype(np.int64), self.rules["right"].astype(np.int64)
        while len(row) and (open_ := row >= self.first).any():
            at = np.cumsum(1 + open_) - 1 - open_
            out = np.empty(int(at[-1]) + 1 + int(open_[-1]), np.int64)
            out[at] = row
            rule = row[open_] - self.first
            out[at[open_]], out[at[open_] + 1] = left[rule], right[rule]
            row = out
        return row.astype(np.uint32)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, without end tokens, and their bounds. Each rule is expanded once and copied to where it stands."""
        known = np.r_[np.arange(self.first, dtype=np.uint32), self._expand(self.first + np.arange(len(self.rules)))]
        begin = np.cumsum(self.lengths) - self.lengths
        sizes = self.lengths[self.symbols]
        ends = np.cumsum(sizes)
        ids = known[np.repeat(begin[self.symbols] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.r_[0, np.cumsum(self.docs["n_ids"].astype(np.int64))]

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.places[i] : self.places[i + 1]])

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document i, from the symbols that cover them."""
        own = self.symbols[self.places[i] : self.places[i + 1]]
        ends = np.cumsum(self.lengths[own])
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._expand(own[a:b])[start - skipped : stop - skipped]


def shards(docs: DataFrame, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """Shards in doc_id order: part and shard number them."""
    path = path or default_path()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal held, size, number
            doc_ids = [d for ds, _, _ in held for d in ds]
            sizes = np.concatenate([np.diff(b) for _, _, b in held])
            bounds = np.r_[0, np.cumsum(sizes)]
            ids = np.concatenate([i for _, i, _ in held])
            out = of(SHARDS, part=[part], shard=[number], n_docs=[len(doc_ids)], n_ids=[int(bounds[-1]) + len(doc_ids)], payload=[write_shard(doc_ids, ids, bounds)])
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            for rows in text_slices(batch):
                doc_ids = rows.column("doc_id").to_pylist()
                ids, bounds = encoder(path).encode(texts(rows))
                begin = 0
                while begin < len(doc_ids):  # as many documents as fill the shard
                    stop = int(np.searchsorted(bounds, bounds[begin] + max(1, shard - size), side="left"))
                    stop = min(max(stop, begin + 1), len(doc_ids))
                    held.append((doc_ids[begin:stop], ids[bounds[begin] : bounds[stop]], bounds[begin : stop + 1] - bounds[begin]))
                    size += int(bounds[stop] - bounds[begin])
                    begin = stop
                    if size >= shard:
                        yield flush()
        if held:
            yield flush()

    kept = documents(docs).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    # by a hash too, so an id that holds many rows is spread over several ranges
    ordered = kept.repartitionByRange(partitions(docs), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    return ordered.mapInArrow(run, "part int, shard int, n_docs long, n_ids long, payload binary")


def write(docs: DataFrame, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """The shards, written to the shared folder and opened again."""
    return stored(shards(docs, path, shard), "tokens", "uncompressed")


def read(written: DataFrame, end: int = END) -> DataFrame:
    """Per document, from its shard: where it begins among the part's ids, its ids with the end token, and their crc32."""

    def run(batches):
        for batch in batches:
            for part, number, payload in zip(*(batch.column(c) for c in ("part", "shard", "payload")), strict=True):
                opened = Shard(payload.as_buffer().to_pybytes())
                ids, bounds = opened.all()
                tail = np.array([end], "<u4").tobytes()
                crc = [zlib.crc32(tail, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(opened.docs)
                yield of(
                    READ,
                    part=[part.as_py()] * n,
                    shard=[number.as_py()] * n,
                    position=np.arange(n),
                    doc_id=pa.array(opened.docs["doc_id"], mask=opened.docs["known"] == 0),
                    within=bounds[:-1] + np.arange(n),
                    n_tokens=np.diff(bounds) + 1,
                    ids_crc32=crc,
                )

    return written.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, position long, doc_id long, within long, n_tokens long, ids_crc32 long")


def starts(written: DataFrame) -> DataFrame:
    """Ids before each shard: within its part, and the parts before it, of which there are as many as partitions."""
    sizes = written.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("shards")).join(parts, "part").select("part", "shard", (F.col("parts") + F.col("shards")).alias("first"))


def round_trip(docs: DataFrame, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """The contract's rows, from the written files: doc_id, start, n_tokens, ids_crc32."""
    written = write(docs, path, shard)
    return read(written).join(starts(written), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
