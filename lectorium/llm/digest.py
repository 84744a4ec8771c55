"""Document fingerprints: digests of improbable features, compared by normalised bit overlap.

Every window of WINDOW bytes has a collision entropy, which is a function of how many pairs of its bytes are equal. Those
counts are tallied over all windows of all documents; the rarer a window's count in the corpus, the better its rank. In each
stretch of POPULAR neighbouring windows the best, leftmost one wins; windows that win LEAST times or more are the features.
Windows of very low entropy never are. A feature sets HASHES bits of a Bloom filter of FILTER bits; after CAPACITY features
the next filter of the chain is begun. A fingerprint is the chain in hexadecimal digits, each filter with the number of its
features before it. Two filters' likeness is the overlap of their bits beyond what chance gives, as a share of the most that
there can be; a digest's likeness to another is the mean, by features, over the shorter chain of the best in the longer.

Documents meet the next one in order of doc_id in ranges of rows, a partition each; the last document of a range is sent to
the following range too, so texts are shuffled once. An id that holds many rows, or none, is cut into ranges by a hash.

Defined cases. Null text is empty; an empty text's fingerprint is empty, its likeness to another empty one is 1, to others 0.
A text of fewer bytes than a window is one feature; one with fewer than POPULAR windows has every fourth window. Rows of the
same doc_id are in the order of a hash of their texts; a null doc_id comes before all others. A document alone is its own next one.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, of, partitions, text_slices, texts

WINDOW = 16
POPULAR = 32
LEAST = 8
MAX_PAIRS = 24
FILTER = 2048
HASHES = 5
CAPACITY = 160
SLICE = 1 << 21
ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
DEALT = pa.schema([("bucket", pa.int32()), ("carried", pa.bool_()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("text", pa.string())])
NO_ID, LAST = -(1 << 63), (1 << 63) - 1
ALL_PAIRS = WINDOW * (WINDOW - 1) // 2


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """For each window of the bytes, how many pairs of its bytes are equal."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        equal = (data[lag:] == data[:-lag]).view(np.uint8)
        ahead[:-lag] += equal
        behind[lag:] += equal
    first = data[:WINDOW]
    start = int(np.triu(first[:, None] == first[None, :], 1).sum())
    step = behind[WINDOW:].astype(np.int32) - ahead[: n - WINDOW]
    return start + np.r_[0, np.cumsum(step, dtype=np.int32)].astype(np.int32)


def tally(docs: DataFrame) -> np.ndarray:
    """Windows of all documents by their count of equal pairs."""

    def run(batches):
        total = np.zeros(ALL_PAIRS + 1, np.int64)
        for batch in batches:
            for piece in _slices(batch):
                data, bounds = _bytes(texts(piece))
                pairs = equal_pairs(data)
                total += np.bincount(pairs[_inside(bounds, len(pairs), WINDOW)], minlength=ALL_PAIRS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ALL_PAIRS + 1)), pa.array(total)], names=["pairs", "n"])

    out = np.zeros(ALL_PAIRS + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "pairs long, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect():
        out[r["pairs"]] = r["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank by count of equal pairs, rarest first; windows of very low entropy come after all others."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    rank[MAX_PAIRS + 1 :] = len(counts)
    return rank


def _slices(batch: pa.RecordBatch):
    for piece in text_slices(batch):
        step = max(1, int(piece.num_rows * SLICE / max(SLICE, piece.nbytes)))
        for at in range(0, piece.num_rows, step):
            yield piece.slice(at, step)


def _bytes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [t.encode("utf-8", "surrogatepass") for t in rows]
    return np.frombuffer(b"".join(coded), np.uint8), np.r_[0, np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))]


def _inside(bounds: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether what begins at each of n places, width long, ends within the same text."""
    change = np.zeros(n + 1, np.int32)
    ends = np.maximum(bounds[1:] - width + 1, bounds[:-1])
    np.add.at(change, np.minimum(bounds[:-1], n), 1)
    np.add.at(change, np.minimum(ends, n), -1)
    return np.cumsum(change[:n]) > 0


def _selected(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the features of all texts."""
    pairs = equal_pairs(data)
    n = len(pairs)
    if not n:
        return np.zeros(0, np.int64)
    rank = rank[pairs]
    low = rank == ALL_PAIRS + 1
    key = rank << 32 | np.arange(n)
    span, best = 1, key
    while span < POPULAR and len(best) > span:
        best, span = np.minimum(best[:-span], best[span:]), span * 2
    chosen = np.zeros(n, bool)
    if span == POPULAR:
        stretch = _inside(bounds, len(best), WINDOW + POPULAR - 1)
        wins = np.bincount(best[stretch] & 0xFFFFFFFF, minlength=n)
        chosen = (wins >= LEAST) & ~low
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if WINDOW <= b - a < WINDOW + POPULAR - 1:
            chosen[a : b - WINDOW + 1 : 4] = True
    return np.flatnonzero(chosen)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digest:
    """A chain of filters: bits as rows of bytes, and the features in each."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.features = np.array([min(CAPACITY, n - a) for a in range(0, n, CAPACITY)], np.int64)
        bits = np.zeros((len(self.features), FILTER), bool)
        chain = np.arange(n) // CAPACITY
        for i in range(HASHES):
            bits[chain, (hashes >> np.uint64(11 * i)).astype(np.int64) % FILTER] = True
        self.bits = np.packbits(bits, axis=1)
        self.ones = bits.sum(1)

    def text(self) -> str:
        return "".join(f"{n:02x}{row.tobytes().hex()}" for n, row in zip(self.features, self.bits, strict=True))

    def likeness(self, other: Digest) -> float:
        if not len(self.features) or not len(other.features):
            return float(len(self.features) == len(other.features))
        a, b = (self, other) if (len(self.features), self.features.sum()) <= (len(other.features), other.features.sum()) else (other, self)
        total = 0.0
        for bits, ones, n in zip(a.bits, a.ones, a.features, strict=True):
            both = np.bitwise_count(bits[None, :] & b.bits).sum(1).astype(np.float64)
            chance, most = ones * b.ones / FILTER, np.minimum(ones, b.ones)
            total += n * float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        return total / float(a.features.sum())


def digests(rows: list[str], rank: np.ndarray) -> list[Digest]:
    data, bounds = _bytes(rows)
    at = _selected(data, bounds, rank)
    if len(at):
        words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
        hashes = _mixed(words[at] * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(words[at + 8]))
    else:
        hashes = np.zeros(0, np.uint64)
    cut = np.searchsorted(at, bounds)
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        own = hashes[a:b]
        if a == b and bounds[i + 1] > bounds[i]:  # too short, or of low entropy throughout: the text is its one feature
            own = _mixed(np.array([xxhash.xxh64_intdigest(data[bounds[i] : bounds[i + 1]].tobytes())], np.uint64))
        out.append(Digest(own))
    return out


def ranges(ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of about n ranges of (doc_id, hash), as two columns: the last pair of each range but the final one. An id that fills several ranges is cut by hash."""
    total, lacking = ids.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).collect()[0]
    parts = [i / n for i in range(1, n)]
    found = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", parts, 0.1 / n) if n > 1 and total > lacking else []
    values, times = np.unique(np.array(found, np.int64), return_counts=True)
    nulls = int(n * lacking / total) if total else 0
    bounds = [(NO_ID, _cut(i, nulls + 1)) for i in range(1, nulls + 1)] + [(NO_ID, LAST)] * (nulls > 0)
    for value, many in zip(values.tolist(), times.tolist(), strict=True):
        bounds += [(max(value - 1, NO_ID), LAST)] * (many > 1) + [(value, _cut(i, many)) for i in range(1, many)] + [(value, LAST)]
    pairs = sorted(set(bounds))
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _cut(i: int, many: int) -> int:
    """The i-th of the hashes that cut all of them into so many equal parts."""
    return -(1 << 63) + (i << 64) // many


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, carried, doc_id, text: ranges of doc_id in order, each led by the last document of the one before (carried)."""
    kept = documents(docs).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = partitions(docs)
    bound_ids, bound_hashes = ranges(kept.select("doc_id"), n)
    names = np.unique(bound_ids)

    def bucket_of(ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        known = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        bucket = np.searchsorted(bound_ids, known, side="left")  # of the first bound of that id or a later one
        for i in np.flatnonzero(np.isin(known, names)) if len(known) else ():
            a, b = np.searchsorted(bound_ids, known[i], side="left"), np.searchsorted(bound_ids, known[i], side="right")
            bucket[i] = a + np.searchsorted(bound_hashes[a:b], hashes[i], side="left")
        return bucket.astype(np.int32)

    def last(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("hash")
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(ids, hashes.to_numpy())), ids, hashes], names=["bucket", "doc_id", "hash"])

    # null is less than any number here too
    found = kept.select("doc_id", "hash").mapInArrow(last, "bucket int, doc_id long, hash long").groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("last")).collect()
    ends = {r["bucket"]: tuple(r["last"]) for r in found}
    order = sorted(ends)
    following = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    def deal(batches):
        for batch in batches:
            for piece in text_slices(batch):
                ids, text, hashes = piece.column("doc_id"), piece.column("text"), piece.column("hash").to_numpy()
                bucket = bucket_of(ids, hashes)
                yield of(DEALT, bucket=bucket, carried=np.zeros(len(bucket), bool), doc_id=ids, hash=hashes, text=text)
                ending = [i for i, (b, *pair) in enumerate(zip(bucket.tolist(), ids.to_pylist(), hashes.tolist(), strict=True)) if tuple(pair) == ends[b]]
                if ending:
                    at = pa.array(ending)
                    yield of(DEALT, bucket=[following[int(bucket[i])] for i in ending], carried=np.ones(len(ending), bool), doc_id=ids.take(at), hash=hashes[ending], text=text.take(at))

    dealt = kept.mapInArrow(deal, "bucket int, carried boolean, doc_id long, hash long, text string")
    return dealt.repartitionById(max(n, len(bound_ids) + 1), F.col("bucket")).sortWithinPartitions("bucket", F.desc("carried"), "doc_id", "hash", "text")


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rank = ranks(tally(docs))

    def run(batches):
        bucket, before, before_digest = None, "", None
        for batch in batches:
            for piece in _slices(batch):
                rows, carried = texts(piece), piece.column("carried").to_pylist()
                own = digests(rows, rank)
                nexts, next_digests = [], []
                for b, t, d in zip(piece.column("bucket").to_pylist(), rows, own, strict=True):
                    if b != bucket:
                        bucket, before, before_digest = b, t, d
                    nexts.append(before)
                    next_digests.append(before_digest)
                    before, before_digest = t, d
                keep = [i for i, c in enumerate(carried) if not c]
                changed = [edited(rows[i], nexts[i]) for i in keep]
                other = digests(changed, rank)
                yield of(
                    ROWS,
                    doc_id=piece.column("doc_id").take(pa.array(keep, pa.int64())),
                    n_chars=[len(rows[i]) for i in keep],
                    edited_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                    fingerprint=[own[i].text() for i in keep],
                    edited_fingerprint=[d.text() for d in other],
                    near_edited=[own[i].likeness(d) for i, d in zip(keep, other, strict=True)],
                    near_next=[own[i].likeness(next_digests[i]) for i in keep],
                )

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
