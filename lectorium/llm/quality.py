"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted documents (labels: quality 1, toxic 0), in two halves by a hash of the text, and a document
of either half is scored by the counts of the other: no document is judged by a model that has seen its text, trusted ones
and copies of them included. An n-gram is ORDER symbols of BITS bits in one long, and the half in the bit above, so that
contexts and suffixes are shifts and masks; characters beyond the alphabet share symbols by remainder. Counts, continuation
counts, context totals and discounts are groupings over the n-grams, sharded by their keys, and n-grams in question are
joined order by order to those counts, which gives each its probability.

Most n-grams of a text are among the most frequent ones: the probabilities of HOT at most travel with the tasks. One pass
over the texts sums those up for each document and writes the n-grams that are left over, with their counts, which are then
joined to the probabilities of their distinct ones and summed by document. Texts are read twice, once for the counts of the
trusted ones, and never shuffled; both steps start from tables in the shared folder.

A document is kept if its log-perplexity lies between two quantiles of the trusted documents of its language: of documents as
good a share of LOW falls below and 1 - HIGH above. Quantiles are read off counts on a grid of GRID; for languages without
trusted documents those of all languages hold.

Defined cases. A null or empty text has no perplexity and is not kept. Null languages are one language. Repeated rows are
judged one by one; a null doc_id stays null and is never trusted. Without trusted documents nothing is known to be bad and
all documents with a text are kept. Ties at a bound are kept. Other columns are ignored by judged(), and kept unchanged by
kept().
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, kept_one, of, stored, text_slices, texts

ORDER = 4
BITS = 15
LOW, HIGH = 0.005, 0.995
HALF = 1 << (BITS * ORDER)
GRID = 1000
PART = 1 << 19
HOT = 1 << 20
BROADCAST_IDS = 4_000_000
COUNTS = pa.schema([("k", pa.int64()), ("c", pa.int64())])
SUMMED = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("hash", pa.int64()), ("n_grams", pa.int64()), ("logp", pa.float64()), ("rest", pa.list_(pa.struct([("k", pa.int64()), ("c", pa.int64())])))]
)
SUMMED_DDL = "rid long, doc_id long, lang string, hash long, n_grams long, logp double, rest array<struct<k: long, c: long>>"


def grams(rows: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each text, padded with zeros at its start, and the texts' bounds."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    bounds = np.r_[0, np.cumsum(sizes)]
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    half = 1 << (BITS - 1)
    symbols = np.where(points < half, points, half + points % half).astype(np.int64)
    key = symbols.copy()
    for back in range(1, order):
        shifted = np.zeros_like(symbols)
        shifted[back:] = symbols[:-back]
        for i in range(back):  # the first characters of each text have no more than i before them
            at = bounds[:-1] + i
            shifted[at[sizes > i]] = 0
        key |= shifted << (BITS * back)
    return key, bounds


def in_halves(key: np.ndarray, bounds: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The n-grams with the bit of each text's half."""
    return key | np.repeat(half.astype(np.int64) * HALF, np.diff(bounds))


def trusted_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """k (with its half), c over all trusted texts; summed in each task before the shuffle."""

    def run(batches):
        held_keys, held_counts, size = [], [], 0
        for batch in batches:
            for piece in text_slices(batch, most=PART):
                keys = in_halves(*grams(texts(piece), order), piece.column("hash").to_numpy() & 1)
                values, counts = np.unique(keys, return_counts=True)
                held_keys.append(values)
                held_counts.append(counts)
                size += len(values)
                if size > 500_000:
                    yield _summed(held_keys, held_counts)
                    held_keys, held_counts, size = [], [], 0
        if held_keys:
            yield _summed(held_keys, held_counts)

    return trusted.select("text", F.xxhash64("text").alias("hash")).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    values, index = np.unique(np.concatenate(keys), return_inverse=True)
    return of(COUNTS, k=values, c=np.bincount(index, np.concatenate(counts), len(values)).astype(np.int64))


def _half(k) -> Column:
    return (k.bitwiseAND(F.lit(HALF)) != 0).cast("int")


def _tail(k, n: int) -> Column:
    """The last n symbols of an n-gram, and its half."""
    return k.bitwiseAND(F.lit(HALF | (1 << (BITS * n)) - 1))


def _context(k) -> Column:
    """An n-gram without its last symbol, and its half."""
    return F.shiftright(k.bitwiseAND(F.lit(HALF - 1)), BITS).bitwiseOR(k.bitwiseAND(F.lit(HALF)))


def _discounts(counts: DataFrame) -> list[list[float]]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts, for each half."""
    found = counts.where("c <= 4").groupBy(_half(F.col("k")).alias("half"), "c").agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for half in (0, 1):
        n = {r["c"]: r["n"] for r in found if r["half"] == half}
        n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
        if not (n1 and n2 and n3 and n4):
            out.append([0.5, 0.75, 0.9])
            continue
        y = n1 / (n1 + 2 * n2)
        out.append([min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))])
    return out


class KneserNey:
    """The counts of each order as tables, and what they come to."""

    def __init__(self, trusted: DataFrame, order: int = ORDER):
        self.order = order
        self.levels = {order: stored(trusted_counts(trusted, order), f"grams{order}")}
        for n in range(order - 1, 0, -1):  # continuation counts: how many different n-grams end so
            self.levels[n] = stored(self.levels[n + 1].select(_tail(F.col("k"), n).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")), f"grams{n}")
        self.discounts = {n: _discounts(level) for n, level in self.levels.items()}
        self.whole = {r["half"]: (float(r["t"]), float(r["g"])) for r in self.levels[1].groupBy(_half(F.col("k")).alias("half")).agg(F.sum("c").alias("t"), F.sum(self._discount(1, F.col("k"))).alias("g")).collect()}

    def _discount(self, n: int, k: Column) -> Column:
        """What is taken from an n-gram's count c."""
        of = lambda d: F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        return F.when(_half(k) == 0, of(self.discounts[n][0])).otherwise(of(self.discounts[n][1]))

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """k and logp (natural logarithm) of each n-gram in asked (k, distinct)."""
        found, p = asked.select("k"), F.lit(1.0 / (1 << BITS))
        for n in range(1, self.order + 1):
            counted = self.levels[n].select(F.col("k").alias("own"), "c")
            # one symbol: 2 ** BITS rows in either half at most
            found = found.withColumn("p", p).withColumn("own", _tail(F.col("k"), n)).join(F.broadcast(counted) if n == 1 else counted, "own", "left")
            if n == 1:
                of = lambda i: F.when(_half(F.col("k")) == 0, F.lit(self.whole.get(0, (0.0, 0.0))[i])).otherwise(F.lit(self.whole.get(1, (0.0, 0.0))[i]))
                found = found.withColumns({"t": of(0), "g": of(1)})
            else:
                contexts = self.levels[n].groupBy(_context(F.col("k")).alias("ctx")).agg(F.sum("c").alias("t"), F.sum(self._discount(n, F.col("k"))).alias("g"))
                found = found.withColumn("ctx", _context(F.col("own"))).join(contexts, "ctx", "left")
            kept = F.coalesce(F.greatest(F.col("c") - self._discount(n, F.col("k")), F.lit(0.0)), F.lit(0.0))
            found = found.select("k", F.when(F.col("t") > 0, kept / F.col("t") + F.col("g") / F.col("t") * F.col("p")).otherwise(F.col("p")).alias("p"))
            p = F.col("p")
        return found.select("k", F.log("p").alias("logp"))

    def frequent(self, most: int) -> DataFrame:
        """k of the n-grams with the greatest counts, at most so many: all from some power of the square root of 2 on."""
        level = F.floor(2 * F.log2("c"))
        n = {r["level"]: r["n"] for r in self.levels[self.order].groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
        least, seen = math.inf, 0
        for at in sorted(n, reverse=True):
            seen += n[at]
            if seen > most:
                break
            least = at
        return self.levels[self.order].where(level >= least if n and least < math.inf else F.lit(False)).select("k")


class Lookup:
    """Places of keys in a sorted array, by a hash table with a binary search for what collides."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(10, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        off = np.flatnonzero(self.keys[at] != keys)
        at[off] = np.minimum(np.searchsorted(self.keys, keys[off]), len(self.keys) - 1)
        return at


def summed(docs: DataFrame, keys: np.ndarray, logs: np.ndarray, order: int = ORDER) -> DataFrame:
    """Per row a number of its own (rid), the sum of its n-grams' logarithms as far as they are known (keys, logs), and the rest."""
    sent, name = docs.sparkSession.sparkContext.broadcast((keys, logs.astype(np.float32))), uuid.uuid4().hex

    def table():
        known, logp = sent.value
        # never empty; no n-gram is below zero
        return np.r_[known, -1], np.r_[logp, 0].astype(np.float64), Lookup(known) if len(known) else None

    def run(batches):
        known, logp, look = kept_one(("grams", name), table)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in text_slices(batch, most=PART):
                key, bounds = grams(texts(piece), order)
                key = in_halves(key, bounds, ~piece.column("hash").to_numpy() & 1)  # asks the other half
                at = look(key) if look is not None else np.full(len(key), len(known) - 1)
                left = np.flatnonzero(known[at] != key)
                found = logp[at]
                found[left] = 0.0
                sums = np.r_[0.0, np.cumsum(found)]
                row = np.searchsorted(bounds, left, side="right") - 1
                by = np.lexsort((key[left], row))
                row, rest = row[by], key[left][by]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (rest[1:] != rest[:-1])]) if len(row) else np.zeros(0, np.int64)
                many = np.diff(np.r_[first, len(row)])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row[first], np.arange(piece.num_rows + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(rest[first], pa.int64()), pa.array(many, pa.int64())], ["k", "c"]),
                )
                yield of(
                    SUMMED,
                    rid=number + np.arange(piece.num_rows),
                    doc_id=piece.column("doc_id"),
                    lang=piece.column("lang"),
                    hash=piece.column("hash"),
                    n_grams=np.diff(bounds),
                    logp=sums[bounds[1:]] - sums[bounds[:-1]],
                    rest=lists,
                )
                number += piece.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("hash", F.xxhash64("text")).mapInArrow(run, SUMMED_DDL)


def _scored(docs: DataFrame, trusted: DataFrame, order: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of scored(), and the tables that they come from."""
    model = KneserNey(trusted, order)
    common = model.probabilities(model.frequent(hot)).toArrow().sort_by("k")
    rows = stored(summed(docs, common.column("k").to_numpy(), common.column("logp").to_numpy(), order), "summed")
    rest = rows.select("rid", F.explode("rest").alias("e")).select("rid", "e.k", "e.c")
    answers = model.probabilities(rest.select("k").distinct())
    more = rest.join(answers, "k").groupBy("rid").agg(F.sum(F.col("c") * F.col("logp")).alias("more"))
    every = rows.drop("rest").join(more, "rid", "left")
    total = F.col("logp") + F.coalesce("more", F.lit(0.0))
    return every.select("doc_id", "lang", "hash", "n_grams", F.when(F.col("n_grams") > 0, F.round(-total / F.col("n_grams"), 9)).alias("log_ppl")), [rows, *model.levels.values()]


def scored(docs: DataFrame, trusted: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """doc_id, lang, hash (of the text), n_grams and log_ppl of every row."""
    return _scored(docs, trusted, order, hot)[0]


def judged(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """doc_id, lang, hash, n_grams, log_ppl, the language's bounds least and most, kept."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trusted = own.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left_semi")
    found, used = _scored(docs, trusted, order, hot)
    rows = stored(found, "scored")
    discard(*used)
    bins = rows.where("log_ppl IS NOT NULL").join(good, "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("l"), F.floor(F.col("log_ppl") * GRID).alias("bin")).groupBy("l", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit("*").alias("l"), "bin", "n"))
    up = Window.partitionBy("l").orderBy("bin")
    share = bins.select("l", "bin", (F.sum("n").over(up) / F.sum("n").over(Window.partitionBy("l"))).alias("share"))
    bounds = share.groupBy("l").agg((F.min(F.when(F.col("share") >= low, F.col("bin"))) / GRID).alias("least"), ((F.min(F.when(F.col("share") >= high, F.col("bin"))) + 1) / GRID).alias("most"))
    bounds = stored(bounds, "bounds")
    every = bounds.where("l = '*'").select(F.col("least").alias("least_all"), F.col("most").alias("most_all")).collect()
    least, most = (every[0]["least_all"], every[0]["most_all"]) if every else (-math.inf, math.inf)
    named = rows.withColumn("l", F.coalesce("lang", F.lit(""))).join(bounds.where("l <> '*'"), "l", "left").withColumns({"least": F.coalesce("least", F.lit(least)), "most": F.coalesce("most", F.lit(most))})
    return named.select("doc_id", "lang", "hash", "n_grams", "log_ppl", "least", "most", F.coalesce(F.col("log_ppl").between(F.col("least"), F.col("most")), F.lit(False)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    a, b = (f"{name}_{uuid.uuid4().hex}" for name in ("doc_id", "hash"))  # names that docs can't have
    out = judged(docs, labels).where("NOT kept").select(F.col("doc_id").alias(a), F.col("hash").alias(b)).distinct()
    return docs.join(out, F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.col("text").cast("string")) == F.col(b)), "left_anti")
