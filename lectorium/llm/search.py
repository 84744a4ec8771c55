"""Ranked lexical search: the best documents of each item of a query set, by a threshold-seeded join.

Documents are indexed once: a row for each, with its length and the occurrences of those terms that some item may have (a
bitmap of fixed size tells which; a false hit costs a row and nothing else). For each term the MOST largest impacts and
their documents are kept. Sums over the lists of an item's terms name documents to seed its threshold with, and their exact
scores bound its last place from below: no less than the largest MOSTth impact of its terms, as the documents of that term's
list are among those to choose from. With an item's terms in the order of their largest impacts, a term is left out where
the bounds of itself and all behind it add up to less than the threshold: a document with none of the terms before can't
reach a place. The other terms' documents are candidates; those whose sum, with the bounds of the terms left out, can still
reach the threshold are scored again over all terms. Nothing is estimated, so the result is that of scoring every document.

Items are joined in blocks of BROADCAST bytes of terms: a block travels with the tasks, which add up the parts of their own
documents and pass on the pairs that reach their item's threshold and no others, so neither a term that many documents have
nor one that many items have meets in one place.

Defined cases. A null or empty text has no terms; such a document is in no result and counts nowhere, such an item has no
rows. Each row of either table is a document or an item of its own, though ids repeat or are null; of equal scores null ids
come last. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slice, discard, of, stored, texts

MOST = 50
BITS = 1 << 24
BROADCAST = 16 << 20
CELLS = 1 << 21
SIZE = "octet_length(term) + 64"  # bytes of a row of an item's terms
BITMAP = 1 << 15  # positions in a bitmap of bitmap_construct_agg
SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in SEPARATORS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
FOUND = pa.schema([(c, pa.int64()) for c in ("item_id", "item", "doc_id", "row", "score")])
ITEM = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.string())), ("places", pa.list_(pa.int64()))])


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: runs of letters and digits, and of all that isn't ASCII; only A-Z is lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def place(term: bytes) -> int:
    """A term's position in the bitmap."""
    return xxhash.xxh3_64_intdigest(term) % BITS


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for v in values for x in v], kind))


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, term, place: each term of an item once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(dict.fromkeys(terms_of(t))) for t in texts(batch)]
        named = [[t.decode("utf-8", "replace") for t in f] for f in found]
        return of(ITEM, item_id=batch.column("item_id"), terms=_lists(named, pa.string()), places=_lists([[place(t) for t in f] for f in found], pa.int64()))

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(by_slice(run), "item_id long, terms array<string>, places array<long>")
    one = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("places").alias("place")))
    return found.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", one)


def bitmap_of(vocabulary: DataFrame) -> bytes:
    """BITS bits, set at the places of the vocabulary; at most BITS / BITMAP rows come to the driver, whatever its size."""
    parts = vocabulary.groupBy(F.expr(f"place div {BITMAP}").alias("at")).agg(F.expr(f"bitmap_construct_agg(place % {BITMAP})").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for row in parts:
        out[row["at"] * (BITMAP // 8) : (row["at"] + 1) * (BITMAP // 8)] = row["bits"]
    return bytes(out)


def indexed(docs: DataFrame, bits: bytes) -> DataFrame:
    """row (a number for each row), doc_id, n and the counted terms that the bitmap has, of every document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, ns, names, counts = held.value, [], [], []
        for text in texts(batch):
            words = terms_of(text)
            own = []
            for term, tf in Counter(words).items():
                at = place(term)
                if bits[at >> 3] >> (at & 7) & 1:
                    own.append((term.decode("utf-8", "replace"), tf))
            ns.append(len(words))
            names.append([t for t, _ in own])
            counts.append([n for _, n in own])
        return of(INDEX, doc_id=batch.column("doc_id"), n=ns, terms=_lists(names, pa.string()), tfs=_lists(counts, pa.int64()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(by_slice(run), "doc_id long, n long, terms array<string>, tfs array<long>").where("n > 0")
    return found.withColumn("row", F.monotonically_increasing_id())


def postings(index: DataFrame, *also: str) -> DataFrame:
    """row, term, g (a term's part of the score but for its weight) for each term of a document."""
    one = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
    g = F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    return index.select("row", *also, "m", one).select("row", *also, "term", g.alias("g"))


def best(scored: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key with their rank; each task passes on no more than so many of a key."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def scored(pairs: DataFrame, index: DataFrame, weights: DataFrame) -> DataFrame:
    """item, row, score over all terms, of pairs (item, row)."""
    each = postings(index.join(pairs, "row"), "item").join(weights.select("item", "term", "w"), ["item", "term"])
    return each.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("g")).alias("score"))


def light(df: DataFrame, size: Column) -> DataFrame:
    """df to be broadcast where its size, summed, is below BROADCAST; else to be joined by key."""
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if held <= BROADCAST else df


def cut(bounds: DataFrame, least: DataFrame) -> DataFrame:
    """bounds with least (an item's threshold), leading (whether a term is needed to find candidates) and rest, the sum of the bounds of an item's other terms."""
    behind = Window.partitionBy("item").orderBy(F.desc("bound"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = bounds.join(least, "item").withColumn("behind", F.sum("bound").over(behind)).withColumn("leading", F.col("behind") >= F.col("least"))
    rest = F.coalesce(F.max(F.when(~F.col("leading"), F.col("behind"))).over(Window.partitionBy("item")), F.lit(0))
    return out.withColumn("rest", rest).select("item", "item_id", "term", "w", "least", "leading", "rest")


class _Weights:
    """Items and weights by term; sums() adds up the weighted parts of documents' terms, exact as all sums are below 2 ** 53."""

    def __init__(self, term: np.ndarray, item: np.ndarray, w: np.ndarray, n_terms: int, n_items: int):
        order = np.argsort(term, kind="stable")
        self.item, self.w, self.n_items = item[order], w[order], n_items
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def sums(self, doc: np.ndarray, term: np.ndarray, g: np.ndarray, n_docs: int) -> np.ndarray:
        out = np.zeros(n_docs * self.n_items)
        ends = np.cumsum(self.first[term + 1] - self.first[term])
        a = 0
        while a < len(term):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
            times = np.diff(np.r_[done, ends[a:b]])
            at = np.repeat(self.first[term[a:b]] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            out += np.bincount(np.repeat(doc[a:b], times) * self.n_items + self.item[at], np.repeat(g[a:b], times) * self.w[at], len(out))
            a = b
        return out.reshape(n_docs, self.n_items)


def joined(index: DataFrame, terms: pa.Table) -> DataFrame:
    """item_id, item, doc_id, row, score of all pairs that reach their item's threshold, for a block of items (rows of cut())."""
    items, item = np.unique(terms.column("item").to_numpy(), return_inverse=True)
    names = pc.unique(terms.column("term").combine_chunks())
    term, w, leading = pc.index_in(terms.column("term").combine_chunks(), names).to_numpy(), terms.column("w").to_numpy(), terms.column("leading").to_numpy(zero_copy_only=False)
    of_item = np.unique(item, return_index=True)[1]
    ids, least, rest = (terms.column(c).combine_chunks().take(pa.array(of_item)) for c in ("item_id", "least", "rest"))
    first, others = (_Weights(term[k], item[k], w[k], len(names), len(items)) for k in (leading, ~leading))
    held = index.sparkSession.sparkContext.broadcast((names, items, ids, least.to_numpy(), rest.to_numpy(), first, others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, ids, least, rest, first, others = held.value
        step = max(1, CELLS // max(1, len(items)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                docs = batch.slice(a, step)
                sizes = pc.list_value_length(docs.column("terms")).to_numpy()
                term = pc.fill_null(pc.index_in(docs.column("terms").flatten(), names), -1).to_numpy()
                doc, tf, known = np.repeat(np.arange(len(sizes)), sizes), docs.column("tfs").flatten().to_numpy(), term >= 0
                doc, term, tf = doc[known], term[known], tf[known]
                g = 1_000_000_000 * tf // (1000 * tf + 20 * docs.column("m").to_numpy()[doc])
                sums = first.sums(doc, term, g, len(sizes))
                maybe = sums + rest >= least
                some = maybe.any(1)
                if not some.any():
                    continue
                number = np.cumsum(some) - 1
                near = some[doc]
                sums = sums[some] + others.sums(number[doc[near]], term[near], g[near], int(some.sum()))
                at, item = np.nonzero(maybe[some] & (sums >= least))
                rows = np.flatnonzero(some)[at]
                yield of(FOUND, item_id=ids.take(pa.array(item)), item=items[item], doc_id=docs.column("doc_id").take(pa.array(rows)), row=docs.column("row").to_numpy()[rows], score=sums[at, item].astype(np.int64))

    return index.select("row", "doc_id", "m", "terms", "tfs").mapInArrow(run, "item_id long, item long, doc_id long, row long, score long")


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST, block: int = BROADCAST) -> DataFrame:
    """item_id, rank, doc_id, score: the documents of the highest scores above 0 for each row of items (item_id, text)."""
    wanted = stored(item_terms(items), "items")
    plain = stored(indexed(docs, bitmap_of(wanted)), "index")
    total = plain.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
    index = plain.withColumn("m", F.expr(f"50L + ((50L * n * {total['N']}L) div {total['L']}L)"))
    terms = light(wanted.select("term").distinct(), F.expr(SIZE))
    own = postings(index).join(terms, "term", "left_semi")
    counts = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = counts.select("term", F.floor(1000 * F.log(F.lit(float(2 * total["N"] + 2)) / (2 * F.col("df") + 1))).cast("long").alias("w")).where("w > 0")
    tops = stored(best(own, "term", [F.desc("g"), F.asc("row")], most).select("term", "row", "g"), "tops")
    largest = tops.groupBy("term").agg(F.max("g").alias("largest"))
    bounds = stored(wanted.join(weights, "term").join(largest, "term").select("item", "item_id", "term", "w", (F.col("w") * F.col("largest")).alias("bound")), "bounds")

    sums = tops.join(bounds.select("item", "term", "w"), "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("g")).alias("sum"))
    seeds = stored(best(sums, "item", [F.desc("sum"), F.asc("row")], most).select("item", "row"), "seeds")
    reached = scored(light(seeds, F.lit(32)), index, light(bounds, F.expr(SIZE))).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("n") == most, F.greatest(F.col("least"), F.lit(1))).otherwise(F.lit(1))
    leading = cut(bounds, reached.select("item", least.alias("least")))
    held = bounds.agg(F.coalesce(F.sum(F.expr(SIZE)), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-held // block))
    leading = stored(leading.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "leading")
    found = [stored(best(joined(index, leading.where(F.col("block") == b).drop("block").toArrow()), "item", [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("row")], most), "found") for b in range(blocks)]
    discard(wanted, plain, tops, bounds, seeds, leading)
    return reduce(DataFrame.unionByName, found).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM s) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), g),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT r, doc_id, 50 + ((50 * n * n_docs)::BIGINT // n_terms) AS m FROM s, g),
z AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM z WHERE score > 0) WHERE rank <= 50
"""
