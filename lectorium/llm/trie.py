"""Prefix trie of conversations: a node for each different sequence of first turns, with counts over its subtree.

Turns are shuffled as digests of their role and text. Each conversation's digests are chained, link by link in a stream, so
that equal prefixes, and only these, have equal digests; every prefix is a row, and the rows of a (depth, digest) are a node.
A node's smallest member has all of the node's ancestors among its own prefixes, so the node is exploded to its ancestors
along that conversation; what a conversation's nodes give to one ancestor is summed first, by a running sum from the deepest
prefix up, and a row for each prefix is left, not one for each node and ancestor. The numbers of conversations that
end in a node are written in stretches of STRETCH numbers each, and a digest runs over a node's stretches in order, so no
group is held in memory, the root and groups of copies included.

Defined cases. conv_id - conv_id % 5 takes the remainder's sign from conv_id. A null role or text is empty; a null turn comes
first; rows of one turn are in the order of their digests, and repeated rows are turns of their own. Rows with a null conv_id
are in no conversation. A conversation without any turn is in the root alone. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import of, partitions, stored

GROUP = 5
HEADS = 9
STRETCH = 1 << 12
ROWS = 1 << 14
PREFIX = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("above", pa.binary()), ("bytes", pa.int64()), ("ends", pa.bool_())])
ENDS = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])
ROOT = hashlib.sha256(b"").digest()


def turns(rows: DataFrame) -> DataFrame:
    """conv, place (from 1), digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    own = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return own.select("conv", F.row_number().over(order).cast("long").alias("place"), "digest", "bytes")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv, place, digest, bytes: turns for conv in order of place; place 0 says that conv is a conversation and isn't a turn.

    Each turn goes to its own conversation where that keeps it, and one of the first turns also to those that may begin with it.
    """
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    here = own.withColumn("h", head)
    # its own: behind the head, or the head of one that begins its group; of the first turn also the mark
    kept = F.when((F.col("place") > F.col("h")) | (F.col("conv") % GROUP == 0), F.array(F.col("place"))).otherwise(F.array().cast("array<long>"))
    marks = F.when(F.col("place") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    mine = here.select("conv", F.explode(F.concat(marks, kept)).alias("to"), "digest", "bytes").withColumnRenamed("to", "place")
    # conversations c with c - c % GROUP == conv: on both sides of 0 for that one, else away from it
    others = F.expr(f"IF(conv = 0, sequence(-{GROUP - 1}L, {GROUP - 1}L), IF(conv > 0, sequence(conv + 1, conv + {GROUP - 1}), sequence(conv - {GROUP - 1}, conv - 1)))")
    first = here.where((F.col("conv") % GROUP == 0) & (F.col("place") < HEADS)).select(F.explode(others).alias("conv"), "place", "digest", "bytes")
    return mine.unionByName(first.where((F.col("place") <= head) & (F.col("conv") % GROUP != 0)))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, digest, above (the digest one turn before), bytes of the last text, ends: every prefix of every rebuilt conversation, from depth 0."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [], None  # last: conv, depth, digest, above, bytes of the newest prefix, not yet written as it may be an end
        known = None
        for batch in batches:
            for conv, place, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "digest", "bytes")), strict=True):
                if place == 0:
                    if last:
                        out.append((*last, True))
                    known, last = conv, (conv, 0, ROOT, None, 0)
                elif conv == known:
                    out.append((*last, False))
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + digest).digest(), last[2], size)
                if len(out) >= ROWS:
                    yield of(PREFIX, **dict(zip(PREFIX.names, zip(*out, strict=True), strict=True)))
                    out = []
        if last:
            out.append((*last, True))
        if out:
            yield of(PREFIX, **dict(zip(PREFIX.names, zip(*out, strict=True), strict=True)))

    dealt = rebuilt(turns(rows)).repartition(partitions(rows), "conv").sortWithinPartitions("conv", "place")
    return dealt.mapInArrow(chain, "conv long, depth long, digest binary, above binary, bytes long, ends boolean")


def ends(prefix: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256: of nodes where conversations end, the digest of their numbers, ascending and comma-joined."""
    at = F.shiftright("conv", STRETCH.bit_length() - 1)
    some = prefix.where("ends").select("depth", "digest", "conv", at.alias("at"))
    joined = some.groupBy("depth", "digest", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("numbers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for depth, node, numbers in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "numbers")), strict=True):
                if (depth, node) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (depth, node), hashlib.sha256(numbers.encode())
                else:
                    digest.update(b"," + numbers.encode())
                if len(out) >= ROWS:
                    yield of(ENDS, **dict(zip(ENDS.names, zip(*out, strict=True), strict=True)))
                    out = []
        if key:
            out.append((*key, digest.hexdigest()))
        if out:
            yield of(ENDS, **dict(zip(ENDS.names, zip(*out, strict=True), strict=True)))

    dealt = joined.repartition(partitions(prefix), "depth", "digest").sortWithinPartitions("depth", "digest", "at")
    return dealt.mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """The contract's rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    prefix = stored(prefixes(rows), "prefixes")
    plain = prefix.groupBy("depth", "digest").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("above").alias("above"))
    plain = stored(plain, "nodes")
    children = plain.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    named = plain.join(children, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    named = stored(named.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "named")

    # the nodes whose smallest member a prefix's conversation is: from some depth on all of its prefixes
    own = prefix.select("conv", "depth", "digest").join(named.select("conv", "depth", "saved", "leaf"), ["conv", "depth"], "left")
    upward = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = own.select("depth", "digest", *(F.coalesce(F.sum(c).over(upward), F.lit(0)).alias(c) for c in ("saved", "leaf")))
    sums = given.groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    # a parent's smallest member: for a conversation's first node of its own, that of the prefix above
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("above"), F.col("conv").alias("parent_conv_id"))
    full = named.join(sums, ["depth", "digest"]).join(parents, ["depth", "above"], "left").join(ends(prefix), ["depth", "digest"], "left")
    return full.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT c FROM t),
h AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h FROM k),
r AS (SELECT h.c, 0 AS own, t.place, t.x, t.bytes FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.place <= h.h
    UNION ALL SELECT h.c, 1, t.place, t.x, t.bytes FROM h JOIN t ON t.c = h.c AND t.place > h.h),
s AS (SELECT c, row_number() OVER w AS d, bytes, string_agg(x, ',') OVER w AS p FROM r WINDOW w AS (PARTITION BY c ORDER BY own, place)),
p AS (SELECT c, d, bytes, sha256(p) AS p FROM s UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
n AS (SELECT d, p, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY d, p),
a AS (SELECT n.*, b.p AS above FROM n LEFT JOIN p b ON b.c = n.c AND b.d = n.d - 1),
m AS (SELECT d - 1 AS d, above AS p, count(*) AS n_children FROM a WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN m USING (d, p)),
u AS (SELECT q.d, q.p, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n - 1) * v.bytes) AS saved FROM v JOIN p q ON q.c = v.c AND q.d <= v.d GROUP BY q.d, q.p),
e AS (SELECT p.d, p.p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM p JOIN l USING (c, d) GROUP BY p.d, p.p)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, b.c AS parent_conv_id, v.n::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM v JOIN u USING (d, p) LEFT JOIN e USING (d, p) LEFT JOIN n b ON b.d = v.d - 1 AND b.p = v.above
"""
