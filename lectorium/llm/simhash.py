"""SimHash near-duplicates: exact links within a Hamming radius, found in shards of a vantage-point tree.

Distinct fingerprints are dealt to the leaves of a vantage-point tree by their Hamming distance d to each vantage point:
at most the node's radius goes inside, more goes outside. By the triangle inequality two fingerprints that differ in r
bits have distances to any point that differ by r at most, so a fingerprint within r of the radius on one side is sent to
the other side too, and every linked pair meets in some leaf. The tree is fitted on a bounded sample of fingerprints
(SAMPLE); that decides only how evenly the leaves fill, never which links are found. The driver plans MAX_LEAVES leaves at
most. Where that would leave some fuller than LARGEST, their fingerprints are counted and full leaves get trees of their own,
each planned in a task on a sample of that leaf, level by level; a leaf that no cut makes smaller is dealt in blocks, and each
pair of blocks is a group. So no task has many more than LARGEST fingerprints, however many there are. Within a task a leaf
splits itself further in the same way until brute force is cheaper, and gives a spanning forest of its links instead of all
pairs. Connected
components of those forests come from alternating large-star and small-star steps over tables in the shared folder.

Defined cases. A null or empty text, or one without words, has fingerprint zero and is linked like any other. Fewer words
than a shingle: the whole sequence is one shingle. Repeated rows are kept, and get the same class. A row with a null
doc_id gets the class of the others with its fingerprint, null if there are none. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slice, discard, documents, of, partitions, stored, texts

SHINGLE = 3
RADIUS = 3
SEED = 42
LEAF, LARGEST = 1 << 16, 1 << 20
MAX_LEAVES, SUB_LEAVES = 1 << 12, 1 << 8
LEVELS = 8
SAMPLE = 40_000
CANDIDATES = 48
BRUTE = 2048
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
ROUTED = pa.schema([("leaf", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])
ROUTED_DDL = "leaf long, fp long, node long"
PLANNED = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("tree", pa.binary())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes (big-endian) have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 majority bits over a text's word shingles, repeats included, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both are ASCII only: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), ">u8", n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle, seed) for t in texts(batch)], np.uint64).view(np.int64)
        return of(PRINTS, doc_id=batch.column("doc_id"), fp=prints)

    return documents(docs).mapInArrow(by_slice(run), "doc_id long, fp long")


def _split(prints: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int, float] | None:
    """Vantage point and cut with the fewest boundary copies among balanced ones, and the share of the larger side."""
    near = rng.choice(prints, min(CANDIDATES, len(prints)), replace=False)
    some = rng.choice(prints, min(1024, len(prints)), replace=False)
    distance = np.bitwise_count(near[:, None] ^ some[None, :])
    inside = np.stack([(distance <= cut).sum(1) for cut in range(-radius, 65)], 1) / len(some)
    inside, below = inside[:, radius:], inside[:, : 65]
    copied = inside - below
    larger = np.maximum(inside, 1 - inside + copied)
    cost = np.where((inside >= 0.25) & (inside <= 0.75), larger + copied, np.inf)
    point, cut = np.unravel_index(np.argmin(cost), cost.shape)
    return (int(near[point]), int(cut), float(larger[point, cut])) if np.isfinite(cost[point, cut]) else None


def plan_tree(sample: np.ndarray, total: int, radius: int, leaf: int = LEAF, most: int = MAX_LEAVES) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, cut, inside child, outside child); a child below 0 is the leaf -1 - child. The fullest part is split first, until parts hold leaf fingerprints or there are as many as may be."""
    rng, nodes, leaves = np.random.default_rng(SEED), [], 0
    open_: list[tuple[int, int, np.ndarray, int, int]] = [(-len(sample), 0, sample, -1, 0)]  # the node above, and which of its children this is
    turn = 0
    while open_:
        size, _, prints, above, side = heapq.heappop(open_)
        full = -size / max(1, len(sample)) * total > leaf and len(prints) >= 32 and leaves + len(open_) + 1 < most
        found = _split(prints, radius, rng) if full else None
        if found is None or found[2] > 0.9:
            leaves += 1
            at = -leaves
        else:
            at, (point, cut, _) = len(nodes), found
            nodes.append([point, cut, 0, 0])
            distance = np.bitwise_count(prints ^ np.uint64(point)).astype(int)
            for side_, part in ((2, prints[distance <= cut]), (3, prints[distance > cut - radius])):
                turn += 1
                heapq.heappush(open_, (-len(part), turn, part, at, side_))
        if above >= 0:
            nodes[above][side] = at
    return [tuple(n) for n in nodes]


def route(nodes: list[tuple[int, int, int, int]], prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index into prints) for each leaf that each fingerprint belongs to or overlaps."""
    leaves, rows, open_ = [], [], [(0 if nodes else -1, np.arange(len(prints)))]
    while open_:
        node, index = open_.pop()
        if not len(index):
            continue
        if node < 0:
            leaves.append(np.full(len(index), -1 - node, np.int32))
            rows.append(index)
            continue
        point, cut, inside, outside = nodes[node]
        distance = np.bitwise_count(prints[index] ^ np.uint64(point)).astype(int)
        open_ += [(inside, index[distance <= cut]), (outside, index[distance > cut - radius])]
    return (np.concatenate(leaves), np.concatenate(rows)) if rows else (np.zeros(0, np.int32), np.zeros(0, int))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked entries, and all that had their labels, the smallest label. label[x] <= x is a forest."""
    while len(i):
        a, b = label[i], label[j]
        while (differ := label[a] != a).any():
            a[differ] = label[a[differ]]
        while (differ := label[b] != b).any():
            b[differ] = label[b[differ]]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct fingerprints of a leaf, the index of its class's first one."""
    label, rng = np.arange(len(prints)), np.random.default_rng(SEED)
    open_ = [np.arange(len(prints))]
    while open_:
        index = open_.pop()
        own = prints[index]
        found = _split(own, radius, rng) if len(index) > BRUTE else None
        if found is not None and found[2] < 0.85:
            distance = np.bitwise_count(own ^ np.uint64(found[0])).astype(int)
            open_ += [index[distance <= found[1]], index[distance > found[1] - radius]]
            continue
        step = max(1, (1 << 20) // max(1, len(own)))
        for a in range(0, len(own), step):
            i, j = np.nonzero(np.bitwise_count(own[a : a + step, None] ^ own[None, a:]) <= radius)
            apart = i < j
            merge(label, index[i[apart] + a], index[j[apart] + a])
    while (label[label] != label).any():
        label = label[label]
    return label


def _dealt(rows: pa.RecordBatch | pa.Table, tree: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """leaf, fp, node of rows in the leaves of a tree."""
    fps, ids = rows.column("fp").to_numpy(), rows.column("node").to_numpy()
    leaves, at = route(tree, fps.view(np.uint64), radius)
    return leaves, fps[at], ids[at]


def _named(leaf: int, part: str) -> int:
    """A leaf's part as a signed number; two of one number would be searched together, which finds the same links."""
    return xxhash.xxh64_intdigest(f"{leaf}.{part}") - (1 << 63)


def _in_blocks(leaf: int, fps: np.ndarray, ids: np.ndarray, blocks: int) -> list[pa.RecordBatch]:
    """The rows of a leaf once for each pair of blocks that has theirs."""
    own = ((fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(blocks)
    out = []
    for block in np.unique(own).tolist():
        at = np.flatnonzero(own == block)
        for other in range(blocks):
            pair = _named(leaf, f"{min(block, other)}-{max(block, other)}")
            out.append(of(ROUTED, leaf=np.full(len(at), pair), fp=fps[at], node=ids[at]))
    return out


def _split_further(routed: DataFrame, radius: int, largest: int, most: int) -> list[DataFrame]:
    """routed (leaf, fp, node) in frames of further leaves, none of which has many more than `largest` rows."""
    done = []
    for level in range(LEVELS + 1):
        full = stored(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest), "full")
        if full.isEmpty():
            return [*done, routed]
        done.append(routed.join(full, "leaf", "left_anti"))
        parts = F.ceil(F.col("n") / largest)
        rows = routed.join(full, "leaf").withColumn("part", F.pmod(F.xxhash64("fp"), parts))
        share = F.pmod(F.xxhash64("fp", F.lit(level)), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("n")
        leaves_of = most if level < LEVELS else 0  # the last level makes blocks of all that is still full

        def plan(group: pa.Table) -> pa.Table:
            n, prints = group.column("n")[0].as_py(), np.sort(group.column("fp").to_numpy()).view(np.uint64)
            tree = plan_tree(prints, n, radius, largest, leaves_of)
            return pa.Table.from_batches([of(PLANNED, leaf=group.column("leaf")[:1].to_numpy(), n=[n], tree=[np.array([(p - (1 << 63), *rest) for p, *rest in tree], np.int64).tobytes()])])

        def deal(group: pa.Table, planned: pa.Table) -> pa.Table:
            if not group.num_rows:
                return pa.Table.from_batches([], ROUTED)
            leaf, n = planned.column("leaf")[0].as_py(), planned.column("n")[0].as_py()
            tree = [(p + (1 << 63), *rest) for p, *rest in np.frombuffer(planned.column("tree")[0].as_py(), np.int64).reshape(-1, 4).tolist()]
            if not tree:  # pairs of blocks have `largest` rows, and are below it as a whole
                return pa.Table.from_batches(_in_blocks(leaf, group.column("fp").to_numpy(), group.column("node").to_numpy(), -(-5 * n // (2 * largest))), ROUTED)
            leaves, fps, ids = _dealt(group, tree, radius)
            names = {at: _named(leaf, str(at)) for at in np.unique(leaves).tolist()}
            return pa.Table.from_batches([of(ROUTED, leaf=np.array([names[at] for at in leaves.tolist()], np.int64), fp=fps, node=ids)])

        trees = rows.where(share).select("leaf", "n", "fp").groupBy("leaf").applyInArrow(plan, "leaf long, n long, tree binary")
        trees = full.select("leaf", F.col("n").alias("m")).join(trees, "leaf", "left").select("leaf", F.col("m").alias("n"), F.coalesce("tree", F.lit(b"")).alias("tree"))
        trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        pieces = rows.select("leaf", "part", "fp", "node").groupBy("leaf", "part").cogroup(trees.groupBy("leaf", "part"))
        routed = stored(pieces.applyInArrow(deal, ROUTED_DDL), "routed")
    return [*done, routed]


def links(nodes_of: DataFrame, radius: int = RADIUS, leaf: int | None = None, largest: int = LARGEST, most: int = MAX_LEAVES, sub_leaves: int = SUB_LEAVES) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly the nodes whose fingerprints are linked by steps within the radius.

    nodes_of: fp, node; each fingerprint once. A leaf holds what its share of the session's partitions calls for, LEAF at
    least and `largest` at most.
    """
    known = nodes_of.where("node IS NOT NULL")
    total = known.count()
    sample = known.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    leaf = leaf or min(max(LEAF, total // (4 * partitions(nodes_of))), largest)
    tree = plan_tree(sample, total, radius, leaf, most)
    fullest = int(np.bincount(route(tree, sample, radius)[0]).max(initial=0)) / max(1, len(sample)) * total if len(sample) else 0

    def deal(batches):
        for batch in batches:
            leaves, fps, ids = _dealt(batch, tree, radius)
            yield of(ROUTED, leaf=leaves.astype(np.int64), fp=fps, node=ids)

    def search(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("node").to_numpy(), kind="stable")
        ids = group.column("node").to_numpy()[order]
        first = forest(group.column("fp").to_numpy()[order].view(np.uint64), radius)
        linked = np.flatnonzero(first != np.arange(len(first)))
        return pa.Table.from_batches([of(EDGES, u=ids[linked], v=ids[first[linked]])])

    routed = known.select("fp", "node").mapInArrow(deal, ROUTED_DDL)
    frames = _split_further(stored(routed, "routed"), radius, largest, sub_leaves) if 2 * fullest > largest else [routed]  # the sample that a tree is planned on shows its leaves up to half as full as they are
    out = [frame.groupBy("leaf").applyInArrow(search, "u long, v long") for frame in frames]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of each node that has an edge (u, v), by large-star and small-star steps."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stored(small, "edges")
        roots = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        open_ = roots.where("n > 1").select("u").limit(1).unionByName(roots.join(roots.select(F.col("u").alias("v")), "v", "left_semi").select("u").limit(1))
        discard(now)
        now = after
        if open_.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    prints = stored(fingerprints(docs, shingle, seed), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes, radius))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of docs for each class of found (doc_id, component_id; by default those of classes()), with all its columns: that of the smallest doc_id and, among its rows, of the least text hash.

    Rows with a null doc_id stay only where their whole class has none; one of them stays.
    """
    keep, turn = (f"{name}_{uuid.uuid4().hex}" for name in ("keep", "turn"))  # names that docs can't have
    found = classes(docs) if found is None else found
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    first = found.where("doc_id <=> component_id").select(F.col("doc_id").alias(keep)).distinct()
    out = docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(keep)), "left_semi")
    if again.isEmpty():
        return out
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text").cast("string")))
    return out.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn)
