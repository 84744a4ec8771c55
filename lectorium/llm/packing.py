"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Documents longer than a sequence are cut into whole sequences, with the remainder first. Pieces are counted by length; best
fit runs over the counts on the driver, longest first: each pattern takes the longest lengths that still fit and is repeated
as often as the counts allow. A pattern uses up some length or leaves less of it than it takes, so there are at most two
patterns a length, and a pattern holds at most sqrt(2 * size) different lengths: the plan has a bounded size whatever the
input. Each piece then finds its slot by its rank within its length, which is its rank in its own partition plus the counts
of the partitions before; no length is gathered anywhere.

Defined cases. Null and empty texts are one end token. Repeated rows are packed one by one; a null doc_id stays null. An
empty table gives no rows. Other columns are ignored. Which of two pieces of the same length takes which slot is not defined
beyond the partition order of the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, of, stored, text_slices, texts
from .tokens import default_path, encoder

SIZE = 2048
END = 0
PIECES = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece, with its partition and its rank among that partition's pieces of the same length."""
    path = path or default_path()

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows in text_slices(batch):
                ids, bounds = encoder(path).encode(texts(rows))
                out = {f.name: [] for f in PIECES}
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    first = len(own) % size or size
                    starts = [0, *range(first, len(own), size)]
                    for k, start in enumerate(starts):
                        length = first if not k else size
                        row = (part, int(seen[length]), doc, k, start, length, zlib.crc32(own[start : start + length].tobytes()))
                        seen[length] += 1
                        for name, value in zip(out, row, strict=True):
                            out[name].append(value)
                yield of(PIECES, **out)

    return documents(docs).mapInArrow(run, "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Slots: length, first rank, copies a sequence, first sequence, offset. They are in order of length and rank."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, slots, sequence = np.zeros(size + 1, np.int64), [], 0
    for longest in range(size, 0, -1):
        while left[longest]:
            pattern, room, length = [], size, longest
            while room and length:
                copies = min(room // length, int(left[length]))
                if copies:
                    pattern.append((length, copies, size - room))
                    room -= copies * length
                fits = np.flatnonzero(left[: min(room, length - 1) + 1])
                length = int(fits[-1]) if len(fits) else 0
            times = min(int(left[length]) // copies for length, copies, _ in pattern)
            for length, copies, offset in pattern:
                slots.append((length, int(used[length]), copies, sequence, offset))
                used[length] += copies * times
                left[length] -= copies * times
            sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """The contract's rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stored(pieces(docs, path, size, end), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    firsts = np.searchsorted(slots[:, 0], np.arange(size + 2)) if len(slots) else np.zeros(size + 2, int)

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for one in np.unique(length):
                own = length == one
                a, b = firsts[one], firsts[one + 1]
                at[own] = a + np.searchsorted(slots[a:b, 1], rank[own], side="right") - 1
            turn, copies = rank - slots[at, 1], slots[at, 2]
            kept = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield of(PLACED, **kept, sequence_id=slots[at, 3] + turn // copies, offset=slots[at, 4] + length * (turn % copies))

    ranked = rows.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    return ranked.mapInArrow(place, PLACED_DDL)
