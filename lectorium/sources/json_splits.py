"""The lists of one large JSON object, each of their elements a row, read in as many tasks as the file has splits.

Spark's text source cuts the file into byte ranges, in any store, and its lines are made to end at "}", so a list without line
breaks is cut as well. Whether a split begins inside of a string, how deep, and in which element is known only from the splits
before it. So three passes are made, each over all splits at once: one sums up quotes and brackets, for both cases of the
start; one counts, from the depth then known, lists and elements; and the last one cuts the elements out and stores them in
the shared folder, so that the file is read and decoded once, however often the frame that is returned is used. What comes to the driver is a few numbers for each split, and the object without its lists'
elements, of at most SKELETON bytes. An element within one split is decoded there; the edges of others meet by their number.

Elements are decoded strictly, as UTF-8 and then as Python's json does: of repeated keys the last counts. NaN and Infinity,
which no JSON has, become null. A file with anything else wrong is no object of lists: BrokenJson.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import at, shared_folder, stored

END = "}"
BLANK = b" \t\r\n"
SKELETON = 64 << 20
CHUNK = 8 << 20
QUOTE, OPEN, CLOSE, COMMA = 1, 2, 3, 4
CLASS = np.zeros(256, np.uint8)
for _bytes, _class in ((b'"', QUOTE), (b"{[", OPEN), (b"}]", CLOSE), (b",", COMMA)):
    CLASS[list(_bytes)] = _class
STATS = pa.schema([("at", pa.int64()), ("bytes", pa.int64()), ("odd", pa.bool_()), ("deeper", pa.int64()), ("deeper_inside", pa.int64())])
COUNTS = pa.schema([("at", pa.int64()), ("lists", pa.int64()), ("kind", pa.string()), ("before", pa.int64()), ("behind", pa.int64())])
PARTS = pa.schema([("list", pa.int64()), ("i", pa.int64()), ("at", pa.int64()), ("json", pa.string()), ("edge", pa.binary()), ("bad", pa.bool_()), ("last", pa.bool_())])


class BrokenJson(ValueError):
    """The file isn't a JSON object, or something in one of its lists isn't JSON."""


@dataclass
class Start:
    """Where a split begins: in a string or not, at which depth, in which kind of value of the root, and in which element of which list."""

    inside: bool = False
    depth: int = 0
    kind: str = ""
    lists: int = 0
    i: int = 0


def _signs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and classes of brackets, commas and quotes, and which of them are quotes that no backslash takes back."""
    at = np.flatnonzero(CLASS[text])
    kind = CLASS[text[at]]
    quote = kind == QUOTE
    near = np.flatnonzero(quote & (at > 0) & (text[at - 1] == 0x5C))
    if len(near):  # an odd run of backslashes ends before such a quote
        slashes = np.flatnonzero(text == 0x5C)
        first = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, np.arange(len(slashes)), 0))
        own = np.searchsorted(slashes, at[near] - 1)
        quote[near] = (own - first[own]) % 2 == 1
    return at, kind, quote


def tokens(text: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places, classes and depths (that of an opening bracket counts it) of brackets and commas outside of strings, and whether the end is in a string."""
    at, kind, quote = _signs(text)
    within = (np.cumsum(quote) + inside) % 2 == 1
    outside = ~within & (kind != QUOTE)
    places, kinds = at[outside], kind[outside]
    depths = depth + np.cumsum((kinds == OPEN).astype(np.int64) - (kinds == CLOSE))
    return places, kinds, depths, bool((quote.sum() + inside) % 2)


def _ends(text: np.ndarray) -> tuple[bool, int, int]:
    """Whether quotes are odd in number, and how much deeper the end is, for a start out of a string and in one."""
    _, kind, quote = _signs(text)
    within = np.cumsum(quote) % 2 == 1
    step = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
    return bool(quote.sum() % 2), int(step[~within].sum()), int(step[within].sum())


def decoded(raw: bytes) -> tuple[str | None, bool]:
    """The JSON text of an element, with repeated keys and unbounded numbers settled; and whether it is none."""
    odd = False

    def pairs(own: list) -> dict:
        nonlocal odd
        found = dict(own)
        odd |= len(found) != len(own)
        return found

    def constant(_: str) -> None:
        nonlocal odd
        odd = True

    try:
        text = raw.decode("utf-8")
        json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
        if odd or "\\u" in text:  # half of a surrogate pair is no text either
            settled = json.loads(text, parse_constant=lambda _: None, parse_float=lambda x: float(x) if math.isfinite(float(x)) else None)
            text = json.dumps(settled, ensure_ascii=False).encode("utf-8", "replace").decode("utf-8")
        return text, False
    except (ValueError, RecursionError):
        return None, True


def _splits(batches: Iterator[pa.RecordBatch], last: tuple[int, int] | None = None) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(where it begins, its bytes in chunks) of each split. last: where the file's last split begins and its bytes, if the file doesn't end at END."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for at, chunk in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True):
                yield at, chunk

    source = rows()
    ahead = next(source, None)
    while ahead:
        at = ahead[0]

        def chunks(at: int = at) -> Iterator[bytes]:
            nonlocal ahead
            held, size, seen = [], 0, 0
            while ahead and ahead[0] == at:
                piece = ahead[1] + END.encode()
                seen += len(piece)
                held.append(piece[:-1] if last == (at, seen) else piece)
                size += len(piece)
                ahead = next(source, None)
                if size >= CHUNK:
                    yield b"".join(held)
                    held, size = [], 0
            yield b"".join(held)

        yield at, chunks()


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: bytes, whether quotes are odd in number, and how much deeper a split ends, for a start out of a string and in one."""
    for at, chunks in _splits(batches):
        size, odd, out, within = 0, False, 0, 0
        for chunk in chunks:
            flips, *deeper = _ends(np.frombuffer(chunk, np.uint8))
            size, out, within = size + len(chunk), out + deeper[odd], within + deeper[not odd]
            odd ^= flips
        yield _batch(STATS, [(at, size, odd, out, within)])


def _marks(text: np.ndarray, start: Start) -> Iterator[tuple[int, str]]:
    """Places where a value of the root begins ("[" or "{") and ends ("]"), and commas in it at its own depth; start moves on."""
    places, kinds, depths, start.inside = tokens(text, start.inside, start.depth)
    start.depth = int(depths[-1]) if len(depths) else start.depth
    own = ((kinds == CLOSE) & (depths == 1)) | ((kinds != CLOSE) & (depths == 2))
    for place, kind in zip(places[own].tolist(), kinds[own].tolist(), strict=True):
        yield place, "]" if kind == CLOSE else "," if kind == COMMA else chr(text[place])


def counter(starts: dict[int, Start], last: tuple[int, int] | None):
    """Pass 2: of each split the lists that it opens, the kind of value that its end is in ("=": its start's), and the commas before the first value that ends and behind the last that begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, chunks in _splits(batches, last):
            start, lists, kind, before, behind = Start(**vars(starts[at])), 0, "=", 0, 0
            for chunk in chunks:
                for _, mark in _marks(np.frombuffer(chunk, np.uint8), start):
                    if mark == ",":
                        before, behind = before + (kind == "="), behind + (kind == "[")
                    else:
                        kind, behind = "" if mark == "]" else mark, 0
                        lists += mark == "["
            yield _batch(COUNTS, [(at, lists, kind, before, behind)])

    return run


def cutter(starts: dict[int, Start], last: tuple[int, int] | None):
    """Pass 3: elements of lists (list, i, json), edges of those that other splits have parts of, and, as list -1, the rest of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, chunks in _splits(batches, last):
            now, out, held, turn = Start(**vars(starts[at])), [], [], 0
            whole = now.kind != "["  # whether the element at hand began in this split
            for chunk in chunks:
                text, a, moving = np.frombuffer(chunk, np.uint8), 0, Start(**vars(now))
                for place, mark in _marks(text, moving):
                    if now.kind == "[" and mark in ",]":
                        raw, ends = b"".join([*held, chunk[a:place]]), mark == "]"
                        if not whole:
                            out.append((now.lists - 1, now.i, at, None, raw, False, ends))
                        elif not ends or now.i or raw.strip(BLANK):
                            out.append((now.lists - 1, now.i, at, *_found(raw), ends))
                        held, whole, a = [], True, place + (not ends)
                        now.i, now.kind = now.i + 1, "" if ends else "["
                    elif now.kind != "[" and mark != ",":
                        if mark == "[":
                            out.append((-1, turn, at, None, chunk[a : place + 1] + str(now.lists).encode(), False, False))
                            now.lists, now.i, a, turn = now.lists + 1, 0, place + 1, turn + 1
                        now.kind = "" if mark == "]" else mark
                now.inside, now.depth = moving.inside, moving.depth
                if now.kind == "[":
                    held.append(chunk[a:])
                elif a < len(chunk):
                    out.append((-1, turn, at, None, chunk[a:], False, False))
                    turn += 1
                yield _batch(PARTS, out)
                out = []
            if now.kind == "[" and any(held):
                yield _batch(PARTS, [(now.lists - 1, now.i, at, None, b"".join(held), False, False)])

    return run


def _found(raw: bytes) -> tuple[str | None, None, bool]:
    text, bad = decoded(raw)
    return text, None, bad


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of edges, whose parts are in order; an empty list's only one is blank and is none."""
    for batch in batches:
        out = []
        for of_list, i, parts, last in zip(*(batch.column(c).to_pylist() for c in ("list", "i", "parts", "last")), strict=True):
            raw = b"".join(parts)
            if not (last and i == 0 and not raw.strip(BLANK)):
                out.append((of_list, i, 0, *_found(raw), last))
        yield _batch(PARTS, out)


DDL = "list long, i long, at long, json string, edge binary, bad boolean, last boolean"


def lists_of(spark: SparkSession, path: str, size: int) -> tuple[dict, DataFrame]:
    """The root, each of its lists as [its number]; and list, i, json of all lists' elements (json is null for one that isn't JSON).

    path: as Spark's readers take it; size: the file's bytes.
    """
    source = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    stats = sorted(source.mapInArrow(summed, "at long, bytes long, odd boolean, deeper long, deeper_inside long").collect())
    read = sum(s["bytes"] for s in stats)
    if not stats or read - size not in (0, 1):  # the source leaves out a byte order mark, which no JSON begins with
        raise BrokenJson(f"{path} is empty or begins with a byte order mark")
    end = (stats[-1]["at"], stats[-1]["bytes"])
    last = end if read == size + 1 else None
    starts, now = {}, Start()
    for s in stats:
        starts[s["at"]] = Start(**vars(now))
        now.depth += s["deeper_inside"] if now.inside else s["deeper"]
        now.inside ^= s["odd"]
    if last:  # an end that the file doesn't have was counted
        now.depth += not now.inside
    if now.inside or now.depth:
        raise BrokenJson(f"{path} doesn't end where its root does")
    counts = sorted(source.mapInArrow(counter(starts, last), "at long, lists long, kind string, before long, behind long").collect())
    now = Start()
    for c in counts:
        own = starts[c["at"]]
        own.kind, own.lists, own.i = now.kind, now.lists, now.i
        now.lists += c["lists"]
        now.i = now.i + c["before"] if c["kind"] == "=" else c["behind"]
        now.kind = now.kind if c["kind"] == "=" else c["kind"]
    parts = stored(source.mapInArrow(cutter(starts, last), DDL), "parts")
    rest = parts.where("list = -1").select("at", "i", "edge")
    if (rest.agg(F.sum(F.length("edge")).alias("n")).first()["n"] or 0) > SKELETON:
        raise ValueError(f"{path} has more than {SKELETON} bytes beside its lists")
    try:
        root = json.loads(b"".join(bytes(r["edge"]) for r in sorted(rest.collect())).decode("utf-8"))
    except (ValueError, RecursionError) as error:
        raise BrokenJson(f"{path}: {error}") from None
    if not isinstance(root, dict):
        raise BrokenJson(f"{path} holds no object")
    edges = parts.where("list >= 0 AND edge IS NOT NULL").groupBy("list", "i").agg(F.array_sort(F.collect_list(F.struct("at", "edge"))).alias("x"), F.max("last").alias("last"))
    met = edges.select("list", "i", F.transform("x", lambda e: e["edge"]).alias("parts"), "last").mapInArrow(_joined, DDL)
    return root, parts.where("list >= 0 AND edge IS NULL").unionByName(met).select("list", "i", "json")


def visible(spark: SparkSession, path: str) -> str:
    """A path by which Spark's readers find the file: its name is no pattern, and where they would hide it a copy is made in the shared folder."""
    store, file = at(spark, path)
    if file.getName()[:1] in "._":
        beside, copy = at(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}.json")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, file, beside, copy, False, spark.sparkContext._jsc.hadoopConfiguration())
        path = copy.toString()
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in path)
