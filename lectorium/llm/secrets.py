"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Base spans are the leftmost non-overlapping matches of three patterns. Besides them every run of LEAST or more key characters
is tested, and of a run that base spans overlap each rest of that length. Its encoding (hex, base 26, 32, 36, 62 or 64) is inferred from the characters in it, and three tests ask whether
it looks drawn at random from that alphabet: chi-squared uniformity, runs about the alphabet's middle, and the serial
correlation of neighbours. A run must pass all three at level REJECT. Its p-value is then the chance that an ordinary
run of that length looks as random: as even by the chi-squared statistic, whose moments under the letter frequencies of
all documents are exact, and with as many turns between lower case, upper case, digits and symbols as ORDINARY_TURNS a
neighbour allows (a capital before a small letter is no turn). Fisher's method joins the two. Weighted Benjamini-Hochberg at level FDR over all runs of the
corpus, with weights in proportion to length, gives the threshold; it is read off a histogram of fixed size. One pass finds
base spans and runs and stores them, for redaction with the rows they belong to; a second one applies the threshold.

Defined cases. Null and empty texts have no spans. Repeated rows are scanned one by one; a null doc_id stays null. Digits
alone are numbers, never keys. Other columns are ignored by scan(), and kept unchanged by redacted().
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, documents, of, stored, text_slices, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
FDR = 0.01
REJECT = 0.001
ORDINARY_TURNS = 0.15
BINS, PER_BIN = 2000, 0.05
PLACEHOLDER = "[SECRET]"

SCANNED = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])))]
    + [("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("k", pa.int32()), ("chi", pa.float64()), ("turns", pa.int32())]))), ("letters", pa.list_(pa.int64()))]
)
SCANNED_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start: long, kind: int, end: long>>, runs array<struct<start: long, end: long, k: int, chi: double, turns: int>>, letters array<long>"
FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _alphabets() -> dict[int, np.ndarray]:
    """By size: each ASCII code's place in that alphabet, -1 outside it."""
    lower, upper, digits = range(97, 123), range(65, 91), range(48, 58)
    kinds = {16: [*digits, *range(97, 103)], 26: [*lower], 32: [*upper, *range(50, 56)], 36: [*digits, *lower], 62: [*digits, *upper, *lower], 64: [*upper, *lower, *digits, 43, 47]}
    out = {}
    for size, codes in kinds.items():
        place = np.full(128, -1, np.int16)
        place[codes] = np.arange(size)
        if size in (16, 26, 36):  # either case, when a run is of one case throughout
            for c in codes:
                if c >= 97:
                    place[c - 32] = place[c]
        if size == 64:
            place[45], place[95] = 62, 63
        out[size] = place
    return out


ALPHABETS = _alphabets()


def encoding(run: str) -> int:
    """Size of the alphabet that a run of key characters seems to be drawn from; 0 for digits alone."""
    if run.isdigit():
        return 0
    if not run.isalnum():
        return 64
    one_case = run == run.lower() or run == run.upper()
    if one_case and not set(run.lower()) - set("0123456789abcdef"):
        return 16
    if one_case and run.isalpha():
        return 26
    if run == run.upper() and not set(run) & set("0189"):
        return 32
    return 36 if one_case else 62


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str) -> tuple[int, float, float, float, float]:
    """(alphabet size, chi-squared statistic, p of uniformity, of the runs test, of the serial correlation)."""
    k = encoding(run)
    if not k:
        return 0, 0.0, 0.0, 0.0, 0.0
    x = ALPHABETS[k][np.frombuffer(run.encode("ascii"), np.uint8)].astype(np.float64)
    n = len(x)
    chi = k / n * float((np.bincount(x.astype(np.int64), minlength=k).astype(np.float64) ** 2).sum()) - n
    uniform = 0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n) / math.sqrt(2))
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return k, chi, uniform, 0.0, 0.0
    turns = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = _two_sided((turns - mean) / math.sqrt(variance)) if variance > 0 else 0.0
    y = x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / (y * y).sum())
    serial = _two_sided((r + 1 / n) * math.sqrt(n))
    return k, chi, uniform, runs, serial


def class_turns(run: str) -> int:
    """Neighbours of different kinds, but for a capital before a small letter."""
    kinds = ["l" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "s" for c in run]
    return sum(a != b and (a, b) != ("U", "l") for a, b in zip(kinds, kinds[1:], strict=False))


def free_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs of key characters, less what base spans cover, LEAST characters or longer."""
    found = []
    for m in RUN.finditer(text):
        at, end = m.span()
        for s, _, e in base:  # in order of their starts
            if e > at and s < end:
                found.append((at, s))
                at = max(at, e)
        found.append((at, end))
    return [(a, b) for a, b in found if b - a >= LEAST]


def random_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, int]]:
    """(start, end, k, chi-squared, infinite where a test rejects, turns) of the tested runs."""
    found = []
    for start, end in free_runs(text, base):
        k, chi, *passed = battery(text[start:end])
        if k:
            found.append((start, end, k, chi if min(passed) > REJECT else math.inf, class_turns(text[start:end])))
    return found


def log_p(length: int, k: int, chi: float, turns: int, letters: np.ndarray) -> float:
    """-log10 of the chance that an ordinary run is as even and turns as often. letters: counts of a to z over the corpus."""
    if math.isinf(chi):
        return 0.0
    place = ALPHABETS[k][97:123]
    if k == 32:
        place = ALPHABETS[k][65:91]
    q = np.where(place >= 0, letters + 1.0, 0.0)
    q /= q.sum()
    q2, q3, n = float((q**2).sum()), float((q**3).sum()), length
    mean = k / n * (n * (n - 1) * q2 + n) - n
    variance = (k / n) ** 2 * (4 * n * (n - 1) * (n - 2) * (q3 - q2 * q2) + 2 * n * (n - 1) * (q2 - q2 * q2))
    z = (chi - mean) / math.sqrt(max(variance, 1e-12))
    even = 0.5 * math.erfc(-z / math.sqrt(2))
    spread = math.sqrt((n - 1) * ORDINARY_TURNS * (1 - ORDINARY_TURNS))
    if n <= 256:
        turning = sum(math.comb(n - 1, i) * ORDINARY_TURNS**i * (1 - ORDINARY_TURNS) ** (n - 1 - i) for i in range(turns, n))
    else:
        turning = 0.5 * math.erfc((turns - 0.5 - (n - 1) * ORDINARY_TURNS) / spread / math.sqrt(2))
    product = even * turning
    if product <= 0:
        return BINS * PER_BIN
    return max(0.0, min(-math.log10(product) - math.log10(1 - math.log(product)), BINS * PER_BIN))


def threshold(counts: dict[int, int], level: float = FDR) -> float:
    """Least -log10 of a weighted p-value that Benjamini-Hochberg accepts; counts by bin of PER_BIN."""
    total, seen, least = sum(counts.values()), 0, math.inf
    for bin_ in sorted(counts, reverse=True):
        seen += counts[bin_]
        if total * 10 ** (-bin_ * PER_BIN) <= level * seen:
            least = bin_ * PER_BIN
    return least


def weighted(length: int, mean_length: float, value: float) -> float:
    """value with the weight that its length gives it."""
    return value + math.log10(length / mean_length) if value else 0.0


def scanned(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Per row: base spans and tested runs, and with whole the row itself; a further row for each slice of a batch has the slice's letter counts alone."""
    rows = documents(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")) if whole else documents(docs)

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch):
                own = texts(piece)
                base = [base_spans(t) for t in own]
                runs = [random_runs(t, b) for t, b in zip(own, base, strict=True)]
                count = np.zeros(26, np.int64)
                for t in own:
                    count += np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass").lower(), np.uint8), minlength=128)[97:123]
                out = of(
                    SCANNED,
                    doc_id=[*piece.column("doc_id").to_pylist(), None],
                    **{f"n_{kind}": [*(sum(k == i for _, k, _ in b) for b in base), 0] for i, kind in enumerate(KINDS[:3])},
                    base=[[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b in [*base, []]],
                    runs=[[dict(zip(("start", "end", "k", "chi", "turns"), s, strict=True)) for s in r] for r in [*runs, []]],
                    letters=[*([None] * len(own)), count.tolist()],
                )
                if whole:
                    row = piece.column("row")
                    out = out.append_column("row", pa.concat_arrays([row, pa.nulls(1, row.type)]))
                yield out

    return rows.mapInArrow(run, T.StructType([*T.StructType.fromDDL(SCANNED_DDL).fields, *([T.StructField("row", rows.schema["row"].dataType)] if whole else [])]))


def fitted(rows: DataFrame, level: float = FDR) -> tuple[np.ndarray, float, float]:
    """Letter counts, mean length of the tested runs and the threshold, over all rows of scanned()."""
    sums = rows.where("letters IS NOT NULL").select(F.posexplode("letters")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    letters = np.zeros(26)
    for r in sums:
        letters[r["pos"]] = r["n"]
    tested = rows.select(F.explode("runs").alias("r")).select((F.col("r.end") - F.col("r.start")).alias("n"), "r.k", "r.chi", "r.turns")
    mean = tested.agg(F.avg("n").alias("n")).collect()[0]["n"] or 1.0

    def bins(batches):
        for batch in batches:
            n, k, chi, turns = (batch.column(c).to_pylist() for c in ("n", "k", "chi", "turns"))
            at = [int(weighted(a, mean, log_p(a, b, c, d, letters)) / PER_BIN) if not math.isinf(c) else 0 for a, b, c, d in zip(n, k, chi, turns, strict=True)]
            values, many = np.unique(np.array(at, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(values, 0)), pa.array(many)], names=["bin", "n"])

    counted = tested.mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return letters, mean, threshold({r["bin"]: r["n"] for r in counted}, level)


def _added(runs, letters: np.ndarray, mean: float, least: float) -> list[tuple[int, int, int]]:
    return [(s, 3, e) for s, e, k, chi, turns in runs if not math.isinf(chi) and weighted(e - s, mean, log_p(e - s, k, chi, turns, letters)) >= least > 0]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, level: float = FDR) -> DataFrame:
    """The contract's rows, and n_random: spans that the test battery adds."""
    rows = stored(scanned(docs), "scanned")
    letters, mean, least = fitted(rows, level)

    def run(batches):
        for batch in batches:
            base = [[(s["start"], s["kind"], s["end"]) for s in b] for b in batch.column("base").to_pylist()]
            more = [_added([(r["start"], r["end"], r["k"], r["chi"], r["turns"]) for r in rs], letters, mean, least) for rs in batch.column("runs").to_pylist()]
            yield of(
                FOUND,
                doc_id=batch.column("doc_id"),
                **{f"n_{k}": batch.column(f"n_{k}") for k in KINDS[:3]},
                base_sha256=[hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                spans=[joined(sorted(b + m)) for b, m in zip(base, more, strict=True)],
                n_random=[len(m) for m in more],
            )

    return rows.where("letters IS NULL").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(text: str, spans: list[tuple[int, int, int]], placeholder: str = PLACEHOLDER) -> str:
    """The text with each maximal stretch of spans replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], placeholder]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, level: float = FDR, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every found span replaced and n_chars recounted; a null text stays null."""
    rows, names = stored(scanned(docs, whole=True), "scanned"), docs.columns
    letters, mean, least = fitted(rows, level)

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            columns = dict(zip(names, row.flatten(), strict=True))
            texts_, out = columns["text"], []
            for t, base, runs in zip(texts_.to_pylist(), batch.column("base").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                spans = [(s["start"], s["kind"], s["end"]) for s in base] + _added([(r["start"], r["end"], r["k"], r["chi"], r["turns"]) for r in runs], letters, mean, least)
                out.append(redact(t, spans, placeholder) if spans else t)
            columns["text"] = pa.array(out, texts_.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    done = rows.where("letters IS NULL").select("base", "runs", "row").mapInArrow(_in_slices(run), docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done


def _in_slices(run):
    """run over batches of a bounded size, where the texts are within rows."""

    def sliced(batches):
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            yield from run(batch.slice(a, step) for a in range(0, batch.num_rows, step))

    return sliced
