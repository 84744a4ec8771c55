"""Calls to an outside text service, by a client that the caller gives: one paced, retried call for each row, whatever happens to its task.

A client is made once in each task: call(prompt, **options), which raises errors with a code. The rate is one for all tasks,
without any of them asking another: rows are dealt to lanes, a task each, and time is cut into slots of 60 / rate seconds,
of which lane k of n has those with a number that leaves k when divided by n. A call begins with a slot of its lane, so no two
calls anywhere share a slot, however many tasks run, and a task that is run again has its old slots.

With a ledger, a row is leased before it is asked for and its answer is noted before the next row's turn. A task that is run
again, or a copy of one, takes what is noted and asks for the rest; a lease that was broken off is free again after a while.
Rows that are equal in id and prompt, asked with equal options, are one question. A failure that isn't worth another try, and the last of several,
becomes an error column; it doesn't end the job. An answer that holds no JSON where JSON is asked for is such an error, and
is never asked for again.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import AGAIN, BAD_JSON, OTHER, delay_before, kind_of
from ..functions.text import extract_json, strip

ATTEMPTS = 3
SHOWN = 40
LEASE = 120.0
LOOK = 0.25
ANSWERS = pa.schema([("id", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("ms", pa.int64())])


class Slots:
    """One lane's slots of a rate a minute that all lanes share; a rate of zero or less is no limit."""

    def __init__(self, per_minute: float, lane: int = 0, lanes: int = 1, now: Callable[[], float] = time.time, rest: Callable[[float], None] = time.sleep):
        self.length = 60.0 / per_minute if per_minute > 0 else 0.0
        self.lane, self.lanes, self.now, self.rest, self.turn = lane, lanes, now, rest, -1

    def next(self) -> None:
        """Return as the lane's next slot begins that wasn't used."""
        if not self.length:
            return
        first = math.ceil((self.now() / self.length - self.lane) / self.lanes)
        self.turn = max(first, self.turn + 1)
        begin = (self.turn * self.lanes + self.lane) * self.length
        while (left := begin - self.now()) > 0:
            self.rest(left)


class FolderLedger:
    """Answers and leases as files in a folder that all executors can open, such as a shared mount. A paced call is rare, so a file for each is little.

    A lease is a file that only one can make; it lasts so many seconds, which must be more than a call with its retries takes.
    """

    def __init__(self, folder: str, lease: float = LEASE, now: Callable[[], float] = time.time, rest: Callable[[float], None] = time.sleep):
        parsed = urlparse(folder)
        if parsed.scheme not in ("", "file"):
            raise ValueError(f"{folder} can't be opened as a folder by tasks; give a ledger of your own with take() and note()")
        self.folder, self.lease, self.now, self.rest = parsed.path, lease, now, rest

    def _paths(self, key: str) -> tuple[str, str]:
        beside = os.path.join(self.folder, key[:2], key)
        return f"{beside}.json", f"{beside}.lease"

    def take(self, key: str) -> list | None:
        """What is noted under the key; None if nothing is, and then the key is leased to the caller. Waits while another holds it."""
        noted, lease = self._paths(key)
        os.makedirs(os.path.dirname(noted), exist_ok=True)
        while True:
            try:
                with open(noted, encoding="utf-8") as file:
                    return json.load(file)
            except FileNotFoundError:
                pass
            try:
                with open(lease, "x", encoding="utf-8") as file:
                    file.write(str(self.now()))
            except FileExistsError:
                self._look(lease)
                continue
            if not os.path.exists(noted):  # else it was noted between the two looks
                return None
            os.unlink(lease)

    def _look(self, lease: str) -> None:
        """Wait a little for a lease, or take it away if it has run out; of several that do only one moves it."""
        try:
            old = self.now() - os.path.getmtime(lease) > self.lease
            if old:
                aside = f"{lease}.{uuid.uuid4().hex}"
                os.rename(lease, aside)
                os.unlink(aside)
            else:
                self.rest(LOOK)
        except FileNotFoundError:
            pass

    def note(self, key: str, answer: list) -> None:
        noted, lease = self._paths(key)
        beside = f"{noted}.{uuid.uuid4().hex}"
        with open(beside, "w", encoding="utf-8") as file:
            json.dump(answer, file)
            file.flush()
            os.fsync(file.fileno())
        os.replace(beside, noted)
        try:
            os.unlink(lease)
        except FileNotFoundError:
            pass


def called(call: Callable[..., str], prompt: str, slots: Slots, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, **options) -> tuple[str | None, str | None]:
    """(answer, kind of failure) after at most so many further attempts. Options without a value aren't passed on."""
    given, kind = {k: v for k, v in options.items() if v is not None}, OTHER
    for attempt in range(max(0, attempts) + 1):
        if attempt:
            sleep(delay_before(attempt - 1))
        slots.next()
        try:
            return call(prompt, **given) or "", None
        except Exception as error:  # noqa: BLE001  whatever the service's library raises
            kind = kind_of(error)
        if kind not in AGAIN:
            break
    return None, kind


def question(id_: str | None, prompt: str | None, options: dict) -> str:
    """The ledger's key of a row."""
    return hashlib.sha256(json.dumps([id_, prompt, sorted((k, repr(v)) for k, v in options.items() if v is not None)]).encode()).hexdigest()


def answers(rows: DataFrame, client: Callable[[], Callable[..., str]], per_minute: float, attempts: int = ATTEMPTS, ledger: str | Callable | None = None, lanes: int | None = None, **options) -> DataFrame:
    """id, answer, error and ms (its time) of rows (id, prompt). options: such as system_instruction and temperature.

    ledger: a folder for a FolderLedger, or what makes a ledger in each task. lanes: tasks that call at once (by default as many as the session runs).
    """
    make = (lambda: FolderLedger(ledger)) if isinstance(ledger, str) else ledger
    if isinstance(ledger, str):
        FolderLedger(ledger)  # a folder that can't be one is an error here
    wanted = rows.selectExpr("cast(id AS string) AS id", "prompt")
    paced = per_minute > 0
    lanes = max(1, lanes or rows.sparkSession.sparkContext.defaultParallelism)
    if paced:
        wanted = wanted.repartition(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, own = client(), make() if make else None
        slots = Slots(per_minute, TaskContext.get().partitionId() % lanes, lanes) if paced else Slots(0)
        for batch in batches:
            done = []
            for id_, prompt in zip(batch.column("id").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                key = question(id_, prompt, options)
                found = own.take(key) if own else None
                if found is None:
                    began = time.monotonic()
                    found = [*called(call, prompt or "", slots, attempts, **options), int((time.monotonic() - began) * 1000)]
                    if own:
                        own.note(key, found)
                done.append(found)
            columns = list(zip(*done, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(columns, list(ANSWERS)[1:], strict=True))], schema=ANSWERS)

    return wanted.mapInArrow(run, "id string, answer string, error string, ms long")


def json_answers(rows: DataFrame, client: Callable[[], Callable[..., str]], per_minute: float, attempts: int = ATTEMPTS, temperature: float | None = 0.2, **options) -> DataFrame:
    """id, json and error: the JSON text in each answer; an answer without one is an error of its own kind."""
    found = answers(rows, client, per_minute, attempts, temperature=temperature, response_mime_type="application/json", **options)
    return found.withColumn("json", extract_json(F.col("answer"))).select("id", "json", F.when(F.col("error").isNull() & F.col("json").isNull(), BAD_JSON).otherwise(F.col("error")).alias("error"))


def probes(models: DataFrame, client: Callable[[], Callable[..., str]], prompt: str, attempts: int = ATTEMPTS) -> DataFrame:
    """model, ok, message (the answer's first SHOWN characters, or the kind of failure) and latency_ms (0 where it failed) of each of models (model): a call to each."""
    found = answers(models.select(F.col("model").alias("id"), F.lit(prompt).alias("prompt")), client, 0, attempts, temperature=0)
    ok = F.col("error").isNull()
    return found.select(F.col("id").alias("model"), ok.alias("ok"), F.when(ok, F.substring(strip(F.col("answer")), 1, SHOWN)).otherwise(F.col("error")).alias("message"), F.when(ok, F.col("ms")).otherwise(0).alias("latency_ms"))
