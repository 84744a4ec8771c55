"""Keyword search over a table of passages in Parquet files, with an index that names the files to be read.

Beside the table there are postings: which three bytes in a row (a gram) are somewhere in which file's titles and texts, as
has_keyword() compares them. A text that holds a keyword holds all of its grams, so only files with all of them can have
matches; has_keyword() decides on their rows. The postings are sorted by gram, so a search reads the row groups of its own
keyword's grams and not the rest, however many files there are.

refresh() indexes files that are new or were changed, and writes a batch of postings; the batch counts once its list of files
is written, so one that was broken off counts for nothing. A search lists the table's files, and reads those that
are in no batch as they are now (path, size and time) besides the ones that the index names: an index that is behind costs
time and loses no row. Files that are gone are never named.

Defined cases. Null titles and texts are empty, blank keywords no test, as in has_keyword(). Keywords of fewer than three
bytes have no gram: all files are read. A table without rows gives none. The driver holds the list of files, as Spark itself
does to scan them, and no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import at
from .browse import has_keyword, searched

FILES = "path string, size long, at timestamp"
POSTINGS = "file int, gram int"
#: Texts are taken apart in slices of about so many bytes.
SLICE = 8 << 20


def grams_of(data: bytes) -> np.ndarray:
    """The different grams of some bytes, ascending."""
    x = np.frombuffer(data, np.uint8).astype(np.int32)
    return np.unique((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) if len(x) > 2 else np.zeros(0, np.int32)


def _of_file(batches):
    """(file, gram) once for each task and file: a mark for each gram, 16 MB, is kept for the file that is being read."""
    now, seen = None, np.zeros(1 << 24, np.bool_)

    def told():
        own = np.flatnonzero(seen).astype(np.int32)
        seen[own] = False
        for a in range(0, len(own), 1 << 16):
            part = own[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now, np.int32)), pa.array(part)], names=["file", "gram"])

    for batch in batches:
        step = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            files = part.column("file").to_numpy()
            for file in np.unique(files):
                if file != now:
                    yield from told()
                    now = file
                own = part.column("text").filter(pa.array(files == file)).to_pylist()
                seen[grams_of(b"\n".join(t.encode("utf-8", "surrogatepass") for t in own))] = True
    yield from told()


class KeywordIndex:
    def __init__(self, spark: SparkSession, table: str, path: str):
        """table: a folder or file of Parquet with title and text; path: the folder of the index, not within the table's."""
        self.spark, self.table, self.path = spark, table, path

    def _there(self, path: str) -> bool:
        store, found = at(self.spark, path)
        return store.exists(found)

    def _read(self):
        """A reader of single files that gives them the columns which folders of the table are named by."""
        store, found = at(self.spark, self.table)
        return self.spark.read.option("basePath", self.table) if store.getFileStatus(found).isDirectory() else self.spark.read

    def listed(self) -> DataFrame:
        """path, size, at of the table's files as they are now; nothing in them is read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.table)
        return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at"))

    def indexed(self) -> DataFrame:
        """path, size, at, batch, file of what refresh() has been through."""
        if not self._there(f"{self.path}/files"):
            return self.spark.createDataFrame([], f"{FILES}, file int, batch string")
        return self.spark.read.schema(f"{FILES}, file int, batch string").parquet(f"{self.path}/files")

    def _known(self) -> DataFrame:
        """listed(), with batch and file where indexed() has them."""
        return self.listed().join(self.indexed(), ["path", "size", "at"], "left")

    def refresh(self) -> int:
        """Index what isn't; how many files that was."""
        batch = uuid.uuid4().hex
        todo = sorted(self._known().where("batch IS NULL").select("path", "size", "at").collect())
        if not todo:
            return 0
        files = self.spark.createDataFrame([(*row, i) for i, row in enumerate(todo)], f"{FILES}, file int")
        rows = self._read().schema(self.spark.read.parquet(self.table).schema).parquet(*(row["path"] for row in todo)).select(F.col("_metadata.file_path").alias("path"), searched().alias("text"))
        told = rows.join(F.broadcast(files.select("path", "file")), "path").select("file", "text").mapInArrow(_of_file, POSTINGS)
        told.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.parquet(f"{self.path}/postings/batch={batch}")
        files.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.path}/files")
        return len(todo)

    def candidates(self, keyword: str) -> list[str]:
        """The files that may hold a keyword: those with all of its grams, and those that aren't indexed as they are now."""
        known = self._known()
        grams = grams_of(keyword.strip().lower().encode("utf-8", "surrogatepass")).tolist()
        if grams and self._there(f"{self.path}/postings"):
            some = self.spark.read.schema(f"{POSTINGS}, batch string").parquet(f"{self.path}/postings").where(F.col("gram").isin(grams))
            full = some.distinct().groupBy("batch", "file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
            known = known.where("batch IS NULL").unionByName(known.join(full.select("batch", "file"), ["batch", "file"], "left_semi").select(known.columns))
        return sorted(row["path"] for row in known.select("path").collect())

    def search(self, keyword: str | None) -> DataFrame:
        """The table's rows with the keyword, from the candidates alone."""
        test = has_keyword(keyword)
        if test is None:
            return self.spark.read.parquet(self.table)
        found, whole = self.candidates(keyword), self.spark.read.parquet(self.table)
        return self._read().schema(whole.schema).parquet(*found).where(test) if found else whole.where(F.lit(False))
