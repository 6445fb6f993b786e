"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A ledger is a folder that all executors share. Each committed batch writes the new totals as a
table of its own and then one manifest, moved to its number by a rename that fails if that is taken:
a manifest is what makes a batch count, so a job that dies half-way leaves the totals as they were.
A mark named by the batch's hash says that it was applied; the last manifest's mark is made up for
if a job died before it. So a batch costs a look at one manifest and one mark, however many were
before, and is never applied again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tokenizer import VOCABULARY, tokenizer

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def counted(docs: DataFrame, version: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) for each row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            n = pa.array([own.count(t.as_py() or "") for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * batch.num_rows, pa.string()), n], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return part.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(rows: DataFrame) -> DataFrame:
    """Deltas of counted rows that come in."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Deltas of counted rows that go."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of rows whose count, source or language changes: the old rows go, the new come in."""
    return deletes(old).unionByName(inserts(new))


class Ledger:
    """Rolled-up totals in a folder, changed by batches that each count once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, what: str) -> list[str]:
        folder = self._path(f"{self.path}/{what}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, path, content: dict) -> None:
        self._fs.mkdirs(path.getParent())
        stream = self._fs.create(path, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def _create(self, name: str, content: dict) -> bool:
        """Writes the file whole under another name, then moves it: false if the name is taken."""
        draft, final = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._fs.makeQualified(self._path(f"{self.path}/{name}"))
        self._write(draft, content)
        self._fs.mkdirs(final.getParent())
        jvm = self.spark._jvm
        nothing = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), final, nothing)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def _last(self) -> tuple[int, dict | None]:
        """How many commits there are, and the manifest of the last one, whose mark is there then."""
        names = self._names("commits")
        if not names:
            return 0, None
        last = self._read(names[-1])
        mark = self._path(f"{self.path}/applied/{last['key']}")
        if not self._fs.exists(mark):
            self._write(mark, {"commit": names[-1]})
        return len(names), last

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of the last commit."""
        _, last = self._last()
        if last is None:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(last["totals"])

    def applied(self, batch_id: str) -> bool:
        self._last()
        return self._fs.exists(self._path(f"{self.path}/applied/{hashlib.sha256(batch_id.encode()).hexdigest()}"))

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds the deltas (KEYS, docs, tokens) to the totals, unless the batch has been applied.

        Null keys are keys of their own; null amounts count as 0; groups whose totals are both 0
        go; an empty batch is committed too. Of two writers at once one fails and may be run again.
        """
        if self.applied(batch_id):
            return False
        n, last = self._last()
        # each delta frame is summed map-side; only group totals are shuffled
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        before = self.spark.createDataFrame([], TOTALS) if last is None else self.spark.read.schema(TOTALS).parquet(last["totals"])
        merged = before.unionByName(summed).groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), F.lit(0)).cast("long").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
        where = f"{self.path}/totals/{uuid.uuid4().hex}"
        merged.where((F.col("docs") != 0) | (F.col("tokens") != 0)).write.parquet(where)
        if not self._create(f"commits/{n:010d}", {"key": hashlib.sha256(batch_id.encode()).hexdigest(), "batch": batch_id, "totals": where}):
            raise RuntimeError("another writer committed at the same time; apply the batch again")
        self._last()
        return True


def token_counts(docs: DataFrame, path: str, batch_id: str = "load", version: str = "byte_bpe_50k", vocabulary: str = VOCABULARY) -> DataFrame:
    """Loads all of docs as one batch of inserts into the ledger at path and returns its totals.

    Rows with null source or language form groups of their own; repeated rows count as often as
    they stand there; an empty table gives the ledger's former totals; other columns are not read.
    """
    ledger = Ledger(docs.sparkSession, path)
    ledger.apply(batch_id, inserts(counted(docs, version, vocabulary)))
    return ledger.totals()
