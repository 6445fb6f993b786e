"""Quality rules: a hashed n-gram logistic regression trained on labelled rows and calibrated.

At most SAMPLE labelled documents, chosen by hash, are used: four fifths to fit the weights, one
fifth to fit the calibration. All documents are scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import linear

SAMPLE = 5_000
KEEP, REJECT = 0.5, 0.2
RESULT = "doc_id long, probability double, verdict string, keep boolean"


@dataclass(frozen=True)
class Model:
    weights: bytes
    bias: float
    slope: float
    offset: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        z = linear.margins(column, np.frombuffer(self.weights, np.float32), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, quality, part) of at most sample labelled documents with text, half of them of either
    label as far as there are so many; part is 0 to 4 by hash."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"))
    halves = [good.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    # the sample's ids have a bounded number of rows
    ids = F.broadcast(halves[0].unionByName(halves[1]))
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("text", "quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).cast("int").alias("part"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The calibrated model. With no labelled rows of either kind all documents get probability 1
    or 0, whichever label there is; with none at all, 0.5."""
    rows = labelled(docs, labels, sample).toArrow()
    y, part = rows.column("quality").to_numpy().astype(float), rows.column("part").to_numpy()
    if len(set(y.tolist())) < 2:
        sure = 0.0 if not len(y) else 40.0 * (2 * y[0] - 1)
        return Model(np.zeros(linear.DIM, np.float32).tobytes(), sure, 1.0, 0.0)
    texts = rows.column("text").combine_chunks()
    held = part == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    fitted, yf = texts.filter(pa.array(~held)), y[~held]
    # both labels weigh the same in the fit; the calibration sets the level
    share = np.where(yf > 0.5, 0.5 / (yf > 0.5).sum(), 0.5 / (yf <= 0.5).sum())
    w, b = linear.train(fitted, yf, share=share)
    check, yc = (texts.filter(pa.array(held)), y[held]) if held.any() else (fitted, yf)
    slope, offset = linear.platt(linear.margins(check, w, b), yc)
    return Model(w.tobytes(), b, slope, offset)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, reject: float = REJECT) -> DataFrame:
    """(doc_id, probability, verdict, keep) of each row: verdict is keep from probability keep on,
    reject below probability reject, review between; the column keep is true for verdict keep.

    Null and blank texts have probability 0. Repeated rows get a row each, null doc_ids stay null,
    an empty table gives no rows. Labels of unknown or null doc_ids are not used; of several labels
    of a doc_id the lowest counts. Whole texts are scored; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                p = np.round(np.where(blank(part.column(1)), 0.0, model.probabilities(part.column(1))), 6)
                verdict = np.where(p >= keep, "keep", np.where(p < reject, "reject", "review"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(verdict.tolist(), pa.string()), pa.array(p >= keep)], ["doc_id", "probability", "verdict", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def blank(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(column)), 0), True).to_numpy(zero_copy_only=False)
