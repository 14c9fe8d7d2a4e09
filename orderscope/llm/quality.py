"""Quality by nearest-neighbour voting on latent-semantic vectors.

Fitting takes at most ``MAX_LABELLED`` labelled documents (in expectation; a
hash of the id picks them). A document's terms are hashed into ``TERMS`` bins:
n-grams of its text's shape (letters, capitals, digits, blanks and each
punctuation mark, runs of letters as one), its words, and repeats (a word equal
to the one or two before it, a line equal to an earlier one). Logarithmic term
frequencies, weighted by inverse document frequency, are projected on the
leading ``RANK`` directions of the labelled term-document matrix (latent
semantic analysis by subspace iteration) and scaled to unit length. The
labelled vectors are broadcast (their number and length are bounded); every
document takes exact cosines with all of them, block by block, and the
``NEIGHBOURS`` largest vote with their similarity.

Defined results: null or empty text has a zero vector; its neighbours are the
labelled empty texts, or, without any, its score is the share of label 1; a
null id or label, or a label other than 0 and 1, is not learnt; several labels of
one id count as the largest; without labels the score is 0.5; repeated rows
score alike; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orderscope.llm.common import ship_package, text_of
from orderscope.llm.toxicity import fold, sample_labels

MAX_LABELLED = 8_000
SHAPE_TERMS, WORD_TERMS = 1024, 512
TERMS = SHAPE_TERMS + WORD_TERMS + 3
RANK = 48
NEIGHBOURS = 15
ROWS = 256

_shape = np.zeros(256, np.int64)  # 0: letters
_shape[65:91] = 1
_shape[48:58] = 2
_shape[[9, 11, 12, 13, 32]] = 3
_shape[10] = 4
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
_shape[_marks] = 5 + np.arange(len(_marks))


def terms(text: str) -> np.ndarray:
    """Term counts of one text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    shape = _shape[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    runs = shape[np.concatenate([[True], (shape[1:] != shape[:-1]) | (shape[1:] > 4)])]
    for n, odd in ((1, 40503), (2, 40427), (3, 40009)):
        gram = np.zeros(max(0, len(runs) - n + 1), np.int64)
        for i in range(n):
            gram = gram * 64 + runs[i : i + len(gram)]
        out[:SHAPE_TERMS] += np.bincount((gram * odd + n) % 1000003 % SHAPE_TERMS, minlength=SHAPE_TERMS)
    words = text.lower().split()
    # crc32-like spread without per-word calls: length and first and last letters
    codes = np.array([(ord(w[0]) * 31 + ord(w[-1])) * 31 + len(w) for w in words], np.int64)
    out[SHAPE_TERMS:-3] = np.bincount(codes * 40503 % 1000003 % WORD_TERMS, minlength=WORD_TERMS)
    out[-3] = 8 * sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[-2] = 4 * sum(a == b for a, b in zip(words, words[2:], strict=False))
    lines = [line for line in text.split("\n") if line]
    out[-1] = 8 * (len(lines) - len(set(lines)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled documents x rank
    labels: np.ndarray
    share: float
    empty_share: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = (x / np.maximum(norm, 1e-9)) @ self.basis
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        x = self.project(counts)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(x), self.share)
        near = x @ self.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1).astype(float), 0)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-9)
        out = np.where(total > 1e-9, votes, self.share)
        return np.clip(np.where(counts.any(axis=1), out, self.empty_share), 0, 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(t.as_py()) for t in batch.column(1)]
        at = [np.flatnonzero(x).astype(np.int32) for x in found]
        values = [x[i] for x, i in zip(found, at, strict=True)]
        yield pa.record_batch(
            [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["label", "at", "value"]
        )


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    ship_package(spark)
    chosen = sample_labels(labels, label_col, id_col, MAX_LABELLED, keep)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(chosen, "_id")
    # At most MAX_LABELLED sparse rows (in expectation) reach the driver.
    rows = texts.select(F.col("_label").alias("label"), "text").mapInArrow(_count, "label int, at array<int>, value array<float>").toPandas()
    y = rows.label.to_numpy(float)
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        counts[i, np.asarray(at, int)] = value
    share = float(y.mean()) if len(y) else 0.5
    blank = ~counts.any(axis=1)
    empty_share = float(y[blank].mean()) if blank.any() else share
    weights = np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    model = Model(weights, np.eye(TERMS, RANK, dtype=np.float32), np.zeros((0, RANK), np.float32), y[:0], share, empty_share)
    counts, y = counts[~blank], y[~blank]
    if len(y):
        x = np.log1p(counts) * weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        q = np.linalg.qr(np.random.default_rng(4).normal(size=(TERMS, RANK + 8)))[0]
        for _ in range(6):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        model.basis = (q @ vt.T)[:, :RANK].astype(np.float32)
        model.vectors, model.labels = model.project(counts), y
    return model


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = model.vote(np.stack([terms(t.as_py()) for t in part.column("_text")]))
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every document with its score."""
    keep = [c for c in keep if c != "score"]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text_col).alias("_text"))
    schema = StructType([*chosen.schema.fields[:-1], StructField("score", DoubleType())])
    # MAX_LABELLED vectors of RANK numbers and the projection: under 3 MB.
    return chosen.mapInArrow(_score(spark.sparkContext.broadcast(model), keep), schema)


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(spark, docs, labels, fold("doc_id", 4) != 2)
    out = score(spark, docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
