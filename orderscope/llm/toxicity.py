"""Toxicity by maximum-scoring segments of token log-odds.

Fitting takes at most ``MAX_LABELLED`` labelled documents (in expectation; a
hash of the id picks them); of texts of one label with the same minwise
five-word shingle one counts, and a word counts once in a text, so copies, near
copies and repetition don't pass for evidence. Words get the
log-odds of the toxic against the clean class under a Dirichlet prior spread as
the classes are; words that are not significant by themselves are pooled by their first letters, which catches
inflected forms. A token of the lexicon scores its log-odds, any other token
``-DRIFT``. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments
of a document. On clean training documents the scores follow an extreme-value law:
lambda solves the null equation of the token scores, K is its maximum
likelihood estimate. A document's evidence is the best over r of the surprise of its
r-th best segment, and a logistic curve turns evidence into a probability.

Defined results: null and empty text have no tokens and get the score of no
evidence; a document without a usable label, or with a null id, is scored all
the same; several labels of one id count as their largest; without labels of
both classes every score is the smoothed share of toxic labels (0.5 with none);
repeated rows score alike; an empty table gives no rows; other columns are
not touched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderscope.llm.common import materialise, ship_package, text_of
from orderscope.llm.jaccard_join import shingles

MAX_LABELLED = 30_000
PRIOR = 10.0
DRIFT = 0.5
SIGNIFICANT = 4.0
# Least log-odds of the lexicon: six times likelier in toxic texts.
LEAST_ODDS = math.log(6)
STEM = 4
WORD = re.compile(r"[^\W\d_]+")


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % folds


def sample_labels(labels: DataFrame, label_col: str, id_col: str, most: int, keep: Column) -> DataFrame:
    """``(id, label)`` of the training rows, thinned by hash to ``most`` in
    expectation (all of them, if there are no more)."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & keep)
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    share = min(1.0, most / max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        lexicon, stems = self.lexicon, self.stems
        out = []
        for i, w in enumerate(tokens):
            s = lexicon.get(w) or stems.get(w[:STEM])
            if s:
                out.append((i, s))
        return out

    def evidence(self, n: int, segments: list[float]) -> float:
        """Surprise of the r-th best segment, at its best r: Chernoff's bound on
        seeing r segments where the extreme-value law expects E."""
        best = 0.0
        for r, s in enumerate(sorted(segments, reverse=True), 1):
            log_e = math.log(self.k * max(n, 1)) - self.lam * s
            if math.log(r) > log_e:
                best = max(best, r * (math.log(r) - log_e) - r + math.exp(log_e))
        return best

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.intercept))))


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end exclusive, score)`` of the
    token scores: each hit its own, every other token ``-drift``. Linear time:
    candidates are kept with their cumulative sums before and after."""
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier candidate with a smaller sum before
    total, at = 0.0, 0
    for position, score in hits:
        total -= drift * (position - at)
        at = position + 1
        start, end, left, total = position, position + 1, total, total + score
        right = total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, end, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]
            after = stack[j][4]
            del stack[j:]
            j = after
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a text's word shingles, equal for most near copies."""
    for batch in batches:
        least = [int(h[0]) >> 1 if len(h) else 0 for h in (shingles(t.as_py()) for t in batch.column(1))]
        yield pa.record_batch([*batch.columns, pa.array(least, pa.int64())], names=["label", "text", "kin"])


def _log_odds(toxic: Column, clean: Column, share: float) -> tuple[Column, Column]:
    """Log-odds against the class share under the prior, and their z value."""
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    odds = F.log(a / b) - math.log(share / (1 - share))
    return odds, odds / F.sqrt(1 / a + 1 / b)


def _lexicon(counts: DataFrame, unit: str, share: float) -> DataFrame:
    odds, z = _log_odds(F.col("toxic"), F.col("clean"), share)
    scored = counts.select(unit, odds.alias("odds"), z.alias("z"))
    return scored.where((F.col("z") >= SIGNIFICANT) & (F.col("odds") >= LEAST_ODDS))


SEGMENTS = "label int, n int, found array<double>, hit array<double>"


def _segments_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, hit = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = words(text)
                hits = model.hits(tokens)
                n.append(len(tokens))
                hit.append([s for _, s in hits])
                found.append([s for _, _, s in segments(hits)])
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip((n, found, hit), kinds, strict=True))], names=["label", "n", "found", "hit"])

    return run


def _null_rate(hits: np.ndarray, tokens: float) -> float:
    """The lambda at which the null token scores have an expected exponential of 1."""
    p, high = hits.size / tokens, 20.0
    if p <= 0:
        return 1.0

    def excess(x: float) -> float:
        return float(np.exp(x * hits - math.log(hits.size)).sum() * p + (1 - p) * math.exp(-x * DRIFT)) - 1

    low = 1e-3
    if excess(low) >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        w = w + np.linalg.solve(hess, design.T @ (y - p) - ridge * w)
    return float(w[0]), float(w[1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    ship_package(spark)
    chosen = sample_labels(labels, label_col, id_col, MAX_LABELLED, keep)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(chosen, "_id").select(F.col("_label").alias("label"), "text")
    once = texts.mapInArrow(_kin, "label int, text string, kin long").groupBy("label", "kin").agg(F.max("text").alias("text")).select("label", "text")
    train = materialise(spark, once, "train")
    by_class = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    model = Model()
    if len(by_class) < 2:
        known = sum(by_class.values())
        p = (by_class.get(1, 0) + 1) / (known + 2)
        model.intercept = math.log(p / (1 - p))
        return model
    # Bounded by the sample: one row per word of at most MAX_LABELLED texts.
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))
    tokens = train.select("label", F.explode(F.array_distinct(found)).alias("word"))
    counted = tokens.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    counted = materialise(spark, counted, "words")
    sums = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not sums["t"] or not sums["c"]:
        return model
    share = sums["t"] / (sums["t"] + sums["c"])
    own = materialise(spark, _lexicon(counted, "word", share), "lexicon")
    rest = counted.join(own, "word", "left_anti").where(F.char_length("word") > STEM)
    pooled = rest.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model.lexicon = {r["word"]: r["odds"] for r in own.collect()}
    model.stems = {r["stem"]: r["odds"] for r in _lexicon(pooled, "stem", share).collect()}
    seen = train.select("label", "text").mapInArrow(_segments_of(model), SEGMENTS).toPandas()
    clean = seen[seen.label == 0]
    hits = np.concatenate([np.asarray(h, float) for h in clean.hit]) if len(clean) else np.zeros(0)
    # One more of each score than seen: scores that clean texts never show
    # still get a rate.
    hits = np.concatenate([hits, np.fromiter([*model.lexicon.values(), *model.stems.values()], float)])
    model.lam = _null_rate(hits, float(clean.n.sum()) + hits.size)
    top = np.array([max(f, default=0.0) for f in clean.found])
    model.k = len(clean) / max(1e-9, float((np.maximum(clean.n, 1) * np.exp(-model.lam * top)).sum()))
    x = np.array([math.log1p(model.evidence(n, list(f))) for n, f in zip(seen.n, seen.found, strict=True)])
    model.slope, model.intercept = _logistic(x, seen.label.to_numpy(float))
    return model


SCORED = "score double, n_passages int, passages array<struct<start:int,end:int,score:double>>"
_PASSAGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _score(model: Model, names: list[str]):
    """Adds the score and the significant passages (token offsets; expected less
    than once in a clean text of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("_text").to_pylist():
                tokens = words(text)
                found = segments(model.hits(tokens))
                scores.append(model.probability(model.evidence(len(tokens), [s for _, _, s in found])))
                least = math.log(max(model.k * max(len(tokens), 1), 1e-300)) / model.lam
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in found if s > least])
            added = [pa.array(scores, pa.float64()), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, _PASSAGE)]
            yield pa.record_batch([*(batch.column(c) for c in names), *added], names=[*names, "score", "n_passages", "passages"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every document with its score and passages."""
    keep = [c for c in keep if c not in ("score", "n_passages", "passages")]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text_col).alias("_text"))
    schema = StructType([*chosen.schema.fields[:-1], *StructType.fromDDL(SCORED).fields])
    return chosen.mapInArrow(_score(model, keep), schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` without those scored 0.5 or more; labels are learnt outside fold 0."""
    model = fit(spark, docs, labels, fold("doc_id", folds) != 0)
    names = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), "text")
    return score(renamed, model, ["_doc"]).where("score < 0.5").select(*[F.col(f"_doc.`{c}`") for c in names])


def op5_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(spark, docs, labels, fold("doc_id", 5) != 0)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
