"""Ranked lexical search over document intervals.

Every document's terms are counted once (``count_terms``): the stored counts
hold the terms that some query asks for, and the document's length. A search
reads them in blocks of documents. Of each block the posting list of every term
is laid out by document, with the impact (the term's share of a score) of every
posting, and a sparse table of range maxima over the lists. A query starts with
the whole block as one interval. The interval with the highest bound, the sum
of its terms' range maxima, is taken first; it is split at the document that
holds its largest single impact, that document is scored exactly, and the parts
left and right of it get bounds of their own. A block is done when no
interval's bound reaches the score of the last place. Intervals are taken
``WIDTH`` at a time, so that all bounds of a step are one array operation.

A task keeps its places from block to block, so later blocks start with a high
bar, and gives at most ``k`` rows per query to the final ranking. Nothing is
shuffled but those rows. Queries are searched in batches of at most
``BATCH_TERMS`` (query, term) pairs, which bounds what is broadcast, however many
queries there are; all batches together give the whole answer.

Defined results: the rows of one query id are one query with the terms of all
of them; a null query id is an id like others; repeated documents rank each on
their own, equal scores by document id, null ids last; a null text has no
terms; documents without terms count in no statistic; an empty table of
documents or queries, or a query without a known term, gives no rows; other
columns are not touched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderscope.llm.common import materialise, scratch_session, ship_package

K = 10
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 20
WIDTH = 256
BATCH_TERMS = 1 << 20

# Bytes of UTF-8 that belong to a term (letters, digits and all of a code point
# above 127), A to Z lower-cased; every other byte becomes a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
NO_ID = np.iinfo(np.int64).max  # a null document id in the search: after all others

COUNTED = "id long, n long, terms array<int>, counts array<int>"
FOUND = "query int, id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, term = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = sorted(set(terms_of(text)))
            row += [i] * len(found)
            term += found
        yield pa.record_batch([batch.column("id").take(pa.array(row, pa.int64())), pa.array(term, pa.binary())], names=["id", "term"])


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term)``, each pair once."""
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_query_terms, "id long, term binary").distinct()


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                held = Counter(words)
                own = sorted((known[t], c) for t, c in held.items() if t in known)
                n.append(len(words))
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, kind), pa.array(counts, kind)], names=["id", "n", "terms", "counts"])

    return run


def count_terms(spark: SparkSession, docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """One row per document: its length in terms, and the given terms (by their
    place in ``terms``) that it holds, with their counts."""
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count(shared), COUNTED)


class Block:
    """Posting lists of one block of documents, with range maxima.

    All lists lie in one array, by (term, document); a window of the sparse
    table is only ever read inside one list."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        order = np.lexsort((doc, term))
        self.docs = docs
        self.key = term[order].astype(np.int64) * docs + doc[order]
        self.impact = np.append(impact[order], 0)
        self.doc = np.append(doc[order], docs)
        edges = np.searchsorted(self.key, np.arange(terms + 1, dtype=np.int64) * docs)
        self.start, self.end = edges[:-1], edges[1:]
        longest = int((self.end - self.start).max(initial=1))
        self.levels = [np.arange(len(self.key), dtype=np.int32)]
        while 2 ** len(self.levels) <= longest:
            half, last = 2 ** (len(self.levels) - 1), self.levels[-1]
            left, right = last[:-half], last[half:]
            self.levels.append(np.where(self.impact[left] >= self.impact[right], left, right))
        # Windows that start too near the end are never asked for.
        self.table = np.zeros((len(self.levels), max(1, len(self.key))), np.int32)
        for k, level in enumerate(self.levels):
            self.table[k, : len(level)] = level
        self.levels = []

    def top(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact of each posting range ``[lo, hi)``; the
        place after the last posting (of impact 0) for an empty range."""
        n = hi - lo
        k = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
        some = n > 0
        a = self.table[k, np.where(some, lo, 0)]
        b = self.table[k, np.where(some, hi - (1 << k), 0)]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(some, best, len(self.key))


def search_block(block: Block, ids: np.ndarray, terms: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ``k`` first of ``best`` and the block's documents as ``(-score,
    id)``, first place first. ``ids`` ascend with the block's documents."""
    lo, hi = block.start[terms], block.end[terms]
    held = hi > lo
    terms, lo, hi = terms[held], lo[held][None, :], hi[held][None, :]
    if not len(terms):
        return best
    base = terms.astype(np.int64)[None, :] * block.docs
    at = block.top(lo, hi)
    gain = block.impact[at]
    bound, first = gain.sum(axis=1), np.zeros(1, np.int64)
    while len(bound):
        bar, bar_id = (-best[-1][0], best[-1][1]) if len(best) == k else (0, -1)
        # Equal bounds can still win the last place by a smaller id.
        alive = np.flatnonzero((bound > bar) | ((bound == bar) & (bound > 0) & (ids[np.minimum(first, block.docs - 1)] < bar_id)))
        if not len(alive):
            break
        turn = alive[np.argsort(-bound[alive], kind="stable")]
        now, rest = turn[:WIDTH], turn[WIDTH:]
        row = np.arange(len(now))
        pick = at[now][row, gain[now].argmax(axis=1)]  # the largest single impact of each interval
        split = block.doc[pick]
        place = np.searchsorted(block.key, base + split[:, None])
        there = (place < hi[now]) & (block.doc[place] == split[:, None])
        score = np.where(there, block.impact[place], 0).sum(axis=1)
        best = sorted(best + list(zip((-score).tolist(), ids[split].tolist(), strict=True)))[:k]
        left = (lo[now], place, first[now])
        right = (place + there, hi[now], split + 1)
        new = [np.concatenate(pair) for pair in zip(left, right, strict=True)]
        new_at = block.top(new[0], new[1])
        new_gain = block.impact[new_at]
        lo, hi, first = (np.concatenate([old[rest], fresh]) for old, fresh in zip((lo, hi, first), new, strict=True))
        at, gain = np.concatenate([at[rest], new_at]), np.concatenate([gain[rest], new_gain])
        bound = np.concatenate([bound[rest], new_gain.sum(axis=1)])
    return best


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, all_terms: int) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of a task's documents, in the order of their ids."""

    def block(held: list[pa.RecordBatch]) -> tuple[Block, np.ndarray]:
        rows = pa.Table.from_batches(held)
        ids = rows.column("id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        lengths = rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(rank, lengths)
        term = rows.column("terms").combine_chunks().flatten().to_numpy().astype(np.int64)
        tf = rows.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * rows.column("n").to_numpy() * n_docs) // max(1, all_terms)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, lengths)))
        return Block(doc, term, impact, len(ids), len(weights)), ids[order]

    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield block(held)
            held, docs, postings = [], 0, 0
    if docs:
        yield block(held)


def _search(shared, n_docs: int, all_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for block, ids in _blocks(batches, weights, n_docs, all_terms):
            for q, terms in enumerate(queries):
                best[q] = search_block(block, ids, terms, k, best[q])
        rows = [(q, None if i == NO_ID else i, -s) for q, found in enumerate(best) for s, i in found if s < 0]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query", "id", "score"])

    return run


def search(
    spark: SparkSession,
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's ``k`` best documents."""
    ship_package(spark)
    own = scratch_session(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "2048"})
    asked = query_terms(queries, query_id_col, query_text_col)
    asked = materialise(spark, asked, "asked")
    batches = math.ceil(asked.count() / BATCH_TERMS)
    found = None
    for number in range(batches):
        pairs = asked.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == number).orderBy(F.col("id").asc_nulls_first(), "term").toArrow()  # BATCH_TERMS rows in expectation
        one = _search_batch(own, docs, pairs, k, id_col, text_col)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _search_batch(own: SparkSession, docs: DataFrame, pairs: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame:
    # Ids in the order of the pairs, which is theirs; a null id is one of them.
    ids = list(dict.fromkeys(pairs.column("id").to_pylist()))
    terms = sorted(set(pairs.column("term").to_pylist()))
    place = {t: i for i, t in enumerate(terms)}
    counted = materialise(own, count_terms(own, docs, terms, id_col, text_col), "counted")
    # Two rows and one per asked term reach the driver.
    total = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(terms), np.int64)
    df[held.column("term").to_numpy()] = held.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    asked: dict[int | None, list[int]] = {i: [] for i in ids}
    for i, t in zip(pairs.column("id").to_pylist(), pairs.column("term").to_pylist(), strict=True):
        if weights[place[t]] > 0:
            asked[i].append(place[t])
    shared = own.sparkContext.broadcast((weights, [np.array(asked[i], np.int64) for i in ids]))
    found = counted.where("size(terms) > 0").mapInArrow(_search(shared, total["docs"], total["terms"], k), FOUND)
    names = own.createDataFrame(list(enumerate(ids)), "query int, query_id long")  # as many as the batch has queries
    return found.join(names, "query").select("query_id", "id", "score")


def op11_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = search(spark, docs, items)
    return found.select(F.col("query_id").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, g GROUP BY term, big_n),
s AS (
  SELECT item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), g
  GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s WHERE score > 0)
WHERE rank <= 10
"""
