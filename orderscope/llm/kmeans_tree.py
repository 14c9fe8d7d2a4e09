"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most ``FIT_ROWS`` distinct vectors (in expectation; a
hash picks them) by splitting into ``BRANCH`` clusters until a node is small.
Every vector is then indexed: it goes down the tree to its leaf. A query walks
the tree best bin first: a priority queue holds nodes by their centre's inner
product with the query, the best is opened, leaves are visited in that order.
How many leaves to visit is calibrated: for a sample of queries the exact
neighbours are found by brute force in blocks, and the visits are widened until
``RECALL`` of them lie in visited leaves (always until enough vectors for a
whole answer are seen). A query meets all its visited leaves below one node of
the second level (a bucket) at once, in blocks of bounded size, so a bucket may hold
any share of the vectors, and gives one answer per bucket, not per leaf.

Equal vectors are one indexed row with its ``k + 1`` smallest ids: no answer can
need more. Scores are inner products in double precision, summed alike for
equal vectors, ties to the smaller id.

Defined results: rows with a null id take no part, nor vectors that are null,
zero, hold a null or non-finite number, or have another length than most (an
inner product with them has no value); of several vectors of one id the
smallest, number by number, counts, as query and as candidate; an empty table,
or no query, gives no rows; other columns are not touched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderscope.llm.common import materialise, ship_package

K = 20
FIT_ROWS = 20_000
BRANCH = 12
LEAF_ROWS = 48
BUCKET_LEVEL = 2
RECALL = 0.97
PROBES = 300
BLOCK = 4096


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)  # of each inner node's children
    children: list[list[int]] = field(default_factory=list)  # >= 0: inner node, < 0: leaf ~id
    leaves: int = 0
    bucket: list[int] = field(default_factory=list)  # of each leaf: the node of level BUCKET_LEVEL above it

    def fit(self, x: np.ndarray, seed: int = 9) -> int:
        """Build the node over ``x``; its reference (see ``children``)."""
        rng = np.random.default_rng(seed)
        if len(x) <= LEAF_ROWS:
            self.leaves += 1
            return ~(self.leaves - 1)
        centre = x[rng.choice(len(x), BRANCH, replace=False)]
        for _ in range(12):
            near = _nearest(x, centre)
            centre = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(BRANCH)])
        near = _nearest(x, centre)
        parts = [x[near == j] for j in range(BRANCH)]
        if max(map(len, parts)) == len(x):
            self.leaves += 1
            return ~(self.leaves - 1)
        me = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.children[me] = [self.fit(p, seed + 1 + j) for j, p in enumerate(parts)]
        return me

    def name_buckets(self) -> None:
        """Number the nodes of level ``BUCKET_LEVEL`` and leaves above it."""
        self.bucket = [0] * self.leaves
        queue, buckets = [(0 if self.centres else -1, 0, -1)], 0
        while queue:
            node, level, bucket = queue.pop()
            if bucket < 0 and (level == BUCKET_LEVEL or node < 0):
                bucket, buckets = buckets, buckets + 1
            if node < 0:
                self.bucket[~node] = bucket
            else:
                queue += [(child, level + 1, bucket) for child in self.children[node]]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if self.centres else np.full(len(x), -1)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                rows = np.flatnonzero(at == node)
                at[rows] = np.array(self.children[node])[_nearest(x[rows], self.centres[node])]
        return ~at

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield ~node
                continue
            for score, child in zip((self.centres[node] @ q).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-score, child))


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre * centre).sum(axis=1) - 2 * (x @ centre.T), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(x: np.ndarray) -> pa.Array:
    width = x.shape[1] if len(x) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel(), pa.float64()))


INDEXED = "rid long, bucket int, leaf int, n int, ids array<long>, vector array<double>"
TURNS = "query_id long, leaf int, turn int"
ASKED = "query_id long, bucket int, leaves array<int>"
SLICE = 1 << 16  # rows of one Arrow batch of visits


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            leaf = shared.value.leaf_of(x) if len(x) else np.zeros(0, np.int64)
            n = pa.array([len(i) for i in batch.column("ids")], pa.int32())
            bucket = pa.array(np.array(shared.value.bucket)[leaf], pa.int32())
            columns = [batch.column("rid"), bucket, pa.array(leaf, pa.int32()), n, batch.column("ids"), _lists(x)]
            yield pa.record_batch(columns, names=["rid", "bucket", "leaf", "n", "ids", "vector"])

    return run


def _ask(shared, visits: int, sizes: dict[int, int], k: int):
    """The first ``visits`` leaves of each query, and more until ``k`` others are
    seen: one row per bucket with the leaves visited there, without the vector,
    in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for me, q in zip(batch.column("query_id").to_pylist(), _matrix(batch.column("vector")), strict=True):
                taken: dict[int, list[int]] = {}
                seen = n = 0
                for at in shared.value.walk(q):
                    if n >= visits and seen > k:
                        break
                    if at in sizes:
                        taken.setdefault(shared.value.bucket[at], []).append(at)
                        n += 1
                        seen += sizes[at]
                rows += [(me, bucket, leaves) for bucket, leaves in taken.items()]
                if len(rows) >= SLICE:
                    yield _batch(rows, ("query_id", pa.int64()), ("bucket", pa.int32()), ("leaves", pa.list_(pa.int32())))
                    rows = []
            yield _batch(rows, ("query_id", pa.int64()), ("bucket", pa.int32()), ("leaves", pa.list_(pa.int32())))

    return run


def _turns(shared, sizes: dict[int, int]):
    """When each query would come to each of the leaves in its column ``leaves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for me, leaves, q in zip(batch.column("query_id").to_pylist(), batch.column("leaves").to_pylist(), _matrix(batch.column("vector")), strict=True):
                left = set(leaves)
                for turn, at in enumerate(x for x in shared.value.walk(q) if x in sizes):
                    if at in left:
                        left.remove(at)
                        rows.append((me, at, turn))
                    if not left:
                        break
            yield _batch(rows, ("query_id", pa.int64()), ("leaf", pa.int32()), ("turn", pa.int32()))

    return run


def _batch(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.record_batch([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


FOUND = "query_id long, vec_id long, score double"


def _products(asked: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, candidates and their products; minus infinity where the query
    doesn't visit the candidate's leaf (a null list of leaves visits all)."""
    q, x = (_matrix(t.column("vector").combine_chunks()) for t in (asked, held))
    visited = asked.column("leaves").to_pylist()
    if visited[0] is None:
        return q, x, q @ x.T
    near = np.full((len(q), len(x)), -np.inf)
    by_leaf: dict[int, list[int]] = {}
    for i, leaves in enumerate(visited):
        for leaf in leaves:
            by_leaf.setdefault(leaf, []).append(i)
    leaf_of = held.column("leaf").to_numpy()
    order = np.argsort(leaf_of, kind="stable")
    cuts = np.flatnonzero(np.diff(leaf_of[order])) + 1
    for rows in np.split(order, cuts):
        askers = by_leaf.get(int(leaf_of[rows[0]]))
        if askers:
            near[np.ix_(askers, rows)] = q[askers] @ x[rows].T
    return q, x, near


def _meet(k: int):
    """Exact products of a block of queries with a block of candidates: each
    query's best k."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            q, x, products = _products(asked, held)
            ids = held.column("ids").to_pylist()
            for me, vector, near in zip(asked.column("query_id").to_pylist(), q, products, strict=True):
                # One more than k vectors (one may be the query's own), with all
                # that come within rounding of the last.
                top = np.flatnonzero(near > -np.inf)
                if len(top) > k + 1:
                    least = np.partition(near, len(x) - k - 1)[len(x) - k - 1]
                    top = np.flatnonzero(near >= least - 1e-9 * max(1.0, abs(least)))
                exact = (x[top] * vector).sum(axis=1).tolist()
                best = sorted((-s, i) for s, j in zip(exact, top.tolist(), strict=True) for i in ids[j] if i != me)[:k]
                out += [(me, i, -s) for s, i in best]
        return pa.Table.from_batches([_batch(out, ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))])

    return run


def _joined(asked: DataFrame, indexed: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Best k per query. ``counts`` has the blocks of queries (``qb``) and of
    candidates (``cb``) of each bucket."""
    left = asked.join(counts, "bucket").withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.col("qb")))
    left = left.withColumn("cblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cb") - 1))).drop("qb", "cb")
    right = indexed.join(counts, "bucket").withColumn("cblock", F.pmod(F.xxhash64("rid"), F.col("cb")))
    right = right.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1))).drop("qb", "cb")
    keys = ("bucket", "qblock", "cblock")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    spark: SparkSession,
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows where ``is_query``, a
    condition on ``id``."""
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull()).where(usable("vector"))
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # One vector per id: a partial aggregate, so an id with very many rows is cheap.
    rows = rows.where(F.size("vector") == width["w"]).groupBy("id").agg(F.min("vector").alias("vector"))
    # The k + 1 smallest ids of each vector: a window limit that map tasks apply
    # before the shuffle, so a vector that a third of the rows share is cheap.
    order = Window.partitionBy("vector").orderBy("id")
    firsts = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    once = firsts.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    once = materialise(spark, once.select(F.monotonically_increasing_id().alias("rid"), "ids", "vector"), "vectors")
    share = min(1.0, FIT_ROWS / max(1, once.count()))
    sample = once.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("rid", "vector").toArrow()  # FIT_ROWS rows in expectation
    x = _matrix(sample.column("vector").combine_chunks())[np.argsort(sample.column("rid").to_numpy())]
    tree = Tree()
    tree.fit(x)
    tree.name_buckets()
    shared = spark.sparkContext.broadcast(tree)
    indexed = materialise(spark, once.mapInArrow(_index(shared), INDEXED), "indexed")
    per_leaf = indexed.groupBy("bucket", "leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    sizes = {r["leaf"]: r["n"] for r in per_leaf.collect()}  # one row per leaf of the tree

    queries = materialise(spark, rows.where(is_query).select(F.col("id").alias("query_id"), "vector"), "queries")
    chance = min(1.0, PROBES / max(1, queries.count()))
    probes = materialise(spark, queries.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(1 << 30)) < int(chance * (1 << 30))), "probes")
    # Calibration: brute force in blocks finds the probes' true neighbours, whose
    # leaves the probes then look for: at most k rows a probe.
    blocks = indexed.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).alias("cb")).select(F.lit(0).alias("bucket"), "cb", F.lit(1).cast("long").alias("qb"))
    anywhere = probes.select("query_id", F.lit(0).alias("bucket"), F.lit(None).cast("array<int>").alias("leaves"), "vector")
    true = _joined(anywhere, indexed.withColumn("bucket", F.lit(0)), blocks, k).select("query_id", "vec_id")
    where = indexed.select("leaf", F.explode("ids").alias("vec_id"))
    near = materialise(spark, true.join(where, "vec_id").select("query_id", "leaf"), "true_leaves")
    wanted = near.groupBy("query_id").agg(F.collect_set("leaf").alias("leaves"))
    turns = probes.join(wanted, "query_id").mapInArrow(_turns(shared, sizes), TURNS)
    needed = np.sort([r["turn"] for r in near.join(turns, ["query_id", "leaf"]).select("turn").collect()])  # k per probe
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1

    visited = materialise(spark, queries.mapInArrow(_ask(shared, visits, sizes, k), ASKED), "visited")
    asked = visited.join(queries, "query_id")
    counts = visited.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).alias("qb"))
    counts = counts.join(per_leaf.groupBy("bucket").agg(F.ceil(F.sum("rows") / BLOCK).alias("cb")), "bucket")
    found = _joined(asked, indexed, materialise(spark, counts, "counts"), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, vectors, F.col("id") % 20 == 0)
