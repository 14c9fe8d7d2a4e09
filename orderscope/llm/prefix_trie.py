"""The trie of conversation prefixes, from sorted turn-id matrices.

A turn is identified by 128 bits of the SHA-256 of its role and text, and a
conversation is the sequence of these. Conversations are range-sharded by
(sequence, id) and written, so a shard is a run of the total order and rows
with a common prefix are neighbours. A task takes one shard, numbers its turns
densely (in their byte order), and goes through bands of columns of the padded
turn-id matrix: ``numpy.lexsort`` orders the rows that go on, changes between
neighbours, OR-accumulated along the columns, mark where nodes start, and
``reduceat`` sums over each node's rows, for every depth. Bands keep the matrix
within ``CELLS`` cells however long one conversation is.

Nodes on the path of a shard's first or last row may go on in the shards next to
it. Every shard knows the last row before it and the first row after it, counts a
node's start, and whether it is a leaf, only where it really starts or ends, and so all
sums are additive: such boundary nodes are summed by node, all others are
complete. The ids that end at a boundary node are digested by one streaming pass
over its chunks of ``CHUNK`` ids in order, as SHA-256 can't be split; it holds one
chunk at a time.

Defined results: rows with a null conversation id take no part; a null role
or text is empty; turns are ordered by turn, null first, equal turn numbers by
the digest of their role and text; repeated rows are turns of their own; an empty
table gives no node, not even a root; ids may be negative (``c - c % 100`` then
truncates towards zero); other columns are not touched. One conversation's turn
ids, 16 bytes a turn, must fit a task; its texts needn't.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderscope.llm.common import materialise, ship_package

SHARD_TURNS = 200_000
CELLS = 1 << 22
CHUNK = 4096
WIDTH = 16  # bytes of a turn id

NODES = (
    "shard int, node binary, parent binary, depth long, edge boolean, low long, parent_low long, "
    "n long, children long, leaves long, saved long, ends string, chunk_low long, chunk string"
)
NAMES = [c.split()[0] for c in NODES.split(", ")]
KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.string()]
ROOT = b"\0" * WIDTH
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, base, turns)``: each conversation's turns in order, as structs
    ``(key, points)``; partitioned by ``base``, the first id of its hundred."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    one = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"),
        F.substring(key, 1, 2 * WIDTH).alias("key"), F.char_length(text).alias("points"),
    )
    one = one.select(F.expr("id - id % 100").alias("base"), "*").repartition("base")
    held = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "points")))
    listed = one.groupBy("base", "id").agg(held.alias("held"))
    return listed.select("id", "base", F.transform("held", lambda t: F.struct(t["key"].alias("key"), t["points"].alias("points"))).alias("turns"))


def rebuilt(conversations: DataFrame, taken: Column) -> DataFrame:
    """``sequences`` whose first ``taken`` (at most 5) turns are those of the
    conversation whose id is ``base``. A hundred ids share a base, so the window
    holds at most that many rows."""
    head = F.max(F.when(F.col("id") == F.col("base"), F.slice("turns", 1, 5))).over(Window.partitionBy("base"))
    given = conversations.withColumn("head", head).withColumn("h", taken)
    turns = F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))),
    )
    return given.select("id", turns.alias("turns"))


def _matrix(ids: np.ndarray, start: np.ndarray, length: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Columns ``lo .. hi - 1`` of the padded matrix of turn ids; -1 pads."""
    column = np.arange(lo, hi)
    there = column[None, :] < length[:, None]
    at = np.where(there, start[:, None] + column[None, :], 0)
    return np.where(there, ids[at], -1)


def _common(a: bytes, b: bytes) -> int:
    """The turns that two sequences share at their beginning."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s[:n], np.uint8) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return (int(differ[0]) if len(differ) else n) // WIDTH


def _shard_nodes(shard: int, conv: np.ndarray, seq: list[bytes], points: np.ndarray, before: bytes | None, after: bytes | None, cells: int) -> dict[str, list]:
    """The nodes of one shard, with what its own rows add to them."""
    rows = len(conv)
    length = np.array([len(s) // WIDTH for s in seq], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.frombuffer(b"".join(seq), f"S{WIDTH}") if length.sum() else np.zeros(0, f"S{WIDTH}")
    # Numbers in byte order; void keys would drop no trailing zero bytes.
    words = flat.view(">u8").reshape(-1, 2) if len(flat) else np.zeros((0, 2), ">u8")
    order = np.lexsort((words[:, 1], words[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(fresh) - 1
    ids = ids if len(ids) else np.zeros(1, np.int64)
    least, most = min(seq), max(seq)
    shared_before = -1 if before is None else _common(before, least)
    shared_after = -1 if after is None else _common(after, most)

    out: dict[str, list] = {name: [] for name in NAMES}
    levels: list[dict] = []
    active = np.arange(rows)  # in the order of the rows' prefixes so far
    group = np.zeros(rows, np.int64)  # the node of each active row at the depth reached
    ends: list[tuple[int, int, np.ndarray]] = []

    def level(members: np.ndarray, starts: np.ndarray, depth: int, parent: np.ndarray) -> None:
        """Add the nodes of one depth; ``starts`` are the places of their first
        rows among ``members``."""
        n = np.diff(np.append(starts, len(members)))
        low = np.minimum.reduceat(conv[members], starts)
        one = members[starts]
        last = points[start[one] + depth - 1].astype(np.int64) if depth else np.zeros(len(starts), np.int64)
        stays = length[members] > depth
        levels.append({"first": one, "n": n, "low": low, "last": last, "parent": parent, "goes_on": np.add.reduceat(stays.astype(np.int64), starts)})
        done = np.flatnonzero(~stays)
        if len(done):
            node = np.searchsorted(starts, done, side="right") - 1
            by = np.lexsort((conv[members[done]], node))
            cut = np.flatnonzero(np.diff(node[by])) + 1
            for piece in np.split(by, cut):
                ends.append((depth, int(node[piece[0]]), conv[members[done[piece]]]))

    level(active, np.zeros(1, np.int64), 0, np.zeros(1, np.int64))
    depth = 0
    while True:
        on = length[active] > depth
        active, group = active[on], group[on]
        if not len(active):
            break
        width = int(min(max(1, cells // len(active)), length[active].max() - depth))
        band = _matrix(ids, start[active], length[active], depth, depth + width)
        order = np.lexsort((conv[active], *band.T[::-1], group))
        active, group, band = active[order], group[order], band[order]
        change = np.ones((len(active), width + 1), bool)
        change[1:, 0] = group[1:] != group[:-1]
        change[1:, 1:] = band[1:] != band[:-1]
        starts_here = np.logical_or.accumulate(change, axis=1)  # column j: depth + j
        above = group
        for j in range(width):
            held = np.flatnonzero(band[:, j] >= 0)
            mark = starts_here[:, j + 1]
            # A row that ended above its neighbour passes its mark on to the next row.
            number = np.cumsum(mark)
            first = np.ones(len(held), bool)
            first[1:] = number[held][1:] != number[held][:-1]
            starts = np.flatnonzero(first)
            level(active[held], starts, depth + j + 1, above[held][starts])
            above = np.full(len(active), -1, np.int64)
            above[held] = np.cumsum(first) - 1
        group = above
        depth += width

    # Sums over subtrees, from the deepest level up.
    for d in range(len(levels) - 1, -1, -1):
        x = levels[d]
        nodes = len(x["n"])
        x["own_start"], x["edge"] = np.ones(nodes, bool), np.zeros(nodes, bool)
        # The least row's prefix is the level's first node, the greatest row's its last.
        if len(least) >= d * WIDTH:
            x["edge"][0], x["own_start"][0] = True, d > shared_before
        if len(most) >= d * WIDTH:
            x["edge"][-1] = True
        ends_here = np.ones(nodes, bool)
        if d <= shared_after and len(most) >= d * WIDTH:
            ends_here[-1] = False
        x["leaves"] = ((x["goes_on"] == 0) & ends_here).astype(np.int64)
        x["saved"] = x["n"] * x["last"] - np.where(x["own_start"], x["last"], 0)
        x["children"] = np.zeros(nodes, np.int64)
        if d + 1 < len(levels):
            y = levels[d + 1]
            np.add.at(x["leaves"], y["parent"], y["leaves"])
            np.add.at(x["saved"], y["parent"], y["saved"])
            np.add.at(x["children"], y["parent"], y["own_start"].astype(np.int64))

    chunks: list[tuple[bytes, int, int, str]] = []
    names: list[list[bytes]] = [[ROOT]]
    for d, x in enumerate(levels[1:], 1):
        above = names[-1]
        names.append(
            [
                hashlib.blake2b(above[p] + seq[i][(d - 1) * WIDTH : d * WIDTH], digest_size=WIDTH).digest()
                for p, i in zip(x["parent"].tolist(), x["first"].tolist(), strict=True)
            ]
        )
    digest: dict[tuple[int, int], str] = {}
    for d, node, members in ends:
        if levels[d]["edge"][node]:
            for at in range(0, len(members), CHUNK):
                part = members[at : at + CHUNK].tolist()
                chunks.append((names[d][node], d, part[0], ",".join(map(str, part))))
        else:
            digest[d, node] = hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest()
    for d, x in enumerate(levels):
        n = len(x["n"])
        out["shard"] += [shard] * n
        out["node"] += names[d]
        out["parent"] += [names[d - 1][p] for p in x["parent"].tolist()] if d else [None]
        out["depth"] += [d] * n
        out["edge"] += x["edge"].tolist()
        out["parent_low"] += levels[d - 1]["low"][x["parent"]].tolist() if d else [None]
        for name in ("low", "n", "children", "leaves", "saved"):
            out[name] += x[name].tolist()
        out["ends"] += [None if e else digest.get((d, i), EMPTY_SHA256) for i, e in enumerate(x["edge"].tolist())]
        out["chunk_low"] += [None] * n
        out["chunk"] += [None] * n
    for name, d, low, text in chunks:
        for column, value in zip(NAMES, (shard, name, None, d, True, None, None, None, None, None, None, None, low, text), strict=True):
            out[column].append(value)
    return out


def _nodes(cells: int) -> Callable:
    def run(key: tuple, held: pa.Table, edges: pa.Table) -> pa.Table:
        if not held.num_rows:
            return pa.table([pa.array([], t) for t in KINDS], names=NAMES)
        points = held.column("points").combine_chunks()
        found = _shard_nodes(
            held.column("shard")[0].as_py(),
            held.column("id").to_numpy(),
            held.column("seq").to_pylist(),
            np.append(points.flatten().to_numpy(zero_copy_only=False), 0),
            edges.column("before")[0].as_py(),
            edges.column("after")[0].as_py(),
            cells,
        )
        return pa.table([pa.array(found[n], t) for n, t in zip(NAMES, KINDS, strict=True)], names=NAMES)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order."""
    node, running = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["node", "all_ends"])

    for batch in batches:
        for name, text in zip(batch.column("node").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    yield row()
                node, running = name, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
    if node is not None:
        yield row()


def trie(spark: SparkSession, conversations: DataFrame, shard_turns: int = SHARD_TURNS, cells: int = CELLS) -> DataFrame:
    """One row per node of the trie of ``conversations(id, turns)``: ``low``
    (smallest member), ``depth``, ``parent_low``, ``n``, ``children``, ``leaves``,
    ``saved``, ``ends``."""
    ship_package(spark)
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = conversations.select("id", joined.alias("seq"), F.transform("turns", lambda t: t["points"]).alias("points"))
    rows = materialise(spark, rows, "conversations")
    size = rows.agg(F.coalesce(F.sum(F.size("points") + 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(size / shard_turns))
    # The bounds are sampled: written once, so that every reader sees the same shards.
    dealt = materialise(spark, rows.repartitionByRange(shards, "seq", "id").withColumn("shard", F.spark_partition_id()), "shards")
    ends = dealt.groupBy("shard").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    order = Window.orderBy("shard")  # one row per shard
    edges = ends.select("shard", F.lag("most").over(order).alias("before"), F.lead("least").over(order).alias("after"))
    found = dealt.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_nodes(cells), NODES)
    found = materialise(spark, found, "nodes")

    parts = found.where("edge AND chunk IS NULL")
    chunks = found.where("chunk IS NOT NULL").select("node", "chunk_low", "chunk")
    digests = chunks.repartition("node").sortWithinPartitions("node", "chunk_low").mapInArrow(_digests, "node binary, all_ends string")
    whole = parts.groupBy("node").agg(
        F.min("low").alias("low"), F.max("parent").alias("parent"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
    )
    whole = materialise(spark, whole.join(digests, "node", "left"), "boundary_nodes")
    lows = whole.select("node", F.col("low").alias("whole_low"))
    above = lows.withColumnRenamed("node", "parent")
    tops = whole.join(above, "parent", "left").select(
        "low", "depth", F.col("whole_low").alias("parent_low"), "n", "children", "leaves", "saved", F.coalesce("all_ends", F.lit(EMPTY_SHA256)).alias("ends")
    )
    # The boundary nodes of a shard are parents of nodes of that shard alone.
    local = parts.select("shard", "node").join(lows, "node").select("shard", F.col("node").alias("parent"), "whole_low")
    inner = found.where("NOT edge").join(local, ["shard", "parent"], "left")
    inner = inner.select("low", "depth", F.coalesce("whole_low", "parent_low").alias("parent_low"), "n", "children", "leaves", "saved", "ends")
    return tops.unionByName(inner)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    taken = (F.crc32(F.col("id").cast("string").cast("binary")) % 6).cast("int")
    nodes = trie(spark, rebuilt(sequences(turns), taken))
    return nodes.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


OP13_SQL = """
WITH
-- CRC-32 of a decimal number, byte by byte, each byte in eight shifts
k AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (
  SELECT k.conv_id, o.i, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id - k.conv_id % 100 AND o.i <= k.h
  UNION ALL SELECT k.conv_id, o.i, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.i > k.h),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, md5(length(role) || ':' || role || text) AS t, length(text) AS points FROM b),
s AS (
  SELECT conv_id, d, points, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
m AS (SELECT conv_id, max(d) AS size FROM s GROUP BY conv_id),
n AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS low, count(*) AS n, any_value(points) AS points,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size), '') AS ends
  FROM s JOIN m USING (conv_id) GROUP BY node),
c AS (SELECT left(node, length(node) - 32) AS node, count(*) AS children FROM n WHERE node <> '' GROUP BY 1),
a AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN c USING (node)),
u AS (
  SELECT left(a.node, 32 * j) AS node, sum((children = 0)::BIGINT)::BIGINT AS leaves, sum((n - 1) * points)::BIGINT AS saved
  FROM a, LATERAL (SELECT unnest(range(0, a.depth + 1)) AS j) GROUP BY 1)
SELECT a.low AS conv_id, a.depth::BIGINT AS depth, p.low AS parent_conv_id, a.n AS n_convs, a.children AS n_children,
       u.leaves AS n_leaves, u.saved AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN u USING (node) LEFT JOIN a p ON a.node <> '' AND p.node = left(a.node, length(a.node) - 32)
"""
