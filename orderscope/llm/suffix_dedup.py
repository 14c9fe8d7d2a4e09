"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
anywhere else. Sorting every suffix of a corpus would move each byte many
times, so suffixes are sorted where a repeat must show: each window of
``LENGTH`` bytes selects the leftmost ``GRAM`` bytes in it with the smallest
hash, equal windows select the same place, and neighbouring windows mostly share
it. Such a place (an anchor) with the bytes of all windows that select it is
its context, some 580 bytes every 180.

1. Per document: anchors, each with a hash of its gram and a digest of its context.
2. Contexts that occur twice are repeated throughout: settled by counting digests.
3. Different contexts of one gram are compared: their suffixes (from the anchor
   on, and backwards before it) are sorted, to a shallow depth by multikey
   quicksort, then by a blind trie for each group with a longer common
   prefix. Common prefixes along the order tell which windows are equal.
4. Grams with more than ``GROUP`` different contexts (a passage with ever other
   surroundings) would overfill a task: their windows are counted by digest.
5. The covered bytes are taken out of each document.

Counting is partially aggregated, and copies collapse before anything is
sorted, so a hot passage or group of copies is a row per map task.

Defined results: null text is empty; texts shorter than ``LENGTH`` bytes stay
whole; repeated rows remove each other's bytes; null ids are kept; an empty
table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm.common import LOC, located, materialise, ship_package, text_of
from orderscope.llm.jaccard_join import _groups

LENGTH = 400
GRAM = 48
GROUP = 50_000
SHALLOW = 24
SEGMENT = 1 << 19

_rng = np.random.default_rng(33)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << k, 1 << 64)) for k in range(6)]
_PLACES = np.uint64((1 << 20) - 1)


def selected(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window start the place it selects, and per place its gram's hash."""
    h = [_BYTE[data]]
    for k in range(5):  # hashes of 2, 4, 8, 16 and 32 bytes
        h.append(h[-1][: -(1 << k)] * _BASE[k] + h[-1][1 << k :])
    gram = h[5][:-16] * _BASE[4] + h[4][32:]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0x9FB21C651E98DF25)
    gram ^= gram >> np.uint64(28)
    low = (gram & ~_PLACES) | np.arange(len(gram), dtype=np.uint64)
    wide, have = LENGTH - GRAM + 1, 1
    while 2 * have <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if wide > have:
        low = np.minimum(low[: -(wide - have)], low[wide - have :])
    return (low & _PLACES).astype(np.int64), gram


ANCHORS = f"{LOC[0]} long, {LOC[1]} long, a int, s1 int, s2 int, gram long, context binary, n long"
_ANCHORS = pa.schema([(LOC[0], pa.int64()), (LOC[1], pa.int64()), ("a", pa.int32()), ("s1", pa.int32()), ("s2", pa.int32()), ("gram", pa.int64()), ("context", pa.binary()), ("n", pa.int64())])


def _anchors_of(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Anchors of segments ``(file, row, offset, bytes)``. A context repeated
    inside its segment is one row with its count; the windows of its other
    occurrences come out as rows without context, merged."""
    cols: list[list] = [[] for _ in range(8)]
    data = b"".join(p[3] for p in parts)
    place, gram = selected(np.frombuffer(data, np.uint8))
    gram = gram.view(np.int64)
    at = 0
    for file, row, offset, part in parts:
        mine = place[at : at + len(part) - LENGTH + 1]
        edges = np.flatnonzero(mine[1:] != mine[:-1]) + 1
        first = np.concatenate([[0], edges])
        last = np.concatenate([edges - 1, [len(mine) - 1]])
        digests = [hashlib.blake2b(part[s : e + LENGTH], digest_size=16).digest() for s, e in zip(first.tolist(), last.tolist(), strict=True)]
        where: dict[bytes, int] = {}
        counts: dict[bytes, int] = {}
        spans: list[list[int]] = []
        for i, d in enumerate(digests):
            if d not in where:
                where[d], counts[d] = i, 1
                continue
            counts[d] += 1
            start, end = int(first[i]), int(last[i]) + LENGTH
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        keep = np.fromiter(where.values(), np.int64)
        anchor = mine[first[keep]]
        cols[0] += [file] * (len(keep) + len(spans))
        cols[1] += [row] * (len(keep) + len(spans))
        cols[2] += [*(anchor - at + offset).tolist(), *[0] * len(spans)]
        cols[3] += [*(first[keep] + offset).tolist(), *(s + offset for s, _ in spans)]
        cols[4] += [*(last[keep] + offset).tolist(), *(e + offset for _, e in spans)]
        cols[5] += [*gram[anchor].tolist(), *[0] * len(spans)]
        cols[6] += [*where, *[None] * len(spans)]
        cols[7] += [*counts.values(), *[0] * len(spans)]
        at += len(part)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ANCHORS, strict=True)], schema=_ANCHORS)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for file, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
                part = data[at : at + SEGMENT + LENGTH - 1]
                if size + len(part) > int(_PLACES):
                    yield _anchors_of(parts)
                    parts, size = [], 0
                parts.append((file, row, at, part))
                size += len(part)
    if parts:
        yield _anchors_of(parts)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length()
    return n - (differing + 7) // 8


def blind_sort(texts: list[bytes], rows: list[int]) -> list[int]:
    """Order rows by their texts with a blind trie: an inner node knows only
    how many bytes its texts share, a leaf its rows. One text is compared per
    insertion."""
    root: list | None = None  # inner: [shared, {byte: node}], leaf: [-1, rows]
    for row in rows:
        text = texts[row]
        if root is None:
            root = [-1, [row]]
            continue
        node = root
        while node[0] >= 0:
            byte = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = texts[node[1][0]]
        shared = common_prefix(text, other)
        if shared == len(text) == len(other):
            node[1].append(row)
            continue
        node = root
        while 0 <= node[0] < shared:
            node = node[1][text[node[0]] if node[0] < len(text) else -1]
        byte = text[shared] if shared < len(text) else -1
        if node[0] == shared:
            node[1][byte] = [-1, [row]]
        else:
            below = node[:]
            node[:] = [shared, {other[shared] if shared < len(other) else -1: below, byte: [-1, [row]]}]
    out: list[int] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Rows in order of their texts, and the common prefix of each with the one
    before it. Multikey quicksort for SHALLOW bytes beyond what all share, blind
    tries below."""
    base = min((common_prefix(texts[0], t) for t in texts[1:]), default=0)
    order: list[int] = []
    stack = [(list(range(len(texts))), base)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            order += rows
        elif depth >= base + SHALLOW or len(rows) < 4:
            order += blind_sort(texts, rows)
        else:
            keys = [texts[r][depth] if depth < len(texts[r]) else -1 for r in rows]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            same = [r for r, c in zip(rows, keys, strict=True) if c == pivot]
            more = [r for r, c in zip(rows, keys, strict=True) if c > pivot]
            less = [r for r, c in zip(rows, keys, strict=True) if c < pivot]
            stack.append((more, depth))
            # Texts that end here are equal: nothing is left to sort by.
            stack.append((same, depth + 1 if pivot >= 0 else base + SHALLOW))
            stack.append((less, depth))
    return order, [0, *(common_prefix(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False))]


def repeated_windows(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per context the distances d (as ranges, ends included) from window start
    to anchor at which another context has the same window. Context i has the
    windows low[i] <= d <= high[i]; ``left`` runs backwards from the anchor."""
    n = len(left)
    (ro, rl), (lo, ll) = deep_shallow_sort(right), deep_shallow_sort(left)
    ro_, lo_, rl_, ll_ = (np.array(v) for v in (ro, lo, rl, ll))
    points = {int(d) for d in low} | {int(d) + 1 for d in high} | {LENGTH - p for p in rl[1:]} | {p + 1 for p in ll[1:]}
    first, last = int(low.min()), int(high.max()) + 1
    cuts = sorted(p for p in points if first <= p <= last)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d, end in zip(cuts, cuts[1:], strict=False):
        by_right[ro_] = np.cumsum(rl_ < LENGTH - d)
        by_left[lo_] = np.cumsum(ll_ < d)
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) < 2:
            continue
        key = by_right[rows] * (n + 2) + by_left[rows]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        for i in rows[counts[back] > 1].tolist():
            if out[i] and out[i][-1][1] == d - 1:
                out[i][-1] = (out[i][-1][0], end - 1)
            else:
                out[i].append((d, end - 1))
    return out


CONTEXTS = f"gram long, {LOC[0]} long, {LOC[1]} long, a int, s1 int, s2 int, bytes binary"
WINDOWS = f"window binary, {LOC[0]} long, {LOC[1]} long, start int"
SPANS = f"{LOC[0]} long, {LOC[1]} long, start int, end int"


def _batch(schema: str, cols: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, row, text, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            wanted = asked.as_py()
            n = len(wanted)
            cols = [[w["gram"] for w in wanted], [file.as_py()] * n, [row.as_py()] * n, *([w[c] for w in wanted] for c in ("a", "s1", "s2"))]
            yield _batch(CONTEXTS, [*cols, [data[w["s1"] : w["s2"] + LENGTH] for w in wanted]])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _contexts(batches):
        for file, row, s1, s2, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6)), strict=True):
            n = s2 - s1 + 1
            digests = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            yield _batch(WINDOWS, [digests, [file] * n, [row] * n, list(range(s1, s2 + 1))])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[], [], [], []]
    for group in _groups(batches, ["gram"]):
        file, row, a, s1, s2, data = (group.column(i).to_pylist() for i in range(1, 7))
        if len(a) < 2:
            continue
        left = [b[: x - s][::-1] for b, x, s in zip(data, a, s1, strict=True)]
        right = [b[x - s :] for b, x, s in zip(data, a, s1, strict=True)]
        at = np.array(a)
        for i, ranges in enumerate(repeated_windows(left, right, at - np.array(s2), at - np.array(s1))):
            for d, end in ranges:
                for col, value in zip(cols, (file[i], row[i], a[i] - end, a[i] - d + LENGTH), strict=True):
                    col.append(value)
        if len(cols[0]) > 20000:
            yield _batch(SPANS, cols)
            cols = [[], [], [], []]
    yield _batch(SPANS, cols)


def _texts_with(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each text once with its wanted contexts (as many as it is long, at most)."""
    lists = wanted.groupBy(*LOC).agg(F.collect_list(F.struct("gram", "a", "s1", "s2")).alias("wanted"))
    return texts.join(lists, list(LOC)).select(*LOC, "text", "wanted")


def repeated_spans(spark: SparkSession, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """Byte spans (may overlap) of ``texts(locator, text)`` covered by repeats."""
    anchors = materialise(spark, texts.mapInArrow(_anchors, ANCHORS), "anchors")
    known = anchors.where("context IS NOT NULL")
    contexts = known.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(F.struct(*LOC, "a", "s1", "s2")).alias("at"))
    contexts = materialise(spark, contexts.select("gram", "context", "n", "at.*"), "contexts")
    grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    rivals = contexts.drop("context", "n").join(grams, "gram")

    ready = _texts_with(texts, rivals.where(F.col("different") <= group)).mapInArrow(_contexts, CONTEXTS)
    ready = ready.repartition("gram").sortWithinPartitions("gram")
    spans = materialise(spark, ready.mapInArrow(_compare, SPANS), "spans")
    span = lambda start, end: [*LOC, start.cast("int").alias("start"), end.cast("int").alias("end")]
    full = contexts.where("n > 1").select("context")
    spans = spans.union(known.join(full, "context", "left_semi").select(*span(F.col("s1"), F.col("s2") + LENGTH)))
    spans = spans.union(anchors.where("context IS NULL").select(*span(F.col("s1"), F.col("s2"))))
    hot = rivals.where(F.col("different") > group)
    if not hot.isEmpty():
        windows = materialise(spark, _texts_with(texts, hot).mapInArrow(_windows, WINDOWS), "windows")
        twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        found = windows.join(twice, "window", "left_semi")
        spans = spans.union(found.select(*span(F.col("start"), F.col("start") + LENGTH)))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


CLEANED = "n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:int,end:int>>"
_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, runs = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            gone = merged([(s["start"], s["end"]) for s in spans.as_py() or ()])
            edges = [0, *(x for s in gone for x in s), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(data))
            runs.append(gone)
        cols = [pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()), pa.array([len(g) for g in runs], pa.int64())]
        removed = pa.array([[{"start": a, "end": b} for a, b in g] for g in runs], _REMOVED)
        yield pa.record_batch([batch.column(0), *cols, pa.array(kept, pa.binary()), removed], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per document ``id, n_bytes, n_removed, n_spans, kept`` (the remaining
    bytes) and ``removed`` (maximal spans)."""
    ship_package(spark)
    _, rows = located(spark, docs, [F.col(id_col).alias("id"), text_of(text_col).alias("text")])
    spans = repeated_spans(spark, rows.select(*LOC, "text"), group)
    lists = spans.groupBy(*LOC).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.join(lists, list(LOC), "left").select("id", "text", "spans").mapInArrow(_clean, f"id {kind}, {CLEANED}")


def sha256(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", sha256("kept").alias("kept_sha256"))
