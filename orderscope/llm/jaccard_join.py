"""Similarity join of word n-gram sets (Jaccard) by chosen paths.

A document's set is its distinct five-word shingles (lower-cased, split at
white space; a text of fewer words is one shingle). Equal sets are one row
with a weight. Each set is embedded as ``COORDS`` minwise tokens, so that two
sets share a share of their tokens equal to their similarity in expectation.
Per run, a bucket of sets is split on sampled tokens, 1/threshold of them in
expectation: a set goes to one child per sampled token, together with the sets
that have the same token there. Buckets of at most ``SMALL`` sets are compared
by brute force; larger ones are split again, unless their sets already agree
so much that splitting gains nothing. The chance that a pair at the threshold
survives a run falls with every split, so the number of runs follows from the splits
really made: runs enough for ``STEP`` splits are made of all sets (at once,
as rows), more for twice as many of the sets that a run splits further, and so
on up to ``DEPTH``.

The comparison inside buckets joins candidates whose tokens agree in at least
``LOOSE`` of the places (six standard deviations under the threshold) into
candidate groups. Within a group all exact similarities are computed from the
full sets; groups of more than ``BLOCK`` sets are dealt out as pairs of blocks,
so no task holds a large group. Only link counts and spanning links come
out, never all pairs; the comparisons themselves grow with the square of a
group of different near-copies, as do its links.

Defined results: texts without words (null, empty, blank) link to nothing; a
null id takes part, and a class is named by its smallest non-null id (null if it
has none); repeated rows are copies and link to each other; an empty table
gives no rows; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderscope.llm.common import LOC, connected_components, located, materialise, ship_package, text_of, without

WORDS = 5
THRESHOLD = Fraction(4, 5)
COORDS = 64
SMALL = 256
LOOSE = 0.5
BLOCK = 512
# Most splits, and by how many at a time runs are added.
DEPTH = 12
STEP = 3
RECALL = 0.9999

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    data = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    word = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    n = len(word) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += word[i : i + n] * _PLACE[i]
    return np.unique(_mixed(total))


def minwise(hashes: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _MULTIPLY + _ADD
        np.minimum(out, (part >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32).view(np.int32)


def survival(agreeing: np.ndarray, splits: int) -> np.ndarray:
    """The chance that a pair agreeing in so many places is still together
    somewhere after ``splits`` splits of one run (a branching process)."""
    extra = (1 / float(THRESHOLD) - 1) / (COORDS - 1)
    alive, share = np.ones(len(agreeing)), agreeing / COORDS
    for _ in range(splits):
        lost = 1 - extra * alive
        alive = 1 - share * (1 - alive) * lost ** np.maximum(agreeing - 1, 0) - (1 - share) * lost**agreeing
    return alive


def runs_for(recall: float, splits: int) -> int:
    """Runs that lose a pair at the threshold within ``splits`` splits with a
    chance of at most (1 - recall) / DEPTH, over the spread of its agreeing
    places."""
    p, places = float(THRESHOLD), np.arange(COORDS + 1)
    chance = np.array([math.comb(COORDS, int(m)) * p**m * (1 - p) ** (COORDS - m) for m in places])
    lost, runs = 1 - survival(places, splits), 1
    while float(chance @ lost**runs) > (1 - recall) / DEPTH:
        runs += 1
    return runs


SIGNED = f"{LOC[0]} long, {LOC[1]} long, digest binary, n int, sig array<int>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, sigs = [], [], []
        for text in batch.column(2):
            hashes = shingles(text.as_py())
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            sizes.append(len(hashes))
            sigs.append(minwise(hashes))
        flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, COORDS * len(sigs) + 1, COORDS), pa.int32()), flat)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], names=[*LOC, "digest", "n", "sig"])


def _path(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _members() -> list[Column]:
    """How many sets a bucket has, and a digest of who is in it."""
    who = [F.bit_xor(F.xxhash64("sid", F.lit(i))) for i in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), F.xxhash64(F.count(F.lit(1)), *who).alias("same")]


def _one_each(found: DataFrame) -> DataFrame:
    """Mark one of the buckets with the same members: runs often find the same
    group again, and one comparison of it is enough."""
    return found.withColumn("one", F.col("path") == F.min("path").over(Window.partitionBy("same")))


def _first() -> Column:
    """The token that a bucket is always split on."""
    return F.pmod(F.xxhash64("path", F.lit(-1)), F.lit(COORDS)).cast("int")


def _children(rows: DataFrame) -> DataFrame:
    """Rows of ``(path, sid, sig)`` sent to the children of their bucket: one
    token always, each other with a chance that makes 1/threshold in all."""
    extra = (1 / float(THRESHOLD) - 1) / (COORDS - 1)
    sampled = F.filter(
        F.sequence(F.lit(0), F.lit(COORDS - 1)),
        lambda i: (i == F.col("first")) | (F.pmod(F.xxhash64("path", i), F.lit(1 << 20)) < extra * (1 << 20)),
    )
    rows = rows.withColumn("first", _first()).withColumn("coord", F.explode(sampled))
    return rows.select("sid", _path("path", "coord", F.get("sig", F.col("coord"))).alias("path"))


def _descend(spark: SparkSession, sets: DataFrame, runs: range) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """``(small, alike, split)`` of these runs, split until nothing is left to
    split: the two kinds of ``buckets``, and per depth (from one split on) the
    ``sid`` of the sets in buckets that were split again. Buckets that agree
    throughout are found before any of their sets is sent on."""
    chosen = []
    for run in runs:
        more = np.random.default_rng([21, run]).random(COORDS) < (1 / float(THRESHOLD) - 1) / (COORDS - 1)
        chosen += [(run, c) for c in range(COORDS) if c == run % COORDS or more[c]]
    paths = F.array(*[_path(F.lit(run), F.lit(c), F.get("sig", F.lit(c))) for run, c in chosen])
    rows = sets.select("sid", F.explode(paths).alias("path"))
    sizes = materialise(spark, _one_each(rows.groupBy("path").agg(*_members()).where("n > 1")), "sizes")
    small, alike, split = [], [], []
    for depth in range(DEPTH):
        held = materialise(spark, rows.join(sizes, "path").select("path", "n", "same", "one", "sid"), "held")
        # Buckets that are split stay apart, as seeds of their own.
        small.append(held.where((F.col("n") <= SMALL) & F.col("one")).select("path", "sid"))
        if sizes.where(F.col("n") > SMALL).isEmpty():
            break
        inside = held.where(F.col("n") > SMALL)
        if depth == DEPTH - 1:
            alike.append(inside.where("one").select("path", "sid"))
            break
        # The share of pairs that agree on that token. From threshold^2 on,
        # splitting into 1/threshold children would save no work.
        signed = inside.join(sets.select("sid", "sig"), "sid")
        shared = signed.groupBy("path", "n", "same", F.get("sig", _first()).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        agree = shared.groupBy("path", "n", "same").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
        close = agree.where(F.col("s") / (F.col("n").cast("double") * F.col("n")) >= float(THRESHOLD) ** 2)
        close = materialise(spark, _one_each(close.select("path", "same")), "close")
        alike.append(inside.join(close.where("one").select("path"), "path", "left_semi").select("path", "sid"))
        apart = inside.join(close.select("path"), "path", "left_anti").select("path", "sid")
        split.append(apart.select("sid").distinct())
        rows = materialise(spark, _children(apart.join(sets.select("sid", "sig"), "sid")), "down")
        # A child with one set holds no pair.
        sizes = materialise(spark, _one_each(rows.groupBy("path").agg(*_members()).where("n > 1")), "sizes")
    return small, alike, split


def buckets(spark: SparkSession, sets: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """``(small, alike)`` rows of ``(path, sid)``: buckets to compare by brute
    force, and large buckets whose sets agree throughout. Sets that any run
    splits more than ``STEP`` times get the runs that so many splits need."""
    small, alike, done, pool = [], [], 0, sets
    deeper: dict[int, list[DataFrame]] = {}
    for splits in range(STEP, DEPTH + STEP, STEP):
        runs = range(done, runs_for(recall, splits))
        found, close, split = _descend(spark, pool, runs)
        small, alike, done = small + found, alike + close, runs.stop
        for k, sids in enumerate(split, 1):
            deeper.setdefault(k, []).append(sids)
        if splits not in deeper:
            break
        pool = sets.select("sid", "sig").join(_union(deeper[splits]).distinct(), "sid", "left_semi")
        pool = materialise(spark, pool, "pool")
        if pool.isEmpty():
            break
    alike = materialise(spark, _union(alike), "alike") if alike else _union(small).limit(0)
    return _union(small), alike


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; groups may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        for a, b in zip(edges, edges[1:], strict=False):
            if held and (a or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each, by a boolean adjacency matrix."""
    root = np.arange(len(linked))
    todo = linked.any(axis=1)
    while todo.any():
        start = int(np.argmax(todo))
        seen = np.zeros(len(linked), bool)
        seen[start] = True
        front = seen
        while front.any():
            front = linked[front].any(axis=0) & ~seen
            seen |= front
        root[seen] = start
        todo &= ~seen
    return root


EDGES = "a long, b long"


def _compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force inside small buckets on the tokens: spanning links."""
    a: list[int] = []
    b: list[int] = []
    for group in _groups(batches, ["path"]):
        if group.num_rows < 2:
            continue
        sid = group.column("sid").to_numpy()
        sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(sid), COORDS)
        same = np.stack([(sig == row).mean(axis=1) for row in sig]) >= LOOSE
        root = _roots(same & ~np.eye(len(sid), dtype=bool))
        out = np.flatnonzero(root != np.arange(len(sid)))
        a += sid[out].tolist()
        b += sid[root[out]].tolist()
        if len(a) > 20000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


FILLED = "comp long, blocks int, block int, sid long, weight long, hashes binary"


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text (last column) by its shingles."""
    for batch in batches:
        hashes = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(5)], pa.binary())
        yield pa.record_batch([*batch.columns[:5], hashes], names=[c.split()[0] for c in FILLED.split(", ")])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by incidence matrices over slices of the
    shingles that occur on both sides."""
    every = [np.unique(np.concatenate(side)) for side in (left, right)]
    common = np.intersect1d(*every, assume_unique=True)
    if left is right:
        values, counts = np.unique(np.concatenate(left), return_counts=True)
        common = values[counts > 1]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]

        def incidence(side: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(side), len(part)), np.float32)
            for i, h in enumerate(side):
                h = h[np.searchsorted(h, part[0]) : np.searchsorted(h, part[-1], "right")]
                place = np.minimum(np.searchsorted(part, h), len(part) - 1)
                m[i, place[part[place] == h]] = 1
            return m

        x = incidence(left)
        out += x @ (x if left is right else incidence(right)).T
    return out


LINKED = "sid long, links long, root long, multi boolean"


def _compare_exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All exact similarities of a group, or of one block with another: per set
    the weight it links to, and a spanning link."""
    for group in _groups(batches, ["comp", "low", "high"]):
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        block, sid, weight = (group.column(c).to_numpy() for c in ("block", "sid", "weight"))
        hashes = [np.frombuffer(h.as_py(), np.uint64) for h in group.column("hashes")]
        n = np.array([len(h) for h in hashes])
        at = [np.flatnonzero(block == low), np.flatnonzero(block == high)]
        sides = [[hashes[i] for i in part] for part in at]
        linked = np.zeros((len(sid), len(sid)), bool)
        if low == high:
            sides[1] = sides[0]
        if len(at[0]) and len(at[1]):
            both = _shared(*sides)
            union = n[at[0]][:, None] + n[at[1]][None, :] - both
            near = both * THRESHOLD.denominator >= union * THRESHOLD.numerator
            linked[np.ix_(*at)] = near
            linked |= linked.T
            np.fill_diagonal(linked, False)
        root = _roots(linked)
        yield pa.record_batch(
            [
                pa.array(sid),
                pa.array((linked @ weight).astype(np.int64)),
                pa.array(sid[root]),
                pa.array(np.full(len(sid), group.column("blocks")[0].as_py() > 1)),
            ],
            names=["sid", "links", "root", "multi"],
        )


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``(docs, rows)``: one row per document with ``id, class_id, n_links,
    class_size, keeps`` (true for one row of each class) and its locator."""
    ship_package(spark)
    docs, rows = located(spark, docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")])
    texts = rows.select(*LOC, text_of().alias("text"))
    signed = materialise(spark, texts.mapInArrow(_sign, SIGNED), "signed")
    sets = signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct(*LOC, "sig")).alias("at"), F.count(F.lit(1)).alias("weight")
    )
    sets = materialise(spark, sets.select(F.monotonically_increasing_id().alias("sid"), "digest", "at.*", "weight"), "sets")

    small, alike = buckets(spark, sets, recall)
    ready = small.join(sets.select("sid", "sig"), "sid").repartition("path").sortWithinPartitions("path")
    star = alike.groupBy("path").agg(F.min("sid").alias("b"))
    edges = ready.select("path", "sid", "sig").mapInArrow(_compare_small, EDGES)
    edges = edges.union(alike.join(star, "path").select(F.col("sid").alias("a"), "b"))
    comps = connected_components(spark, edges)
    comps = materialise(spark, comps.union(comps.select(F.col("component").alias("node"), "component").distinct()), "comps")

    count = comps.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = comps.join(count, "component").withColumnRenamed("node", "sid").join(sets.drop("sig", "digest"), "sid")
    members = members.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    filled = members.join(texts, list(LOC)).select("component", "blocks", "block", "sid", "weight", "text").mapInArrow(_fill, FILLED)
    dealt = filled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    linked = materialise(spark, dealt.drop("other").mapInArrow(_compare_exact, LINKED), "linked")

    links = linked.groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("multi").alias("multi"))
    crossing = linked.where("multi AND root <> sid").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    wide = connected_components(spark, crossing).withColumnRenamed("node", "sid") if not crossing.isEmpty() else None
    if wide is not None:
        links = links.join(wide, "sid", "left").withColumn("root", F.coalesce("component", F.when(F.col("multi"), F.col("sid")).otherwise(F.col("root"))))
    known = sets.select("sid", "digest", "weight").join(links.select("sid", "links", "root"), "sid", "left")
    known = known.select("digest", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))

    ids = rows.select("id", *LOC).join(signed.select(*LOC, "digest"), list(LOC))
    found = materialise(spark, ids.join(known, "digest", "left").drop("digest"), "found")
    first = F.min(F.struct(F.isnull("id").alias("u"), F.col("id").alias("id"), *LOC)).alias("first")
    named = found.where("root IS NOT NULL").groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size"))
    found = found.join(named, "root", "left")
    alone = F.col("root").isNull()
    return docs, found.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | ((F.col(LOC[0]) == F.col(f"first.{LOC[0]}")) & (F.col(LOC[1]) == F.col(f"first.{LOC[1]}")))).alias("keeps"),
        *LOC,
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class."""
    docs, found = classes(spark, docs, id_col, text_col)
    gone = found.where(~F.col("keeps")).select(*LOC)
    return without(docs, gone)


def op8_chosen_path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "class_size")
