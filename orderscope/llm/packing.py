"""Packing documents into fixed windows by non-negative least squares.

Each document's ids (its text's, then a closing 0) are cut into whole windows
and one remainder. The histogram of remainder lengths (fewer bins than the
window) is all that reaches the driver. There, combinations of two and three
lengths that fill a window exactly are enumerated, their repeat counts are
solved against the histogram by non-negative least squares and rounded down,
and the residual remainders are packed greedily one after another, cut where
a window ends. A piece learns its place from its rank among the pieces
of its length: ranks are counted per written block and offset by a running sum
over blocks, so nothing is numbered in one task.

Only the last residual window can be padded: every combination is exact.

Defined results: null or empty text is the closing id alone; a special token in
a text is its one id, by the file's defaults; an id may be of any type that
Arrow carries (numbers, text, dates, bytes), and a null id is kept as null;
repeated rows are packed each; an empty table gives no pieces; other columns are
not touched.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orderscope.llm.common import materialise, ship_package, text_of

WINDOW = 1024
# Words whose ids a worker remembers, and lengths (the commonest) of which all
# pairs are completed to triples.
CACHED_WORDS = 400_000
TRIPLE_LENGTHS = 96

PIECES = "doc_id {id}, start long, length int, ids_crc32 long, doc_tokens long, ids binary, block int, local_rank long"
PACKED = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Text to little-endian unsigned 32-bit ids of a byte-level BPE file.

    The file's pattern starts a new unit at each single space between
    other characters, so such texts are encoded word by word with a memory
    of words; texts in which a space touches other white space go in whole.
    Where the file's ids rank its merges, words are encoded by tiktoken from
    those ranks (the same ids, several times faster). Texts that hold a token
    added to the file (a special one, say) are encoded whole by the file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        # A normalizer can make an added token out of other text.
        self.whole = self.slow.normalizer is not None
        self.known: dict[str, bytes] = {}
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, special = data["model"]["vocab"], {t["content"] for t in data.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in data["model"]["merges"]]
        order = [vocab[m] for m in merged]
        if order != sorted(order) or data["pre_tokenizer"].get("add_prefix_space") or data.get("normalizer"):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def _new(self, word: str) -> bytes:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        got = self.known[word] = np.array(self.ids(word), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole or self.added is not None and self.added.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split(" ")
        if any(w[:1].isspace() or w[-1:].isspace() or not w for w in words):
            return np.array(self.ids(text), "<u4").tobytes()
        known = self.known
        out = [known.get(words[0]) or self._new(words[0])]
        for word in words[1:]:
            word = " " + word
            out.append(known.get(word) or self._new(word))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(path: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of each document: whole windows and the remainder with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ranks, block = encoder(path), [0] * (WINDOW + 1), TaskContext.get().partitionId()
        size = 4 * WINDOW
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = enc.encode(text) + b"\0\0\0\0"
                total = len(data) // 4
                for at in range(0, len(data), size):
                    piece = data[at : at + size]
                    n = len(piece) // 4
                    row = (doc, at // 4, n, zlib.crc32(piece), total, piece if n < WINDOW else None, block, ranks[n])
                    ranks[n] += 1
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                if len(cols[0]) >= 5000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols = [[] for _ in range(8)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def combinations(counts: np.ndarray) -> np.ndarray:
    """Length triples (0: none) that fill the window exactly: all pairs, and all
    completions of pairs of the commonest lengths. Only lengths that occur."""
    there = [int(x) for x in np.flatnonzero(counts)]
    out = {(0, a, WINDOW - a) for a in there if a <= WINDOW - a and counts[WINDOW - a]}
    common = sorted(sorted(there, key=lambda a: (-counts[a], a))[:TRIPLE_LENGTHS])
    for a in common:
        for b in common:
            c = WINDOW - a - b
            if a <= b and c > 0 and counts[c]:
                out.add(tuple(sorted((a, b, c))))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def nnls(combos: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 minimising |A x - counts|^2, where column j of A
    counts the lengths in combination j: accelerated projected gradient on the
    three indices of each column, with the step from A's norm."""
    if not len(combos):
        return np.zeros(0)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts))
        for k in range(3):
            np.add.at(out, combos[:, k], x)
        out[0] = 0
        return out

    def back(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0
        return y[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(times(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    target, x = counts.astype(float), np.zeros(len(combos))
    z, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, z - back(times(z) - target) / (1.01 * norm))
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / grown * (new - x), new, grown
    return x


class Plan:
    """Where the piece of a given length and rank goes. Arrays of at most
    window-many lengths and a few thousand combinations."""

    def __init__(self, counts: np.ndarray):
        left = counts.astype(np.int64)
        left[0] = left[WINDOW] = 0
        combos = combinations(left)
        keys, firsts, sequences, offsets = [], [], [], []
        taken, n = np.zeros(WINDOW + 1, np.int64), 0
        solved = nnls(combos, left[:WINDOW])
        # Rounded counts first, most repeated first; then what is still there.
        for rounded in (True, False):
            for j in np.argsort(-solved, kind="stable"):
                lengths = [int(a) for a in combos[j] if a]
                need = {a: lengths.count(a) for a in lengths}
                most = min(int(left[a]) // k for a, k in need.items())
                repeats = min(int(solved[j] + 1e-6), most) if rounded else most
                if repeats <= 0:
                    continue
                at = 0
                for a in lengths:
                    keys.append((a, int(taken[a])))
                    sequences.append(n)
                    offsets.append(at)
                    taken[a] += repeats
                    left[a] -= repeats
                    at += a
                n += repeats
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.length = np.array([keys[i][0] for i in order], np.int64)
        self.first = np.array([keys[i][1] for i in order], np.int64)
        self.sequence = np.array([sequences[i] for i in order], np.int64)
        self.offset = np.array([offsets[i] for i in order], np.int64)
        self.taken = taken
        tokens = left * np.arange(WINDOW + 1)
        self.residual = np.concatenate([[0], np.cumsum(tokens)[:-1]])
        self.combined = n
        self.whole = n + int(-(-tokens.sum() // WINDOW))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece; a residual may run over its end."""
        sequence, offset = self.whole + rank, np.zeros(len(rank), np.int64)
        mine = (length < WINDOW) & (rank < self.taken[length])
        if mine.any():
            # Slots are sorted by length, then first rank: find the last not after.
            low = np.searchsorted(self.length, length[mine], "left")
            high = np.searchsorted(self.length, length[mine], "right")
            want = rank[mine]
            while (high - low > 1).any():
                mid = (low + high) // 2
                above = self.first[np.minimum(mid, len(self.first) - 1)] > want
                wide = high - low > 1
                high, low = np.where(wide & above, mid, high), np.where(wide & ~above, mid, low)
            sequence[mine], offset[mine] = self.sequence[low] + want - self.first[low], self.offset[low]
        rest = (length < WINDOW) & ~mine
        at = self.residual[length[rest]] + (rank[rest] - self.taken[length[rest]]) * length[rest]
        sequence[rest], offset[rest] = self.combined + at // WINDOW, at % WINDOW
        return sequence, offset


def _place(plan: Plan, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(name) for name in batch.schema.names}
            length, rank = get["length"].to_numpy().astype(np.int64), get["rank"].to_numpy()
            sequence, offset = plan.place(length, rank)
            over = np.flatnonzero(offset + length > WINDOW)
            crc, start, tokens = (get[c].to_numpy().copy() for c in ("ids_crc32", "start", "doc_tokens"))
            first = WINDOW - offset[over]
            second, rest_crc = length[over] - first, []
            for i, n in zip(over, first, strict=True):
                data = get["ids"][int(i)].as_py()
                crc[i] = zlib.crc32(data[: 4 * n])
                rest_crc.append(zlib.crc32(data[4 * n :]))
            length[over] = first
            doc = get["doc_id"]
            columns = [
                pa.concat_arrays([doc, doc.take(pa.array(over))]),
                *(
                    pa.array(np.concatenate(pair).astype(np.int64))
                    for pair in (
                        (start, start[over] + first),
                        (length, second),
                        (crc, np.array(rest_crc, np.int64)),
                        (tokens, tokens[over]),
                        (sequence, sequence[over] + 1),
                        (offset, np.zeros(len(over), np.int64)),
                    )
                ),
            ]
            yield pa.record_batch(columns, schema=schema)

    return run


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    ship_package(spark)
    kind = docs.schema[id_col].dataType
    simple = kind.simpleString()
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), simple: to_arrow_type(kind)}

    def fields(text: str) -> pa.Schema:
        return pa.schema([(name, arrow[t]) for name, t in (c.split(" ") for c in text.format(id=simple).split(", "))])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    cut = rows.mapInArrow(_cut(tokenizer or default_tokenizer(), fields(PIECES)), PIECES.format(id=simple))
    pieces = materialise(spark, cut, "pieces")
    blocks = materialise(spark, pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "blocks")
    counts = np.zeros(WINDOW + 1, np.int64)
    for row in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most WINDOW rows
        counts[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["block", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank")
    return ranked.mapInArrow(_place(Plan(counts), fields(PACKED)), PACKED.format(id=simple))


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
