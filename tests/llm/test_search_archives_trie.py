"""Ranked search, archives and the conversation trie against brute force."""

from __future__ import annotations

import collections
import glob
import gzip
import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderscope.llm import interval_search, prefix_trie, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, all_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // all_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in c}
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    found = interval_search.search(spark, docs, items, **options)
    return sorted(map(tuple, found.select("query_id", "rank", "id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "x1"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, weights=range(63, 0, -1), k=n))
    docs = [(i, text(rng.choice([0, 1, 3, 20, 200]))) for i in rng.sample(range(10_000), 700)]
    docs += [(20_000 + i, "w1 w2 w3") for i in range(60)]  # copies: ties by id
    docs += [(None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (5, None), (6, ""), (7, "  .;"), (8, "W1 w1\x00W2"), (8, "W1 w1\x00W2"), (9, "w5 " * 50_000)]
    items = [(i, text(rng.choice([1, 2, 5, 40]))) for i in range(25)]
    items += [(100, "w1 w2 w3"), (101, "nowhere to be found"), (102, None), (None, "w3 w4"), (103, "w1"), (103, "w2 É"), (103, "w1")]
    return docs, items


@pytest.mark.parametrize("block", [8192, 50])
def test_search_equals_brute_force(spark, library, block, monkeypatch):
    docs, items = library
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, term string, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, id int")
    monkeypatch.setattr(interval_search, "BLOCK_DOCS", block)  # of this process; the workers' is 8192
    assert searched(spark, frame, asked) == brute_search(docs, items)


def test_blocks_and_narrow_steps_keep_the_ranking(monkeypatch):
    rng = np.random.default_rng(2)
    for width in (1, 3, 256):
        monkeypatch.setattr(interval_search, "WIDTH", width)
        for _ in range(30):
            docs, terms = int(rng.integers(1, 60)), 6
            dense = rng.integers(0, 5, (terms, docs)) * (rng.random((terms, docs)) < 0.4)
            term, doc = np.nonzero(dense)
            block = interval_search.Block(doc, term, dense[term, doc].astype(np.int64), docs, terms)
            asked = np.flatnonzero(rng.random(terms) < 0.7)
            ids = np.sort(rng.integers(0, 40, docs))
            start = sorted((-int(s), int(i)) for s, i in zip(rng.integers(1, 12, 4), rng.integers(0, 40, 4), strict=True))
            got = interval_search.search_block(block, ids, asked, 5, start)
            score = dense[asked].sum(axis=0)
            want = sorted(start + [(-int(s), int(i)) for s, i in zip(score, ids, strict=True) if s > 0])[:5]
            assert [x for x in got if x[0] < 0] == want


def test_search_in_batches_and_empty_tables(spark, library, monkeypatch):
    docs, items = library
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(interval_search, "BATCH_TERMS", 100)
    assert searched(spark, frame, asked, k=3) == brute_search(docs, items, 3)
    assert searched(spark, frame.limit(0), asked) == [] and searched(spark, frame, asked.limit(0)) == []
    assert searched(spark, frame.select("doc_id", F.lit(None).cast("string").alias("text")), asked) == []


BIG = "WARC/1.1\r\n" * 200 + "é"
PAGES = [
    (1, "http://a.b/c d", BIG), (1, "http://a.b/c d", BIG), (2, "http://a.b/x?q", BIG), (3, None, None), (None, "http://z", "WARC/1.0\r\n\r\nWARC/1."),
    (4, "http://u@h:8/", "x" * 999), (5, "http://h", "x" * 999), (None, "u\r\nWARC-Type: x", BIG), (6, "http://h/é", "\r\n\r\n\r\nWARC/1.1\r\n"), (7, "", "y" * 300_000), (8, "", "y" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 5) for r in PAGES], "page_id long, url string, html string, type string, record_id int").repartition(3)


def test_archives_round_trip(spark, pages, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_captures(spark, pages, folder)
    records = warc.read_records(spark, folder)
    rows = records.collect()
    assert collections.Counter(r.type for r in rows) == {"request": 11, "metadata": 11, "response": 7, "revisit": 4}
    once = [BIG, "", "WARC/1.0\r\n\r\nWARC/1.", "x" * 999, "x" * 999, "\r\n\r\n\r\nWARC/1.1\r\n", "y" * 300_000]
    assert sorted(r.payload.decode() for r in rows if r.type == "response") == sorted(once)
    assert all(r.payload == b"" and r.refers_to for r in rows if r.type == "revisit")
    assert all(r.payload_digest == "sha1:" + hashlib.sha1(r.payload).hexdigest() for r in rows if r.type == "response")
    assert len({r.record_id for r in rows}) == len(rows) and all(uuid.UUID(r.record_id) for r in rows)
    assert all(" " not in r.target_uri and "\n" not in r.target_uri for r in rows)
    # Every byte of the files belongs to a record: what a plain reader finds too.
    raw = b"".join(gzip.open(f).read() for f in glob.glob(folder + "/*.gz"))
    at = n = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        assert raw.startswith(b"WARC/1.1\r\n", at)
        at = head + 4 + int(re.search(rb"Content-Length: (\d+)", raw[at:head])[1])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(rows)
    captures = warc.transactions(records).collect()
    assert len(captures) == 11 and all(len(c.requests) == 1 and len(c.metadata) == 1 for c in captures)


def test_warc_query_edges(spark, pages, tmp_path):
    folder = tmp_path / "sf"
    pages.write.parquet(str(folder / "pages.parquet"))
    got = warc.op12_warc_transactions(spark, str(folder)).collect()
    first = {t: max((i for i, _, x in PAGES if x == t), key=lambda i: i or 0) for t in (BIG, "y" * 300_000)}
    want = collections.Counter()
    seen = set()
    for i, _, t in sorted(PAGES, key=lambda r: -(r[0] or 0)):
        text = (t or "").encode()
        response = len(text) < 1000 or t not in seen
        seen.add(t)
        want[i, len(text), hashlib.sha1(text).hexdigest(), "response" if response else "revisit", None if response else first[t]] += 1
    assert collections.Counter(map(tuple, got)) == want
    pages.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op12_warc_transactions(spark, str(tmp_path / "none")).collect() == []


def test_join_unique_with_hot_keys(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 1500, 7).when(F.col("id") < 2900, F.col("id")).alias("k"), "id")
    one = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {(r["id"], r["k"], r["v"]) for r in warc.join_unique(many, one, "k").collect()}
    key = lambda i: 7 if i < 1500 else i if i < 2900 else None
    assert got == {(i, key(i), 2 * key(i) if key(i) is not None and key(i) < 2000 else None) for i in range(3000)}


def archive(folder, name, data, pack=True):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(gzip.compress(data) if pack else data)


def record(kind, me, block, *fields, version="1.0"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{me}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Links from either side and through the request, per-record members,
    records in different files, plain files, damaged files."""
    folder = tmp_path / "other"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    one = record("response", "r1", http, "Content-Type: application/http", "warc-concurrent-to: <q1>", "X-Folded: a", "  b")
    archive(folder, "a.warc.gz", record("warcinfo", "i", b"software: z\r\n") + one)
    members = [record("request", "q1", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", "m1", b"a: b", "WARC-Concurrent-To: <q1>"), record("response", "r2", http, version="1.1")]
    (folder / "b.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    archive(folder, "c.warc", record("metadata", "m2", b"c: d", "WARC-Concurrent-To: <r2>") + record("metadata", "m3", b"lost", "WARC-Concurrent-To: <nobody>"), pack=False)
    records = warc.read_records(spark, str(folder))
    rows = {r.record_id: r for r in records.collect()}
    assert set(rows) == {"i", "r1", "q1", "m1", "r2", "m2", "m3"}
    assert rows["r1"].payload == b"body" and rows["r1"].http == "HTTP/1.1 200 OK\r\nX: y" and rows["r1"].headers["x-folded"] == "a b"
    found = {c.record_id: ([r.record_id for r in c.requests or []], [m.record_id for m in c.metadata or []]) for c in warc.transactions(records).collect()}
    assert found == {"r1": (["q1"], ["m1"]), "r2": ([], ["m2"])}
    for name, data in (("cut", one[:-6]), ("between", one + b"junk" + one), ("before", b"junk" + one), ("no_length", one.replace(b"Content-Length", b"Content-Len"))):
        archive(tmp_path / name, "a.warc.gz", data)
        with pytest.raises(Exception, match="a.warc.gz"):
            warc.read_records(spark, str(tmp_path / name)).collect()


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for turns in own.values():
        turns.sort(key=lambda v: v[:2])
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [v[2:] for v in own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]]
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out = []

    def sums(node):
        saved, leaves = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0), not below[node]
        for more, count in map(sums, below[node]):
            saved, leaves = saved + more, leaves + count
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[node]), len(node), above, len(members[node]), len(below[node]), int(leaves), saved, digest))
        return saved, leaves

    if members:
        sums(())
    return sorted(out, key=str)


def turns_of_all_kinds():
    rng = random.Random(3)
    rows = []
    for c in [*range(260), -5, -100, -101, 1000]:
        first = rng.choice(["a", "a", "a", "b", None])
        for t in range(rng.choice([1, 2, 3, 5, 5, 9, 14])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["u", "v", None]) if t > 3 else "u", first if t == 0 else rng.choice(["x", "yy", "é", ""])))
    rows += [(c, t, "u", "same") for c in range(300, 380) for t in range(7)]  # copies of one conversation
    return [*rows, (None, 0, "u", "q"), (None, None, None, None)]


@pytest.mark.parametrize(("shard_turns", "cells"), [(200_000, 1 << 22), (60, 16), (7, 1 << 22)])
def test_trie_equals_brute_force(spark, shard_turns, cells):
    rows = turns_of_all_kinds()
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(5)
    taken = (F.crc32(F.col("id").cast("string").cast("binary")) % 6).cast("int")
    found = prefix_trie.trie(spark, prefix_trie.rebuilt(prefix_trie.sequences(frame), taken), shard_turns, cells)
    got = [tuple(r) for r in found.select("low", "depth", "parent_low", "n", "children", "leaves", "saved", "ends").collect()]
    assert sorted(got, key=str) == brute_trie(rows)
    assert prefix_trie.trie(spark, prefix_trie.rebuilt(prefix_trie.sequences(frame.limit(0)), taken)).collect() == []


def test_trie_of_a_long_conversation_and_chunked_ends(spark):
    long = [(1, t, "u", f"t{t % 50}") for t in range(3000)] + [(2, t, "u", f"t{t % 50}") for t in range(2999)]
    copies = [(c, 0, "u", "hello") for c in range(10, 9010)]
    frame = spark.createDataFrame(long + copies, "conv_id long, turn long, role string, text string")
    nodes = prefix_trie.trie(spark, prefix_trie.sequences(frame).select("id", "turns"), shard_turns=5000)
    rows = nodes.collect()
    assert len(rows) == 3002 and sum(r["depth"] == 1 for r in rows) == 2
    hot = next(r for r in rows if r["n"] == 9000)
    assert hot["ends"] == hashlib.sha256(",".join(map(str, range(10, 9010))).encode()).hexdigest() and hot["saved"] == 8999 * 5
    root = next(r for r in rows if r["depth"] == 0)
    assert (root["low"], root["n"], root["children"], root["leaves"]) == (1, 9002, 2, 2)
    assert root["saved"] == 8999 * 5 + sum(len(f"t{t % 50}") for t in range(2999))
