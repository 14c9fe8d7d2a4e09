"""The pipeline's stages on a small corpus, and their decisions."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from orderscope.llm import exact_dedup, jaccard_join, mixing, packing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        after = spark.read.parquet(path)
        if name == "packing":
            assert after.agg({"length": "sum"}).first()[0] >= docs.count()
            break
        assert after.columns == names and {r["doc_id"]: r["text"] for r in after.collect()}.items() <= before.items()
        if name == "toxicity":
            gone = set(before) - {r["doc_id"] for r in after.collect()}
            clean = [i for i in before if marks.get(i) == 0]
            assert gone and sum(i in gone for i in clean) <= 0.1 * len(clean)
        if name == "exact_dedup":
            assert all(r["kept"] for r in exact_dedup.decisions(spark, after)[1].collect())
        if name == "near_dedup":
            assert all(r["keeps"] for r in jaccard_join.classes(spark, after)[1].collect())
        docs = after
    assert corpus_pipeline.run(spark, SF).columns == [c.split()[0] for c in packing.PACKED.split(", ")]


def brute_near(rows):
    """One id (the smallest) of each component of texts at a Jaccard similarity of 0.8 of five-word shingles."""
    sets, root = {}, {i: i for i in rows}
    for i, t in rows.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(i) for i in rows}


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        got = Counter(spark.read.parquet(path).collect())
        if name == "toxicity":
            model = toxicity.fit(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.fold("doc_id", 5) != 0)
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
            want = Counter(r for r in rows if scores[r["doc_id"]] < 0.5)
        elif name == "exact_dedup":
            groups = {}
            for r in rows:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
            want = Counter(min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values())
        elif name == "near_dedup":
            keep = brute_near({r["doc_id"]: r["text"] for r in rows})
            want = Counter(r for r in rows if r["doc_id"] in keep)
        else:
            con = duckdb.connect()
            con.register("documents", docs.toArrow())
            counts = Counter(i for (i,) in con.execute(f"SELECT doc_id FROM ({mixing.OP1_SQL})").fetchall())
            want = Counter({r: counts[r["doc_id"]] for r in rows if counts[r["doc_id"]]})
        assert got == want and got, name
        docs = spark.read.parquet(path)
    tk = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in got}
    held = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        data = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(data) and zlib.crc32(data[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        for at in range(r["start"], r["start"] + r["length"]):
            held[r["doc_id"], at] += 1
    copies = Counter()
    for r, n in got.items():
        copies[r["doc_id"]] += n
    assert held == Counter({(i, at): n for i, n in copies.items() for at in range(len(ids[i]))})


def test_mixing_stage_keeps_clashing_columns(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], i * 10, f"k{i}", "d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy_index int, shuffle_key string, _doc string")
    out = corpus_pipeline.mixed(spark, docs, SF)
    got = out.collect()
    assert out.columns == docs.columns and got and {tuple(r) for r in got} <= set(rows)
    plain = mixing.mix(docs.drop("copy_index", "shuffle_key"))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in plain.collect())
