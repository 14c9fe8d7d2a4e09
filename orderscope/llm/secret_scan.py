"""Secret scanning with an incremental blob ledger.

Every version of every path is content-addressed by the sha256 of its text.
The ledger (a Parquet table in a shared folder) holds the findings of each
(blob, rule version) pair scanned so far. A scan takes the pairs that the
ledger lacks, picks one row per unseen blob, scans only those texts, appends
to the ledger, and joins the findings back to all paths and versions. A
changed rule set has another version, so it scans all blobs anew and leaves
older findings in place.

Defined results: null text counts as the empty blob; repeated rows each get
their blob's findings; a document without secrets gets zero counts, an empty
span list and the digest of the empty string; an empty table gives none; other
columns are not touched. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm.common import LOC, located, materialise, scratch_session, shared_folder, ship_package, text_of

# The kinds in their listed order, their patterns, the group
# whose length counts and the least length.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

FINDING = "blob string, rule_version string, n_assign long, n_access long, n_hex long, spans string"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    """Spans of one text. A run pattern with a least length is searched with
    that length built in: a maximal run that is too short holds no longer one."""

    def __init__(self, rules=RULES):
        self.assign = re.compile(rules[0][1], re.IGNORECASE | re.ASCII)
        self.group, self.least = rules[0][2:]
        self.access = re.compile(rf"AKIA[A-Z0-9]{{{rules[1][3] - 4},}}")
        self.hex = re.compile(rf"[0-9a-f]{{{rules[2][3]},}}")

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, kind index, end)`` in order."""
        out = []
        low = text.lower()
        if any(word in low for word in KEYWORDS):
            for m in self.assign.finditer(text):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    out.append((m.start(), 0, m.end()))
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(out)


def _scan(version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [scanner.spans(text) for text in batch.column("text").to_pylist()]
            counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(3)]
            joined = [",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans) for spans in found]
            yield pa.record_batch(
                [batch.column("blob"), pa.array([version] * len(found), pa.string()), *[pa.array(c, pa.int64()) for c in counts], pa.array(joined, pa.string())],
                names=[c.split()[0] for c in FINDING.split(", ")],
            )

    return run


class BlobLedger:
    """Findings of all (blob, rule version) pairs scanned so far, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        ship_package(spark)
        self.spark = scratch_session(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "500"})
        self.findings = f"{folder or shared_folder(spark, 'blobs')}/findings"

    def entries(self) -> DataFrame:
        """All findings; the ledger is created empty on first use."""
        self.spark.createDataFrame([], FINDING).coalesce(1).write.mode("append").parquet(self.findings)
        return self.spark.read.schema(FINDING).parquet(self.findings)

    def scan(self, versions: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """``keep`` columns of every row of ``versions``, with its ``blob`` and
        findings under the current rules."""
        version = rule_version()
        own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own")
        _, rows = located(self.spark, versions, [own, text_of(text_col).alias("text")])
        blob = F.sha2(F.encode("text", "utf-8"), 256).alias("blob")
        paths = materialise(self.spark, rows.select("own", blob, *LOC), "paths")
        known = self.entries().where(F.col("rule_version") == version)
        blobs = paths.groupBy("blob").agg(F.min(F.struct(*LOC)).alias("at"))
        unseen = blobs.join(known, "blob", "left_anti").select("blob", "at.*")
        texts = rows.select(*LOC, "text").join(unseen, list(LOC)).select("blob", "text")
        texts.mapInArrow(_scan(version), FINDING).write.mode("append").parquet(self.findings)
        found = self.entries().where(F.col("rule_version") == version).dropDuplicates(["blob"])
        names = found.columns[1:]
        return paths.drop(*LOC).join(found, "blob").select(*[F.col(f"own.`{c}`") for c in keep], "blob", *names)


def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = BlobLedger(spark).scan(docs, ["doc_id"])
    # This method adds no spans of its own: all spans are base spans.
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("spans", "utf-8"), 256).alias("base_sha256"), "spans")
