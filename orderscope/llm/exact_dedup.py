"""Exact deduplication by a stream over keyed, disk-backed state (native).

Arrivals ``(digest, size, id, locator)`` are written to the shared folder and
read as a stream. The stream keeps, per digest and without expiry, the row that
stays so far (its id and its content locator) and the number of rows seen, in
the RocksDB state store; the state is checkpointed to the shared folder, so a
lost executor or a restart resumes from it, and later arrivals can be ingested
into the same ledger. A digest seen more than once is a hit. For hits the full
normalised bytes are compared: those of this ingest with one another, and with
the bytes that earlier ingests saw under the digest, which are read again at
their locator (the ledger keeps the path behind each file hash). Rows whose
bytes differ despite an equal digest are separated again, and the ledger
remembers such digests.

Defined results: null text counts as empty; a row with a null id takes part
and loses ties to any id; repeated rows are rows of their own (only one is
kept); an empty table gives an empty result; other columns are not touched.
A later ingest decides anew on all rows of the ledger. A row is its place in a
file: ingesting a file again adds nothing, whereas input that is no plain file
scan is copied first, so its rows count as new at each ingest. Files must stay
readable as long as the ledger takes arrivals; a row that was rewritten in
place is a new row beside the earlier one, whose bytes can't be compared any
more, so its digest stands for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm.common import LOC, located, located_files, materialise, scratch_session, shared_folder, text_of, without

BLANKS = " \t\n\x0b\x0c\r"
# Marks of hit digests that the byte check's prefilter broadcasts at most.
MARKS = 1 << 18


def normalised(column: str = "text") -> Column:
    """Text without the characters of ``[\\x20\\x09-\\x0D]``; null as empty."""
    return F.translate(text_of(column), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


class Ledger:
    """Keyed state of all content seen so far, kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.arrivals, self.state = f"{folder}/arrivals", f"{folder}/state"
        self.files, self.clashes = f"{folder}/files", f"{folder}/clashes"
        self.spark = scratch_session(
            spark,
            **{
                "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
                # No disk set aside ahead of use: most state partitions are small.
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            },
        )

    def _stored(self, path: str) -> DataFrame | None:
        """A table of the ledger as it is now; None before it is first written."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def arrived(self) -> DataFrame | None:
        return self._stored(self.arrivals)

    def note_files(self, docs: DataFrame, text_col: str) -> None:
        """Remember the paths behind the locators of ``docs``."""
        files = located_files(docs).withColumn("text_col", F.lit(text_col))
        files.write.mode("append").parquet(self.files)

    def content(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``norm``, the normalised text at their locator. Only the
        paths of the files that hold them reach the driver, which lists the
        files of a scan anyway."""
        wanted = self._stored(self.files).join(rows.select(LOC[0]).distinct(), LOC[0], "left_semi")
        paths: dict[str, list[str]] = {}
        for file in wanted.select("text_col", "path").distinct().collect():
            paths.setdefault(file["text_col"], []).append(file["path"])
        text = self.spark.createDataFrame([], f"norm string, {LOC[0]} long, {LOC[1]} long")
        for column, some in paths.items():
            scan = self.spark.read.schema(f"`{column}` string").parquet(*some)
            text = text.unionByName(located(self.spark, scan, [normalised(f"`{column}`").alias("norm")])[1])
        return rows.join(text, list(LOC))

    def known_clashes(self) -> DataFrame | None:
        return self._stored(self.clashes)

    def ingest(self, rows: DataFrame) -> None:
        """Append the arrivals that are new and run the stream until it has
        taken all of them."""
        earlier, schema = self.arrived(), rows.schema
        if earlier is not None:
            rows = rows.join(earlier.select("digest", *LOC), ["digest", *LOC], "left_anti").select(*schema.names)
        rows.write.mode("append").option("compression", "zstd").parquet(self.arrivals)
        stream = (
            self.spark.readStream.schema(schema)
            .parquet(self.arrivals)
            .groupBy("digest")
            .agg(
                F.min(F.struct((-F.col("size")).alias("s"), F.isnull("id").alias("u"), F.col("id").alias("id"), *LOC)).alias("keep"),
                F.count(F.lit(1)).alias("seen"),
            )
        )
        query = (
            stream.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", self.state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def entries(self) -> DataFrame:
        """One row per digest: ``digest, keep (struct), seen`` read from the state."""
        state = self.spark.read.format("statestore").load(self.state)
        return state.select(F.col("key.digest").alias("digest"), F.col("value.min").alias("keep"), F.col("value.count").alias("seen"))


def decisions(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(docs, rows)``: one row per document with ``id, digest, keep_id,
    group_size, kept`` and its locator. ``folder`` names the ledger (a new one
    by default)."""
    docs, rows = located(spark, docs, [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")])
    arrivals = rows.select(
        digest(normalised()).alias("digest"), F.char_length(text_of()).cast("long").alias("size"), "id", *LOC
    )
    ledger = Ledger(spark, folder or shared_folder(spark, "ledger"))
    earlier = ledger.arrived()
    ledger.note_files(docs, text_col)
    ledger.ingest(arrivals)
    arrived = ledger.spark.read.schema(arrivals.schema).parquet(ledger.arrivals)
    entries = materialise(ledger.spark, ledger.entries(), "entries")
    clash = _clashes(ledger, rows.select(digest(normalised()).alias("digest"), normalised().alias("norm")), entries, earlier, digest)
    found = arrived.join(entries, "digest")
    if clash is not None:
        found = found.join(clash, "digest", "left_anti").unionByName(_split(ledger.content(arrived.join(clash, "digest", "left_semi"))))
    return docs, found.select(
        "id",
        "digest",
        F.col("keep.id").alias("keep_id"),
        F.col("seen").alias("group_size"),
        ((F.col(LOC[0]) == F.col(f"keep.{LOC[0]}")) & (F.col(LOC[1]) == F.col(f"keep.{LOC[1]}"))).alias("kept"),
        *LOC,
    )


def _clashes(
    ledger: Ledger, rows: DataFrame, entries: DataFrame, earlier: DataFrame | None, digest: Callable[[Column], Column]
) -> DataFrame | None:
    """Digests under which different bytes were ever seen (None, in practice). The
    smallest and the largest text of a digest are equal only if all are; map
    tasks hand on one pair per digest, so a hot group costs one row per task.
    Rows that can't be hits are left out before the shuffle by a broadcast of
    at most MARKS residues. Of earlier ingests, one row of each digest that is
    met again is enough: theirs were compared when they came."""
    mark = F.pmod(F.xxhash64("digest"), F.lit(MARKS))
    marks = entries.where("seen > 1").select(mark.alias("mark")).distinct()
    hits = rows.withColumn("mark", mark).join(F.broadcast(marks), "mark", "left_semi").select("digest", "norm")
    if earlier is not None:
        first = earlier.groupBy("digest").agg(F.min(F.struct(*LOC)).alias("at"))
        met = materialise(ledger.spark, first.join(rows.select("digest").distinct(), "digest", "left_semi").select("digest", "at.*"), "met")
        hits = hits.unionByName(ledger.content(met).where(digest(F.col("norm")) == F.col("digest")).select("digest", "norm"))
    ends = hits.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    clash, known = materialise(ledger.spark, ends.where("a <> b").select("digest"), "clashes"), ledger.known_clashes()
    if not clash.isEmpty():
        clash.write.mode("append").parquet(ledger.clashes)
        return clash if known is None else clash.union(known).distinct()
    return known if known is None else known.distinct()


def _split(rows: DataFrame) -> DataFrame:
    keep = F.min(F.struct((-F.col("size")).alias("s"), F.isnull("id").alias("u"), F.col("id").alias("id"), *LOC))
    groups = rows.groupBy("digest", "norm").agg(keep.alias("keep"), F.count(F.lit(1)).alias("seen"))
    return rows.join(groups, ["digest", "norm"]).drop("norm").select("digest", "size", "id", *LOC, "keep", "seen")


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) without the rows that are copies of another."""
    docs, found = decisions(spark, docs, id_col, text_col)
    dropped = found.where(~F.col("kept")).select(*LOC)
    return without(docs, dropped)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, found = decisions(spark, docs)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
