"""Mergeable partial states of an order fact, kept up to date file by file.

A dashboard refresh asks dozens of questions of one table. Most of them are
sums, counts, minima and maxima over a few small keys, so the table is read once
into partial states: one row per (hour of the order, platform, area, order
class, status, late or not, scored or not) with the sums and counts that the
datasets need, and one KLL sketch of the delivery minutes per (day, platform,
area). States of disjoint files merge by adding up, so when files arrive only
these are read (``PartialStore.refresh``), and every question is answered from the
states (``plans/refresh.py``).

Layout under the store's folder: ``gen=<n>/files/batch=<b>`` (path, length and
modification time of every file read so far), ``gen=<n>/states/batch=<b>``,
``gen=<n>/sketches/batch=<b>``. A batch counts once its ``files`` entry is
committed, which is written last: a refresh that dies leaves an unread folder
behind and nothing else. If a file that was read is gone or has changed, its
share can't be taken out of minima, maxima and sketches, so all files are read
into the next generation. One refresh of a store runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.functions.expressions import net_revenue, safe_div
from orderscope.operators.filters import SCORE_HIGH, SCORE_LOW
from orderscope.sources.store import _committed, _fs

KEYS = ("at", "on_hour", "platform", "macro_bairro", "order_mode", "status", "late", "scored")
SKETCH_KEYS = ("day", "platform", "macro_bairro")
KLL_K = 400
# Normalised rank error of a KLL sketch of this k, at 99 % confidence: the
# published fit 2.296 / k ** 0.9021 of single-sided error.
RANK_ERROR = 2.296 / KLL_K**0.9021

# name -> the value that is summed and counted (as s_<name>, n_<name>)
SUMMED: dict[str, Callable[[], Column]] = {
    "total": lambda: F.col("total_brl"),
    "net": lambda: net_revenue(F.col("total_brl"), F.col("platform_commision_pct")),
    "items": lambda: F.col("num_itens"),
    "ticket": lambda: safe_div(F.col("total_brl"), F.col("num_itens")),
    "prep": lambda: F.col("tempo_preparo_minutos"),
    "delivery": lambda: F.col("actual_delivery_minutes"),
    "delay": lambda: F.col("actual_delivery_minutes") - F.col("eta_minutes_quote"),
    "distance": lambda: F.col("distance_km"),
    "score": lambda: F.col("satisfacao_nivel"),
}


def states(fact: DataFrame) -> DataFrame:
    """One row per ``KEYS`` of a canonical fact: ``n``, s_ and n_ of every entry
    of ``SUMMED``, ``n_late``, ``n_satisfied``, ``dt_min``, ``dt_max``."""
    ts = F.col("order_datetime")
    at = F.date_trunc("hour", ts).cast("timestamp_ntz")
    delay = SUMMED["delay"]()
    rows = fact.select(
        "*", at.alias("at"), (ts == at).alias("on_hour"), (delay > 0).alias("late"),
        F.coalesce(F.col("satisfacao_nivel").between(SCORE_LOW, SCORE_HIGH), F.lit(False)).alias("scored"),
    )
    sums = [a for name, value in SUMMED.items() for a in (F.sum(value()).alias(f"s_{name}"), F.count(value()).alias(f"n_{name}"))]
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), *sums, F.count_if(delay > 0).alias("n_late"),
        F.count_if(F.col("satisfacao_nivel") >= 4.5).alias("n_satisfied"), F.min(ts).alias("dt_min"), F.max(ts).alias("dt_max"),
    )


def sketches(fact: DataFrame) -> DataFrame:
    """One KLL sketch of the delivery minutes per ``SKETCH_KEYS``, and ``n``."""
    rows = fact.where(F.col("actual_delivery_minutes").isNotNull())
    day = F.to_date("order_datetime").alias("day")
    return rows.groupBy(day, "platform", "macro_bairro").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("actual_delivery_minutes", KLL_K).alias("sketch")
    )


class PartialStore:
    """The states of a folder of fact files, in ``folder`` on shared storage."""

    def __init__(self, spark: SparkSession, source: str, folder: str, read: Callable[[list[str]], DataFrame] | None = None):
        """``read`` makes a canonical fact of some files; without one they are
        Parquet files of canonical columns."""
        self.spark, self.source, self.folder = spark, source.rstrip("/"), folder.rstrip("/")
        self.read = read or (lambda paths: spark.read.parquet(*paths))

    def _generation(self) -> int:
        fs, path = _fs(self.spark, self.folder)
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[4:]) for n in names if n.startswith("gen=") and _committed(self.spark, f"{self.folder}/{n}/files/{self._first(n)}")), default=0)

    def _first(self, generation: str) -> str:
        fs, path = _fs(self.spark, f"{self.folder}/{generation}/files")
        return next((s.getPath().getName() for s in fs.listStatus(path)), "none") if fs.exists(path) else "none"

    def _batches(self, generation: int) -> list[str]:
        fs, path = _fs(self.spark, f"{self.folder}/gen={generation}/files")
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n for n in names if _committed(self.spark, f"{self.folder}/gen={generation}/files/{n}")]

    def _listing(self) -> DataFrame:
        """Every source file; a scan whose content column is pruned."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.source)
        return found.select("path", "length", F.unix_micros("modificationTime").alias("modified"))

    def refresh(self) -> int:
        """Read the files that the states lack; how many those were."""
        generation = self._generation()
        batches = self._batches(generation) if generation else []
        listing = self._listing()
        if batches:
            ledger = self.spark.read.parquet(*[f"{self.folder}/gen={generation}/files/{b}" for b in batches])
            keys = ["path", "length", "modified"]
            fresh = listing.join(ledger, keys, "left_anti")
            if not ledger.join(listing, keys, "left_anti").isEmpty():
                generation, batches, fresh = generation + 1, [], listing
        else:
            generation, fresh = generation or 1, listing
        new = fresh.collect()  # the files that came since the last refresh
        if not new:
            return 0
        # A first build reads the folder; later ones name the files.
        fact = self.read([r["path"] for r in new] if batches else [self.source])
        batch = f"batch={uuid.uuid4().hex[:16]}"
        home = f"{self.folder}/gen={generation}"
        states(fact).write.parquet(f"{home}/states/{batch}")
        sketches(fact).write.parquet(f"{home}/sketches/{batch}")
        self.spark.createDataFrame(new, listing.schema).coalesce(1).write.parquet(f"{home}/files/{batch}")
        return len(new)

    def _held(self, kind: str) -> DataFrame:
        generation = self._generation()
        batches = self._batches(generation) if generation else []
        if not batches:
            raise ValueError("the store is empty: refresh() first")
        return self.spark.read.parquet(*[f"{self.folder}/gen={generation}/{kind}/{b}" for b in batches])

    def states(self) -> DataFrame:
        return self._held("states")

    def sketches(self) -> DataFrame:
        return self._held("sketches")

    def compact(self) -> None:
        """Merge the states of all batches into the next generation, so that
        their number doesn't grow with the refreshes."""
        generation = self._generation()
        batches = self._batches(generation)
        if len(batches) < 2:
            return
        home, batch = f"{self.folder}/gen={generation + 1}", f"batch={uuid.uuid4().hex[:16]}"
        held = self.states()
        least, most = F.min("dt_min").alias("dt_min"), F.max("dt_max").alias("dt_max")
        sums = [F.sum(c).alias(c) for c in held.columns if c not in (*KEYS, "dt_min", "dt_max")]
        held.groupBy(*KEYS).agg(*sums, least, most).select(*held.columns).write.parquet(f"{home}/states/{batch}")
        merged = F.kll_merge_agg_double("sketch", KLL_K).alias("sketch")
        self.sketches().groupBy(*SKETCH_KEYS).agg(F.sum("n").alias("n"), merged).write.parquet(f"{home}/sketches/{batch}")
        ledger = self.spark.read.parquet(*[f"{self.folder}/gen={generation}/files/{b}" for b in batches])
        ledger.coalesce(1).write.parquet(f"{home}/files/{batch}")
