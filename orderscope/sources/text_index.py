"""A trigram index that lets a regular-expression search skip files.

The index holds, per Parquet file of a table and text column, which three-letter
sequences occur in it, as a bitmap over ``DOMAIN`` hash values (a Bloom filter with
one hash), in one small table next to the facts. A search takes from its pattern
the sequences that every match must contain (``required_trigrams``); files of
which no text column has all sequences of any branch can't match and are not
opened. The search itself then runs on the files that are left, so the rows are
those of a full scan; a pattern from which nothing can be taken scans all files.

Letters are folded as the case-insensitive search compares them: A to Z to lower
case, and the four non-ASCII letters that match an ASCII letter to that letter.
Only ASCII sequences are used. A NULL cell is searched as the text ``nan``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.functions.expressions import text_key
from orderscope.session import ensure_checkpoint_dir
from orderscope.sources.store import _committed, _publish

BITS = 8 * 4096  # bits of one bitmap of the bitmap functions
DOMAIN = 8 * BITS

# Letters that a case-insensitive Unicode match takes as equal to
# an ASCII letter (long s, Kelvin sign, dotless and dotted i), and those letters.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u017f\u212a\u0131\u0130"
FOLD_TO = "abcdefghijklmnopqrstuvwxyzskii"
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def required_trigrams(pattern: str) -> list[set[str]] | None:
    """Per branch of the pattern, sequences that each of its matches contains;
    None if some branch has none (or the pattern uses what isn't read here).

    Only plain literals of the outermost level count: groups, classes and
    escapes other than of a punctuation mark end a run of letters, a
    quantifier that allows none takes its letter out of the run."""
    branches: list[set[str]] = []
    runs: list[str] = [""]
    i, n = 0, len(pattern)

    def close() -> bool:
        found = {r[j : j + 3] for r in runs for j in range(len(r) - 2)}
        branches.append(found)
        runs[:] = [""]
        return bool(found)

    while i < n:
        c = pattern[i]
        if c == "|":
            if not close():
                return None
        elif c == "\\":
            if i + 1 >= n or pattern[i + 1] in "QEx0ucpPk":
                return None
            i += 1
            if pattern[i].isalnum():
                runs.append("")
            else:
                runs[-1] += pattern[i]
        elif c in "([":
            i = _skip(pattern, i)
            if i is None:
                return None
            runs.append("")
        elif c in "*?{":
            # The letter before may be absent; what follows starts a new run.
            runs[-1] = runs[-1][:-1]
            runs.append("")
            if c == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return None
                i = end
        elif c == "+":
            runs.append("")  # the letter is there at least once
        elif c in ".^$)":
            runs.append("")
        else:
            folded = c.translate(_FOLD)
            if folded.isascii():
                runs[-1] += folded
            else:
                runs.append("")
        i += 1
    return branches if close() else None


def _skip(pattern: str, start: int) -> int | None:
    """The place of the bracket that closes the one at ``start``."""
    if pattern.startswith(("(?", "(*"), start) and not pattern.startswith(("(?:", "(?<", "(?=", "(?!"), start):
        return None  # flags change what the rest matches
    depth, in_class, i = 0, False, start
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i < len(pattern) and pattern[i] in "QE":
                return None
        elif in_class:
            if c == "[":
                return None  # nested classes
            in_class = c != "]"
            if not in_class and depth == 0:
                return i
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                return None
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return None


def _place(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(DOMAIN))


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def build(df: DataFrame) -> DataFrame:
    """file, column, bucket, bits: the bitmaps of a plain scan of Parquet files.
    Values that repeat inside a file are looked at once."""
    file = df.metadataColumn("_metadata")["file_path"]
    columns = _text_columns(df)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.translate(text_key(F.col(f"`{c}`")), FOLD_FROM, FOLD_TO).alias("text")) for c in columns]))
    texts = df.select(file.alias("file"), cells.alias("cell")).select("file", "cell.*").distinct()
    ends = F.sequence(F.lit(1), F.greatest(F.char_length("text") - 2, F.lit(1)))
    grams = texts.select("file", "column", F.explode(F.transform(ends, lambda i: F.substring(F.col("text"), i, F.lit(3)))).alias("gram"))
    placed = grams.select("file", "column", _place(F.col("gram")).alias("place"))
    bucket = (F.col("place") / BITS).cast("int")
    return placed.groupBy("file", "column", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BITS).alias("bits"))


class TextIndex:
    """The index of one version of a table (``table_key``), built on first use."""

    def __init__(self, df: DataFrame, table_key: str):
        self.df, self.spark = df, df.sparkSession
        name = hashlib.sha1(f"{table_key}|{DOMAIN}|{df.schema.json()}".encode()).hexdigest()[:16]
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/orderscope_text_index/{name}"
        if _text_columns(df) and not _committed(self.spark, self.path):
            tmp = f"{self.path}.tmp"
            build(df).write.mode("overwrite").parquet(tmp)
            _publish(self.spark, tmp, self.path)

    def files(self, pattern: str) -> list[str] | None:
        """Files that may hold a match; None for all of them."""
        branches = required_trigrams(pattern)
        if branches is None or not _text_columns(self.df):
            return None
        held = self.spark.read.parquet(self.path)
        grams = sorted(set().union(*branches))
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _place(F.col("gram")).alias("place"))
        asked = asked.select("gram", (F.col("place") / BITS).cast("int").alias("bucket"), (F.col("place") % BITS).alias("bit"))
        # The bit in its bitmap: byte bit / 8, counted from the lowest bit.
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
        found = held.join(F.broadcast(asked), "bucket").where(there)  # as many rows as the pattern has sequences
        has = found.groupBy("file", "column").agg(F.collect_set("gram").alias("grams"))
        whole = [F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(b)]), F.col("grams"))) == 0 for b in branches]
        return sorted(r["file"] for r in has.where(reduce(lambda a, b: a | b, whole)).select("file").distinct().collect())

    def candidates(self, pattern: str) -> DataFrame:
        """The table, or the files of it that may hold a match."""
        files = self.files(pattern)
        if files is None:
            return self.df
        reader = self.spark.read.schema(self.df.schema)
        return reader.parquet(*files) if files else self.spark.createDataFrame([], self.df.schema)


def files_of(df: DataFrame) -> Sequence[str]:
    """The files a scan would open."""
    return sorted(df.inputFiles())
