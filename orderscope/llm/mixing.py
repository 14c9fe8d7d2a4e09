"""Mixing sources to target weights by Poisson replication (native).

Each source gets a mean repetition rate ``target size / actual size``; every
document inverts the Poisson distribution of that mean at a number hashed from
the seed and its id, is repeated that often, and all repeats are dealt out by
a hash that depends on seed, id and copy: a global shuffle that a rerun
reproduces.

Sizes are counted over all rows, in characters plus one per document (so a
source of empty texts has a size). The distribution function of a source is
tabulated once; a mean over ``CHUNK`` is drawn as a sum of equal parts, which
keeps the tables short and the exponential away from underflow.

Defined results: a null source is a source of its own; null text has size 1;
rows with equal ids repeat equally often; a null id hashes as an empty text;
an empty table stays empty; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm.common import materialise

# Largest mean tabulated in one piece, and the largest number of sources whose
# tables (some 130 numbers each) are broadcast; more are joined by salted keys.
CHUNK = 32.0
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: 52 bits, centred."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``(source, size, weight, rate, pieces, cdf)``. Weights are the given
    ones (absent sources: 0) or ``size ** temperature``; the mix has ``epochs``
    times the size of the input."""
    size = F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("double")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(size.alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    sizes = sizes.join(F.broadcast(total))  # one row
    sizes = sizes.withColumn("rate", F.coalesce(F.try_divide(F.lit(epochs) * F.col("all_size") * F.col("weight"), F.col("all_weight") * F.col("size")), F.lit(0.0)))
    sizes = sizes.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return sizes.select("source", "size", "weight", "rate", "pieces", F.aggregate(steps, start, step, lambda a: a["cdf"]).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus ``copy_index`` (from 1) and ``shuffle_key``,
    repeated and globally shuffled. Own columns of these two names give way."""
    by_source = rates(docs, weights, temperature, epochs, source_col, text_col)
    by_source = materialise(docs.sparkSession, by_source, "rates").select(F.col("source").alias("of"), "pieces", "cdf")
    kept = [c for c in docs.columns if c not in ("copy_index", "shuffle_key")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key")
    docs = docs.select(row, key, F.col(f"`{source_col}`").alias("source"), F.pmod(F.hash(f"`{id_col}`"), F.lit(SALTS)).cast("int").alias("own_salt"))
    same = F.col("source").eqNullSafe(F.col("of"))
    if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(by_source), same)
    else:
        salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.join(salted, same & (F.col("own_salt") == F.col("salt")))

    def drawn(piece: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.col("key"), piece.cast("string"))
        return F.size(F.filter("cdf", lambda c: c < u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("pieces")), F.lit(0), lambda n, piece: n + drawn(piece))
    out = rated.select("row", "key", count.alias("n")).where("n > 0")
    out = out.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_index"))
    digest = F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), "key", F.col("copy_index").cast("string")))
    out = out.select(*[F.col(f"row.`{c}`") for c in kept], "copy_index", digest.alias("shuffle_key"))
    # The key is a digest, so hashing it deals repeats out evenly and at random.
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH s AS (
  SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
r AS (
  SELECT source, (sum(size) OVER ()) * pow(size, 0.5) / ((sum(pow(size, 0.5)) OVER ()) * size) AS rate FROM s),
p AS (
  SELECT source, greatest(ceil(rate / 32), 1)::INT AS pieces, rate / greatest(ceil(rate / 32), 1) AS mean FROM r),
k AS (
  SELECT source, pieces, mean, unnest(generate_series(0, ceil(mean + 12 * sqrt(mean) + 30)::INT)) AS k FROM p),
c AS (
  SELECT source, pieces, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (
  SELECT *, unnest(generate_series(1, pieces)) AS piece
  FROM (SELECT documents.*, pieces FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.source)),
u AS (
  SELECT doc_id, source, piece,
         (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || piece), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM d),
n AS (
  SELECT doc_id, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY doc_id)
SELECT documents.*, g.i::INT AS copy_index, md5('shuffle17|' || doc_id || '|' || g.i) AS shuffle_key
FROM documents JOIN n USING (doc_id), LATERAL (SELECT unnest(generate_series(1, n.n)) AS i) AS g
"""
