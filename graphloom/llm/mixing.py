"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source s with n_s rows gets the mean repetition rate lambda_s = total * w_s / sum(w) / n_s. A row's number of
copies is Poisson(lambda_s), found by inverting the distribution at a uniform number that a hash of (seed, source,
doc_id) gives; then copies are dealt out and sorted by a second hash, which is a global shuffle.

Rates above MAX_PIECE_RATE are drawn as the sum of several independent Poisson numbers of a smaller rate, which is the
same distribution; the table of cumulative probabilities so stays short for any rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage

#: A piece's largest rate, and the number of steps of its table: P(X > 63) is below 1e-17 at a rate of 16.
MAX_PIECE_RATE, STEPS = 16.0, 64
LOG_FACTORIAL = [math.lgamma(k + 1) for k in range(STEPS)]
SEED = "mix-1"
#: Sources up to which the table of rates (some 600 bytes a source) is broadcast; beyond, it is joined with salted keys.
MAX_BROADCAST_SOURCES, SALTS = 20_000, 64


def hash_below_one(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def repetition_rates(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None, default_weight: float, rows_out: int | None, source: str) -> DataFrame:
    """(mix_source, rate, pieces, cdf) per source: counts are aggregated before the shuffle, so a hot source costs no more."""
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n"))
    w = F.lit(default_weight)
    if weights:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(F.element_at(table, F.col("mix_source")), w)
    counts = cut_lineage(spark, counts.withColumn("w", w), "sources")
    n_all, w_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    goal = float(n_all if rows_out is None else rows_out)
    rate = F.lit(goal) * F.col("w") / F.lit(float(w_all)) / F.col("n") if w_all > 0 else F.lit(0.0)
    rated = counts.select("mix_source", rate.alias("rate")).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_PIECE_RATE)).cast("int"))
    piece = F.col("rate") / F.col("pieces")
    terms = F.transform(F.array(*map(F.lit, LOG_FACTORIAL)), lambda log_fact, k: F.exp(-piece + k * F.log(piece) - log_fact))
    rated = rated.withColumn("terms", F.when(F.col("rate") > 0, terms).otherwise(F.array(F.lit(1.0))))
    cdf = F.transform(F.sequence(F.lit(1), F.size("terms")), lambda k: F.aggregate(F.slice("terms", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    return rated.select("mix_source", "rate", "pieces", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, default_weight: float = 1.0, rows_out: int | None = None, seed: str = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns of docs, plus mix_copy (from 0), mix_rate and mix_order (the place in the global shuffle).

    weights: target weight by source; others have default_weight (1: all sources alike). rows_out: expected number of
    rows (default: as many as docs has). A weight of 0 drops a source; that is its meaning.

    Null sources form a source of their own, named ''. Null texts are rows like others. Repeated rows (same key and
    source) draw the same number, so each is repeated alike. An empty table gives an empty result. Columns of docs named
    mix_copy, mix_rate or mix_order are replaced; any other names may occur, and come back as they are.
    """
    docs = docs.drop("mix_copy", "mix_rate", "mix_order")
    spark = docs.sparkSession
    rates = repetition_rates(spark, docs, weights, default_weight, rows_out, source)
    ident = [F.lit(seed), F.col("mix_source"), F.col("mix_key")]
    # the columns of docs are one struct from here on, so that their names can't meet those used here
    keyed = docs.select(F.struct("*").alias("mix_row"), F.coalesce(F.col(source), F.lit("")).alias("mix_source"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("mix_key"))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        keyed = keyed.join(F.broadcast(rates), "mix_source")
    else:  # each source's rows are dealt over SALTS keys, so that a hot source isn't one task's
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("mix_salt", F.pmod(F.xxhash64("mix_key", "mix_source"), F.lit(SALTS)).cast("int")).join(salted, ["mix_source", "mix_salt"])
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= hash_below_one(*ident, j.cast("string")))),
    )
    # "cdf" holds P(X <= k); the number of entries at or below u is the smallest k with P(X <= k) > u
    drawn = F.when(F.col("rate") > 0, drawn).otherwise(F.lit(0))
    once = F.when((F.col("rate") > 0) & (F.col("pieces") == 1), F.size(F.filter("cdf", lambda c: c <= F.col("mix_u")))).otherwise(drawn)
    counted = keyed.withColumn("mix_u", hash_below_one(*ident, F.lit("0"))).withColumn("mix_n", once)
    copies = counted.where("mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("order"), *ident, F.col("mix_copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    copies = copies.select("mix_row", "mix_copy", F.col("rate").alias("mix_rate"), order.alias("mix_order"))
    return copies.repartition("mix_order").sortWithinPartitions("mix_order").select("mix_row.*", "mix_copy", "mix_rate", "mix_order")


MIX_SQL = f"""
WITH counts AS (SELECT coalesce(source, '') AS mix_source, count(*) AS n FROM documents GROUP BY 1),
rates AS (
  SELECT mix_source, (SELECT sum(n) FROM counts)::DOUBLE * 1.0 / (SELECT count(*)::DOUBLE FROM counts) / n AS rate FROM counts),
pieces AS (SELECT mix_source, rate, greatest(1, ceil(rate / {MAX_PIECE_RATE})::INT) AS pieces FROM rates),
terms AS (
  SELECT mix_source, rate, pieces,
    list_transform(range(0, {STEPS}), lambda k: exp(-(rate / pieces) + k * ln(rate / pieces) - ([{", ".join(map(repr, LOG_FACTORIAL))}])[k + 1])) AS terms
  FROM pieces),
cdf AS (
  SELECT mix_source, rate, pieces, list_transform(range(1, {STEPS + 1}), lambda k: list_sum(terms[1:k])) AS cdf FROM terms),
drawn AS (
  SELECT d.*, c.rate, c.cdf, j.j,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || j.j), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN cdf c ON coalesce(d.source, '') = c.mix_source, LATERAL (SELECT unnest(range(0, c.pieces)) AS j) j),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, rate, CAST(sum(len(list_filter(cdf, lambda c: c <= u))) AS INT) AS n
  FROM drawn GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, k::INT AS mix_copy, rate AS mix_rate,
  CAST('0x' || substr(md5('order|{SEED}|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || k), 1, 15) AS BIGINT) AS mix_order
FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT doc_id, text, lang, source, n_chars, rate, sum(n)::INT AS n FROM counted GROUP BY ALL) WHERE n > 0)
"""
