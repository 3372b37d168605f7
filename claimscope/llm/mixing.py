"""Mixing sources to target weights by Poisson replication, in SQL functions only.

Source s with n_s documents and target share w_s of ``total`` copies gets the mean repetition rate
r_s = w_s * total / n_s. A document's count inverts the Poisson(r_s) distribution at a uniform number
that is the MD5 of (seed, doc_id): the number of k with CDF(k) <= u. The draw depends on nothing else, so a
lost task repeats it exactly. Counts are exploded and the copies shuffled by the MD5 of (seed, doc_id, copy).

Defined cases: null source is a source of its own (the empty name in ``weights``); null text passes;
repeated rows draw the same count each; an empty table gives no rows; sources missing from ``weights`` get weight 0;
null doc_id draws as the text ``null``; columns named ``copy`` or ``mix_key`` are replaced, columns that start with ``_mix_`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources, and numbers in their distributions (8 bytes each), that may be broadcast.
BROADCAST_SOURCES, BROADCAST_NUMBERS = 65_536, 4_000_000
SALTS, PART = 16, 500


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of an MD5; exact as a double."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """(source, n_docs, rate). Without ``weights`` a source's share is n_s ** alpha over the sum of these."""
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("_mix_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        n = n.withColumn("w", F.coalesce(F.try_element_at(listed, F.col("_mix_source")), F.lit(0.0)).cast("double"))
    sums = n.agg(F.sum("w").alias("w_sum"), F.sum("n_docs").alias("n_sum"))  # one row
    goal = F.col("n_sum") if total is None else F.lit(total)
    return n.crossJoin(F.broadcast(sums)).select("_mix_source", "n_docs", F.when(F.col("w_sum") > 0, F.col("w") / F.col("w_sum") * goal / F.col("n_docs")).otherwise(0.0).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """CDF(0), CDF(1), ... as an array that ends where the tail is below double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated by its count, plus ``copy`` (from 1) and ``mix_key``, which replace columns of these names, globally shuffled.

    Rates above 500 are split into equal parts of at most 500 with a draw each, for ``exp(-rate)`` would vanish: their sum is Poisson of the full mean.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "mix_key") and not c.lower().startswith("_mix_")])
    rates = source_rates(docs, weights, alpha, total)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rates = rates.select("_mix_source", parts.alias("_mix_parts"), poisson_cdf(F.col("rate") / parts).alias("_mix_cdf"))
    held = docs.withColumn("_mix_source", F.coalesce("source", F.lit("")))
    size = rates.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_mix_cdf")), F.lit(0)).alias("numbers")).first()
    if size.rows <= BROADCAST_SOURCES and size.numbers <= BROADCAST_NUMBERS:
        held = held.join(F.broadcast(rates), "_mix_source")
    else:  # a source may hold a third of all rows: its documents go to several tasks
        salted = rates.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["_mix_source", "_mix_salt"])
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    part = lambda i: F.when(i > 0, F.concat(F.lit("part"), i.cast("string")))  # noqa: E731  # the first part's seed has no number
    draws = F.transform(F.sequence(F.lit(0), F.col("_mix_parts") - 1), lambda i: _uniform(F.lit(str(seed)), key, part(i)))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("_mix_cdf", lambda c: c <= u)))
    held = held.withColumn("_mix_n", count).filter("_mix_n > 0")
    held = held.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("copy"))
    held = held.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(str(seed)), key, F.col("copy").cast("string"))))
    return held.repartition("mix_key").sortWithinPartitions("mix_key")
