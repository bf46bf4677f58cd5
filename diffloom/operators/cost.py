"""Request keys, prices, budgets and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What cached tokens cost against fresh ones, and the output ceilings of the two calls.
CACHE_READ, CACHE_WRITE = 0.1, 1.25
REVIEW_OUTPUT, SUMMARY_OUTPUT = 8000, 2000


def request_key(model: Column, effort: Column, system: Column, user: Column) -> Column:
    """SHA-256 over the four parts, each followed by a NUL (P10)."""
    nul = F.lit("\0")
    return F.sha2(F.concat(model, nul, F.coalesce(F.when(effort != "", effort), F.lit("-")), nul, system, nul, user, nul).cast("binary"), 256)


def with_rates(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(model, run_date) with rate_in and rate_out of the row valid on that day; unknown models take the row with
    the highest output rate (P12). prices(model, valid_from, valid_to, rate_in, rate_out) is a price list: rows of
    a few models, whose size Spark checks before it broadcasts it."""
    top = prices.agg(F.max_by(F.struct("rate_in", "rate_out"), F.struct("rate_out", "rate_in")).alias("top"))
    p = prices.select(F.col("model").alias("_m"), "valid_from", "valid_to", F.col("rate_in").alias("_i"), F.col("rate_out").alias("_o"))
    found = calls.join(p, (F.col("model") == F.col("_m")) & F.col("run_date").between(F.col("valid_from"), F.col("valid_to")), "left")
    priced = found.crossJoin(top)  # one row of maxima
    return priced.withColumn("rate_in", F.coalesce("_i", "top.rate_in")).withColumn("rate_out", F.coalesce("_o", "top.rate_out")).drop("_m", "_i", "_o", "valid_from", "valid_to", "top")


def worst_cost(input_tokens: Column, output_tokens: Column) -> Column:
    """P11, in dollars; rates are dollars a million tokens."""
    return (input_tokens * F.col("rate_in") + output_tokens * F.col("rate_out")) / 1e6


def usage_cost() -> Column:
    """The actual cost of a call."""
    return (F.col("input_tokens") * F.col("rate_in") + F.col("cache_read") * F.col("rate_in") * CACHE_READ + F.col("cache_write") * F.col("rate_in") * CACHE_WRITE + F.col("output_tokens") * F.col("rate_out")) / 1e6


def dry_run(calls: DataFrame) -> DataFrame:
    """change_id, label, tokens, cost, calls: a row for each call and one total (null label) for each change."""
    g = calls.rollup("change_id", "label").agg(F.sum("tokens").alias("tokens"), F.sum("worst").alias("cost"), F.count("*").alias("calls"))
    return g.where("change_id IS NOT NULL")


def budgets(calls: DataFrame, max_input_tokens: int, max_run_cost: float) -> DataFrame:
    """calls with `spent` (actual cost of the change's earlier calls), over_tokens (U3), over_cost.

    Cached calls cost nothing and are never checked. Calls after the first one over a limit are not made: they stay
    in the table with made = false.
    """
    before = W.partitionBy("change_id").orderBy("call_no").rowsBetween(W.unboundedPreceding, -1)
    fresh = ~F.col("hit")
    c = calls.withColumn("spent", F.coalesce(F.sum(F.when(fresh, F.col("actual")).otherwise(0.0)).over(before), F.lit(0.0)))
    c = c.withColumn("over_tokens", fresh & (F.col("tokens") > max_input_tokens)).withColumn("over_cost", fresh & ~F.col("over_tokens") & (F.col("spent") + F.col("worst") > max_run_cost))
    stopped = F.coalesce(F.max(F.col("over_tokens") | F.col("over_cost")).over(before), F.lit(False))
    return c.withColumn("made", ~stopped & ~F.col("over_tokens") & ~F.col("over_cost"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """change_id, label, the four token sums and cost: per call, per change (null label) and in all (both null)."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")]
    return calls.rollup("change_id", "label").agg(*sums, F.sum("actual").alias("cost"))
