"""Problem 9: mixing sources to target shares of the tokens, with capped repeats.

Method: weighted fair queueing. Each source's documents are shuffled by a hash; a document's (or copy's) virtual finish
time is its source's cumulative tokens divided by the source's weight. All copies are sorted by that time over ranges of
it, and cut off at the total budget. Running sums use buckets of bounded size whose totals are added up first, so a
source with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokens import token_counts
from corpusloom.runtime import cut


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, name: str, count: str = "") -> DataFrame:
    """df with `name`, the running sum of value within groups in the order of (bucket, *order), and `count`, the running count.

    The bucket must rise with the order; no bucket should have more rows than a task can sort.
    """
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_rows"))
    out = df.join(offsets, [*groups, bucket]).withColumn(name, F.col("_before") + F.sum(value).over(inner))
    if count:
        out = out.withColumn(count, F.col("_rows") + F.count(F.lit(1)).over(inner))
    return out.drop("_before", "_rows")


def mix(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", model: str = "", budget: int | None = None, seed: int = 7, bucket_rows: int = 100_000,
) -> DataFrame:
    """(position, key, source, copy_no, tokens, finish): the mixture in its order, positions from 1.

    targets: source, target_share, max_repeats. Weights are the shares of the sources that have tokens, scaled to sum 1.
    Without a budget the total is the largest that every such source can fill with its repeats. Rows without tokens, with a
    null source or with one that has no target are left out; repeated rows count as documents of their own.
    """
    t = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("share > 0 AND repeats > 0")
    named = docs.withColumn("_src", F.col(f"`{source}`")).withColumn("_digest", F.xxhash64(F.col(f"`{text}`")))
    counted = token_counts(named, key, text, model, estimate=False, keep=("_src", "_digest")).filter("tokens > 0 AND _src IS NOT NULL")
    # Equal rows are numbered: the order depends on the rows alone, and a repeated key is spread over all buckets.
    once = counted.groupBy("key", "_src", "_digest", "tokens").agg(F.count(F.lit(1)).alias("rows")).select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("twin"))
    rows = cut(once.select("key", F.col("_src").alias("source"), "tokens", F.xxhash64("key", "_digest", "twin", F.lit(seed)).alias("h")), "mix")
    have = rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n")).join(t, "source")
    plan = have.collect()  # one row for each target
    if not plan:
        return rows.select(F.lit(0).cast("long").alias("position"), "key", "source", F.lit(0).alias("copy_no"), "tokens", F.lit(0.0).alias("finish")).limit(0)
    scale = sum(p.share for p in plan)
    most = min(p.repeats * p.total / (p.share / scale) for p in plan)
    budget = int(min(budget, most) if budget is not None else most)
    buckets = max(1, -(-sum(p.n for p in plan) // bucket_rows))
    parts = rows.sparkSession.createDataFrame([(p.source, float(p.share / scale), int(p.total), int(min(p.repeats, -(-budget * p.share / scale // p.total)))) for p in plan], "source string, weight double, total long, copies int")
    placed = rows.join(F.broadcast(parts), "source").withColumn("bucket", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets))
    summed = running_sum(placed, ["source"], "bucket", ["h", "key", "tokens"], "tokens", "cum")
    copies = summed.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no")).withColumn("finish", (F.col("cum") + (F.col("copy_no") - 1) * F.col("total")) / F.col("weight"))
    # A document whose virtual start lies behind the budget can't be within it.
    near = copies.filter(F.col("finish") - F.col("tokens") / F.col("weight") <= float(budget))
    ranges = max(1, -(-int(sum(p.n * min(p.repeats, budget * p.share / scale / p.total + 1) for p in plan)) // bucket_rows))
    sorted_ = running_sum(near.withColumn("range", F.floor(F.col("finish") * (ranges / max(1, budget)))), [], "range", ["finish", "source", "h", "key", "tokens", "copy_no"], "tokens", "running", "position")
    return sorted_.filter(F.col("running") <= budget).select("position", "key", "source", "copy_no", "tokens", "finish")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, docs, most_repeats): actual shares of the mixture, all targets listed."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("key").alias("docs"), F.max("copy_no").alias("most_repeats"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    total = mixed.agg(F.sum("tokens").alias("all_tokens"))
    return t.join(by, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.nullif("all_tokens", F.lit(0))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
