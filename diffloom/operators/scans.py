"""Ordered scans over groups of any size: running sums, the last value before a row, the first after it, next-fit groups.

A window over a whole group lays that group out in one task. Here rows are sorted over ranges first, and a group may fill many of
them. A window sees one group within one range; what it needs of the other ranges is their summaries, a row for each group
and range, which a second, small window adds up. Results do not depend on where the ranges are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffloom.sources.shared import stored


def laid_out(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows, sorted by keys and order over ranges and written so, with _range and _at (unlike for any two rows, rising in order)."""
    by = [*keys, *order]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(spread).withColumn("_range", F.shiftright("_at", 33))


def windowed(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """What `scanned` adds, by windows over whole groups: for groups that fit in a task."""
    sums, last, following = sums or {}, last or {}, following or {}
    own = W.partitionBy(*keys).orderBy(*order)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, -1)
    made = [F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for n, c in sums.items()]
    made += [F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in last.items()]
    made += [F.last(c, ignorenulls=True).over(after).alias(n) for n, c in following.items()]
    return rows.select(*rows.columns, *made)


def scanned(laid: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """laid-out rows with more columns, each over the rows of the same keys, in order.

    sums: the running sum, the row itself included. last: the last value that is not null, the row itself included. following: the
    first value that is not null after the row.
    """
    sums, last, following = sums or {}, last or {}, following or {}
    own = W.partitionBy("_range", *keys).orderBy("_at")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    # what follows is what came before in falling order: a frame that ends at the last row would be worked out anew for every row
    after = W.partitionBy("_range", *keys).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1)
    valued = laid
    for name, c in (sums | last | following).items():
        valued = valued.withColumn(f"_v_{name}", c)
    parts = valued.groupBy(*keys, "_range").agg(
        *(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums),
        *(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_p_{n}") for n in last),
        *(F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_p_{n}") for n in following),
    )
    whole = W.partitionBy(*keys).orderBy("_range")
    ahead = whole.rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_range").alias("_kr"),
        F.count("*").over(W.partitionBy(*keys)).alias("_ranges"),
        *(F.coalesce(F.sum(f"_p_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums),
        *(F.last(f"_p_{n}", ignorenulls=True).over(ahead).alias(f"_o_{n}") for n in last),
        *(F.last(f"_p_{n}", ignorenulls=True).over(behind).alias(f"_o_{n}") for n in following),
    )
    # a group within one range gets nothing from others, and rows are sorted, so a range shares two groups at most: few rows, sent to
    # all tasks, so that the rows themselves are dealt once for a chain of scans
    parts = F.broadcast(parts.where("_ranges > 1").drop("_ranges"))
    out = valued
    for n in sums:
        out = out.withColumn(f"_w_{n}", F.sum(f"_v_{n}").over(upto))
    for n in last:
        out = out.withColumn(f"_w_{n}", F.last(f"_v_{n}", ignorenulls=True).over(upto))
    for n in following:
        out = out.withColumn(f"_w_{n}", F.last(f"_v_{n}", ignorenulls=True).over(after))
    on = out["_range"] == parts["_kr"]
    for i, k in enumerate(keys):
        on &= out[k].eqNullSafe(parts[f"_k{i}"])
    out = out.join(parts, on, "left")
    made = [(F.coalesce(f"_w_{n}", F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in sums] + [F.coalesce(f"_w_{n}", f"_o_{n}").alias(n) for n in (*last, *following)]
    return out.select(*laid.columns, *made)


def next_fit(items: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """items with group_no (long, from 0): in order, an item opens a new group where the open one's sizes and its own pass `limit`.

    The ordered fold of next-fit, in parallel: where a group that begins at an item would end is a search among the prefix sums
    of the sizes (all above zero); the groups that do begin are the orbit of the first item under that step, found by doubling it: log2 of
    the number of groups rounds of joins on (keys, item). No task holds all items of a key.
    """
    laid = laid_out(items, keys, order)
    placed = stored(scanned(laid, keys, sums={"_i": F.lit(1).cast("long"), "_upto": F.col(size).cast("long")}).withColumn("_i", F.col("_i") - 1))
    points = placed.select(*keys, F.col("_upto").alias("_value"), F.lit(0).alias("_ask"), F.col("_i"))
    asks = placed.select(*keys, (F.col("_upto") - F.col(size) + limit).alias("_value"), F.lit(1).alias("_ask"), F.col("_i"))
    found = scanned(laid_out(points.unionByName(asks), keys, ["_value", "_ask"]), keys, following={"_next": F.when(F.col("_ask") == 0, F.col("_i"))})
    step = stored(found.where("_ask = 1 AND _next IS NOT NULL").select(*keys, "_i", F.greatest("_next", F.col("_i") + 1).alias("_next")))
    jumps = [step]
    while not (reached := jumps[-1].where("_i = 0")).isEmpty():
        a, b = jumps[-1], jumps[-1].select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_i").alias("_from"), F.col("_next").alias("_to"))
        on = a["_next"] == b["_from"]
        for i, k in enumerate(keys):
            on &= a[k].eqNullSafe(b[f"_k{i}"])
        jumps.append(stored(a.join(b, on).select(*keys, "_i", F.col("_to").alias("_next"))))
    starts = placed.where("_i = 0").select(*keys, F.lit(0).cast("long").alias("_start"), F.lit(0).cast("long").alias("group_no"))
    for power in range(len(jumps) - 1, -1, -1):
        jump = jumps[power].select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_i", "_next")
        on = starts["_start"] == jump["_i"]
        for i, k in enumerate(keys):
            on &= starts[k].eqNullSafe(jump[f"_k{i}"])
        more = starts.join(jump, on).select(*keys, F.col("_next").alias("_start"), (F.col("group_no") + 2**power).alias("group_no"))
        starts = stored(starts.unionByName(more))
    first = starts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_start", "group_no")
    on = placed["_i"] == first["_start"]
    for i, k in enumerate(keys):
        on &= placed[k].eqNullSafe(first[f"_k{i}"])
    opened = placed.join(first, on, "left").select(*placed.columns, F.col("group_no").alias("_opened"))
    # the group of an item is the last that was opened up to it
    return scanned(opened, keys, last={"group_no": F.col("_opened")}).select(*items.columns, "group_no")
