"""Row numbers and running sums per key without a task per key.

A window over a key sorts all rows of that key in one task. Here the rows are dealt by ranges of (key, order), so a key with
half of all rows is spread over half of the tasks; each range counts its rows by key, the counts are summed up over the
ranges (a row for each range and key in it), and a row's number is its place in the range plus what stands before the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.sources.scratch import Store

ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the row's number from 1 within ``keys`` by ``order``, and for each (new column, column) of
    ``sums`` the sum of that column over the rows of the key up to and with this one.

    ``order`` should tell the rows of a key apart: rows that it does not are numbered in any order. Null keys are a key of
    their own, null values count as nothing in a sum, an empty table gives no rows. The dealt table is written, so that every
    later step sees the same ranges.
    """
    spark, sums = df.sparkSession, sums or {}
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc() for k in keys] + list(order)
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_wl_at", F.monotonically_increasing_id())
    rows = Store(spark, "ranks").put(dealt, "dealt").withColumn("_wl_part", F.shiftright("_wl_at", ROW_BITS))
    totals = [F.sum(c).alias(f"_wl_sum_{i}") for i, c in enumerate(sums.values())]
    counts = rows.groupBy("_wl_part", *keys).agg(F.count(F.lit(1)).alias("_wl_n"), F.min("_wl_at").alias("_wl_first"), *totals)
    # one row for each range and key: at most the number of ranges for any key
    before = Window.partitionBy(*keys).orderBy("_wl_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum("_wl_n").over(before), F.lit(0)).alias("_wl_before"), *[F.coalesce(F.sum(f"_wl_sum_{i}").over(before), F.lit(0)).alias(f"_wl_ahead_{i}") for i in range(len(sums))]]
    offsets = counts.select(F.col("_wl_part").alias("_wl_p"), *[F.col(k).alias(f"_wl_k_{i}") for i, k in enumerate(keys)], "_wl_first", *ahead)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_wl_k_{i}")) for i, k in enumerate(keys)], F.col("_wl_part") == F.col("_wl_p"))
    out = rows.join(offsets, same).withColumn(name, F.col("_wl_before") + F.col("_wl_at") - F.col("_wl_first") + 1)
    own = Window.partitionBy("_wl_part", *keys).orderBy("_wl_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, (new, c) in enumerate(sums.items()):
        out = out.withColumn(new, F.col(f"_wl_ahead_{i}") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return out.select(*df.columns, name, *sums)
