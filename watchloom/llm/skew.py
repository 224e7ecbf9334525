"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, HOT = 2048, 4096  # rows of a hot key that stay together; keys that are salted


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined to ``other`` on equal ``keys``; how: inner, left_semi or left.

    ``counts`` holds each key once with the number of its rows in ``rows``. The ``HOT`` most frequent keys with more than
    ``PART`` rows are salted: their rows are dealt by hash over parts of about ``PART``, and the rows of ``other`` with
    such a key are repeated for each part. Every other key has at most a 1 / HOT of all rows. Only the list of the salted
    keys, never more than HOT rows, is broadcast; it decides where rows go, not which rows are joined.
    """
    hot = counts.where(F.col(n) > PART).orderBy(F.col(n).desc(), *keys).limit(HOT).select(*keys, F.ceil(F.col(n) / PART).cast("int").alias("_wl_parts"))
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_wl_parts")).cast("int"), F.lit(0))
    left = rows.join(hot, keys, "left").withColumn("_wl_salt", salt).drop("_wl_parts")
    right = other.join(hot, keys, "left").withColumn("_wl_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_wl_parts"), F.lit(1)) - 1))).drop("_wl_parts")
    return left.join(right, [*keys, "_wl_salt"], how).drop("_wl_salt")
