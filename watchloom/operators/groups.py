"""Results of several queries and methods put together: near-equal names grouped in order, ranked by score and by all queries.

A list holds the results of one request in their order. A result joins the first group whose first name is alike beyond a
bound, else it opens a group; which group that is depends on all results before it, so this is a fold over the ordered list. Lists
are sorted where they are read and folded as a stream: a task holds the first names of one list's groups, never a list. Names are
alike by edits, so only first names of nearly the same length are compared, and a comparison ends once the edits are too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.text import edit_similarity
from watchloom.operators.search import combined, top


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits turn a into b: a row of the distance table at a time, no further from the diagonal than that."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            far = most + 1
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), most + 1) <= most


class Leaders:
    """The first names of one list's groups, in order, and by their lengths."""

    def __init__(self, above: float):
        self.above, self.number, self.by_length = above, {}, {}

    def group(self, name: str) -> int:
        """The first group whose name is alike beyond the bound (1 - edits / longer length), or a new one."""
        if name in self.number:  # it was opened because no group before it is alike
            return self.number[name]
        best = None
        for n, held in self.by_length.items():
            longest = max(n, len(name))
            most = max((e for e in range(longest + 1) if 1 - e / longest > self.above), default=-1) if longest else 0
            if abs(n - len(name)) > most:
                continue
            for at, other in held:
                if best is not None and at > best:
                    break
                if within(other, name, most):
                    best = at
                    break
        if best is None:
            best = len(self.number)
            self.by_length.setdefault(len(name), []).append((best, name))
            self.number[name] = best
        return best


def leader_groups(results: DataFrame, by: str, name: str, order: list[Column], above: float = 0.95) -> DataFrame:
    """``results`` with ``group``: the number, from 0, of the result's group in its list ``by``.

    Names are compared trimmed and in lower case. ``order`` should tell the results of a list apart. Null names are empty ones; a
    null list is a list.
    """
    key = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    dealt = results.withColumn("_wl_key", key).repartition(by).sortWithinPartitions(F.col(by), *order)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema] + ["group int"])

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, leaders = object(), Leaders(above)
        for pdf in parts:
            found = []
            for of, k in zip(pdf[by], pdf["_wl_key"], strict=True):
                of = None if pd.isna(of) else of
                if of != here:
                    here, leaders = of, Leaders(above)
                found.append(leaders.group(k))
            yield pdf.drop(columns="_wl_key").assign(group=pd.Series(found, index=pdf.index, dtype="int32"))

    return dealt.mapInPandas(fold, ddl)


def dedup_and_rank(results: DataFrame, queries: DataFrame, by: str, above: float = 0.95, share: float = 0.7) -> DataFrame:
    """The best result of each group of each list, ranked: (by, name, method, score, duplicate_count, methods, relevance, final, rank).

    results: ``by``, name, method, score, place (the order within the list); queries: ``by``, query. A group's best has the highest
    score, of equal ones the first. relevance is the mean likeness of its name to all queries of the list, repeated ones included;
    final is ``share`` of the score and the rest of the relevance. A list without queries has relevance 0.
    """
    grouped = leader_groups(results.select(by, "name", "method", "score", "place"), by, "name", [F.col("place").asc()], above)
    best = F.max_by(F.struct("name", "method", "score", "place"), F.struct("score", -F.col("place"))).alias("b")
    kept = grouped.groupBy(by, "group").agg(best, F.count(F.lit(1)).alias("duplicate_count"), F.array_sort(F.collect_set("method")).alias("methods"))
    asked = queries.groupBy(by).agg(F.collect_list("query").alias("_q"))  # the queries of one request
    total = F.aggregate(F.transform("_q", lambda q: edit_similarity(F.lower(q), F.lower("b.name"))), F.lit(0.0), lambda s, x: s + x)
    relevance = F.when(F.size("_q") > 0, total / F.size("_q")).otherwise(0.0)
    rows = kept.join(asked, by, "left").select(by, "b.name", "b.method", "b.score", "b.place", "duplicate_count", "methods", relevance.alias("relevance"))
    return top(rows.withColumn("final", combined(F.col("score"), F.col("relevance"), share)), 1 << 30, by, "place", "final").drop("place")
