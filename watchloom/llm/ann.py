"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Vectors are dealt to ranges of norms: a range holds norms down to its largest divided by ``RANGE``. In a range, largest inner
product becomes least distance by one more coordinate, sqrt(M**2 - |x|**2), with M the range's largest norm (the query's is
0); so one long vector changes only its own range. A table hashes a vector by ``depth`` Gaussian (2-stable) projections,
each cut into cells of a random offset. ``depth`` follows the range's n vectors so that a bucket holds about ``PER_ROOT`` times the root of n
of them, and never more than about ``bucket``: few vectors are hashed too. Only ranges of under about 160 vectors (as one long vector
makes) are one bucket each, which every query visits.

A score that ``k`` others of a bounded sample reach bounds each query's k-th best from below, so no neighbour has less. A
range whose norms cannot reach it is left out. In the others the query visits a table's buckets in falling order of the
estimated chance that a neighbour of a given similarity lies there (its projection is normal around the query's, moved by
the range's mean added coordinate), until ``mass`` of that chance is covered, for each similarity of ``LEVELS`` down to the
bound: near copies and far neighbours of one query are both looked for. The best-first search over perturbations never
lists buckets that it does not visit. Candidates of all tables are merged and ranked by their inner products in double
precision. Queries that found fewer than ``k``, or that the sample cannot bound, are compared with every vector.

Every vector is indexed; the sample of at most ``2 * SAMPLE`` vectors gives bounds only. Buckets are dealt over tasks in
blocks of at most about ``BLOCK`` vectors, by their counts, so a vector that a third of all rows share makes many blocks and
no large group. Blocks of one table are put together into groups of at most about ``GROUP`` vectors: a query is sent to a group once, with the
buckets that it visits there. It carries its bound along, so of a bucket only what reaches the bound is scored in full and put out.

Defined cases: vectors that are null, empty, of a length other than the queries' commonest, zero, or hold null or non-finite
components take no part; null vec_ids neither; repeated rows are candidates of their own unless all their columns are
equal; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.store import Store, table

SAMPLE, BLOCK, GROUP, PER_ROOT = 20_000, 4096, 65_536, 9.0
#: Inner products held at once, and candidates scored in full at once.
PRODUCTS, SCORED = 1 << 22, 1 << 14
#: Norms are counted in bins of this ratio; a range spans bins of up to RANGE.
BIN, RANGE = 1.02, 1.25
LEVELS = (1.0, 0.97, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.05, -0.1, -0.25, -0.4, -0.55, -0.7, -0.85)
#: Width of a cell; projections of unit vectors are standard normal.
WIDTH = 2.2
SIDE = np.arange(-4, 5)


def _cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution to seven digits (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x > 0, 1 - tail / 2, tail / 2)


def _norms(v: np.ndarray) -> np.ndarray:
    peak = np.abs(v).max(1, keepdims=True)
    return peak * np.sqrt(((v / peak) ** 2).sum(1, keepdims=True))


@dataclass
class Range:
    """Vectors of like norms; cells are numbered from floor((x - offset) / WIDTH). Without depth, one bucket of all."""

    first: int  # number of its first table
    floor: int  # its lowest bin
    norm: float  # largest
    added: float  # mean of the added coordinate
    varied: float  # and its variance
    direction: np.ndarray  # (tables, depth, dims + 1)
    offset: np.ndarray  # (tables, depth)

    def project(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, depth)"""
        n = _norms(v)
        x = np.concatenate([v / n, np.zeros_like(n)], axis=1) if query else np.concatenate([v / self.norm, np.sqrt(np.maximum(0, 1 - (n / self.norm) ** 2))], axis=1)
        t, d, w = self.direction.shape
        return (x @ self.direction.reshape(t * d, w).T).reshape(len(v), t, d)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(rows, tables): the buckets of vectors."""
        return key(np.floor((self.project(v, False) - self.offset) / WIDTH).astype(np.int64))

    def chances(self, p: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables, depth, cells): cells, likeliest first, and the chances that a neighbour of the given similarity lies there."""
        last, s = self.direction[..., -1], near[:, None, None]
        mean = s * p + self.added * last
        spread = np.sqrt(np.maximum(1 - s**2 - self.added**2 - self.varied, 1e-6) + self.varied * last**2)[..., None]
        cells = np.floor((mean - self.offset) / WIDTH).astype(np.int64)[..., None] + SIDE
        lo = (cells * WIDTH + self.offset[..., None] - mean[..., None]) / spread
        chance = _cdf(lo + WIDTH / spread) - _cdf(lo)
        order = np.argsort(-chance, axis=-1, kind="stable")
        return np.take_along_axis(cells, order, -1), np.take_along_axis(chance, order, -1)


def key(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of a table."""
    h = np.full(cells.shape[:-1], 17, np.int64)
    for j in range(cells.shape[-1]):
        h = (h * np.int64(1_000_003) + cells[..., j] + 64) % np.int64((1 << 61) - 1)
    return h


def likeliest(cells: np.ndarray, chance: np.ndarray, mass: float) -> Iterator[tuple[int, ...]]:
    """Buckets (depth, cells) in falling order of their chance, until ``mass`` is covered."""
    first = (0,) * len(cells)
    covered, heap, seen = 0.0, [(-float(chance[:, 0].prod()), first)], {first}
    while heap and covered < mass:
        c, at = heapq.heappop(heap)
        covered -= c
        yield tuple(int(cells[j, i]) for j, i in enumerate(at))
        for j, i in enumerate(at):
            if i + 1 < cells.shape[1] and chance[j, i + 1] > 1e-6:
                more = (*at[:j], i + 1, *at[j + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (c * float(chance[j, i + 1] / chance[j, i]), more))


@dataclass
class Hashing:
    ranges: list[Range]  # by rising norms
    ids: np.ndarray  # of the sample
    sample: np.ndarray
    mass: float

    @classmethod
    def fit(cls, bins: list[tuple[int, int, float, float, float]], ids: np.ndarray, sample: np.ndarray, tables: int, bucket: int, mass: float, seed: int = 3) -> Hashing:
        """From (bin, vectors, least, mean and largest norm) of each bin of norms."""
        groups: list[list] = []
        for b in sorted(bins, reverse=True):
            if groups and groups[-1][0][4] <= RANGE * b[2]:
                groups[-1].append(b)
            else:
                groups.append([b])
        count = lambda g: sum(b[1] for b in g)
        depth = lambda g: max(0, int(round(np.log2(count(g) / min(bucket, PER_ROOT * np.sqrt(count(g)))))))
        merged: list[list] = []
        for g in groups:
            if merged and not depth(g) and not depth(merged[-1]) and count(g) + count(merged[-1]) <= min(bucket, BLOCK):
                merged[-1] = merged[-1] + g
            else:
                merged.append(g)
        r, out, first = np.random.RandomState(seed), [], 0
        for g in reversed(merged):
            d, norm = depth(g), g[0][4]
            t = tables if d else 1
            n = np.array([b[1] for b in g], float)
            added = np.sqrt(np.maximum(0, 1 - (np.array([b[3] for b in g]) / norm) ** 2))
            mean = float((n * added).sum() / n.sum())
            direction = r.standard_normal((t, d, sample.shape[1] + 1))
            out.append(Range(first, g[-1][0], norm, mean, float((n * (added - mean) ** 2).sum() / n.sum()), direction, r.uniform(0, WIDTH, (t, d))))
            first += t
        return cls(out, ids, sample, mass)

    def buckets(self, bins: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(rows, first table, keys of the rows in the tables from there) by ranges."""
        at = np.searchsorted([r.floor for r in self.ranges], bins, "right") - 1
        for i in np.unique(at):
            rows = np.flatnonzero(at == i)
            yield rows, self.ranges[i].first, self.ranges[i].keys(v[rows])

    def bounds(self, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
        """A score that k others of the sample reach; -inf where it has fewer."""
        out = np.full(len(v), -np.inf)
        if k <= len(self.sample):
            s = v @ self.sample.T
            s[ids[:, None] == self.ids] = -np.inf
            out = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return out

    def visits(self, ids: np.ndarray, v: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, table, keys) of the buckets that queries visit; none for those without a bound."""
        bound, n = self.bounds(ids, v, k) if bound is None else bound, _norms(v)[:, 0]
        for r in self.ranges:
            near = bound / n / r.norm
            rows = np.flatnonzero((bound > -np.inf) & (near <= 1 + 1e-9))
            if not r.offset.size:
                yield from ((i, r.first, np.array([17])) for i in rows)
                continue
            near, p = near[rows], r.project(v[rows], True) if len(rows) else None
            found = [[set() for _ in r.direction] for _ in rows]
            for s in (*LEVELS, -1.0):
                # the last level of a row is its own bound
                at = np.flatnonzero(near < s - 0.03) if s > -1 else np.arange(len(rows))
                if not len(at):
                    continue
                cells, chance = r.chances(p[at], np.full(len(at), s) if s > -1 else np.clip(near, -0.999, 1))
                alone = chance[..., 0].prod(-1) >= self.mass
                for j, i in enumerate(at):
                    for t, into in enumerate(found[i]):
                        into.update((tuple(cells[j, t, :, 0].tolist()),) if alone[j, t] else likeliest(cells[j, t], chance[j, t], self.mass))
            for i, of in zip(rows, found, strict=True):
                yield from ((i, r.first + t, key(np.array(sorted(cells), np.int64))) for t, cells in enumerate(of))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col(embedding).cast("array<double>")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine).distinct()


def _matrix(col) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _flat(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _best(row: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best, ties to the smaller id."""
    order = np.lexsort((ids, -s, row))
    row, s, ids = row[order], s[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], s[place < k], ids[place < k]


def rank(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """(query_id, s, id): the k best candidates of each query in a group's buckets that it visits. asked: query_id, qv, least, bs; held:
    b, vec_id, v. What is under ``least``, a score that k others reach, is left out."""
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if len(asked) and len(held):
        b = held.column("b").to_numpy()
        order = np.argsort(b, kind="stable")
        x, ids = _flat(held.column("v"))[order], held.column("vec_id").to_numpy()[order]
        buckets, start = np.unique(b[order], return_index=True)
        stop = np.append(start[1:], len(b))
        q, names, least = _flat(asked.column("qv")), asked.column("query_id").to_numpy(), asked.column("least").to_numpy()
        # near the limit rounding may differ from the final scores, so a little more is scored
        limit = np.where(np.isfinite(least), least - 1e-9 * np.maximum(1.0, np.abs(least)), -np.inf)
        lists = asked.column("bs").combine_chunks()
        owner, wanted = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
        here = np.flatnonzero(buckets[at] == wanted)
        here = here[np.argsort(at[here], kind="stable")]
        at, owner = at[here], owner[here]
        for j, lo, hi in zip(range(len(buckets)), np.searchsorted(at, np.arange(len(buckets))), np.searchsorted(at, np.arange(len(buckets)), "right"), strict=True):
            y, own = x[start[j] : stop[j]], ids[start[j] : stop[j]]
            step = max(1, PRODUCTS // len(y))
            for first in range(lo, hi, step):
                who = owner[first : min(hi, first + step)]
                rough, bar = q[who] @ y.T, limit[who].copy()
                for i in np.flatnonzero(bar == -np.inf):
                    rough[i, own == names[who[i]]] = -np.inf
                    if len(y) > k:
                        edge = np.partition(rough[i], len(y) - k)[len(y) - k]
                        bar[i] = edge - 1e-9 * max(1.0, abs(edge))
                i, c = np.nonzero(rough >= bar[:, None])
                other = own[c] != names[who[i]]
                i, c = i[other], c[other]
                # summed alike for equal vectors, wherever they stand
                exact = [(y[c[n : n + SCORED]] * q[who[i[n : n + SCORED]]]).sum(1) for n in range(0, len(i), SCORED)]
                found.append(_best(who[i], np.concatenate([np.zeros(0), *exact]), own[c], k))
        found = [_best(*(np.concatenate(z) for z in zip(*found, strict=True)), k)]
        found = [(names[found[0][0]], *found[0][1:])]
    return pa.table({"query_id": pa.array(found[0][0], pa.int64()), "s": pa.array(found[0][1], pa.float64()), "id": pa.array(found[0][2], pa.int64())})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 6, bucket: int = 2048, mass: float = 0.36, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each query, its own vec_id left out."""
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "ann")
    rows = usable(vectors, vec_id, embedding)
    asked = usable(queries, vec_id, embedding).withColumnRenamed("vec_id", "query_id")
    # the commonest length of the queries, of equally common ones the smaller
    head = asked.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").head()
    dims = head["d"] if head else 0
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    peak = F.array_max(F.transform("v", F.abs))
    norm = peak * F.sqrt(F.aggregate(F.transform("v", lambda x: x / peak), F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm).withColumn("bin", F.floor(F.log("norm") / log(BIN)))
    bins = [tuple(b) for b in rows.groupBy("bin").agg(F.count(F.lit(1)), F.min("norm"), F.avg("norm"), F.max("norm")).collect()]
    rows, n = rows.drop("norm"), sum(b[1] for b in bins)
    if not n or not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = min(2**63 - 1, -(2**63) + int(min(1.0, SAMPLE / n) * 2**64))
    sample = rows.where(F.xxhash64("vec_id") <= F.lit(top).cast("long")).select("vec_id", "v").orderBy("vec_id").limit(2 * SAMPLE).toPandas()
    fitted = Hashing.fit(bins, sample["vec_id"].to_numpy(), _matrix(sample["v"]) if len(sample) else np.zeros((0, dims)), tables, bucket, mass)
    h = spark.sparkContext.broadcast(fitted)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                ids = p["vec_id"].to_numpy()
                for at, first, keys in h.value.buckets(p["bin"].to_numpy(), _matrix(p["v"])):
                    t = keys.shape[1]
                    yield pd.DataFrame({"t": np.tile(np.arange(first, first + t, dtype=np.int32), len(at)), "b": keys.ravel(), "vec_id": np.repeat(ids[at], t)})

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ids = p["query_id"].to_numpy()
            for lo in range(0, len(p), 128):
                part, v = ids[lo : lo + 128], _matrix(p["v"].iloc[lo : lo + 128])
                bound = h.value.bounds(part, v, k)
                out = [(part[i], bound[i], t, bs) for i, t, bs in h.value.visits(part, v, k, bound)]
                yield pd.DataFrame(out, columns=["query_id", "least", "t", "bs"])

    entries = store.put(rows.mapInPandas(index, "t int, b long, vec_id long"), "index")
    counts = entries.groupBy("t", "b").count()
    # so many vectors a group that a small table has several groups, too
    group = min(GROUP, max(BLOCK, n // 16))
    tasks = -(-n // group) * sum(len(r.direction) for r in fitted.ranges)
    tasks = min(tasks, 2 * -(-n // group) * tables)  # short ranges are a table each
    groups = counts.groupBy("t").agg(F.ceil(F.sum("count") / group).cast("int").alias("groups"))  # a row for each hash table
    sizes = store.put(counts.join(F.broadcast(groups), "t").select("t", "b", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), "groups"), "buckets")
    rows = rows.drop("bin")
    placed = F.pmod(F.xxhash64("b", "block"), F.col("groups")).cast("int").alias("g")
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int")
    held = entries.join(sizes, ["t", "b"]).withColumn("block", block).select("t", placed, "b", "vec_id").join(rows, "vec_id").select("t", "g", "b", "vec_id", "v")

    def best_of(visits: DataFrame, held: DataFrame) -> DataFrame:
        """(query_id, best) from the query_id, least, t, b, blocks and groups of the buckets visited."""
        visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query_id", "least", "t", placed, "b")
        visits = visits.groupBy("query_id", "t", "g").agg(F.min("least").alias("least"), F.collect_set("b").alias("bs"))
        sent = visits.join(asked, "query_id").select("t", "g", "query_id", "least", "bs", F.col("v").alias("qv"))
        # about a group a task: by its bytes a small table would be a task or two, but its work is in the products
        sent, held = sent.repartition(tasks, "t", "g"), held.repartition(tasks, "t", "g")
        found = sent.groupBy("t", "g").cogroup(held.groupBy("t", "g")).applyInArrow(lambda a, h: rank(a, h, k), "query_id long, s double, id long")
        pairs = F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("s"), "id")))
        return found.groupBy("query_id").agg(F.slice(pairs, 1, k).alias("best"))

    visits = asked.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(probe, "query_id long, least double, t int, bs array<long>").select("query_id", "least", "t", F.explode("bs").alias("b"))
    best = store.put(best_of(visits.join(sizes, ["t", "b"]), held), "best")
    full = best.where(F.size("best") >= k)
    few = asked.select("query_id").distinct().join(full, "query_id", "left_anti")
    if not few.isEmpty():
        once = F.col("t").isin([r.first for r in fitted.ranges])
        every = few.crossJoin(sizes.where(once)).withColumn("least", F.lit(float("-inf")))
        best = full.unionByName(best_of(every, held.where(once)))
    return best.select("query_id", F.posexplode("best").alias("rank", "z")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("z.id").alias("vec_id"), (-F.col("z.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """{query's id: ids of its k nearest}, for tests."""
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(1)
        order = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q]
        out[int(q)] = order[:k]
    return out
