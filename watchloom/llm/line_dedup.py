"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State of the index (written tables, in layers; the newest layer that has a key or shard is right about it):

* ``postings(doc_id, hi, lo, sign)`` - the lines each document holds, by the 128-bit hash of the line's key;
* ``counts(hi, lo, refs, last_doc)`` - the exact reference counts of all keys;
* ``filters(shard, n_keys, filter)`` - one cuckoo filter per shard, holding the keys whose count has reached
  ``min_docs``. A filter has at most ``SHARD_KEYS`` keys; the number of shards follows the number of keys.

``insert`` and ``delete`` add a layer with the postings that come or go, the new counts of their keys alone, and the
filters of the shards in which a key crossed ``min_docs``: what they write follows the change, not the index. After
``LAYERS`` layers the state is written anew as one. Deleting what was inserted gives back the state before.

A line probes its shard's filter first; only lines that the filter may hold are joined to the exact counts, which decide.
Postings are dealt by shard, a large shard over several parts of about ``PROBE`` postings that each get the shard's
filter, so filters meet their lines in the executors and nothing is collected. The join to the counts is salted.

Defined cases: null or empty text is one empty line; rows with a null doc_id keep all their lines and count nowhere;
repeated rows of one doc_id count as one document; equal lines in the last document all stay; an empty table gives no
rows. Other columns of the documents are carried along untouched by ``apply``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from watchloom.llm.kernel import GOLD, U, mix
from watchloom.llm.skew import spread_join
from watchloom.llm.store import Store, ahead, table

BLANK = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 18
PROBE = 1 << 18
LAYERS = 8
SLOTS = 4
KICKS = 200


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 marks a free slot. Works on whole arrays of keys."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8))))), SLOTS), np.uint16) if table is None else table

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(U) * U(GOLD) + U(1))
        return ((h >> U(48)).astype(np.int64) % 65535 + 1).astype(np.uint16), (h & U(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U) + U(GOLD)) & U(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a = self._places(keys)
        b = self._other(a, mark)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def _place(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts at most one fingerprint into each bucket with a free slot; returns which got in."""
        free = (self.table[bucket] == 0).any(1)
        idx = np.flatnonzero(free)
        _, first = np.unique(bucket[idx], return_index=True)
        idx = idx[first]
        slot = (self.table[bucket[idx]] == 0).argmax(1)
        self.table[bucket[idx], slot] = mark[idx]
        done = np.zeros(len(mark), bool)
        done[idx] = True
        return done

    def insert(self, keys: np.ndarray) -> None:
        mark, bucket = self._places(np.asarray(keys, U))
        turn = 0
        while len(mark):
            done = self._place(mark, bucket)
            mark, bucket = mark[~done], bucket[~done]
            if not len(mark):
                return
            bucket = self._other(bucket, mark)
            done = self._place(mark, bucket)
            mark, bucket = mark[~done], bucket[~done]
            full = (self.table[bucket] != 0).all(1) if len(mark) else np.zeros(0, bool)
            if full.any():  # one resident of each full bucket gives way and tries its other bucket
                idx = np.flatnonzero(full)
                _, first = np.unique(bucket[idx], return_index=True)
                idx = idx[first]
                slot = (mark[idx].astype(np.int64) + turn) % SLOTS
                out = self.table[bucket[idx], slot].copy()
                self.table[bucket[idx], slot] = mark[idx]
                mark[idx] = out
                bucket[idx] = self._other(bucket[idx], out)
            turn += 1
            if turn > KICKS:
                raise OverflowError("cuckoo filter is full: more keys than it was sized for")

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one copy of each key's fingerprint; the keys must have been inserted."""
        mark, a = self._places(np.asarray(keys, U))
        b = self._other(a, mark)
        for m, x, y in zip(mark, a, b, strict=True):
            for bucket in (x, y):
                hit = np.flatnonzero(self.table[bucket] == m)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break


def _lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(lines) -> F.Column:
    """For each line its key's hashes and length."""
    key = lambda x: F.translate(F.btrim(x, F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.transform(lines, key), lambda k: F.struct(F.xxhash64(k).alias("hi"), F.xxhash64(F.lit(1), k).alias("lo"), F.length(k).alias("n")))


def _newest(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of the rows of all layers the last one for each key."""
    if len(layers) == 1:
        return layers[0]
    rest = [c for c in layers[0].columns if c not in keys]
    rows = [x.withColumn("_wl_v", F.lit(i)) for i, x in enumerate(layers)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_wl_v").alias("_wl_z")).select(*keys, *[F.col("_wl_z")[c].alias(c) for c in rest])


@dataclass(frozen=True)
class LineIndex:
    """The index over some documents; every method returns a new state and leaves this one as it is."""

    store: Store
    min_chars: int
    min_docs: int
    changes: tuple[DataFrame, ...] = ()  # layers of postings
    levels: tuple[DataFrame, ...] = ()  # layers of counts
    tables: tuple[DataFrame, ...] = ()  # layers of filters
    shards: int = 0
    keys: int = 0  # in the filters

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = 40, min_docs: int = 5) -> LineIndex:
        return cls(Store(spark, "lines"), min_chars, min_docs)

    def _put(self, df: DataFrame, what: str) -> DataFrame:
        return self.store.put(df, f"{what}-{uuid.uuid4().hex[:10]}")

    @property
    def postings(self) -> DataFrame:
        """(doc_id, hi, lo) of the documents now in the index."""
        if len(self.changes) == 1:
            return self.changes[0].select("doc_id", "hi", "lo")
        rows = self.changes[0]
        for more in self.changes[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    @property
    def counts(self) -> DataFrame:
        """(hi, lo, refs, last_doc) of all keys now in the index."""
        return _newest(list(self.levels), ["hi", "lo"]).where("refs > 0")

    @property
    def repeated(self) -> DataFrame:
        """The counts that have reached ``min_docs``."""
        return self.counts.where(F.col("refs") >= self.min_docs)

    @property
    def filters(self) -> DataFrame:
        return _newest(list(self.tables), ["shard"])

    def _shard(self) -> F.Column:
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int")

    def _built(self) -> LineIndex:
        """With filters made anew from the counts."""
        n = self.repeated.count()
        out = replace(self, shards=max(1, -(-n // (SHARD_KEYS * 3 // 4))), keys=n)
        filters = out.repeated.select(out._shard().alias("shard"), "hi").groupBy("shard").applyInPandas(_build, FILTER)
        return replace(out, tables=(self._put(filters, "filters"),))

    def line_keys(self, docs: DataFrame) -> DataFrame:
        """(doc_id, hi, lo): the distinct long keys of each row."""
        long = F.filter(_keys(_lines(F.col("text"))), lambda k: k.n >= self.min_chars)
        pairs = F.array_distinct(F.transform(long, lambda k: F.struct(k.hi.alias("hi"), k.lo.alias("lo"))))
        return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(pairs).alias("k")).select("doc_id", "k.hi", "k.lo")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; those of a doc_id that the index has already add the lines it did not have."""
        found = self.line_keys(docs)
        if not self.changes:
            new = self._put(found.withColumn("sign", F.lit(1)), "postings")
            sums = new.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("refs"), F.max("doc_id").alias("last_doc"))
            return replace(self, changes=(new,), levels=(self._put(sums, "counts"),))._built()
        found = self._put(found.distinct(), "found")
        held = self.postings.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
        new = self._put(found.join(held, ["doc_id", "hi", "lo"], "left_anti").withColumn("sign", F.lit(1)), "postings")
        delta = new.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("by"), F.max("doc_id").alias("newest"))
        return self._layer(new, delta, F.greatest("newest", "last_doc"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes the documents of these doc_ids out again: counts fall, and keys below the bound leave the filters."""
        if not self.changes:
            return self
        gone = self.postings.distinct().join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        # a document's rows may repeat in the first layer; all of them go
        gone = self._put(gone.withColumn("sign", F.lit(-1)), "gone")
        rows = self.changes[0].join(gone.select("doc_id", "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi")
        for more in self.changes[1:]:
            rows = rows.unionByName(more.join(gone.select("doc_id", "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi"))
        gone = self._put(rows.groupBy("doc_id", "hi", "lo").agg((-F.sum("sign")).cast("int").alias("sign")), "postings")
        touched = gone.select("hi", "lo").distinct()
        left = self.postings.join(touched, ["hi", "lo"], "left_semi").join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
        left = left.groupBy("hi", "lo").agg(F.max("doc_id").alias("newest"))
        delta = gone.groupBy("hi", "lo").agg((-F.count(F.lit(1))).alias("by")).join(left, ["hi", "lo"], "left")
        return self._layer(gone, delta, F.col("newest"))

    def _layer(self, changed: DataFrame, delta: DataFrame, last_doc: F.Column) -> LineIndex:
        """The state behind a change: ``delta`` has the touched keys (hi, lo, by, newest)."""
        delta = self._put(delta, "delta")
        old = _newest([x.join(delta.select("hi", "lo"), ["hi", "lo"], "left_semi") for x in self.levels], ["hi", "lo"])
        both = delta.join(old, ["hi", "lo"], "left").withColumn("was", F.coalesce("refs", F.lit(0)))
        level = self._put(both.select("hi", "lo", (F.col("was") + F.col("by")).alias("refs"), last_doc.alias("last_doc"), "was"), "counts")
        crossed = level.where((F.col("was") >= self.min_docs) != (F.col("refs") >= self.min_docs)).select(self._shard().alias("shard"), "hi", "lo", (F.col("was") >= self.min_docs).alias("out"))
        n = {r["out"]: r["count"] for r in crossed.groupBy("out").count().collect()}
        out = replace(self, changes=(*self.changes, changed), levels=(*self.levels, level.drop("was")), keys=self.keys + n.get(False, 0) - n.get(True, 0))
        if len(out.changes) > LAYERS:
            whole = out._put(out.postings.withColumn("sign", F.lit(1)), "postings")
            return replace(out, changes=(whole,), levels=(out._put(out.counts, "counts"),))._built()
        if out.keys > SHARD_KEYS * self.shards:
            return out._built()
        if not n:
            return out
        held = self.filters.join(crossed.select("shard").distinct(), "shard", "left_semi")
        made = out._put(crossed.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(_change, FILTER), "changed")
        # a filter without room is built anew
        full = out.repeated.select(self._shard().alias("shard"), "hi").join(made.where("filter IS NULL").select("shard"), "shard", "left_semi")
        filters = made.where("filter IS NOT NULL").unionByName(full.groupBy("shard").applyInPandas(_build, FILTER))
        return replace(out, tables=(*self.tables, out._put(filters, "filters")))

    def candidates(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters may hold; a superset of the repeated ones by about one in ten thousand."""
        rows = keys.withColumn("shard", self._shard())
        # 12 bytes for each 200,000 repeated keys
        parts = F.broadcast(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBE).cast("int").alias("parts")))
        dealt = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
        held = self.filters.select("shard", "filter").join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter")
        return dealt.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInPandas(_probe, keys.schema)

    def drops(self) -> DataFrame:
        """(doc_id, hi, lo): the lines that each indexed document loses."""
        maybe, held = self.candidates(self.postings), self.repeated
        exact = spread_join(maybe, held.select("hi", "lo", "last_doc"), ["hi", "lo"], held.select("hi", "lo", "refs"), "refs")
        return exact.where(F.col("doc_id") < F.col("last_doc")).select("doc_id", "hi", "lo")

    def apply(self, docs: DataFrame) -> DataFrame:
        """The documents with ``n_lines``, ``n_dropped`` and the remaining ``kept_text``."""
        lost = self.drops().groupBy(F.col("doc_id").alias("_wl_id")).agg(F.collect_set(F.struct("hi", "lo")).alias("_wl_lost"))
        docs = ahead(docs, "n_lines", "n_dropped", "kept_text")
        d = docs.join(lost, F.col("doc_id").cast("long") == F.col("_wl_id"), "left")
        lines = _lines(F.col("text"))
        keys = F.when(F.col("_wl_lost").isNotNull(), _keys(lines))
        field = lambda name: F.transform(keys, lambda k: k[name])
        d = d.withColumn("_wl_out", _lost(field("hi"), field("lo"), F.col("_wl_lost.hi"), F.col("_wl_lost.lo")))
        some = F.col("_wl_out").isNotNull()
        left = F.filter(F.zip_with(lines, "_wl_out", lambda x, out: F.when(~out, x)), lambda x: x.isNotNull())
        return d.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.size(lines).cast("long").alias("n_lines"),
            F.when(some, F.size(F.filter("_wl_out", lambda x: x))).otherwise(0).cast("long").alias("n_dropped"),
            F.when(some, F.array_join(left, "\n")).otherwise(F.coalesce("text", F.lit(""))).alias("kept_text"),
        )


@F.pandas_udf(ArrayType(BooleanType()))
def _lost(hi: pd.Series, lo: pd.Series, lost_hi: pd.Series, lost_lo: pd.Series) -> pd.Series:
    """For each line whether it is among the lost; null where a document loses none."""
    out = []
    for a, b, x, y in zip(hi, lo, lost_hi, lost_lo, strict=True):
        if x is None:
            out.append(None)
            continue
        gone = set(zip(x.tolist(), y.tolist(), strict=True))
        out.append([k in gone for k in zip(a.tolist(), b.tolist(), strict=True)])
    return pd.Series(out, dtype=object)


FILTER = "shard int, n_keys long, filter binary"


def _change(turned: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with keys taken out and put in; null where it has no room or does not exist yet."""
    shard = int((turned if len(turned) else held)["shard"].iloc[0])
    out = turned["hi"].to_numpy(np.int64).view(U)[turned["out"].to_numpy(bool)] if len(turned) else np.zeros(0, U)
    new = turned["hi"].to_numpy(np.int64).view(U)[~turned["out"].to_numpy(bool)] if len(turned) else np.zeros(0, U)
    blob, n = None, len(new)
    if len(held):
        f, n = CuckooFilter.load(bytes(held["filter"].iloc[0])), int(held["n_keys"].iloc[0]) + len(new) - len(out)
        if n <= 0.9 * f.table.size:
            try:
                f.delete(out)
                f.insert(new)
                blob = f.dump()
            except OverflowError:
                blob = None
    return pd.DataFrame({"shard": [shard], "n_keys": [n], "filter": [blob]})


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["hi"].to_numpy(np.int64).view(U)
    room = len(keys)
    while True:
        f = CuckooFilter(room)
        try:
            f.insert(keys)
            break
        except OverflowError:  # many equal fingerprints: one size more
            room = len(f.table) * SLOTS
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_keys": [len(keys)], "filter": [f.dump()]})


def _probe(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The keys of a part of a shard that the shard's filter may hold."""
    keys = keys.drop(columns=["shard", "part"])
    if not len(held) or not len(keys):
        return keys[:0]
    return keys[CuckooFilter.load(bytes(held["filter"].iloc[0])).contains(keys["hi"].to_numpy(np.int64).view(U))]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents with the lines that ``LineIndex`` drops taken out of ``text``, and ``n_chars`` set to what is left."""
    names = [f"_wl_{i}" if c.lower() in ("n_lines", "n_dropped", "kept_text") else c for i, c in enumerate(docs.columns)]
    docs, columns = docs.toDF(*names), docs.columns
    out = LineIndex.empty(docs.sparkSession, min_chars, min_docs).insert(docs).apply(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[(new[n] if n in new else F.col(f"`{n}`")).alias(c) for n, c in zip(names, columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = LineIndex.empty(spark).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id < h.last_doc) AS dropped
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
