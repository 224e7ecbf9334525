"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

SuperMinHash gives each shingle one random permutation of the signature's slots; its value for the slot at place j is
j plus a random fraction. As values below j + 1 are settled before place j + 1 is drawn, drawing stops as soon as every slot
is filled below the next place: long texts need one or two draws a shingle, whatever the signature's length. Estimates
have a lower variance than those of independent hashes.

Steps, over tables (nothing about documents is collected):

1. signatures, next to the scan: set size, a 128-bit hash of the set, band hashes, 16 bits of each slot;
2. texts with equal sets form a class, represented by its least doc_id; only representatives go on;
3. within each band bucket every member is paired with the bucket's least member (a star, linear in the bucket); a pair
   whose signatures agree in far fewer slots than the threshold is dropped (``margin`` is close to five standard
   deviations of independent hashes, and more of these), and of each member's pairs the likeliest is verified on the full shingle sets;
4. components of the verified links; members of a bucket that are still in different components are then compared with the
   bucket's members by signature and parity map, in blocks: first the likeliest pairs that would join components are
   verified, then every likely pair between components that are apart even so;
5. components of all links; a class takes its representative's.

With 32 bands of 5 slots, a pair at the threshold of 0.8 shares no bucket with a probability of about 3 in a million.
Buckets have no cap: a bucket that is one component after step 3 needs nothing more, any other is compared in full.

Buckets and centres may be hot: joins on them are salted (``spread_join``), and a bucket that has to be compared is cut
into chunks on both sides, so a task holds at most about two times ``CHUNK`` members of it.

Defined cases: null or blank text has an empty set and links with nothing; a text of fewer words than ``ngram`` is one
shingle; rows with a null doc_id link with nothing, get a null component and are kept; a doc_id is one node whatever the
number of its rows and texts, so all its rows get one component and it links what any of its texts links; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.graph import components
from watchloom.llm.kernel import GOLD, LOWER, SPACED, U, blocks, mix, ngram_hashes, word_hashes, word_runs
from watchloom.llm.skew import spread_join
from watchloom.llm.store import Store, table

BANDS, DEPTH = 32, 5
SLOTS = BANDS * DEPTH
CHUNK = 2048
MAP = 4096  # bits of the parity map of a set


def shingles(data: np.ndarray, offs: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other and sorted within it, and each text's first."""
    data = LOWER[data]
    s, e = word_runs(data, offs, SPACED)
    h = word_hashes(data, s, e)
    first = np.searchsorted(s, offs)
    grams = ngram_hashes(h, ngram)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= ngram:
            out.append(np.unique(grams[a : b - ngram + 1]))
        else:
            out.append(ngram_hashes(h[a:b], n) if n else np.zeros(0, U))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def superminhash(h: np.ndarray, first: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """(texts, m) signatures; a value is (place << 32 | 32 random bits), 2**64 - 1 for a text without shingles."""
    texts = len(first) - 1
    own = np.repeat(np.arange(texts), np.diff(first))
    low = np.full(texts * m, np.iinfo(U).max, U)

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        r = mix(x + U((j + 1) * GOLD & (2**64 - 1)))
        return (r >> U(32)) | U(j << 32), j + ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)

    value, k = draw(h, 0)
    np.minimum.at(low, own * m + k, value)
    top = low.reshape(texts, m).max(1)
    go = (top >= U(1 << 32))[own]
    h, own, k = h[go], own[go], k[go]
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
    rows = np.arange(len(h))
    perm[rows, k], perm[:, 0] = 0, k
    for j in range(1, m):
        if not len(h):
            break
        value, k = draw(h, j)
        rows = np.arange(len(h))
        slot = perm[rows, k]
        perm[rows, k] = perm[:, j]
        np.minimum.at(low, own * m + slot, value)
        if j % 4 == 0 or j < 4:
            ids = np.unique(own)
            go = np.isin(own, ids[low.reshape(texts, m)[ids].max(1) >= U(j + 1 << 32)])
            if not go.all():
                h, own, perm = h[go], own[go], perm[go]
    return low.reshape(texts, m)


def _describe(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each set, band hashes, 16 bits of each slot."""
    sums = [np.concatenate([[U(0)], np.cumsum(mix(h + U(s)))]) for s in (11, 12)]
    a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
    low = superminhash(h, first)
    band = np.zeros((len(low), BANDS), U) + np.arange(BANDS, dtype=U) * U(GOLD)
    for d in range(DEPTH):
        band = mix(band + mix(low[:, d::DEPTH]))
    return a.view(np.int64), b.view(np.int64), band.view(np.int64), (mix(low) >> U(48)).astype(np.uint16)


def parity_maps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, MAP / 8) bytes: each shingle flips one bit. Two maps differ in at most as many bits as their sets in shingles."""
    n = len(first) - 1
    own = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(own * MAP + (mix(h + U(21)) & U(MAP - 1)).astype(np.int64), minlength=n * MAP) & 1
    return np.packbits(odd.astype(bool).reshape(n, MAP), axis=1)


def signatures(docs: DataFrame, ngram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, max_bytes=1 << 19, max_rows=512):
                h, first = shingles(data, offs, ngram)
                a, b, band, bits = _describe(h, first)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n_shingles": pa.array(np.diff(first)), "set_a": a, "set_b": b, "bands": pa.array(list(band), pa.list_(pa.int64())), "bits": [x.tobytes() for x in bits], "parity": [x.tobytes() for x in parity_maps(h, first)]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary, parity binary")


def _agree(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Share of agreeing slots, or -1 where sizes or slots rule the pair out."""
    share = (a == b).mean(-1)
    fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb) * (1 - 1e-9)
    return np.where(fits & (share >= least), share, -1.0)


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the parity maps leave the pair's similarity a chance to reach the threshold; never wrong about a no."""
    most = (na + nb) * (1 - threshold) / (1 + threshold) + 1e-9
    return np.bitwise_count(a ^ b).sum(-1) <= most


def _maps(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint64).reshape(len(col), MAP // 64)


def _forest(pairs: list[tuple]) -> list[tuple]:
    """Of (share, root, other root, ...) those that join components, likeliest first."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for p in sorted(pairs, key=lambda p: (-p[0], *p[1:])):
        a, b = top(p[1]), top(p[2])
        if a != b:
            up[b] = a
            out.append(p)
    return out


def _bits(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), SLOTS)


class NearDuplicates:
    def __init__(self, docs: DataFrame, ngram: int = 2, percent: int = 80, margin: float = 0.15):
        self.spark, self.docs, self.ngram, self.percent = docs.sparkSession, docs, ngram, percent
        self.least, self.store = percent / 100 - margin, Store(docs.sparkSession, "minhash")

    def likely(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose signatures allow a link, with the share of agreeing slots."""
        sig = reps.select("doc_id", "n_shingles", "bits")
        one = sig.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ba"))
        two = sig.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bb"))
        least, threshold = self.least, self.percent / 100

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    share = _agree(_bits(p["ba"]), _bits(p["bb"]), p["na"].to_numpy(), p["nb"].to_numpy(), least, threshold)
                    yield pd.DataFrame({"a": p["a"], "b": p["b"], "share": share})[share >= 0]

        hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        both = spread_join(pairs.join(two, "b"), one, ["a"], hot)
        return both.select("a", "b", "na", "nb", "ba", "bb").mapInPandas(run, "a long, b long, share double")

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Of pairs (a, b) those with 100 * intersection >= percent * union of the full shingle sets."""
        ngram, percent = self.ngram, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = []
                for name in ("ta", "tb"):
                    got = []
                    for _, _, data, offs in blocks(batch, name):
                        h, first = shingles(data, offs, ngram)
                        got += [h[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
                    sets.append(got)
                ok = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_pydict({"u": batch.column(0), "v": batch.column(1)}).filter(pa.array(ok, pa.bool_()))

        a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        both = spread_join(pairs.select("a", "b").join(b, "b"), a, ["a"], hot)
        return both.select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")

    def open_rows(self, members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """(key, doc_id, root) of buckets whose members are in different components; of buckets with the same members one."""
        rooted = members.join(roots, members.doc_id == roots.node, "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("y")]
        split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *same).where("lo <> hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
        split = self.store.put(split, f"split-{name}")
        return self.store.put(spread_join(rooted, split.select("key"), ["key"], split, how="left_semi"), f"open-{name}")

    def rest(self, open_rows: DataFrame, reps: DataFrame, name: str, forest: bool) -> DataFrame:
        """Likely pairs between members of one bucket that are in different components.

        A member outside its bucket's largest component meets all the bucket's members. Buckets of up to ``CHUNK`` members
        stream through their tasks, sorted; of larger ones both the members and those sent to them are cut into chunks, and
        each pair of chunks is a group of its own. Only pairs come out that neither the slots nor the parity maps rule
        out: these bound the sets' difference from below, so hardly any pair under the threshold is left. ``forest`` puts out
        only the likeliest of them that would join components, a pair for each joining; else all come out.
        """
        sizes = open_rows.groupBy("key", "root").count()
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", F.negative("root"))).alias("main"), F.sum("count").alias("n"))
        main = self.store.put(main, f"main-{name}")
        rows = spread_join(open_rows, main, ["key"], main.select("key", "n")).join(reps.select("doc_id", "n_shingles", "bits", "parity"), "doc_id")
        rows = self.store.put(rows, f"rows-{name}")
        again = self.spark.read.schema(rows.schema).parquet(self.store.path(f"rows-{name}"))
        least, threshold = self.least, self.percent / 100

        def links(ids, roots, n, bits, maps, sent) -> list[tuple]:
            """Of the members ``sent`` (doc_id, root, size, slots, map) against the others: (share, root, root, a, b)."""
            out = []
            for d, r, k, b, m in sent:
                at = np.flatnonzero((roots != r) & _near(maps, m, n, np.int64(k), threshold))
                if not len(at):
                    continue
                share = _agree(bits[at], b, n[at], np.int64(k), least, threshold)
                at, share = at[share >= 0], share[share >= 0]
                if forest and len(at):  # the likeliest of each component
                    order = np.lexsort((ids[at], -share))
                    _, first = np.unique(roots[at[order]], return_index=True)
                    at, share = at[order[first]], share[order[first]]
                out += [(s, int(r), int(roots[i]), int(min(d, ids[i])), int(max(d, ids[i]))) for i, s in zip(at, share, strict=True)]
            return _forest(out) if forest else out

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def work(t: pa.Table) -> pa.RecordBatch:
                key, ids, roots, main, n = (t[c].to_numpy() for c in ("key", "doc_id", "root", "main", "n_shingles"))
                bits, maps, out = _bits(t["bits"].to_pylist()), _maps(t["parity"].to_pylist()), []
                edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    at = a + np.flatnonzero(roots[a:b] != main[a:b])
                    out += links(ids[a:b], roots[a:b], n[a:b], bits[a:b], maps[a:b], zip(ids[at], roots[at], n[at], bits[at], maps[at], strict=True))
                pairs = sorted({x[3:] for x in out})
                return pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in pairs], pa.int64()) for i, c in enumerate("ab")})

            left = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                t = t if left is None else pa.concat_tables([left, t])
                edge = np.flatnonzero(np.diff(t["key"].to_numpy())) + 1
                cut = int(edge[-1]) if len(edge) else 0
                left = t.slice(cut)
                if cut:
                    yield work(t.slice(0, cut))
            if left is not None and len(left):
                yield work(left)

        def large(sent: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(sent) and len(held):
                mine = zip(sent["doc_id"], sent["root"], sent["n_shingles"], _bits(sent["bits"]), _maps(sent["parity"]), strict=True)
                out = links(held["doc_id"].to_numpy(), held["root"].to_numpy(), held["n_shingles"].to_numpy(), _bits(held["bits"]), _maps(held["parity"]), mine)
            return pd.DataFrame([x[3:] for x in out], columns=["a", "b"], dtype="int64")

        cols = ["key", "doc_id", "root", "main", "n_shingles", "bits", "parity"]
        few = rows.where(F.col("n") <= CHUNK).select(cols).repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(small, "a long, b long")
        chunks, many = F.ceil(F.col("n") / CHUNK).cast("int"), F.col("n") > CHUNK
        own, all_ = F.pmod(F.xxhash64("doc_id"), chunks).cast("int"), F.explode(F.sequence(F.lit(0), chunks - 1))
        held = rows.where(many).withColumn("chunk", own).withColumn("block", all_)
        sent = again.where(many & (F.col("root") != F.col("main"))).withColumn("block", own).withColumn("chunk", all_)
        by, cols = ["key", "chunk", "block"], ["key", "chunk", "block", *cols[1:]]
        lots = sent.select(cols).groupBy(by).cogroup(held.select(cols).groupBy(by)).applyInPandas(large, "a long, b long")
        return few.unionByName(lots).distinct()

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id and class_id (least doc_id with the same set), a row for each row of the input."""
        store = self.store
        sigs = store.put(signatures(self.docs, self.ngram), "signatures")
        full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = store.put(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id")), "classes")
        picked = full.join(classes, (full.doc_id == classes.class_id) & (full.set_a == classes.set_a) & (full.set_b == classes.set_b), "left_semi")
        reps = store.put(picked.dropDuplicates(["doc_id", "set_a", "set_b"]).select("doc_id", "n_shingles", "bands", "bits", "parity"), "representatives")
        rows = reps.select(F.explode("bands").alias("key"), "doc_id")
        centres = store.put(rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centres")
        members = store.put(spread_join(rows, centres.select("key", "a"), ["key"], centres.select("key", "n")), "members")
        star = self.likely(members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), reps)
        best = store.put(star.groupBy("b").agg(F.max_by("a", F.struct("share", F.negative("a"))).alias("a")).select("a", "b"), "best")
        store.release()
        wanted = members.select("doc_id").distinct()
        texts = store.put(self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), "texts")
        store.release()
        # a doc_id with several sets is one node: it is tied to the class of each
        several = full.groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where("lo <> hi").select("doc_id")
        ties = full.join(several, "doc_id", "left_semi").join(classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).where("u <> v")
        links = store.put(self.verify(best, texts).select("u", "v").unionByName(ties), "links")
        roots = components(links, store, "first")
        for name, forest in (("likeliest", True), ("rest", False)):
            rows = self.open_rows(members, roots, name)
            more = store.put(self.verify(self.rest(rows, reps, name, forest), texts).select("u", "v"), f"links-{name}")
            links = links.unionByName(more)
            store.drop(f"open-{name}", f"rows-{name}", f"main-{name}", f"split-{name}")
            if not more.isEmpty():
                roots = components(links, store, name)
        store.drop("members", "centres", "texts", "best")
        own = sigs.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").withColumn("class_id", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")))
        out = own.join(roots, F.col("class_id") == F.col("node"), "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class_id")).alias("component_id"), "class_id")


def dedup(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a near copy of smaller doc_id in their group."""
    groups = NearDuplicates(docs, ngram, percent).run()
    lost = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost.select(F.col("doc_id").alias("_wl_lost")), F.col("doc_id") == F.col("_wl_lost"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = NearDuplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).run()
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return groups.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "class_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
class AS (SELECT doc_id, list_sort(s) AS s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM sets),
rep AS (SELECT doc_id, s, len(s) AS n FROM class WHERE doc_id = class_id AND len(s) > 0),
item AS (SELECT doc_id, n, unnest(s) AS x FROM rep),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM rep UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
root AS (SELECT a AS class_id, min(b) AS root FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS component_id, doc_id = CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS kept,
  CASE WHEN len(s) = 0 THEN doc_id ELSE class_id END AS class_id
FROM class LEFT JOIN root USING (class_id)
"""


def brute_force(rows: list[tuple[int, str | None]], ngram: int = 2, percent: int = 80) -> dict[int, tuple[int, int]]:
    """{doc_id: (n_shingles, component_id)} from all pairs; for tests."""
    import re

    sets, parent = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else set())
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}
