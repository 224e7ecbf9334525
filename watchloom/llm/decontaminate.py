"""Benchmark decontamination by winnowing and a join of fingerprints.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lowered. A span of ``WINDOW`` words is
covered by k-grams of ``K`` words; of each ``WINDOW - K + 1`` consecutive k-gram hashes the least is a fingerprint, so
two texts that share a whole window share a fingerprint. An item of fewer words than a window is one window of its own
length; such lengths (at most ``WINDOW - 1`` of them) keep every gram of the document (a winnowing window of one), since
nothing shorter than the item may be skipped.

1. Items are winnowed where they are scanned: a table of fingerprints and a table of windows (128-bit hash, the words).
2. Documents are winnowed where they are scanned. A bitmap of the benchmark's fingerprints drops most others at once; it
   has 64 bits a fingerprint and never more than ``BITS`` bits (16 MB), however large the benchmark is. What passes
   comes out with the words around it.
3. Both tables of fingerprints are joined; hot ones are salted.
4. Around a hit every window that holds the fingerprint is extended to its full length and joined to the benchmark's
   windows by hash and by the words themselves. Windows that are hit give the hit words and, by one more join, the items.
5. A row's hits are put together by its doc_id and a 128-bit hash of its text (rows alike in both have the same result)
   and joined to the documents; where the table of hits is small, the planner sends it to the documents.

Nothing of the benchmark is built on the driver but the bitmap.

Defined cases: null or empty text has no words and is clean; items without words match nothing; a null item_id counts as
an item named by the empty string; repeated items count once, by item_id; an empty benchmark leaves every document clean;
an empty table of documents gives no rows. Other columns are carried along by ``decontaminate``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.kernel import ALNUM, GOLD, LOWER, U, blocks, mix, ngram_hashes, window_min, word_hashes, word_runs
from watchloom.llm.skew import spread_join
from watchloom.llm.store import Store, ahead, ddl, table

WINDOW, K = 13, 5
BITS = 1 << 27
PAGE = 1 << 15  # bits of one page of a bitmap, as Spark's bitmap functions have it


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lowered bytes, and each text's first word."""
    s, e = word_runs(data, offs, ALNUM)
    return s, e, word_hashes(data, s, e), np.searchsorted(s, offs)


def fingerprints(h: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the k-grams that are the least of some w consecutive ones (of equal ones all)."""
    g = ngram_hashes(h, k)
    if w == 1 or len(g) < w:
        return np.arange(len(g))
    least = window_min(g, w)  # of the windows that start at each position
    around = np.concatenate([least[:1].repeat(w - 1), least, least[-1:].repeat(w - 1)])
    # a gram is picked if it is the minimum of a window that holds it: the largest of those minima
    best = ~window_min(~around, w)
    return np.flatnonzero(g == best[: len(g)])


def clean_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(data[s[i] : e[i]].tobytes() for i in range(at, at + n))


def scheme(n: int) -> tuple[int, int]:
    """Words of a gram and grams of a winnowing window, for windows of n words."""
    return (K, WINDOW - K + 1) if n == WINDOW else (n, 1)


def windows_of(words_: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each n consecutive words."""
    return ngram_hashes(words_, n).view(np.int64), ngram_hashes(mix(words_ ^ U(GOLD)), n).view(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> a row for each window: length, item, two hashes, words, and the fingerprints that start in it."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for lo, hi, data, offs in blocks(batch):
            data = LOWER[data]
            s, e, h, first = words(data, offs)
            out: list[list] = [[] for _ in range(6)]
            for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)):
                n = min(WINDOW, y - x)
                if not n:
                    continue
                k, w = scheme(n)
                prints = ngram_hashes(h[x:y], k)
                picked = set(fingerprints(h[x:y], k, w).tolist())
                w1, w2 = windows_of(h[x:y], n)
                last = len(w1) - 1  # grams behind the last window's start belong to it
                for q in range(len(w1)):
                    mine = [j for j in range(q, len(prints) if q == last else q + 1) if j in picked]
                    row = (n, names[lo + i] or "", int(w1[q]), int(w2[q]), clean_words(data, s, e, x + q, n), prints[mine].view(np.int64).tolist())
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_pydict({"n": pa.array(out[0], pa.int32()), "item": pa.array(out[1], pa.string()), "w1": pa.array(out[2], pa.int64()), "w2": pa.array(out[3], pa.int64()), "words": pa.array(out[4], pa.binary()), "prints": pa.array(out[5], pa.list_(pa.int64()))})


class Bitmap:
    """Which fingerprints may be the benchmark's; pages without any are left out."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        self.bits = bits
        self.number = np.array(sorted(pages), np.int64)
        self.pages = np.frombuffer(b"".join(pages[i] for i in sorted(pages)), np.uint8).reshape(len(pages), PAGE // 8)

    @classmethod
    def build(cls, prints: DataFrame) -> Bitmap:
        """From a written table of (n, g); at most ``BITS`` bits come to the driver."""
        bits = min(BITS, max(PAGE, 1 << int(64 * prints.count()).bit_length()))
        place = F.pmod(F.col("g"), F.lit(bits)) + 1  # the functions count from one
        got = prints.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        return cls(bits, {r["page"] - 1: bytes(r["bits"]) for r in got})

    def holds(self, g: np.ndarray) -> np.ndarray:
        if not len(self.number):
            return np.zeros(len(g), bool)
        at = (g & U(self.bits - 1)).astype(np.int64)
        page = np.minimum(np.searchsorted(self.number, at // PAGE), len(self.number) - 1)
        byte = self.pages[page, at % PAGE // 8]
        return (self.number[page] == at // PAGE) & (byte >> (at % 8).astype(np.uint8) & 1).astype(bool)


def _prints(held, lengths: list[int]):
    """Documents -> (d, t, u, n, g, at, left, words): a fingerprint, its place, the words before it there and all words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        for batch in batches:
            for lo, hi, data, offs in blocks(batch):
                data = LOWER[data]
                s, e, h, first = words(data, offs)
                for n in lengths:
                    k, w = scheme(n)
                    at = fingerprints(h, k, w)
                    g = ngram_hashes(h, k)[at]
                    ok = bitmap.holds(g)
                    at, g = at[ok], g[ok]
                    own = np.searchsorted(first, at, "right") - 1
                    inside = at + k <= first[own + 1]
                    at, g, own = at[inside], g[inside], own[inside]
                    if not len(at):
                        continue
                    x, y = np.maximum(at - (n - k), first[own]), np.minimum(at + n, first[own + 1])
                    ids = [batch.column(i).slice(lo, hi - lo).take(pa.array(own)) for i in range(3)]
                    around = pa.array([clean_words(data, s, e, int(p), int(q - p)) for p, q in zip(x, y, strict=True)], pa.binary())
                    columns = [*ids, pa.array(np.full(len(at), n, np.int32)), pa.array(g.view(np.int64)), pa.array(at - first[own]), pa.array(at - x, pa.int32()), around]
                    yield pa.RecordBatch.from_arrays(columns, names=["d", "t", "u", "n", "g", "at", "left", "words"])

    return run, "d long, t long, u long, n int, g long, at long, left int, words binary"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with the words around them -> every window that holds the fingerprint."""
    for batch in batches:
        n, at, left = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "at", "left"))
        out: list[list] = [[] for _ in range(5)]
        for i, text in enumerate(batch.column(batch.schema.get_field_index("words")).to_pylist()):
            data = np.frombuffer(text, np.uint8)
            s, e, h, _ = words(data, np.array([0, len(data)]))
            w1, w2 = windows_of(h, int(n[i]))
            for q in range(len(w1)):
                row = (i, int(at[i] - left[i] + q), int(w1[q]), int(w2[q]), clean_words(data, s, e, q, int(n[i])))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        own = pa.array(out[0], pa.int64())
        kept = [batch.column(batch.schema.get_field_index(c)).take(own) for c in ("d", "t", "u", "n")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["d", "t", "u", "n", "at", "w1", "w2", "words"])


FOUND = ("n_words", "n_hit", "item_ids", "spans")
KEY = ["_wl_d", "_wl_t", "_wl_u"]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(dict(zip(KEY, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_wl_d, _wl_t, _wl_u, _wl_items, _wl_spans) of the rows with a hit: sorted items, and merged spans of words (written)."""
    spark, store = docs.sparkSession, Store(docs.sparkSession, "winnow")
    held = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = store.put(held.mapInArrow(_items, "n int, item string, w1 long, w2 long, words binary, prints array<long>"), "items")
    prints = store.put(windows.select("n", F.explode("prints").alias("g")).distinct(), "prints")
    lengths = sorted((r["n"] for r in prints.select("n").distinct().collect()), reverse=True)  # at most WINDOW
    run, types = _prints(spark.sparkContext.broadcast(Bitmap.build(prints)), lengths)
    found = store.put(keyed(docs.select("doc_id", "text")).select(*[F.col(k).alias(k[-1]) for k in KEY], "text").mapInArrow(run, types), "found")
    often = found.groupBy("n", "g").agg(F.count(F.lit(1)).alias("of"))
    shared = spread_join(found, prints, ["n", "g"], often, "of", "left_semi")
    tries = store.put(shared.mapInArrow(_extend, "d long, t long, u long, n int, at long, w1 long, w2 long, words binary").distinct(), "tries")
    whole = windows.select("n", "w1", "w2", "words").distinct()
    often = tries.groupBy("n", "w1", "w2", "words").agg(F.count(F.lit(1)).alias("of"))
    same = ["n", "w1", "w2", "words"]
    hit = store.put(spread_join(tries, whole, same, often, "of", "left_semi"), "hit")
    spans = hit.groupBy("d", "t", "u").agg(F.collect_set(F.struct(F.col("at").cast("int").alias("start"), (F.col("at") + F.col("n")).cast("int").alias("end"))).alias("s"))
    each = hit.select("d", "t", "u", *same).distinct()
    often = each.groupBy(*same).agg(F.count(F.lit(1)).alias("of"))
    names = spread_join(each, windows.select(*same, "item").distinct(), same, often, "of").groupBy("d", "t", "u").agg(F.array_sort(F.collect_set("item")).alias("_wl_items"))
    kind = "array<struct<start:int,end:int>>"
    merged = F.aggregate(F.array_sort("s"), F.array().cast(kind), _merge)
    out = spans.select("d", "t", "u", merged.alias("_wl_spans")).join(names, ["d", "t", "u"])
    return store.put(out.select(*[F.col(k[-1]).alias(k) for k in KEY], "_wl_items", "_wl_spans"), "hits")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings) and ``spans`` of hit words [start, end)."""
    docs = ahead(docs, *FOUND)
    both = keyed(docs).join(hits(docs, items), KEY, "left").drop(*KEY)
    counted = both.mapInArrow(_count, ddl(both, "n_words long"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    out = counted.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", F.coalesce("_wl_items", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("_wl_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", hit.alias("n_hit"), "item_ids", "spans")


def _merge(done, x):
    """Adds a span to sorted, disjoint spans; it may overlap the last."""
    top = F.element_at(done, -1)
    joined = F.struct(top.start.alias("start"), F.greatest(top.end, x.end).alias("end"))
    return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).end >= x.start), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch):
            s, _ = word_runs(LOWER[data], offs, ALNUM)
            own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(np.searchsorted(s, offs)))], names=[*batch.schema.names, "n_words"])


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents of which less than a twentieth of the words is hit."""
    names = [f"_wl_{i}" if c.lower() in FOUND else c for i, c in enumerate(docs.columns)]  # found columns may be there already
    clean = find(docs.toDF(*names), items).where(~contaminated())
    return clean.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iat AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM iat),
dat AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT d.doc_id, d.n, d.i, win.item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dat) d JOIN win ON d.n = win.n AND d.s = win.s),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def brute_force(text: str | None, items: list[tuple[int, str]]) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, item ids) by comparing word lists; for tests."""
    import re

    lower = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    doc, hit, names = cut(text), set(), set()
    at = defaultdict(list)
    for n in {min(WINDOW, len(cut(t))) for _, t in items} - {0}:
        for i in range(len(doc) - n + 1):
            at[n, tuple(doc[i : i + n])].append(i)
    for name, t in items:
        w = cut(t)
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for q in at.get((n, tuple(w[i : i + n])), ()):
                hit.update(range(q, q + n))
                names.add(str(name))
    return len(doc), len(hit), sorted(names)
