"""Resampling towards a target distribution by importance weights over hashed n-grams, with a dictionary of distinct features.

1. Documents and target texts become blocks (``word_blocks``): each distinct feature of a block once, with its counts per document.
2. The features of all blocks are counted as strings; each distinct string of the corpus is hashed once, into its bucket.
3. Counts are summed up by bucket on both sides; a bucket's gain is 1000 times the log ratio of the two smoothed
   shares, rounded down. There are ``buckets`` rows of gains, a parameter, so they are sent to the dictionary whole.
4. Gains go back from the dictionary to the blocks' features, and each document adds up its own. Strings are not hashed again.
5. A document's score is its weight plus a Gumbel draw from the digest of seed and doc_id; of the eligible documents the highest scores
   are drawn, which is a draw without replacement in proportion to exp(weight / 1000). Ranks come from ranges and prefix sums,
   so no task holds all documents.

Weights are whole numbers: sums do not depend on their order, and any split of the corpus into blocks gives the same rows.

Defined cases: null or empty texts have no features and weight 0; a null doc_id has the digest of the seed, a colon and nothing and
sorts behind the others; repeated rows are documents of their own, and take ranks one after the other; an empty target gives each bucket
the smoothed share 1 / buckets; an empty table gives no rows. Other columns are carried along by ``draw``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import word_blocks as B
from watchloom.llm.kernel import ALNUM
from watchloom.llm.store import Store, ahead, table
from watchloom.operators.ranks import ranked

BUCKETS, SEED, PERCENT, LEAST = 10_000, 2024, 10, 20


def bucket_gains(dictionary: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket that the documents use; never more than ``buckets`` rows."""
    s = dictionary.groupBy("bucket").agg(F.sum("uses").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("uses").alias("t"))
    both = s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    totals = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s_all")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t_all")))  # one row
    d = lambda c, n: (F.col(c) + n).cast("double")
    share = d("t", 1) * d("s_all", buckets) / (d("s", 1) * d("t_all", buckets))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw, rounded down, from the first 8 hex digits of the digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, seed: int = SEED, size: int = B.SIZE) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) for each row of ``docs``; ``target`` has texts of the wanted kind."""
    store = Store(docs.sparkSession, "importance")
    bucket = F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("bucket")
    blocks = B.written(store, B.cut(docs, ALNUM, order, size), "documents")
    wanted = B.cut(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), ALNUM, order, size)
    known = store.put(B.dictionary(B.entries(blocks)).select("word", "uses", "blocks", bucket), "dictionary")
    aims = store.put(B.dictionary(B.entries(wanted)).select("uses", bucket), "target")
    gains = store.put(bucket_gains(known, aims, buckets), "gains")
    single = (F.instr(F.decode("word", "UTF-8"), " ") == 0).cast("long").alias("single")  # a word, not a run of several
    valued = known.join(F.broadcast(gains), "bucket").select("word", "blocks", "gain", single)

    sums = {"n_words": lambda times, v: times * v("single"), "n_features": lambda times, v: times.astype(np.int64), "weight": lambda times, v: times * v("gain")}
    out = B.per_document(store, "documents", blocks, valued, ["gain", "single"], sums, "n_words long, n_features long, weight long")
    return out.select("row", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST, size: int = B.SIZE) -> DataFrame:
    """``weigh`` with ``rank``: from 1, for the ``percent`` of 100 documents of at least ``least`` words with the highest scores, ties to
    the smaller doc_id; null for the others."""
    store = Store(docs.sparkSession, "resample")
    rows = store.put(weigh(docs, target, order, buckets, seed, size), "weighed")
    fit = rows.where(F.col("n_words") >= least)
    drawn = fit.count() * percent // 100
    order_by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranks = ranked(fit.select("row", "doc_id", "score"), [], order_by).where(F.col("rank") <= drawn).select("row", "rank")
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with n_features, weight, score and rank (for a repeated doc_id its best)."""
    best = F.min_by(F.struct("n_features", "weight", "score", "rank"), "rank").alias("x")
    found = resample(docs, target, **how).where(F.col("rank").isNotNull()).groupBy("doc_id").agg(best).select(F.col("doc_id").alias("_wl_doc"), "x.*")
    kept = ahead(docs, "n_features", "weight", "score", "rank")
    return kept.join(found, kept["doc_id"].eqNullSafe(found["_wl_doc"])).drop("_wl_doc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
dw AS (SELECT doc_id, {LOWERED} AS w FROM documents),
feature AS (SELECT doc_id, unnest(w) AS f FROM dw),
target AS (SELECT unnest({LOWERED}) AS f FROM benchmark),
each AS (SELECT f, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), (2 * i - 1)::BIGINT, 2))::BIGINT) AS b FROM (SELECT f FROM feature UNION SELECT f FROM target)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM each, crc),
s AS (SELECT bucket, count(*) AS s FROM feature JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT count(*) + 10000 FROM feature)::DOUBLE / ((s + 1)::DOUBLE * (SELECT count(*) + 10000 FROM target)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM feature JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM dw LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM ranks) THEN rank END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


def brute_force(docs: list[tuple[int | None, str | None]], target: list[str | None], order: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) from a plain reading of the definition; for tests."""
    import hashlib
    import math
    import re
    import zlib
    from collections import Counter

    def words(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))

    def grams(w: list[str]) -> list[int]:
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(grams(words(x)))
    for x in target:
        t.update(grams(words(x)))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    rows = []
    for i, x in docs:
        w = words(x)
        g = grams(w)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in g)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]
