"""Language ID by nearest centroid over normalised TF-IDF vectors of hashed byte n-grams.

Fit: of each language at most ``per_language`` labelled documents (those with the lowest hashes of their ids) are turned
into vectors on the executors; the driver computes document frequencies and a few spherical k-means centroids per
language from this bounded sample. Every text is then scored whole, next to the scan, against all centroids by cosine.
A text whose cosine stays under its language's bound is rejected: the bound lies ``slack`` below the lowest cosine of the
sample's own documents, widened for short texts, whose vectors are sparse.

Defined cases: a null text or one without any letter is ``und`` with score 0 and rejected; with nothing to learn from all
are; equal cosines go to the language that sorts first; a null doc_id is neither learned from nor held out; repeated rows
are scored alike; an empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.features import LETTERS, gram_counts, unit
from watchloom.llm.kernel import blocks
from watchloom.llm.store import ahead, ddl, table

ORDERS = ((1, 8), (2, 10), (3, 12))  # order, bits
ROWS = 256


def remainder(column, n: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def tf(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.log1p(np.concatenate([gram_counts(LETTERS[data], offs, o, b) for o, b in ORDERS], axis=1))


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray  # of each centroid
    bound: np.ndarray  # of each centroid's language

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine and whether it is near enough, of each text."""
        cos = unit(tf(data, offs) * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        top = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
        sparse = np.minimum(1.0, np.diff(offs) / 400.0)
        return self.language[best], top, top >= self.bound[best] * sparse


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; no randomness."""
    centre = unit(x.mean(0, keepdims=True))
    picked = [int((x @ centre[0]).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = unit(c)
    return c


def sample_by_label(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most about ``per_label`` rows of each label: those whose hash of (doc_id) lies under the label's share."""
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per label
    share = F.lit(False)
    for value, count in n.items():
        top = min(2**63 - 1, -(2**63) + int(min(1.0, per_label / count) * 2**64))
        share = share | ((F.col(label) == F.lit(value)) & (F.xxhash64("doc_id") <= F.lit(top).cast("long")))
    return rows.where(share)


def fit(rows: DataFrame, per_language: int = 600, centroids: int = 3, slack: float = 0.6) -> Model | None:
    """``rows``: doc_id, text, lang to learn from. None if there is nothing to learn."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(batch.schema.get_field_index("lang"))
            for lo, hi, data, offs in blocks(batch, max_rows=ROWS):
                v = tf(data, offs).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"lang": lang.slice(lo, hi - lo), "v": [x.tobytes() for x in v]})

    known = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text RLIKE '\\\\p{L}'")
    got = sample_by_label(known.select("doc_id", "text", "lang"), "lang", per_language).select("text", "lang").mapInArrow(vectors, "lang string, v binary").toArrow()
    if not len(got):
        return None
    lang = np.array(got["lang"].to_pylist())
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float16).reshape(len(lang), -1).astype(np.float32)
    order = np.lexsort((x[:, 101], x[:, 110], x[:, 97], x.sum(1), lang))  # the rows' arrival must not matter
    lang, x = lang[order], x[order]
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = unit(x * idf)
    c, names, bounds = [], [], []
    for value in sorted(set(lang)):
        own = x[lang == value]
        got_c = kmeans(own, centroids)
        c.append(got_c)
        names += [value] * len(got_c)
        bounds += [slack * float(np.quantile((own @ got_c.T).max(1), 0.01))] * len(got_c)
    return Model(idf, np.concatenate(c), np.array(names), np.array(bounds))


def identify(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``rejected`` behind the prefix; nothing but the text decides."""
    added = [prefix + x for x in ("lang_pred", "score", "rejected")]
    docs = ahead(docs, *added)
    if model is None:
        return docs.withColumns(dict(zip(added, (F.lit("und"), F.lit(0.0), F.lit(True)), strict=True)))
    held = docs.sparkSession.sparkContext.broadcast(model)
    marked = docs.withColumn("_wl_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = ddl(docs, *(f"{a} {t}" for a, t in zip(added, ("string", "double", "boolean"), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            letter = batch.column(batch.num_columns - 1)
            for lo, hi, data, offs in blocks(batch, max_rows=ROWS):
                lang, score, near = m.score(data, offs)
                has = letter.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                out = [pa.array(np.where(has, lang, "und"), pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(~(has & near))]
                yield pa.RecordBatch.from_arrays(own + out, names=[*batch.schema.names[:-1], *added])

    return marked.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """The documents that the model does not reject, with what it found as their ``lang``; learned from their own labels.

    Without any label to learn from all documents stay as they are.
    """
    model = fit(docs.where(F.coalesce(remainder("doc_id", 5) != 0, F.lit(False))), per_language)
    if model is None:  # nothing to learn from, so nothing to reject by
        return docs
    found = identify(docs, model, "_wl_").where("NOT _wl_rejected")
    return found.select(*[F.col("_wl_lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
