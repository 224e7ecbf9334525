"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. A passage's features are hashed byte trigrams and shares of
character kinds; a learned layer encodes it, gated attention (a tanh branch times a sigmoid branch) weighs it, and the
weighted mean of the encodings is scored. Only document labels are learned from: the driver fits the few thousand weights
by Adam on at most ``per_label`` documents of each label (vectors computed on the executors; a bound on rows that does
not grow with the input). Every document is then scored over all its passages, next to the scan.

Defined cases: a null or empty text is a bag with one empty passage; null labels and null doc_ids are not learned from;
with no labels, or one label only, every score is that label's share (0.5 without any); repeated rows are scored alike;
an empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.features import gram_counts, owners, passages, unit
from watchloom.llm.kernel import LOWER, blocks
from watchloom.llm.language_id import remainder, sample_by_label
from watchloom.llm.store import ahead, ddl, table

PASSAGE = 1024
BITS = 9
KINDS = [
    lambda b: 97 <= b <= 122,
    lambda b: 65 <= b <= 90,
    lambda b: 48 <= b <= 57,
    lambda b: b == 32,
    lambda b: b == 10,
    lambda b: b >= 128,
    lambda b: b in b".,;:!?'\"-",
    lambda b: b in b"#$%&*|@<>{}[]\\/=+_~^",
]
KIND = np.array([next((i for i, k in enumerate(KINDS) if k(b)), len(KINDS)) for b in range(256)])
STATS = len(KINDS) + 4
ROWS = 256


def bag_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage."""
    cuts, first = passages(offs, PASSAGE)
    n, kinds = len(cuts) - 1, len(KINDS) + 1
    own, length = owners(cuts), np.maximum(1, np.diff(cuts))
    grams = gram_counts(LOWER[data], cuts, 3, BITS)
    share = np.bincount(own * kinds + KIND[data], minlength=n * kinds).reshape(n, kinds) / length[:, None]
    total = np.maximum(1, grams.sum(1))
    extra = np.stack([np.log1p(np.diff(cuts)) / 7, (grams > 0).sum(1) / np.minimum(total, 1 << BITS), grams.max(1) / total], axis=1)
    return np.concatenate([4 * unit(np.log1p(grams)), np.sqrt(share) * 3, extra], axis=1).astype(np.float32), first


@dataclass
class Model:
    w: dict[str, np.ndarray] | None
    share: float = 0.5

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, at, own = self.w, first[:-1], owners(first)
        h = np.tanh(x @ w["W"] + w["c"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (v * u) @ w["a"]
        p = np.exp(e - np.maximum.reduceat(e, at)[own])
        alpha = p / np.add.reduceat(p, at)[own]
        z = np.add.reduceat(alpha[:, None] * h, at)
        return {"h": h, "v": v, "u": u, "alpha": alpha, "z": z, "own": own, "s": 1 / (1 + np.exp(-(z @ w["b"] + w["b0"])))}

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(offs) - 1, self.share)
        return np.clip(self.forward(*bag_features(data, offs))["s"].astype(np.float64), 0, 1)


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 25, rate: float = 4e-3, decay: float = 1e-4) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    r = np.random.RandomState(7)
    d = bags[0].shape[1]
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = Model({"W": init(d, hidden), "c": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "a": init(gate), "b": init(hidden), "b0": np.zeros(1, np.float32)})
    mean, square, step = {k: np.zeros_like(v) for k, v in m.w.items()}, {k: np.zeros_like(v) for k, v in m.w.items()}, 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), 64):
            idx = order[lo : lo + 64]
            x = np.concatenate([bags[i] for i in idx]).astype(np.float32)
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in idx])])
            f, w = m.forward(x, first), m.w
            ds = ((f["s"] - y[idx]) / len(idx)).astype(np.float32)
            dz = ds[:, None] * w["b"]
            dalpha = (dz[f["own"]] * f["h"]).sum(1)
            de = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, first[:-1])[f["own"]])
            dvu = de[:, None] * w["a"]
            dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
            dh = (f["alpha"][:, None] * dz[f["own"]] + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
            g = {"W": x.T @ dh, "c": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ de, "b": f["z"].T @ ds, "b0": ds.sum(keepdims=True)}
            step += 1
            for k in w:
                grad = g[k] + decay * w[k]
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                w[k] = (w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def fit(rows: DataFrame, per_label: int = 1500) -> Model:
    """``rows``: doc_id, text, quality to learn from."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("quality"))
            for lo, hi, data, offs in blocks(batch, max_rows=ROWS):
                x, first = bag_features(data, offs)
                x = x.astype(np.float16)
                yield pa.RecordBatch.from_pydict({"quality": label.slice(lo, hi - lo), "x": [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]})

    known = rows.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    got = sample_by_label(known, "quality", per_label).select("text", "quality").mapInArrow(bags, "quality int, x binary").toArrow()
    d = (1 << BITS) + STATS
    pairs = sorted(zip(got["x"].to_pylist(), got["quality"].to_pylist(), strict=True))  # the rows' arrival must not matter
    return train([np.frombuffer(x, np.float16).reshape(-1, d) for x, _ in pairs], np.array([q for _, q in pairs], np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score``; nothing but the text decides."""
    docs = ahead(docs, "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ddl(docs, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, max_rows=ROWS):
                own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(m.score(data, offs))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = sample_by_label(labels, "quality", 1500)  # at most 3,000 rows, whatever the input, so that no text is moved
    model = fit(docs.join(F.broadcast(chosen), "doc_id"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
