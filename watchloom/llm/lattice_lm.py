"""Scores of whole texts under a unigram model over subword pieces, summed over all segmentations of every word.

Words are runs between white space, with A-Z lower-cased. The arcs of a word's lattice (``lattice``) are the pieces of an existing
vocabulary file, which is never changed, and, where training has seen the word, one arc over the whole of it. The forward recursion gives
the sum over all paths, so no segmentation is chosen.

* The documents that are learned from are put into ``components`` groups by their ``lang`` (the most frequent values each their own, the
  rest and null together); each group has piece probabilities, counts of words and a share of the documents. A text's probability is the
  sum over the groups of the group's share times the text's probability in it; a text's own lang is not looked at.
* Piece probabilities come from expectation-maximisation over all learned words with their counts. The file's scores, which are ranks of
  merges, give the start (a weight of 1 / rank), not the model.
* The whole-word arc of group g weighs lam * ((1 - shared) * c_g / W_g + shared * c / W), the pieces together 1 - lam; lam is one less the
  share of words seen once (Good and Turing's estimate of what is new). A token is the end with (d_g + 1) / (N_g + 2), for d_g documents and
  N_g tokens. Over all strings of words these add up to no more than one.

The corpus enters through blocks of words (``word_blocks``): counts of distinct words are summed up over the corpus, each distinct word's
lattice is worked on once, next to its row, and the values go back to the blocks. Only piece sums (pieces x groups) and totals come
to the driver, whatever the corpus holds. Word scores travel in single precision and are added up in double.

Defined cases: null or empty text is the end alone; a null doc_id is neither learned from nor held out; with nothing to learn from one
group with the starting pieces stands in, and N is 0; repeated rows are scored alike; a word of any length is scored whole; an empty table
gives no rows. Of other columns only ``lang`` is read, where there is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import word_blocks as B
from watchloom.llm.kernel import SPACED
from watchloom.llm.language_id import remainder
from watchloom.llm.lattice import Lattice, Trie, pieces
from watchloom.llm.store import Store, table

COMPONENTS, ROUNDS, SHARED, FLOOR = 8, 3, 0.1, 0.01
CHUNK = 1 << 18  # bytes of words whose lattices are worked on together
LN10 = np.log(10.0)
_loaded: dict[str, tuple[Trie, np.ndarray]] = {}


def vocabulary(path: str) -> tuple[Trie, np.ndarray]:
    """The worker's trie of this file, and where its pieces start from."""
    if path not in _loaded:
        found, scores = pieces(path)
        start = 1.0 / (1.0 + np.maximum(0.0, -scores))
        _loaded[path] = Trie(found), np.log(start / start.sum())
    return _loaded[path]


@dataclass
class Model:
    """What a word's score needs: for each group piece log probabilities, tokens and words, documents, and the mass of whole-word arcs."""

    path: str
    logp: np.ndarray  # groups x pieces
    docs: np.ndarray
    words: np.ndarray  # uses of words in each group
    once: np.ndarray  # words used once in each group

    @property
    def lam(self) -> np.ndarray:
        return np.clip(1 - self.once / np.maximum(self.words, 1), 0, 0.999) * (self.words > 0)

    @property
    def end(self) -> np.ndarray:
        return (self.docs + 1) / (self.docs + self.words + 2)

    @property
    def share(self) -> np.ndarray:
        return self.docs / self.docs.sum() if self.docs.sum() else np.full(len(self.docs), 1 / len(self.docs))

    def word_scores(self, data: np.ndarray, offs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's probability, end not being chosen, in each group: (words, groups). counts: (words, groups)."""
        lattice, out = Lattice.build(vocabulary(self.path)[0], data, offs), np.empty(counts.shape)
        every = counts.sum(1) / max(1, self.words.sum())
        for g, lam in enumerate(self.lam):
            whole = lam * ((1 - SHARED) * counts[:, g] / max(1, self.words[g]) + SHARED * every)
            with np.errstate(divide="ignore"):
                out[:, g] = np.logaddexp(np.log(whole), np.log(1 - lam) + lattice.marginal(self.logp[g])) + np.log(1 - self.end[g])
        return out / LN10


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches put together to about ``CHUNK`` bytes of words; the words' bytes, each behind a blank, and their offsets."""

    def made(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held)
        col = rows.column("word").combine_chunks().cast(pa.large_binary())
        n = len(col)
        raw = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        buffer = col.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[raw[0] : raw[-1]] if buffer is not None else np.zeros(0, np.uint8)
        return rows, np.insert(data, raw[:-1] - raw[0], 32), raw - raw[0] + np.arange(n + 1)

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            held.append(batch.slice(at, 8192))
            size += held[-1].column(0).nbytes
            if size >= CHUNK:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def _counts(rows: pa.Table, groups: int) -> np.ndarray:
    return np.stack([rows.column(f"uses_{g}").to_numpy() for g in range(groups)], 1).astype(np.float64)


def learned(known: DataFrame, path: str, docs: np.ndarray, rounds: int) -> Model:
    """The model of a written dictionary (word, uses_0 ...)."""
    groups = len(docs)
    totals = known.agg(*[F.sum(f"uses_{g}").alias(f"w{g}") for g in range(groups)], *[F.count_if(F.col(f"uses_{g}") == 1).alias(f"o{g}") for g in range(groups)]).first()
    trie, start = vocabulary(path)
    model = Model(path, np.tile(start, (groups, 1)), docs, np.array([totals[f"w{g}"] or 0 for g in range(groups)]), np.array([totals[f"o{g}"] for g in range(groups)]))
    some = reduce(lambda a, b: a | b, [F.col(f"uses_{g}") > 0 for g in range(groups)])
    words = known.where(some).select("word", *[f"uses_{g}" for g in range(groups)])
    for _ in range(rounds if model.words.sum() else 0):
        logp = model.logp

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            trie_, total = vocabulary(path)[0], np.zeros(logp.shape)
            for rows, data, offs in _chunks(batches):
                counts = _counts(rows, groups)
                for g in range(groups):
                    at = np.flatnonzero(counts[:, g])
                    if not len(at):
                        continue
                    n = np.diff(offs)
                    mine = np.repeat(counts[:, g] > 0, n)
                    lattice = Lattice.build(trie_, data[mine], np.concatenate([[0], np.cumsum(n[at])]))
                    total[g] += lattice.expected(logp[g], counts[at, g], trie_.size)[0]
            g, piece = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int32()), "piece": pa.array(piece, pa.int32()), "times": total[g, piece]})

        got = words.mapInArrow(expect, "g int, piece int, times double").groupBy("g", "piece").agg(F.sum("times").alias("times")).collect()
        times = np.full((groups, trie.size), FLOOR)
        for r in got:
            times[r["g"], r["piece"]] += r["times"]
        model = Model(path, np.log(times / times.sum(1, keepdims=True)), model.docs, model.words, model.once)
    return model


def group_of(docs: DataFrame, learn: Column, components: int) -> tuple[Column, np.ndarray]:
    """The group of a document (null: not learned from) and the learned documents of each group; at most ``components`` groups."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    found = docs.where(learn).groupBy(lang.alias("lang")).count().orderBy(F.col("count").desc(), "lang").limit(components - 1).collect()
    every = docs.where(learn).count()
    sizes = [r["count"] for r in found]
    rest = every - sum(sizes)
    if rest or not found:
        sizes.append(rest)
    number = F.lit(len(sizes) - 1)
    for i, r in enumerate(found):
        number = F.when(lang == r["lang"], i).otherwise(number)
    return F.when(learn, number), np.array(sizes, np.int64)


def score_documents(docs: DataFrame, path: str, learn: Column, components: int = COMPONENTS, rounds: int = ROUNDS, size: int = B.SIZE) -> tuple[DataFrame, Model]:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``, and the model.

    ``learn`` says which documents are learned from. ``base_score`` is the add-one unigram's: the sum over words and end of
    log10((c + 1) / (N + V + 1)).
    """
    store = Store(docs.sparkSession, "lattice")
    group, sizes = group_of(docs, F.coalesce(learn, F.lit(False)), components)
    groups = len(sizes)
    blocks = B.written(store, B.cut(docs, SPACED, 1, size, group, groups), "documents")
    known = store.put(B.dictionary(B.entries(blocks)), "dictionary")
    model = learned(known, path, sizes, rounds)
    made = ", ".join(f"s{g} float" for g in range(groups))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in _chunks(batches):
            counts = _counts(rows, groups)
            scores = model.word_scores(data, offs, counts)
            yield from pa.table({"word": rows.column("word"), "blocks": rows.column("blocks"), "c": counts.sum(1).astype(np.int64), **{f"s{g}": scores[:, g].astype(np.float32) for g in range(groups)}}).to_batches()

    valued = store.put(known.select("word", "blocks", *[f"uses_{g}" for g in range(groups)]).mapInArrow(values, f"word binary, blocks long, c long, {made}"), "values")
    store.drop("dictionary")

    sums = {"n": lambda times, v: times.astype(np.int64), "known": lambda times, v: times * (v("c") > 0).astype(np.int64), "base": lambda times, v: times * np.log10(v("c") + 1.0)}
    sums |= {f"s{g}": lambda times, v, g=g: times * v(f"s{g}").astype(np.float64) for g in range(groups)}
    out = B.per_document(store, "documents", blocks, valued, ["c", *[f"s{g}" for g in range(groups)]], sums, "n long, known long, base double, " + ", ".join(f"s{g} double" for g in range(groups)))
    n_docs, n_words = int(sizes.sum()), int(model.words.sum())
    distinct = valued.where("c > 0").count() + (n_docs > 0)
    each = [F.col(f"s{g}") + F.lit(float(np.log10(model.share[g]) + np.log10(model.end[g]))) for g in range(groups) if model.share[g] > 0]
    top = F.greatest(*each) if len(each) > 1 else each[0]
    score = top + F.log10(reduce(lambda a, b: a + b, [F.pow(F.lit(10.0), e - top) for e in each]))
    every = n_docs + n_words
    base = F.col("base") + F.lit(float(np.log10(n_docs + 1.0))) - (F.col("n") + 1) * F.lit(float(np.log10(every + distinct + 1.0)))
    return out.select("doc_id", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + int(n_docs > 0)).alias("n_known"), F.lit(every).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score")), model


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, _ = score_documents(docs, path or public_tokenizers.path("piece_bpe_32k.model"), remainder("doc_id", 7) != 2)
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
