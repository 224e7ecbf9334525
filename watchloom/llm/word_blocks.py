"""Words of whole documents as blocks: a dictionary and counts per document, joined to a corpus-wide dictionary.

A scan task cuts its documents into blocks of at most ``SIZE`` bytes of text. A block has its distinct features (words, or runs of
words) once each, and for each of its documents which of them it holds how often (compressed sparse rows). It is gathered from
pieces of ``STEP`` bytes, and leaves in rows that hold the next ``WORDS`` of its features, numbered from ``base``, and its next documents
with about ``CELLS`` counts: neither a task nor a batch on its way holds arrays of one entry for each word of a block. What a statistic of the whole corpus needs is then a row for each *block and distinct feature*, not for each token or for each document
and word: ``entries``. A feature stands in a block once, so the most frequent word of the corpus has as many rows as there are
blocks, and ``spread_join`` deals those. Values found for features come back to their blocks by a co-grouping on the block:
``per_document`` holds one block and its values at a time, spills where it has to, and collects nothing.

A text longer than a block is cut between words into several blocks; its parts have the same row number, and what is summed up
over a document is summed up over its parts in the end. Row numbers hold within one written table of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.kernel import LOWER, blocks, word_runs
from watchloom.llm.skew import spread_join
from watchloom.llm.store import Store

SIZE = 1 << 24
STEP = 1 << 20  # bytes of text whose words are found together
WORDS, CELLS = 1 << 16, 1 << 18  # features and counts in one row of a block
BATCH = 1000  # texts that go to a worker at once
SCHEMA = "block long, base int, words array<binary>, row array<long>, doc_id array<long>, first array<int>, word array<int>, times array<int>"


def features(packed: np.ndarray, s: np.ndarray, e: np.ndarray, order: int, last: np.ndarray, until: int) -> tuple[pa.Array, np.ndarray | slice]:
    """The runs of 1 to ``order`` consecutive words that start before word ``until``, and the word each starts with.

    packed: the bytes of the words, one after the other; last: for each word, the word behind the last one of its document; no run
    reaches over it.
    """
    offs = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=offs[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offs), pa.py_buffer(packed)])
    if order == 1:
        return words, slice(0, until)
    found, at = [words.slice(0, until)], [np.arange(until)]
    for n in range(2, order + 1):
        here = np.arange(until)[np.arange(until) + n <= last[:until]]
        found.append(pc.binary_join_element_wise(*[words.take(pa.array(here + j)) for j in range(n)], pa.scalar(b" ", pa.large_binary())))
        at.append(here)
    return pa.concat_arrays(found), np.concatenate(at)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x, in order, and how often each occurs; x itself is sorted, so that no copy of it is made."""
    x.sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new).astype(np.int32)
    return x[at], np.diff(at, append=np.int32(len(x)))


@dataclass
class _Piece:
    """Some documents of a block: their distinct features, and for each document its cells (feature, times)."""

    words: pa.Array
    row: np.ndarray
    docs: pa.Array
    group: np.ndarray
    first: np.ndarray
    word: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, packed: np.ndarray, s: np.ndarray, e: np.ndarray, own: np.ndarray, last: np.ndarray, until: int, order: int, row: np.ndarray, docs: pa.Array, group: np.ndarray) -> _Piece:
        found, at = features(packed, s, e, order, last, until)
        coded = found.dictionary_encode()
        n, width = len(row), max(1, len(coded.dictionary))
        cells, times = _counted(own[at].astype(np.int64) * width + coded.indices.to_numpy())
        return cls(coded.dictionary, row, docs, group, np.searchsorted(cells, np.arange(n + 1) * width), (cells % width).astype(np.int32), times)


def _rows(number: int, pieces: list[_Piece], counters: list[str]) -> Iterator[pa.RecordBatch]:
    """A block's rows: its distinct features in parts of ``WORDS``, its documents in parts of about ``CELLS`` cells."""
    coded = pa.concat_arrays([p.words for p in pieces]).dictionary_encode()
    starts = np.cumsum([0, *[len(p.words) for p in pieces]])
    words, place = coded.dictionary, coded.indices.to_numpy()
    word = np.concatenate([place[a:][p.word] for a, p in zip(starts, pieces, strict=False)])
    times, row, group = (np.concatenate([getattr(p, c) for p in pieces]) for c in ("times", "row", "group"))
    n = np.concatenate([np.diff(p.first) for p in pieces])
    docs, first = pa.concat_arrays([p.docs for p in pieces]), np.concatenate([[0], np.cumsum(n)])
    pieces.clear()
    uses = {"uses": np.bincount(word, times, len(words)).astype(np.int32)} if counters == ["uses"] else {}
    if not uses:
        owner = np.repeat(group, n)
        for g, c in enumerate(counters):
            mine = owner == g
            uses[c] = np.bincount(word[mine], times[mine], len(words)).astype(np.int32)

    def one(values, kind: pa.DataType) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))

    base, lo = 0, 0
    while base < len(words) or lo < len(row):
        hi = min(len(row), lo + CELLS, max(lo + 1, int(np.searchsorted(first, first[lo] + CELLS, "right")) - 1))
        a, b, until = first[lo], first[hi], min(len(words), base + WORDS)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "base": pa.array([base], pa.int32()),
                "words": one(words.slice(base, until - base), pa.binary()),
                "row": one(row[lo:hi], pa.int64()),
                "doc_id": one(docs.slice(lo, hi - lo), pa.int64()),
                "first": one(first[lo : hi + 1] - a, pa.int32()),
                "word": one(word[a:b], pa.int32()),
                "times": one(times[a:b], pa.int32()),
                **{c: one(x[base:until], pa.int32()) for c, x in uses.items()},
            }
        )
        base, lo = until, hi


def cut(docs: DataFrame, inside: np.ndarray, order: int = 1, size: int = SIZE, group: F.Column | None = None, groups: int = 0) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text). Words are runs of bytes of the class ``inside``, with A-Z lower-cased. A document's
    ``group`` is a number under ``groups``, or null for none; uses_0, uses_1 ... count the uses in the documents of each. Without
    groups, ``uses`` counts those in all documents."""
    told = F.coalesce(group, F.lit(-1)) if group is not None else F.lit(-1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), told.cast("int").alias("group"))
    counters = [f"uses_{g}" for g in range(groups)] or ["uses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        number, seen, held, full = base, base, [], 0
        for batch in batches:
            ids, of = batch.column(0), batch.column(2).to_numpy()
            for lo, hi, data, offs in blocks(batch, max_bytes=min(STEP, size), max_rows=max(1, min(STEP, size) // 16)):
                data = LOWER[data]
                s, e = (x.astype(np.int32) for x in word_runs(data, offs, inside))
                first = np.searchsorted(s, offs)
                own = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(first))
                last = np.repeat(first[1:], np.diff(first)) if order > 1 else own
                step = max(1, min(STEP, size) // 4) if hi - lo == 1 else max(1, len(s))  # a long text: so many words a piece
                for w in range(0, max(1, len(s)), step):
                    until, reach = min(len(s), w + step), min(len(s), w + step + order - 1)
                    a, b = (int(s[w]), int(e[reach - 1])) if reach > w else (0, 0)
                    if held and full + b - a > size:
                        yield from _rows(number, held, counters)
                        number, held, full = number + 1, [], 0
                        pa.default_memory_pool().release_unused()  # else the worker keeps what its largest block took
                    packed = data[a:b][inside[data[a:b]]]
                    held.append(_Piece.of(packed, s[w:reach] - a, e[w:reach] - a, own[w:reach], last[w:reach] - w, until - w, order, seen + np.arange(lo, hi), ids.slice(lo, hi - lo), of[lo:hi]))
                    full += b - a + 16 * (hi - lo)  # texts without words take room, too
            seen += batch.num_rows
        if held:
            yield from _rows(number, held, counters)

    return rows.mapInArrow(run, SCHEMA + "".join(f", {c} array<int>" for c in counters))


def written(store: Store, table: DataFrame, name: str) -> DataFrame:
    """The written table of ``cut``. Executors hold a batch of texts outside their heap, and once more while it grows: for this
    write it has at most ``BATCH`` rows."""
    conf, key = store.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        return store.put(table, name, 1)
    finally:
        conf.set(key, before)


def counters(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c == "uses" or c.startswith("uses_")]


def entries(table: DataFrame) -> DataFrame:
    """(block, at, word, uses, uses_0 ...): a row for each block and distinct feature of it."""
    each = F.posexplode(F.arrays_zip("words", *counters(table))).alias("at", "x")
    out = table.select("block", "base", each)
    return out.select("block", (F.col("base") + F.col("at")).alias("at"), F.col("x.words").alias("word"), *[F.col(f"x.{c}").alias(c) for c in counters(table)])


def dictionary(entry_rows: DataFrame) -> DataFrame:
    """(word, uses or uses_0 ..., blocks): each distinct feature of the corpus once."""
    return entry_rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in counters(entry_rows)], F.count(F.lit(1)).alias("blocks"))


def per_document(store: Store, name: str, table: DataFrame, values: DataFrame, columns: list[str], sums: dict[str, Callable[[np.ndarray, Callable[[str], np.ndarray]], np.ndarray]], made: str) -> DataFrame:
    """(row, doc_id and ``made``): for each document the sums that ``sums`` makes from the values of its features.

    ``values`` has each feature once: word, blocks and ``columns``. For each name of ``made`` a function of ``sums`` gets the times a cell's
    feature stands in its document and, by column, the features' values, and returns what each cell adds; one after the other, so a
    task holds the cells of one row of a block. Repeated rows stay apart by their row number.
    """
    names = [x.split()[0] for x in made.split(",")]
    found = spread_join(entries(table).select("block", "at", "word"), values.select("word", *columns), ["word"], values.select("word", "blocks"), "blocks")
    found = found.select("block", "at", *columns)
    cells = store.spark.read.schema(table.schema).parquet(store.path(name)).where(F.size("row") > 0).select("block", "row", "doc_id", "first", "word", "times")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        at = left.column("at").to_numpy()
        placed, parts = {}, []
        for c in columns:
            x = left.column(c).to_numpy()
            placed[c] = np.zeros(int(at.max(initial=-1)) + 1, x.dtype)
            placed[c][at] = x
        for batch in right.to_batches():
            for i in range(batch.num_rows):
                row, doc_id, first, word, times = (batch.column(c)[i].values for c in ("row", "doc_id", "first", "word", "times"))
                first, word, times = first.to_numpy(), word.to_numpy(), times.to_numpy()
                total = {n: _segments(sums[n](times, lambda c, word=word: placed[c][word]), first) for n in names}
                parts.append(pa.table({"row": row, "doc_id": doc_id, **total}))
        return pa.concat_tables(parts)  # a block has documents

    summed = found.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(join, f"row long, doc_id long, {made}")
    return summed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(n).alias(n) for n in names])


def _segments(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x[first[i]:first[i + 1]], each added up on its own."""
    out = np.zeros(len(first) - 1, x.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(x, first[full])
    return out
