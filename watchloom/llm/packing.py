"""Best-fit packing of token sequences by minimum bin slack.

Texts are encoded once, in place. What is left of a piece for planning is its length, and there are at most ``size``
lengths: the plan works on their histogram, whatever the number of documents. Per bin, the longest length left is set and
a bitset subset-sum over the available lengths finds the fullest combination with it; that combination is taken out as
often as the counts allow. Each combination uses up a length, or leaves fewer of it than it takes, so there are at most
``size * (1 + ln size)`` of them (about 8,000 for 1,024): a plan of proven size, which is what is broadcast.

Pieces get their bins by their rank among the pieces of their length. Ranks come from counts per task and length and a
running sum over the tasks, so no task ever holds all pieces of a length, however many documents share it.

Defined cases: a null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows are packed
as often as they come; an empty table gives no rows. A text longer than ``size`` is cut from its end into full pieces, so
that only its first piece may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.llm.kernel import blocks
from watchloom.llm.store import Store, table
from watchloom.llm.tokens import Encoder

SIZE = 1024


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def fullest(counts: np.ndarray, size: int) -> dict[int, int]:
    """The fullest combination of available lengths that holds the longest one: {length: how many}."""
    longest = int(np.flatnonzero(counts)[-1])
    take, room = {longest: 1}, size - longest
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in range(min(longest, room), 0, -1):
        for _ in range(min(int(counts[length]) - (length == longest), room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for length, before in reversed(steps):
        if not before >> at & 1:
            take[length] = take.get(length, 0) + 1
            at -= length
    return take


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """[(how many bins, {length: how many in each})]"""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    while counts.any():
        take = fullest(counts, size)
        times = min(int(counts[length]) // n for length, n in take.items())
        for length, n in take.items():
            counts[length] -= times * n
        out.append((times, take))
    return out


class Placer:
    """Turns a piece's length and rank among its length into (sequence, offset)."""

    def __init__(self, bins: list[tuple[int, dict[int, int]]]):
        self.by: dict[int, tuple[np.ndarray, ...]] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for times, take in bins:
            at = 0
            for length in sorted(take, reverse=True):
                n = take[length]
                rows.setdefault(length, []).append((used.get(length, 0), sequence, n, at))
                used[length] = used.get(length, 0) + n * times
                at += n * length
            sequence += times
        for length, r in rows.items():
            self.by[length] = tuple(np.array(x, np.int64) for x in zip(*r, strict=True))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        values, first = np.unique(length[order], return_index=True)
        for v, idx in zip(values, np.split(order, first[1:]), strict=True):
            start, base, each, at = self.by[int(v)]
            p = np.searchsorted(start, rank[idx], "right") - 1
            k = rank[idx] - start[p]
            sequence[idx] = base[p] + k // each[p]
            offset[idx] = at[p] + k % each[p] * v
        return sequence, offset


def _cut(path: str, end_id: int, size: int, with_ids: bool):
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.get(path), np.zeros(size + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            col = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, _, _ in blocks(batch):
                out: list[list] = [[] for _ in kinds]
                parts = [np.empty(0, "<u4")]
                for i, ids in enumerate(encoder.encode([x or "" for x in col.slice(lo, hi - lo).to_pylist()])):
                    ids = np.concatenate([ids, tail])
                    for k, (s, n) in enumerate(pieces_of(len(ids), size)):
                        part = ids[s : s + n]
                        row = (names[lo + i].as_py(), k, s, n, zlib.crc32(part.tobytes()), int(seen[n]))
                        seen[n] += 1
                        parts.append(part)
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
                arrays = [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)]
                if with_ids:
                    ends = np.cumsum([len(x) for x in parts], dtype=np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names + ["ids"] * with_ids)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids
    return run, ddl


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, if asked for)."""
    store = Store(docs.sparkSession, "pack")
    run, ddl = _cut(tokenizer, end_id, size, with_ids)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
    # the task's number is written with its rows, so ranks stay what they are if a task runs again
    cut = store.put(cut.withColumn("task", F.spark_partition_id()), "pieces")
    stats = store.put(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "stats")
    bins = plan({r["length"]: r["n"] for r in stats.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)  # at most `size` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = cut.join(stats.select("task", "length", before.alias("before")), ["task", "length"])
    placer = docs.sparkSession.sparkContext.broadcast(Placer(bins))

    kept = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    columns = [c.split()[0] for c in kept.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("before").to_numpy() + b.column("nth").to_numpy()
            placed = placer.value.place(b.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns[:-2]] + [pa.array(x) for x in placed], names=columns)

    return ranked.select(*columns[:-2], "nth", "before").mapInArrow(place, kept).select(*columns)


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))

