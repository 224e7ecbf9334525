"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by doc_id; each task encodes its documents in order and writes one shard: an Arrow IPC
file whose batches hold the shard's id stream cut into rows of ``SEQUENCE`` ids (``fixed_size_list``) with a mask of the
same shape (false on the padding of the shard's last row), and a second, small Arrow file with the place of each document
in the stream. Nothing is compressed, so a memory-mapped reader gets any row or document without copying. Ids take two
bytes where the vocabulary allows it. Batches are flushed as they fill, so a task holds one batch, not one shard.

A task writes its two files under names of its own attempt and hands back one row with the name and the counts. The
committed table of these rows is the manifest: it alone says which files belong to the store, so nothing has to be renamed or
replaced, and files of attempts that failed or lost are no part of it and are deleted once it is written. Starts over
the whole corpus are a running sum over its rows.

Defined cases: null or empty text is the end id alone; null doc_ids come first; rows of one doc_id stay neighbours in the
order of their texts; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.llm.kernel import blocks
from watchloom.llm.store import Store, table
from watchloom.llm.tokens import Encoder

SEQUENCE = 2048
ROWS = 256  # rows of a batch
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    def __init__(self, uri: str, dtype, sequence: int = SEQUENCE):
        self.uri = f"{uri}-{uuid.uuid4().hex[:12]}"
        self.fs, self.path = open_store(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.dtype, self.sequence = dtype, sequence
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sinks = [self.fs.open_output_stream(self.path + x) for x in (".ids", ".docs")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], INDEX)
        self.wait: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.wait.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= self.sequence * ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.wait) if self.wait else np.zeros(0, self.dtype)
        n = len(flat) if last else len(flat) // self.sequence * self.sequence
        part, rest = flat[:n], flat[n:]
        pad = -n % self.sequence
        for at in range(0, n + pad, self.sequence * ROWS):
            one = part[at : at + self.sequence * ROWS]
            extra = -len(one) % self.sequence
            mask = np.ones(len(one) + extra, bool)
            mask[len(one) :] = False
            one = np.concatenate([one, np.zeros(extra, self.dtype)])
            self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(one), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))
        self.wait, self.waiting = [rest], len(rest)
        if self.rows:
            self.docs.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), INDEX, strict=True)], schema=INDEX))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        self.ids.close()
        self.docs.close()
        for sink in self.sinks:
            sink.close()


class ShardReader:
    """Random access to a shard: memory-mapped where the store is a local folder."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        source = (lambda p: pa.memory_map(p)) if fs.type_name == "local" else (lambda p: fs.open_input_file(p))
        self.ids, self.docs = pa.ipc.open_file(source(path + ".ids")), pa.ipc.open_file(source(path + ".docs"))
        self.sequence = self.ids.schema.field("ids").type.list_size

    def batch(self, i: int) -> np.ndarray:
        """All ids of a batch, one after the other, as a view of the file."""
        return self.ids.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequences(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.ids.get_batch(i)
        return self.batch(i).reshape(-1, self.sequence), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.sequence)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in the file's order; holds one batch of ids and one document."""
        i, held, first = -1, np.zeros(0), 0
        for k in range(self.docs.num_record_batches):
            b = self.docs.get_batch(k)
            for doc, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts, at, need = [], start, n
                while need:
                    while at >= first + len(held):
                        first, i = first + len(held), i + 1
                        held = self.batch(i)
                    part = held[at - first : at - first + need]
                    parts.append(part)
                    at, need = at + len(part), need - len(part)
                yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, sequence: int = SEQUENCE, shards: int | None = None) -> DataFrame:
    """Writes the shards; returns a row for each: shard, uri, n_docs, n_tokens, start (ids of all shards before)."""
    spark = docs.sparkSession
    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shards or max(sorted_docs.rdd.getNumPartitions(), 1)
    sorted_docs = sorted_docs.repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, count = TaskContext.get().partitionId(), None, 0
        uri = f"{folder}/shard-{shard:06d}"
        encoder = Encoder.get(tokenizer)
        dtype = np.uint16 if max(encoder.size(), end_id + 1) <= 1 << 16 else np.uint32
        tail = np.array([end_id], "<u4")
        for batch in batches:
            names, col = batch.column(0), batch.column(1)
            for lo, hi, _, _ in blocks(batch):
                for i, ids in enumerate(encoder.encode([x or "" for x in col.slice(lo, hi - lo).to_pylist()])):
                    out = out or ShardWriter(uri, dtype, sequence)
                    out.add(names[lo + i].as_py(), np.concatenate([ids, tail]))
                    count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [out.uri], "n_docs": pa.array([count], pa.int64()), "n_tokens": pa.array([out.total], pa.int64())})

    written = Store(spark, "tokens").put(sorted_docs.mapInArrow(run, "shard int, uri string, n_docs long, n_tokens long"), "shards")
    _sweep(folder, {r["uri"].rsplit("/", 1)[1] for r in written.select("uri").collect()})  # one name per shard
    start = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # one row per shard file
    return written.withColumn("start", start)


def _sweep(folder: str, kept: set[str]) -> None:
    """Deletes files of this folder that the manifest does not name."""
    from pyarrow.fs import FileSelector

    fs, path = open_store(folder)
    for f in fs.get_file_info(FileSelector(path, allow_not_found=True)):
        if f.is_file and f.base_name.rsplit(".", 1)[0] not in kept:
            fs.delete_file(f.path)


def read(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32 for each document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for uri, base in zip(pdf["uri"], pdf["start"], strict=True):
                rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in ShardReader(uri).documents()]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    return shards.repartition(4 * n, "shard").select("uri", "start").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), Store(spark, "token-files").path("files")))
