"""Chat formatting as prefix trees: turns that conversations share from their start on are emitted once.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, every ``<``, backslashes and ``|`` in a row
gets one more backslash, so a control string never appears in content and the step is undone exactly; roles also escape
newlines. Assistant texts are under the loss mask.

A node of the tree is a turn behind given earlier turns, found by a hash of all of them and compared by role and text.
Conversations are sorted by their paths of node hashes (range-partitioned, conv_id last, so a conversation with many copies
spreads over tasks); neighbours then share the longest prefixes. A first pass weighs each conversation by what it adds to
the one before (bytes, and ``MEMBER`` for the member itself); running sums over all partitions, of which only one row a
partition is needed, cut the sorted conversations into packs of about ``PACK``. A pack is dealt to one task, so where the
partitions' borders were does not matter: a shared turn is emitted once, and again only where a pack ends within it. One pass
with a stack emits a pack's tree depth-first; a pack is one training sequence.

Units are token ids of a public tokenizer, or code points where none is given. The head, text and end of a turn are encoded
apart, so masks fall on whole units. Each node has its place in the pack, the position id of its first unit (positions go on
from its parent's end) and its ancestors' intervals: a unit attends to these intervals and to what stands before it in its
own node. A conversation is the list of its nodes' intervals.

Two tables come out, in one DataFrame by ``kind``: nodes and conversations. ``read_back`` rebuilds the conversations from
their ids alone.

Defined cases: null role or text is empty; turns of equal number are ordered by role and text; rows with a null conv_id
form one conversation with a null id; repeated rows are turns of their own; an empty table gives no rows. One
conversation is formatted as a whole and has to fit into a task's memory; any number of conversations may be alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.llm.store import Store, table
from watchloom.llm.tokens import Encoder

START, END = "<|im_start|>", "<|im_end|>"
PACK, MEMBER = 1 << 19, 64
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*)\n((?s:.*?))<\|im_end\|>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, text and end of the formatted turn."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


class Units:
    """Texts as ids and back."""

    def __init__(self, tokenizer: str | None):
        self.encoder = Encoder.get(tokenizer) if tokenizer else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.encoder:
            return [x.astype(np.int32) for x in self.encoder.encode(texts)]
        return [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32) for x in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        if self.encoder:
            return self.encoder.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return ["".join(map(chr, x)) for x in ids]


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> one row for each conversation: path of node hashes, roles, texts."""
    schema = pa.schema([("conv_id", pa.int64()), ("path", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
    now, turns, out, size = object(), [], [], 0

    def done() -> None:
        h, path = hashlib.blake2b(digest_size=8), []
        for role, text in turns:
            h.update(f"{len(role)}:{role}{len(text)}:{text}".encode("utf-8", "surrogatepass"))
            path.append(int.from_bytes(h.digest(), "little", signed=True))
        out.append({"conv_id": now, "path": path, "roles": [r for r, _ in turns], "texts": [t for _, t in turns]})

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if turns and conv != now:
                done()
                turns = []
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            now = conv
            turns.append((role or "", text or ""))
            size += len(text or "")
    if turns:
        done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


SORTED = "conv_id long, path array<long>, roles array<string>, texts array<string>, part int, run long"


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations with the partition's number and the weight of those before in it."""
    from pyspark import TaskContext

    part, run, before = TaskContext.get().partitionId(), 0, []
    for batch in batches:
        runs = []
        for path, roles, texts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            depth = 0
            while depth < min(len(before), len(path)) and before[depth] == path[depth]:
                depth += 1
            before = path
            runs.append(run)
            run += MEMBER + 16 * len(path) + sum(len("".join(turn_parts(r, t)).encode("utf-8", "surrogatepass")) for r, t in zip(roles[depth:], texts[depth:], strict=True))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(runs), part, np.int32)), pa.array(runs, pa.int64())], names=[x.split()[0] for x in SORTED.split(", ")])
    # one row without a conversation tells the partition's whole weight
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.string())), pa.array([part], pa.int32()), pa.array([run], pa.int64())], names=[x.split()[0] for x in SORTED.split(", ")])


TREE = "kind string, pack long, node int, parent int, start long, length long, position long, ancestors array<struct<start:long,end:long>>, ids array<int>, mask array<struct<start:long,end:long>>, conv_id long"


class Node:
    """A turn behind given turns; its number, place and positions are set when its ids are known."""

    __slots__ = ("end", "hash", "ids", "node", "parent", "role", "start", "text")

    def __init__(self, hash_: int, role: str, text: str, parent: Node | None):
        self.hash, self.role, self.text, self.parent = hash_, role, text, parent

    def span(self) -> dict:
        return {"start": self.start, "end": self.start + len(self.ids)}


def _tree(tokenizer: str | None):
    schema = pa.schema([("kind", pa.string()), ("pack", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("ancestors", SPANS), ("ids", pa.list_(pa.int32())), ("mask", SPANS), ("conv_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, now, placed, stack, at, number = Units(tokenizer), None, None, [], 0, 0
        for batch in batches:
            events, new = [], []
            for pack, conv, path, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if pack != now:
                    now, stack = pack, []
                turns, depth = list(zip(path, roles, texts, strict=True)), 0
                while depth < min(len(stack), len(turns)) and (stack[depth].hash, stack[depth].role, stack[depth].text) == turns[depth]:
                    depth += 1
                stack = stack[:depth]
                for turn in turns[depth:]:
                    stack.append(Node(*turn, stack[-1] if stack else None))
                    new.append(stack[-1])
                    events.append((pack, None, list(stack)))
                events.append((pack, conv, list(stack)))
            ids = iter(units.encode([p for x in new for p in turn_parts(x.role, x.text)]))
            out: dict[str, list] = {c: [] for c in schema.names if c != "ids"}
            units_of, none = [], np.zeros(0, np.int32)
            for pack, conv, path in events:
                me = path[-1]
                if not hasattr(me, "ids"):
                    if pack != placed:
                        placed, at, number = pack, 0, 0
                    head, body, tail = next(ids), next(ids), next(ids)
                    me.ids, me.start, me.node = np.concatenate([head, body, tail]), at, number
                    me.end = (me.parent.end if me.parent else 0) + len(me.ids)
                    mask = [{"start": len(head), "end": len(head) + len(body)}] if me.role == "assistant" else []
                    at, number = at + len(me.ids), number + 1
                    row = ("node", pack, me.node, me.parent.node if me.parent else -1, me.start, len(me.ids), me.end - len(me.ids), [x.span() for x in path[:-1]], mask, None)
                    units_of.append(me.ids)
                else:
                    row = ("conversation", pack, me.node, None, None, None, None, [x.span() for x in path], None, conv)
                    units_of.append(none)
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
            flat = pa.array(np.concatenate(units_of) if units_of else none, pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in units_of])]), pa.int32()), flat)
            columns = [lists if f.name == "ids" else pa.array(out[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def build(rows: DataFrame, tokenizer: str | None = None, pack_size: int = PACK) -> DataFrame:
    """The packed prefix trees of all conversations (written)."""
    store = Store(rows.sparkSession, "chat")
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_conversations, "conv_id long, path array<long>, roles array<string>, texts array<string>")
    whole = store.put(whole, "conversations")
    weighed = store.put(whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_weigh, SORTED), "sorted")
    sums = weighed.where("path IS NULL").select("part", (F.sum("run").over(Window.orderBy("part")) - F.col("run")).alias("before"))  # a row for each partition
    packed = weighed.where("path IS NOT NULL").join(F.broadcast(sums), "part").withColumn("pack", F.floor((F.col("before") + F.col("run")) / pack_size))
    packed = packed.select("pack", "conv_id", "path", "roles", "texts").repartition("pack").sortWithinPartitions("pack", "path", "conv_id")
    return store.put(packed.mapInArrow(_tree(tokenizer), TREE), "tree")


def _digests(tokenizer: str | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Conversations of one pack, rebuilt from its nodes."""
        units, nodes = Units(tokenizer), pdf[pdf["kind"] == "node"]
        # before, under and behind the mask, decoded apart and once; masks fall on whole characters
        starts, cuts, ids = nodes["start"].tolist(), [], []
        for x, ms in zip(nodes["ids"], nodes["mask"], strict=True):
            edges = [0, *(e for m in ms for e in (m["start"], m["end"])), len(x)]
            ids += [x[i:j].tolist() for i, j in zip(edges[:-1], edges[1:], strict=True)]
            cuts.append(len(edges) - 1)
        parts, text, said, at = units.decode(ids), {}, {}, 0
        for start, n in zip(starts, cuts, strict=True):
            text[start] = "".join(parts[at : at + n])
            if n > 1:
                said[start] = "".join(map(unescape, parts[at + 1 : at + n : 2]))
            at += n
        known: dict[tuple, tuple] = {}
        out = []
        members = pdf[pdf["kind"] == "conversation"]
        for conv, spans in zip(members["conv_id"], members["ancestors"], strict=True):
            key = tuple(s["start"] for s in spans)
            if key not in known:
                formatted = "".join(text[s] for s in key)
                turns = parse(formatted)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(said.get(s, "") for s in key)
                digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                known[key] = (len(turns), digest(whole), len(loss), digest(loss), len(formatted))
            out.append((conv, *known[key]))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    return run


def read_back(tree: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each conversation, from the packs alone; a pack is bounded, so is its group."""
    return tree.groupBy("pack").applyInPandas(_digests(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(build(rows.unionByName(extra), tokenizer), tokenizer)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
         + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
