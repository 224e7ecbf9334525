"""Exact substring dedup: maximal repeat groups of at least ``span`` bytes, from common-prefix interval trees.

A corpus has no single suffix array here; its suffixes are dealt out so that suffixes which share ``span`` bytes meet:

1. Next to the scan every possible start of a ``span``-byte string is given to an anchor: the least 32-byte gram (by hash,
   then leftmost) inside the string. Equal strings have equal anchors at equal places. Consecutive starts with one anchor
   form a context (the bytes of all their strings), one per about 85 bytes; only its place and two hashes are kept.
2. Anchors that occur once repeat nothing. Equal contexts of the others form a class with a multiplicity (partial
   aggregates, so a text with millions of copies is counted and not collected); a class is cut out of one text, once.
3. A class is cut in two halves, each keyed by the 117 bytes that all strings of the half share. Halves that share a key go
   into one enhanced suffix array, as strings with the multiplicity of their class: its suffixes of at least ``span`` bytes,
   sorted, and the common prefixes of neighbours. A stack scan walks the common-prefix intervals, tests whether the bytes to
   the left differ, and puts out the maximal repeat groups with all their occurrences; a leaf of a multiplicity over one is
   a group as well, and left-maximal where its string begins. Equal strings have their anchor at equal places, so no string
   of a half repeats in the half itself: of a half that is alone with its key only the whole enters the array.
4. A key of more than ``GROUP`` halves is dealt over several arrays. These also put out all intervals at the depth of
   ``span`` bytes (leaves too), labelled by a 128-bit hash of the bytes; labels that several arrays hold are one interval.
   It is extended to both sides as far as its least and largest bytes there agree, which gives the maximal repeat with
   these occurrences. So every array is bounded, and shared strings leave an array as one row each, whatever the number
   of texts.
5. Spans of a class are those of its occurrences in the groups, united; every text takes them from its contexts' classes.

Groups are maximal within a context (up to 368 bytes). ``Repeats.arrays`` holds them as intervals of the sorted suffixes of
class rows with counts, so nested groups share their occurrences; ``Repeats.groups`` spells them out, and
``Repeats.occurrences`` as places in texts. Removed bytes come from the groups alone and are exact.

Defined cases: a null text is empty; texts under ``span`` bytes lose nothing; matches never cross texts; repeated rows are
texts of their own, so each loses what the other holds; rows with a null doc_id take part like any other; an empty table
gives no rows. Other columns are carried along by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.kernel import BASE, GOLD, U, blocks, mix, powers, window_min
from watchloom.llm.skew import spread_join
from watchloom.llm.store import Store, ahead, ddl, table

SPAN, GRAM = 200, 32
PLACE = U((1 << 24) - 1)
PIECE = 1 << 22  # starts of a very long text that are worked on at once
CHUNK, GROUP = 1 << 19, 2048  # bytes of the strings of small arrays together; halves of one array


def gram32(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each place, by doubling."""
    h = mix(data.astype(U) + U(GOLD))
    step = 1
    while step < GRAM:
        h = h[: len(h) - step] * U(BASE + 2 * step) + (h[step:] ^ (h[step:] >> U(29)))
        step *= 2
    return mix(h)


class Sums:
    """Hashes of any stretch of bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum(mix(data.astype(U) + U(3)) * self.up[: len(data)], out=self.total[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.down[lo] + U(salt) + (hi - lo).astype(U) * U(GOLD))


def contexts(data: np.ndarray, offs: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, place of the anchor behind the first start, anchor hash, context hash)."""
    n = len(data) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    g = gram32(data)
    least = window_min((g & ~PLACE) | np.arange(len(g), dtype=U), span - GRAM + 1)
    own = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    starts = np.flatnonzero(own[:n] == own[span - 1 :])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = (least[starts] & PLACE).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)]))
    lo, count, anchor = starts[edge], np.diff(np.append(edge, len(starts))), at[edge]
    c = Sums(data).of(lo, lo + count - 1 + span, 5)
    return own[lo], lo - offs[own[lo]], count, anchor - lo, g[anchor].view(np.int64), c.view(np.int64)


def _places(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, max_bytes=1 << 20):
                d, t = (batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in (0, 1))
                for base in range(0, max(1, len(data)), PIECE):
                    one = data[base : base + PIECE + span - 1]
                    own, at, n, p, a, c = contexts(one, np.clip(offs - base, 0, len(one)), span)
                    at = at + np.where(offs[own] < base, base - offs[own], 0)
                    yield pa.RecordBatch.from_pydict({"d": d[own], "t": t[own], "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int16()), "p": pa.array(p, pa.int16()), "a": a, "c": c})

    return run, "d long, t long, at int, n smallint, p smallint, a long, c long"


def _halves(span: int):
    """Cuts classes out of their text; (key, class, multiplicity, place in the context, bytes)."""
    mid = (span - GRAM) // 2  # starts up to this far before the anchor form one half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            for lo, hi, data, offs in blocks(batch):
                w = wanted.slice(lo, hi - lo)
                own = np.repeat(np.arange(hi - lo), w.value_lengths().to_numpy())
                s = w.flatten()
                at, n, p, a, c, k = (s.field(i).to_numpy().astype(np.int64) for i in range(6))
                first = offs[own] + at
                anchor, end = first + p, first + n  # end: behind the last start
                cut = np.clip(anchor - mid, first, end)
                p0 = np.concatenate([anchor - mid - 1, anchor])
                x, y = np.concatenate([first, cut]), np.concatenate([cut, end])
                late = np.arange(len(x)) >= len(first)
                ok = y > x
                first, a, c, k = (np.concatenate([z, z])[ok] for z in (first, a, c, k))
                p0, x, y, late = p0[ok], x[ok], y[ok] - 1 + span, late[ok]
                # shared by all strings of the half that starts before, and of the half that starts close to the anchor
                key = Sums(data).of(p0, np.where(late, p0 + span - mid, p0 + mid + 1 + GRAM), 7)
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "a": a, "c": c, "k": k, "lo": pa.array(x - first, pa.int32()), "bytes": pa.array([data[i:j].tobytes() for i, j in zip(x, y, strict=True)], pa.binary())})

    return run, "key long, a long, c long, k long, lo int, bytes binary"


class SuffixArray:
    """Enhanced suffix array of the suffixes of at least ``least`` bytes of several strings, each with a multiplicity."""

    def __init__(self, strings: list[bytes], least: int, times: np.ndarray | None = None, alone: np.ndarray | None = None):
        lens = np.array([len(x) for x in strings], np.int64)
        first = np.cumsum(lens) - lens
        self.flat, self.least = np.frombuffer(b"".join(strings), np.uint8), least
        n = np.maximum(lens - least + 1, 0)
        if alone is not None:  # nothing but the whole can repeat
            n = np.where(alone, np.minimum(n, 1), n)
        #: string of each suffix, its place there and in all bytes, its length
        self.own = np.repeat(np.arange(len(strings)), n)
        self.at = np.arange(len(self.own)) - np.repeat(np.cumsum(n) - n, n)
        self.pos = first[self.own] + self.at
        self.room = lens[self.own] - self.at
        self.times = np.ones(len(strings), np.int64) if times is None else times
        width = int(self.room.max(initial=1))
        padded = np.concatenate([self.flat, np.zeros(width, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[self.pos]
        rows[np.arange(width) >= self.room[:, None]] = 0
        #: the suffixes in order; of suffixes that differ in zero bytes at their ends the shorter comes first
        self.sa = np.argsort(self.room, kind="stable")
        self.sa = self.sa[np.argsort(rows[self.sa].view(f"S{width}").ravel(), kind="stable")]
        rows = rows[self.sa]
        unlike = rows[1:] != rows[:-1]
        same = np.where(unlike.any(1), unlike.argmax(1), width) if len(rows) > 1 else np.zeros(0, np.int64)
        room = self.room[self.sa]
        #: common prefix of each suffix and the one before it in the array, 0 for the first
        self.lcp = np.concatenate([[0], np.minimum(same, np.minimum(room[1:], room[:-1]))])[: len(room)]
        #: the byte to the left, or a value of its own where a string begins
        self.left = np.where(self.at == 0, -1 - np.arange(len(self.at)), self.flat[self.pos - 1] if len(self.flat) else 0)

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, lo, hi): the suffixes sa[lo..hi] share ``length`` bytes, which can be extended to neither side."""
        lcp, left, sa, least = self.lcp, self.left, self.sa, self.least
        whole = np.maximum(lcp, np.append(lcp[1:], 0)) < self.room[sa]
        for i in np.flatnonzero(whole & (self.at[sa] == 0) & (self.times[self.own[sa]] > 1)):
            yield int(self.room[sa[i]]), int(i), int(i)
        inside = lcp >= least
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            chars = left[sa[a - 1 : b]].tolist()
            heights = lcp[a:b].tolist() + [0]
            stack: list[list] = []  # length, lo, the one byte to the left or None
            for k, height in enumerate(heights):
                lo, char = a - 1 + k, chars[k]
                while stack and stack[-1][0] > height:
                    length, start, seen = stack.pop()
                    seen = seen if seen == char else None
                    if seen is None:
                        yield length, start, a - 1 + k
                    lo, char = start, seen
                if height < least:
                    break
                if stack and stack[-1][0] == height:
                    if stack[-1][2] != char:
                        stack[-1][2] = None
                else:
                    stack.append([height, lo, char])

    def labels(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the array of the intervals at the depth of ``least`` bytes of the marked strings."""
        keep = of[self.own[self.sa]]
        edge = np.flatnonzero(self.lcp < self.least)
        lo, hi = edge, np.append(edge[1:], len(self.sa)) - 1
        return lo[keep[lo]], hi[keep[lo]]


def _lists(rows: list[tuple[str, str]]) -> str:
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in rows) + ">>"


def _list(ends: np.ndarray, **columns) -> pa.ListArray:
    fields = [pa.array(v) for v in columns.values()]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(fields, names=list(columns)))


STRINGS = [("a", "bigint"), ("c", "bigint"), ("lo", "bigint"), ("k", "bigint")]
SUFFIXES = [("string", "int"), ("at", "int")]
GROUPS = [("g1", "bigint"), ("g2", "bigint"), ("length", "bigint"), ("lo", "bigint"), ("hi", "bigint"), ("shift", "bigint")]
COVERED = [("a", "bigint"), ("c", "bigint"), ("lo", "bigint"), ("hi", "bigint")]
ARRAY = f"array long, strings {_lists(STRINGS)}, suffixes {_lists(SUFFIXES)}, groups {_lists(GROUPS)}, covered {_lists(COVERED)}, labels array<struct<lo:bigint,hi:bigint>>"
LABEL = "label int, g1 long, g2 long, left_lo binary, left_hi binary, rest_lo binary, rest_hi binary"


def _united(string: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of strings, united."""
    order = np.lexsort((lo, string))
    string, lo, hi = string[order], lo[order], hi[order]
    base = string * np.int64(1 << 20)  # strings are far shorter
    reach = np.maximum.accumulate(base + hi) if len(hi) else hi
    new = np.flatnonzero(np.concatenate([[True], (base + lo)[1:] > reach[:-1]])) if len(hi) else np.zeros(0, np.int64)
    end = reach[np.append(new[1:], len(hi)) - 1] if len(hi) else hi
    return string[new], lo[new], end - base[new]


def _arrays(span: int):
    """Halves by key and chunk -> arrays with their maximal repeat groups, and the labelled intervals of keys in several chunks.

    An array's row has its strings, its suffixes in order, the groups as intervals of these, and the united spans of the
    groups' occurrences in each string: an occurrence is written once, in however many groups of the tree it is.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, a, c, k, at = (t[x].to_numpy().astype(np.int64) for x in ("n", "a", "c", "k", "lo"))
        sa = SuffixArray(t["bytes"].to_pylist(), span, k, n == 1)
        if not len(sa.sa):
            return
        name = mix(t["key"].to_numpy()[:1].view(U) + t["chunk"].to_numpy()[:1].astype(U) * U(GOLD)).view(np.int64)
        sums, gram = Sums(sa.flat), gram32(sa.flat)
        found = np.array(list(sa.maximal_repeats()), np.int64).reshape(-1, 3)
        lo, hi = sa.labels(n > GROUP)
        used = np.zeros(len(sa.sa) + 1, np.int64)  # suffixes in a group or label
        for x, y in ((found[:, 1], found[:, 2]), (lo, hi)):
            np.add.at(used, x, 1)
            np.add.at(used, y + 1, -1)
        used = np.cumsum(used[:-1]) > 0
        place = np.cumsum(used) - 1
        kept = sa.sa[used]
        length, glo, ghi = found.T
        reach = np.zeros(len(sa.sa), np.int64)
        for i in np.argsort(length, kind="stable"):
            reach[glo[i] : ghi[i] + 1] = length[i]
        on = np.flatnonzero(reach)
        s, x, y = _united(sa.own[sa.sa[on]], sa.at[sa.sa[on]], sa.at[sa.sa[on]] + reach[on])
        head = sa.pos[sa.sa[glo]]
        one = np.array([0])
        row = {
            "array": pa.array(name),
            "strings": _list(one + len(a), a=a, c=c, lo=at, k=k),
            "suffixes": _list(one + len(kept), string=sa.own[kept].astype(np.int32), at=sa.at[kept].astype(np.int32)),
            "groups": _list(one + len(found), g1=sums.of(head, head + length, 13).view(np.int64), g2=gram[head].view(np.int64), length=length, lo=place[glo], hi=place[ghi], shift=length * 0),
            "covered": _list(one + len(s), a=a[s], c=c[s], lo=at[s] + x, hi=at[s] + y),
            "labels": _list(one + len(lo), lo=place[lo], hi=place[hi]),
        }
        names = [x.split()[0] for x in LABEL.split(", ")]
        none = {x: pa.nulls(1, t) for x, t in zip(names, [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)}
        yield pa.RecordBatch.from_pydict({**row, **none})
        for i in range(0, len(lo), 1 << 12):
            x, y = lo[i : i + (1 << 12)], hi[i : i + (1 << 12)]
            size = y - x + 1
            ends = np.cumsum(size)
            each = sa.sa[np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(x, size)]
            # least and largest of the bytes before, read backwards, and of the bytes behind
            left = [sa.flat[p - q : p][::-1].tobytes() for p, q in zip(sa.pos[each], sa.at[each], strict=True)]
            pick = lambda f: pa.array([f(left[p:q]) for p, q in zip((ends - size).tolist(), ends.tolist(), strict=True)], pa.binary())  # noqa: B023,E731
            tail = lambda z: pa.array([sa.flat[p + span : p + r].tobytes() for p, r in zip(sa.pos[sa.sa[z]], sa.room[sa.sa[z]], strict=True)], pa.binary())
            head = sa.pos[sa.sa[x]]
            columns = [pa.array(np.arange(i, i + len(x)), pa.int32()), pa.array(sums.of(head, head + span, 13).view(np.int64)), pa.array(gram[head].view(np.int64)), pick(min), pick(max), tail(x), tail(y)]
            empty = {c: pa.nulls(len(x), row[c].type) for c in row if c != "array"}
            yield pa.RecordBatch.from_pydict({"array": pa.array(np.repeat(name, len(x))), **empty, **dict(zip(names, columns, strict=True))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            key, chunk = t["key"].to_numpy(), t["chunk"].to_numpy()
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(chunk) != 0)) + 1
            size = np.cumsum(np.array([len(x) for x in t["bytes"].to_pylist()], np.int64))
            at = 0
            for e in edges:
                if size[e - 1] - (size[at - 1] if at else 0) >= CHUNK:
                    yield from work(t.slice(at, e - at).combine_chunks())
                    at = int(e)
            left = t.slice(at)
        if left is not None and len(left):
            yield from work(left.combine_chunks())

    return run, f"{ARRAY}, {LABEL}"


def _merged(span: int):
    """Arrays with the labels they share with others (``cross``) -> the groups of these labels and the spans they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                flat = lambda name, field: batch.column(batch.schema.get_field_index(name)).slice(r, 1).flatten().field(field).to_numpy().astype(np.int64)  # noqa: B023,E731
                label, g1, g2, before, behind = (flat("cross", i) for i in range(5))
                lo, hi = flat("labels", 0)[label], flat("labels", 1)[label]
                a, c, at = (flat("strings", i) for i in range(3))
                size = hi - lo + 1
                ends = np.cumsum(size)
                each = np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(lo, size)
                string, x = flat("suffixes", 0)[each], flat("suffixes", 1)[each]
                s, x, y = _united(string, x - np.repeat(before, size), x + span + np.repeat(behind, size))
                one = np.array([0])
                yield pa.RecordBatch.from_pydict({
                    "array": batch.column(0).slice(r, 1),
                    "groups": _list(one + len(label), g1=g1, g2=g2, length=span + before + behind, lo=lo, hi=hi, shift=-before),
                    "covered": _list(one + len(s), a=a[s], c=c[s], lo=at[s] + x, hi=at[s] + y),
                })

    return run, f"array long, groups {_lists(GROUPS)}, covered {_lists(COVERED)}"


def keyed(docs: DataFrame) -> DataFrame:
    """A row's identity: its doc_id (or the least long) and a hash of its text."""
    return docs.withColumns({"_wl_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_wl_t": F.xxhash64(F.coalesce("text", F.lit("")))})


def united(spans) -> F.Column:
    """Spans (lo, hi) as disjoint ones, in order."""
    kind = "array<struct<lo:bigint,hi:bigint>>"

    def add(done, x):
        top = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top.lo.alias("lo"), F.greatest(top.hi, x.hi).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).hi >= x.lo), longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), add)


class Repeats:
    """Maximal repeat groups of the texts of some documents."""

    def __init__(self, docs: DataFrame, span: int = SPAN):
        self.span, self.store = span, Store(docs.sparkSession, "suffix")
        store = self.store
        base = keyed(docs).select(F.col("_wl_d").alias("d"), F.col("_wl_t").alias("t"), "text")
        run, types = _places(span)
        places = store.put(base.mapInArrow(run, types), "places")
        anchors = store.put(places.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
        store.release()
        #: contexts whose anchor is found more than once
        self.contexts = store.put(spread_join(places, anchors.select("a"), ["a"], anchors), "contexts")
        store.drop("places")
        store.release()
        #: classes of equal contexts: how many, and where one of them is
        self.classes = store.put(self.contexts.groupBy("a", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("d", "t", "at", "n", "p")).alias("r")), "classes")
        wanted = self.classes.groupBy("r.d", "r.t").agg(F.collect_list(F.struct("r.at", "r.n", "r.p", "a", "c", "k")).alias("wanted"))
        run, types = _halves(span)
        halves = store.put(base.join(wanted, ["d", "t"]).dropDuplicates(["d", "t"]).select("text", "wanted").mapInArrow(run, types), "halves")
        store.release()
        shared = store.put(halves.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("of")).where("of > 1").select("key", "n"), "shared")
        chunk = F.pmod(F.xxhash64("a", "c"), F.ceil(F.col("n") / GROUP)).cast("int")
        rows = spread_join(halves, shared.withColumnRenamed("n", "of"), ["key"], shared).withColumnRenamed("of", "n").withColumn("chunk", chunk)
        run, types = _arrays(span)
        rows = rows.select("key", "chunk", "n", "a", "c", "k", "lo", "bytes").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "a", "c")
        found = store.put(rows.mapInArrow(run, types), "found")
        store.drop("halves", "shared")
        store.release()
        #: suffix arrays: strings (class, place, multiplicity), suffixes in order, groups as intervals, covered spans
        self.arrays = found.where("label IS NULL").select("array", "strings", "suffixes", "groups", "covered", "labels")
        #: groups of labels that several arrays hold, and what they cover
        self.merged = store.put(self._merge(found.where("label IS NOT NULL")), "merged")

    def _merge(self, labels: DataFrame) -> DataFrame:
        ends = [f(x).alias(x) for f, x in ((F.min, "left_lo"), (F.max, "left_hi"), (F.min, "rest_lo"), (F.max, "rest_hi"))]
        several = labels.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")

        def shared(lo, hi) -> list[int]:
            return [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(lo, hi, strict=True)]

        def extend(batches):
            for p in batches:
                yield p[["g1", "g2"]].assign(before=shared(p["left_lo"], p["left_hi"]), behind=shared(p["rest_lo"], p["rest_hi"]))

        several = several.drop("n").mapInPandas(extend, "g1 long, g2 long, before int, behind int")
        cross = labels.select("array", "label", "g1", "g2").join(several, ["g1", "g2"]).groupBy("array").agg(F.collect_list(F.struct("label", "g1", "g2", "before", "behind")).alias("cross"))
        run, types = _merged(self.span)
        return self.arrays.join(cross, "array").select("array", "strings", "suffixes", "labels", "cross").mapInArrow(run, types)

    def groups(self) -> DataFrame:
        """(g1, g2, length, occurrences): the repeated bytes by hash, and the classes that hold them, with their counts.

        A group whose labels several arrays hold has a row for each of them. Groups of one tree are nested, so this list may
        be far longer than ``arrays`` and ``merged``, which hold each occurrence once.
        """
        rows = self.arrays.select("array", F.explode("groups").alias("g")).unionByName(self.merged.select("array", F.explode("groups").alias("g")))
        both = rows.join(self.arrays.select("array", "strings", "suffixes"), "array")
        inside = F.slice("suffixes", (F.col("g.lo") + 1).cast("int"), (F.col("g.hi") - F.col("g.lo") + 1).cast("int"))

        def place(x):
            s = F.element_at("strings", x.string + 1)
            return F.struct(s.a.alias("a"), s.c.alias("c"), (s.lo + x.at + F.col("g.shift")).alias("lo"), s.k.alias("k"))

        return both.select("g.g1", "g.g2", "g.length", F.transform(inside, place).alias("occurrences"))

    def occurrences(self) -> DataFrame:
        """(g1, g2, length, d, t, lo): every group with all its places, in texts as ``keyed`` names them."""
        of = self.groups().select("g1", "g2", "length", F.explode("occurrences").alias("o")).select("g1", "g2", "length", "o.a", "o.c", "o.lo").distinct()
        held = self.contexts.select("a", "c", "d", "t", "at")
        both = spread_join(held, of, ["a", "c"], self.classes.select("a", "c", F.col("k").alias("n")))
        return both.select("g1", "g2", "length", "d", "t", (F.col("at") + F.col("lo")).alias("lo")).distinct()

    def spans(self) -> DataFrame:
        """(d, t, spans): the bytes of each text that strings of ``span`` bytes found elsewhere cover."""
        one = self.arrays.select(F.explode("covered").alias("o")).unionByName(self.merged.select(F.explode("covered").alias("o"))).select("o.*")
        of = self.store.put(one.groupBy("a", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select("a", "c", united(F.col("spans")).alias("spans")), "covers")
        held = spread_join(self.contexts.select("a", "c", "d", "t", "at"), of, ["a", "c"], self.classes.select("a", "c", F.col("k").alias("n")))
        moved = F.transform("spans", lambda s: F.struct((s.lo + F.col("at")).alias("lo"), (s.hi + F.col("at")).alias("hi")))
        return held.select("d", "t", moved.alias("spans")).groupBy("d", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans, kept_sha256, ``spans`` of removed bytes and the ``kept`` bytes."""
    docs = ahead(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
    per = Repeats(docs, span).spans().select(F.col("d").alias("_wl_d"), F.col("t").alias("_wl_t"), F.col("spans").alias("_wl_spans"))
    joined = keyed(docs).join(per, ["_wl_d", "_wl_t"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_wl_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, max_bytes=1 << 22):
                got = batch.column(batch.num_columns - 1).slice(lo, hi - lo)
                own = np.repeat(np.arange(hi - lo), got.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                s = got.flatten()
                on = np.zeros(len(data) + 1, np.int32)
                np.add.at(on, offs[own] + s.field(0).to_numpy().astype(np.int64), 1)
                np.add.at(on, offs[own] + s.field(1).to_numpy().astype(np.int64), -1)
                gone = np.cumsum(on[:-1]) > 0
                out: list[list] = [[], [], [], [], [], []]
                for a, b in zip(offs[:-1], offs[1:], strict=True):
                    part = gone[a:b]
                    if part.any():
                        kept = data[a:b][~part].tobytes()
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                        cut = [{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    else:
                        kept, cut = data[a:b].tobytes(), []
                    for c, v in zip(out, (b - a, b - a - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), cut, kept), strict=True):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.binary()]
                mine = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(mine + [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*batch.schema.names[:-1], "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return joined.mapInArrow(run, ddl(docs, "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "spans array<struct<lo:long,hi:long>>", "kept binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
st AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200),
x AS (SELECT doc_id, i, sha256(array_slice(b, i, i + 199)) AS h FROM st),
again AS (SELECT doc_id, i FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
mark AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 199 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark) GROUP BY doc_id, r),
ends AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
kept AS (SELECT e.doc_id, string_agg(hex(array_slice(b, before + 1, lo - 1)), '' ORDER BY lo) || hex(array_slice(any_value(b), max(hi) + 1, octet_length(any_value(b)))) AS k, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans
  FROM ends e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN k IS NULL THEN b ELSE from_hex(k) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def brute_force(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by counting all strings; for tests."""
    raw, seen = [(t or "").encode() for t in texts], {}
    for x in raw:
        for i in range(len(x) - span + 1):
            seen[x[i : i + span]] = seen.get(x[i : i + span], 0) + 1
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
