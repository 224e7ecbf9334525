"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one class: for each run its first place in characters and in bytes, its length and
the units counted up to its end. A cut behind u units is found by a binary search for the run in which the units reach u,
and its place inside that run is arithmetic: no unit is listed and no text is split into tokens. Three kinds of units exist:

* ``token``: classes are white space (``[\\x20\\x09-\\x0D]``) and the rest; a unit is a run of the rest with the white space
  before it, or white space at the very end. Every run of the rest completes one unit, so a cut is the end of a run.
* ``char``: classes are the widths of UTF-8 characters (1 to 4 bytes); a unit is a character, and a cut lies ``u`` less the
  units before the run characters into it, which the width turns into bytes.
* ``byte``: the same classes; a unit is a byte, and a cut inside a character falls back to the character's start.

Cuts, form and order come from the digest of seed and doc_id, so they are the same on every run and every executor. The
forms are ``psm`` (``<P>prefix<S>suffix<M>middle``), ``spm`` (``<S>suffix<P>prefix<M>middle``) and ``plain`` (the text).
``restore`` gives the exact text back from output and form alone: texts that hold a sentinel stay plain, and a sentinel cannot
come about where a piece meets another, since only its first character is ``<``.

Defined cases: a null text is empty; an empty text is plain with n = 0; a text of white space alone is one token; a null doc_id
has the digest of the seed, a colon and nothing; rows alike in id and text are transformed alike; an empty table gives no
rows. Other columns are carried along by ``transform``, one named like a new column gives way. A text is worked on whole, in blocks of
whole texts of about ``BLOCK`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from watchloom.llm.kernel import SPACED, blocks
from watchloom.llm.store import ahead, ddl, table

SENTINELS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 22
#: Width of a character by its first byte; 0 for the bytes inside a character.
WIDTH = np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.uint8)


@dataclass
class Runs:
    """The maximal runs of a block of texts, one after the other.

    start, char: each run's first byte and first character in the block; width: bytes of a unit inside the run, 0 if the run is one
    unit or part of one; units: units of the block complete at the end of each run; first: each text's first run.
    """

    unit: str
    start: np.ndarray
    char: np.ndarray
    width: np.ndarray
    units: np.ndarray
    first: np.ndarray
    offs: np.ndarray
    offs_char: np.ndarray

    @classmethod
    def encode(cls, data: np.ndarray, offs: np.ndarray, unit: str) -> Runs:
        n = len(data)
        lead = WIDTH[data]
        chars = np.zeros(n + 1, np.int64)
        np.cumsum(lead > 0, out=chars[1:])
        at = np.arange(n) if unit == "token" else np.flatnonzero(lead)  # where a run may begin
        kind = SPACED[data] if unit == "token" else lead[at]
        new = np.ones(len(at), bool)
        new[1:] = kind[1:] != kind[:-1]
        begins = offs[:-1][np.diff(offs) > 0]
        new[np.searchsorted(at, begins)] = True
        start, kind = at[new], kind[new]
        first = np.searchsorted(start, offs)
        stop = np.append(start[1:], n)
        if unit == "token":
            last = np.zeros(len(start), bool)
            last[first[1:][np.diff(first) > 0] - 1] = True
            each, width = (kind | last).astype(np.int64), np.zeros(len(start), np.int64)
        else:
            width = kind.astype(np.int64)
            each = chars[stop] - chars[start] if unit == "char" else stop - start
        return cls(unit, start, chars[start], width, np.cumsum(each), first, offs, chars[offs])

    def before(self) -> np.ndarray:
        """Units of the block before each text, and all of them."""
        return np.concatenate([[0], self.units])[self.first]

    def cut(self, text: int, u: int) -> tuple[int, int]:
        """(byte, character) in the text behind its first ``u`` units."""
        if not u:
            return 0, 0
        lo, hi = self.first[text], self.first[text + 1]
        done = self.units[lo - 1] if lo else 0
        r = lo + int(np.searchsorted(self.units[lo:hi], done + u))
        if self.unit == "token":  # the end of run r
            byte = self.start[r + 1] if r + 1 < hi else self.offs[text + 1]
            char = self.char[r + 1] if r + 1 < hi else self.offs_char[text + 1]
        else:
            inside = u + done - (self.units[r - 1] if r else 0)
            inside //= 1 if self.unit == "char" else self.width[r]
            byte, char = self.start[r] + inside * self.width[r], self.char[r] + inside
        return int(byte - self.offs[text]), int(char - self.offs_char[text])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def form_of(text: bytes, h: list[int], rate: int, spm: int) -> str:
    if not text or h[2] % 100 >= rate or (b"<" in text and any(s.encode() in text for s in SENTINELS)):
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in SENTINELS)
    if form == "plain":
        return prefix + middle + suffix
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: bytes, form: str) -> bytes:
    """The text, from a document's output and form."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in SENTINELS)
    lead, split = (p, s) if form == "psm" else (s, p)
    if not output.startswith(lead):
        raise ValueError(f"output of form {form} does not start with {lead.decode()}")
    one, found, rest = output[len(lead) :].partition(split)
    two, also, middle = rest.partition(m)
    if not (found and also):
        raise ValueError(f"output of form {form} lacks a sentinel")
    return one + middle + two if form == "psm" else two + middle + one


ADDED = ("n long", "form string", "prefix_chars long", "middle_chars long", "output string")


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token") -> DataFrame:
    """``docs`` (doc_id, text, others) with n (units), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of these with the suffix first.
    """
    if unit not in ("token", "char", "byte"):
        raise ValueError(f"unknown unit {unit!r}")
    kept = ahead(docs, *[a.split()[0] for a in ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, offs in blocks(batch, max_bytes=BLOCK):
                runs = Runs.encode(data, offs, unit)
                n = np.diff(runs.before())
                raw = data.tobytes()
                rows: list[tuple] = []
                for i, doc in enumerate(ids.slice(lo, hi - lo).to_pylist()):
                    text, h, k = raw[offs[i] : offs[i + 1]], draws(seed, doc), int(n[i])
                    form = form_of(text, h, rate, spm)
                    if form == "plain":
                        rows.append((k, form, None, None, text))
                        continue
                    (a, ca), (b, cb) = (runs.cut(i, u) for u in sorted((h[0] % (k + 1), h[1] % (k + 1))))
                    rows.append((k, form, ca, cb - ca, assemble(form, text[:a], text[a:b], text[b:])))
                new = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary())
                out = [pa.array(x, t) for x, t in zip(new, kinds, strict=True)]
                out[-1] = out[-1].cast(pa.large_string())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *[a.split()[0] for a in ADDED]])

    return kept.mapInArrow(run, ddl(kept, *ADDED))


def digests(done: DataFrame) -> DataFrame:
    """doc_id, n, form, the cuts, and the digests of the output and of the text rebuilt from output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, output = batch.column(4).to_pylist(), batch.column(5).cast(pa.large_binary())
            hashed: list[tuple[str, str]] = []
            for f, o in zip(form, output, strict=True):  # one output at a time in Python's memory
                o = o.as_py()
                hashed.append((hashlib.sha256(o).hexdigest(), hashlib.sha256(restore(o, f)).hexdigest()))
            two = [pa.array([x[i] for x in hashed], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), *batch.columns[2:4], *two], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    rows = done.select(done["doc_id"].cast("long").alias("doc_id"), "n", "prefix_chars", "middle_chars", "form", "output")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def brute_force(text: str | None, doc_id: int | None, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token") -> tuple[int, str, str | None, str | None, str]:
    """(n, form, prefix, middle, output) by listing the units; for tests."""
    import re

    t = text or ""
    if unit == "token":
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    elif unit == "char":
        units = list(t)
    else:  # a cut inside a character falls back to its start: the character stands at its last byte
        units = [x for c in t for x in [""] * (len(c.encode()) - 1) + [c]]
    h1, h2, h3, h4 = draws(seed, doc_id)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(s in t for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    if h4 % 100 < spm:
        return n, "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}"
