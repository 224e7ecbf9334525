"""Encoding with public tokenizers of the ``tokenizers`` library, with a bounded cache of words in front of it.

Both kinds of vocabulary used here cut a text into pieces that never reach over a blank behind a word: a text without two
blanks in a row may be encoded word by word (each with the blank before it) and gives the ids of the whole text. Words
repeat, so a worker keeps the ids of the first ``CACHE`` short ones it meets (about 200 MB); the others go through the
library. Texts with doubled blanks go through it whole.

A word of plain letters, or one with a single mark behind it, is one piece (and the mark another), so it is given to the
library's model without the normaliser and splitter in front; every other word goes through the whole tokenizer in one call
a block. Which of the two kinds a file is of is read from the file; for any other kind texts are encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

CACHE = 900_000
LONGEST = 32
MARKS = ".,;:!?"
#: Letters below this code point are composed already and are lowered alike everywhere, but for the dotted capital I.
LATIN = "\u0180"
_loaded: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Encoder:
    def __init__(self, path: str, add_special_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.special = Tokenizer.from_file(path), add_special_tokens
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = {k: v for k, v in json.load(f).items() if k != "model"}
        splitter, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        byte = normalizer is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        lowered = [x.get("type") for x in (normalizer or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        word = lowered and [x.get("type") for x in splitter.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        self.kind = "" if add_special_tokens or spec.get("post_processor") else "byte" if byte else "word" if word else ""
        self.letters = byte_letters()
        self.model, self.blank = self.tokenizer.model, self.letters[32] if byte else ""
        self.marks = dict(zip(MARKS, self._library(list(MARKS)), strict=True))

    def _plain(self, w: str) -> bytes | None:
        """The ids of a blank and a word of plain letters, perhaps with a mark behind; None for any other word."""
        core, mark = w, b""
        if not w.isalpha():
            core = w[:-1]
            if w[-1:] not in self.marks or not core.isalpha():
                return None
            mark = self.marks[w[-1]]
            if (got := self.known.get(core)) is not None:
                return got + mark
        x = core.lower() if self.kind == "word" else core
        if not core.isascii():
            if max(core) >= LATIN or "\u0130" in core:
                return None
            x = x.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(self.blank + x)]).tobytes() + mark

    @classmethod
    def get(cls, path: str) -> Encoder:
        """The worker's encoder for this file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=self.special)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint32."""
        if not self.kind:
            return [np.frombuffer(x, "<u4") for x in self._library(texts)]
        known, parts, holes = self.known, [], []
        room = CACHE - len(known)
        for t in texts:
            if "  " in t:
                parts.append([b""])
                holes.append((len(parts) - 1, 0, t, t))
                continue
            head, *words = t.split(" ")
            got = [b"", *map(known.get, words)]
            holes.append((len(parts), 0, head, head))
            i = 0
            for _ in range(got.count(None)):
                i = got.index(None, i)
                w = words[i - 1]
                one = known.get(w) or self._plain(w)
                if one is None:
                    holes.append((len(parts), i, w, " " + w))
                    one = b""
                elif room > 0 and len(w) <= LONGEST and w not in known:
                    known[w] = one
                    room -= 1
                got[i] = one
            parts.append(got)
        ask = list(dict.fromkeys(x[3] for x in holes))
        ids = dict(zip(ask, self._library(ask), strict=True))
        for p, i, w, text in holes:
            parts[p][i] = one = ids[text]
            if i and room > 0 and len(w) <= LONGEST and w not in known:
                known[w] = one
                room -= 1
        return [np.frombuffer(b"".join(p), "<u4") for p in parts]
