"""Lattices of subword pieces over the bytes of words: all segmentations at once, in log space.

A word stands behind one blank. An arc leads from byte to byte of it where the bytes between are a piece; a path from the first byte to
the end is a segmentation. The forward recursion adds up all paths: at each boundary the log of the sum over arcs ending there of
the start's value times the piece's probability. Words are worked on together, boundary by boundary, so the recursion is a few array
operations for each place in a word, however many words there are.

Every byte that is no piece by itself is one through the vocabulary's byte pieces, so each word has at least one path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLANK = "▁"  # the vocabulary's mark of a blank


def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a vocabulary file that lower-cased words can hold, as bytes, and the file's score of each.

    Left out are control pieces, pieces with A-Z, and those with a blank behind the first character, which lie over two words. Of the
    byte pieces those stay whose byte is no piece by itself.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    single: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            single[bytes([int(sp.id_to_piece(i)[1:-1], 16)])] = sp.get_score(i)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            p = sp.id_to_piece(i)
            if BLANK in p[1:] or any("A" <= c <= "Z" or c in " \t\n\v\f\r" for c in p):
                continue
            out[p.replace(BLANK, " ").encode()] = sp.get_score(i)
    least = min(out.values(), default=0.0)
    for b, _ in sorted(single.items()):
        if not (65 <= b[0] <= 90 or 9 <= b[0] <= 13):
            out.setdefault(b, least - 1)
    return list(out), np.array(list(out.values()))


class Trie:
    """The pieces as a table of transitions; node 0 is the root, and a missing child."""

    def __init__(self, pieces_: list[bytes]):
        child: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, p in enumerate(pieces_):
            at = 0
            for b in p:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                at = child[at][b]
            ends[at] = i
        self.next = np.zeros((len(child), 256), np.uint16 if len(child) <= 1 << 16 else np.int32)
        for k, c in enumerate(child):
            for b, to in c.items():
                self.next[k, b] = to
        self.piece = np.full(len(child), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.size = len(pieces_)


@dataclass
class Lattice:
    """The arcs of a block of words. Boundaries are numbered through: a word of n bytes has n + 1."""

    start: np.ndarray  # boundary where each arc starts
    end: np.ndarray
    piece: np.ndarray
    offset: np.ndarray  # of each boundary within its word
    first: np.ndarray  # first boundary of each word, and the number of boundaries

    @classmethod
    def build(cls, trie: Trie, data: np.ndarray, offs: np.ndarray) -> Lattice:
        """data, offs: the bytes of the words, each with its blank in front."""
        offs = np.asarray(offs, np.int64)
        n = np.diff(offs)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        offset = np.arange(first[-1]) - np.repeat(first[:-1], n + 1)
        word = np.repeat(np.arange(len(n)), n)
        left = np.repeat(offs[1:], n) - np.arange(len(data))  # bytes from here to the word's end
        starts, ends, found = [], [], []
        at, state, length = np.arange(len(data)), np.zeros(len(data), np.int32), 0
        while len(at):
            state = trie.next[state, data[at + length]]
            length += 1
            alive = state > 0
            at, state = at[alive], state[alive]
            hit = trie.piece[state]
            full = hit >= 0
            starts.append(at[full] + word[at[full]])
            ends.append(starts[-1] + length)
            found.append(hit[full])
            more = left[at] > length
            at, state = at[more], state[more]
        none = np.zeros(0, np.int64)
        return cls(np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([none.astype(np.int32), *found]), offset, first)

    def _sweep(self, here: np.ndarray, there: np.ndarray, logp: np.ndarray, value: np.ndarray, backward: bool) -> None:
        """Fills ``value`` at the boundaries ``here`` from those ``there``, place by place."""
        order = np.lexsort((here, self.offset[here]))
        here, there, w = here[order], there[order], logp[self.piece[order]]
        new = np.ones(len(here), bool)
        new[1:] = here[1:] != here[:-1]
        seg = np.flatnonzero(new)  # one for each boundary
        place = self.offset[here[seg]]
        cuts = np.searchsorted(place, np.arange(place.max(initial=-1) + 2))
        seg = np.append(seg, len(here))
        steps = range(len(cuts) - 1)
        for t in reversed(steps) if backward else steps:
            a, b = cuts[t], cuts[t + 1]
            if a == b:
                continue
            lo, hi = seg[a], seg[b]
            x = value[there[lo:hi]] + w[lo:hi]
            at = seg[a:b] - lo
            top = np.maximum.reduceat(x, at)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(at, hi - lo)))), at)
            value[here[seg[a:b]]] = top + np.log(total)

    def forward(self, logp: np.ndarray) -> np.ndarray:
        alpha = np.full(self.first[-1], -np.inf)
        alpha[self.first[:-1]] = 0.0
        self._sweep(self.end, self.start, logp, alpha, False)
        return alpha

    def marginal(self, logp: np.ndarray) -> np.ndarray:
        """Log probability of each word: the sum over all its segmentations."""
        return self.forward(logp)[self.first[1:] - 1]

    def expected(self, logp: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        """How often each piece is expected in the words, each ``times`` times, and the log likelihood of them all."""
        alpha = self.forward(logp)
        last = self.first[1:] - 1
        beta = np.full(self.first[-1], -np.inf)
        beta[last] = 0.0
        self._sweep(self.start, self.end, logp, beta, True)
        every = alpha[last]
        word = np.searchsorted(self.first, self.start, "right") - 1
        share = np.exp(alpha[self.start] + logp[self.piece] + beta[self.end] - every[word]) * times[word]
        return np.bincount(self.piece, share, size), float((every * times).sum())
