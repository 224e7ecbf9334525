"""The lattice model against enumerated segmentations, a plain recomputation of the whole model, and the word model it is held against."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.test_text_operators import ROWS
from tests.test_queries import SF
from watchloom.llm import lattice, lattice_lm
from watchloom.llm.language_id import remainder

PATH = public_tokenizers.path("piece_bpe_32k.model")
LANGS = ["en", "de", "fr", None]
DOCS = [(i, t, LANGS[k % 4], "own") for k, (i, t) in enumerate([*ROWS, (None, "the of lorem"), (1, "same id"), (40, "日本語 Ünder\x00x é\tw1 neu"), (41, "nowhereelse qqq zzz")])]


def packed(words):
    raw = [b" " + w.encode() for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [pieces[word[:n]], *rest]


def test_marginal_and_expected_counts_are_those_of_all_segmentations():
    known = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba", b" ab", bytes([0xC3]), bytes([0xA9]), "é".encode()]
    index = {p: i for i, p in enumerate(known)}
    logp = np.log(np.random.RandomState(3).dirichlet(np.ones(len(known))))
    words = ["a", "abab", "bababa", "é", "aéb", "", "aaaaaaaa"]
    times = np.arange(1.0, len(words) + 1)
    made = lattice.Lattice.build(lattice.Trie(known), *packed(words))
    total, want = np.zeros(len(known)), []
    for w, k in zip(words, times, strict=True):
        paths = list(segmentations(b" " + w.encode(), index))
        weight = [math.exp(sum(logp[i] for i in p)) for p in paths]
        want.append(math.log(sum(weight)))
        for p, x in zip(paths, weight, strict=True):
            for i in p:
                total[i] += k * x / sum(weight)
    assert np.allclose(made.marginal(logp), want)
    got, likelihood = made.expected(logp, times, len(known))
    assert np.allclose(got, total) and math.isclose(likelihood, float((np.array(want) * times).sum()))


def test_no_words_and_a_word_as_long_as_a_text():
    trie, start = lattice_lm.vocabulary(PATH)
    assert len(lattice.Lattice.build(trie, *packed([])).marginal(start)) == 0
    one, long = lattice.Lattice.build(trie, *packed(["q" * 10, "q" * 200_000])).marginal(start)
    assert np.isfinite(long) and long < 1000 * one


def test_pieces_cover_every_byte_a_word_can_hold():
    found, scores = lattice.pieces(PATH)
    assert len(found) == len(set(found)) == len(scores)
    assert {bytes([b]) for b in range(256) if not (9 <= b <= 13 or 65 <= b <= 90)} <= set(found)
    assert not any(re.search(rb"[A-Z\t\n]", p) or b" " in p[1:] for p in found)


def brute_force(docs, learn, rounds=lattice_lm.ROUNDS):
    """(n_tokens, n_known, N, base, score) of each document, by dictionaries and a recursion per word."""
    pieces, scores = lattice.pieces(PATH)
    index = {p: i for i, p in enumerate(pieces)}
    cut = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for _, t, _, _ in docs]
    taught = [(w, lang or "") for w, (i, _, lang, _) in zip(cut, docs, strict=True) if learn(i)]
    sizes = Counter(lang for _, lang in taught)
    groups = sorted(sizes, key=lambda k: (-sizes[k], k))
    counts = {g: Counter(w for ws, lang in taught if lang == g for w in ws) for g in groups}
    start = np.array([1 / (1 + max(0.0, -s)) for s in scores])
    start /= start.sum()
    longest = max(map(len, pieces))

    def arcs(word):
        b = b" " + word.encode()
        return len(b), [(x, y, index[b[x:y]]) for y in range(1, len(b) + 1) for x in range(max(0, y - longest), y) if b[x:y] in index]

    def forward(word, p):
        n, found = arcs(word)
        alpha = [0.0] + [-math.inf] * n
        for x, y, i in found:
            alpha[y] = np.logaddexp(alpha[y], alpha[x] + math.log(p[i]))
        return alpha, found

    model = {}
    for g in groups:
        p = start
        for _ in range(rounds if sum(map(sum, (c.values() for c in counts.values()))) else 0):
            total = np.full(len(pieces), lattice_lm.FLOOR)
            for w, k in counts[g].items():
                alpha, found = forward(w, p)
                beta = [-math.inf] * (len(alpha) - 1) + [0.0]
                for x, y, i in reversed(found):
                    beta[x] = np.logaddexp(beta[x], math.log(p[i]) + beta[y])
                for x, y, i in found:
                    total[i] += k * math.exp(alpha[x] + math.log(p[i]) + beta[y] - alpha[-1])
            p = total / total.sum()
        model[g] = p
    memo = {}

    def scored(g, w):
        if (g, w) not in memo:
            memo[g, w] = forward(w, model[g])[0][-1]
        return memo[g, w]

    every = Counter()
    for c in counts.values():
        every.update(c)
    n_docs = sum(sizes.values())
    N, V = sum(every.values()) + n_docs, len(every) + (n_docs > 0)  # noqa: N806
    out = []
    for ws in cut:
        by = []
        for g in groups:
            words = sum(counts[g].values())
            lam = min(0.999, max(0, 1 - sum(k == 1 for k in counts[g].values()) / words)) if words else 0
            end = (sizes[g] + 1) / (sizes[g] + words + 2)
            s = math.log10(sizes[g] / n_docs) + math.log10(end)
            for w in ws:
                whole = lam * ((1 - lattice_lm.SHARED) * counts[g][w] / max(1, words) + lattice_lm.SHARED * every[w] / max(1, sum(every.values())))
                s += (np.logaddexp(math.log(whole) if whole else -math.inf, math.log(1 - lam) + scored(g, w)) + math.log(1 - end)) / math.log(10)
            by.append(s)
        base = sum(math.log10((every[w] + 1) / (N + V + 1)) for w in ws) + math.log10((n_docs + 1) / (N + V + 1))
        out.append((len(ws) + 1, sum(every[w] > 0 for w in ws) + (n_docs > 0), N, base, max(by) + math.log10(sum(10 ** (x - max(by)) for x in by))))
    return out


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_scores_equal_a_plain_recomputation(spark, size):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, Score string")
    got, model = lattice_lm.score_documents(df, PATH, remainder("doc_id", 7) != 2, size=size)
    assert model.docs.sum() == sum(i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in DOCS)
    want = brute_force(DOCS, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()), key=key)
    for a, b in zip(have, sorted(((d[0], *w) for d, w in zip(DOCS, want, strict=True)), key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-5), (a, b)


def test_nothing_to_learn_from_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted(lattice_lm.score_documents(df, PATH, remainder("doc_id", 7) == 99)[0].collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows) and math.isclose(rows[1].score, math.log10(0.5))
    assert lattice_lm.score_documents(df.limit(0), PATH, remainder("doc_id", 7) != 2)[0].collect() == []


def test_documents_are_likelier_than_under_the_word_model(spark):
    rows = lattice_lm.query(spark, SF).collect()
    for held in (False, True):
        mine = [r for r in rows if r.held_out is held]
        assert mine and all(r.score < 0 and r.n_known <= r.n_tokens for r in mine)
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)
