"""The written index against BM25 by hand, whatever the blocks are, and what it leaves unread."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from watchloom.operators import search as S
from watchloom.operators.index import TextIndex
from watchloom.sources.scratch import Store

R = random.Random(4)
WORDS = [w for i in range(40) for w in [f"w{i}"] * (1 + 200 // (i + 1))]
DOCS = [(i, " ".join(R.choice(WORDS) for _ in range(R.randrange(1, 30))), " ".join(R.choice(WORDS) for _ in range(R.randrange(0, 4)))) for i in range(300)]
DOCS += [(300, None, "w1"), (301, "", None), (302, "W1, w1. rare", "w1"), (303, "rare", "rare rare")]
QUERIES = [(0, "w0 w1 rare"), (1, "w0"), (2, "unknown"), (3, None), (4, "w5 w17 w30 w0 W1 w1"), (5, "rare")]


def tokens(t):
    return [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]


def by_hand(weights, best):
    """{query: {doc: score}}"""
    out: dict = {q: {} for q, _ in QUERIES}
    for at, weight in weights:
        lists = {d[0]: tokens(d[at]) for d in DOCS}
        average = sum(map(len, lists.values())) / len(lists)
        df = Counter(w for ws in lists.values() for w in set(ws))
        for q, text in QUERIES:
            for d, ws in lists.items():
                tf = Counter(ws)
                s = sum(math.log(1 + (len(lists) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in set(tokens(text)) if tf[w])
                if any(tf[w] for w in tokens(text)):
                    out[q].setdefault(d, []).append(weight * s)
    return {q: {d: (max if best else sum)(v) for d, v in found.items()} for q, found in out.items()}


@pytest.fixture(scope="module", params=[4, 512])
def index(spark, request):
    docs = spark.createDataFrame(DOCS, "id int, text string, title string")
    return TextIndex.build(docs, "id", {"text": F.col("text"), "title": F.col("title")}, block=request.param)


def queries(spark):
    return spark.createDataFrame(QUERIES, "query int, text string")


@pytest.mark.parametrize("best", [False, True])
def test_scores_and_top_equal_bm25_by_hand(spark, index, best):
    weights = {"text": 1.0, "title": 2.5}
    want = by_hand([(1, 1.0), (2, 2.5)], best)
    got: dict = {q: {} for q, _ in QUERIES}
    for r in index.scores(queries(spark), weights, best).collect():
        got[r["query"]][r.doc] = round(r.score, 9)
    assert got == {q: {d: round(s, 9) for d, s in v.items()} for q, v in want.items()}
    for k in (1, 7, 1000):
        top: dict = {q: [] for q, _ in QUERIES}
        for r in index.top(queries(spark), k, weights, best).orderBy("query", "rank").collect():
            top[r["query"]].append((r.doc, round(r.score, 9)))
        assert top == {q: sorted(((d, round(s, 9)) for d, s in v.items()), key=lambda x: (-x[1], x[0]))[:k] for q, v in want.items()}


def test_frequent_words_stay_unread(spark, index):
    asked = Store(spark, "test").put(index._asked(queries(spark).where("query = 0"), {"text": 1.0}, {}), "asked")
    every = asked.join(index.table("blocks"), ["field", "term"]).count()
    read = index.read(asked, 2, False).count()
    assert read < every / 2
    assert index.table("blocks").agg(F.max(F.size("postings"))).first()[0] <= (512 if every == 3 else 4)


def test_equals_the_join_on_postings_and_empty_tables(spark, index):
    docs = spark.createDataFrame(DOCS, "id int, text string, title string")
    q = queries(spark)
    old = {(r["query"], r.doc): round(r.score, 9) for r in S.bm25(q, docs.fillna(""), "query", "text", "id", "text").collect()}
    assert {(r["query"], r.doc): round(r.score, 9) for r in index.scores(q, {"text": 1.0}).collect()} == old
    empty = TextIndex.build(docs.limit(0), "id", {"text": F.col("text")})
    assert empty.top(q, 3, {"text": 1.0}).count() == 0 and index.top(q.limit(0), 3, {"text": 1.0}).count() == 0
    twice = TextIndex.build(spark.createDataFrame([(1, "a b"), (1, "b"), (None, "a")], "id int, text string"), "id", {"text": F.col("text")})
    assert [(r.doc, r.term, r.tf) for r in twice.table("forward").orderBy("term").collect()] == [(1, "a", 1), (1, "b", 2)]


ODD = [(1, "a b a"), (1, "b c"), (1, "a a"), (2, None), (3, ""), (4, "  , A-b!"), (None, "a c"), (5, "Ünï b b b b"), (6, "a b"), (7, "a b"), (8, "a b")]


@pytest.mark.parametrize("k, text", [(2, 1 << 22), (3, 4), (100, 8)])
def test_ranking_in_chunks_equals_the_join_on_postings(spark, monkeypatch, k, text):
    """Repeated ids, null and empty texts, equal scores, several blocks and chunks; no row for each query and document is shuffled."""
    monkeypatch.setattr(S, "CHUNK_BYTES", text)
    monkeypatch.setattr(S, "BLOCK", 2)
    for rows, asked in ((ODD, [(0, "a b c"), (1, "B ünï"), (2, "nothing"), (3, None), (0, "c"), (4, "a")]), ([(d[0], d[1]) for d in DOCS], QUERIES)):
        docs, q = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(asked, "query int, text string")
        key = lambda r: (r["query"], r["rank"], r.doc, round(r.score, 9))
        want = S.top(S.bm25(q, docs, "query", "text", "id", "text"), k)
        assert sorted(map(key, S.bm25_top(q, docs, "query", "text", "id", "text", k).collect())) == sorted(map(key, want.collect()))
    assert S.bm25_top(q.limit(0), docs, "query", "text", "id", "text", k).count() == 0 == S.bm25_top(q, docs.limit(0), "query", "text", "id", "text", k).count()


def test_ranked_documents_write_no_postings(spark, monkeypatch):
    from watchloom.registry import QUERIES as REGISTERED

    monkeypatch.setattr(TextIndex, "build", lambda *a, **k: pytest.fail("an index of all postings is written"))
    for name in ("bm25_topk", "rrf_hybrid_top2"):
        assert REGISTERED[name](spark, "/root/testdata/sf0.001").count()
