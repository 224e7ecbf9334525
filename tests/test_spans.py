"""The extraction chain against a plain reading of its rules, on the fixtures' articles and on random texts."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from watchloom.operators import spans as X
from watchloom.plans import queries as Q
from watchloom.plans.fixtures import named, news

WORDS = ["the", "a", "French", "former", "Interim", "interim", "president", "president", "CEO", "of", "Acme", "Acme's", "Oslo", "office", "headquarters", "main", "vice", "Ann", "Lee", "company", "said", "general", "minister", "university", "chancellor", "\n", ",", "Group", "Tesla", "and", "manager", "leader", "offices", "Chairman"]


def brute_force(text, mentions):
    """(name, kind, start, stop, confidence): each class in turn, each span tested against all that were kept before it."""
    apart = lambda s, kept: all(s[3] <= k[2] or s[2] >= k[3] for k in kept)

    def take(kept, new):
        for s in new:
            if apart(s, kept):
                kept.append(s)
        return kept

    low = lambda a, b: text[max(0, a - 50) : b + 50].lower()
    people = [n.lower().split() for n, k, *_ in mentions if k == "PERSON"]
    inside = lambda a, b: (" " + " ".join(a) + " ") in (" " + " ".join(b) + " ")
    compounds, titles, places = [], [], []
    for pattern, org, title in ((X.ORGANISATION_TITLE, 1, 2), (X.TITLE_OF_ORGANISATION, 2, 1)):
        for m in re.finditer(pattern, text):
            w = m.group(org).split()
            o = " ".join(w[1:]) if len(w) > 1 and w[0].lower() in ("the", "a", "an") else m.group(org)
            ow = o.lower().split()
            if o.lower() in X.NOT_ORGANISATIONS + X.GENERIC_WORDS or set(ow) & set(X.CONNECTIVES) or any(inside(ow, p) or inside(p, ow) for p in people):
                continue
            near = low(m.start(), m.end())
            c = 0.75 + 0.08 * (o.lower() in X.KNOWN_ORGANISATIONS) + 0.05 * (m.group(title).lower() in X.EXECUTIVE_TITLES)
            c += 0.03 * any(x in near for x in X.BUSINESS_WORDS) + 0.02 * any(x in near for x in X.NEWS_WORDS)
            compounds.append((f"{o} {m.group(title)}", "COMPOUND_TITLE", m.start(), m.end(), min(0.9, c)))
    for category, patterns in X.TITLES.items():
        for pattern in patterns:
            for m in re.finditer(pattern, text, re.IGNORECASE):
                near = low(m.start(), m.end())
                c = 0.7 + 0.1 * any(x in m.group().lower() for x in X.SPECIFIC_TITLES) + 0.15 * any(x in near for x in X.CATEGORY_WORDS.get(category, []))
                titles.append((m.group(), "TITLE", m.start(), m.end(), min(1.0, c)))
    places_ = "|".join(X.PLACES)
    for pattern, kind, c in ((rf"(?<!\w)(\w+)'s\s+(\w+)\s+({places_})", "COMPOUND_LOCATION", 0.85), (rf"(?<!\w)(\w+)\s+(\w+)\s+({places_})", "COMPOUND_LOCATION", 0.8), (rf"\b({places_})\b", "LOCATION_DESCRIPTOR", 0.75)):
        places += [(m.group(), kind, m.start(), m.end(), c) for m in re.finditer(pattern, text, re.IGNORECASE)]
    at = lambda s: s[2]
    titled = take(take([], sorted(compounds, key=at)), sorted(titles, key=at))
    places = take([], sorted(places, key=at))
    ner = sorted(mentions, key=lambda m: (m[2], -m[3], m[1], m[0]))
    every = sorted([*ner, *sorted(titled, key=at), *places], key=at)
    made, used = [], []
    for x, y in zip(every, every[1:], strict=False):
        first = x[0].strip().lower()
        if any(x is u for u in used) or not 0 <= y[2] - x[3] <= 10 or x[1] not in ("MISCELLANEOUS", "ORGANIZATION") or y[1] != "TITLE" or y[0].strip().lower() not in X.TITLE_WORDS:
            continue
        kind, boost = ("NATIONAL_TITLE", 0.15) if first in X.NATIONALITIES else ("DESCRIPTIVE_TITLE", 0.1) if first in X.DESCRIPTORS else ("ORGANIZATIONAL_TITLE", 0.12) if x[1] == "ORGANIZATION" else ("COMPOUND_TITLE", 0.05)
        made.append((f"{x[0]} {y[0]}", kind, x[2], y[3], min(0.9, (x[4] + y[4]) / 2 + boost)))
        used += [x, y]
    free = lambda s: not any(s is u for u in used)
    kept = take([], made)
    for group in ([t for t in titled if t[1] == "COMPOUND_TITLE"], [t for t in titled if t[1] == "TITLE" and free(t)], places, [m for m in ner if free(m)]):
        kept = take(kept, sorted(group, key=at))
    return sorted(((n, k, a, b, round(c, 6)) for n, k, a, b, c in kept if real(n, k)), key=lambda s: (s[2], s[3]))


def real(name, kind):
    n = name.strip()
    return len(n) > 1 and n not in X.PUNCTUATION and not (n.lower() in X.FALSE_POSITIVES and kind in ("PERSON", "ORGANIZATION"))


def mentions_of(text, r):
    found = [(m.group(), r.choice(["PERSON", "ORGANIZATION", "MISCELLANEOUS", "LOCATION"]), m.start(), m.end(), r.choice([0.5, 0.7, 0.95])) for m in re.finditer(r"[A-Za-z]+(?: [A-Z]\w+)?", text)]
    return [f for f in found if r.random() < 0.3]


def test_combine_equals_brute_force_on_random_texts():
    r = random.Random(9)
    kinds = set()
    for _ in range(2000):
        text = " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 40)))
        ner = mentions_of(text, r)
        got = [s[1:3] + s[4:6] + (round(s[6], 6),) for s in X.combine(text, [dict(zip(("name", "category", "start", "stop", "confidence"), m, strict=True)) for m in ner])]
        got = [s for s in got if real(*s[:2])]
        assert got == brute_force(text, ner), text
        kinds |= {s[1] for s in got}
    assert {"NATIONAL_TITLE", "DESCRIPTIVE_TITLE", "ORGANIZATIONAL_TITLE", "COMPOUND_TITLE", "TITLE", "COMPOUND_LOCATION", "LOCATION_DESCRIPTOR", "PERSON"} <= kinds


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_brute_force_on_every_article(spark):
    words = {r.surface.lower(): r.category for r in named(spark, SF).collect()}
    got: dict = {}
    for r in Q.hybrid_extraction(spark, SF).collect():
        got.setdefault(r.article_id, []).append((r.name, r.kind, r.start, r.stop, r.confidence))
    texts = {r.article_id: r.text for r in news(spark, SF).collect()}
    for i, text in texts.items():
        tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        ner = [(n, words[n.lower()], a, b, 0.5 + min(len(n), 20) / 50) for n, a, b in tokens if n.lower() in words]
        assert sorted(got.get(i, []), key=lambda s: (s[2], s[3])) == brute_force(text, ner), text
    assert len({k for v in got.values() for _, k, *_ in v}) >= 8


def test_a_long_article_and_odd_rows(spark):
    r = random.Random(3)
    long = " ".join(r.choice(WORDS) for _ in range(100_000))
    rows = spark.createDataFrame([(1, long, "own"), (2, None, "own"), (3, "", "own"), (None, "Acme CEO", "own"), (4, "x" * 100_000, "own"), (5, "president " * 20_000, "own")], "article_id int, text string, spans string")
    extractor = lambda a: X.gazetteer(a, spark.createDataFrame([("french", "MISCELLANEOUS"), ("ann lee", "PERSON")], "surface string, entity_id string")).select("article_id", "name", F.col("entity_id").alias("category"), F.col("position").alias("start"), (F.col("position") + F.length("name")).alias("stop"), F.lit(0.9).alias("confidence"))
    began = time.perf_counter()
    got = {i: n for i, n in X.extract(rows, extractor=extractor).select("article_id", F.size("spans")).collect()}
    assert time.perf_counter() - began < 60
    assert got[1] > 10_000 and got[2] in (0, -1) and got[3] == 0 and got[None] == 1 and got[5] == 20_000


def test_runs_of_words_leave_in_bounded_batches_and_no_join_runs_twice(spark, monkeypatch):
    from pyspark.sql import functions as F

    from watchloom.operators import spans as X

    monkeypatch.setattr(X, "RUNS", 100)
    text = "blue sky over Oslo " * 400
    articles = spark.createDataFrame([(i, text) for i in range(8)] + [(8, None), (9, ""), (None, "oslo")], "article_id long, text string").coalesce(1)
    surfaces = spark.createDataFrame([("Oslo", "o"), ("over Oslo blue", "b"), ("sky over", "s")], "surface string, entity_id string")
    got = X.gazetteer(articles, surfaces)
    assert {(r.article_id, r.entity_id): r["count"] for r in got.groupBy("article_id", "entity_id").count().collect()} == {(i, e): n for i in range(8) for e, n in (("o", 400), ("b", 399), ("s", 400))} | {(None, "o"): 1}
    assert got.where("article_id = 0").agg(F.min("position")).first()[0] == 5

    def extractor(a):
        return X.gazetteer(a, surfaces).select("article_id", "name", F.lit("LOCATION").alias("category"), F.col("position").alias("start"), (F.col("position") + 4).alias("stop"), F.lit(0.5).alias("confidence"))

    spark.sparkContext.setJobGroup("extract", "")
    X.extract(articles, extractor=extractor)
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("extract"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert after <= 2  # the word counts of the list are read, the join is not run


def test_runs_of_words_are_never_broadcast(spark, tmp_path, monkeypatch):
    """The articles' file is far smaller than its runs of words, and smaller than the list as Spark guesses it."""
    text = "blue sky over Oslo " * 40
    spark.createDataFrame([(i, text) for i in range(300)] + [(300, None), (None, "oslo")], "article_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/a")
    articles = spark.read.parquet(f"{tmp_path}/a")
    surfaces = spark.createDataFrame([("Oslo", "o"), ("over Oslo blue", "b"), ("sky over", None), (None, "n"), ("Oslo", "o2")], "surface string, entity_id string")

    def found():
        got = X.gazetteer(articles, surfaces)
        return got._jdf.queryExecution().executedPlan().toString(), sorted(map(str, got.collect()))

    plan, rows = found()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert len(rows) == 300 * (40 + 40 + 39 + 40) + 2
    monkeypatch.setattr(X, "LISTED", 0)
    plan, same = found()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and same == rows
    assert X.gazetteer(articles, surfaces.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_matches_each_article_once(spark):
    plan = Q.hybrid_extraction(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("ArrowEvalPython") == 1
