"""Ranks by prefix sums and the judge chain on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.operators import groups as G
from watchloom.operators import judge as J
from watchloom.operators import judge_chain as H
from watchloom.operators import metrics as M
from watchloom.operators.ranks import ranked

SCHEMA = "query string, candidate string, context string, score double"
LONG = "x" * 100


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ranked_equals_windows_with_a_hot_key_nulls_and_ties(spark):
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") % 4).cast("string"))
    rows = spark.range(3000).select(key.alias("k"), "id", F.when(F.col("id") % 7 > 0, F.col("id") % 17).alias("v"))
    w = Window.partitionBy("k").orderBy(F.col("id").desc())
    want = rows.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    got = ranked(rows, ["k"], [F.col("id").desc()], sums={"s": "v"}, parts=7)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert [r["rank"] for r in ranked(rows, [], [F.col("id").asc()]).orderBy("id").collect()] == list(range(1, 3001))
    ties = ranked(spark.range(50).select(F.lit(1).alias("k"), F.lit(0).alias("o")), ["k"], [F.col("o")])
    assert sorted(r["rank"] for r in ties.collect()) == list(range(1, 51))
    assert ranked(rows.limit(0), ["k"], [F.col("id")]).collect() == []


def good(confidence=0.9, **more):
    return {"confidence": confidence, "match_type": "exact", "reasoning": "long enough a reason", **more}


def test_whole_contexts_and_case_tell_pairs_apart(spark):
    rows = [("A", "B", f"{LONG}one", 0.1), ("A", "B", f"{LONG}two", 0.1), ("a", "B", f"{LONG}one", 0.1), ("A", "B", f"{LONG}one", 0.4), ("A", "B", None, 0.1), ("A", "B", "", 0.1)]
    judge = H.Judge("j", lambda part: [good(0.9 if p["context"].endswith("one") else 0.3) for p in part], 2)
    out, attempts = H.judged(frame(spark, rows), [judge])
    got = {(r["query"], r.context): r.confidence for r in out.collect()}
    assert out.count() == 6 and got[("A", f"{LONG}one")] == 0.9 and got[("A", f"{LONG}two")] == 0.3 and got[("A", None)] == 0.3
    assert attempts.agg(F.sum("pairs")).first()[0] == 4  # null and empty contexts are one, the repeated pair another
    judged = J.with_judge(frame(spark, rows), J.batched(lambda part: [good(0.9 if p["context"] and p["context"].endswith("one") else 0.3) for p in part], 3))
    assert {(r["query"], r.context): r.confidence for r in judged.collect()}[("A", f"{LONG}two")] == 0.3


def test_only_a_failed_call_is_retried_and_the_next_judge_gets_what_is_open(spark):
    rows = [(str(i), "c", "", 0.95 if i == 3 else 0.01) for i in range(6)]

    def first(part):
        if any(p["query"] == "0" for p in part):
            raise TimeoutError
        return [good(1.5) if p["query"] in "13" else good(float("nan")) if p["query"] == "2" else good() for p in part]

    def second(part):
        return [good(0.2, is_match=True) for _ in part][: 0 if part[0]["query"] == "3" else None]

    results, attempts = H.run(frame(spark, rows), [H.Judge("first", first, 100), H.Judge("second", second, 1)])
    pairs = {r.pair_id: r["query"] for r in frame(spark, rows).withColumn("pair_id", H.pair_id()).collect()}
    got = {pairs[r.pair_id]: (r.source, r.confidence, r.is_match) for r in results.collect()}
    assert got == {"0": ("second", 0.2, True), "1": ("second", 0.2, True), "2": ("second", 0.2, True), "3": ("score", 0.95, True), "4": ("first", 0.9, True), "5": ("first", 0.9, True)}
    a = {r.judge: r.asDict() for r in H.accounts(attempts).collect()}
    assert (a["first"]["calls"], a["first"]["retries"], a["first"]["failed"], a["first"]["pairs"]) == (7, 6, 2, 12)
    assert (a["second"]["calls"], a["second"]["retries"], a["second"]["failed"]) == (4, 0, 0)


def test_no_judges_no_pairs_and_answers_that_are_none(spark):
    results, attempts = H.run(frame(spark, [("a", "b", None, 1.7), ("c", "d", None, None)]), [])
    assert sorted((r.confidence, r.is_match, r.match_type) for r in results.collect()) == [(0.0, False, "unlikely"), (1.0, True, "exact")] and attempts.count() == 0
    results, attempts = H.run(frame(spark, []), [H.Judge("j", lambda part: [good() for _ in part])])
    assert results.count() == 0 and attempts.count() == 0
    for odd in (None, "text", [None], [{"confidence": True}], [{"confidence": 0.5, "match_type": "no such type", "reasoning": "long enough a reason"}]):
        results, _ = H.run(frame(spark, [("a", "b", None, 0.2)]), [H.Judge("j", lambda part, odd=odd: odd)])
        assert [r.source for r in results.collect()] == ["score"]


@pytest.mark.parametrize("result, ok", [(good(), True), (good(0), True), (good(1.2), False), (good("0.5"), False), (good(True), False), (good(float("nan")), False), (good(reasoning="short"), False), ({}, False), (None, False)])
def test_contract(result, ok):
    assert J.keeps_contract(result) is ok


def plain_groups(names, above):
    """Each name against the first names of all groups, in order, by the whole distance table."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    leaders, out = [], []
    for n in names:
        hit = [i for i, l in enumerate(leaders) if l == n or (max(len(l), len(n)) and 1 - edits(l, n) / max(len(l), len(n)) > above)]
        out.append(hit[0] if hit else len(leaders))
        leaders += [] if hit else [n]
    return out


@given(st.lists(st.text("ab", max_size=12), max_size=25), st.sampled_from([0.5, 0.7, 0.8, 0.95]))
@settings(max_examples=200, deadline=None)
def test_leaders_are_the_first_alike(names, above):
    held = G.Leaders(above)
    assert [held.group(n) for n in names] == plain_groups(names, above)


def test_groups_differ_from_equal_names_and_lists_stay_apart(spark):
    long = "the very long name of some limited company"
    rows = [("a", long, "text", 1.0, 0), ("a", f"{long}s", "vector", 2.0, 1), ("a", long.upper(), "text", 2.0, 2), ("a", "other", "text", 0.5, 3), ("b", f"{long}s", "text", 1.0, 0), (None, None, "text", 0.1, 0)]
    results = spark.createDataFrame(rows, "request string, name string, method string, score double, place int")
    queries = spark.createDataFrame([("a", "other"), ("a", long), ("b", "x")], "request string, query string")
    got = {(r.request, r.name): (r.duplicate_count, r.methods, r["rank"]) for r in G.dedup_and_rank(results, queries, "request").collect()}
    assert got == {("a", f"{long}s"): (3, ["text", "vector"], 1), ("a", "other"): (1, ["text"], 2), ("b", f"{long}s"): (1, ["text"], 1), (None, None): (1, ["text"], 1)}
    assert G.dedup_and_rank(results.limit(0), queries, "request").count() == 0


def test_a_prediction_counts_for_each_label_of_its_article(spark):
    gold = spark.createDataFrame([(1, "n", "e", "x"), (1, "m", "f", "y"), (2, "n", "e", "x"), (3, "k", "g", "z")], "article_id int, name string, entity string, label string")
    predicted = spark.createDataFrame([(1, "n", "e"), (1, "n", "wrong"), (1, "n", "wrong"), (2, "n", "e"), (9, "n", "e"), (1, None, "e")], "article_id int, name string, entity string")
    got = {r.label: (r.articles, r.gold, r.pred_in_articles, r.tp, r.fp, r.fn) for r in M.prf1_by_challenge(gold, predicted).collect()}
    assert got == {"x": (2, 2, 3, 2, 1, 0), "y": (1, 1, 2, 0, 2, 1), "z": (1, 1, 0, 0, 0, 1)}
