"""Operators on small fixtures: functions, spans, cascades with a hybrid stage, judges, sources, stages, streams."""

import datetime
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom.functions import text as T
from watchloom.operators import candidates as C
from watchloom.operators import judge as J
from watchloom.operators import metrics as M
from watchloom.operators import search as S
from watchloom.operators import spans as X
from watchloom.operators import watchlist as W
from watchloom.sources import tables as R
from watchloom.streaming import alerts

ENTITIES = [
    ("a_001", "Ann Lee", "person", ["A. Lee", "Dr. Lee"], "high", "a surgeon in Oslo", None),
    ("b_001", "Acme Corp", "organization", ["Acme", "ACME"], None, "", "Acme makes anvils"),
    ("c_001", "Ann Lee", "person", ["Annie Lee"], "low", "a singer", None),
]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "entity_id string, name string, entity_type string, aliases array<string>, priority string, description string, explicit_context string")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def spans_of(spark, text, f):
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(f(F.col("text"))).alias("s")).select("s.*").collect()
    return [(r["name"], r["start"], r["stop"]) for r in rows]


def test_matches_have_python_s_offsets(spark):
    import re

    for text in ("the CEO, the ceo and Été CEO", "no match", "ceo", "xx ceo"):
        want = [(m.group(), m.start(), m.end()) for m in re.finditer(r"(?i)\bceo\b", text)]
        assert spans_of(spark, text, lambda c: X.matches(c, r"(?i)\bceo\b")) == want


def test_compounds_keep_case_and_whole_words(spark):
    get = lambda t: [s[0] for s in spans_of(spark, t, X.compounds)]
    assert get("Amazon CEO spoke") == ["Amazon CEO"]  # "on" inside a word is no connective
    assert get("CEO of Intel Group") == ["Intel CEO"]
    assert get("The CEO, his President") == []
    assert get("Microsoft CEO") == ["Microsoft CEO"]


def test_extraction_leaves_no_overlap(spark):
    text = "Yesterday the vice president of Austria met Acme CEO at Acme's Oslo headquarters near the regional center."
    rows = X.extract(spark.createDataFrame([(1, text)], "article_id int, text string")).select(F.explode("spans").alias("s")).select("s.*").collect()
    assert len(rows) >= 4
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.stop <= b.start
    assert all(text[r.start : r.stop] == r["name"] or r.kind in X.COMPOUND_KINDS for r in rows)


def test_surfaces_and_namesakes(spark, entities):
    s = {r.surface: (r.kind, r.entity_id) for r in W.surfaces(entities).collect()}
    assert s["Ann Lee"] == ("name", "a_001") and s["Acme"] == ("alias", "b_001") and len(s) == 7
    assert W.add(entities.withColumn("o", F.monotonically_increasing_id()), "o").count() == 3  # namesakes with other descriptions stay
    assert {r.entity_id: r.source for r in W.enrich(entities).collect()} == {"a_001": "Entity Data", "b_001": "Explicit Context", "c_001": "Entity Data"}


def test_cascade_uses_each_stage_only_for_what_is_open(spark, entities):
    m = spark.createDataFrame([(1, "Ann Lee"), (2, "Acme"), (3, "Anne Lee"), (4, "zzz")], "mention_id int, name string")

    def hybrid(names):
        assert {r.name for r in names.collect()} == {"Anne Lee", "zzz"}
        return names.where("name <> 'zzz'").crossJoin(entities.select("entity_id")).withColumn("score", F.when(F.col("entity_id") == "b_001", 0.01).otherwise(0.05))

    got = sorted((r.mention_id, r.match_type, r.entity_id) for r in C.cascade(m, entities, hybrid).collect())
    assert got == [(1, "exact", "a_001"), (2, "alias", "b_001"), (3, "hybrid", "a_001"), (3, "hybrid", "c_001")]


def test_containment_finds_names_inside_words_and_short_ones(spark):
    a = spark.createDataFrame([(1, "a cold bolt"), (2, "ab"), (3, "")], "article_id int, text string")
    e = spark.createDataFrame([("x", "old bolt"), ("y", "b"), ("z", "ab c")], "entity_id string, name string")
    assert sorted((r.article_id, r.entity_id) for r in C.contained(a, e).collect()) == [(1, "x"), (1, "y"), (2, "y")]


def test_bm25_prefers_rare_terms_and_fusion_is_monotone(spark):
    d = spark.createDataFrame([(1, "rare common"), (2, "common common"), (3, "common")], "d int, t string")
    q = spark.createDataFrame([(9, "rare common")], "q int, t string")
    top = S.top(S.bm25(q, d, "q", "t", "d", "t"), 3).orderBy("rank").collect()
    assert top[0].doc == 1
    fused = S.fuse([S.top(S.bm25(q, d, "q", "t", "d", "t"), 50)], 3).orderBy("rank").collect()
    assert [r.doc for r in fused] == [r.doc for r in top] and abs(fused[0].score - 1 / 21) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.text("abc ", max_size=8), st.text("abc ", max_size=8))
def test_similarities_are_symmetric_and_bounded(spark, a, b):
    x, y = F.lit(a), F.lit(b)
    r = one(spark, T.edit_similarity(x, y), T.edit_similarity(y, x), T.jaccard(x, y), T.jaccard(y, x))
    assert r[0] == r[1] and r[2] == r[3] and 0 <= r[0] <= 1 and 0 <= r[2] <= 1


def test_rules_of_the_judge(spark):
    cases = [
        ("Acme", "Acme Inc", "", "exact"), ("Lee Ann", "Ann Lee", "", "out_of_order"), ("A. Lee", "Ann Lee", "", "initial"), ("Bob Marley", "Robert Marley", "", "nickname"),
        ("Martin King", "Martin Luther King", "", "missing_components"), ("Tolstoy", "Leo Tolstoy", "", "partial_last"), ("Jon Smyth", "John Smith", "", "phonetic"),
        ("José Peña", "Jose Pena", "", "cultural"), ("the president", "Acme", "the president of Acme", "title_role"), ("x", "y", None, "unlikely"), ("", "y", None, "unlikely"),
    ]
    pairs = spark.createDataFrame([c[:3] for c in cases], "query string, candidate string, context string")
    got = {(r["query"], r.candidate): r.match_type for r in J.with_judge(pairs, J.rule_judge).collect()}
    assert got == {(q, c): t for q, c, _, t in cases}
    assert set(got.values()) <= set(J.MATCH_TYPES)


def test_answers_of_models_are_read_by_the_contract(spark):
    good = {"confidence": 0.9, "is_match": True, "match_type": "exact", "reasoning": "the same name twice"}
    rows = [(1, "x " + json.dumps([good, good | {"match_type": "odd"}]) + " y", 2), (2, json.dumps([good]), 2), (3, json.dumps(good), 1), (4, None, 1)]
    got = {(r.b, r.position): (r.ok, r.match_type) for r in J.parse_answers(spark.createDataFrame(rows, "b int, answer string, n_pairs int"), "b").withColumn("ok", F.col("is_match")).collect()}
    assert got == {(1, 0): (True, "exact"), (1, 1): (False, "unlikely"), (2, 0): (False, "error"), (2, 1): (False, "error"), (3, 0): (False, "error"), (4, 0): (False, "error")}


def test_batched_judges_are_joined_by_pair_and_survive_failures(spark):
    pairs = spark.createDataFrame([("a", "b", ""), ("a", "b", ""), ("bad", "b", "")], "query string, candidate string, context string")

    def call(batch):
        if any(p["query"] == "bad" for p in batch):
            raise RuntimeError("no service")
        return [{"confidence": 0.7, "is_match": True, "match_type": "semantic", "reasoning": "close enough to it"} for _ in batch]

    got = sorted((r["query"], r.confidence) for r in J.with_judge(pairs, J.batched(call, 1)).collect())
    assert got == [("a", 0.7), ("a", 0.7), ("bad", 0.0)]


def test_true_positives_and_misses_add_up_to_gold(spark):
    g = spark.createDataFrame([(i, f"e{i % 3}") for i in range(9)], "mention_id int, entity string")
    p = spark.createDataFrame([(0, "e0"), (1, "e0"), (2, "e2")], "mention_id int, entity string")
    r = M.prf1_pairs(g, p, ["mention_id", "entity"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 7) and r.tp + r.fn == 9
    r = M.prf1_mention(g, p).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 6)


def test_json_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"entities": [{"name": "Ann", "aliases": ["A"]}, {"name": "Bo", "context": "c", "priority": "high"}], "enrichment": {"enabled": True}}))
    e = {r["name"]: r for r in R.entities_json(spark, str(tmp_path / "e.json")).collect()}
    assert e["Ann"].priority == "medium" and e["Ann"].entity_type == "person" and e["Bo"].explicit_context == "c"
    art = [{"id": "1", "title": "t", "content": "c", "expected_matches": [{"extracted_entity": "A", "watch_list_entity": "Ann", "match_type": "nickname"}, {"mention": "x", "entity_name": ""}], "category": "k"}, {"title": "t2", "content": "c2"}]
    (tmp_path / "a.json").write_text(json.dumps(art))
    a = R.articles_json(spark, str(tmp_path / "a.json"))
    assert a.count() == 2 and a.where("id LIKE 'article_%'").count() == 1
    assert sorted((r.mention, r.entity, r.expects_match, r.label) for r in R.gold(a).collect()) == [("A", "Ann", True, "k"), ("x", "", False, "k")]
    (tmp_path / "g.json").write_text(json.dumps({"golden_standard": {"1": {"A": "Ann"}}}))
    assert [tuple(r) for r in R.golden_json(spark, str(tmp_path / "g.json")).collect()] == [("1", "A", "Ann")]


def test_stages_exports_and_guards(spark, tmp_path, entities):
    clock = iter(datetime.datetime(2024, 1, d) for d in (1, 2, 3))
    s = R.Stages(spark, str(tmp_path / "state"), lambda: next(clock))
    s.save("prepare", entities)
    s.save("match", entities.limit(1))
    s.save("prepare", entities.limit(2))
    assert [(r.stage, r.n_rows) for r in s.manifest().collect()] == [("prepare", 2), ("match", 1)]
    assert [r.stage for r in s.missing(["prepare", "process"]).collect()] == ["process"]
    R.export(entities, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    with pytest.raises(ValueError):
        R.export(entities, str(tmp_path / "x"), "xls")
    good, bad = R.guarded(entities, {"priority": F.col("priority").isNotNull()})
    assert good.count() == 2 and [r._error for r in bad.collect()] == ["priority"]
    base = {"a": {"b": 1, "c": 2}}
    assert R.merge_config(base, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and base["a"]["b"] == 1


def test_streams_give_the_batch_rows(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)] + [(99, start + datetime.timedelta(days=2), 1, "view", 0.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, f, mode in (("counts", alerts.tumbling_counts, "complete"), ("alerts", alerts.dedup_alerts, "append")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(events).collect()))
    seen = []
    mentions = stream.select("event_id", F.col("event_type").alias("name"))
    surfaces = spark.createDataFrame([("click", "e1")], "surface string, entity_id string")
    q = alerts.match_stream(mentions, surfaces, lambda df, i: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(seen) == 30


def test_exact_candidates_are_a_plain_equi_join(spark, entities):
    m = spark.createDataFrame([(1, "Ann Lee")], "mention_id int, name string")
    plan = C.exact(m, entities)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_text_pairs_hold_every_pair_with_a_score(spark):
    words = ["", "!!", "b", "ab", "abc", "ABCD", "abxd", "acme corp", "acme", "me co", "acne corp", "acme corp inc", "corp, acme", "Dr. Ann Lee", "Ann Lee", "an lee", "ann leex", "xann lee", "anm leee", "ünal şen", "unal sen", "Ünal Şenx", "rp"]
    q = spark.createDataFrame([(w,) for w in words], "query string")
    n = spark.createDataFrame([(f"d{i}", w) for i, w in enumerate(words)], "doc string, name string")
    scored = lambda p: {tuple(r) for r in p.where(S.text_score(F.col("query"), F.col("name")) > 0).select("query", "doc").collect()}
    assert scored(S.text_pairs(q, n)) == scored(q.crossJoin(n)) and S.text_pairs(q, n).count() < q.count() * n.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_enhanced_text_search_meets_every_entity(spark):
    from watchloom.plans import fixtures, queries

    sf = "/root/testdata/sf0.001"
    q = fixtures.mentions(spark, sf).select(F.col("name").alias("query")).distinct()
    p = q.crossJoin(fixtures.entities(spark, sf).select(F.col("entity_id").alias("doc"), "name"))
    want = {tuple(r) for r in p.where(S.text_score(F.col("query"), F.col("name")) > 0).select("query", "doc").collect()}
    got = queries.enhanced_text_search(spark, sf).select("query", "doc").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_slug_ids_of_more_than_999_rows(spark, tmp_path):
    from watchloom.plans import queries

    spark.range(1, 1206).selectExpr("id AS p_partkey", "IF(id <= 1200, 'BIG-RED BOX', 'x') AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.part: r.entity_id for r in queries.watch_list_slug_ids(spark, str(tmp_path)).collect()}
    assert len(got) == 1205 and (got[999], got[1000], got[1200], got[1205]) == ("big_red_box_999", "big_red_box_1000", "big_red_box_1200", "x_005")


def test_gazetteer_finds_names_of_many_words(spark):
    articles = spark.createDataFrame([(1, "The EUROPEAN Central Bank, and Acme; the Trust of the Lake-Side Towns. European Central"), (2, None), (3, "")], "article_id int, text string")
    surfaces = spark.createDataFrame([("European Central Bank", "a"), ("trust of the lake-side towns", "b"), ("Acme", "c"), ("central bank", "d"), ("?", "e"), (None, "f")], "surface string, entity_id string")
    got = sorted((r.article_id, r.position, r.name, r.entity_id) for r in X.gazetteer(articles, surfaces).collect())
    assert got == [(1, 4, "EUROPEAN Central Bank", "a"), (1, 13, "Central Bank", "d"), (1, 31, "Acme", "c"), (1, 41, "Trust of the Lake-Side Towns", "b")]
    assert X.gazetteer(articles, surfaces.limit(0)).count() == 0


def test_default_encoder_counts_hashed_trigrams(spark):
    from watchloom.operators import enrich as E

    rows = spark.createDataFrame([("Mara Ellison",), ("x",), ("Mara Ellison",)], "name string")
    out = E.with_embeddings(rows, "name").collect()
    assert out[0].vector == out[2].vector and all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 and len(r.vector) == 64 for r in out)


def test_sample_list_finds_its_names(spark):
    from watchloom.registry import QUERIES

    got = {(r.article_id, r.entity_id) for r in QUERIES["sample_matches"](spark, "/root/testdata/sf0.001").collect()}
    want = {("s1", "mara_ellison"), ("s1", "port_alder"), ("s1", "northlight_shipping"), ("s2", "bluefern_labs"), ("s3", "irina_sokolova"), ("s4", "marsh_fever"), ("s4", "port_alder"), ("s5", "port_alder"), ("s5", "northlight_shipping")}
    assert want <= got


def test_drop_and_reset(spark, tmp_path):
    from watchloom.sources.tables import drop_table, reset

    spark.range(3).write.parquet(str(tmp_path / "a"))
    assert drop_table(spark, f"file://{tmp_path}/a") and not drop_table(spark, f"file://{tmp_path}/a")
    spark.range(3).write.parquet(str(tmp_path / "b"))
    assert reset(spark, f"file://{tmp_path}", ["a", "b"]) == ["b"]


def test_schemas_of_the_judges_agree():
    from watchloom.operators import judge as J
    from watchloom.operators import report as R

    one = {"match_type": J.MATCH_TYPES, "is_match": ["false", "true"]}
    assert R.consistent(one, {"match_type": set(J.MATCH_TYPES), "is_match": {"true", "false"}})
    assert not R.consistent(one, {"match_type": J.MATCH_TYPES[1:], "is_match": ["false", "true"]})


def test_foreign_providers_run_on_batches(spark):
    from watchloom.operators import enrich as E

    names = spark.createDataFrame([("a b",), ("c",)], "name string")
    asked = lambda df: E.foreign(df, lambda p: p.assign(title=p["name"] + " page", context="about " + p["name"], language="en", source="service"), E.CONTEXTS)
    rows = E.alternatives(E.disambiguated(asked(names))).collect()
    assert {(r.name, r.title, round(r.confidence, 3)) for r in rows} == {("a b", "a b page", 0.8), ("c", "c page", 0.8)}


def test_no_search_plan_holds_a_cartesian_product(spark):
    from watchloom.registry import QUERIES

    for name in ("cosine_topk", "knn_filtered", "rrf_hybrid_top2", "vector_dedup", "containment_join", "candidate_fuzzy", "candidate_phonetic", "fuzzy_search", "text_search", "search_mode_union"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_stages_keep_a_backup_and_know_their_version(spark, tmp_path):
    stages = R.Stages(spark, str(tmp_path / "st"))
    assert not stages.valid("a")
    stages.save("a", spark.range(3))
    stages.save("a", stages.load("a").where("id > 0"))
    assert stages.load("a").count() == 2 and stages.load("a", backup=True).count() == 3
    assert stages.valid("a") and not stages.valid("a", "0") and not stages.valid("b")


def test_config_from_files_and_variables(tmp_path):
    base = {"a": {"x": 1, "y": 2}, "b": 3}
    (tmp_path / "c.json").write_text(json.dumps({"a": {"x": 5}, "c": [1]}))
    got = R.load_config(str(tmp_path / "c.json"), base, {"KEY": "k", "NONE": ""}, {"KEY": ["a", "key"], "NONE": ["b"]})
    assert got == {"a": {"x": 5, "y": 2, "key": "k"}, "b": 3, "c": [1]} and base == {"a": {"x": 1, "y": 2}, "b": 3}
    assert R.load_config(str(tmp_path / "none.json"), base) == base == R.load_config(None, base)
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a:\n  y: 7\n")
    assert R.load_config(str(tmp_path / "c.yaml"), base)["a"] == {"x": 1, "y": 7}


def test_analysed_tokens_fold_and_drop_stop_words(spark):
    rows = spark.createDataFrame([("The Café of Łódź, Straße and Ænima",), ("Йод και ψωμί",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(T.analysed("t")).collect()]
    assert got == [["cafe", "lodz", "strasse", "aenima"], ["йод", "και", "ψωμί"], [], None]


def test_cosine_fallback_equals_brute_force(spark):
    import numpy as np

    rng = np.random.RandomState(5)
    vec = rng.randn(60, 4)
    vec[7] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)], "id long, vector array<double>")
    hits = {(int(q), int(d)): float(rng.rand() * 2) for q in (0, 20, 40) for d in rng.choice(60, 9, replace=False) if d != q}
    h = spark.createDataFrame([(*k, s) for k, s in hits.items()] + [(0, 0, 9.0), (0, 999, 9.0)], "query long, doc long, score double")
    got = {}
    for r in S.cosine_fallback(v.where("id IN (0, 20, 40)"), v, h, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["doc"])
    for q in (0, 20, 40):
        norm = np.linalg.norm(vec, axis=1) * np.linalg.norm(vec[q])
        s = np.divide(vec @ vec[q], norm, out=np.zeros(60), where=norm > 0) + 1 + np.array([hits.get((q, d), 0.0) for d in range(60)])
        order = [int(d) for d in np.lexsort((np.arange(60), -s.round(9))) if d != q]
        assert got[q] == order[:5]


def test_compound_needs_a_word_or_the_end_behind(spark):
    get = lambda t: [s[0] for s in spans_of(spark, t, X.compounds)]
    assert get("CEO of Acme, who left") == [] and get("Meet the CEO of Acme") == ["Acme CEO"] == get("CEO of Acme who left")


def test_equal_texts_are_searched_for_names_once(spark, monkeypatch):
    texts = ["a blue bolt", "a blue bolt", None, "", "x"] * 40 + ["bolt blue", "Üx blue bolts"]
    articles = spark.createDataFrame(list(enumerate(texts)) + [(None, "a blue bolt")], "article_id int, text string")
    names = ["blue bolt", "bolt", "x", "", None, "blue b"]
    entities = spark.createDataFrame([(n, str(i)) for i, n in enumerate(names)], "name string, entity_id string")
    seen, inner = [], C._contained
    monkeypatch.setattr(C, "_contained", lambda a, e: seen.append(a.count()) or inner(a, e))
    got = sorted(map(tuple, C.contained(articles, entities).collect()), key=repr)
    want = [(i, str(j)) for i, t in [*enumerate(texts), (None, "a blue bolt")] for j, n in enumerate(names) if t and n and n in t]
    assert got == sorted(want, key=repr) and seen == [5]


def test_nearest_moves_vectors_in_their_own_type_and_scores_in_double(spark):
    import numpy as np

    vec = np.random.RandomState(3).randn(50, 8).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)], "id long, vector array<float>")
    near = S.nearest(v.where("id < 3"), v, 4)
    assert "array<double>" not in near._jdf.queryExecution().executedPlan().toString()
    wide = v.withColumn("vector", F.col("vector").cast("array<double>"))
    key = lambda r: (r["query"], r["rank"], r.doc, r.score)
    assert sorted(map(key, near.collect())) == sorted(map(key, S.nearest(wide.where("id < 3"), wide, 4).collect()))
