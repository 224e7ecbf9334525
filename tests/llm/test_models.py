"""The classifiers, the vector index and the pipeline: held-out accuracy, recall against brute force, defined cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.llm import ann, language_id, quality
from watchloom.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"
need_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@need_data
def test_language_id_on_held_out_documents(spark):
    out = QUERIES["op9_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id")
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert out.where("NOT held_out AND NOT score BETWEEN 0 AND 1").count() == 0 and out.count() == docs.count()


def test_language_id_defined_cases(spark):
    rows = [(i, f"the cat and the dog {i} went over there with words", "en") for i in range(30)] + [(100 + i, f"le chat et le chien {i} sont partis avec des mots", "fr") for i in range(30)]
    rows += [(200, None, "en"), (201, "12 !!", "fr"), (202, "", None), (None, "the dog over there", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit("own"))
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(got[i].lang_pred == "en" and not got[i].rejected for i in range(30)) and got[105].lang_pred == "fr"
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (200, 201, 202)) and got[None].lang_pred == "en"
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {200, 201, 202}
    assert language_id.fit(docs.where("lang IS NULL")) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.fit(docs)).count() == 0


@need_data
def test_quality_on_held_out_documents(spark):
    out = QUERIES["op2_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id")
    assert held.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.9


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "plain words", "s"), (3, "plain words", "s")], "doc_id long, text string, score string")
    got = quality.score(docs, quality.Model(None, 0.25)).collect()
    assert [r.score for r in got] == [0.25] * 4 and got[0].asDict().keys() == {"doc_id", "text", "score"}
    r = np.random.RandomState(0)
    bags = [r.standard_normal((1 + i % 4, 6)).astype(np.float32) for i in range(80)]
    for i, b in enumerate(bags):
        b[-1, 0] = 3 if i % 2 else -3  # one passage tells
    y = np.array([i % 2 for i in range(80)], np.float32)
    m = quality.train(bags, y)
    s = m.forward(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]))["s"]
    assert ((s > 0.5) == (y > 0.5)).mean() > 0.95
    rows = [(i, "good plain words here " * 5 if i % 2 else "### $$$ %%% 9 " * 5, i % 2) for i in range(60)] + [(60, None, None), (None, "x", 1)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    out = {r.doc_id: r.score for r in quality.score(docs.drop("score"), model).collect()}
    assert out[3] > 0.5 and all(0 <= v <= 1 for v in out.values())
    assert quality.score(docs.limit(0), model).count() == 0


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


def test_ann_recall_and_order(spark):
    r = np.random.RandomState(4)
    x = r.standard_normal((3000, 24)).astype(np.float32) * r.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    df = vectors(spark, x)
    got = {}
    for q, k, v, s in ann.search(df, df.where("vec_id % 20 = 0"), 10, bucket=200).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect():
        got.setdefault(q, []).append((v, s))
        assert k == len(got[q])
    ids = np.arange(len(x))
    want = ann.brute_force(ids, x.astype(float), ids[::20], 10)
    assert np.mean([len({v for v, _ in got[q]} & set(w)) / 10 for q, w in want.items()]) >= 0.9
    for q, found in got.items():
        assert q not in {v for v, _ in found} and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - float(x[q].astype(float) @ x[v].astype(float))) < 1e-9 for v, s in found)


def ann_recall(spark, x, k=10, bucket=100):
    """Share of its k nearest that each of 200 queries finds."""
    df, ids = vectors(spark, x), np.arange(len(x))
    got = {}
    for r in ann.search(df, df.where(f"vec_id % {len(x) // 200} = 0"), k, bucket=bucket).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = ann.brute_force(ids, x.astype(np.float32).astype(float), ids[:: len(x) // 200], k)
    return {q: len(got.get(q, set()) & set(w)) / k for q, w in want.items()}


def test_ann_recall_beside_groups_of_near_copies(spark):
    r = np.random.RandomState(3)
    x = r.standard_normal((8000, 32))
    x[:4800] = np.repeat(x[:48], 100, axis=0) + 0.002 * r.standard_normal((4800, 32))
    recall = ann_recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.mean(list(recall.values())) >= 0.9 and np.mean([v for q, v in recall.items() if q >= 4800]) >= 0.9


def test_ann_recall_beside_one_long_vector(spark):
    x = np.random.RandomState(3).standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 50
    assert np.mean(list(ann_recall(spark, x, bucket=200).values())) >= 0.9


def test_ann_compares_all_where_the_sample_gives_no_bound(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 3)
    x = np.random.RandomState(5).standard_normal((400, 8)) * 2.0 ** np.arange(-2, 2).repeat(100)[:, None]
    df = vectors(spark, x)
    found = ann.search(df, df.where("vec_id % 100 = 0"), 20, bucket=20).collect()
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in range(0, 400, 100)}
    assert got == ann.brute_force(np.arange(400), x.astype(np.float32).astype(float), np.arange(0, 400, 100), 20)


def test_ann_copies_and_odd_vectors(spark):
    x = np.tile(np.array([[1.0, 2.0, 2.0]]), (6000, 1))
    df = vectors(spark, x)
    odd = spark.createDataFrame([(-1, None), (-2, [0.0, 0.0, 0.0]), (-3, [1.0, None, 1.0]), (-4, [1.0, float("nan"), 1.0]), (-5, [float("inf"), 1.0, 1.0]), (-6, []), (None, [1.0, 1.0, 1.0]), (-7, [1.0])], "vec_id long, embedding array<float>")
    found = ann.search(df.unionByName(odd).unionByName(df.limit(5)), df.where("vec_id IN (0, 4000)"), 5).collect()
    got = {(r.query_id, r.rank): r.vec_id for r in found}
    assert got == {(0, i + 1): i + 1 for i in range(5)} | {(4000, i + 1): i for i in range(5)}
    few = vectors(spark, x[:3])
    assert ann.search(few, few, 20).count() == 6
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_ann_puts_out_what_reaches_a_query_s_bound():
    import pyarrow as pa

    x = np.random.RandomState(2).standard_normal((600, 8))
    held = pa.table({"b": np.arange(600) % 3, "vec_id": np.arange(600), "v": x.tolist()})
    inf = float("inf")
    asked = pa.table({"query_id": [0, 1, 2, 3], "qv": x[:4].tolist(), "least": [5.0, -inf, 1e9, 2.0], "bs": [[0, 2], [1, 7], [0, 1, 2], [9]]})
    got = ann.rank(asked, held, 4).to_pylist()
    s = x @ x.T
    for q, bs, least in ((0, (0, 2), 5.0), (1, (1,), -inf)):
        want = sorted((-s[q, i], i) for i in range(600) if i != q and i % 3 in bs and s[q, i] >= least)[:4]
        assert want and [r["id"] for r in got if r["query_id"] == q] == [i for _, i in want]
    assert {r["query_id"] for r in got} == {0, 1}


def test_quality_moves_no_texts(spark, tmp_path, monkeypatch):
    """The few labelled rows go to the texts, however large the tables are."""
    spark.range(60).selectExpr("id AS doc_id", "concat('some words ', id) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(60).selectExpr("id AS doc_id", "id % 2 AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows) or quality.Model(None, 0.5))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality.query(spark, str(tmp_path)).count() == 60
        assert seen[0].count() == seen[0].select("doc_id").distinct().count() > 0
        assert "BroadcastHashJoin" in seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@need_data
@pytest.mark.parametrize("name", list(SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    from tests.test_queries import rows_of, views

    con = views(duckdb.connect(), "/root/testdata/sf0.001")
    rel = con.sql(SQL[name])
    want = rows_of(rel.fetchall(), rel.columns, rel.columns)
    df = QUERIES[name](spark, "/root/testdata/sf0.001").select(*rel.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns, rel.columns) == want


@need_data
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        docs = out.persist()
        assert 0.5 * n < docs.count() <= n
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


ODD = [
    (1, "the cat and the dog went over there", "en", "s", 36), (1, "the cat and the dog went over there", "en", "s", 36), (1, "another text of the same id", "en", None, None),
    (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a text without an id", "en", "s", 20), (None, None, None, None, None), (4, "\n \n", None, "s", 3),
    (5, "one very long text of words " * 20_000, "en", "s", None), (6, "!!! 12", "en", "s", 6), *[(10 + i, f"short text number {i}", "en", "s", 20) for i in range(10)],
]


@need_data
@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows_and_clashing_columns(spark, rows):
    import corpus_pipeline

    clash = [(*r, "own", ["own"], 7) for r in rows]
    docs = spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans array<string>, component_id long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert len(kept) <= len(rows) and all(r.n_words == "own" and r.component_id == 7 for r in kept)
        if rows and name != "language_id":
            assert {10 + i for i in range(10)} <= {r.doc_id for r in kept}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} and all(r.length == len(r.ids) for r in packed)


def test_models_on_long_and_repeated_texts(spark):
    rows = [(i, f"the cat and the dog {i} went over there with words", "en") for i in range(30)] + [(100 + i, f"le chat et le chien {i} sont partis avec des mots", "fr") for i in range(30)]
    rows += [(300, "the dog went over there with words " * 30_000, "en")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).where("doc_id = 300").collect()]
    assert len(got) == 2 and got[0] == got[1] and got[0][0] == "en"
    scored = [r.score for r in quality.score(docs, quality.Model(None, 0.25)).where("doc_id = 300").collect()]
    assert len(scored) == 2 and scored[0] == scored[1]


def test_ann_takes_the_commonest_length_of_the_queries(spark):
    x = np.random.RandomState(2).standard_normal((60, 4))
    df = vectors(spark, x).unionByName(vectors(spark, x[:2, :2], [900, 901]))
    assert {r.query_id for r in ann.search(df, df.where("vec_id IN (0, 20, 900)"), 3).collect()} == {0, 20}


def test_few_vectors_are_hashed_too():
    r = np.random.RandomState(0)
    for n in (200, 500, 2000):
        x = r.standard_normal((n, 16))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        h = ann.Hashing.fit([(0, n, 1.0, 1.0, 1.0)], np.arange(n), x, 6, 2048, 0.36)
        keys = np.concatenate([k for _, _, k in h.buckets(np.zeros(n, int), x)])
        assert keys.shape == (n, 6) and all(len(np.unique(keys[:, t])) > 1 for t in range(6))
