"""Importance resampling and its blocks of words against brute force."""

import duckdb
import pytest

from tests.llm.test_text_operators import ROWS
from tests.test_queries import SF, rows_of, views
from watchloom.llm import importance, word_blocks
from watchloom.llm.kernel import ALNUM
from watchloom.llm.store import Store

TARGET = ["the of the lorem", None, "", "dolor AB c3 été Straße", "w1 w2 w3 w1"]
MORE = [(None, "the of lorem ipsum " * 8), (None, None), (1, "the same id with another text " * 6), (2, ROWS[1][1]), (30, "Ünder-score_d 日本 x" * 20)]
DOCS = [*ROWS, *MORE]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "own", "kept") for i, t in rows], "doc_id long, text string, Score string, lang string")


def aims(spark, rows=TARGET):
    return spark.createDataFrame([(t,) for t in rows], "text string")


@pytest.mark.parametrize("size", [1 << 23, 700])
@pytest.mark.parametrize("how", [{}, {"order": 3, "buckets": 37, "seed": 5, "percent": 40, "least": 3}, {"percent": 100, "least": 0}])
def test_resample_equals_brute_force(spark, how, size):
    got = importance.resample(frame(spark), aims(spark), **how, size=size).drop("n_words").collect()
    want = importance.brute_force(DOCS, TARGET, **how)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    assert importance.resample(frame(spark).limit(0), aims(spark)).collect() == []
    got = importance.resample(frame(spark), aims(spark, []).limit(0), least=1, percent=50).drop("n_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(importance.brute_force(DOCS, [], least=1, percent=50), key=repr)


def test_draw_carries_the_other_columns(spark):
    out = importance.draw(frame(spark), aims(spark), percent=50, least=1)
    assert out.columns == ["doc_id", "text", "lang", "n_features", "weight", "score", "rank"]
    drawn = {r[0] for r in importance.brute_force(DOCS, TARGET, percent=50, least=1) if r[4]}
    rows = out.collect()
    assert {r.doc_id for r in rows} == drawn and {r.lang for r in rows} == {"kept"}
    assert len(rows) == sum(i in drawn for i, _ in DOCS)


def test_a_block_holds_each_feature_once_and_long_texts_are_cut(spark):
    table = Store(spark, "test").put(word_blocks.cut(frame(spark), ALNUM, 2, 2000), "blocks")
    assert table.count() > 20
    assert all(len(set(map(bytes, r.words))) == len(r.words) and r.first[-1] == len(r.word) == len(r.times) for r in table.collect())
    assert table.selectExpr("explode(row) AS row").distinct().count() == len(DOCS)
    got = {bytes(r.word).decode(): r.uses for r in word_blocks.dictionary(word_blocks.entries(table)).collect()}
    want: dict = {}
    import re

    for _, t in DOCS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        for g in [*w, *map(" ".join, zip(w, w[1:], strict=False))]:
            want[g] = want.get(g, 0) + 1
    assert got == want


def test_sql_and_query_agree(spark):
    con = views(duckdb.connect(), SF)
    df, rel = importance.query(spark, SF), con.sql(importance.SQL)
    order = sorted(rel.columns)
    assert sorted(df.columns) == order
    assert rows_of([tuple(r) for r in df.collect()], df.columns, order) == rows_of(rel.fetchall(), rel.columns, order)


def test_each_block_has_a_file_of_its_own(spark, tmp_path, monkeypatch):
    """Readers decode whole batches of rows, and a block is a row of many MB."""
    from pyspark.sql import functions as F

    from watchloom.llm import importance as I
    from watchloom.llm import lattice_lm as L
    from watchloom.llm.store import Store

    files = []

    def put(self, df, name, *a, f=Store.put):
        out = f(self, df, name, *a)
        if name == "documents":
            files.extend(r["count"] for r in out.groupBy(F.input_file_name()).count().collect())
        return out

    monkeypatch.setattr(Store, "put", put)
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "concat('aa bb word', id) AS text", "'en' AS lang")
    assert I.weigh(docs, docs, size=64).count() == 40
    assert len(files) > 3 and max(files) == 1
    monkeypatch.setattr(L, "learned", lambda *a: 1 / 0)  # what follows needs a vocabulary file
    files.clear()
    with pytest.raises(ZeroDivisionError):
        L.score_documents(docs, "", F.lit(True), size=64)
    assert len(files) > 3 and max(files) == 1


def test_a_block_of_many_words_leaves_in_bounded_rows(spark):
    """One block, gathered from several pieces; as one row it took an executor hundreds of MB."""
    docs = spark.range(0, 4, 1, 1).selectExpr("IF(id = 3, NULL, id) AS doc_id", "concat_ws(' ', transform(sequence(id * 40000, id * 40000 + 60000), x -> concat('w', x, ' w', x % 7, ' the'))) AS text")
    table = Store(spark, "test").put(word_blocks.cut(docs, ALNUM), "blocks")
    assert table.select("block").distinct().count() == 1
    assert table.selectExpr("max(size(words)) <= 65536 AND max(size(word)) <= 262144 AS small").first().small
    known = word_blocks.dictionary(word_blocks.entries(table))
    assert known.where("blocks <> 1").count() == 0 and known.selectExpr("sum(uses) AS n").first().n == 4 * 3 * 60001
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resample(docs, aims(spark), percent=50).drop("n_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(importance.brute_force(rows, TARGET, percent=50), key=repr)


def test_texts_go_to_workers_in_small_batches_and_the_setting_is_left_as_it_was(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def put(self, df, name, *a, f=Store.put):
        seen.append((name, int(spark.conf.get(key))))
        return f(self, df, name, *a)

    monkeypatch.setattr(Store, "put", put)
    before = spark.conf.get(key)
    importance.weigh(frame(spark), aims(spark)).count()
    assert dict(seen)["documents"] == word_blocks.BATCH < int(before) == dict(seen)["dictionary"] and spark.conf.get(key) == before
