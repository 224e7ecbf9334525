"""The article stream, replayed with late and repeated rows, against one batch."""

import datetime
import shutil

from watchloom.streaming import articles as A

T = datetime.datetime(2024, 5, 1)
TEXTS = {0: "Acme CEO spoke", 1: "The senator met Acme CEO", 2: "Acme's Oslo office", 3: "nothing"}


def rows(*given):
    return [(i, v, T + datetime.timedelta(minutes=m), t) for i, v, m, t in given]


FILES = [
    rows((1, 1, 0, TEXTS[0]), (1, 2, 1, TEXTS[1]), (2, 5, 1, TEXTS[2]), (None, 1, 1, "x"), (3, 1, 1, None), (3, None, 1, "x")),
    rows((1, 1, 2, TEXTS[2]), (2, 5, 2, TEXTS[2]), (3, 1, 3, TEXTS[3]), (4, 1, 3, "")),
    rows((5, 1, 60 * 24 * 9, TEXTS[0])),  # days later
    rows((1, 3, 2, TEXTS[2]), (2, 4, 2, TEXTS[0]), (5, 1, 60 * 24 * 9, TEXTS[0])),  # late versions, one newer
]


def state(df):
    return sorted((r.article_id, r.version, r.n_spans, {k: tuple(v) for k, v in r.by_class.items()}) for r in df.collect())


def test_the_replayed_stream_is_one_batch(spark, tmp_path):
    schema = A.COLUMNS
    every = None
    table = A.table(spark, str(tmp_path / "table"))
    args = (str(tmp_path / "dead"), str(tmp_path / "check"))
    for i, part in enumerate(FILES):
        df = spark.createDataFrame(part, schema)
        every = df if every is None else every.unionByName(df)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        A.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, *args).awaitTermination(120)
        assert state(table.read()) == state(A.latest(every)), i
    layers = len(table._layers())
    assert {r._error for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {"no article_id", "no text", "no version"}
    # a crash that lost the checkpoint: every batch comes again under the numbers it had, and changes nothing
    shutil.rmtree(tmp_path / "check")
    A.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), table, *args).awaitTermination(120)
    assert len(table._layers()) == layers and state(table.read()) == state(A.latest(every))
    table.compact()
    assert state(table.read()) == state(A.latest(every))


def test_a_batch_keeps_what_is_newer_than_the_table(spark):
    """By joins: no call for each article."""
    good = spark.createDataFrame(rows((1, 1, 0, "a"), (1, 3, 1, "b"), (1, 2, 2, "c"), (2, 5, 0, "d"), (3, 1, 0, "e"), (4, 2, 0, "f"), (4, 2, 0, "f")), A.COLUMNS)
    held = spark.createDataFrame([(1, 2), (2, 5), (3, 9)], "article_id long, version long")
    kept = A.newest(good, held)
    assert sorted((r.article_id, r.version, r.text) for r in kept.collect()) == [(1, 3, "b"), (4, 2, "f")]
    assert "Pandas" not in kept._jdf.queryExecution().executedPlan().toString()
