"""The commit log, stages and layered tables: two writers, crashes, merges."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from watchloom.sources.layers import LayeredTable
from watchloom.sources.log import Log
from watchloom.sources.tables import Stages


def test_of_many_writers_at_once_every_change_is_kept(spark, tmp_path):
    errors = []

    def write(i):
        try:
            Log(spark, str(tmp_path)).commit(lambda s: s | {str(i): i})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = Log(spark, str(tmp_path))
    assert not errors and log.head() == (8, {str(i): i for i in range(8)}) and log.versions() == list(range(1, 9))


def test_an_entry_cut_off_by_a_crash_is_passed_over(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.head() == (0, {}) and log.versions() == []
    log.commit(lambda s: {"a": 1})
    (tmp_path / "_log/000000000002.json").write_text('{"a": 2')
    assert log.head() == (1, {"a": 1})
    assert log.commit(lambda s: s | {"b": 1}) == 3 and log.head()[1] == {"a": 1, "b": 1}
    assert not log._create(3, {"a": 9}) and log.head()[1] == {"a": 1, "b": 1}
    log.forget(1)
    assert log.versions() == [3]


def test_two_saves_at_once_leave_one_valid_stage(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    threads = [threading.Thread(target=lambda n=n: Stages(spark, str(tmp_path)).save("a", spark.range(n))) for n in (3, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {stages.load("a").count(), stages.load("a", backup=True).count()} == {3, 5}
    with pytest.raises(KeyError):
        stages.load("b")
    spark.range(9).write.parquet(str(tmp_path / "a/attempt-of-a-crashed-writer"))
    assert stages.info("a")["n_rows"] in (3, 5) and stages.list() == ["a"]


def test_stages_know_what_they_were_made_from(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    stages.save("prepare", spark.range(4))
    stages.save("match", stages.load("prepare").limit(2), needs=["prepare"])
    stages.save("report", stages.load("match"), needs=["match", "prepare"])
    assert stages.order() == ["prepare", "match", "report"] and stages.manifest().where("stale").count() == 0
    stages.save("prepare", spark.range(5))
    assert {r.stage for r in stages.manifest().where("stale").collect()} == {"match", "report"}
    stages.save("prepare", spark.range(6))
    assert len(stages.clean()) == 1 and stages.load("prepare").count() == 6 and stages.load("prepare", backup=True).count() == 5
    with pytest.raises(KeyError):
        stages.save("x", spark.range(1), needs=["nowhere"])


CHANGES = [
    [("a", 1, "upsert", "A1"), ("b", 2, "upsert", "B1"), ("b", 3, "upsert", "B2"), (None, 4, "upsert", "?"), ("c", 5, "rename", "?")],
    [("a", 6, "delete", None), ("c", 7, "upsert", "C1"), ("d", 8, "upsert", None), ("d", 9, None, "D")],
    [("a", 11, "upsert", "A2"), ("a", 10, "delete", None), ("c", 12, "delete", None), ("zz", 13, "delete", None)],
]
STATES = [{"a": "A1", "b": "B2"}, {"b": "B2", "c": "C1"}, {"a": "A2", "b": "B2"}]


def test_layers_give_the_last_change_of_each_key(spark, tmp_path):
    table = LayeredTable(spark, str(tmp_path), "id", "name string")
    state = lambda: {r["id"]: r["name"] for r in table.read().collect()}
    assert state() == {} and table.results() == []
    for batch, want in zip(CHANGES, STATES, strict=True):
        df = spark.createDataFrame(batch, "id string, seq int, op string, name string")
        before = table.read()
        held = len(before.collect())
        result = table.apply(df, required=("name",))
        assert state() == want and len(before.collect()) == held
        good = {b[0] for b in batch if b[0] and b[2] in ("upsert", "delete") and (b[2] == "delete" or b[3])}
        last = sorted((f for f in os.listdir(tmp_path) if f.startswith("layer-")), key=lambda f: os.path.getmtime(tmp_path / f))[-1]
        assert spark.read.parquet(str(tmp_path / last)).count() == len(good) == result["keys"]
        assert result["total"] == len(batch) == result["success"] + result["errors"]
    assert [r["errors"] for r in table.results()] == [2, 2, 0]
    assert sorted(r._error for r in table.errors().collect()) == ["no id", "no name", "no such operation", "no such operation"]
    assert table.compact() == 3 and state() == STATES[-1] and [r["errors"] for r in table.results()] == [2, 2, 0]
    assert table.compact() == 1
    table.apply(spark.createDataFrame([("b", 1, "delete", None)], "id string, seq int, op string, name string"))
    assert state() == {"a": "A2"} and LayeredTable(spark, str(tmp_path), "id", "name string").read().count() == 1


def test_a_batch_during_a_compaction_stays_on_top(spark, tmp_path):
    table = LayeredTable(spark, str(tmp_path), "id", "name string")
    for i in range(3):
        table.apply(spark.createDataFrame([("a", i, "upsert", str(i))], "id string, seq int, op string, name string"))
    merged, other = table._merged, LayeredTable(spark, str(tmp_path), "id", "name string")

    def late(layers):
        other.apply(spark.createDataFrame([("a", 9, "upsert", "late")], "id string, seq int, op string, name string"))
        return merged(layers)

    table._merged = late
    table.compact()
    assert [r["name"] for r in other.read().collect()] == ["late"] and len(other._layers()) == 2
    assert other.read().select(F.count(F.lit(1))).first()[0] == 1
