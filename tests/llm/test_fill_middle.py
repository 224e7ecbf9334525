"""Fill-in-middle against a listing of the units, and its exact round trip."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_text_operators import ROWS
from tests.test_queries import SF, rows_of, views
from watchloom.llm import fill_middle as fim

ODD = [(100, " lead"), (101, "tail \n"), (102, " \t\n"), (103, "a <P> b"), (104, "<S>"), (105, "x<M>y z"), (106, "< P> <S"), (107, "日本 語 é"), (108, " a b"), (109, "a\x00b c"), (110, "<" * 50 + " " + "S>" * 9), (None, "no id here")]
WANTED = [*ROWS, *ODD, (1, "the same id, another text")]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("unit", ["token", "char", "byte"])
@given(st.lists(st.text(st.sampled_from("ab <SPM>\t\né日😀"), max_size=30), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_every_cut_of_the_runs_is_the_cut_of_the_units(unit, texts):
    data, offs = packed(texts)
    runs = fim.Runs.encode(data, offs, unit)
    n = np.diff(runs.before())
    for i, t in enumerate(texts):
        if unit == "byte":
            ends = [len(t.encode()[:u].decode(errors="ignore")) for u in range(len(t.encode()) + 1)]
        else:
            ends = [0]
            while ends[-1] < len(t):
                at = ends[-1]
                while unit == "token" and at < len(t) and t[at] in " \t\n":
                    at += 1
                while unit == "token" and at < len(t) and t[at] not in " \t\n":
                    at += 1
                ends.append(at if unit == "token" else at + 1)
        assert n[i] == len(ends) - 1
        assert [runs.cut(i, u) for u in range(n[i] + 1)] == [(len(t[:c].encode()), c) for c in ends]


def test_runs_are_stored_once_for_each_change_of_class():
    data, offs = packed(["aaaa bbbb", "", "é" * 1000])
    assert len(fim.Runs.encode(data, offs, "token").start) == 4 and len(fim.Runs.encode(data, offs, "char").start) == 2


@pytest.mark.parametrize("unit", ["token", "char", "byte"])
def test_transform_equals_brute_force(spark, unit):
    df = spark.createDataFrame([(i, t, "own", "kept") for i, t in WANTED], "doc_id long, text string, FORM string, lang string")
    for rate, spm in ((50, 80), (100, 0), (100, 100), (0, 50)):
        out = fim.transform(df, 7, rate, spm, unit)
        assert out.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.lang) for r in out.collect()), key=repr)
        want = []
        for i, t in WANTED:
            n, form, pre, mid, text = fim.brute_force(t, i, 7, rate, spm, unit)
            want.append((i, t, n, form, None if pre is None else len(pre), None if mid is None else len(mid), text, "kept"))
        assert got == sorted(want, key=repr)
        assert {r[3] for r in got} >= ({"plain", "psm", "spm"} if rate == 50 else {"plain"})


def test_digests_restore_the_text(spark):
    df = spark.createDataFrame(WANTED, "doc_id long, text string")
    got = fim.digests(fim.transform(df, rate=100, spm=50)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in got) == sorted(sha(t) for _, t in WANTED)
    assert fim.digests(fim.transform(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        fim.restore(b"<P>a<S>b", "psm")
    with pytest.raises(ValueError):
        fim.transform(df, unit="word")


def test_a_very_long_text_and_one_without_a_blank(spark):
    rows = [(1, "wort " * 400_000), (2, "é" * 1_500_000), (3, " " * 1_000_000)]
    got = fim.digests(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate=100)).collect()
    for r in got:
        n, form, pre, mid, out = fim.brute_force(dict(rows)[r.doc_id], r.doc_id, rate=100)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, len(pre), len(mid), hashlib.sha256(out.encode()).hexdigest())


def test_query_equals_sql(spark):
    con = views(duckdb.connect(), SF)
    df = fim.query(spark, SF)
    rel = con.sql(fim.SQL)
    order = sorted(rel.columns)
    assert sorted(df.columns) == order
    assert rows_of([tuple(r) for r in df.collect()], df.columns, order) == rows_of(rel.fetchall(), rel.columns, order)
