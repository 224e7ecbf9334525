"""Longest-match transducers and bracket scanners against plain forms."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom.functions import scan
from watchloom.operators import enrich as E
from watchloom.operators import judge as J


def by_regex(text, table):
    """The same by an alternation of the keys, longest first."""
    keys = sorted((k for k in table if k), key=len, reverse=True)
    return re.sub("|".join(map(re.escape, keys)), lambda m: table[m.group()], text) if keys else text


@given(st.dictionaries(st.text("abc", max_size=4), st.text("xyz", max_size=3), max_size=8), st.text("abcd", max_size=30))
@settings(max_examples=300, deadline=None)
def test_transducer_takes_the_longest_key(table, text):
    assert scan.Transducer(table)(text) == by_regex(text, table)


def test_schemes_by_rule():
    for name, scheme in scan.SCHEMES.items():
        to = scan.Transducer(scheme)
        assert all(to(k) == v for k, v in scheme.items()), name
    assert len(scan.SCHEMES) == 8 and len(scan.SCHEMES["hangul"]) == 11172
    to = {n: scan.Transducer(s) for n, s in scan.SCHEMES.items()}
    assert to["hangul"]("김민준 서울") == "kimminjun seoul".replace("kim", "gim")
    assert to["kana"]("とうきょう") == "toukyou" and to["kana"]("マッチャ ラーメン") == "matcha ramen" and to["kana"]("しゃしん") == "shashin"
    assert to["devanagari"]("हिन्दी") == "hindii" and to["devanagari"]("नमस्ते") == "namaste"


@given(st.lists(st.sampled_from([k for k, v in scan.SCHEMES["cyrillic"].items() if len(v) == 1 and list(scan.SCHEMES["cyrillic"].values()).count(v) == 1 and v not in "yskctz"]), max_size=12))
@settings(max_examples=100, deadline=None)
def test_round_trip_where_letters_are_told_apart(letters):
    text = "".join(letters)
    scheme = scan.SCHEMES["cyrillic"]
    assert scan.Transducer(scan.back(scheme))(scan.Transducer(scheme)(text)) == text


json_texts = st.recursive(st.none() | st.integers(-9, 9) | st.text('ab"\\[]{} ', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k"}', max_size=3), x, max_size=3), max_leaves=8)


@given(st.lists(st.lists(json_texts, max_size=3) | st.dictionaries(st.text('k"]', max_size=3), json_texts, max_size=3), max_size=4), st.text("xyz ,.'", max_size=5))
@settings(max_examples=300, deadline=None)
def test_values_between_prose_are_those_written(items, prose):
    text = prose + prose.join(json.dumps(i, ensure_ascii=False) for i in items) + prose
    assert [json.loads(v) for v in scan.values(text)] == items


def test_cut_and_odd_answers():
    assert scan.values('[{"a": 1}, {"b": "x]') == ['{"a": 1}'] and scan.values('{"a": [1, 2') == [] == scan.values("")
    assert scan.values('see [1] and {"k": "}"} or ]') == ["[1]", '{"k": "}"}'] and scan.values('["a\\"]"]') == ['["a\\"]"]']
    assert scan.values("[" * 3000) == [] and len(scan.values("[]" * 3000)) == 3000


@given(st.dictionaries(st.from_regex(r"[a-z]{1,4}", fullmatch=True), st.text("a'\"\\,=() ", max_size=8), max_size=5))
@settings(max_examples=200, deadline=None)
def test_saved_objects_give_their_fields(given_fields):
    text = f"Thing({', '.join(f'{k}={v!r}' for k, v in given_fields.items())})"
    assert scan.fields(text) == given_fields


def test_what_is_no_saved_object():
    assert scan.fields("Thing(a='x") is None and scan.fields("no object") is None and scan.fields("A(1)") is None and scan.fields("") is None
    assert scan.fields("A()") == {} and scan.fields("A(b=[1, 'x)'], c=None)") == {"b": "[1, 'x)']", "c": "None"}


def test_columns(spark):
    df = spark.createDataFrame([("Tōkyō とうきょう", "A(b='c')"), (None, None), ("", "x")], "t string, r string")
    got = df.select(scan.romaji("t").alias("t"), scan.repr_fields("r").alias("r"), scan.json_values("r").alias("j")).collect()
    assert [(r.t, r.r, r.j) for r in got] == [("tōkyō toukyou", {"b": "c"}, []), (None, None, None), ("", None, [])]
    forms = spark.createDataFrame([("Москва",)], "t string").select(E.transliterations("t").alias("f")).first().f
    assert "moskva" in forms and "москва" not in forms
    odd = [('{"confidence": 0.9, "match_type": "exact", "reasoning": "the names are equal"} {"confidence": 0.8, "match_type": "exact", "reasoning": "the names are equal"}', 2), (None, 1), ("none", 1)]
    answers = spark.createDataFrame([(i, *x) for i, x in enumerate(odd)], "batch_id int, answer string, n_pairs int")
    assert sorted((r.batch_id, r.position, r.confidence, r.match_type) for r in J.parse_answers(answers, objects=True).collect()) == [(0, 0, 0.9, "exact"), (0, 1, 0.8, "exact"), (1, 0, 0.0, "error"), (2, 0, 0.0, "error")]
    assert df.select(F.size(E.transliterations("t"))).collect()
