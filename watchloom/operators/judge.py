"""Judging candidate pairs: the result contract, the score pass-through, the rule judge, reading models' answers, agreement.

A judge is any function from a DataFrame of pairs (pair_id, query, candidate, context, score) to pair_id and the contract's
fields; results are joined by pair_id, never by position. ``with_judge`` judges distinct pairs only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.scan import json_values
from watchloom.operators.spans import TITLE_WORDS

# The match types of the contract.
MATCH_TYPES = ["exact", "nickname", "partial_last", "initial", "missing_components", "out_of_order", "phonetic", "cultural", "semantic", "title_role", "unlikely"]
RESULT = "confidence double, is_match boolean, match_type string, reasoning string, explanation_full string, confidence_factors map<string,double>, key_evidence array<string>, risk_factors array<string>"
# US dollars for an input and an output token.
INPUT_PRICE, OUTPUT_PRICE = 1e-5, 3e-5
#: Given names and their short forms for the rule judge.
NICKNAMES = {"bob": "robert", "bill": "william", "jim": "james", "mike": "michael", "tom": "thomas", "liz": "elizabeth", "kate": "katherine", "dick": "richard", "jack": "john", "tony": "anthony"}
LEGAL = ["inc", "ltd", "llc", "corp", "co", "gmbh", "plc"]


def is_match(explicit: Column, confidence: Column) -> Column:
    """The judge's word, or else more than half."""
    return F.coalesce(explicit, confidence > 0.5)


def pass_through(pairs: DataFrame) -> DataFrame:
    """Without a judge: the retrieval score as confidence, so exact and alias hits pass and fused ranks do not."""
    c = F.least(F.lit(1.0), F.col("confidence"))
    return pairs.withColumns({"confidence": c, "is_match": c > 0.5})


def fold(name: Column) -> Column:
    """Lower-case words without marks and legal forms."""
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(LEGAL))


def rule(query: Column, candidate: Column, context: Column, similarity: Column | None = None, threshold: float = 0.8) -> Column:
    """struct(match_type, confidence): the first rule that holds, as bands of the contract."""
    q, c = fold(query), fold(candidate)
    first = lambda a: F.try_element_at(a, F.lit(1))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    long = lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])[t], t)
    pair = lambda kind, conf: F.struct(F.lit(kind).alias("match_type"), F.lit(conf).alias("confidence"))
    same_last = last(q) == last(c)
    initial = same_last & (F.size(q) == F.size(c)) & (F.size(q) >= 2) & (F.left(first(q), F.lit(1)) == F.left(first(c), F.lit(1))) & ((F.length(first(q)) == 1) | (F.length(first(c)) == 1))
    sounds = F.transform(q, lambda t: F.soundex(t))
    title = F.exists(q, lambda t: t.isin(TITLE_WORDS)) & F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lower(candidate))
    return (
        F.when((F.size(q) == 0) | (F.size(c) == 0), pair("unlikely", 0.10))
        .when(q == c, pair("exact", 0.98))
        .when(F.array_sort(q) == F.array_sort(c), pair("out_of_order", 0.90))
        .when(initial, pair("initial", 0.80))
        .when(same_last & (F.size(q) >= 2) & (F.size(c) >= 2) & (first(q) != first(c)) & (long(first(q)) == long(first(c))), pair("nickname", 0.85))
        .when((F.size(F.array_except(q, c)) == 0) & (F.size(q) >= 2), pair("missing_components", 0.80))
        .when((F.size(q) == 1) & same_last & (F.size(c) >= 2), pair("partial_last", 0.60))
        .when(sounds == F.transform(c, lambda t: F.soundex(t)), pair("phonetic", 0.75))
        .when(F.collate(query, "UNICODE_CI_AI") == F.collate(candidate, "UNICODE_CI_AI"), pair("cultural", 0.85))
        .when(F.coalesce(title, F.lit(False)), pair("title_role", 0.80))
        .when(F.coalesce((similarity if similarity is not None else F.lit(0.0)) >= threshold, F.lit(False)), pair("semantic", 0.60))
        .otherwise(pair("unlikely", 0.10))
    )


def valid(r: Column) -> Column:
    """Whether a result keeps the contract: confidence within [0, 1], known type, ten characters of reasoning."""
    return F.coalesce(r.confidence.between(0.0, 1.0) & r.match_type.isin(MATCH_TYPES) & (F.length(F.trim(r.reasoning)) >= 10), F.lit(False))


def fallback(reason: str) -> Column:
    return F.struct(F.lit(0.0).alias("confidence"), F.lit(False).alias("is_match"), F.lit("unlikely").alias("match_type"), F.lit(reason).alias("reasoning"))


def json_array(answer: Column, objects: bool = False) -> Column:
    """The results in a model's answer as one JSON array: of its outermost JSON values the first array of objects. With ``objects``, where
    there is no such array, all its objects in order (an object that holds an array under ``results`` stands for it). Code fences and prose
    around them do not count; null where nothing is found."""
    found = json_values(answer)
    whole = F.get(F.filter(found, lambda v: v.rlike(r"^\[\s*(\{|\])")), F.lit(0))
    if not objects:
        return whole
    every = F.filter(found, lambda v: v.startswith("{"))
    held = F.get_json_object(F.get(every, F.lit(0)), "$.results")
    return F.coalesce(whole, F.when(held.startswith("["), held), F.when(F.size(every) > 0, F.concat(F.lit("["), F.array_join(every, ","), F.lit("]"))))


def parse_answers(answers: DataFrame, batch: str = "batch_id", answer: str = "answer", size: str = "n_pairs", objects: bool = False) -> DataFrame:
    """One row for each pair of a batch (position from 0): the parsed result, or the error row if it is missing or breaks
    the contract. An answer with another number of results than pairs is an error as a whole. ``objects``: for judges that may
    answer with objects outside of an array."""
    parsed = F.from_json(F.col("_json"), f"array<struct<{RESULT.replace(' ', ':').replace(',:', ', ')}>>")
    answers = answers.withColumn("_json", json_array(F.col(answer), objects)).withColumn("_parsed", parsed)
    fits = F.coalesce(F.size("_parsed") == F.col(size), F.lit(False))
    rows = answers.select(batch, F.when(fits, F.col("_parsed")).alias("_p"), F.posexplode(F.sequence(F.lit(1), F.col(size))).alias("position", "_i"))
    r = F.get("_p", F.col("position"))
    ok = F.col("_p").isNotNull() & valid(r)
    rows = rows.select(batch, "position", ok.alias("ok"), r.alias("r"), F.col("_p").isNotNull().alias("read"))
    return rows.select(
        batch,
        "position",
        F.when(F.col("ok"), F.col("r.confidence")).otherwise(0.0).alias("confidence"),
        F.when(F.col("ok"), is_match(F.col("r.is_match"), F.col("r.confidence"))).otherwise(False).alias("is_match"),
        F.when(F.col("ok"), F.col("r.match_type")).when(F.col("read"), "unlikely").otherwise("error").alias("match_type"),
        F.when(F.col("ok"), F.col("r.reasoning")).when(F.col("read"), "invalid result").otherwise("an error occurred: the answer could not be parsed").alias("reasoning"),
    )


def simple_type(match_type: Column) -> Column:
    """exact, role_based, semantic or other."""
    t = F.lower(match_type)
    return F.when(t == "exact", "exact").when(F.contains(t, F.lit("role")) | F.contains(t, F.lit("title")), "role_based").when(F.contains(t, F.lit("semantic")), "semantic").otherwise("other")


def failed_to_parse(reasoning: Column, match_type: Column) -> Column:
    r = F.lower(F.coalesce(reasoning, F.lit("")))
    has = lambda x: F.contains(r, F.lit(x))
    return has("error occurred") | (has("parse") & has("error")) | F.coalesce(match_type.isin("error", "parse_error", "invalid_json"), F.lit(False))


def unavailable(is_match: Column, confidence: Column) -> Column:
    return ~is_match & (confidence == 0.0)


def agreement(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """How far two judges agree on the pairs that both judged."""
    x = a.select(key, F.col("is_match").alias("_m"), F.col("match_type").alias("_t"), F.col("confidence").alias("_c"))
    both = x.join(b.select(key, "is_match", "match_type", "confidence"), key)
    share = lambda c: F.avg(c.cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), share(F.col("_m") == F.col("is_match")).alias("match_rate"), share(F.col("_t") == F.col("match_type")).alias("type_rate"), F.avg(F.abs(F.col("_c") - F.col("confidence"))).alias("mean_difference"))


def token_cost(calls: DataFrame, inputs: str, outputs: str) -> DataFrame:
    cost = F.sum(inputs) * INPUT_PRICE + F.sum(outputs) * OUTPUT_PRICE
    return calls.agg(F.sum(inputs).alias("input_tokens"), F.sum(outputs).alias("output_tokens"), F.bround(cost, 4).alias("cost"))


FAILED = {"confidence": 0.0, "is_match": False, "match_type": "unlikely"}


def keeps_contract(result: object) -> bool:
    """``valid`` for a result of a judge in Python: a known type, a confidence within [0, 1], ten characters of reasoning."""
    if not isinstance(result, dict) or result.get("match_type") not in MATCH_TYPES:
        return False
    c, why = result.get("confidence"), result.get("reasoning")
    return isinstance(c, (int, float)) and not isinstance(c, bool) and 0 <= c <= 1 and isinstance(why, str) and len(why.strip()) >= 10


def batched(call: Callable[[list[dict]], list[dict]], batch: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A judge from a function that judges a list of pairs, called on batches inside the executors; a call that fails gives
    its pairs the fallback result."""

    def judge(pairs: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for lo in range(0, len(pdf), batch):
                    part = pdf.iloc[lo : lo + batch].to_dict("records")
                    try:
                        got = call(part)
                        if len(got) != len(part):
                            raise ValueError("a judge returned another number of results")
                    except Exception as e:  # noqa: BLE001  a judge is foreign code
                        got = [FAILED | {"reasoning": f"judge unavailable: {e}"}] * len(part)
                    got = [g if keeps_contract(g) else FAILED | {"reasoning": "the judge's result breaks the contract"} for g in got]
                    yield pd.DataFrame([{"pair_id": p["pair_id"], "confidence": float(g["confidence"]), "is_match": g.get("is_match"), "match_type": g["match_type"], "reasoning": g["reasoning"]} for p, g in zip(part, got, strict=True)])

        return pairs.mapInPandas(run, "pair_id string, confidence double, is_match boolean, match_type string, reasoning string")

    return judge


def rule_judge(pairs: DataFrame) -> DataFrame:
    r = rule(F.col("query"), F.col("candidate"), F.col("context"))
    j = pairs.withColumn("_r", r)
    return j.select("pair_id", F.col("_r.confidence").alias("confidence"), (F.col("_r.confidence") > 0.5).alias("is_match"), F.col("_r.match_type").alias("match_type"), F.concat(F.lit("rule: "), F.col("_r.match_type"), F.lit(" holds first")).alias("reasoning"))


def with_judge(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Judges each distinct (query, candidate, context), case and whole context included, once and joins the result back."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("query", "candidate", "context")]
    keyed = pairs.withColumn("pair_id", F.md5(F.concat_ws("\x1f", *parts)))
    return keyed.join(judge(keyed.dropDuplicates(["pair_id"])), "pair_id")
