"""A run of judges over candidate pairs: distinct pairs in batches, retries, fallbacks, the score as the last resort, and accounts.

Every judge is asked about the pairs that no judge before it settled. A call gets a batch; only where the call itself fails each of its
pairs is asked about once more, alone. What a call returns is held against the contract: an answer of another length settles none of
its pairs, a result that breaks the contract does not settle its pair; neither is retried, the next judge gets them. What no judge settled
takes its retrieval score. Each attempt is a row: who, which batch, how many pairs, whether it was a retry, whether it failed, and its tokens.

Calls cost money, so a judge's answers and attempts are written as they are made and read from there by every later step. Batches are cut from
the pairs' order by ranges and prefix sums: which pairs share a call does not depend on how the table is dealt, and no task holds
more than a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators.judge import INPUT_PRICE, OUTPUT_PRICE, keeps_contract, pass_through
from watchloom.operators.ranks import ranked
from watchloom.sources.scratch import Store

ROW = "pair_id string, confidence double, is_match boolean, match_type string, reasoning string, judge string, batch long, pairs int, retry boolean, failed boolean, reason string, input_tokens long, output_tokens long"


@dataclass
class Judge:
    """``call`` gets a list of pairs (pair_id, query, candidate, context, score) and returns a list of results in their order, each with
    confidence, match_type, reasoning and perhaps is_match; it may raise. ``tokens`` counts a text's tokens for the accounts."""

    name: str
    call: Callable[[list[dict]], list[dict]]
    batch: int = 8
    tokens: Callable[[str], int] = lambda text: (len(text) + 3) // 4


def pair_id(query: str = "query", candidate: str = "candidate", context: str = "context") -> Column:
    """One id for all of a pair: case counts, and so does the whole context."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in (query, candidate, context)]))


def _asked(judge: Judge, number: int, pairs: list[dict]) -> list[tuple]:
    """The rows of one batch: a row for each attempt (no pair_id) and one for each settled pair."""
    out: list[tuple] = []

    def attempt(part: list[dict], retry: bool) -> bool:
        sent = sum(judge.tokens(f"{p['query'] or ''}{p['candidate'] or ''}{p['context'] or ''}") for p in part)
        note = lambda failed, why, got: out.append((None, None, None, None, None, judge.name, number, len(part), retry, failed, why, sent, got))
        try:
            results = judge.call(part)
        except Exception as e:  # noqa: BLE001  a judge is foreign code
            note(True, f"call failed: {type(e).__name__}", 0)
            return False
        got = sum(judge.tokens(str(r.get("reasoning") or "")) for r in results if isinstance(r, dict)) if isinstance(results, list) else 0
        if not isinstance(results, list) or len(results) != len(part):
            note(False, "another number of results", got)
            return True
        note(False, "", got)
        for p, r in zip(part, results, strict=True):
            if keeps_contract(r):
                yes = r.get("is_match")
                out.append((p["pair_id"], float(r["confidence"]), bool(yes) if yes is not None else r["confidence"] > 0.5, r["match_type"], r["reasoning"], judge.name, number, None, retry, None, None, None, None))
        return True

    if not attempt(pairs, False):
        for p in pairs:
            attempt([p], True)
    return out


def _asking(judge: Judge) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair_id")
        rows = _asked(judge, int(pdf["batch"].iloc[0]), pdf.drop(columns="batch").to_dict("records"))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in ROW.split(", ")])
        return out.astype({"is_match": "boolean", "retry": "boolean", "failed": "boolean", "pairs": "Int32", "input_tokens": "Int64", "output_tokens": "Int64", "confidence": "float64"})

    return ask


def run(pairs: DataFrame, judges: list[Judge]) -> tuple[DataFrame, DataFrame]:
    """(results, attempts) of the judges over pairs (query, candidate, context, score; others are ignored).

    results: a row for each distinct pair (null counts as empty): pair_id, confidence, is_match, match_type, reasoning, source (the judge's name, or "score"). Of
    equal pairs the highest score counts; pairs without one count as 0. attempts: judge, batch, pairs, retry, failed, reason, input_tokens,
    output_tokens. An empty table gives none of either; without judges every pair takes its score.
    """
    spark = pairs.sparkSession
    store = Store(spark, "judges")
    distinct = pairs.withColumn("pair_id", pair_id()).groupBy("pair_id").agg(*[F.first(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("query", "candidate", "context")], F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"))
    left = distinct = store.put(distinct, "pairs")
    settled, attempts = None, None
    for i, judge in enumerate(judges):
        numbered = ranked(left, [], [F.col("pair_id").asc()], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / judge.batch)).drop("_n")

        answers = store.put(numbered.groupBy("batch").applyInPandas(_asking(judge), ROW), f"answers-{i}")
        own = answers.where("pair_id IS NOT NULL").select("pair_id", "confidence", "is_match", "match_type", "reasoning", F.col("judge").alias("source"))
        made = answers.where("pair_id IS NULL").select("judge", "batch", "pairs", "retry", "failed", "reason", "input_tokens", "output_tokens")
        settled = own if settled is None else settled.unionByName(own)
        attempts = made if attempts is None else attempts.unionByName(made)
        left = left.join(own.select("pair_id"), "pair_id", "left_anti")
    scored = pass_through(left.withColumn("confidence", F.col("score")))
    kind = F.when(F.col("is_match"), "exact").otherwise("unlikely")  # without a judge only exact and alias hits reach a half
    rest = scored.select("pair_id", "confidence", "is_match", kind.alias("match_type"), F.lit("no judge settled the pair: its retrieval score").alias("reasoning"), F.lit("score").alias("source"))
    empty = spark.createDataFrame([], "judge string, batch long, pairs int, retry boolean, failed boolean, reason string, input_tokens long, output_tokens long")
    return rest if settled is None else settled.unionByName(rest), empty if attempts is None else attempts


def judged(pairs: DataFrame, judges: list[Judge]) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with the result of their pair, and the attempts: every distinct pair is judged once and joined back."""
    results, attempts = run(pairs, judges)
    kept = pairs.drop("confidence", "is_match", "match_type", "reasoning", "source").withColumn("pair_id", pair_id())
    return kept.join(results, "pair_id"), attempts


def accounts(attempts: DataFrame) -> DataFrame:
    """By judge: calls, retries, failed calls, pairs asked about, tokens and cost."""
    cost = F.sum("input_tokens") * INPUT_PRICE + F.sum("output_tokens") * OUTPUT_PRICE
    return attempts.groupBy("judge").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("retry").alias("retries"), F.count_if("failed").alias("failed"), F.sum("pairs").alias("pairs"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(cost, 6).alias("cost"),
    )
