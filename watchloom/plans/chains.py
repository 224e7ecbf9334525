"""Registered queries of the judge chain (planned failures, results joined back, accounts), of grouped results and of challenges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators import candidates as C
from watchloom.operators import groups as G
from watchloom.operators import judge_chain as H
from watchloom.operators import metrics as M
from watchloom.plans.fixtures import CTE, entities, mentions
from watchloom.plans.queries import CASCADE, PRF, query


def _number(pair: dict) -> int:
    return int(pair["pair_id"][:4], 16)


def _result(pair: dict) -> dict:
    q, c = pair["query"].lower(), pair["candidate"].lower()
    kind, conf = ("exact", 0.95) if q == c else ("missing_components", 0.7) if c in pair["context"].lower() else ("unlikely", 0.2)
    return {"confidence": conf, "match_type": kind, "reasoning": "compared as lower case"}


def first_judge(pairs: list[dict]) -> list[dict]:
    """Fails where a pair's number is a multiple of 29, leaves the last result out at 31, breaks the contract at 7."""
    if any(_number(p) % 29 == 0 for p in pairs):
        raise TimeoutError("planned")
    out = [_result(p) | ({"confidence": 1.2} if _number(p) % 7 == 0 else {}) for p in pairs]
    return out[:-1] if any(_number(p) % 31 == 0 for p in pairs) else out


def second_judge(pairs: list[dict]) -> list[dict]:
    """Asked about what the first left open; fails at multiples of 5, says yes or no itself, and is short of words at 11."""
    if any(_number(p) % 5 == 0 for p in pairs):
        raise ConnectionError("planned")
    return [{"confidence": 0.6, "is_match": _number(p) % 2 == 0, "match_type": "semantic", "reasoning": "short" if _number(p) % 11 == 0 else "a second opinion"} for p in pairs]


def _pairs(spark, sf) -> DataFrame:
    found = C.cascade(mentions(spark, sf), entities(spark, sf)).select("mention_id", "entity_id", F.col("confidence").alias("score"), F.col("name").alias("query"), "context")
    return found.join(entities(spark, sf).select("entity_id", F.col("name").alias("candidate")), "entity_id")


def _judges() -> list[H.Judge]:
    return [H.Judge("first", first_judge, 8), H.Judge("second", second_judge, 3)]


def _asked(judge: str, size: int, source: str, fails: str, short: str) -> str:
    """Batches of one judge: the pairs in order, what the batch's call does, and each pair's own."""
    return f"""{judge}_n AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // {size} AS batch FROM {source}),
{judge} AS (SELECT *, bool_or({fails}) OVER (PARTITION BY batch) AS down, bool_or({short}) OVER (PARTITION BY batch) AS cut, {fails} AS own_down, {short} AS own_cut FROM {judge}_n)"""


CHAIN = f"""{CASCADE},
raw AS (SELECT mention_id, entity_id, cas.confidence AS score, m.name AS query, wl.name AS candidate, context FROM cas JOIN mentions m USING (mention_id) JOIN wl USING (entity_id)),
keyed AS (SELECT *, md5(query || chr(31) || candidate || chr(31) || context) AS pair_id FROM raw),
pairs AS (SELECT pair_id, ('0x' || substr(pair_id, 1, 4))::BIGINT AS k, query, candidate, context, max(score) AS score FROM keyed GROUP BY ALL),
sized AS (SELECT *, (length(query || candidate || context) + 3) // 4 AS sent FROM pairs),
{_asked("a", 8, "sized", "k % 29 = 0", "k % 31 = 0")},
a_ok AS (SELECT *, CASE WHEN lower(query) = lower(candidate) THEN 'exact' WHEN contains(lower(context), lower(candidate)) THEN 'missing_components' ELSE 'unlikely' END AS kind FROM a
  WHERE k % 7 <> 0 AND CASE WHEN down THEN NOT own_down AND NOT own_cut ELSE NOT cut END),
b_in AS (SELECT * FROM sized WHERE pair_id NOT IN (SELECT pair_id FROM a_ok)),
{_asked("b", 3, "b_in", "k % 5 = 0", "false")},
b_ok AS (SELECT * FROM b WHERE k % 11 <> 0 AND CASE WHEN down THEN NOT own_down ELSE true END),
result AS (SELECT pair_id, CASE kind WHEN 'exact' THEN 0.95e0 WHEN 'missing_components' THEN 0.7e0 ELSE 0.2e0 END AS confidence, kind <> 'unlikely' AS is_match, kind AS match_type, 'first' AS source FROM a_ok
UNION ALL SELECT pair_id, 0.6e0, k % 2 = 0, 'semantic', 'second' FROM b_ok
UNION ALL SELECT pair_id, least(1e0, score), least(1e0, score) > 0.5, CASE WHEN least(1e0, score) > 0.5 THEN 'exact' ELSE 'unlikely' END, 'score' FROM b_in WHERE pair_id NOT IN (SELECT pair_id FROM b_ok))"""


@query("judge_chain", f"+ {CHAIN} SELECT mention_id, entity_id, confidence, is_match, match_type, source FROM keyed JOIN result USING (pair_id)")
def judge_chain(spark, sf):
    out, _ = H.judged(_pairs(spark, sf), _judges())
    return out.select("mention_id", "entity_id", "confidence", "is_match", "match_type", "source")


#: An attempt for each batch, and after a failed call one for each of its pairs.
ATTEMPTS = """attempt AS (SELECT 'first' AS judge, batch, false AS retry, count(*) AS pairs, any_value(down) AS failed, sum(sent) AS sent, CASE WHEN any_value(down) THEN 0 WHEN any_value(cut) THEN (count(*) - 1) * 6 ELSE count(*) * 6 END AS got FROM a GROUP BY batch
UNION ALL SELECT 'first', batch, true, 1, own_down, sent, CASE WHEN own_down OR own_cut THEN 0 ELSE 6 END FROM a WHERE down
UNION ALL SELECT 'second', batch, false, count(*), any_value(down), sum(sent), CASE WHEN any_value(down) THEN 0 ELSE sum(CASE WHEN k % 11 = 0 THEN 2 ELSE 4 END) END FROM b GROUP BY batch
UNION ALL SELECT 'second', batch, true, 1, own_down, sent, CASE WHEN own_down THEN 0 WHEN k % 11 = 0 THEN 2 ELSE 4 END FROM b WHERE down)"""


@query(
    "judge_accounts",
    f"+ {CHAIN}, {ATTEMPTS} SELECT judge, count(*) AS calls, (count(*) FILTER (retry)) AS retries, (count(*) FILTER (failed)) AS failed, sum(pairs)::BIGINT AS pairs, sum(sent)::BIGINT AS input_tokens, sum(got)::BIGINT AS output_tokens, round(sum(sent) * 1e-5 + sum(got) * 3e-5, 6) AS cost FROM attempt GROUP BY judge",
)
def judge_accounts(spark, sf):
    _, attempts = H.run(_pairs(spark, sf), _judges())
    return H.accounts(attempts)


# --- results of several queries -------------------------------------------------------------------------------------

#: The results of one request, an article's: long names that differ in a few letters, found by two methods.
FOUND = {
    "name": "CASE mention_id % 3 WHEN 0 THEN upper(entity) ELSE entity END || ' of the limited company number ' || (mention_id % 17)",
    "method": "CASE mention_id % 2 WHEN 0 THEN 'text' ELSE 'vector' END",
    "score": "confidence + (mention_id % 7) / 10e0",
    "place": "mention_id",
}


@query(
    "grouped_results",
    f"""WITH RECURSIVE {CTE.strip()}, r AS (SELECT article_id, {", ".join(f"{e} AS {c}" for c, e in FOUND.items())}, lower({FOUND["name"]}) AS k, row_number() OVER (PARTITION BY article_id ORDER BY mention_id) AS i FROM mentions),
f AS (SELECT article_id, i, k, [k] AS leaders, 1 AS grp FROM r WHERE i = 1
  UNION ALL SELECT r.article_id, r.i, r.k, CASE WHEN hit IS NULL THEN list_append(leaders, r.k) ELSE leaders END, coalesce(hit, len(leaders) + 1) FROM
  (SELECT f.article_id, f.i + 1 AS i, f.leaders, r.k, list_position(list_transform(f.leaders, lambda l: 1 - levenshtein(l, r.k) / greatest(length(l), length(r.k))::DOUBLE > 0.95), true) AS hit FROM f JOIN r ON r.article_id = f.article_id AND r.i = f.i + 1) r),
g AS (SELECT r.*, grp FROM r JOIN f ON f.article_id = r.article_id AND f.i = r.i),
b AS (SELECT article_id, grp, list(place ORDER BY score DESC, place)[1] AS place, count(*) AS duplicate_count, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM g GROUP BY ALL),
v AS (SELECT b.article_id, r.name, r.method, r.score, b.place, duplicate_count, methods, (SELECT avg(greatest(0e0, 1 - levenshtein(lower(m.name), lower(r.name)) / greatest(length(m.name), length(r.name))::DOUBLE)) FROM mentions m WHERE m.article_id = b.article_id) AS relevance FROM b JOIN r USING (article_id, place))
SELECT article_id, name, method, round(score, 6) AS score, duplicate_count, methods, round(relevance, 6) AS relevance, round(0.7e0 * score + 0.3e0 * relevance, 6) AS final,
row_number() OVER (PARTITION BY article_id ORDER BY round(0.7e0 * score + 0.3e0 * relevance, 9) DESC, place)::INT AS rank FROM v""",
    cte=False,
)
def grouped_results(spark, sf):
    m = mentions(spark, sf)
    results = m.selectExpr("article_id", *[f"{e} AS {c}" for c, e in FOUND.items()])
    out = G.dedup_and_rank(results, m.select("article_id", F.col("name").alias("query")), "article_id")
    r6 = lambda c: F.round(c, 6).alias(c)
    return out.select("article_id", "name", "method", r6("score"), "duplicate_count", F.array_join("methods", ",").alias("methods"), r6("relevance"), r6("final"), "rank")


# --- challenges ----------------------------------------------------------------------------------------------------

#: A judge's decisions: mostly the right entity, some another one of the article, accepted from a bound on.
DECISIONS = "CASE WHEN mention_id % 6 = 0 THEN 'cold_bolt_001' ELSE entity END AS entity, confidence > 0.2 AS is_match"
CHALLENGE = f"""g AS (SELECT DISTINCT label, article_id, name, entity FROM mentions), j AS (SELECT article_id, name, {DECISIONS} FROM mentions),
p AS (SELECT DISTINCT article_id, name, entity FROM j WHERE is_match),
i AS (SELECT label, count(DISTINCT b.article_id) AS articles, count(p.article_id) AS pred_in_articles FROM (SELECT DISTINCT label, article_id FROM g) b LEFT JOIN p USING (article_id) GROUP BY label),
h AS (SELECT label, count(*) AS gold, count(p.name) AS tp FROM g LEFT JOIN p USING (article_id, name, entity) GROUP BY label),
c AS (SELECT label, articles, gold, pred_in_articles, tp, pred_in_articles - tp AS fp, gold - tp AS fn FROM h JOIN i USING (label)),
x AS (SELECT label, articles, gold, pred_in_articles, tp, fp, fn, {PRF} FROM c)"""


def _challenges(spark, sf) -> DataFrame:
    m = mentions(spark, sf)
    return M.prf1_by_challenge(m, m.select("article_id", "name", F.expr(DECISIONS.split(" AS entity")[0]).alias("entity"), "confidence").where("confidence > 0.2"))


@query("prf1_by_challenge", f"+ {CHALLENGE} SELECT * FROM x")
def prf1_by_challenge(spark, sf):
    return _challenges(spark, sf)


@query("challenge_extremes", f"+ {CHALLENGE} SELECT * FROM (SELECT 'hardest' AS side, row_number() OVER (ORDER BY f1, gold DESC, label)::INT AS place, label, gold, f1 FROM x WHERE gold >= 8 UNION ALL SELECT 'best', row_number() OVER (ORDER BY f1 DESC, gold DESC, label)::INT, label, gold, f1 FROM x WHERE gold >= 8) WHERE place <= 10")
def challenge_extremes(spark, sf):
    return M.extremes(_challenges(spark, sf))


@query(
    "decision_metrics",
    f"+ {CHALLENGE}, k AS (SELECT (SELECT count(*) FROM p JOIN (SELECT DISTINCT article_id, name, entity FROM g) USING (article_id, name, entity)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(DISTINCT (article_id, name, entity)) FROM g) AS ng), c2 AS (SELECT tp, np - tp AS fp, ng - tp AS fn FROM k) SELECT (SELECT count(*) FROM j) AS judgments, (SELECT count(*) FILTER (is_match) FROM j) AS positives, (SELECT round(avg(is_match::INT), 6) FROM j) AS acceptance_rate, tp, fp, fn, {PRF} FROM c2",
)
def decision_metrics(spark, sf):
    m = mentions(spark, sf)
    judged = m.select("article_id", "name", F.expr(DECISIONS.split(" AS entity")[0]).alias("entity"), (F.col("confidence") > 0.2).alias("is_match"))
    return M.decision_metrics(m, judged, ["article_id", "name", "entity"])
