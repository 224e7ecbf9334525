"""Registered queries of text scanned in one pass: answers with brackets and quotes, saved objects, syllables."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import scan
from watchloom.operators import judge as J
from watchloom.plans.fixtures import mentions
from watchloom.plans.queries import query
from watchloom.sources.tables import parquet

CONF = "'0.' || lpad(CAST(mention_id % 100 AS STRING), 2, '0')"
QUOTE = "chr(92) || '\"'"
#: Answers to one pair each: an array with brackets and quotes in its text, an object in prose, two objects, an object of
#: results, an array that was cut off behind its first object, and one cut off in it.
REPLY = f"""CASE mention_id % 6
 WHEN 0 THEN '```json' || chr(10) || '[{{"confidence": ' || {CONF} || ', "match_type": "exact", "reasoning": "]}} [names: ' || {QUOTE} || name || {QUOTE} || ' {{equal"}}]' || chr(10) || '```'
 WHEN 1 THEN 'The result {{so far}} is {{"confidence": ' || {CONF} || ', "match_type": "nickname", "reasoning": "short form ]}} of it"}} [as asked'
 WHEN 2 THEN '{{"confidence": ' || {CONF} || ', "match_type": "initial", "reasoning": "the first of two"}} and {{"confidence": 0.5}}'
 WHEN 3 THEN '{{"results": [{{"confidence": ' || {CONF} || ', "match_type": "semantic", "reasoning": "found [in] a list"}}]}}'
 WHEN 4 THEN '[{{"confidence": ' || {CONF} || ', "match_type": "cultural", "reasoning": "whole before the cut"}}, {{"conf'
 ELSE '{{"a": [1, 2, {{"confidence"' END"""


@query(
    "judge_answer_scan",
    """+ a AS (SELECT mention_id, name, mention_id % 6 AS k, (mention_id % 100) / 100e0 AS c FROM mentions)
SELECT mention_id, CASE WHEN k IN (0, 3, 4) THEN c ELSE 0e0 END AS confidence, CASE k WHEN 0 THEN 'exact' WHEN 3 THEN 'semantic' WHEN 4 THEN 'cultural' ELSE 'error' END AS match_type,
CASE k WHEN 0 THEN ']} [names: "' || name || '" {equal' WHEN 3 THEN 'found [in] a list' WHEN 4 THEN 'whole before the cut' END AS reasoning FROM a""",
)
def judge_answer_scan(spark, sf):
    answers = mentions(spark, sf).select(F.col("mention_id").alias("batch_id"), F.expr(REPLY).alias("answer"), F.lit(1).alias("n_pairs"))
    p = J.parse_answers(answers, objects=True)
    good = F.col("match_type") != "error"
    return p.select(F.col("batch_id").alias("mention_id"), "confidence", "match_type", F.when(good, F.col("reasoning")).alias("reasoning"))


#: Mentions as another program has saved them, names with marks of their own included.
SAVED = "CASE WHEN mention_id % 9 = 0 THEN 'Mention(name=' || chr(39) || name ELSE 'Mention(name=' || chr(34) || name || ' (' || chr(39) || 'x, y=1' || chr(39) || ')' || chr(34) || ', kind=' || chr(39) || entity_type || chr(39) || ', position=' || CAST(mention_id AS STRING) || ', tags=[1, (2, 3)], score=None)' END"


@query("saved_objects", "+ m AS (SELECT mention_id, name || ' (''x, y=1'')' AS name, entity_type AS kind, mention_id AS position, '[1, (2, 3)]' AS tags, mention_id % 9 > 0 AS whole FROM mentions) SELECT mention_id, CASE WHEN whole THEN name END AS name, CASE WHEN whole THEN kind END AS kind, CASE WHEN whole THEN position END AS position, CASE WHEN whole THEN tags END AS tags FROM m")
def saved_objects(spark, sf):
    f = mentions(spark, sf).select("mention_id", scan.repr_fields(F.expr(SAVED)).alias("f"))
    return f.select("mention_id", F.col("f")["name"].alias("name"), F.col("f")["kind"].alias("kind"), F.col("f")["position"].cast("long").alias("position"), F.col("f")["tags"].alias("tags"))


FIRST = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
LAST = ["", *"k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()]
_sql = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(
    "romanised_syllables",
    f"""WITH s AS (SELECT p_partkey, unnest([0, 1, 2]) AS i FROM part), n AS (SELECT p_partkey, i, (p_partkey * 7919 + i * 1237) % 11172 AS k FROM s),
r AS (SELECT p_partkey, i, k, {_sql(FIRST)}[k // 588 + 1] || {_sql(VOWEL)}[k % 588 // 28 + 1] || {_sql(LAST)}[k % 28 + 1] AS latin FROM n)
SELECT p_partkey, string_agg(chr((44032 + k)::INT), '' ORDER BY i) AS hangul, string_agg(latin, '' ORDER BY i) AS latin FROM r GROUP BY p_partkey""",
    cte=False,
)
def romanised_syllables(spark, sf):
    """Three Korean syllables for each part, in Latin letters."""
    syllable = lambda i: F.decode(F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in _utf8(44032 + (F.col("p_partkey") * 7919 + i * 1237) % 11172)])), "UTF-8")
    p = parquet(spark, sf, "part").select("p_partkey", F.concat(*[syllable(i) for i in range(3)]).alias("hangul"))
    return p.select("p_partkey", "hangul", scan.transduce("hangul", scan.SCHEMES["hangul"]).alias("latin"))


def _utf8(point):
    """The three bytes of a code point between 2048 and 65535."""
    return [F.lit(224) + F.floor(point / 4096), F.lit(128) + F.floor(point / 64) % 64, F.lit(128) + point % 64]
