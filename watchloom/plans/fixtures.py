"""Watch list, mentions and articles made from the star-schema tables, alike in Spark and in the SQL oracle.

The expressions are written once, in the SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.sources.tables import parquet

NOUN, ADJ = "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 1)"
ENTITY = {
    "name": "p_name",
    "entity_id": "translate(lower(p_name), ' -', '__') || '_001'",
    "entity_type": f"CASE length({NOUN}) % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'location' ELSE 'disease' END",
    "priority": f"CASE length({ADJ}) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "description": f"'The ' || {NOUN} || ' sold as ' || {ADJ}",
}
MENTION = {
    "mention_id": "p_partkey",
    "article_id": "'article_' || CAST(floor(p_partkey / 50) AS BIGINT)",
    "name": f"CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN {NOUN} || ', ' || {ADJ} WHEN 3 THEN left({ADJ}, 1) || '. ' || {NOUN} "
    f"WHEN 4 THEN replace(p_name, 'e', '') WHEN 5 THEN {NOUN} WHEN 6 THEN p_name || ' inc' ELSE replace(p_name, ' ', '-') END",
    "entity": "translate(lower(p_name), ' -', '__') || '_001'",
    "entity_type": ENTITY["entity_type"],
    "context": "'the ' || lower(p_type) || ' ' || p_brand || ' beside ' || p_name",
    "method": "CASE p_partkey % 3 WHEN 0 THEN 'gazetteer' WHEN 1 THEN 'pattern' ELSE 'model' END",
    "confidence": "(p_size % 50) / 50e0",
    "label": "CASE p_partkey % 8 WHEN 0 THEN 'exact' WHEN 1 THEN 'upper' WHEN 2 THEN 'reversed' WHEN 3 THEN 'initial' WHEN 4 THEN 'spelling' WHEN 5 THEN 'partial' WHEN 6 THEN 'suffix' ELSE 'hyphen' END",
}
CAP = f"upper(left({NOUN}, 1)) || substr({NOUN}, 2)"
ARTICLE = {
    "article_id": "p_partkey",
    "text": f"CASE p_partkey % 4 WHEN 0 THEN 'Yesterday ' || {CAP} || ' CEO met the finance minister of Austria, a company said.' "
    f"WHEN 1 THEN 'While at ' || {CAP} || '''s Austin headquarters, Doctor Smith saw the senior engineer.' "
    f"WHEN 2 THEN 'CFO of ' || {CAP} || ' Group left the Seattle office with the prime minister and a ' || p_name || '.' "
    f"ELSE 'The senator and Professor Lee of ' || {CAP} || ' university studied a ' || p_name || ' at the main office.' END",
}

#: A longer article: the text above and a sentence with mentions next to titles, people in front of titles, and places.
NEWS = f"""{ARTICLE["text"]} || CASE p_partkey % 5
 WHEN 0 THEN ' The French president and the interim manager met ' || {CAP} || ' president beside the ' || {CAP} || ' Austin office.'
 WHEN 1 THEN ' A former minister of Norway spoke; ' || {CAP} || ' director and ' || {CAP} || ' Chairman left the main office site.'
 WHEN 2 THEN ' The president of the company met the president near the college, said the {{}} professor.'
 WHEN 3 THEN ' American  general, Russian leader and Interim CEO of ' || {CAP} || ' Works agreed.' || chr(10) || 'The chancellor left. The university stays.'
 ELSE ' Acting ' || {CAP} || ' Founder, the vice president of sales, a team leader and the a CEO.' END""".replace("{}", "blue")


def _sql(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


#: DuckDB's common table expressions of the fixtures.
CTE = f"""
wl AS (SELECT *, [noun || ', ' || adj, left(adj, 1) || '. ' || noun, upper(name)] AS aliases FROM (
  {_sql(ENTITY | {"adj": ADJ, "noun": NOUN}, "(SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)")})),
mentions AS ({_sql(MENTION, "part WHERE p_name IS NOT NULL")}),
articles AS ({_sql(ARTICLE, "part WHERE p_name IS NOT NULL")})
"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    names = parquet(spark, sf, "part").where("p_name IS NOT NULL").select("p_name").distinct()
    e = names.selectExpr(*[f"{e} AS {c}" for c, e in (ENTITY | {"adj": ADJ, "noun": NOUN}).items()])
    return e.selectExpr("name", "entity_id", "entity_type", "priority", "description", "array(noun || ', ' || adj, left(adj, 1) || '. ' || noun, upper(name)) AS aliases")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "part").where("p_name IS NOT NULL").selectExpr(*[f"{e} AS {c}" for c, e in MENTION.items()])


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "part").where("p_name IS NOT NULL").selectExpr(*[f"{e} AS {c}" for c, e in ARTICLE.items()])


def news(spark: SparkSession, sf: str) -> DataFrame:
    """(article_id, text): articles for the whole extraction."""
    return parquet(spark, sf, "part").where("p_name IS NOT NULL").selectExpr("p_partkey AS article_id", f"{NEWS} AS text")


def named(spark: SparkSession, sf: str) -> DataFrame:
    """(surface, category): what the extractor of the fixtures knows, the watch list's nouns by their type and some adjectives."""
    kind = "CASE entity_type WHEN 'person' THEN 'PERSON' WHEN 'organization' THEN 'ORGANIZATION' WHEN 'location' THEN 'LOCATION' ELSE 'MISCELLANEOUS' END"
    nouns = entities(spark, sf).selectExpr("split_part(name, ' ', 2) AS surface", f"{kind} AS category").groupBy("surface").agg(F.min("category").alias("category"))
    words = spark.createDataFrame([(w, "MISCELLANEOUS") for w in ("French", "former", "American", "Russian", "Interim", "Acting", "Austin", "Norway", "a")], "surface string, category string")
    return nouns.unionByName(words)
