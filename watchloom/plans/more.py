"""Registered queries of enrichment, providers, projections, join-backs and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import text as T
from watchloom.operators import candidates as C
from watchloom.operators import enrich as E
from watchloom.operators import report as R
from watchloom.operators import search as S
from watchloom.operators import spans as X
from watchloom.plans.fixtures import articles, entities, mentions
from watchloom.plans.queries import BM25, CASCADE, GRAMS, _index, _items, _vectors, query, tok
from watchloom.sources.tables import parquet, sample_articles, sample_entities

# --- enrichment -----------------------------------------------------------------------------------------------------

PAGES = """pages_ AS (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (disambiguation)' ELSE ' (trade)' END AS title, p_name AS k,
 'The ' || p_name || ' of ' || p_brand || repeat(' sold since long ago.', p_size % 40) AS context, CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS language,
 CASE p_partkey % 4 WHEN 0 THEN 'Wikipedia' WHEN 1 THEN 'Primary source' ELSE 'Catalogue' END AS source FROM part WHERE p_name IS NOT NULL)"""
CONF = "greatest(0.1e0, least(1e0, 0.5e0 + CASE WHEN contains(lower(title), lower(k)) THEN 0.3e0 ELSE 0e0 END + CASE WHEN length(context) > 500 THEN 0.2e0 WHEN length(context) > 200 THEN 0.1e0 ELSE 0e0 END - CASE WHEN contains(lower(title), 'disambiguation') THEN 0.3e0 ELSE 0e0 END))"
RANKED = f"""{PAGES}, rk AS (SELECT k AS name, title, context, language, source, {CONF} AS confidence FROM (SELECT DISTINCT * FROM pages_)),
rn AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, CASE language WHEN 'en' THEN 1 ELSE 10 END, title, context) AS rank FROM rk)"""


def _contexts(spark, sf):
    """Candidate contexts of names, as a look-up service gives them."""
    rows = parquet(spark, sf, "part").where("p_name IS NOT NULL").selectExpr(
        "p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (disambiguation)' ELSE ' (trade)' END AS title", "p_name AS name",
        "'The ' || p_name || ' of ' || p_brand || repeat(' sold since long ago.', p_size % 40) AS context", "CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS language",
        "CASE p_partkey % 4 WHEN 0 THEN 'Wikipedia' WHEN 1 THEN 'Primary source' ELSE 'Catalogue' END AS source")
    return rows.distinct()


@query("disambiguation_ranked", f"+ {RANKED} SELECT name, confidence, count(*) AS n, min(rank)::INT AS first_rank FROM (SELECT name, round(confidence, 6) AS confidence, rank FROM rn) GROUP BY ALL")
def disambiguation_ranked(spark, sf):
    r = E.disambiguated(_contexts(spark, sf))
    return r.groupBy("name", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"))


@query("disambiguation_alternatives", f"+ {RANKED} SELECT name, round(max(confidence), 6) AS confidence, count(*) - 1 AS n_alternatives FROM rn GROUP BY name")
def disambiguation_alternatives(spark, sf):
    a = E.alternatives(E.disambiguated(_contexts(spark, sf)))
    return a.select("name", F.round("confidence", 6).alias("confidence"), F.size("alternatives").cast("long").alias("n_alternatives"))


@query("provider_contexts", f"+ {RANKED}, b AS (SELECT name, max(confidence) AS c FROM rn GROUP BY name) SELECT wl.name, CASE WHEN b.c >= 0.7 THEN round(b.c, 6) ELSE 0.8e0 END AS confidence, b.c < 0.7 AS own FROM wl JOIN b ON b.name = wl.name")
def provider_contexts(spark, sf):
    held = _contexts(spark, sf)
    e = E.with_contexts(entities(spark, sf), lambda names: names.join(held, "name"))
    return e.select("name", F.round("confidence", 6).alias("confidence"), (F.col("source") == "Entity Data").alias("own"))


@query("description_preserving", "SELECT entity_id, description AS context, 1e0 AS confidence, 'Original Description' AS source FROM wl")
def description_preserving(spark, sf):
    return E.keep_description(entities(spark, sf)).select("entity_id", "context", "confidence", "source")


@query("enrichment_projection", f"+ {PAGES} SELECT title, context, source, length(context) AS context_length, contains(source, 'Wikipedia') OR contains(source, 'Primary') AS has_wikipedia, 0.8e0 AS confidence FROM (SELECT DISTINCT * FROM pages_)")
def enrichment_projection(spark, sf):
    rows = _contexts(spark, sf).withColumn("s", E.summary("context", "source", F.lit(None).cast("double")))
    return rows.select("title", "context", "source", F.col("s.context_length").cast("long").alias("context_length"), "s.has_wikipedia", "s.confidence")


@query("romaji_corrections", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') OR contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN array_to_string(list_transform(string_split(replace(replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'red' THEN 'akai' WHEN 'blue' THEN 'aoi' ELSE w END), ' '), 'ring', 'wa'), 'bolt', 'boruto'), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE p_name END AS fixed FROM part WHERE p_name IS NOT NULL", cte=False)
def romaji_corrections(spark, sf):
    p = parquet(spark, sf, "part").where("p_name IS NOT NULL")
    return p.select("p_partkey", E.corrected("p_name", {"red": "akai", "blue": "aoi"}, {"ring": "wa", "bolt": "boruto"}).alias("fixed"))


GREEK = {latin: letter for letter, latin in reversed(E.SCHEMES["greek"].items()) if len(latin) == 1}


@query("transliteration", f"SELECT DISTINCT p_brand, translate(replace(replace(replace(lower(p_brand), 'ch', 'χ'), 'ps', 'ψ'), 'th', 'θ'), '{''.join(GREEK)}', '{''.join(GREEK.values())}') AS greek, lower(p_brand) AS back FROM part WHERE p_brand IS NOT NULL", cte=False)
def transliteration(spark, sf):
    p = parquet(spark, sf, "part").where("p_brand IS NOT NULL").select("p_brand").distinct()
    greek = E.from_latin("p_brand", E.SCHEMES["greek"])
    return p.select("p_brand", greek.alias("greek"), E.to_latin(greek, E.SCHEMES["greek"]).alias("back"))


@query("provider_mentions", r"+ m AS (SELECT article_id, unnest(regexp_extract_all(text, '\b[A-Z]\w+')) AS name FROM articles) SELECT article_id, name, count(*) AS n FROM m GROUP BY ALL")
def provider_mentions(spark, sf):
    def extract(a):
        found = a.select(F.col("article_id").cast("string").alias("article_id"), F.explode_outer(X.matches(F.col("text"), r"\b[A-Z]\w+")).alias("m")).where("m IS NOT NULL")
        return found.select("article_id", "m.name", F.lit("OTHER").alias("category"), F.col("m.start").alias("start"), F.col("m.stop").alias("stop"), F.lit(0.5).alias("confidence"))

    return E.with_mentions(articles(spark, sf), extract).groupBy(F.col("article_id").cast("long").alias("article_id"), "name").agg(F.count(F.lit(1)).alias("n"))


@query("provider_embeddings")
def provider_embeddings(spark, sf):
    """Names under the default encoder; equal to its brute-force form in the tests."""
    return E.with_embeddings(entities(spark, sf).select("entity_id", "name"), "name").select("entity_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


# --- retrieval ------------------------------------------------------------------------------------------------------


@query(
    "cosine_plus_one",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS query, b.id AS doc, list_cosine_similarity(a.v, b.v) + 1 AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 10""",
    cte=False,
)
def cosine_plus_one(spark, sf):
    """The vector fallback: cosine plus one, so that every score is positive; not floored at zero first."""
    v = _vectors(spark, sf)
    return S.nearest(v.where("id % 100 = 0"), v, 10, least=-1.0).select("query", "doc", F.round(F.col("score") + 1, 6).alias("score"), "rank")


@query(
    "enriched_context_search",
    f"""+ q AS (SELECT query, g, count(*) AS x FROM (SELECT name AS query, unnest({GRAMS.format('name')}) AS g FROM (SELECT DISTINCT name FROM mentions)) GROUP BY ALL),
d AS (SELECT doc, g, count(*) AS y FROM (SELECT entity_id AS doc, unnest({GRAMS.format('description')}) AS g FROM wl) GROUP BY ALL),
nq AS (SELECT query, sqrt(sum(x * x)) AS nx FROM q GROUP BY query), nd AS (SELECT doc, sqrt(sum(y * y)) AS ny FROM d GROUP BY doc),
s AS (SELECT query, doc, sum(x * y) / any_value(nx * ny) AS score FROM q JOIN d USING (g) JOIN nq USING (query) JOIN nd USING (doc) GROUP BY query, doc)
SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 5""",
)
def enriched_context_search(spark, sf):
    q = mentions(spark, sf).select(F.col("name").alias("query")).distinct()
    d = E.keep_description(entities(spark, sf)).select(F.col("entity_id").alias("doc"), F.col("context").alias("text"))
    return S.trigram_nearest(q, d, 5).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(
    "robust_probe",
    f"""+ f AS (SELECT entity_id, unnest([name, entity_id, description, entity_type] || aliases) AS f FROM wl), p AS (SELECT DISTINCT name AS probe FROM mentions)
SELECT probe, count(DISTINCT entity_id) AS hits FROM p LEFT JOIN f ON f.f = p.probe OR (len({tok('p.probe')}) > 0 AND list_has_all({tok('f.f')}, {tok('p.probe')})) GROUP BY probe""",
)
def robust_probe(spark, sf):
    return R.probe_hits(mentions(spark, sf).select(F.col("name").alias("probe")), entities(spark, sf), ["name", "entity_id", "description", "entity_type", "aliases"])


# --- projections, join-backs, verification --------------------------------------------------------------------------


@query("article_preview", "SELECT doc_id AS id, length(coalesce(text, '')) AS content_length, length(coalesce(source, '')) AS title_length, doc_id % 3 = 0 AS has_url, lang IS NOT NULL AND length(lang) > 0 AS has_published_date FROM documents", cte=False)
def article_preview(spark, sf):
    d = parquet(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "http://a/b").alias("url"), F.col("lang").alias("published_date"))
    p = R.preview(d)
    return p.select("id", F.col("content_length").cast("long").alias("content_length"), F.col("title_length").cast("long").alias("title_length"), "has_url", "has_published_date")


@query("match_flatten", f"+ {CASCADE} SELECT m.article_id, m.mention_id, c.entity_id, c.confidence FROM cas c JOIN mentions m USING (mention_id)")
def match_flatten(spark, sf):
    found = C.cascade(mentions(spark, sf), entities(spark, sf))
    nested = found.groupBy("article_id").agg(F.collect_list(F.struct("mention_id", "entity_id", "confidence")).alias("matches"))
    return R.flatten_matches(nested)


EXPLAIN = "CASE p_partkey % 4 WHEN 0 THEN 'the names are equal in ' || p_brand WHEN 1 THEN 'short' WHEN 2 THEN NULL ELSE p_type || ' beside it' END"


@query("explained_matches", f"SELECT p_partkey AS pair_id, {EXPLAIN} AS explanation FROM part WHERE length({EXPLAIN}) > 10", cte=False)
def explained_matches(spark, sf):
    return R.explained(parquet(spark, sf, "part").selectExpr("p_partkey AS pair_id", f"{EXPLAIN} AS explanation"))


@query(
    "explanation_join",
    f"+ j AS (SELECT mention_id AS pair_id, m.name AS mention, w.name AS watched, {EXPLAIN} AS explanation FROM mentions m JOIN wl w ON entity = entity_id JOIN part ON p_partkey = mention_id WHERE p_partkey % 4 <> 3), o AS (SELECT mention, watched, arg_min(explanation, pair_id) FILTER (explanation IS NOT NULL) AS explanation FROM j WHERE explanation IS NOT NULL GROUP BY ALL) SELECT m.mention_id, o.explanation FROM mentions m JOIN wl w ON entity = entity_id LEFT JOIN o ON o.mention = m.name AND o.watched = w.name",
)
def explanation_join(spark, sf):
    m = mentions(spark, sf).join(entities(spark, sf).select(F.col("entity_id").alias("entity"), F.col("name").alias("watched")), "entity").select("mention_id", F.col("name").alias("mention"), "watched")
    judged = m.join(parquet(spark, sf, "part").where("p_partkey % 4 <> 3").selectExpr("p_partkey AS mention_id", f"{EXPLAIN} AS explanation"), "mention_id").where("explanation IS NOT NULL")
    return R.explanation_join(m, judged.withColumnRenamed("mention_id", "pair_id")).select("mention_id", "explanation")


@query("type_lookup", "SELECT mention_id, coalesce(upper(w.entity_type), 'PERSON') AS entity_type FROM mentions m LEFT JOIN wl w ON m.name = w.name")
def type_lookup(spark, sf):
    m = mentions(spark, sf).select("mention_id", F.col("name").alias("watched"))
    return R.typed(m, entities(spark, sf)).select("mention_id", "entity_type")


@query("indexing_verification", "SELECT 100::BIGINT AS expected, count(*) AS actual, count(*) FILTER (contains(name, 'red')) AS hits, count(*) >= 100 OR count(*) FILTER (contains(name, 'red')) > 0 AS success FROM wl")
def indexing_verification(spark, sf):
    return R.indexing_check(entities(spark, sf), 100, F.contains(F.col("name"), F.lit("red")))


@query("extraction_tallies", "SELECT method, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.6) AS low FROM mentions GROUP BY method")
def extraction_tallies(spark, sf):
    return R.tallies(mentions(spark, sf))


@query("entity_statistics", "SELECT count(*) AS entities, count(DISTINCT entity_type) AS types, count(DISTINCT priority) AS priorities, sum(len(aliases))::BIGINT AS aliases, avg(len(aliases)) AS mean_aliases FROM wl")
def entity_statistics(spark, sf):
    return R.entity_statistics(entities(spark, sf))


@query(
    "batch_answers_padded",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0.1e0 ELSE least(1e0, (p_size % 12) / 10e0) END AS confidence, p_partkey % 4 <> 3 AND least(1e0, (p_size % 12) / 10e0) > 0.5 AS is_match, CASE WHEN p_partkey % 4 = 3 THEN 'unlikely' ELSE 'semantic' END AS match_type FROM part",
    cte=False,
)
def batch_answers_padded(spark, sf):
    """A judge that is asked four pairs at a time and leaves out the last one."""
    p = parquet(spark, sf, "part")
    pairs = p.select("p_partkey", F.floor(F.col("p_partkey") / 4).alias("batch"), (F.col("p_partkey") % 4).alias("place"))
    given = p.where("p_partkey % 4 <> 3").select(F.floor(F.col("p_partkey") / 4).alias("batch"), (F.col("p_partkey") % 4).alias("place"), ((F.col("p_size") % 12) / 10.0).alias("confidence"), F.lit(None).cast("boolean").alias("is_match"), F.lit("semantic").alias("match_type"), F.lit("close in meaning").alias("reasoning"), F.array(F.lit("context")).alias("key_evidence"))
    return R.padded_answers(pairs, given).select("p_partkey", "confidence", "is_match", "match_type")


@query("health_check", "SELECT * FROM (SELECT 'part' AS name, count(*) AS rows, '' AS missing, count(*) > 0 AS healthy FROM part) UNION ALL SELECT 'wl', count(*), 'context', false FROM wl")
def health_check(spark, sf):
    return R.health({"part": parquet(spark, sf, "part"), "wl": entities(spark, sf)}, {"part": ["p_partkey"], "wl": ["name", "context"]})


@query("sample_matches")
def sample_matches(spark, sf):
    """All documents and the built-in articles against the built-in watch list, by name and alias; the expected pairs are in the tests."""
    e = sample_entities(spark).withColumn("entity_id", T.slug("name"))
    surfaces = e.select("entity_id", F.explode(F.array_append("aliases", F.col("name"))).alias("surface"))
    documents = parquet(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("article_id"), "text")
    return X.gazetteer(sample_articles(spark).select("article_id", "text").unionByName(documents), surfaces).select("article_id", "entity_id", "name", "position")


# --- retrieval over enriched entities, the analyser -----------------------------------------------------------------


@query(
    "enriched_context_columns",
    f"""+ q AS (SELECT query, g, count(*) AS x FROM (SELECT query, unnest({GRAMS.format('query')}) AS g FROM (SELECT DISTINCT p_type AS query FROM part WHERE p_type IS NOT NULL)) GROUP BY ALL),
d AS (SELECT doc, g, count(*) AS y FROM (SELECT entity_id AS doc, unnest({GRAMS.format('description')}) AS g FROM wl) GROUP BY ALL),
nq AS (SELECT query, sqrt(sum(x * x)) AS nx FROM q GROUP BY query), nd AS (SELECT doc, sqrt(sum(y * y)) AS ny FROM d GROUP BY doc),
s AS (SELECT query, doc, sum(x * y) / any_value(nx * ny) AS score FROM q JOIN d USING (g) JOIN nq USING (query) JOIN nd USING (doc) GROUP BY query, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank FROM s)
SELECT query, rank, wl.name, wl.description AS context, 1e0 AS confidence, 'Original Description' AS source, round(score, 6) AS score FROM r JOIN wl ON wl.entity_id = r.doc WHERE rank <= 10""",
)
def enriched_context_columns(spark, sf):
    q = parquet(spark, sf, "part").where("p_type IS NOT NULL").select(F.col("p_type").alias("query")).distinct()
    found = S.enriched_search(q, E.keep_description(entities(spark, sf)), 10)
    return found.select("query", "rank", "name", "context", "confidence", "source", F.round("score", 6).alias("score"))


@query(
    "cosine_fallback",
    f"""WITH {BM25}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS query, b.id AS doc, list_cosine_similarity(a.v, b.v) + 1 + coalesce(sc.score, 0) AS score FROM v a JOIN v b ON a.id <> b.id LEFT JOIN sc ON sc.query = a.id AND sc.doc = b.id WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank FROM s)
SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    cte=False,
)
def cosine_fallback(spark, sf):
    v = _vectors(spark, sf)
    return S.cosine_fallback(v.where("id % 100 = 0"), v, _index(spark, sf, "documents").scores(_items(spark, sf), {"text": 1.0}), 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
ACCENTED = "'The ' || p_name || ' of São Öre and ' || p_brand"


@query("analysed_tokens", f"SELECT p_partkey, array_to_string(list_filter({tok(f'strip_accents({ACCENTED})')}, lambda t: t NOT IN ({STOPS})), ' ') AS terms FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL")
def analysed_tokens(spark, sf):
    p = parquet(spark, sf, "part").where("p_name IS NOT NULL AND p_brand IS NOT NULL")
    return p.select("p_partkey", F.array_join(T.analysed(F.expr(ACCENTED)), " ").alias("terms"))
