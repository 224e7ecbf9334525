"""Candidate generation: which entities a mention may mean. Mentions: mention_id, name, ...; entities: the watch list.

Work is done once per distinct mention name and joined back, which is what a cache of candidates does in a row engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.text import auto_fuzziness, edit_similarity
from watchloom.operators.search import edit_keys, edit_probes
from watchloom.operators.watchlist import first_wins
from watchloom.sources.scratch import Store

BLOCK = 4


def exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Case-sensitive equality of names; of namesakes the lesser id."""
    e = first_wins(entities.select("entity_id", F.col("name").alias("_n")), ["_n"], ["entity_id"])
    return mentions.join(e, mentions.name == F.col("_n")).drop("_n").withColumns({"match_type": F.lit("exact"), "confidence": F.lit(1.0)})


def alias(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    a = first_wins(entities.select("entity_id", F.explode("aliases").alias("_a")), ["_a"], ["entity_id"])
    return mentions.join(a, mentions.name == F.col("_a")).drop("_a").withColumns({"match_type": F.lit("alias"), "confidence": F.lit(0.9)})


def cascade(mentions: DataFrame, entities: DataFrame, hybrid=None, most: int = 2) -> DataFrame:
    """Each mention's candidates by the first stage that has any: exact, alias, then ``hybrid`` (a function of the distinct
    names still open, giving name, entity_id, score), of which the best ``most`` stay."""
    names = mentions.select("name").distinct()
    e = exact(names, entities)
    left = names.join(e, "name", "left_anti")
    a = alias(left, entities)
    found = e.unionByName(a)
    if hybrid is not None:
        h = hybrid(left.join(a, "name", "left_anti"))
        n = F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "entity_id"))
        h = h.withColumn("_n", n).where(F.col("_n") <= most)
        found = found.unionByName(h.select("name", "entity_id", F.lit("hybrid").alias("match_type"), F.col("score").alias("confidence")))
    return mentions.drop("match_type", "confidence").join(found, "name")


def unmatched(mentions: DataFrame, found: DataFrame) -> DataFrame:
    return mentions.join(found, "mention_id", "left_anti")


def _edit_pairs(names: DataFrame, entities: DataFrame, head) -> DataFrame:
    """(name, _q, entity_id, entity, _e): pairs with equal ``head`` that may be within two edits, from an equi-join on keys."""
    n = names.select("name", F.lower("name").alias("_q")).withColumn("_k", F.explode(F.transform(edit_probes(F.col("_q")), lambda k: F.concat(head("_q"), F.lit("|"), k))))
    e = entities.select("entity_id", F.col("name").alias("entity"), F.lower("name").alias("_e")).withColumn("_k", F.explode(F.array_distinct(F.transform(edit_keys(F.col("_e")), lambda k: F.concat(head("_e"), F.lit("|"), k)))))
    return n.distinct().join(e, "_k").drop("_k").distinct()


def fuzzy(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Names within the edits that their length allows, the first letter being equal."""
    both = _edit_pairs(names, entities, lambda c: F.left(F.col(c), F.lit(1))).where(F.levenshtein("_q", "_e", 2) >= 0).withColumn("distance", F.levenshtein("_q", "_e"))
    return both.where(F.col("distance") <= auto_fuzziness("_q")).select("name", "entity_id", "distance", edit_similarity("_q", "_e").alias("similarity"))


def edit_topk(names: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """The k closest by edit similarity among entities that share a token with the name."""
    from watchloom.functions.text import tokens

    n = names.select("name", F.explode(F.array_distinct(tokens("name"))).alias("_t"))
    e = entities.select("entity_id", F.col("name").alias("entity"), F.explode(F.array_distinct(tokens("name"))).alias("_t"))
    pairs = n.join(e, "_t").select("name", "entity_id", "entity").distinct()
    s = pairs.withColumn("similarity", edit_similarity(F.lower("name"), F.lower("entity")))
    r = F.row_number().over(Window.partitionBy("name").orderBy(F.col("similarity").desc(), "entity_id"))
    return s.withColumn("rank", r).where(F.col("rank") <= k)


def phonetic(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Same sound of the first token, at most two edits."""
    both = _edit_pairs(names, entities, lambda c: F.soundex(F.substring_index(F.col(c), " ", 1)))
    return both.where(F.levenshtein("_q", "_e", 2) >= 0).select("name", "entity_id")


def contained(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose name stands anywhere in an article's text.

    Blocked by a name's rarest gram of ``BLOCK`` characters, which a text that contains the name contains too; a name with a
    gram that no text has is in no text. Only (article, gram) rows meet the grams; texts are fetched for what is left, and
    the test itself decides. Shorter names block on all their characters, so nothing is lost. Equal texts are looked at once, and
    their articles joined back.
    """
    texts = articles.select("text").where("text IS NOT NULL").distinct().withColumn("article_id", F.monotonically_increasing_id())
    found = _contained(Store(articles.sparkSession, "contained").put(texts, "texts"), entities)
    return articles.select("article_id", "text").join(found, "text").select("article_id", "entity_id")


def _contained(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """(text, entity_id) of distinct texts; article_id: a number of each."""
    places = lambda t, n: F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
    grams = lambda t, n: F.array_distinct(F.transform(places(t, n), lambda i: F.substring(t, i, F.lit(n))))
    sizes = sorted(r.n for r in entities.select(F.least(F.length("name"), F.lit(BLOCK)).alias("n")).where("n > 0").distinct().collect())  # at most BLOCK
    every = F.flatten(F.array(*[grams(F.col("text"), n) for n in sizes or [BLOCK]]))
    a = articles.select("article_id", F.explode(F.array_distinct(every)).alias("_g"))
    n = F.least(F.length("name"), F.lit(BLOCK))
    e = entities.where(F.length("name") > 0).select("entity_id", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n)))).alias("_g"))
    often = a.join(e.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rare = e.join(often, "_g", "left").groupBy("entity_id", "name").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    pairs = a.join(rare, "_g").select("article_id", "entity_id", "name")
    return pairs.join(articles.select("article_id", "text"), "article_id").where(F.contains("text", "name")).select("text", "entity_id")


def dedup(found: DataFrame, order: list[str]) -> DataFrame:
    """One row for each mention name, context and entity; the first in the given order."""
    return first_wins(found.withColumn("_c", F.coalesce("context", F.lit(""))), ["name", "_c", "entity_id"], order).drop("_c")
