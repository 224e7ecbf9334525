"""Projections of stored results, join-backs, verification and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.text import tokens


def preview(articles: DataFrame) -> DataFrame:
    """What is shown of articles before processing. articles: id, title, content, url, published_date."""
    some = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return articles.select("id", size("content").alias("content_length"), size("title").alias("title_length"), some("url").alias("has_url"), some("published_date").alias("has_published_date"))


def flatten_matches(articles: DataFrame, matches: str = "matches") -> DataFrame:
    """One row for each match of an article; articles without any have none."""
    rows = articles.select("article_id", F.explode_outer(matches).alias("_m")).where("_m IS NOT NULL")
    return rows.select("article_id", "_m.*")


def explained(matches: DataFrame, least: int = 10) -> DataFrame:
    """Matches with an explanation of more than ``least`` characters."""
    return matches.where(F.col("explanation").isNotNull() & (F.length("explanation") > least))


def explanation_join(matches: DataFrame, judged: DataFrame) -> DataFrame:
    """Matches with the stored explanation of their pair of names, whatever the article; of several the least pair id's."""
    one = judged.groupBy("mention", "watched").agg(F.min_by("explanation", "pair_id").alias("explanation"))
    return matches.join(one, ["mention", "watched"], "left")


def typed(mentions: DataFrame, entities: DataFrame, default: str = "PERSON") -> DataFrame:
    """Mentions with the type of the watch-list name they were matched to, or the default."""
    e = entities.groupBy(F.col("name").alias("watched")).agg(F.min(F.upper("entity_type")).alias("entity_type"))
    return mentions.join(e, "watched", "left").withColumn("entity_type", F.coalesce("entity_type", F.lit(default)))


def indexing_check(indexed: DataFrame, expected: int, probe: Column) -> DataFrame:
    """One row: whether all expected rows are there, or at least one answers a probe."""
    c = indexed.agg(F.count(F.lit(1)).alias("actual"), F.count_if(F.coalesce(probe, F.lit(False))).alias("hits"))
    return c.select(F.lit(expected).cast("long").alias("expected"), "actual", "hits", ((F.col("actual") >= expected) | (F.col("hits") > 0)).alias("success"))


def tallies(mentions: DataFrame) -> DataFrame:
    """Counts of high (0.8), medium (0.6) and low confidence by method."""
    c = F.col("confidence")
    return mentions.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(F.coalesce(c < 0.6, F.lit(True))).alias("low"))


def entity_statistics(entities: DataFrame) -> DataFrame:
    """One row: entities, types, priorities, aliases in all and on average."""
    a = F.size(F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("entity_type").alias("types"), F.count_distinct("priority").alias("priorities"), F.sum(a).alias("aliases"), F.avg(a).alias("mean_aliases"))


def probe_hits(probes: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """(probe, hits): entities of which a field equals the probe or holds all its words. Array fields count by their items.

    Equal fields and first words meet by an equi-join on keys: a field that holds all words holds the probe's first.
    """
    texts = F.flatten(F.array(*[F.col(f) if entities.schema[f].dataType.typeName() == "array" else F.array(F.col(f)) for f in fields]))
    e = entities.select("entity_id", F.explode(F.array_distinct(F.array_compact(texts))).alias("_f"))
    held = e.select("entity_id", "_f", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "_f")), F.transform(tokens("_f"), lambda t: F.concat(F.lit("t"), t))))).alias("_k"))
    first = F.concat(F.lit("t"), F.try_element_at(tokens("probe"), F.lit(1)))
    asked = probes.select("probe").distinct().withColumn("_k", F.explode(F.array_compact(F.array(F.concat(F.lit("="), "probe"), first))))
    fits = (F.col("_f") == F.col("probe")) | ((F.size(tokens("probe")) > 0) & (F.size(F.array_except(tokens("probe"), tokens("_f"))) == 0))
    hits = asked.join(held, "_k").where(fits).groupBy("probe").agg(F.count_distinct("entity_id").alias("hits"))
    return probes.select("probe").distinct().join(hits, "probe", "left").select("probe", F.coalesce("hits", F.lit(0)).alias("hits"))


def padded_answers(pairs: DataFrame, answers: DataFrame, confidence: float = 0.1) -> DataFrame:
    """Results of a judge that answers a batch in order: pairs (batch, place) with their answer, or a fallback where the
    batch came back too short. answers: batch, place, five fields."""
    both = pairs.join(answers, ["batch", "place"], "left")
    missing = F.col("match_type").isNull()
    return both.withColumns({
        "confidence": F.when(missing, F.lit(confidence)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(confidence))))),
        "is_match": F.when(missing, F.lit(False)).otherwise(F.coalesce("is_match", F.col("confidence") > 0.5)),
        "match_type": F.coalesce("match_type", F.lit("unlikely")),
        "reasoning": F.coalesce("reasoning", F.lit("no answer for this pair")),
        "key_evidence": F.coalesce("key_evidence", F.array().cast("array<string>")),
    })


def health(tables: dict[str, DataFrame], needed: dict[str, list[str]]) -> DataFrame:
    """(name, rows, missing, healthy) of each table: its rows, and the needed columns that it lacks."""
    every = None
    for name, df in tables.items():
        missing = [c for c in needed.get(name, []) if c not in df.columns]
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(missing)).alias("missing"))
        every = row if every is None else every.unionByName(row)
    return every.withColumn("healthy", (F.col("rows") > 0) & (F.col("missing") == ""))


def consistent(*schemas: dict[str, set[str] | list[str]]) -> bool:
    """Whether schemas of a result (field -> allowed values) say the same."""
    plain = [{k: sorted(v) for k, v in s.items()} for s in schemas]
    return all(s == plain[0] for s in plain)
