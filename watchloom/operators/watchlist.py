"""The watch list as a table: ids, surfaces, changes, statistics. Joins go by entity_id, never by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.text import contextual_text, slug, strip_parentheses
from watchloom.operators.ranks import ranked


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_wl_place", n).where("_wl_place = 1").drop("_wl_place")


def add(rows: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """First row of each (name, description) stays, so that namesakes with other descriptions survive."""
    return first_wins(rows, keys or ["name", "description"], [order])


def with_ids(rows: DataFrame, order: str, first: int = 1, until_parenthesis: bool = False) -> DataFrame:
    """entity_id: the name's slug and a number among equal slugs, from ``first``. Numbers come from ranges and prefix sums, so a slug that
    many rows share is no task of its own."""
    base = slug(F.trim(F.substring_index("name", "(", 1)) if until_parenthesis else F.col("name"))
    numbered = ranked(rows.withColumn("_slug", base), ["_slug"], [F.col(order).asc()], "_n").withColumn("_n", F.col("_n") - 1 + first)
    n = F.col("_n").cast("string")
    return numbered.withColumn("entity_id", F.concat("_slug", F.lit("_"), F.when(F.col("_n") < 1000, F.lpad(n, 3, "0")).otherwise(n))).drop("_slug", "_n")


def index_rows(entities: DataFrame) -> DataFrame:
    """What is searched: cleaned and lowered name, contextual text."""
    clean = strip_parentheses("name")
    return entities.withColumns({"clean_name": clean, "name_lower": F.lower(clean), "search_text": contextual_text("name", "context", "description")})


def surfaces(entities: DataFrame) -> DataFrame:
    """(surface, kind, entity_id): every name and alias once; names come before aliases, then the lesser id."""
    names = entities.select(F.col("name").alias("surface"), F.lit("name").alias("kind"), "entity_id", F.lit(0).alias("_rank"))
    aliases = entities.select(F.explode("aliases").alias("surface"), F.lit("alias").alias("kind"), "entity_id", F.lit(1).alias("_rank"))
    return first_wins(names.unionByName(aliases), ["surface"], ["_rank", "entity_id"]).drop("_rank")


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last write of each key wins."""
    return first_wins(rows, [key], [F.col(order).desc()])


def remove(entities: DataFrame, gone: DataFrame, key: str = "entity_id") -> DataFrame:
    return entities.join(gone.select(key).distinct(), key, "left_anti")


def update(entities: DataFrame, changes: DataFrame, columns: list[str], key: str = "entity_id") -> DataFrame:
    """New values where ``changes`` has one; null leaves the old value."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = entities.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def contains(probes: DataFrame, entities: DataFrame, probe: str) -> DataFrame:
    """Probes that are an id, a name or an alias of the list."""
    known = entities.select(F.col("entity_id").alias("_k")).union(entities.select("name")).union(entities.select(F.explode("aliases")))
    return probes.join(known, F.col(probe) == F.col("_k"), "left_semi")


def stats(entities: DataFrame) -> DataFrame:
    """Counts and aliases by priority, by type and in all, in one pass of grouping sets."""
    e = entities.withColumn("_a", F.size("aliases"))
    sets = e.groupingSets([["priority"], ["entity_type"], []], "priority", "entity_type")
    return sets.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("_a").alias("aliases")).select(
        F.when(F.col("_g") == 1, "priority").when(F.col("_g") == 2, "type").otherwise("all").alias("kind"), F.coalesce("priority", "entity_type", F.lit("all")).alias("value"), "n", "aliases"
    )


def display(entities: DataFrame) -> DataFrame:
    p = F.coalesce("priority", F.lit("medium"))
    level = F.when(p == "high", 3).when(p == "medium", 2).otherwise(1)
    return entities.select("name", "entity_type", F.size("aliases").alias("alias_count"), (F.length(F.coalesce("description", F.lit(""))) > 0).alias("has_description"), p.alias("priority"), level.alias("priority_level"))


def enrich(entities: DataFrame) -> DataFrame:
    """Context by the cascade: an explicit one, else the description, else a plain sentence; with confidence and source."""
    one = lambda text, conf, source: F.when(F.length(F.trim(text)) > 0, F.struct(text.alias("context"), F.lit(conf).alias("confidence"), F.lit(source).alias("source")))
    plain = F.concat("name", F.lit(" is a notable "), F.coalesce("entity_type", F.lit("entity")), F.lit("."))
    best = F.coalesce(one(F.col("explicit_context"), 0.95, "Explicit Context"), one(F.col("description"), 0.8, "Entity Data"), one(plain, 0.3, "Fallback"))
    return entities.withColumn("_e", best).select("*", "_e.context", "_e.confidence", "_e.source").drop("_e")


def best_context(rows: DataFrame, key: str, context: str, description: str) -> DataFrame:
    """Of several contexts the one closest to the description by words; scored, but not if it is the only one."""
    from watchloom.functions.text import jaccard

    sim = jaccard(context, description)
    w = Window.partitionBy(key)
    conf = F.least(F.greatest(F.col("similarity"), F.lit(0.5)), F.lit(0.95))
    better = F.when(F.col("similarity") > 0.3, F.least(conf + 0.1, F.lit(0.95))).otherwise(conf)
    scored = rows.withColumns({"similarity": sim, "_n": F.count(F.lit(1)).over(w)})
    return first_wins(scored, [key], [F.col("similarity").desc(), context]).withColumn("confidence", F.when(F.col("_n") > 1, better)).drop("_n")


def disambiguation_confidence(title, text, name):
    """0.5; more for a title with the name and for a long text; less for a list of namesakes; within [0.1, 1]."""
    c = F.lit(0.5) + F.when(F.contains(F.lower(title), F.lower(name)), 0.3).otherwise(0.0)
    c += F.when(F.length(text) > 500, 0.2).when(F.length(text) > 200, 0.1).otherwise(0.0)
    c -= F.when(F.contains(F.lower(title), F.lit("disambiguation")), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))
