"""Context for watch-list entities, and the providers that stand for outside services.

A provider is a function from rows to rows: a context provider from (name, language) to candidate contexts, an extractor from
articles to mentions, an encoder from texts to vectors. Each has a deterministic default that needs no network; a model or a
service is passed in as a function over pandas frames, which runs in the executors batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.scan import SCHEMES, back, romaji, transduce
from watchloom.functions.text import col, language_order
from watchloom.operators.search import trigrams
from watchloom.operators.watchlist import disambiguation_confidence

CONTEXTS = "name string, title string, context string, language string, source string"
MENTIONS = "article_id string, name string, category string, start int, stop int, confidence double"


def foreign(rows: DataFrame, of: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A service or model as a provider: ``of`` gets batches of rows and returns rows of ``schema``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield of(p)

    return rows.mapInPandas(run, schema)


def table_contexts(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The default context provider: look-ups in a table of (title, context, language, source) by the folded title."""
    held = pages.select("title", "context", "language", "source", F.lower(F.trim("title")).alias("_k"))
    return lambda names: names.select("name", F.lower(F.trim("name")).alias("_k")).distinct().join(held, "_k").drop("_k")


def with_contexts(entities: DataFrame, provider: Callable[[DataFrame], DataFrame], least: float = 0.7) -> DataFrame:
    """Entities with ``context``, ``confidence``, ``source``: the best context found at ``least`` or more, else their own."""
    found = disambiguated(provider(entities.select("name").distinct())).where((F.col("rank") == 1) & (F.col("confidence") >= least))
    found = found.select("name", F.col("context").alias("_c"), F.col("confidence").alias("_f"), F.col("source").alias("_s"))
    own = F.struct(F.col("description").alias("context"), F.lit(0.8).alias("confidence"), F.lit("Entity Data").alias("source"))
    best = F.coalesce(F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("context"), F.col("_f").alias("confidence"), F.col("_s").alias("source"))), own)
    return entities.join(found, "name", "left").withColumn("_b", best).drop("_c", "_f", "_s").select("*", "_b.context", "_b.confidence", "_b.source").drop("_b")


def disambiguated(contexts: DataFrame) -> DataFrame:
    """Contexts of a name ranked by confidence (then language order, then title)."""
    c = contexts.withColumn("confidence", disambiguation_confidence(F.col("title"), F.col("context"), F.col("name")))
    place = F.array_position(language_order(F.lit("en")), F.col("language"))
    order = Window.partitionBy("name").orderBy(F.col("confidence").desc(), F.when(place > 0, place).otherwise(F.lit(99)), "title")
    return c.withColumn("rank", F.row_number().over(order))


def alternatives(ranked: DataFrame) -> DataFrame:
    """(name, title, confidence, alternatives): the first context of a name and the titles of the others, in order."""
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "title")))), lambda x: x.title)
    first = [F.min_by(c, "rank").alias(c) for c in ("title", "confidence")]
    return ranked.groupBy("name").agg(*first, others.alias("alternatives"))


def keep_description(entities: DataFrame) -> DataFrame:
    """The mode that takes the description as it is for the context, with full confidence."""
    return entities.withColumns({"context": F.col("description"), "confidence": F.lit(1.0), "source": F.lit("Original Description")})


def summary(context, source, confidence) -> Column:
    """What is shown of an enrichment: length, whether it is from an encyclopedia, confidence (0.8 if unknown)."""
    wide = F.coalesce(F.contains(col(source), F.lit("Wikipedia")) | F.contains(col(source), F.lit("Primary")), F.lit(False))
    return F.struct(F.length(F.coalesce(col(context), F.lit(""))).alias("context_length"), wide.alias("has_wikipedia"), F.coalesce(col(confidence), F.lit(0.8)).alias("confidence"))


def corrected(text, words: dict[str, str], parts: dict[str, str]) -> Column:
    """A romanised text: whole words replaced by the first table, then substrings by the second; capitalised if it changed."""
    t = col(text)
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else None
    fixed = F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(known[F.lower(w)], w)), " ") if words else t
    fixed = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), parts.items(), fixed)
    return F.when(fixed != t, F.initcap(fixed)).otherwise(t)


def to_latin(text, scheme: dict[str, str]) -> Column:
    """In lower case, the longest key first; letters that the scheme lacks stay."""
    return transduce(text, scheme)


def from_latin(text, scheme: dict[str, str]) -> Column:
    """The way back, longest Latin forms first; a form that several letters share goes to the first of them."""
    return transduce(text, back(scheme))


def transliterations(text, schemes: dict[str, dict[str, str]] | None = None) -> Column:
    """The distinct forms of a text under all schemes, to and from Latin, and as romaji, without the text itself."""
    schemes = SCHEMES if schemes is None else schemes
    forms = [f(text, s) for s in schemes.values() for f in (to_latin, from_latin)]
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms, romaji(text)), lambda x: x != F.lower(col(text)))))


def hashed_vector(text, dims: int = 64) -> Column:
    """The default encoder: counts of character trigrams by hash, of unit length."""
    places = F.transform(trigrams(col(text)), lambda g: F.pmod(F.xxhash64(g), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def with_embeddings(rows: DataFrame, text: str, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with ``vector``; ``encoder`` is a function from a text column to an array column (a pandas UDF for a model)."""
    return rows.withColumn("vector", (encoder or hashed_vector)(F.col(text)))


def with_mentions(articles: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(article_id, name, category, start, stop, confidence) by any extractor, checked against the article's text."""
    found = extractor(articles).select(*[x.split()[0] for x in MENTIONS.split(", ")])
    both = found.join(articles.select(F.col("article_id").cast("string").alias("article_id"), "text"), "article_id")
    return both.where(F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("name")).drop("text")
