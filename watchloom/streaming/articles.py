"""Articles enriched as they are written: a stream of versions of articles into a table of their entities by class.

A row is checked first; what fails goes to the dead letters of its micro-batch with the reason. The state is the table itself: a
micro-batch keeps each article's highest version and joins it to the versions that the table has (two columns of it), so repeated and older
versions are dropped at once, however late they come (a watermark would drop late rows that are newer, too), and no call is made for each article. What is
left is extracted and written as a layer of the table (``sources.layers``), which keeps of each article the highest version whatever the order of
layers is. Rows of one article and version are taken for equal. A micro-batch that is replayed after a
crash finds its number in the table's log and changes nothing; its dead letters are written over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators.spans import extract
from watchloom.sources.layers import LayeredTable
from watchloom.sources.scratch import Store

COLUMNS = "article_id long, version long, ts timestamp, text string"
ENTITIES = "version long, n_spans int, by_class map<string,array<string>>"


def checked(articles: DataFrame) -> DataFrame:
    """Articles with ``_error``: null, or what is wrong with the row."""
    error = F.when(F.col("article_id").isNull(), "no article_id").when(F.col("version").isNull(), "no version").when(F.col("text").isNull(), "no text")
    return articles.select("article_id", "version", "ts", "text").withColumn("_error", error)


def newest(good: DataFrame, held: DataFrame) -> DataFrame:
    """Of articles without an error each article's highest version, where it is newer than what ``held`` (article_id, version) has."""
    best = good.groupBy("article_id").agg(F.max_by(F.struct("version", "ts", "text"), "version").alias("b")).select("article_id", "b.*")
    seen = held.select("article_id", F.col("version").alias("_seen"))
    return best.join(seen, "article_id", "left").where("_seen IS NULL OR version > _seen").drop("_seen")


def entities(articles: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(article_id, version, n_spans, by_class): the spans of each article, their distinct names sorted by kind."""
    spans = extract(articles.select("article_id", "version", "text"), extractor=extractor)
    kinds = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s.kind)))
    names = lambda k: F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s.kind == k), lambda s: s["name"])))
    return spans.select("article_id", "version", F.size("spans").alias("n_spans"), F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, names(k)))).alias("by_class"))


def latest(articles: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What the table holds in the end, made in one batch."""
    good = checked(articles).where("_error IS NULL")
    best = good.groupBy("article_id").agg(F.max_by(F.struct("version", "text"), "version").alias("b")).select("article_id", "b.*")
    return entities(best, extractor)


def table(spark, folder: str) -> LayeredTable:
    return LayeredTable(spark, folder, "article_id", ENTITIES, "long", newest_by="version")


def run(stream: DataFrame, into: LayeredTable, dead_letters: str, checkpoint: str, extractor: Callable[[DataFrame], DataFrame] | None = None, name: str = "articles"):
    """Starts the stream over what is there now; returns the query. ``dead_letters`` gets a folder for each micro-batch."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.where("_error IS NOT NULL").write.mode("overwrite").parquet(f"{dead_letters}/batch={batch}")
        store = Store(rows.sparkSession, "batch")
        found = entities(store.put(newest(rows.where("_error IS NULL"), into.read()), "rows"), extractor)
        into.apply(found.withColumns({"op": F.lit("upsert"), "seq": F.col("version")}), token=(name, batch))
        store.drop("rows")

    return checked(stream).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
