"""Registered queries of tables that are kept up to date and of stages with a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators import candidates as C
from watchloom.plans.fixtures import entities, mentions
from watchloom.plans.queries import CASCADE, query
from watchloom.sources.layers import LayeredTable
from watchloom.sources.scratch import Store
from watchloom.sources.tables import Stages, parquet
from watchloom.streaming import articles as A

#: A stream of changes: four for each entity over three batches, some of them deletions, some that are errors.
CHANGE = {
    "entity": "CAST(floor(p_partkey / 4) AS BIGINT)",
    "batch": "CAST(p_partkey % 3 AS INT)",
    "seq": "p_partkey",
    "op": "CASE WHEN p_size % 11 = 0 THEN 'rename' WHEN p_size % 7 = 0 THEN 'delete' ELSE 'upsert' END",
    "name": "CASE WHEN p_partkey % 13 > 0 THEN p_name END",
    "price": "p_retailprice",
}
CHANGES = f"c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CHANGE.items())} FROM part), ok AS (SELECT * FROM c WHERE op = 'delete' OR op = 'upsert' AND name IS NOT NULL)"


def _table(spark, sf) -> tuple[LayeredTable, list[DataFrame]]:
    changes = parquet(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in CHANGE.items()])
    return LayeredTable(spark, Store(spark, "layers").root, "entity", "name string, price double", "long"), [changes.where(F.col("batch") == b) for b in range(3)]


@query(
    "layered_watch_list",
    f"""WITH {CHANGES}, s AS (SELECT unnest([1, 2, 3]) AS step), l AS (SELECT step, ok.*, row_number() OVER (PARTITION BY step, entity ORDER BY batch DESC, seq DESC) AS n FROM s JOIN ok ON batch < step)
SELECT step, entity, name, price FROM l WHERE n = 1 AND op = 'upsert'""",
    cte=False,
)
def layered_watch_list(spark, sf):
    """The table after each of three batches; after the second the layers are compacted."""
    table, batches = _table(spark, sf)
    states = []
    for i, batch in enumerate(batches):
        table.apply(batch, required=("name",))
        if i == 1:
            table.compact()
        states.append(table.read().withColumn("step", F.lit(i + 1)))
    return reduce(DataFrame.unionByName, states).select("step", "entity", "name", "price")


@query("layered_results", f"WITH {CHANGES} SELECT c.batch, count(*) AS total, count(ok.seq) AS success, count(*) - count(ok.seq) AS errors, count(DISTINCT ok.entity) AS keys FROM c LEFT JOIN ok USING (seq) GROUP BY c.batch", cte=False)
def layered_results(spark, sf):
    table, batches = _table(spark, sf)
    rows = [(i, r["total"], r["success"], r["errors"], r["keys"]) for i, r in enumerate(table.apply(b, required=("name",)) for b in batches)]
    return spark.createDataFrame(rows, "batch int, total long, success long, errors long, keys long")


@query(
    "stage_store",
    f"""+ {CASCADE}, n AS (SELECT (SELECT count(*) FROM wl) AS e, (SELECT count(*) FROM mentions) AS m, (SELECT count(*) FROM cas) AS c, (SELECT count(DISTINCT article_id) FROM cas JOIN mentions USING (mention_id)) AS a)
SELECT unnest(['mentions', 'matches', 'articles', 'entities']) AS stage, unnest([m, c, a, e]) AS n_rows, unnest([1, 2, 3, 0]) AS place, unnest([false, true, false, false]) AS stale FROM n""",
)
def stage_store(spark, sf):
    """Four stages of a run, each with what it was made from; the entities are saved once more behind the matches made from them."""
    stages = Stages(spark, Store(spark, "stages").root)
    stages.save("entities", entities(spark, sf))
    stages.save("mentions", mentions(spark, sf))
    found = C.cascade(stages.load("mentions"), stages.load("entities"))
    stages.save("matches", found.select("mention_id", "article_id", "entity_id"), needs=["mentions", "entities"])
    stages.save("articles", stages.load("matches").groupBy("article_id").count(), needs=["matches"])
    stages.save("entities", stages.load("entities"))
    place = F.create_map(*[F.lit(x) for i, s in enumerate(sorted(stages.order(), key=["entities", "mentions", "matches", "articles"].index)) for x in (s, i)])
    return stages.manifest().select("stage", "n_rows", place[F.col("stage")].alias("place"), "stale")


#: Versions of articles as they come: three of each, some twice, some without a text.
VERSIONS = {
    "article_id": "CASE WHEN p_partkey % 41 > 0 THEN CAST(floor(p_partkey / 3) AS BIGINT) END",
    "version": "(p_partkey * 7) % 3",
    "text": "CASE WHEN p_partkey % 17 > 0 THEN 'The ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' senator met a mayor' WHEN 1 THEN ' general left' WHEN 2 THEN ' senator, senator' ELSE ' arrived' END || CASE WHEN p_partkey % 5 > 0 THEN '; Acme CEO' ELSE '.' END END",
}


@query(
    "stream_enriched_articles",
    f"""WITH v AS (SELECT {", ".join(f"{e} AS {c}" for c, e in VERSIONS.items())} FROM part), b AS (SELECT article_id, max(version) AS version, arg_max(text, version) AS text FROM v WHERE article_id IS NOT NULL AND text IS NOT NULL GROUP BY article_id)
SELECT article_id, version, len(regexp_extract_all(text, 'senator|mayor|general|Acme CEO'))::INT AS n_spans, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'senator|mayor|general'))), ',') AS titles, nullif(regexp_extract(text, 'Acme CEO'), '') AS compound FROM b""",
    cte=False,
)
def stream_enriched_articles(spark, sf):
    """The table that a stream over the parts leaves, which is what one batch over them gives."""
    store = Store(spark, "stream")
    source = spark.readStream.schema(parquet(spark, sf, "part").schema).parquet(f"{sf}/[p]art.parquet")  # a pattern: a stream takes no path of a single file
    rows = source.where("p_name IS NOT NULL").selectExpr(*[f"{e} AS {c}" for c, e in VERSIONS.items()], "timestamp_seconds(p_partkey) AS ts")
    table = A.table(spark, store.path("table"))
    A.run(rows, table, store.path("dead"), store.path("checkpoint")).awaitTermination()
    out = table.read()
    return out.select("article_id", "version", "n_spans", F.coalesce(F.array_join(F.col("by_class")["TITLE"], ","), F.lit("")).alias("titles"), F.get(F.col("by_class")["COMPOUND_TITLE"], F.lit(0)).alias("compound"))
