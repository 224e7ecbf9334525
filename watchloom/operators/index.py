"""A written inverted index: postings of any fields in blocks by impact, lengths and frequencies, and the documents' own terms.

A posting's impact is what BM25 makes of its frequency and its document's length; the term's rarity comes on top. The postings of a
term are sorted by impact and cut into blocks of ``BLOCK``, each block a row with its largest impact. Two tables of rows follow: the terms with
their document frequencies, and the forward table with each document's terms.

* ``scores`` adds up all postings of the queries' terms.
* ``top`` reads what it must. The first block of each of a query's terms gives documents with at least a part of their score, and the k-th
  best of these parts is a bound below the k-th best score. With n terms, a document that is only in blocks whose weight is under bound / n
  stays under the bound, so those blocks are skipped: of a frequent word usually all of them. The documents of the other blocks are
  scored in full from the forward table. The result is that of scoring everything.

No task holds a posting list: blocks of one term are dealt over ``PARTS`` parts of the join, their order comes from ranges and prefix
sums. Scores are equal whatever the blocks are, up to the order of additions.

Defined cases: null texts count as documents without terms; rows with a null id are left out; a query without a known term has no result;
repeated rows of an id are one document whose texts are read one after the other; an empty table gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.functions.text import tokens
from watchloom.operators.ranks import ranked
from watchloom.operators.search import K1, B, top
from watchloom.sources.scratch import Store

BLOCK, PARTS = 512, 8
SLACK = 1e-7  # scores that differ by less may be ties after rounding


@dataclass
class TextIndex:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @classmethod
    def build(cls, docs: DataFrame, doc: str, fields: dict[str, Column], folder: str | None = None, block: int = BLOCK) -> TextIndex:
        """Writes the index of ``fields`` (name: text) of ``docs``; without a folder into the scratch folder of this run."""
        spark = docs.sparkSession
        index = cls(spark, folder or Store(spark, "index").root)
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{index.folder}/{name}")
        every = F.array(*[F.struct(F.lit(f).alias("field"), tokens(text).alias("t")) for f, text in fields.items()])
        rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.explode(every).alias("x")).select("doc", "x.field", "x.t")
        # the texts of one id in any order: only counts are made of them
        long = rows.groupBy("doc", "field").agg(F.sum(F.coalesce(F.size("t"), F.lit(0))).alias("dl"))
        put(long, "lengths")
        put(index.table("lengths").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("av")), "totals")
        held = rows.select("doc", "field", F.explode("t").alias("term")).groupBy("doc", "field", "term").agg(F.count(F.lit(1)).alias("tf"))
        totals = F.broadcast(index.table("totals"))  # a row for each field
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("av")))
        put(held.join(index.table("lengths"), ["doc", "field"]).join(totals, "field").select("doc", "field", "term", "tf", impact.alias("impact")), "forward")
        forward = index.table("forward")
        put(forward.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")), "terms")
        placed = ranked(forward.select("field", "term", "impact", "doc"), ["field", "term"], [F.col("impact").desc(), F.col("doc").asc()], "place")
        blocks = placed.withColumn("block", F.floor((F.col("place") - 1) / block).cast("int")).groupBy("field", "term", "block")
        put(blocks.agg(F.max("impact").alias("most"), F.collect_list(F.struct("doc", "impact")).alias("postings")), "blocks")
        return index

    def _asked(self, queries: DataFrame, weights: dict[str, float], texts: dict[str, str]) -> DataFrame:
        """(query, field, term, weight): the distinct known terms of each query and field, with the rarity times the field's weight."""
        parts = [queries.select("query", F.lit(f).alias("field"), F.explode(tokens(texts.get(f, "text"))).alias("term")) for f in weights]
        q = reduce(DataFrame.unionByName, parts).distinct()
        rarity = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = reduce(lambda w, kv: F.when(F.col("field") == kv[0], kv[1]).otherwise(w), weights.items(), F.lit(0.0))
        return q.join(self.table("terms"), ["field", "term"]).join(F.broadcast(self.table("totals")), "field").select("query", "field", "term", (weight * rarity).alias("weight"))

    def _postings(self, asked: DataFrame, blocks: DataFrame, kept: Column | None = None) -> DataFrame:
        """(query, field, doc, score) of the blocks of the queries' terms that are kept; a term's blocks are dealt over the join."""
        q = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        both = q.join(blocks.withColumn("part", F.pmod("block", F.lit(PARTS))), ["field", "term", "part"])
        both = both if kept is None else both.where(kept)
        return both.select("query", "field", "weight", F.explode("postings").alias("p")).select("query", "field", F.col("p.doc").alias("doc"), (F.col("weight") * F.col("p.impact")).alias("score"))

    def scores(self, queries: DataFrame, weights: dict[str, float], best: bool = False, texts: dict[str, str] | None = None) -> DataFrame:
        """(query, doc, score) of every document with a term of the query: the sum over its fields, or the best field.

        queries: query, and the text asked of each field (``texts``: field to column; else the column ``text``)."""
        return _summed(self._postings(self._asked(queries, weights, texts or {}), self.table("blocks")), best)

    def top(self, queries: DataFrame, k: int, weights: dict[str, float], best: bool = False, texts: dict[str, str] | None = None) -> DataFrame:
        """``scores`` of the ``k`` best documents of each query, numbered; ties to the lesser document."""
        asked = Store(self.spark, "asked").put(self._asked(queries, weights, texts or {}), "terms")
        return top(_summed(self._full(self._candidates(asked, k, best), asked), best), k)

    def read(self, asked: DataFrame, k: int, best: bool) -> DataFrame:
        """The blocks that ``top`` reads for each query and term: query, field, term, weight, block, most, postings."""
        blocks = self.table("blocks")
        part = _summed(self._postings(asked, blocks.where("block = 0")), best)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
        bound = part.withColumn("_n", place).where(F.col("_n") == k).select("query", F.col("score").alias("bound"))
        group = ["query", "field"] if best else ["query"]
        least = asked.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(bound, "query", "left")
        least = least.select(*group, ((F.coalesce("bound", F.lit(0.0)) - SLACK) / F.col("n")).alias("least"))
        q = asked.join(least, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        both = q.join(blocks.withColumn("part", F.pmod("block", F.lit(PARTS))), ["field", "term", "part"])
        return both.where(F.col("weight") * F.col("most") >= F.col("least")).drop("part", "least")

    def _candidates(self, asked: DataFrame, k: int, best: bool) -> DataFrame:
        return self.read(asked, k, best).select("query", F.explode("postings.doc").alias("doc")).distinct()

    def _full(self, candidates: DataFrame, asked: DataFrame) -> DataFrame:
        wanted = candidates.join(asked, "query")
        return wanted.join(self.table("forward"), ["doc", "field", "term"]).select("query", "field", "doc", (F.col("weight") * F.col("impact")).alias("score"))


def _summed(rows: DataFrame, best: bool) -> DataFrame:
    by_field = rows.groupBy("query", "doc", "field").agg(F.sum("score").alias("score"))
    return by_field.groupBy("query", "doc").agg((F.max if best else F.sum)("score").alias("score"))
