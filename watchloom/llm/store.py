"""Tables of the operators: where they are written (the engine's scratch folders) and how their columns are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.sources.scratch import Store, shared_dir

__all__ = ["Store", "ahead", "ddl", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ahead(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` without columns named like those an operator adds: the operator's column takes the name."""
    names = {a.lower() for a in added}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def ddl(docs: DataFrame, *added: str) -> str:
    """The schema of ``docs`` with columns behind it, for map operators."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + list(added))
