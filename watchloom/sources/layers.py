"""A table kept up to date by batches of changes: a layer a batch, merged as it is read, compacted when there are many.

A layer holds the keys of one batch only, with their new row or a tombstone; which layers there are, and in which order, stands in a log
(``log``). Reading takes each key's row of the last layer that has one. Writing a batch reads nothing of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.sources.log import Log

OPS = ("upsert", "delete")


class LayeredTable:
    """Rows by ``key``; ``columns`` is the DDL of the other columns. Of a key's layers the last one counts, or with ``newest_by`` the one
    with the highest value of that column (of equal ones the last), for changes that may come late."""

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: str, kind: str = "string", newest_by: str | None = None):
        self.newest_by = newest_by
        self.spark, self.folder, self.key, self.log = spark, folder.rstrip("/"), key, Log(spark, folder)
        self.ddl = f"`{key}` {kind}, {columns}"
        self.columns = [f.name for f in spark.createDataFrame([], self.ddl).schema]

    def _layers(self) -> list[dict]:
        return self.log.head()[1].get("layers", [])

    def apply(self, changes: DataFrame, seq: str = "seq", op: str = "op", required: tuple[str, ...] = (), token: tuple[str, int] | None = None) -> dict | None:
        """Writes one batch and commits it. Returns total, success, errors (of changes) and keys (written).

        ``token`` names a stream and the number of its batch: a batch whose number, or a later one, the log already has for the stream
        changes nothing, and None is returned.

        Of several changes of a key the last by ``seq`` counts. A change without a key, with an operation that there is not, or an upsert
        without a required column is an error: it changes nothing and is kept under ``errors`` with its reason.
        """
        given = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required]) if required else F.lit(None).cast("string")
        reason = F.when(F.col(self.key).isNull(), f"no {self.key}").when(~F.coalesce(F.col(op).isin(*OPS), F.lit(False)), "no such operation").when(F.col(op) == "upsert", given)
        known = lambda state: token is not None and state.get("streams", {}).get(token[0], -1) >= token[1]
        if known(self.log.head()[1]):
            return None
        name = uuid.uuid4().hex
        marked = changes.withColumn("_error", reason)
        kept = marked.where("_error IS NULL").groupBy(self.key).agg(F.max_by(F.struct(F.col(op).alias("_op"), *[c for c in self.columns if c != self.key]), seq).alias("_r"), F.count(F.lit(1)).alias("_changes"))
        rows = kept.select(self.key, *[f"_r.{c}" for c in self.columns if c != self.key], (F.col("_r._op") == "delete").alias("_gone"), "_changes")
        rows.write.parquet(f"{self.folder}/layer-{name}")
        marked.where("_error IS NOT NULL").write.parquet(f"{self.folder}/errors-{name}")
        done = self.spark.read.schema(f"{self.ddl}, _gone boolean, _changes long").parquet(f"{self.folder}/layer-{name}")
        counts = done.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("_changes"), F.lit(0)).alias("success")).first()
        errors = self.spark.read.parquet(f"{self.folder}/errors-{name}").count()
        result = {"total": counts["success"] + errors, "success": counts["success"], "errors": errors, "keys": counts["keys"]}

        def change(state: dict) -> dict:
            if known(state):
                return state
            streams = state.get("streams", {}) | ({token[0]: token[1]} if token else {})
            return state | {"layers": [*state.get("layers", []), {"name": name, **result}], "streams": streams}

        self.log.commit(change)
        return result

    def results(self) -> list[dict]:
        """What each committed batch, in order, returned; a compacted layer has all its batches'."""
        return [r for x in self._layers() for r in x.get("batches", [x])]

    def errors(self) -> DataFrame:
        """The changes of the current layers' batches that were errors, with ``_error``."""
        names = [r["name"] for r in self.results()]
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/errors-{n}" for n in names])

    def _merged(self, layers: list[dict]) -> DataFrame:
        every = None
        for i, x in enumerate(layers):
            one = self.spark.read.schema(f"{self.ddl}, _gone boolean").parquet(f"{self.folder}/layer-{x['name']}").withColumn("_layer", F.lit(i))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return self.spark.createDataFrame([], f"{self.ddl}, _gone boolean")
        if len(layers) == 1:
            return every.drop("_layer")
        last = every.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in every.columns if c not in (self.key, "_layer")]), F.struct(*([self.newest_by] if self.newest_by else []), "_layer")).alias("_r"))
        return last.select(self.key, "_r.*")

    def read(self) -> DataFrame:
        """The table as the log's last entry has it; later batches do not change what was read."""
        return self._merged(self._layers()).where("NOT _gone").select(*self.columns)

    def compact(self) -> int:
        """Puts the present layers into one, without tombstones (but where late changes may still come); returns how many there were. Batches that came meanwhile stay on top;
        if another compaction was first, this one changes nothing."""
        layers = self._layers()
        if len(layers) < 2:
            return len(layers)
        name, old = uuid.uuid4().hex, [x["name"] for x in layers]
        rows = self._merged(layers)
        (rows if self.newest_by else rows.where("NOT _gone")).write.parquet(f"{self.folder}/layer-{name}")
        batches = [r for x in layers for r in x.get("batches", [x])]

        def change(state: dict) -> dict:
            now = state.get("layers", [])
            if [x["name"] for x in now[: len(old)]] != old:
                return state
            return state | {"layers": [{"name": name, "batches": batches}, *now[len(old) :]]}

        self.log.commit(change)
        return len(old)
