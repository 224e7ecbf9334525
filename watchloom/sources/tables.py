"""Sources and sinks: Parquet tables, entity and article JSON, written stages with a manifest, exports, run artefacts."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.sources.log import Log

ENTITY = "name string, entity_type string, description string, aliases array<string>, explicit_context string, context string, priority string, metadata map<string,string>"
ARTICLE = "id string, title string, content string, source string, language string, url string, published_date string, expected_matches array<struct<extracted_entity:string,mention:string,text:string,surface_form:string,watch_list_entity:string,entity_name:string,match_type:string>>, test_category string, challenge_type string, challenge_category string, category string, complexity string, metadata map<string,string>"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _either(spark: SparkSession, path: str, key: str, item: str) -> DataFrame:
    """Rows of a file that is an array, or an object with the array under ``key``."""
    rows = spark.read.schema(f"{key} array<struct<{_types(item)}>>, {item}").json(path, multiLine=True)
    wrapped = rows.where(F.col(key).isNotNull()).select(F.inline(key))
    return wrapped.unionByName(rows.where(F.col(key).isNull()).drop(key))


def _types(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def entities_json(spark: SparkSession, path: str) -> DataFrame:
    e = _either(spark, path, "entities", ENTITY).where("name IS NOT NULL")
    none = F.array().cast("array<string>")
    return e.select(
        "name",
        F.coalesce("entity_type", F.lit("person")).alias("entity_type"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("aliases", none).alias("aliases"),
        F.coalesce("explicit_context", "context", F.try_element_at("metadata", F.lit("explicit_context"))).alias("explicit_context"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
    )


def articles_json(spark: SparkSession, path: str) -> DataFrame:
    from watchloom.functions.text import article_id

    a = _either(spark, path, "articles", ARTICLE).where("content IS NOT NULL")
    return a.withColumns({"id": F.coalesce("id", article_id("title", "content")), "language": F.coalesce("language", F.lit("en")), "text": F.concat_ws("\n\n", "title", "content")})


def gold(articles: DataFrame) -> DataFrame:
    """(article_id, mention, entity, match_type, label, expects_match) from labelled articles."""
    label = F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("test_category", "challenge_type", "challenge_category", "category")], F.lit("unknown"))
    rows = articles.select(F.col("id").alias("article_id"), label.alias("label"), F.explode("expected_matches").alias("m"))
    entity = F.coalesce("m.watch_list_entity", "m.entity_name", F.lit(""))
    return rows.select("article_id", "label", F.coalesce("m.extracted_entity", "m.mention", "m.text", "m.surface_form").alias("mention"), entity.alias("entity"), "m.match_type", (F.length(entity) > 0).alias("expects_match"))


def golden_json(spark: SparkSession, path: str) -> DataFrame:
    g = spark.read.schema("golden_standard map<string,map<string,string>>").json(path, multiLine=True)
    a = g.select(F.explode("golden_standard").alias("article_id", "_m"))
    return a.select("article_id", F.explode("_m").alias("mention", "entity"))


class Stages:
    """Stage outputs as Parquet under one folder; the clock is given by the caller.

    A save writes a folder of its own, an attempt, and becomes current by an entry in a log: nothing is moved, so a crash leaves
    the stage as it was, and of two saves at once both are whole and the later entry counts. The attempt before stays as the backup. An
    entry also names the attempts of the stages that the saved one was made from.
    """

    VERSION = "1"

    def __init__(self, spark: SparkSession, folder: str, clock=datetime.now):
        self.spark, self.folder, self.clock, self.log = spark, folder.rstrip("/"), clock, Log(spark, folder)

    def _stages(self) -> dict[str, dict]:
        return self.log.head()[1].get("stages", {})

    def save(self, stage: str, rows: DataFrame, success: bool = True, needs: list[str] | None = None) -> DataFrame:
        made_from = {n: self.info(n)["attempt"] for n in needs or []}
        attempt = f"{stage}/attempt-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{attempt}")
        out = self.spark.read.parquet(f"{self.folder}/{attempt}")
        line = {"stage": stage, "attempt": attempt, "saved_at": self.clock().isoformat(), "version": self.VERSION, "success": success, "n_rows": out.count(), "needs": made_from}

        def change(state: dict) -> dict:
            before = state.get("stages", {}).get(stage)
            return state | {"stages": state.get("stages", {}) | {stage: line | {"backup": before and before["attempt"]}}}

        self.log.commit(change)
        return out

    def info(self, stage: str) -> dict:
        """The entry of a stage's current save; an error where there is none."""
        found = self._stages().get(stage)
        if found is None:
            raise KeyError(f"stage {stage} was never saved")
        return found

    def list(self) -> list[str]:
        return sorted(self._stages())

    def load(self, stage: str, backup: bool = False) -> DataFrame:
        attempt = self.info(stage)["backup" if backup else "attempt"]
        if attempt is None:
            raise KeyError(f"stage {stage} has no backup")
        return self.spark.read.parquet(f"{self.folder}/{attempt}")

    def manifest(self) -> DataFrame:
        """The last save of each stage, newest first, and whether a stage it was made from was saved again since."""
        now = self._stages()
        rows = [(s, x["saved_at"], x["version"], x["success"], x["n_rows"], any(now[n]["attempt"] != a for n, a in x["needs"].items() if n in now)) for s, x in now.items()]
        return self.spark.createDataFrame(rows, "stage string, saved_at string, version string, success boolean, n_rows long, stale boolean").orderBy(F.col("saved_at").desc(), "stage")

    def order(self) -> list[str]:
        """All saved stages, each behind those it was made from."""
        needs = {s: set(x["needs"]) for s, x in self._stages().items()}
        return [s for s in TopologicalSorter(needs).static_order() if s in needs]

    def valid(self, stage: str, version: str | None = None) -> bool:
        """Whether the stage's last save is of the version wanted, by default of this one."""
        found = self._stages().get(stage)
        return found is not None and found["version"] == (version or self.VERSION)

    def missing(self, needed: list[str]) -> DataFrame:
        want = self.spark.createDataFrame([(s,) for s in needed], "stage string")
        return missing_stages(want, self.manifest())

    def clean(self) -> list[str]:
        """Deletes attempts that earlier entries named and the last does not, and those entries; returns the attempts."""
        now = {a for x in self._stages().values() for a in (x["attempt"], x["backup"]) if a}
        earlier = {a for v in self.log.versions() for x in (self.log.entry(v) or {}).get("stages", {}).values() for a in (x["attempt"], x["backup"]) if a}
        gone = sorted(a for a in earlier - now if drop_table(self.spark, f"{self.folder}/{a}"))
        self.log.forget(1)
        return gone


def last_saved(rows: DataFrame) -> DataFrame:
    s = rows.groupBy("stage").agg(F.max_by(F.struct(*rows.columns), "saved_at").alias("_s"))
    return s.select("_s.*").orderBy(F.col("saved_at").desc(), "stage")


def missing_stages(needed: DataFrame, manifest: DataFrame) -> DataFrame:
    return needed.join(manifest.where("success"), "stage", "left_anti")


def export(rows: DataFrame, path: str, kind: str) -> None:
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no export format: {kind}")
    flat = rows.withColumns({f.name: F.to_json(f.name) for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}) if kind == "csv" else rows
    writer = flat.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)


def run_artifacts(parts: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """One JSON dataset for each result, in the run's partition."""
    for name, rows in parts.items():
        rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(f"{folder}/{name}")


def merge_config(base: dict, over: dict) -> dict:
    """Deep merge into a new dict; the arguments stay as they are."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return out


def load_config(path: str | None, defaults: dict, environment: dict[str, str] | None = None, names: dict[str, list[str]] | None = None) -> dict:
    """``defaults``, under a JSON or YAML file if there is one, under variables: ``names`` maps each to its place in the dict.

    The defaults stay as they are. A file that is not there changes nothing; one that cannot be read is an error.
    """
    out = merge_config(defaults, {})
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                out = merge_config(out, yaml.safe_load(f) or {})
            else:
                out = merge_config(out, json.load(f))
    for name, place in (names or {}).items():
        value = (environment or {}).get(name)
        if value:
            over: dict | str = value
            for key in reversed(place):
                over = {key: over}
            out = merge_config(out, over)
    return out


def guarded(rows: DataFrame, checks: dict[str, F.Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with ``_error`` naming the first check they fail (the dead letters)."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = rows.withColumn("_error", error)
    return marked.where("_error IS NULL").drop("_error"), marked.where("_error IS NOT NULL")


def report(rows: DataFrame) -> DataFrame:
    """Field names, types and how many rows have a value: what verifies a written table."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in rows.columns])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("n")) for f in rows.schema])
    return counts.select("_n", F.explode(pairs).alias("p")).select("p.field", "p.type", F.col("p.n").alias("n_values"), F.col("_n").alias("n_rows"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_table(spark: SparkSession, path: str) -> bool:
    """Deletes a written table if it is there; says whether it was. What is written is visible at once, so there is no refresh."""
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p)) and bool(fs.delete(p, True))


def reset(spark: SparkSession, folder: str, stages: list[str]) -> list[str]:
    """Deletes the saved stages of these names; returns those that were there."""
    return [s for s in stages if drop_table(spark, f"{folder.rstrip('/')}/{s}")]


# A small list of our own to try the engine with: invented people and organisations.
SAMPLE_ENTITIES = [
    ("Mara Ellison", "person", "head of the harbour authority", ["M. Ellison", "Ellison, Mara"], None, "high"),
    ("Jonas Wedekind", "person", "geologist and author", ["Dr. Wedekind"], "Jonas Wedekind surveys glaciers in the north", "medium"),
    ("Irina Sokolova", "person", "chess grandmaster", ["Ирина Соколова"], None, "medium"),
    ("Tarek Haddad", "person", "editor of a newspaper", ["T. Haddad"], None, "low"),
    ("Northlight Shipping", "organization", "freight line on the coast", ["Northlight"], None, "high"),
    ("Bluefern Labs", "organization", "maker of sensors", ["Bluefern", "Bluefern Labs Inc"], "Bluefern Labs builds sensors for rivers", "medium"),
    ("Port Alder", "location", "harbour town", ["Alder"], None, "medium"),
    ("Marsh fever", "disease", "illness of wet lowlands", ["marsh ague"], None, "low"),
]
SAMPLE_ARTICLES = [
    ("s1", "Harbour plan", "Mara Ellison opened the new quay at Port Alder. Northlight Shipping will use it.", "en"),
    ("s2", "Sensors", "Bluefern Labs sold river sensors to Dr. Wedekind.", "en"),
    ("s3", "Шахматы", "Ирина Соколова выиграла турнир.", "ru"),
    ("s4", "Lowlands", "Doctors report marsh ague near Port Alder, writes T. Haddad.", "en"),
    ("s5", "Hafen", "Northlight baut am Hafen von Port Alder.", "de"),
]


def sample_entities(spark: SparkSession) -> DataFrame:
    """The built-in watch list."""
    return spark.createDataFrame(SAMPLE_ENTITIES, "name string, entity_type string, description string, aliases array<string>, explicit_context string, priority string")


def sample_articles(spark: SparkSession) -> DataFrame:
    """The built-in articles."""
    return spark.createDataFrame(SAMPLE_ARTICLES, "article_id string, title string, content string, language string").withColumn("text", F.concat_ws("\n\n", "title", "content"))
