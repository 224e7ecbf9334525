"""Evaluation and analytics over mentions, candidates and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.ranks import ranked


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def prf1_mention(gold: DataFrame, predicted: DataFrame, key: str = "mention_id") -> DataFrame:
    """Decisions by mention: right entity TP, other entity FP (and not FN), no prediction FN."""
    both = predicted.select(key, F.col("entity").alias("_p")).join(gold.select(key, F.col("entity").alias("_g")), key, "full_outer")
    n = lambda c: F.count_if(c)
    counts = both.agg(
        n(F.col("_p").isNotNull() & (F.col("_p") == F.col("_g"))).alias("tp"),
        n(F.col("_p").isNotNull() & ~F.coalesce(F.col("_p") == F.col("_g"), F.lit(False))).alias("fp"),
        n(F.col("_p").isNull()).alias("fn"),
    )
    return counts.select("tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def prf1_pairs(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Sets of keys: TP in both, FP predicted only, FN gold only."""
    g, p = gold.select(keys).distinct().withColumn("_g", F.lit(1)), predicted.select(keys).distinct().withColumn("_p", F.lit(1))
    counts = g.join(p, keys, "full_outer").agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    return counts.select("tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def prf1_by_label(gold: DataFrame, predicted: DataFrame, label: str, least: int = 8, key: str = "mention_id") -> DataFrame:
    """By challenge label, for labels with enough gold rows."""
    both = gold.select(key, label, F.col("entity").alias("_g")).join(predicted.select(key, F.col("entity").alias("_p")), key, "left")
    hit = F.coalesce(F.col("_g") == F.col("_p"), F.lit(False))
    counts = both.groupBy(label).agg(F.count(F.lit(1)).alias("gold"), F.count_if(hit).alias("tp"), F.count_if(F.col("_p").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    return counts.where(F.col("gold") >= least).select(label, "gold", "tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def prf1_by_challenge(gold: DataFrame, predicted: DataFrame, article: str = "article_id", keys: tuple[str, ...] = ("name", "entity"), label: str = "label") -> DataFrame:
    """By challenge label, false positives by article: a prediction in an article that has gold of the label, but is none of it, counts.

    A prediction in an article of two labels counts once for each. gold: article, keys, label; predicted: article, keys; repeated rows
    count once. Predictions are counted by article before they meet the labels of the article, so an article with many
    predictions is one row there.
    """
    key = [article, *keys]
    g, p = gold.select(label, *key).dropna().distinct(), predicted.select(*key).dropna().distinct()
    bridge = g.select(label, article).distinct()
    inside = bridge.join(p.groupBy(article).agg(F.count(F.lit(1)).alias("_n")), article, "left").groupBy(label).agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pred_in_articles"))
    hits = g.join(p.withColumn("_hit", F.lit(1)), key, "left").groupBy(label).agg(F.count(F.lit(1)).alias("gold"), F.count("_hit").alias("tp"))
    both = hits.join(inside, label).withColumns({"fp": F.col("pred_in_articles") - F.col("tp"), "fn": F.col("gold") - F.col("tp")})
    return both.select(label, "articles", "gold", "pred_in_articles", "tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def extremes(by_label: DataFrame, label: str = "label", least: int = 8, most: int = 10) -> DataFrame:
    """(side, place, label, gold, f1): the labels with the least and with the highest F1 among those with enough gold; ties to more gold."""
    some = by_label.where(F.col("gold") >= least).select(label, "gold", "f1")
    parts = []
    for side, order in (("hardest", F.col("f1").asc()), ("best", F.col("f1").desc())):
        few = some.orderBy(order, F.col("gold").desc(), label).limit(most)  # a report of a few labels
        parts.append(few.withColumn("place", F.row_number().over(Window.orderBy(order, F.col("gold").desc(), label))).select(F.lit(side).alias("side"), "place", label, "gold", "f1"))
    return parts[0].unionByName(parts[1])


def decision_metrics(gold: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Sets of decisions with the judge's acceptance: judgments, positives, acceptance_rate, tp, fp, fn, precision, recall, f1."""
    accepted = judged.where("is_match").select(keys)
    n = judged.agg(F.count(F.lit(1)).alias("judgments"), F.count_if("is_match").alias("positives"))
    rate = F.when(F.col("judgments") > 0, F.round(F.col("positives") / F.col("judgments"), 6)).otherwise(0.0).alias("acceptance_rate")
    return n.select("judgments", "positives", rate).crossJoin(prf1_pairs(gold, accepted, keys))  # a row each


def confusion(gold: DataFrame, predicted: DataFrame, key: str = "mention_id") -> DataFrame:
    """Mentions that got another entity than theirs, or none."""
    both = gold.select(key, F.col("entity").alias("expected")).join(predicted.select(key, F.col("entity").alias("got")), key, "left")
    return both.where(~F.coalesce(F.col("expected") == F.col("got"), F.lit(False))).withColumn("error", F.when(F.col("got").isNull(), "missed").otherwise("wrong"))


def confidence_level(c: Column) -> Column:
    """high from .8, medium from .5, low."""
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def confidence_bin(c: Column) -> Column:
    """Low (0, .5], Medium (.5, .8], High (.8, 1]; null outside."""
    return F.when((c > 0) & (c <= 0.5), "Low").when((c > 0.5) & (c <= 0.8), "Medium").when((c > 0.8) & (c <= 1), "High")


def distribution(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Counts and shares of the whole, in one aggregation and a window over its few rows."""
    counts = rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def extraction_stats(mentions: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return mentions.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean_confidence"), F.count_if(c > 0.8).alias("high"), F.count_if((c >= 0.5) & (c <= 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low")
    )


def method_comparison(mentions: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return mentions.groupBy("method").agg(F.round(F.avg(c), 3).alias("mean"), F.round(F.stddev_samp(c), 3).alias("std"), F.count(c).alias("n"), F.count_distinct("entity_type").alias("types"))


def verification(mentions: DataFrame) -> DataFrame:
    compound = F.contains("name", F.lit(" ")) & (F.col("entity_type") != "person")
    return mentions.agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("article_id").alias("articles"), F.count_distinct("entity_type").alias("types"), F.count_if(compound).alias("compounds"))


def running_mean(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The mean of the values of ``by`` so far, by ranges and prefix sums; nulls count as nothing."""
    summed = ranked(rows.withColumn("_one", F.col(value).isNotNull().cast("long")), [by], [F.col(order).asc()], "_rank", {"_sum": value, "_n": "_one"})
    return summed.withColumn("running_mean", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).drop("_one", "_rank", "_sum", "_n")


def batch_numbers(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``batch``: the number, from 0, of each row's batch of ``size`` among the rows of ``by``."""
    return ranked(rows, [by], [F.col(order).asc()], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))


def top_values(rows: DataFrame, value: str, k: int) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value).limit(k)


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_per_type(rows: DataFrame, kind: str, key: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(kind).orderBy(F.col("confidence").desc(), key))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def roll_up(matches: DataFrame, article: str = "article_id") -> DataFrame:
    """Matches nested in their articles, with those of high priority and the distinct names longer than a character."""
    m = F.struct("mention_id", "name", "entity_id", "priority", "confidence")
    out = matches.groupBy(article).agg(F.array_sort(F.collect_list(m)).alias("matches"))
    return out.withColumns(
        {
            "n_matches": F.size("matches"),
            "high_priority": F.filter("matches", lambda x: x.priority == "high"),
            "names": F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda x: x["name"]), lambda n: F.length(n) > 1))),
        }
    )


def true_negatives(expected_none: DataFrame, predicted: DataFrame, key: str = "mention_id") -> DataFrame:
    """Of mentions that should match nothing, how many do not."""
    hit = predicted.select(key).distinct().withColumn("_p", F.lit(1))
    return expected_none.join(hit, key, "left").agg(F.count_if(F.col("_p").isNull()).alias("tn"), F.count_if(F.col("_p").isNotNull()).alias("fp"))


def script_stats(rows: DataFrame, script: Column) -> DataFrame:
    return rows.groupBy(script.alias("script")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_match").alias("confirmed"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def rates(judged: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return judged.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_match").cast("double")), 6).alias("confirmed_rate"), F.round(F.avg((c > 0).cast("double")), 6).alias("success_rate"))


def hit_rate(rows: DataFrame, key: Column) -> DataFrame:
    """What a cache of distinct keys would save: 1 - distinct keys / rows."""
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(key).alias("distinct_keys")).withColumn("hit_percent", F.bround(100.0 * (F.col("calls") - F.col("distinct_keys")) / F.col("calls"), 2))


def first_label(columns: list[str]) -> Column:
    """First of several label columns that is not empty."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, F.col(c)) for c in columns], F.lit("unknown"))
