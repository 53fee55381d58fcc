"""Comparisons: of coders, with a template, of tiers, with norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.words import folded, ratio


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of each code of two codings of one text (utt_idx, cod): counts, agreements and their share of the larger count.

    Utterances are put side by side by utt_idx, as many as the shorter coding has.
    """
    n = min(first.agg(F.max("utt_idx")).first()[0] or 0, second.agg(F.max("utt_idx")).first()[0] or 0)
    counts = lambda t, name: t.where(F.col("utt_idx") <= n).select("utt_idx", F.explode("cod").alias("code")).groupBy("utt_idx", "code").agg(F.count(F.lit(1)).alias(name))
    both = counts(first, "a").join(counts(second, "b"), ["utt_idx", "code"], "full").na.fill(0, ["a", "b"])
    out = both.groupBy("code").agg(F.sum("a").alias("first"), F.sum("b").alias("second"), F.sum(F.least("a", "b")).alias("agreed"))
    return out.withColumn("percent", F.round(100 * F.col("agreed") / F.greatest("first", "second"), 6))


def kappa(by_code: DataFrame) -> DataFrame:
    """Overall agreement and Cohen's kappa of agreement()'s counts; kappa is 1 where chance explains everything."""
    sums = by_code.agg(F.sum("first").alias("a"), F.sum("second").alias("b"), F.sum("agreed").alias("agreed"), F.sum(F.col("first") * F.col("second")).alias("products"))
    n = F.greatest("a", "b")
    observed, chance = F.col("agreed") / n, F.col("products") / (n * n)
    value = F.when(F.abs(1 - chance) <= 1e-12, 1.0).otherwise((observed - chance) / (1 - chance))
    return sums.select("agreed", n.alias("n"), F.round(100 * observed, 6).alias("percent"), F.round(value, 6).alias("kappa"))


def against_template(subject: DataFrame, template: DataFrame) -> DataFrame:
    """produced, ideal, correct, omitted and added words of the subject's turns against the template's, and the percentage correct."""
    counts = lambda t, name: t.select(F.explode(folded("cw")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias(name))
    both = counts(subject, "s").join(counts(template, "t"), "word", "full").na.fill(0, ["s", "t"])
    out = both.agg(F.sum("s").alias("produced"), F.sum("t").alias("ideal"), F.sum(F.least("s", "t")).alias("correct"))
    out = out.na.fill(0)
    return out.withColumns({"omitted": F.col("ideal") - F.col("correct"), "added": F.col("produced") - F.col("correct"), "percent": F.round(100 * ratio("correct", "ideal"), 6)})


def tier_mismatches(turns: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of items at one place of two tiers that differ, with their counts; the shorter is filled with ∅."""
    pairs = F.explode(F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b"))).alias("p")
    rows = turns.select(pairs).select(F.coalesce("p.a", F.lit("∅")).alias("first"), F.coalesce("p.b", F.lit("∅")).alias("second"))
    return rows.where("first != second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("count"))


def tier_accuracy(turns: DataFrame, first: str, second: str) -> DataFrame:
    """Items compared, items equal, and their percentage."""
    rows = turns.select(F.explode(F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b"))).alias("p"))
    out = rows.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("p.a") == F.col("p.b"), 1)).alias("equal"))
    return out.withColumn("accuracy", F.round(F.when(F.col("items") == 0, 100.0).otherwise(100 * F.col("equal") / F.col("items")), 6))


def replicas(turns: DataFrame, model: str = "mod", replica: str = "pho") -> DataFrame:
    """Of each speaker: how often each model word is said as each replica; words are taken by place, as many as the shorter tier has."""
    n = F.least(F.size(model), F.size(replica))
    pairs = F.arrays_zip(F.slice(model, 1, n).alias("m"), F.slice(replica, 1, n).alias("r"))
    rows = turns.where(n > 0).select("speaker", F.explode(pairs).alias("p"))
    return rows.groupBy("speaker", F.lower("p.m").alias("model"), F.lower("p.r").alias("replica")).agg(F.count(F.lit(1)).alias("count"))


def phones(turns: DataFrame, tier: str = "pho") -> DataFrame:
    """Of each phone: total, initial, final and other places in words. Letters and + are phones; stress and length marks aren't."""
    letters = F.filter(F.split(F.regexp_replace(F.col("w"), "[ˈˌː]", ""), ""), lambda c: F.rlike(c, F.lit(r"^[\p{L}+]$")))
    rows = turns.select(F.explode(tier).alias("w")).select(letters.alias("c")).where(F.size("c") > 0)
    rows = rows.select(F.size("c").alias("n"), F.posexplode("c").alias("k", "phone"))
    first, last = F.col("k") == 0, F.col("k") == F.col("n") - 1
    count = lambda test: F.count(F.when(test, 1))
    return rows.groupBy("phone").agg(F.count(F.lit(1)).alias("total"), count(first).alias("initial"), count(~first & last).alias("final"), count(~first & ~last).alias("other"))


def norm_statistics(norms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """measure, mean, sd (over n - 1, 0 for one entry) and n of each place of the norms' scores."""
    rows = norms.select(*by, F.posexplode("scores").alias("measure", "score")).where("score is not null")
    return rows.groupBy(*by, "measure").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.count("score").alias("n"))


def z_scores(scores: DataFrame, norms: DataFrame, key: str = "speaker", by: tuple[str, ...] = ()) -> DataFrame:
    """key, measure, score, mean, sd, z and n of scores (key, by, measure, score) against norms; z is null where the SD is 0.

    The statistics have one row for each measure, so Spark broadcasts them by their size.
    """
    out = scores.join(norm_statistics(norms, by), [*by, "measure"])
    z = F.when(F.col("sd") != 0, F.round((F.col("score") - F.col("mean")) / F.col("sd"), 6))
    return out.select(key, *by, "measure", F.round("score", 6).alias("score"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), z.alias("z"), "n")


def filter_norms(norms: DataFrame, language: str | None = None, group: str | None = None, sex: str | None = None, ages: tuple[int, int] | None = None, speakers: list[str] = ()) -> DataFrame:
    """Entries that fit; texts are compared without case, an unknown age fits no range."""
    for column, value in (("language", language), ("grp", group), ("sex", sex)):
        if value is not None:
            norms = norms.where(F.lower(column) == value.lower())
    if ages:
        norms = norms.where(F.col("age_months").between(*ages))
    return norms.where(F.lower("speaker_code").isin(*(s.lower() for s in speakers))) if speakers else norms
