"""Lengths of utterances, turns and words, and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.morphology import TRACED_IN_WORDS, all_words, traced_morphemes
from parlance.functions.words import folded, length_without, population_sd, ratio
from parlance.operators.filters import without_solo


def islands(turns: DataFrame) -> DataFrame:
    """Adds island: the number of the run of one speaker that a turn belongs to, within its file; only turns with counted words."""
    order = Window.partitionBy("file").orderBy("utt_idx")
    spoken = turns.where(F.size("cw") > 0)
    new = (F.lag("speaker").over(order).isNull() | (F.lag("speaker").over(order) != F.col("speaker"))).cast("long")
    return spoken.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def mean_length(turns: DataFrame, morphemes: bool = False, solo: list[str] = (), left_out_postcode: str = "mlue", by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """utterances, morphemes (or words), mean, population SD, least and most of each group's utterances with counted words.

    Left out: utterances that say only words of solo, that have the postcode, or that have words not
    understood (column unclear, if there is one). With morphemes, those without a mor tier are left out
    too, but their speakers are listed.
    """
    rows = turns.where(F.size("cw") > 0)
    if solo:
        rows = without_solo(rows, list(solo))
    if "postcodes" in turns.columns:
        rows = rows.where(~F.coalesce(F.array_contains("postcodes", left_out_postcode), F.lit(False)))
    if "unclear" in turns.columns:
        rows = rows.where(~F.coalesce("unclear", F.lit(False)))
    n = F.when(F.col("mor").isNotNull(), traced_morphemes("mor")) if morphemes else F.size("cw").cast("long")
    rows = rows.select(*by, n.alias("n"))
    return rows.groupBy(*by).agg(
        F.count("n").alias("utterances"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.round(F.avg("n"), 6).alias("mean"),
        F.round(population_sd("n"), 6).alias("sd"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
    )


def turn_lengths(turns: DataFrame, solo: list[str] = ()) -> DataFrame:
    """Of each speaker: turns (runs of utterances within a file), utterances, words, their ratios, and the population SD of words of an utterance."""
    rows = islands(without_solo(turns, list(solo)) if solo else turns)
    each = rows.select("speaker", "file", "island", F.size("cw").cast("long").alias("n"))
    order = each.groupBy("speaker", "file", "island").agg(F.count("n").alias("u"), F.sum("n").alias("w"), F.sum(F.col("n") * F.col("n")).alias("q"))
    sums = order.groupBy("speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum("u").alias("utterances"), F.sum("w").alias("words"), F.sum("q").alias("q"))
    # n * sum of squares less the squared sum, in whole numbers, for an SD that doesn't depend on the order of sums.
    variance = (F.col("utterances").cast("decimal(38,0)") * F.col("q") - F.col("words").cast("decimal(38,0)") * F.col("words")).cast("double") / (F.col("utterances").cast("double") * F.col("utterances").cast("double"))
    return sums.select(
        "speaker", "turns", "utterances", "words",
        F.round(ratio("words", "turns"), 6).alias("words_per_turn"),
        F.round(ratio("utterances", "turns"), 6).alias("utterances_per_turn"),
        F.round(ratio("words", "utterances"), 6).alias("words_per_utterance"),
        F.round(F.when(F.col("utterances") > 1, F.sqrt(variance)), 6).alias("sd"),
    )


def _histogram(rows: DataFrame, section: int) -> DataFrame:
    return rows.groupBy("speaker", "length").agg(F.count(F.lit(1)).alias("count")).select(F.lit(section).alias("section"), "speaker", "length", "count")


def length_histograms(turns: DataFrame) -> DataFrame:
    """Six histograms by speaker: 1 characters of words, 2 words of utterances, 3 utterances and 4 words of turns; with mor, 5 morphemes of words (and one for the part of speech) and 6 of utterances."""
    runs = islands(turns).groupBy("file", "speaker", "island").agg(F.count(F.lit(1)).alias("u"), F.sum(F.size("cw")).alias("w"))
    out = _histogram(turns.select("speaker", F.explode("cw").alias("w")).select("speaker", length_without("w", "'").alias("length")), 1)
    out = out.unionByName(_histogram(turns.where(F.size("cw") > 0).select("speaker", F.size("cw").cast("long").alias("length")), 2))
    out = out.unionByName(_histogram(runs.select("speaker", F.col("u").alias("length")), 3)).unionByName(_histogram(runs.select("speaker", F.col("w").cast("long").alias("length")), 4))
    if "mor" not in turns.columns:
        return out
    marks = F.array(*map(F.lit, TRACED_IN_WORDS))
    of = lambda w: F.when(F.arrays_overlap(w["features"], marks), 2).otherwise(1)
    item = lambda i: F.aggregate(i["post_clitics"], of(i["main"]).cast("long"), lambda a, w: a + of(w))
    items = turns.where(F.size("mor") > 0)
    words = items.select("speaker", F.explode(F.transform("mor", item)).alias("length"))
    whole = items.select("speaker", F.aggregate("mor", F.lit(0).cast("long"), lambda a, i: a + item(i) + 1).alias("length"))
    return out.unionByName(_histogram(words, 5)).unionByName(_histogram(whole, 6))


def word_sizes(turns: DataFrame, bound: tuple[str, int] | None = None, main_tier: bool = False) -> DataFrame:
    """Histogram of the characters of lemmas (main words and clitics), or of counted words without a mor tier. bound: (gt, lt or eq, n)."""
    words = F.transform(all_words("mor"), lambda w: w["lemma"]) if "mor" in turns.columns and not main_tier else F.col("cw")
    rows = turns.where(F.size("cw") > 0).select("speaker", F.explode(F.coalesce(words, F.col("cw"))).alias("w")).select("speaker", F.char_length("w").cast("long").alias("length"))
    if bound:
        n = F.col("length")
        rows = rows.where({"gt": n > bound[1], "lt": n < bound[1], "eq": n == bound[1]}[bound[0]])
    return rows.groupBy("speaker", "length").agg(F.count(F.lit(1)).alias("count"))


def longest_words(turns: DataFrame, limit: int = 20, unique_lengths: bool = False, left_out: list[int] = ()) -> DataFrame:
    """The limit longest words of each speaker, by length, then alphabet. unique_lengths: only lengths that one word has."""
    words = turns.select("speaker", F.explode(folded("cw")).alias("word")).groupBy("speaker", "word").agg(F.count(F.lit(1)).alias("count"))
    words = words.withColumn("length", F.char_length("word").cast("long"))
    if left_out:
        words = words.where(~F.col("length").isin(*left_out))
    if unique_lengths:
        single = words.groupBy("speaker", "length").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("word"), F.sum("count").alias("count"))
        words = single.where("n = 1").select("speaker", "word", "count", "length")
    order = Window.partitionBy("speaker").orderBy(F.desc("length"), "word")
    return words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def word_lengths(turns: DataFrame) -> DataFrame:
    """Of each speaker: words, the greatest length, and the mean length over all words said."""
    counts = turns.select("speaker", F.explode(folded("cw")).alias("word")).groupBy("speaker", "word").agg(F.count(F.lit(1)).alias("count"))
    size = F.char_length("word")
    return counts.groupBy("speaker").agg(F.sum("count").alias("words"), F.max(size).cast("long").alias("longest"), F.round(F.sum(size * F.col("count")) / F.sum("count"), 6).alias("mean"))


def longest_places(turns: DataFrame) -> DataFrame:
    """Where the longest words of all are first said (+ and ' don't count): word, length, file, utt_idx."""
    rows = turns.select("file", "utt_idx", F.explode(folded("cw")).alias("word")).withColumn("length", length_without("word", "+'"))
    most = rows.agg(F.max("length").alias("length"))
    return rows.join(F.broadcast(most), "length").groupBy("word", "length").agg(F.min(F.struct("file", "utt_idx")).alias("first")).select("word", "length", "first.file", "first.utt_idx")


def durations(turns: DataFrame, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """Timed utterances, sum, whole mean, least and most of their lengths in ms; negative lengths are 0, untimed ones are left out."""
    rows = turns.where("start_ms is not null and end_ms is not null").withColumn("ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    out = rows.groupBy(*by).agg(F.count("ms").alias("timed"), F.sum("ms").alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"))
    return out.withColumn("mean", F.expr("total div timed"))


def durations_of_all(turns: DataFrame, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """durations() of every speaker that is seen, with all their utterances; those without a timed one have 0 of them and no lengths."""
    seen = turns.groupBy(*by).agg(F.count(F.lit(1)).alias("utterances"))
    return seen.join(durations(turns, by), list(by), "left").na.fill(0, ["timed", "total"])


def span(turns: DataFrame) -> DataFrame:
    """Timed utterances, sum of lengths, and the time from the first start to the last end."""
    rows = turns.where("start_ms is not null and end_ms is not null")
    return rows.agg(F.count(F.lit(1)).alias("timed"), F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("total"), (F.max("end_ms") - F.min("start_ms")).alias("span"))


def means(histograms: DataFrame) -> DataFrame:
    """Mean length of each section and speaker of length_histograms()."""
    out: Column = F.sum(F.col("length") * F.col("count")) / F.sum("count")
    return histograms.groupBy("section", "speaker").agg(F.round(out, 6).alias("mean"))
