"""Lexical diversity D from random samples: words drawn without replacement from each group, however many words it has.

Draws don't touch the words. A sample of n of a group's T words is n places below T, made by n steps of
Floyd's method, so all places of a draw differ and every set of n is as likely; random numbers come from the
draw's own numbers, and SQL can make the same ones. Only then places become words, by the running sums of the
word counts: a word has as many places in a row as it occurs. Both are cut in bins of places and merged there in order, so
a group with most of the words is spread over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.frequency import SAMPLES, diversity_curve, frequency

#: Bins of places of each group, and buckets of words (by two hex digits of a digest) that are summed up each by itself.
BINS = 256
#: Modulus of the random numbers.
P = 2_147_483_647


def random_number(draw: Column, step: Column, seed: int) -> Column:
    """A number below P for each draw and step: three rounds of squares and products."""
    x = ((draw * 64 + step) * 48271 + (seed * 69621 + 12345)) % P
    return _round(_round(x, 40692), 16807)


def _round(x: Column, factor: int) -> Column:
    return F.transform(F.array(x), lambda v: (v * factor + v * v % P) % P)[0]


def predicted(d: Column, n: Column) -> Column:
    """Ratio of types to n words at diversity d."""
    return d / n * (F.sqrt(1 + 2 * n / d) - 1)


def least(error, low: Column, high: Column) -> Column:
    """The whole number from low to high at which error, which falls and then rises, is least: a third of the range is left out at each step."""
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")),
        lambda s, _: F.when(s["high"] - s["low"] <= 2, s).otherwise(
            F.transform(
                F.array(F.struct(s["low"].alias("low"), s["high"].alias("high"), ((s["high"] - s["low"]) / 3).cast("long").alias("third"))),
                lambda t: F.when(error(t["low"] + t["third"]) <= error(t["high"] - t["third"]), F.struct(t["low"].alias("low"), (t["high"] - t["third"]).alias("high"))).otherwise(F.struct((t["low"] + t["third"]).alias("low"), t["high"].alias("high"))),
            )[0]
        ),
    )
    left = F.transform(F.array(halved), lambda s: F.array_min(F.transform(F.sequence(s["low"], s["high"]), lambda k: F.struct(error(k).alias("error"), k.alias("k")))))[0]
    return left


def _error(points: Column | str, d: Column) -> Column:
    """Sum of squares of what the points (n, ttr) differ from the curve of d."""
    off = lambda p: p["ttr"] - predicted(d, p["n"].cast("double"))
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + off(p) * off(p))


def fitted(points: str) -> Column:
    """D, to a thousandth, whose curve is nearest to an array of points (n, ttr)."""
    return least(lambda k: _error(points, k / 1000.0), F.lit(1), F.lit(10_000_000))["k"] / 1000.0


def _placed(counts: DataFrame, by: list[str]) -> DataFrame:
    """Words with their first place (low) and the one after their last (high): running sums, first of buckets, then within each."""
    words = counts.withColumn("bucket", F.substring(F.md5("word"), 1, 2))
    sums = words.groupBy(*by, "bucket").agg(F.sum("count").alias("of"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("from", F.coalesce(F.sum("of").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "bucket").orderBy("word").rowsBetween(Window.unboundedPreceding, 0)
    out = words.withColumn("upto", F.sum("count").over(inside)).join(sums, [*by, "bucket"])
    return out.select(*by, (F.col("from") + F.col("upto") - F.col("count")).alias("low"), (F.col("from") + F.col("upto")).alias("high"))


def sampled_ratios(turns: DataFrame, by: tuple[str, ...] = ("speaker",), sizes: tuple[int, ...] = SAMPLES, samples: int = 100, trials: int = 3, seed: int = 0, case_sensitive: bool = True) -> DataFrame:
    """by, trial, n, types, ttr, sd and d: of samples of each size, the mean number of types, the mean ratio of types to words, its (population) deviation, and D of that ratio.

    Groups of fewer words than the largest size have no rows. d is 0 where no word came twice.
    """
    keys = list(by)
    counts = frequency(turns, by, case_sensitive=case_sensitive)
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("t")).where(F.col("t") >= max(sizes))
    width = F.ceil(F.col("t") / BINS)
    upto = lambda k: F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))
    draws = totals.withColumn("trial", upto(trials)).withColumn("n", F.explode(F.array(*(F.lit(x).cast("long") for x in sizes)))).withColumn("sample", upto(samples))
    draw = (F.col("trial") * 64 + F.col("n")) * 128 + F.col("sample")
    # The k-th step chooses among the first t - n + k places; a place that is taken already gives the last of them.
    last = lambda k: F.col("t") - F.col("n") + k
    place = lambda k: 1 + random_number(draw, k, seed) % last(k)
    chosen = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.array().cast("array<bigint>"), lambda a, k: F.transform(F.array(place(k)), lambda r: F.array_append(a, F.when(F.array_contains(a, r), last(k)).otherwise(r)))[0])
    places = draws.select(*keys, "trial", "n", "sample", width.alias("width"), F.explode(chosen).alias("place"))
    places = places.select(*keys, F.floor((F.col("place") - 1) / F.col("width")).alias("bin"), (F.col("place") - 1).alias("at"), "trial", "n", "sample", F.lit(None).cast("long").alias("word"))
    words = _placed(counts, keys).join(totals, keys).withColumn("width", width)
    bins = F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width")))
    null = F.lit(None).cast("long")
    starts = words.withColumn("bin", F.explode(bins)).select(*keys, "bin", F.greatest("low", F.col("bin") * F.col("width")).alias("at"), null.alias("trial"), null.alias("n"), null.alias("sample"), F.col("low").alias("word"))
    order = Window.partitionBy(*keys, "bin").orderBy("at", F.col("word").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(places).withColumn("word", F.last("word", ignorenulls=True).over(order)).where("trial is not null")
    drawn = [*keys, "trial", "n", "sample"]
    types = found.select(*drawn, "word").distinct().groupBy(*drawn).agg(F.count(F.lit(1)).alias("types"))
    sums = types.groupBy(*keys, "trial", "n").agg(F.sum("types").alias("s"), F.sum(F.col("types") * F.col("types")).alias("q"))
    n, ttr = F.col("n").cast("double"), F.col("ttr")
    out = sums.withColumn("ttr", F.col("s") / (F.col("n") * samples))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / samples - (F.col("s") / samples) * (F.col("s") / samples))) / n
    return out.select(*keys, "trial", "n", (F.col("s") / samples).alias("types"), "ttr", sd.alias("sd"), F.when(ttr < 1, 0.5 * n * ttr * ttr / (1 - ttr)).otherwise(0.0).alias("d"))


def sampled_trials(ratios: DataFrame, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """by, trial, d_average, d_sd, d_optimum and error of sampled_ratios(): mean and deviation of D over the sizes, and the D at which the curve is nearest to all, sought from the mean in steps of a thousandth up to twice and down to nothing."""
    keys = [*by, "trial"]
    rows = ratios.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "ttr", "d"))).alias("points"))
    mean = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["d"]) / F.size("points")
    rows = rows.withColumn("d_average", mean)
    apart = F.aggregate("points", F.lit(0.0), lambda a, p: a + (p["d"] - F.col("d_average")) * (p["d"] - F.col("d_average"))) / F.size("points")
    steps = F.ceil(F.col("d_average") * 1000) - 1
    best = least(lambda k: _error("points", F.col("d_average") + k / 1000.0), -steps, steps)
    rows = rows.withColumns({"d_sd": F.sqrt(apart), "best": F.when(F.col("d_average") > 0.001, best)})
    optimum = F.when(F.col("best").isNull(), F.lit(0.0)).otherwise(F.col("d_average") + F.col("best.k") / 1000.0)
    return rows.select(*keys, "d_average", "d_sd", optimum.alias("d_optimum"), F.col("best.error").alias("error"))


def sampled_diversity(turns: DataFrame, by: tuple[str, ...] = ("speaker",), **more) -> DataFrame:
    """by, d: the mean of the trials' optima."""
    trials = sampled_trials(sampled_ratios(turns, by, **more), by)
    return trials.groupBy(*by).agg(F.round(F.avg("d_optimum"), 3).alias("d"))


def vocd(turns: DataFrame, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """D of each group's expected curve, without drawing any sample; groups of fewer than 50 words have none."""
    points = diversity_curve(turns, by=by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "ttr"))).alias("points"))
    return points.select(*by, fitted("points").alias("d"))
