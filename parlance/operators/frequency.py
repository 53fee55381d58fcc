"""Word frequencies, their variants, and lexical diversity.

All are one map-side combined aggregation over exploded words; types and tokens are summed from the
counts, so no distinct aggregation expands the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.morphology import all_words, rendered
from parlance.functions.words import capitalised, folded, matches, matches_any, ratio, split_at

#: Speaker code of everything taken together.
ALL = "*"


def tokens(turns: DataFrame, words: Column | str = "cw", by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """A row for each word: by and word."""
    return turns.select(*by, F.explode(words).alias("word"))


def frequency(
    turns: DataFrame,
    by: tuple[str, ...] = ("speaker",),
    words: Column | str = "cw",
    case_sensitive: bool = True,
    include: list[str] = (),
    exclude: list[str] = (),
    capital: str | None = None,
    delimiters: str = "",
    combine_speakers: bool = False,
) -> DataFrame:
    """Counts of words: by, word, count. by without speaker, or combine_speakers, takes all speakers together."""
    if combine_speakers:
        by = tuple(c for c in by if c != "speaker")
    rows = tokens(turns, folded(words, case_sensitive), by)
    if delimiters:
        rows = rows.select(*by, F.explode(split_at("word", delimiters)).alias("word"))
    if include:
        rows = rows.where(matches_any("word", list(include), case_sensitive))
    if exclude:
        rows = rows.where(~matches_any("word", list(exclude), case_sensitive))
    if capital:
        rows = rows.where(capitalised("word", capital))
    return rows.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"))


def types_and_tokens(counts: DataFrame, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """types, tokens and their ratio, of frequency()'s counts."""
    out = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("tokens"))
    return out.withColumn("ttr", F.round(ratio("types", "tokens"), 6))


def ordered(counts: DataFrame, order: str = "alphabetical", by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """alphabetical, frequency (then alphabetical), or reverse: by the words read backwards."""
    keys = {"alphabetical": [F.col("word")], "frequency": [F.desc("count"), F.col("word")], "reverse": [F.reverse("word"), F.col("word")]}[order]
    return counts.orderBy(*by, *keys)


def top(counts: DataFrame, k: int, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """The k most frequent words of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_zeros(counts: DataFrame, patterns: list[str], case_sensitive: bool = False) -> DataFrame:
    """Requested words and those of them that never came, with 0."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    key = F.col("pattern") if case_sensitive else F.lower("pattern")
    word = F.col("word") if case_sensitive else F.lower("word")
    sums = counts.groupBy(word.alias("key")).agg(F.sum("count").alias("count"))
    return wanted.join(sums, key == F.col("key"), "left").select(F.col("pattern").alias("word"), F.coalesce("count", F.lit(0)).alias("count"))


def by_pattern(turns: DataFrame, patterns: list[str], case_sensitive: bool = False) -> DataFrame:
    """Counts of each pattern: a word counts once for each pattern that it matches."""
    rows = tokens(turns)
    hits = F.array(*(F.when(matches("word", p, case_sensitive), F.lit(p)) for p in patterns))
    return rows.select("speaker", F.explode(F.array_compact(hits)).alias("pattern")).groupBy("speaker", "pattern").agg(F.count(F.lit(1)).alias("count"))


def by_share_of_speakers(turns: DataFrame, percent: int, sign: str = ">=") -> DataFrame:
    """Words whose number of (file, speaker) rows compares so with percent of all such rows, rounded down."""
    counts = frequency(turns, ("file", "speaker"))
    total = turns.where(F.size("cw") > 0).select("file", "speaker").distinct().count()
    least = total * percent // 100
    words = counts.groupBy("word").agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("count"))
    n = F.col("rows")
    return words.where({"<": n < least, "<=": n <= least, "=": n == least, ">=": n >= least, ">": n > least}[sign])


def wide(counts: DataFrame, words: list[str], by: tuple[str, ...] = ("file", "speaker")) -> DataFrame:
    """A row for each file and speaker, a column for each given word, and types, tokens and their ratio."""
    columns = [F.coalesce(F.sum(F.when(F.col("word") == w, F.col("count"))), F.lit(0)).alias(f"w_{w}") for w in words]
    out = counts.groupBy(*by).agg(*columns, F.count(F.lit(1)).alias("types"), F.sum("count").alias("tokens"))
    return out.withColumn("ttr", F.round(ratio("types", "tokens"), 6))


def of_tier(turns: DataFrame, tier: str = "mor", by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """Counts over a tier: rendered main words and clitics of mor, items of any other."""
    items = F.transform(all_words("mor"), rendered) if tier == "mor" else F.transform("gra", lambda r: F.concat_ws("|", r["idx"].cast("string"), r["head"].cast("string"), r["relation"])) if tier == "gra" else F.col(tier)
    return frequency(turns, by, items)


def sequences(turns: DataFrame, patterns: list[str], by: tuple[str, ...] = ("speaker",), alone: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Counts of runs of words that match the patterns in order; matches don't overlap. alone: the run is the whole utterance."""
    n = len(patterns)
    words = F.col("cw")
    fits = lambda i: math_and([matches(F.element_at(words, (i + k + 1).cast("int")), p, case_sensitive) for k, p in enumerate(patterns)])
    places = F.when(F.size(words) >= n, F.filter(F.sequence(F.lit(0), F.size(words) - n), fits)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("count"))
    chosen = F.aggregate(places, start, lambda s, i: F.when(i >= s["last"] + n, F.struct(i.alias("last"), (s["count"] + 1).alias("count"))).otherwise(s), lambda s: s["count"])
    rows = turns.where(F.size("cw") == n) if alone else turns
    return rows.groupBy(*by).agg(F.sum(chosen).alias("count")).where("count > 0").select(*by, F.lit(" ".join(patterns)).alias("group"), "count")


def any_order(turns: DataFrame, patterns: list[str], by: tuple[str, ...] = ("speaker",), case_sensitive: bool = False) -> DataFrame:
    """Counts of utterances' complete sets of words that fill all patterns, in any order."""
    have = [_matching("cw", p, case_sensitive) for p in patterns]
    n = F.least(*have) if len(have) > 1 else have[0]
    return turns.groupBy(*by).agg(F.sum(n).cast("long").alias("count")).where("count > 0").select(*by, F.lit(" ".join(patterns)).alias("group"), "count")


def _matching(words: str, pattern: str, case_sensitive: bool) -> Column:
    return F.size(F.filter(words, lambda w: matches(w, pattern, case_sensitive)))


def math_and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def moving_ratio(turns: DataFrame, window: int, by: tuple[str, ...] = ("file", "speaker"), case_sensitive: bool = False) -> DataFrame:
    """Mean type-token ratio of all windows of so many words; null for fewer words.

    In closed form: a word is the first of its kind in as many windows as lie between its previous
    place and itself, so no window is ever built.
    """
    rows = turns.select(*by, "utt_idx", F.posexplode(folded("cw", case_sensitive)).alias("pos", "word"))
    order = ("utt_idx",) if "file" in by else ("file", "utt_idx")
    if "file" not in by:
        rows = turns.select(*by, "file", "utt_idx", F.posexplode(folded("cw", case_sensitive)).alias("pos", "word"))
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("i", F.row_number().over(whole.orderBy(*order, "pos")))
    rows = rows.withColumn("p", F.coalesce(F.lag("i").over(Window.partitionBy(*by, "word").orderBy("i")), F.lit(0)))
    n = F.lit(window)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("t"))
    rows = rows.join(totals, list(by))
    first_in = F.greatest(F.lit(0), F.least("i", F.col("t") - n + 1) - F.greatest(F.col("i") - n + 1, F.col("p") + 1, F.lit(1)) + 1)
    out = rows.groupBy(*by).agg(F.max("t").alias("tokens"), F.sum(first_in).alias("s"))
    mean = F.when(F.col("tokens") >= n, F.round(F.col("s") / (n * (F.col("tokens") - n + 1)), 6))
    return out.select(*by, "tokens", mean.alias("mattr"))


def core_lexicon(turns: DataFrame, least: int = 3) -> DataFrame:
    """Each word's frequency, number of speakers, and whether it is frequent enough to be core."""
    counts = frequency(turns, case_sensitive=False)
    out = counts.groupBy("word").agg(F.sum("count").alias("frequency"), F.count(F.lit(1)).alias("speakers"))
    return out.withColumn("core", F.col("frequency") >= least)


SAMPLES = tuple(range(35, 51))


def diversity_curve(turns: DataFrame, sizes: tuple[int, ...] = SAMPLES, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """Expected type-token ratio of samples of each size, without drawing any: words of equal frequency are taken together."""
    counts = frequency(turns, by)
    spectrum = counts.groupBy(*by, "count").agg(F.count(F.lit(1)).alias("words"))
    totals = spectrum.groupBy(*by).agg(F.sum(F.col("count") * F.col("words")).alias("t"))
    rows = spectrum.join(totals, list(by)).where(F.col("t") >= max(sizes)).withColumn("n", F.explode(F.array(*map(F.lit, sizes))))
    missed = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (F.col("t") - F.col("count") - i).cast("double")) / (F.col("t") - i).cast("double"))
    out = rows.groupBy(*by, "n").agg(F.sum(F.col("words") * (1 - missed)).alias("types"))
    return out.select(*by, "n", F.round(F.col("types") / F.col("n"), 6).alias("ttr"))
