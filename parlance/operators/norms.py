"""Evaluations against norms: which measure is which column of a norm database, and cohorts of like age.

A norm database is one row for each child, with its scores in columns. Children of one age are summed up before anything is
joined: what is left has a row for each age in months and measure, and each such cell goes to the ages near to it. So a
cohort is a sum of cells, an interval of ages costs no comparison of all with all, and a database of any size is read once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.comparison import filter_norms


class Measure(NamedTuple):
    label: str
    column: int
    field: str


# Names and columns of measures in norm databases, with the fields of profiles.evaluation() and child_evaluation().
EVAL = (
    Measure("Utterances", 8, "utterances"),
    Measure("Total words", 2, "words"),
    Measure("NDW", 1, "different_words"),
    Measure("MLU (words)", 6, "words_per_utterance"),
    Measure("MLU (morphemes)", 7, "morphemes_per_utterance"),
    Measure("Total morphemes", 12, "morphemes"),
    Measure("Nouns", 14, "n_noun"),
    Measure("Verbs", 15, "n_verb"),
    Measure("Auxiliaries", 16, "n_aux"),
    Measure("Modals", 17, "n_mod"),
    Measure("Prepositions", 18, "n_prep"),
    Measure("Adjectives", 19, "n_adj"),
    Measure("Adverbs", 20, "n_adv"),
    Measure("Conjunctions", 21, "n_conj"),
    Measure("Pronouns", 22, "n_pron"),
    Measure("Determiners", 23, "n_det"),
    Measure("Plurals", 28, "plurals"),
    Measure("Past tense", 26, "past"),
    Measure("Present participle", 29, "present_participle"),
    Measure("Past participle", 27, "past_participle"),
    Measure("Word errors", 10, "word_errors"),
)
KIDEVAL = (
    Measure("Utterances", 0, "utterances"),
    Measure("Total words", 8, "words"),
    Measure("NDW", 9, "different_words"),
    Measure("MLU (words)", 2, "words_per_utterance"),
    Measure("MLU (morphemes)", 3, "morphemes_per_utterance"),
    Measure("VOCD", 11, "d_estimate"),
    Measure("DSS", 18, "dss"),
    Measure("IPSyn", 20, "ipsyn"),
    Measure("Word errors", 13, "word_errors"),
)
#: How far, in months, the ages of a cohort may be from a speaker's; the last, wider than any, takes all ages.
WIDTHS = (3, 6, 12)
ALL_AGES = 9999


def measured(evaluated: DataFrame, keys: tuple[str, ...], measures: tuple[Measure, ...] = EVAL) -> DataFrame:
    """keys, label, measure (the column of norm databases) and score: a row for each measure that evaluated has a field for."""
    have = [m for m in measures if m.field in evaluated.columns]
    rows = F.inline(F.array(*(F.struct(F.lit(m.label).alias("label"), F.lit(m.column).alias("measure"), F.col(m.field).cast("double").alias("score")) for m in have)))
    return evaluated.select(*keys, rows)


def as_norms(evaluated: DataFrame, measures: tuple[Measure, ...] = EVAL) -> DataFrame:
    """evaluated with its scores in the columns of a norm database, 0 where none belongs."""
    field = {m.column: m.field for m in measures}
    return evaluated.withColumn("scores", F.array(*(F.col(field[k]).cast("double") if k in field else F.lit(0.0) for k in range(max(field) + 1))))


def cohorts(norms: DataFrame, ages: DataFrame, by: tuple[str, ...] = ("language",), widths: tuple[int, ...] = WIDTHS, least: int = 5) -> DataFrame:
    """by, age_months, width, entries, measure, mean, sd and n: for each of ages (by, age_months) the statistics of its cohort.

    That is of the narrowest width with so many entries at least, else of all entries of the group; width is then ALL_AGES. An
    unknown age goes with all entries, and entries of unknown age are in no narrower cohort. sd is over n - 1, 0 for a single score.
    Groups are compared without case.
    """
    low = {c: F.lower(F.col(c)) for c in by}
    keys = list(by)
    # All children of one age: at most some hundreds of ages for each group.
    rows = norms.withColumns(low).select(*keys, "age_months", F.posexplode("scores").alias("measure", "score"))
    cells = rows.groupBy(*keys, "age_months", "measure").agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q"))
    sizes = norms.withColumns(low).groupBy(*keys, "age_months").agg(F.count(F.lit(1)).alias("entries"))
    asked = ages.withColumns(low).select(*keys, "age_months").distinct().withColumn("asked", F.coalesce("age_months", F.lit(-1)))
    to = lambda cell: F.explode(F.flatten(F.array(*(_near(cell, w) for w in widths))))

    def summed(table: DataFrame, more: list[str], sums: list[str]) -> DataFrame:
        """table's sums for each age that is asked for and each width, all ages among them."""
        near = table.where("age_months is not null").withColumn("to", to(F.col("age_months"))).select(*keys, "to.asked", "to.width", *more, *sums)
        near = near.join(asked.select(*keys, "asked"), [*keys, "asked"], "left_semi").groupBy(*keys, "asked", "width", *more).agg(*(F.sum(c).alias(c) for c in sums))
        whole = table.groupBy(*keys, *more).agg(*(F.sum(c).alias(c) for c in sums)).join(asked.select(*keys, "asked"), keys)
        return near.unionByName(whole.withColumn("width", F.lit(ALL_AGES)))

    fits = summed(sizes, [], ["entries"]).where((F.col("entries") >= least) | (F.col("width") == ALL_AGES))
    narrow = fits.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "asked").orderBy("width"))).where("place = 1").drop("place")
    stats = summed(cells, ["measure"], ["n", "s", "q"]).join(narrow, [*keys, "asked", "width"])
    n = F.col("n").cast("double")
    spread = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    # What rounding leaves of equal scores is no deviation.
    sd = F.when((n > 1) & (spread > 1e-12 * F.col("q") / n), F.sqrt(spread)).otherwise(0.0)
    return stats.where("n > 0").select(*keys, F.nullif("asked", F.lit(-1)).alias("age_months"), "width", "entries", "measure", (F.col("s") / n).alias("mean"), sd.alias("sd"), "n")


def _near(cell: Column, width: int) -> Column:
    """The ages that a cell of an age serves, within a width."""
    return F.transform(F.sequence(cell - width, cell + width), lambda a: F.struct(a.alias("asked"), F.lit(width).alias("width")))


def against_norms(
    evaluated: DataFrame, speakers: DataFrame, norms: DataFrame, measures: tuple[Measure, ...] = EVAL, keys: tuple[str, ...] = ("file", "speaker"), by: tuple[str, ...] = ("language",), widths: tuple[int, ...] = WIDTHS, least: int = 5, **chosen
) -> DataFrame:
    """keys, by, age_months, label, score, and the cohort's width, entries, mean, sd, n and z for each measure.

    evaluated: profiles.evaluation() or child_evaluation() by keys. speakers: keys, by and age_months, as in @ID headers.
    chosen: what filter_norms() takes. z is null where the deviation is 0; a group without norms has n 0 and no mean.
    """
    norms = filter_norms(norms, **chosen)
    who = speakers.select(*keys, *by, F.col("age_months").cast("int").alias("age_months"))
    scores = measured(evaluated, keys, measures).join(who, list(keys), "left").withColumns({c: F.lower(F.col(c)) for c in by})
    found = cohorts(norms, who, by, widths, least)
    fits = [scores[c].eqNullSafe(found[c]) for c in (*by, "age_months")] + [scores["measure"] == found["measure"]]
    out = scores.join(found, fits, "left").select(*(scores[c] for c in (*keys, *by, "age_months", "label", "score")), "width", "entries", "mean", "sd", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rounded = {c: F.round(c, 6) for c in ("score", "mean", "sd")}
    return out.withColumn("z", F.when(F.col("sd") > 0, F.round((F.col("score") - F.col("mean")) / F.col("sd"), 6))).withColumns(rounded)
