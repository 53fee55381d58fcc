"""Profiles of speakers: sentence scoring, syntax indices, part-of-speech and fluency tables, complexity."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.morphology import CLASSES, all_words, any_item_matches, any_pos_starts, base_relation, classify, feature_morphemes, inflections, is_verb, item_matches
from parlance.functions.words import folded, once, ratio

# Categories of developmental sentence scoring, their patterns and points.
DSS_RULES = (
    ("indefinite_pronouns", ("pro:indef",), 1),
    ("personal_pronouns", ("pro:sub", "pro:obj"), 1),
    ("main_verbs", ("v",), 1),
    ("copula", ("cop",), 2),
    ("auxiliaries", ("aux",), 2),
    ("past_tense", ("v-PAST",), 2),
    ("negation", ("neg",), 1),
    ("conjunctions", ("conj:coo", "conj:sub"), 3),
    ("wh_questions", ("pro:wh", "adv:wh"), 2),
    ("articles", ("det:art",), 1),
)
# Prefixes that make a subject and a verb, for the point of a complete sentence.
SUBJECTS, VERBS = ("pro:sub", "pro:per", "pron", "propn", "n"), ("v", "cop", "aux")


class Syntax(NamedTuple):
    name: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


# Rules of the index of productive syntax.
IPSYN_RULES = (
    Syntax("N1", ("n|",)),
    Syntax("N2", ("det|", "n|")),
    Syntax("N3", ("adj|", "n|")),
    Syntax("N4", ("n|", "POSS")),
    Syntax("N5", ("pro:sub|",)),
    Syntax("N6", ("pro:obj|",)),
    Syntax("V1", ("v|",)),
    Syntax("V2", ("v|", "PAST")),
    Syntax("V3", ("cop|",)),
    Syntax("V4", ("aux|",)),
    Syntax("V5", ("mod|",)),
    Syntax("Q1", ("pro:wh|",)),
    Syntax("Q2", ("adv:wh|",)),
    Syntax("S1", ("pro:sub|", "v|")),
    Syntax("S2", ("neg|",)),
    Syntax("S3", ("conj:coo|",)),
    Syntax("S4", ("conj:sub|",)),
    Syntax("S5", ("prep|",)),
)
# Relations that make an utterance complex, those of both styles and of the older one alone.
COMPLEX_UD, COMPLEX_BOTH = ("CCOMP", "XCOMP", "ACL", "ADVCL", "APPOS", "EXPL"), ("CSUBJ",)
COMPLEX_LEGACY = ("COMP", "CPRED", "CPOBJ", "COBJ", "CJCT", "XJCT", "NJCT", "CMOD", "XMOD")
# Relations that make a clause subordinate.
SUBORDINATE = ("CSUBJ", "CPRED", "CPOBJ", "COBJ", "CJCT", "XJCT", "CMOD", "XMOD", "COMP")
INFLECTIONS = ("plurals", "past", "present_participle", "past_participle")
OPEN_CLASSES, CLOSED_CLASSES = ("noun", "verb", "adj", "adv"), ("aux", "mod", "prep", "conj", "det", "pron")


def first_utterances(turns: DataFrame, most: int) -> DataFrame:
    """The first utterances with a mor tier of each speaker, by file and utt_idx. Each task keeps no more than so many before the shuffle."""
    order = Window.partitionBy("speaker").orderBy("file", "utt_idx")
    return turns.where(F.size("mor") > 0).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def sentence_scores(turns: DataFrame, rules=DSS_RULES, most: int = 50) -> DataFrame:
    """Of each speaker: utterances, points by category, points of complete sentences, and the mean score."""
    rows = first_utterances(turns, most)

    def points_of(words: Column) -> Column:
        found = [F.when(reduce(lambda a, b: a | b, [any_item_matches(words, p) for p in patterns]), points).otherwise(0).alias(name) for name, patterns, points in rules]
        whole = F.when(any_pos_starts(words, SUBJECTS) & any_pos_starts(words, VERBS), 1).otherwise(0).alias("sentence_points")
        return F.struct(*found, whole)

    columns = [*(name for name, _, _ in rules), "sentence_points"]
    rows = rows.select("speaker", once(all_words("mor"), points_of).alias("p")).select("speaker", "p.*")
    out = rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("utterances"), *(F.sum(k).alias(k) for k in columns))
    total = reduce(lambda a, b: a + b, [F.col(k) for k in columns])
    return out.withColumn("score", F.round(total / F.col("utterances"), 6))


def syntax_index(turns: DataFrame, rules=IPSYN_RULES, most: int = 100) -> DataFrame:
    """Of each speaker: utterances and, for each rule, how many utterances show it, 2 at most; sums by kind (first letter) and in all."""
    rows = first_utterances(turns, most)

    def shown(words: Column, rule: Syntax) -> Column:
        out = reduce(lambda a, b: a & b, [any_item_matches(words, p) for p in rule.include])
        for p in rule.exclude:
            out = out & ~any_item_matches(words, p)
        return out

    rows = rows.select("speaker", once(all_words("mor"), lambda words: F.struct(*(shown(words, r).alias(r.name) for r in rules))).alias("r")).select("speaker", "r.*")
    out = rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("utterances"), *(F.least(F.lit(2), F.count(F.when(F.col(r.name), 1))).cast("long").alias(r.name) for r in rules))
    kinds = sorted({r.name[0] for r in rules})
    total = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return out.withColumns({f"total_{k}": total([r.name for r in rules if r.name[0] == k]) for k in kinds}).withColumn("total", total([r.name for r in rules]))


def evaluation(turns: DataFrame, by: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """One wide row for each speaker: utterances, words, different words and their ratio, mean lengths, parts of speech, inflections, errors and the ratio of open to closed classes."""
    classes = [c for c, _, _ in CLASSES]
    errors = F.col("n_err") if "n_err" in turns.columns else F.lit(0)
    # One row for each word of the mor tier, and for an utterance without any; the first one stands for the utterance.
    each = turns.where(F.size("cw") > 0).select(*by, F.size("cw").cast("long").alias("w"), errors.cast("long").alias("errors"), F.posexplode_outer(all_words("mor")).alias("k", "x"))
    has = inflections(F.col("x.features"))
    each = each.select(*by, "w", "errors", (F.coalesce("k", F.lit(0)) == 0).alias("first"), classify(F.col("x.pos")).alias("class"), F.when(F.col("k").isNotNull(), 1 + F.size("x.features")).alias("m"), *(has[k].alias(k) for k in INFLECTIONS))
    first = lambda c: F.sum(F.when(F.col("first"), F.col(c)))
    sums = each.groupBy(*by).agg(
        F.count(F.when(F.col("first"), 1)).alias("utterances"), first("w").alias("words"), F.coalesce(F.sum("m"), F.lit(0)).alias("morphemes"), F.coalesce(first("errors"), F.lit(0)).alias("word_errors"),
        *(F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c}") for c in classes), *(F.count(F.when(F.col(k), 1)).alias(k) for k in INFLECTIONS),
    )
    types = turns.select(*by, F.explode(folded("cw")).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.count(F.lit(1)).alias("different_words"))
    add = lambda names: reduce(lambda a, b: a + b, [F.col(f"n_{n}") for n in names])
    return sums.join(types, list(by)).withColumns(
        {
            "ttr": F.round(ratio("different_words", "words"), 6),
            "words_per_utterance": F.round(ratio("words", "utterances"), 6),
            "morphemes_per_utterance": F.round(ratio("morphemes", "utterances"), 6),
            "open_closed": F.round(F.when(add(CLOSED_CLASSES) > 0, add(OPEN_CLASSES) / add(CLOSED_CLASSES)), 6),
        }
    )


def child_evaluation(turns: DataFrame) -> DataFrame:
    """Evaluation, sentence scores, syntax index and an estimate of D for each speaker: n ttr^2 / (1 - ttr), 0 to 120, 0 for fewer than 50 words."""
    base = evaluation(turns).select("speaker", "utterances", "words", "different_words", "ttr", "words_per_utterance", "morphemes_per_utterance")
    exact = F.col("different_words") / F.col("words")
    d = F.when(F.col("words") < 50, 0.0).when(F.col("different_words") == F.col("words"), 120.0).otherwise(F.least(F.lit(120.0), F.col("words") * exact * exact / (1 - exact)))
    return base.withColumn("d_estimate", F.round(d, 6)).join(sentence_scores(turns).select("speaker", F.col("score").alias("dss")), "speaker", "left").join(syntax_index(turns).select("speaker", F.col("total").alias("ipsyn")), "speaker", "left")


def sampling_profile(turns: DataFrame) -> DataFrame:
    """Of each speaker: utterances with a mor tier, features per utterance, words, words per utterance with a verb, and clauses per such utterance."""
    rows = turns.where((F.size("cw") > 0) & (F.size("mor") > 0))
    clauses = 1 + F.size(F.filter("gra", lambda r: F.upper(r["relation"]).isin(*SUBORDINATE)))
    rows = rows.select("speaker", feature_morphemes("mor").alias("m"), F.size("cw").cast("long").alias("w"), F.exists(all_words("mor"), lambda x: is_verb(x["pos"])).alias("verb"), F.coalesce(clauses, F.lit(1)).cast("long").alias("c"))
    out = rows.groupBy("speaker").agg(
        F.count(F.lit(1)).alias("utterances"), F.sum("m").alias("morphemes"), F.sum("w").alias("words"),
        F.count(F.when(F.col("verb"), 1)).alias("verb_utterances"), F.coalesce(F.sum(F.when(F.col("verb"), F.col("w"))), F.lit(0)).alias("v"), F.coalesce(F.sum(F.when(F.col("verb"), F.col("c"))), F.lit(0)).alias("clauses"),
    )
    per = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.select("speaker", "utterances", "words", "verb_utterances", "clauses", per("morphemes", "utterances").alias("mlu"), per("v", "verb_utterances").alias("words_per_sentence"), per("clauses", "verb_utterances").alias("clauses_per_sentence"))


def complexity(turns: DataFrame) -> DataFrame:
    """Of each speaker: counts of complex relations, their sum, all relations but PUNCT, and the ratio. Which relations count depends on the style that the whole corpus shows."""
    rows = turns.select("speaker", F.explode("gra").alias("r")).select("speaker", base_relation("r.relation").alias("r")).where("r != 'PUNCT'")
    counts = rows.groupBy("speaker", "r").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.coalesce(F.bool_or(F.col("r").isin(*COMPLEX_LEGACY)), F.lit(False)).alias("old"), F.coalesce(F.bool_or(F.col("r").isin(*COMPLEX_UD)), F.lit(False)).alias("ud"))
    legacy = F.col("old") & ~F.col("ud")
    counts = counts.crossJoin(F.broadcast(seen))  # one row
    labels = COMPLEX_UD + COMPLEX_BOTH + COMPLEX_LEGACY
    of = lambda label: F.coalesce(F.sum(F.when((F.col("r") == label) & (F.lit(label in COMPLEX_BOTH) | (legacy if label in COMPLEX_LEGACY else ~legacy)), F.col("n"))), F.lit(0)).alias(label.lower())
    out = counts.groupBy("speaker").agg(*map(of, labels), F.sum("n").alias("relations"))
    total = reduce(lambda a, b: a + b, [F.col(x.lower()) for x in labels])
    return out.withColumn("complex", total).withColumn("ratio", F.round(ratio("complex", "relations"), 6))


def morpheme_table(turns: DataFrame, rules: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Counts of labels of each speaker's main words. rules: (mode, label, patterns +, patterns -).

    With a + pattern any of them makes a match, else all others must; a matching rule of mode OR ends the
    search, one of mode AND lets it go on.
    """
    rows = turns.select("speaker", F.explode(F.transform("mor", lambda i: i["main"])).alias("w"))
    done, found = F.lit(False), []
    for mode, label, some, others in rules:
        any_of = [item_matches(F.col("w"), p) for p in some]
        all_of = [item_matches(F.col("w"), p) for p in others]
        fits = reduce(lambda a, b: a | b, any_of) if any_of else reduce(lambda a, b: a & b, all_of) if all_of else F.lit(False)
        fits = fits & ~done
        found.append(F.when(fits, F.lit(label)))
        if mode == "OR":
            done = done | fits
    rows = rows.select("speaker", F.explode(F.array_compact(F.array(*found))).alias("label"))
    return rows.groupBy("speaker", "label").agg(F.count(F.lit(1)).alias("count"))


def fluency(turns: DataFrame, words: str = "words") -> DataFrame:
    """Of each speaker: words, prolongations, broken words, repeated words, phrase repetitions, revisions, fillers and fragments, and both rates per 100 words.

    words: an array of word structs (raw, category, retrace_kind), those in retraces too. A word repeats
    the one before it in its utterance if they are equal in lower case and without lengthening.
    """
    names = ("words", "prolongations", "broken", "repetitions", "phrase_repetitions", "revisions", "fillers", "fragments")

    def counts(x: Column) -> Column:
        count = lambda test: F.size(F.filter(x, test)).cast("long")
        of = lambda name: count(lambda w: F.coalesce(w["category"] == name, F.lit(False)))
        bare = F.transform(x, lambda w: F.lower(F.translate(w["raw"], ":", "")))
        kinds = F.transform(x, lambda w: F.coalesce(w["retrace_kind"], F.lit("")))
        # Adjacent words in retraces of one kind are one retrace.
        runs = lambda name: once(kinds, lambda k: F.size(F.filter(_places(k), lambda i: (F.get(k, i) == name) & ~F.get(k, i - 1).eqNullSafe(F.lit(name)))))
        found = (
            F.size(x), count(lambda w: F.contains(w["raw"], F.lit(":"))), count(lambda w: F.contains(w["raw"], F.lit("^"))), _repeated(bare),
            runs("partial"), runs("full"), of("filler"), of("fragment"),
        )
        return F.struct(*(c.cast("long").alias(n) for c, n in zip(found, names, strict=True)))

    rows = turns.select("speaker", once(F.col(words), counts).alias("c")).select("speaker", "c.*")
    out = rows.groupBy("speaker").agg(*(F.sum(c).alias(c) for c in rows.columns[1:]))
    per = lambda names: F.round(100 * ratio(reduce(lambda a, b: a + b, [F.col(n) for n in names]), F.col("words")), 6)
    return out.withColumns({"stuttering_rate": per(["prolongations", "broken", "repetitions"]), "typical_rate": per(["phrase_repetitions", "revisions", "fillers", "fragments"])})


def _places(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))


def _repeated(words: Column) -> Column:
    """How many words are equal to the one before them."""
    return once(words, lambda w: F.size(F.filter(_places(w), lambda i: F.coalesce(F.get(w, i) == F.get(w, i - 1), F.lit(False)))))


def repeated_words(turns: DataFrame) -> DataFrame:
    """Of each speaker: words and words equal to the one before them in their utterance, for turns that have only cw."""
    rows = turns.select("speaker", F.size("cw").cast("long").alias("n"), _repeated(folded("cw")).cast("long").alias("r"))
    return rows.groupBy("speaker").agg(F.sum("n").alias("words"), F.sum("r").alias("repetitions")).withColumn("rate", F.round(100 * ratio("repetitions", "words"), 6))
