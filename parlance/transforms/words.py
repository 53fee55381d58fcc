"""Transforms of words and turns. Each takes and returns a DataFrame; words are in column cw unless named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.words import col


def changed_strings(turns: DataFrame, changes: list[tuple[str, str]], words: str = "cw") -> DataFrame:
    """Every change in turn, in every word."""

    def change(w: Column) -> Column:
        for a, b in changes:
            w = F.replace(w, F.lit(a), F.lit(b))
        return w

    return turns.withColumn(words, F.transform(words, change))


def lower_case(turns: DataFrame, words: str = "cw") -> DataFrame:
    """All words but I in lower case."""
    return turns.withColumn(words, F.transform(words, lambda w: F.when(w == "I", w).otherwise(F.lower(w))))


def compounds(turns: DataFrame, dash_to_plus: bool = True, words: str = "cw") -> DataFrame:
    """a-b becomes a+b where all parts are letters."""
    if not dash_to_plus:
        return turns
    return turns.withColumn(words, F.transform(words, lambda w: F.when(F.rlike(w, F.lit(r"^\p{L}+(-\p{L}+)+$")), F.translate(w, "-", "+")).otherwise(w)))


def with_terminator(turns: DataFrame) -> DataFrame:
    """A full stop where there is no terminator."""
    return turns.withColumn("terminator", F.coalesce("terminator", F.lit(".")))


def plain_tier(turns: DataFrame) -> DataFrame:
    """file, utt_idx, speaker and flo: counted words and the terminator."""
    return turns.select("file", "utt_idx", "speaker", F.concat_ws(" ", F.array_join("cw", " "), F.coalesce("terminator", F.lit("."))).alias("flo"))


def lexicon_tier(turns: DataFrame, lexicon: DataFrame, all_forms: bool = False) -> DataFrame:
    """file, utt_idx and mod: for each word its form in the lexicon (word in upper case, form, k), ??? if it has none; all forms joined by ^.

    Words are joined with the lexicon by hash; Spark broadcasts it if it is small.
    """
    forms = lexicon.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("k", "form"))).alias("f"))
    forms = forms.select(F.col("word").alias("key"), (F.array_join(F.transform("f", lambda x: x["form"]), "^") if all_forms else F.col("f")[0]["form"]).alias("form"))
    rows = turns.select("file", "utt_idx", F.posexplode("cw").alias("k", "word")).join(forms, F.upper("word") == F.col("key"), "left")
    out = rows.groupBy("file", "utt_idx").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("form", F.lit("???")).alias("form")))).alias("f"))
    return out.select("file", "utt_idx", F.array_join(F.transform("f", lambda x: x["form"]), " ").alias("mod"))


def respelled(turns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """file, utt_idx, words replaced by a dictionary (word in lower case, spelling), and ort: the words as they were, where any changed."""
    rows = turns.select("file", "utt_idx", F.posexplode("cw").alias("k", "word")).join(dictionary.select(F.col("word").alias("key"), "spelling"), F.lower("word") == F.col("key"), "left")
    out = rows.groupBy("file", "utt_idx").agg(F.sort_array(F.collect_list(F.struct("k", "word", "spelling"))).alias("w"), F.count("spelling").alias("n"))
    join = lambda f: F.array_join(F.transform("w", f), " ")
    return out.select("file", "utt_idx", join(lambda x: F.coalesce(x["spelling"], x["word"])).alias("words"), F.when(F.col("n") > 0, join(lambda x: x["word"])).alias("ort"))


def marked_repeats(turns: DataFrame, speaker: str, marks: tuple[str, ...] = ("[//]", "[///]", "[/-]")) -> DataFrame:
    """Adds the postcode rep to a speaker's utterances whose text has a mark of repetition."""
    has = F.lit(False)
    for m in marks:
        has = has | F.contains("text", F.lit(m))
    return turns.withColumn("postcodes", F.when((F.col("speaker") == speaker) & has, F.array_union(F.coalesce("postcodes", F.array().cast("array<string>")), F.array(F.lit("rep")))).otherwise(F.col("postcodes")))


def renamed_speakers(df: DataFrame, names: dict[str, str], column: str = "speaker") -> DataFrame:
    """Speakers by their new codes, in turns, ids or headers."""
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, new).otherwise(out)
    return df.withColumn(column, out)


def postmortem(content: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Sequences of tokens rewritten by rules (from, to), one rule after the other, from left to right without overlap.

    * in from stands for any token; * or $- in to for the token at the same place of what was found.
    """
    out = col(content)
    for source, target in rules:
        wanted, new, groups, pattern, replaced = source.split(), target.split(), 0, [], []
        at = {}
        for k, token in enumerate(wanted):
            if token == "*":
                groups += 1
                at[k] = groups
                pattern.append(r"(\S+)")
            else:
                pattern.append("".join("\\" + c if not c.isalnum() else c for c in token))
        for k, token in enumerate(new):
            replaced.append(f"${at[k]}" if token in ("*", "$-") and k in at else token.replace("\\", "\\\\").replace("$", "\\$"))
        out = F.regexp_replace(out, r"(?<!\S)" + " ".join(pattern) + r"(?!\S)", " ".join(replaced))
    return out
