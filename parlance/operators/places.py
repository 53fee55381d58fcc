"""Where words stand and what they stand beside: positions, clusters, distances, keyword search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.words import folded, matches, matches_any, once


def positions(turns: DataFrame, second: bool = False) -> DataFrame:
    """Of each word: total, initial, final, other, and alone in its utterance. second: position two takes the place of the final one."""
    rows = turns.select(F.size("cw").alias("n"), F.posexplode(folded("cw")).alias("k", "word"))
    alone, first = F.col("n") == 1, F.col("k") == 0
    marked = (F.col("k") == 1) if second else (F.col("k") == F.col("n") - 1)
    count = lambda test: F.count(F.when(test, 1))
    return rows.groupBy("word").agg(
        F.count(F.lit(1)).alias("total"),
        count(~alone & first).alias("initial"),
        count(~alone & ~first & marked).alias("second" if second else "final"),
        count(~alone & ~first & ~marked).alias("other"),
        count(alone).alias("one_word"),
    )


def clusters(turns: DataFrame, size: int = 2) -> DataFrame:
    """Counts of runs of so many words within an utterance, joined by blanks."""
    runs = F.when(F.size("cw") >= size, once(folded("cw"), lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))))
    return turns.select(F.explode(runs).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))


def cluster_totals(turns: DataFrame, size: int = 2) -> DataFrame:
    """Different clusters, all clusters, and utterances with any."""
    found = clusters(turns, size).agg(F.count(F.lit(1)).alias("unique"), F.coalesce(F.sum("count"), F.lit(0)).alias("instances"))
    return found.crossJoin(turns.agg(F.count(F.when(F.size("cw") >= size, 1)).alias("utterances")))


def distances(turns: DataFrame, once_per_turn: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Of each word in each file: count, first and last turn (null if the same), and their distance over the count.

    Every utterance with words is a turn; turns are numbered within a file.
    """
    order = Window.partitionBy("file").orderBy("utt_idx")
    numbered = turns.where(F.size("cw") > 0).withColumn("turn", F.row_number().over(order))
    words = folded("cw", case_sensitive)
    rows = numbered.select("file", "turn", F.explode(F.array_distinct(words) if once_per_turn else words).alias("word"))
    out = rows.groupBy("file", "word").agg(F.count(F.lit(1)).alias("count"), F.min("turn").alias("first"), F.max("turn").alias("l"))
    return out.select("file", "word", "count", "first", F.when(F.col("l") != F.col("first"), F.col("l")).alias("last"), F.round((F.col("l") - F.col("first")) / F.col("count"), 6).alias("average"))


def keyword_lines(turns: DataFrame, keywords: list[str], strict: bool = False, before: int = 0, after: int = 0, case_sensitive: bool = False) -> DataFrame:
    """Utterances with a keyword: file, utt_idx, speaker, the first keyword matched, and texts of so many utterances around.

    strict: the utterance has one counted word only. Context is taken from the file's own (filtered) turns.
    """
    hits = F.filter("cw", lambda w: matches_any(w, keywords, case_sensitive))
    first = F.coalesce(*(F.when(_some("cw", k, case_sensitive), F.lit(k)) for k in keywords))
    order = Window.partitionBy("file").orderBy("utt_idx")
    rows = turns.withColumn("keyword", first)
    if before:
        rows = rows.withColumn("before", F.collect_list("text").over(order.rowsBetween(-before, -1)))
    if after:
        rows = rows.withColumn("after", F.collect_list("text").over(order.rowsBetween(1, after)))
    rows = rows.where(F.size(hits) > 0)
    if strict:
        rows = rows.where(F.size("cw") == 1)
    return rows.select("file", "utt_idx", "speaker", "text", "keyword", *(c for c, n in (("before", before), ("after", after)) if n))


def _some(words: str, glob: str, case_sensitive: bool) -> Column:
    return F.exists(words, lambda w: matches(w, glob, case_sensitive))


def keyword_counts(turns: DataFrame, keywords: list[str], case_sensitive: bool = False) -> DataFrame:
    """Utterances with each keyword."""
    found = F.array_compact(F.array(*(F.when(_some("cw", k, case_sensitive), F.lit(k)) for k in keywords)))
    return turns.select(F.explode(found).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))


def parse_expression(text: str) -> tuple[str, list[str]]:
    """("and", terms) where + stands between terms, else ("or", terms) where a comma does, else one term."""
    if "+" in text:
        return "and", [t.strip() for t in text.split("+") if t.strip()]
    return "or", [t.strip() for t in text.split(",") if t.strip()]


def expression(text: str, case_sensitive: bool = False) -> Column:
    """Whether an utterance's words satisfy a search expression."""
    kind, terms = parse_expression(text)
    tests = [_some("cw", t, case_sensitive) for t in terms]
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if kind == "and" else (out | t)
    return out


def combinations(turns: DataFrame, expressions: list[str], exclude: list[str] = (), first_only: bool = False, dedupe: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Utterances that satisfy an expression and no excluded one, with the number of the expression and the words that matched.

    first_only: only the first expression that holds; dedupe: each word once.
    """
    each = []
    for k, text in enumerate(expressions):
        words = _matched(parse_expression(text)[1], case_sensitive)
        words = F.array_distinct(words) if dedupe else words
        each.append(F.when(expression(text, case_sensitive), F.struct(F.lit(k).alias("expression"), words.alias("matched"))))
    found = F.array_compact(F.array(*each))
    rows = turns
    for text in exclude:
        rows = rows.where(~expression(text, case_sensitive))
    rows = rows.select("file", "utt_idx", "speaker", F.explode(F.slice(found, 1, 1) if first_only else found).alias("m"))
    return rows.select("file", "utt_idx", "speaker", "m.expression", F.array_join("m.matched", " ").alias("matched"))


def _matched(terms: list[str], case_sensitive: bool) -> Column:
    return F.filter("cw", lambda w: matches_any(w, terms, case_sensitive))


def unique_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Counts of lines, trimmed and in lower case."""
    return lines.groupBy(F.lower(F.trim(line)).alias("line")).agg(F.count(F.lit(1)).alias("count"))
