"""Turns to other formats: one row for each block or line, or one text for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.times import clock


def _timed(turns: DataFrame) -> DataFrame:
    return turns.where("start_ms is not null and end_ms is not null and text != ''")


def subtitles(turns: DataFrame, vtt: bool = False) -> DataFrame:
    """file, n and block of each timed turn with a text: SRT, or WebVTT with points in its times."""
    rows = _timed(turns)
    n = F.row_number().over(Window.partitionBy("file").orderBy("utt_idx")).cast("long")
    point = "." if vtt else ","
    times = F.concat(clock("start_ms", point), F.lit(" --> "), clock("end_ms", point))
    return rows.select("file", n.alias("n"), F.concat_ws("\n", *([] if vtt else [n.cast("string")]), times, "text").alias("block"))


def whole(blocks: DataFrame, first: str = "", between: str = "\n\n") -> DataFrame:
    """file and text: the blocks of each file in order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]), between)
    return blocks.groupBy("file").agg(F.concat(F.lit(first), joined, F.lit("\n")).alias("text"))


def plain(turns: DataFrame, speakers: bool = False) -> DataFrame:
    """file, utt_idx and line: what is said, with the speaker before it if asked for."""
    said = F.array_join("cw", " ")
    return turns.where(F.size("cw") > 0).select("file", "utt_idx", (F.concat(F.col("speaker"), F.lit(": "), said) if speakers else said).alias("line"))


def chat(turns: DataFrame, language: str = "eng") -> DataFrame:
    """file and text: a transcript with headers, from turns with text and terminator."""
    bullet = F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.concat(F.lit(" \u0015"), F.col("start_ms").cast("string"), F.lit("_"), F.col("end_ms").cast("string"), F.lit("\u0015"))) if "start_ms" in turns.columns else F.lit(None).cast("string")
    line = F.concat(F.lit("*"), F.col("speaker"), F.lit(":\t"), F.col("text"), F.lit(" "), F.coalesce("terminator", F.lit(".")), F.coalesce(bullet, F.lit("")))
    rows = turns.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("utt_idx", line.alias("line")))).alias("l"), F.sort_array(F.collect_set("speaker")).alias("s"))
    people = F.array_join(F.transform("s", lambda s: F.concat(s, F.lit(" Participant"))), ", ")
    ids = F.array_join(F.transform("s", lambda s: F.concat(F.lit(f"@ID:\t{language}|corpus|"), s, F.lit("|||||Participant|||"))), "\n")
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("file", F.concat_ws("\n", F.lit("@UTF8"), F.lit("@Begin"), F.lit(f"@Languages:\t{language}"), F.concat(F.lit("@Participants:\t"), people), ids, body, F.lit("@End\n")).alias("text"))


def filled_times(turns: DataFrame, lasts: int = 1000) -> DataFrame:
    """Turns with times: one without begins where the last timed one before ended, plus what untimed ones between took."""
    order = Window.partitionBy("file").orderBy("utt_idx")
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    rows = turns.withColumn("e", F.coalesce(F.last(F.when(timed, F.col("end_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("run", F.sum(F.when(timed, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.sum(F.when(timed, 0).otherwise(1)).over(Window.partitionBy("file", "run").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(timed, F.col("start_ms")).otherwise(F.col("e") + lasts * F.coalesce(k, F.lit(0)))
    last_of_timed = F.last(F.when(timed, F.col("end_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.when(timed, F.col("start_ms")).otherwise(F.coalesce(last_of_timed, F.lit(0)) + lasts * F.coalesce(k, F.lit(0)))
    return rows.withColumn("s", start).withColumn("end_ms", F.when(timed, F.col("end_ms")).otherwise(F.col("s") + lasts)).withColumn("start_ms", F.col("s")).drop("s", "e", "run")


def _escaped(x: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        x = F.replace(x, F.lit(char), F.lit(f"&{name};"))
    return x


def eaf(turns: DataFrame) -> DataFrame:
    """file and text: an ELAN document, a tier for each speaker."""
    rows = filled_times(turns).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("utt_idx")))
    one = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", "speaker", "text", "start_ms", "end_ms"))).alias("r"))
    slot = lambda id_, ms: F.concat(F.lit('<TIME_SLOT TIME_SLOT_ID="ts'), id_.cast("string"), F.lit('" TIME_VALUE="'), ms.cast("string"), F.lit('"/>'))
    slots = F.array_join(F.transform("r", lambda x: F.concat(slot(2 * x["n"] - 1, x["start_ms"]), F.lit("\n"), slot(2 * x["n"], x["end_ms"]))), "\n")
    note = lambda x: F.concat(
        F.lit('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a'), x["n"].cast("string"), F.lit('" TIME_SLOT_REF1="ts'), (2 * x["n"] - 1).cast("string"), F.lit('" TIME_SLOT_REF2="ts'), (2 * x["n"]).cast("string"),
        F.lit('"><ANNOTATION_VALUE>'), _escaped(x["text"]), F.lit("</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>"),
    )
    speakers = F.array_sort(F.array_distinct(F.transform("r", lambda x: x["speaker"])))
    tier = lambda s: F.concat(F.lit('<TIER LINGUISTIC_TYPE_REF="default" TIER_ID="'), s, F.lit('">\n'), F.array_join(F.transform(F.filter("r", lambda x: x["speaker"] == s), note), "\n"), F.lit("\n</TIER>"))
    tiers = F.array_join(F.transform(speakers, tier), "\n")
    return one.select("file", F.concat_ws("\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<ANNOTATION_DOCUMENT FORMAT="3.0" VERSION="3.0">'), F.lit("<TIME_ORDER>"), slots, F.lit("</TIME_ORDER>"), tiers, F.lit("</ANNOTATION_DOCUMENT>\n")).alias("text"))


def textgrid(turns: DataFrame) -> DataFrame:
    """file and text: a Praat TextGrid in the long form, a tier of intervals for each speaker."""
    one = _timed(turns).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "speaker", "text"))).alias("r"), F.max("end_ms").alias("m"))
    s = lambda ms: F.format_string("%.3f", ms / 1000)
    speakers = F.array_sort(F.array_distinct(F.transform("r", lambda x: x["speaker"])))

    def interval(x: Column, i: Column) -> Column:
        return F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), s(x["start_ms"]), F.lit("\n            xmax = "), s(x["end_ms"]), F.lit('\n            text = "'), F.replace(x["text"], F.lit('"'), F.lit('""')), F.lit('"'))

    def tier(speaker: Column, k: Column) -> Column:
        own = F.filter("r", lambda x: x["speaker"] == speaker)
        return F.concat(F.lit("    item ["), (k + 1).cast("string"), F.lit(']:\n        class = "IntervalTier"\n        name = "'), speaker, F.lit('"\n        xmin = 0\n        xmax = '), s(F.col("m")), F.lit("\n        intervals: size = "), F.size(own).cast("string"), F.lit("\n"), F.array_join(F.transform(own, interval), "\n"))

    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), s(F.col("m")), F.lit("\ntiers? <exists>\nsize = "), F.size(speakers).cast("string"), F.lit("\nitem []:\n"))
    return one.select("file", F.concat(head, F.array_join(F.transform(speakers, tier), "\n"), F.lit("\n")).alias("text"))
