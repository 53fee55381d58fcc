"""Checks of transcripts: one row for each finding, (file, line_no, number, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unused_speakers(declared: DataFrame, turns: DataFrame) -> DataFrame:
    """Speakers (file, speaker) that are declared and never speak."""
    return declared.select("file", "speaker").distinct().join(turns.select("file", "speaker"), ["file", "speaker"], "left_anti")


def undeclared_speakers(declared: DataFrame, turns: DataFrame) -> DataFrame:
    """Speakers that speak and aren't declared, with their first utterance."""
    rows = turns.join(declared.select("file", "speaker").distinct(), ["file", "speaker"], "left_anti")
    return rows.groupBy("file", "speaker").agg(F.min("utt_idx").alias("utt_idx"))


def duplicate_speakers(declared: DataFrame) -> DataFrame:
    """Speakers declared more than once, with how often."""
    return declared.groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def media_names(headers: DataFrame) -> DataFrame:
    """Files whose media header names another file: file, media. Folders and endings don't count, nor does case."""
    rows = headers.where("kind = 'Media'").select("file", F.trim(F.element_at(F.split("value", ","), 1)).alias("media"))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return rows.where(F.lower("media") != F.lower(stem))


def missing_target(ids: DataFrame) -> DataFrame:
    """Files without a speaker in the role of target child."""
    files = ids.select("file").distinct()
    return files.join(ids.where(F.lower("role") == "target_child").select("file"), "file", "left_anti")


def findings(headers: DataFrame, ids: DataFrame, turns: DataFrame, target: bool = False, unused: bool = False) -> DataFrame:
    """file, number, detail of everything that is wrong with a corpus; numbers are those of the usual checker."""
    declared = headers.where("kind = 'Participant'").select("file", F.col("participant").alias("speaker"))
    of = lambda df, number, detail: df.select("file", F.lit(number).alias("number"), detail.cast("string").alias("detail"))
    out = of(undeclared_speakers(declared, turns), 18, F.col("speaker"))
    out = out.unionByName(of(duplicate_speakers(declared), 13, F.col("speaker")))
    out = out.unionByName(of(media_names(headers), 157, F.col("media")))
    lacking = declared.distinct().join(ids.select("file", "speaker"), ["file", "speaker"], "left_anti")
    out = out.unionByName(of(lacking, 60, F.col("speaker")))
    bare = turns.where(F.col("terminator").isNull())
    out = out.unionByName(of(bare, 21, F.col("utt_idx")))
    first = headers.groupBy("file").agg(F.min_by("kind", "line_no").alias("first"), F.max_by("kind", "line_no").alias("last"))
    out = out.unionByName(of(first.where("first != 'UTF8'"), 69, F.col("first"))).unionByName(of(first.where("last != 'End'"), 7, F.col("last")))
    if target:
        out = out.unionByName(of(missing_target(ids), 68, F.lit("Target_Child")))
    if unused:
        out = out.unionByName(of(unused_speakers(declared, turns), 46, F.col("speaker")))
    return out


def cascades(found: DataFrame) -> DataFrame:
    """Findings that stay once those that follow from others are taken away, file by file.

    16, then 53, hides all others; 69 hides all others; 6 leaves only 6 and 69; 44 hides 7; 143 hides 60;
    60 without 143 hides 18.
    """
    by = Window.partitionBy("file")
    has = {n: F.max(F.col("number") == n).over(by) for n in (16, 53, 69, 6, 44, 143, 60)}
    rows = found.withColumns({f"has{n}": c for n, c in has.items()})
    n = F.col("number")
    stays = (
        F.when(F.col("has16"), n == 16)
        .when(F.col("has53"), n == 53)
        .when(F.col("has69"), n == 69)
        .when(F.col("has6"), n.isin(6, 69))
        .otherwise(~(F.col("has44") & (n == 7)) & ~(F.col("has143") & (n == 60)) & ~(F.col("has60") & ~F.col("has143") & (n == 18)))
    )
    return rows.where(stays).select(*found.columns)
