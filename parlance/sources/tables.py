"""Turns out of ordinary tables, and derived tiers for them.

No table at hand has annotated tiers, so with_tiers() derives some from the words by rules that any
SQL engine can follow. They exercise the operators and mean nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.words import split_words
from parlance.sources.chat import protected

#: Derived parts of speech by length of the word, and relations.
POS = ("n", "v", "pro:sub", "det:art", "cop", "conj:coo", "neg", "adj", "aux", "pro:wh")
RELATIONS = ("SUBJ", "CCOMP", "ROOT", "PUNCT", "CSUBJ", "ADVCL", "OBJ")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """A conversation is a file, a role a speaker; two turns each share a gem."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("file"),
        (F.col("turn") + 1).alias("utt_idx"),
        F.col("role").alias("speaker"),
        split_words("text").alias("cw"),
        "text",
        F.nullif(F.regexp_extract("text", r"([.?!])\s*$", 1), F.lit("")).alias("terminator"),
        F.array(F.concat(F.lit("g"), F.floor(F.col("turn") / 2).cast("string"))).alias("active_gems"),
    )


def document_turns(documents: DataFrame) -> DataFrame:
    """A document is a file, its source the speaker and its sentences the turns."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    sentences = F.filter(F.split(flat, r"(?<=[.?!])\s+"), lambda x: x != "")
    rows = documents.select(F.col("doc_id").cast("string").alias("file"), F.col("source").alias("speaker"), "lang", F.posexplode(sentences).alias("k", "text"))
    return rows.select("file", (F.col("k") + 1).cast("long").alias("utt_idx"), "speaker", "lang", split_words("text").alias("cw"), "text")


def event_turns(events: DataFrame) -> DataFrame:
    """A user's events are a file; each is a coded, timed turn of one of five speakers."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = events.select(
        F.col("user_id").cast("string").alias("file"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("utt_idx"),
        F.concat(F.lit("U"), (F.col("event_id") % 5).cast("string")).alias("speaker"),
        F.array("event_type").alias("cod"),
        ms.alias("start_ms"),
        (ms + F.floor(F.col("value") * 10).cast("long") - 500).alias("end_ms"),
    )
    return rows


def with_tiers(turns: DataFrame) -> DataFrame:
    """Adds derived mor, gra, cod, pho and mod to turns with cw."""
    low = F.transform("cw", F.lower)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    size = F.char_length
    none = F.array().cast("array<string>")
    features = lambda w: F.when(w.endswith("s"), F.array(F.lit("PL"))).when(w.endswith("d"), F.array(F.lit("PAST"))).when(w.endswith("g"), F.array(F.lit("PRESP"))).otherwise(none)
    main = lambda w: F.struct(pick(POS, size(w)).alias("pos"), w.alias("lemma"), features(w).alias("features"))
    be = F.struct(F.lit("aux").alias("pos"), F.lit("be").alias("lemma"), none.alias("features"))
    clitics = lambda w: F.when(size(w) % 11 == 0, F.array(be)).otherwise(F.slice(F.array(be), 1, 0))
    return turns.withColumns(
        {
            "mor": F.transform(low, lambda w: F.struct(main(w).alias("main"), clitics(w).alias("post_clitics"))),
            "gra": F.transform(low, lambda w, i: F.struct((i + 1).alias("idx"), i.alias("head"), pick(RELATIONS, size(w) + i).alias("relation"))),
            "cod": F.transform(low, lambda w: F.concat(F.lit("$"), F.substring(w, 1, 1))),
            "pho": low,
            "mod": F.transform(low, lambda w: F.translate(w, "aeiou", "eioua")),
        }
    )


def marked_turns(turns: DataFrame) -> DataFrame:
    """Turns with a main tier as text, made of cw: some words said twice, some after a filler, some corrected, and before long turns a retrace in a retrace.

    What counts in it are the words of cw.
    """
    n = F.char_length
    word = lambda w: (
        F.when(n(w) % 7 == 0, F.concat(protected(w), F.lit(" [/] "), protected(w)))
        .when(n(w) % 5 == 0, F.concat(F.lit("&-um "), protected(w)))
        .when(n(w) % 11 == 0, F.concat(F.lit("zz [: "), protected(w), F.lit("] [*]")))
        .otherwise(protected(w))
    )
    at = lambda k: protected(F.col("cw")[k])
    again = F.when(F.size("cw") >= 6, F.concat(F.lit("<"), at(0), F.lit(" <"), at(1), F.lit("> [/] "), at(2), F.lit("> [//] "))).otherwise(F.lit(""))
    return turns.withColumn("text", F.concat(again, F.array_join(F.transform("cw", word), " ")))
