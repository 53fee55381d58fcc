"""Queries over transcript files: conversations are written as files, found, read back and analysed; and the same in SQL over the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import sinks
from parlance.converters import export
from parlance.operators import frequency, lengths, profiles
from parlance.plans.catalog import _TOK, _UTT, ORACLES as _CATALOG, _with
from parlance.plans.requests import run_line
from parlance.sources import chat
from parlance.sources.tables import conversation_turns, marked_turns, read
from parlance.storage import new_path, read_packed, write_packed, write_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """file and text of a transcript of each conversation. Rows are dealt out before their words are cut and marked: a small file would be one task's work."""
    dealt = read(spark, folder, "conversations").repartition(F.col("conv_id").cast("string"))
    turns = conversation_turns(dealt).where("file is not null and speaker is not null and utt_idx is not null")
    return export.chat(marked_turns(turns.withColumn("cw", F.coalesce("cw", F.array().cast("array<string>")))))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The transcripts of all conversations, written many to a file and read back: they are small, and a file each would cost more than what is in it."""
    path = new_path(spark, "transcripts")
    write_packed(_transcripts(spark, folder), path)
    return read_packed(spark, path)


def _turns(spark: SparkSession, folder: str, **more) -> DataFrame:
    """Turns of the transcripts, parsed from their files."""
    turns = chat.turns(_files(spark, folder), **more)
    return turns.withColumn("cw", chat.unprotected("cw"))


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = sql


_GIVEN = _UTT + """,
given AS (SELECT file, utt_idx, speaker, coalesce(cw, []) AS cw, CASE WHEN regexp_matches(text, '[.?!]\\s*$') THEN regexp_extract(text, '([.?!])\\s*$', 1) ELSE '.' END AS terminator
  FROM utt WHERE file IS NOT NULL AND speaker IS NOT NULL AND utt_idx IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY utt_idx) AS n FROM given)"""

_add(
    "cha_turns",
    lambda spark, folder: _turns(spark, folder).select("file", "utt_idx", "speaker", "terminator", F.array_join("cw", " ").alias("words")),
    _with(_GIVEN, "SELECT file, n AS utt_idx, speaker, terminator, array_to_string(cw, ' ') AS words FROM numbered"),
)


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    words = lambda test: F.size(F.filter("words", test)).cast("long")
    marks = [f"words.{f}" for f in ("retrace_kind", "n_err")]
    return _turns(spark, folder, retraced=True, only=["utt_idx", *marks]).select(
        "file", "utt_idx", F.size("cw").cast("long").alias("counted"), words(lambda w: w["in_retrace"]).alias("retraced"),
        words(lambda w: w["retrace_kind"] == "full").alias("in_full"), words(lambda w: w["category"] == "filler").alias("fillers"), words(lambda w: w["replaced"]).alias("replaced"), F.col("n_err").cast("long").alias("errors"),
    )


_add(
    "cha_marks",
    _marks,
    _with(_GIVEN, """
, c AS (SELECT file, n AS utt_idx, len(cw) AS words, len(list_filter(cw, lambda w: length(w) % 7 = 0)) AS said_twice, len(list_filter(cw, lambda w: length(w) % 7 <> 0 AND length(w) % 5 = 0)) AS fillers,
  len(list_filter(cw, lambda w: length(w) % 7 <> 0 AND length(w) % 5 <> 0 AND length(w) % 11 = 0)) AS replaced, CASE WHEN len(cw) >= 6 THEN 1 ELSE 0 END AS long FROM numbered)
SELECT file, utt_idx, words + said_twice + 3 * long AS counted, said_twice + 3 * long AS retraced, 2 * long AS in_full, fillers, replaced, replaced AS errors FROM c"""),
)
_add("cha_freq", lambda spark, folder: frequency.frequency(_turns(spark, folder)), _with(_TOK, "SELECT speaker, word, count(*) AS count FROM tok GROUP BY ALL"))
_add("cha_mlu", lambda spark, folder: lengths.mean_length(_turns(spark, folder)), _with(_UTT, """
SELECT speaker, count(*) AS utterances, sum(len(cw)) AS total, round(avg(len(cw)), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(len(cw)), 6) END AS sd, min(len(cw)) AS least, max(len(cw)) AS most FROM utt WHERE len(cw) > 0 GROUP BY speaker"""))


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    """From a scan that is stored by kind: what each file declares, and how many turns of each speaker it has."""
    files, path = _files(spark, folder), new_path(spark, "scan")
    chat.store(files, path, ("header", "id", "turn"), only=["speaker"])
    lines = chat.stored(spark, path)
    declared = chat.headers(lines).where("kind = 'Participant'").select("file", F.col("participant").alias("speaker"), F.col("value").alias("role"))
    ids = chat.ids(lines).select("file", "speaker", "language", F.col("role").alias("id_role"))
    said = chat.turns(lines).groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("turns"))
    return declared.join(ids, ["file", "speaker"], "left").join(said, ["file", "speaker"], "left")


_add("cha_headers", _headers, _with(_GIVEN, "SELECT file, speaker, 'Participant' AS role, 'eng' AS language, 'Participant' AS id_role, count(*) AS turns FROM given GROUP BY ALL"))


def _discovered(spark: SparkSession, folder: str) -> DataFrame:
    """Of each transcript, and of a path that isn't there, whether it is read; names are asked for by a pattern before anything is opened."""
    path = new_path(spark, "transcripts")
    write_texts(_transcripts(spark, folder), path)
    found = chat.discovered(spark, [path, f"{path}/none.cha"], pattern="*.txt")
    of = F.coalesce(F.nullif(F.regexp_extract("file", r"/file=([^/]*)/", 1), F.lit("")), F.lit("none"))
    return found.where("reason is null or reason <> 'name'").groupBy(of.alias("file"), "status", "reason").agg((F.min("bytes") > 0).alias("filled"))


_add("cha_discovered", _discovered, _with(_GIVEN, "SELECT DISTINCT file, 'read' AS status, CAST(NULL AS VARCHAR) AS reason, true AS filled FROM given UNION ALL SELECT 'none', 'skipped', 'missing', NULL"))


def _sheets(spark: SparkSession, folder: str, made: DataFrame) -> DataFrame:
    """The rows of workbooks that were written and read back."""
    path = new_path(spark, "sheets")
    sinks.write_workbooks(made, path, packed=True)
    return sinks.read_workbooks(spark, path, packed=True).where("cells[0] <> 'File' and size(cells) > 1")


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_turns(read(spark, folder, "conversations")).where("file is not null and speaker is not null")


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sheets(spark, folder, sinks.flat_sheet(_conversations(spark, folder)))
    return rows.select("book", F.col("cells")[1].alias("speaker"), F.col("cells")[2].alias("word"), F.col("cells")[3].cast("long").alias("count"))


_add("sheet_flat", _flat, _with(_TOK, "SELECT file AS book, speaker, word, count(*) AS count FROM tok WHERE speaker IS NOT NULL GROUP BY ALL"))


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    """Of each row: how many word columns there are, how many hold nothing, the words' counts by place, and the sums behind them."""
    rows = _sheets(spark, folder, sinks.wide_sheet(_conversations(spark, folder), mattr=25))
    cell = lambda k: F.element_at("cells", k)
    words = F.transform(F.slice("cells", 3, F.size("cells") - 6), lambda x: x.cast("long"))
    rows = rows.select("book", F.col("cells")[1].alias("speaker"), words.alias("w"), cell(-4).cast("long").alias("types"), cell(-3).cast("long").alias("tokens"), cell(-2).alias("ttr"), cell(-1).alias("mattr"))
    places = F.aggregate(F.transform("w", lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("book", "speaker", F.size("w").alias("columns"), F.size(F.filter("w", lambda x: x == 0)).alias("empty"), places.alias("places"), "types", "tokens", "ttr", "mattr")


_add("sheet_wide", _wide, _with(_CATALOG["mattr"].removeprefix("WITH ").rpartition("SELECT file, speaker, max(t)")[0].rstrip() + ",", """
m AS (SELECT file, speaker, CASE WHEN max(t) >= 25 THEN round(sum(greatest(0, least(i, t - 24) - greatest(i - 24, p + 1, 1) + 1)) / (25 * (max(t) - 24)), 6) END AS mattr FROM p GROUP BY file, speaker),
c AS (SELECT file, speaker, word, count(*) AS count FROM tok WHERE speaker IS NOT NULL GROUP BY ALL), v AS (SELECT file, word, row_number() OVER (PARTITION BY file ORDER BY word) AS k FROM (SELECT DISTINCT file, word FROM c)),
s AS (SELECT file, speaker, count(*) AS types, sum(count) AS tokens FROM c GROUP BY ALL)
SELECT s.file AS book, s.speaker AS speaker, count(*) AS columns, count(*) FILTER (c.count IS NULL) AS empty, sum(coalesce(c.count, 0) * k) AS places, any_value(types) AS types, any_value(tokens) AS tokens, format('{:.3f}', round(any_value(types / tokens), 3)) AS ttr, coalesce(format('{:.3f}', round(any_value(mattr), 3)), '.') AS mattr
FROM s JOIN v ON v.file = s.file LEFT JOIN c ON c.file = s.file AND c.speaker = s.speaker AND c.word = v.word JOIN m ON m.file = s.file AND m.speaker = s.speaker GROUP BY s.file, s.speaker"""))


def _line(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A command line over the transcripts."""
    return lambda spark, folder: run_line(spark, text, _files(spark, folder))


_add("request_freq", _line("freq +tuser -sthe +k"), _with(_TOK, "SELECT speaker, lower(word) AS word, count(*) AS count FROM tok WHERE speaker = 'user' AND lower(word) <> 'the' GROUP BY ALL"))
_add("request_groups", _line("freq '+sof the' '+sthe w*' +k"), _with(_TOK, """
, l AS (SELECT speaker, lower(word) AS w, lower(lead(word) OVER (PARTITION BY file, utt_idx ORDER BY pos)) AS n FROM tok)
SELECT speaker, 'of the' AS word, count(*) AS count FROM l WHERE w = 'of' AND n = 'the' GROUP BY ALL UNION ALL SELECT speaker, 'the w*', count(*) FROM l WHERE w = 'the' AND n LIKE 'w%' GROUP BY ALL"""))
_add("request_mlu", _line("mlu -t%mor +tassistant +z1-3"), _with(_GIVEN, """
SELECT speaker, count(*) AS utterances, sum(len(cw)) AS total, round(avg(len(cw)), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(len(cw)), 6) END AS sd, min(len(cw)) AS least, max(len(cw)) AS most FROM numbered WHERE len(cw) > 0 AND speaker = 'assistant' AND n <= 3 GROUP BY speaker"""))

_add("cha_fluency", lambda spark, folder: profiles.fluency(_turns(spark, folder)), _with(_GIVEN, """
, w AS (SELECT speaker, len(cw) >= 6 AS long, list_transform(list_concat(CASE WHEN len(cw) >= 6 THEN cw[1:3] ELSE [] END, flatten(list_transform(cw, lambda w: CASE WHEN length(w) % 7 = 0 THEN [w, w] WHEN length(w) % 5 = 0 THEN ['&-um', w] WHEN length(w) % 11 = 0 THEN ['zz', w] ELSE [w] END))), lambda w: lower(w)) AS said,
  len(list_filter(cw, lambda w: length(w) % 7 = 0)) AS twice, len(list_filter(cw, lambda w: length(w) % 7 <> 0 AND length(w) % 5 = 0)) AS um FROM numbered),
c AS (SELECT speaker, len(said) AS n, len(list_filter(range(2, len(said) + 1), lambda i: said[i] = said[i - 1])) AS again, twice + CASE WHEN long THEN 1 ELSE 0 END AS partial, CASE WHEN long THEN 2 ELSE 0 END AS "full", um FROM w),
s AS (SELECT speaker, sum(n) AS words, 0 AS prolongations, 0 AS broken, sum(again) AS repetitions, sum(partial) AS phrase_repetitions, sum("full") AS revisions, sum(um) AS fillers, 0 AS fragments FROM c GROUP BY speaker)
SELECT *, round(100 * repetitions / words, 6) AS stuttering_rate, round(100 * (phrase_repetitions + revisions + fillers) / words, 6) AS typical_rate FROM s"""))
