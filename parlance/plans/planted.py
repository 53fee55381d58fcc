"""Checks over transcripts with planted faults: a transcript for each conversation, and a fault for each file or each turn by its number; SQL says what must be found.

Four classes: headers, speakers, tiers, bullets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators import validation
from parlance.sources import chat
from parlance.sources.tables import read
from parlance.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_U = "\x15"


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """file, c (its number), i (turns from 1 on)."""
    turns = read(spark, folder, "conversations").where("conv_id is not null and turn is not null")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return turns.select(F.col("conv_id").cast("string").alias("file"), F.col("conv_id").cast("long").alias("c"), i.alias("i"))


_NUMBERED = "n AS (SELECT CAST(conv_id AS VARCHAR) AS file, CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),\nf AS (SELECT file, c, count(*) AS turns FROM n GROUP BY ALL)"


def _head(fault: Column | None = None, **other: dict[int, str | Column | None]) -> list[Column]:
    """The eight lines that a transcript begins with; other: for a line's name what stands in its place with a fault, None for nothing."""
    file = F.col("file")
    plain: dict[str, str | Column] = {
        "utf8": "@UTF8", "begin": "@Begin", "languages": "@Languages:\teng", "people": "@Participants:\tCHI Target_Child, MOT Mother",
        "child": "@ID:\teng|c|CHI|2;06.|female||WC|Target_Child|||", "mother": "@ID:\teng|c|MOT|||||Mother|||", "media": F.concat(F.lit("@Media:\t"), file, F.lit(", audio")), "date": "@Date:\t01-JAN-2020",
    }
    return [_either(text, other.get(name, {}), fault) for name, text in plain.items()]


def _either(text: str | Column | None, cases: dict, fault: Column | None) -> Column:
    col = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    out = col(text)
    for number, instead in cases.items():
        out = F.when(fault == number, col(instead)).otherwise(out)
    return out


def _scanned(files: DataFrame) -> DataFrame:
    """The files' scan, parsed once and stored by kind."""
    path = new_path(files.sparkSession, "scan")
    chat.store(files, path, ("line", "turn", "problem"))
    return chat.stored(files.sparkSession, path)


def _file(lines: list[Column]) -> Column:
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    fault = F.col("c") % 24
    rows = _numbered(spark, folder).groupBy("file", "c").agg(F.count(F.lit(1)).alias("turns"))
    child = "@ID:\teng|c|CHI|2;06.|female||WC|Target_Child|||"
    lines = _head(
        fault,
        utf8={1: None},
        begin={2: None, 4: "@Begin\n@Begin"},
        languages={11: "@Languages:\teng1", 22: "@Languages: eng"},
        people={14: "@Participants:\tCHI Target_Child, MOT Wizard"},
        child={7: child[:-1], 8: child.replace("female", "x"), 9: child.replace("WC", "rich"), 10: child.replace("2;06.", "3;2."), 12: child.replace("eng", "deu")},
        mother={13: "@ID:\teng|c|MOT|||||Father|||", 14: "@ID:\teng|c|MOT|||||Wizard|||", 21: None},
        media={15: "@Media:\tother, audio", 16: F.concat(F.lit("@Media:\t"), F.col("file"), F.lit(", tape"))},
        date={6: "@Date:\t2020-01-01"},
    )
    lines.append(_either(None, {17: "@Bg:\tx", 18: "@Eg:\tx", 19: "@Foo:\tx", 20: "@Comment", 23: "@Options:\t"}, fault))
    lines.append(F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("turns")), lambda k: F.concat(F.lit("*"), F.when(k % 2 == 1, F.lit("CHI")).otherwise(F.lit("MOT")), F.lit(":\tgo ."))), "\n"))
    lines.append(_either("@End", {3: None, 5: "@End\n@Comment:\tmore"}, fault))
    return validation.check(_scanned(rows.select("file", _file(lines).alias("text")))).select("file", "line_no", "number", "message")


def _found(sql: str) -> str:
    """With the messages, from rows of file, line_no and number."""
    said = ", ".join(f"({n}, '{m.replace(chr(39), chr(39) * 2)}')" for n, m in validation.MESSAGES.items())
    return f"{sql} SELECT file, CAST(line_no AS INTEGER) AS line_no, CAST(number AS INTEGER) AS number, message FROM found JOIN (VALUES {said}) m(k, message) ON k = number"


QUERIES["check_headers"] = headers
ORACLES["check_headers"] = _found(f"""WITH {_NUMBERED},
planted AS (SELECT * FROM (VALUES (1, 69, 1), (2, 6, 2), (4, 53, 3), (6, 34, 8), (7, 143, 5), (8, 64, 5), (9, 144, 5), (10, 153, 5), (11, 121, 3), (11, 122, 5), (11, 122, 6), (12, 122, 5), (13, 142, 6), (14, 15, 4),
  (15, 157, 7), (16, 113, 7), (17, 45, 9), (18, 46, 9), (19, 17, 9), (20, 2, 9), (21, 60, 4), (22, 4, 3), (23, 103, 9)) p(fault, number, line_no)),
found AS (
  SELECT file, line_no, number FROM f JOIN planted ON c % 24 = fault
  UNION ALL SELECT file, 8 + turns, 7 FROM f WHERE c % 24 = 3
  UNION ALL SELECT file, 10 + turns, 44 FROM f WHERE c % 24 = 5)""")


def speakers(spark: SparkSession, folder: str) -> DataFrame:
    fault = F.col("c") % 7
    people = {2: "@Participants:\tCHI Target_Child, MOT Mother, CHI Target_Child", 4: "@Participants:\tCHI, MOT Mother", 5: "@Participants:\tCHI Target_Child, MOT Mother, FAT Father", 6: "@Participants:\tMOT Mother"}
    lines = [*_head(fault, people=people, child={6: None}), _either("*CHI:\tone .", {6: "*MOT:\tone ."}, fault), F.lit("*MOT:\ttwo ."), _either(None, {1: "*XXX:\tthree .", 3: "*ÉVA:\tthree ."}, fault), F.lit("@End")]
    files = _numbered(spark, folder).select("file", "c").distinct().select("file", _file(lines).alias("text"))
    return validation.check(_scanned(files), target=True, unused=True).select("file", "line_no", "number", "message")


QUERIES["check_speakers"] = speakers
ORACLES["check_speakers"] = _found(f"""WITH {_NUMBERED},
planted AS (SELECT * FROM (VALUES (1, 18, 11), (2, 13, 4), (3, 16, 11), (4, 12, 4), (4, 142, 5), (4, 68, 0), (5, 0, 4), (5, 60, 4), (6, 68, 0)) p(fault, number, line_no)),
found AS (SELECT file, line_no, number FROM f JOIN planted ON c % 7 = fault)""")

#: What stands in a turn with a fault: its main tier, its mor tier, its comment.
_MAIN = {
    1: "big dog runs", 2: "big dog runs . .", 3: "big dog . runs", 4: "big dog runs [/ .", 5: "big dog runs ] .", 6: "<big dog runs .", 7: "big dog> runs .", 8: "big (dog runs .", 9: "big 3 runs .", 10: "big d3og runs .",
    11: "big do$g runs .", 12: ".", 13: f"big dog runs . {_U}100_200{_U} [+ bch]", 14: "“big dog runs .", 15: "big xx runs .", 16: "<big dog> [: cat] runs .", 17: "big (dog) runs .", 18: "big ,, dog runs .", 19: "big dog [: xxx] runs .",
    20: "big dog[/] runs .", 25: "[/] big dog runs .",
}
_MOR = {21: "adj|big dog v|runs .", 22: "adj|big n|dog v|runs ?"}
_COMMENT = {23: "%zzz:\tok", 24: "%mor:\tadj|big .", 26: "%com: ok"}


def tiers(spark: SparkSession, folder: str) -> DataFrame:
    fault = (F.col("c") * 7 + F.col("i")) % 27
    turn = F.concat(F.lit("*CHI:\t"), _either("big dog runs .", _MAIN, fault), F.lit("\n%mor:\t"), _either("adj|big n|dog v|runs .", _MOR, fault), F.lit("\n"), _either("%com:\tok", _COMMENT, fault))
    rows = _numbered(spark, folder).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    files = rows.select("file", _file([*_head(), F.col("body"), F.lit("@End")]).alias("text"))
    return validation.check(_scanned(files)).select("file", "line_no", "number", "message")


QUERIES["check_tiers"] = tiers
ORACLES["check_tiers"] = _found(f"""WITH {_NUMBERED},
planted AS (SELECT * FROM (VALUES (1, 21, 0), (1, 94, 0), (2, 50, 0), (3, 36, 0), (4, 22, 0), (5, 23, 0), (6, 24, 0), (7, 25, 0), (8, 28, 0), (9, 38, 0), (9, 47, 0), (10, 47, 0), (11, 48, 0), (12, 70, 0), (12, 140, 0), (13, 108, 0), (14, 117, 0),
  (15, 135, 0), (15, 140, 0), (16, 141, 0), (16, 140, 0), (17, 155, 0), (18, 156, 0), (19, 158, 0), (19, 140, 0), (20, 161, 0), (20, 140, 0), (21, 134, 0), (21, 140, 0), (22, 94, 0), (23, 17, 2), (24, 40, 2), (25, 52, 0), (26, 4, 2)) p(fault, number, down)),
found AS (SELECT file, 9 + 3 * (i - 1) + down AS line_no, number FROM n JOIN planted ON (c * 7 + i) % 27 = fault)""")


def bullets(spark: SparkSession, folder: str) -> DataFrame:
    fault, begin, end = (F.col("c") * 5 + F.col("i")) % 9, F.col("i") * 1000, F.col("i") * 1000 + 1000
    times = lambda a, b: F.concat(F.lit(_U), a.cast("string"), F.lit("_"), b.cast("string"), F.lit(_U))
    mark = _either(times(begin, end), {1: "", 2: times(end, begin), 3: f"{_U}x_y{_U}", 4: times(begin - 700, end - 500), 5: times(begin + 500, end)}, fault)
    turn = F.concat(F.lit("*"), F.when(F.col("i") % 3 == 1, F.lit("MOT")).otherwise(F.lit("CHI")), F.lit(":\tgo . "), mark)
    rows = _numbered(spark, folder).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    files = rows.select("file", _file([*_head(), F.col("body"), F.lit("@End")]).alias("text"))
    return validation.check(_scanned(files), include=(82, 83, 84, 85, 89, 110, 133), bullets=0).select("file", "line_no", "number", "message")


QUERIES["check_bullets"] = bullets
ORACLES["check_bullets"] = _found(f"""WITH {_NUMBERED},
timed AS (SELECT file, i, CASE WHEN i % 3 = 1 THEN 'MOT' ELSE 'CHI' END AS who, (c * 5 + i) % 9 AS fault,
  CASE (c * 5 + i) % 9 WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 2 THEN i * 1000 + 1000 WHEN 4 THEN i * 1000 - 700 WHEN 5 THEN i * 1000 + 500 ELSE i * 1000 END AS b,
  CASE (c * 5 + i) % 9 WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 2 THEN i * 1000 WHEN 4 THEN i * 1000 + 500 ELSE i * 1000 + 1000 END AS e FROM n),
known AS (SELECT *, last_value(b IGNORE NULLS) OVER o AS lb, last_value(e IGNORE NULLS) OVER o AS le, last_value(CASE WHEN b IS NOT NULL THEN who END IGNORE NULLS) OVER o AS lw, last_value(e IGNORE NULLS) OVER (PARTITION BY file, who ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS oe
  FROM timed WINDOW o AS (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (
  SELECT file, 8 + i AS line_no, 110 AS number FROM known WHERE fault = 1 UNION ALL SELECT file, 8 + i, 89 FROM known WHERE fault = 3 UNION ALL SELECT file, 8 + i, 82 FROM known WHERE b > e
  UNION ALL SELECT file, 8 + i, 83 FROM known WHERE b < lb UNION ALL SELECT file, 8 + i, 84 FROM known WHERE b < le AND lw <> who UNION ALL SELECT file, 8 + i, 85 FROM known WHERE b > le UNION ALL SELECT file, 8 + i, 133 FROM known WHERE b < oe)""")
