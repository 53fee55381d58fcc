"""Transforms of dependent tiers (array of label, content) and of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.times import age_between, day_of
from parlance.operators.interaction import gem_depth

# The order of tiers; any other one comes after these, before what isn't known.
ORDER = "mor gra pho mod wor sin modsyl phosyl phoaln xphoint act cod com spa gpx sit exp int add alt coh def eng err fac flo gls ort par tim".split()
_KEYS = {name: k if k < 19 else k + 1 for k, name in enumerate(ORDER)}


def combined(turns: DataFrame, label: str, separator: str = " ") -> DataFrame:
    """Tiers of one label made one, at the place of the first."""
    same = lambda t: t["label"] == label
    text = F.array_join(F.transform(F.filter("tiers", same), lambda t: t["content"]), separator)
    first = F.array_position(F.transform("tiers", lambda t: t["label"]), label)
    out = F.filter(F.transform("tiers", lambda t, i: F.when(~same(t), t).when(i + 1 == first, F.struct(t["label"].alias("label"), text.alias("content")))), lambda t: t.isNotNull())
    return turns.withColumn("tiers", F.when(first > 0, out).otherwise(F.col("tiers")))


def ordered(turns: DataFrame) -> DataFrame:
    """Tiers by their usual order; equal ones stay as they come."""
    keys = F.create_map(*(F.lit(x) for pair in _KEYS.items() for x in pair))
    keyed = F.transform("tiers", lambda t, i: F.struct(F.coalesce(F.try_element_at(keys, t["label"]), F.lit(100)).alias("key"), i.alias("i"), t.alias("t")))
    return turns.withColumn("tiers", F.transform(F.array_sort(keyed), lambda x: x["t"]))


def trimmed(turns: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Only tiers included, or all but those excluded; * is every tier."""
    if not include and not exclude:
        raise ValueError("tiers to keep or to drop are needed")
    keep = lambda t: (F.lit(True) if "*" in include or not include else t["label"].isin(*include)) & (F.lit(True) if not exclude else F.lit(False) if "*" in exclude else ~t["label"].isin(*exclude))
    return turns.withColumn("tiers", F.filter("tiers", keep))


def with_copy(turns: DataFrame) -> DataFrame:
    """A tier ret with the utterance's text before all others."""
    copy = F.array(F.struct(F.lit("ret").alias("label"), F.col("text").alias("content")))
    return turns.withColumn("tiers", F.concat(copy, F.coalesce("tiers", F.array().cast("array<struct<label:string,content:string>>"))))


def in_gem(lines: DataFrame, labels: list[str]) -> DataFrame:
    """Headers, and the lines inside such gems: lines has file, line_no, kind (header or not), label and step (1 begins, -1 ends a gem, else 0)."""
    marks = lines.where(F.col("step") != 0)
    depth = gem_depth(marks.where(F.lower("label").isin(*(x.lower() for x in labels)))).select("file", "line_no", "label", "depth")
    rows = lines.join(depth.select("file", "line_no", F.lower("label").alias("l"), "depth"), ["file", "line_no"], "left")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = [F.coalesce(F.last(F.when(F.col("l") == x.lower(), F.col("depth")), ignorenulls=True).over(order), F.lit(0)) > 0 for x in labels]
    return rows.withColumn("inside", F.greatest(*inside) if len(inside) > 1 else inside[0]).where((F.col("kind") == "header") | F.col("inside")).select(*lines.columns)


def numbered(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with their number in five places before them, headers (@) apart, which aren't counted: file, line_no, line."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col(line).startswith("@")
    n = F.sum(F.when(header, 0).otherwise(1)).over(order)
    return lines.withColumn(line, F.when(header, F.col(line)).otherwise(F.concat(F.lpad(n.cast("string"), 5, " "), F.lit(" "), F.col(line))))


def without_numbers(lines: DataFrame, line: str = "line") -> DataFrame:
    """Takes numbered() back: the first six characters of lines that begin with a number in five places."""
    return lines.withColumn(line, F.when(F.rlike(F.col(line), F.lit(r"^[ \d]{4}\d ")), F.substring(line, 7, 1 << 30)).otherwise(F.col(line)))


def unfolded(text: Column | str) -> Column:
    """A file's text with continuation lines joined by blanks and without empty lines."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n+\t+", " "), r"\n{2,}", "\n")


def cleaned(line: Column | str) -> Column:
    """Blanks around [ ], tabs inside as blanks, ... as +..., #long as ##; headers stay."""
    line = F.col(line) if isinstance(line, str) else line
    out = F.regexp_replace(line, r"(?<=\S)\[", " [")
    out = F.regexp_replace(out, r"\](?=[^\s])", "] ")
    out = F.regexp_replace(out, r"(?<!^.{0,5}:)\t", " ")
    out = F.regexp_replace(out, r"(?<![+.])\.\.\.(?!\.)", "+...")
    out = F.regexp_replace(out, "#long", "##")
    return F.when(line.startswith("@"), line).otherwise(out)


def ages(days: DataFrame, births: DataFrame) -> DataFrame:
    """file, speaker and comment (Age of X is Y;MM.DD) of each file's date (file, value) and births (file, speaker, value)."""
    rows = births.select("file", "speaker", day_of("value").alias("birth")).join(days.select("file", day_of("value").alias("day")), "file")
    age = age_between("birth", "day")
    return rows.where(age.isNotNull()).select("file", "speaker", F.concat(F.lit("Age of "), F.col("speaker"), F.lit(" is "), age).alias("comment"))


def no_quote_postcode(turns: DataFrame) -> DataFrame:
    """The same turns; an error at the first with the postcode \"."""
    bad = F.coalesce(F.array_contains("postcodes", '"'), F.lit(False))
    return turns.withColumn("utt_idx", F.when(bad, F.raise_error(F.concat(F.lit('[+ "] in '), F.col("file")))).otherwise(F.col("utt_idx")))


def shifted(turns: DataFrame, offset: int = 0) -> DataFrame:
    """Times moved by an offset (an error below 0), and then forward past the end of what goes before: a start is at least the adjusted end before plus 1, and an utterance lasts 1 ms at least.

    An adjusted end is the largest of the own end, the own start plus 1 and the end before plus 2; so it is a
    running maximum over the file, once 2 ms for each utterance so far are taken off.
    """
    timed = turns.where("start_ms is not null and end_ms is not null").select("file", "utt_idx", (F.col("start_ms") + offset).alias("s"), (F.col("end_ms") + offset).alias("e"))
    order = Window.partitionBy("file").orderBy("utt_idx", "s", "e")
    own = F.greatest("e", F.col("s") + 1) - 2 * F.col("place")
    rows = timed.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("last", F.greatest(F.lit(-1), F.max(own).over(order.rowsBetween(Window.unboundedPreceding, 0))) + 2 * F.col("place"))
    start = F.greatest("s", F.lag("last", 1, -1).over(order) + 1)
    start = F.when(F.least("s", "e") < 0, F.raise_error(F.lit("a time below 0")).cast("long")).otherwise(start)
    return rows.select("file", "utt_idx", start.alias("start_ms"), F.col("last").alias("end_ms"))


def aligned_overlaps(text: str) -> str:
    """A file's text with each ⌊ under the last ⌈ of its index that another speaker said, moved right by blanks."""
    import re

    tops: dict[str, tuple[str, int]] = {}
    out = []
    for line in text.split("\n"):
        if not line.startswith("*"):
            out.append(line)
            continue
        speaker, done, at = line[1 : line.find(":")], "", 0
        for m in re.finditer("([⌈⌊])([2-9]?)", line):
            done += line[at : m.start()]
            at = m.start()
            if m[1] == "⌊" and m[2] in tops and tops[m[2]][0] != speaker:
                done += " " * max(0, tops[m[2]][1] - len(done))
            elif m[1] == "⌈":
                tops[m[2]] = (speaker, len(done))
            done += m[0]
            at = m.end()
        out.append(done + line[at:])
    return "\n".join(out)


def indented(files: DataFrame, text: str = "text") -> DataFrame:
    """aligned_overlaps() of each file (one row for each); places depend on lines before, so a file's text is one value."""
    return files.withColumn(text, F.udf(aligned_overlaps, "string")(text))
