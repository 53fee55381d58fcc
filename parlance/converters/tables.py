"""Other formats to turns. A file is one row (file, text); each line or block becomes a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.times import from_clock, iso_duration

# Speakers of recorder segments and of another transcript format.
SEGMENTS = {"CHN": "CHI", "CXN": "CHI", "FAN": "MOT", "FAF": "MOT", "MAN": "FAT", "MAF": "FAT", "OLN": "OTH", "OLF": "OTH", "TVN": "ENV", "TVF": "ENV", "NON": "ENV", "NOF": "ENV"}
SALT = {"C": "CHI", "E": "EXA", "P": "PAR", "I": "INV"}
SILENCE = ("sil", "sp", "#", "")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("k", "line"))


def _number(rows: DataFrame, order: str = "k") -> Column:
    return F.row_number().over(Window.partitionBy("file").orderBy(order)).cast("long")


def from_text(files: DataFrame, speaker: str = "TXT") -> DataFrame:
    """Sentences end behind . ? and !; a text without an end gets a full stop."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    parts = F.regexp_extract_all(flat, F.lit(r"[^.?!]+[.?!]?"), F.lit(0))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"[^.?!\s]")))
    parts = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(r"[.?!]$")), x).otherwise(F.concat(x, F.lit("."))))
    rows = files.select("file", F.posexplode(parts).alias("k", "s"))
    return rows.select("file", (F.col("k") + 1).cast("long").alias("utt_idx"), F.lit(speaker).alias("speaker"), F.trim(F.regexp_replace("s", r"[.?!]$", "")).alias("text"), F.regexp_extract("s", r"[.?!]$", 0).alias("terminator"))


def from_srt(files: DataFrame, speaker: str = "SPK") -> DataFrame:
    """Blocks of a number, two times and lines of text, parted by empty lines; blocks without times are left out."""
    blocks = F.split(F.trim(F.regexp_replace("text", r"\r\n?", "\n")), r"\n\s*\n")
    rows = files.select("file", F.posexplode(blocks).alias("k", "b"))
    pattern = r"^\s*(?:\d+\s*\n)?\s*(\S+)\s*-->\s*(\S+)[^\n]*\n?([\s\S]*)$"
    part = lambda i: F.regexp_extract("b", pattern, i)
    rows = rows.select("file", "k", from_clock(part(1)).alias("start_ms"), from_clock(part(2)).alias("end_ms"), F.trim(F.regexp_replace(part(3), r"\s+", " ")).alias("text")).where("start_ms is not null and end_ms is not null and text != ''")
    return rows.select("file", _number(rows).alias("utt_idx"), F.lit(speaker).alias("speaker"), "text", "start_ms", "end_ms")


def _seconds(x: Column) -> Column:
    return F.floor(x.try_cast("decimal(20,6)") * 1000).cast("long")


def from_lab(files: DataFrame, speaker: str = "SPK") -> DataFrame:
    """Lines of start, end and label in seconds, or of time and label, where a label lasts until the next, the last one a second. Silence is left out."""
    three = r"^\s*([\d.]+)\s+([\d.]+)\s+(\S.*?)\s*$"
    two = r"^\s*([\d.]+)\s+([^\d.\s].*?|[\d.]*[^\d.\s].*?)\s*$"
    rows = _lines(files).where(F.rlike("line", F.lit(three)) | F.rlike("line", F.lit(two)))
    full = F.rlike("line", F.lit(three))
    part = lambda p, i: F.regexp_extract("line", p, i)
    rows = rows.select("file", "k", _seconds(F.when(full, part(three, 1)).otherwise(part(two, 1))).alias("start_ms"), _seconds(F.when(full, part(three, 2))).alias("given"), F.when(full, part(three, 3)).otherwise(part(two, 2)).alias("text"))
    after = F.coalesce(F.lead("start_ms").over(Window.partitionBy("file").orderBy("k")), F.col("start_ms") + 1000)
    rows = rows.withColumn("end_ms", F.coalesce("given", after)).where(~F.lower("text").isin(*SILENCE))
    return rows.select("file", _number(rows).alias("utt_idx"), F.lit(speaker).alias("speaker"), "text", "start_ms", "end_ms")


def from_play(files: DataFrame) -> DataFrame:
    """Lines of speaker, start, end and text between tabs, or of speaker and text; lines that begin with # are left out."""
    f = F.split("line", "\t")
    rows = _lines(files).where(F.rlike("line", F.lit(r"\S")) & ~F.col("line").startswith("#")).where(F.size(f) >= 2)
    get = lambda i: F.try_element_at(f, F.lit(i))
    timed = F.size(f) >= 4
    rows = rows.select("file", "k", F.upper(F.substring(F.trim(get(1)), 1, 3)).alias("speaker"), F.when(timed, F.trim(get(2)).try_cast("long")).alias("start_ms"), F.when(timed, F.trim(get(3)).try_cast("long")).alias("end_ms"), F.trim(F.when(timed, get(4)).otherwise(get(2))).alias("text"))
    rows = rows.where("text != ''")
    return rows.select("file", _number(rows).alias("utt_idx"), "speaker", "text", "start_ms", "end_ms")


def from_lipp(files: DataFrame, speaker: str = "CHI") -> DataFrame:
    """Lines of a word and its sounds: a turn with a tier pho. Lines that begin with # are left out."""
    f = F.split("line", "\t")
    rows = _lines(files).where(F.rlike("line", F.lit(r"\S")) & ~F.col("line").startswith("#"))
    rows = rows.select("file", "k", F.trim(f[0]).alias("text"), F.trim(F.try_element_at(f, F.lit(2))).alias("pho")).where("text != ''")
    return rows.select("file", _number(rows).alias("utt_idx"), F.lit(speaker).alias("speaker"), "text", "pho")


def from_salt(files: DataFrame) -> DataFrame:
    """Lines of a speaker's letter and text, without marks of mazes, bound morphemes, codes and omissions; $, +, = and - begin other lines."""
    rows = _lines(files).where(F.rlike("line", F.lit(r"^[A-Z]\s+\S")))
    code = F.substring("line", 1, 1)
    names = F.create_map(*(F.lit(x) for pair in SALT.items() for x in pair))
    text = F.regexp_replace("line", r"^[A-Z]\s+", "")
    text = F.regexp_replace(text, r"\([^)]*\)|\{[^}]*\}|\[[^\]]*\]", " ")
    text = F.regexp_replace(text, r"/\S*?(?=[\s.?!]|$)|\*", "")
    text = F.translate(text, "_", "+")
    end = F.nullif(F.regexp_extract(text, r"([.?!])\s*$", 1), F.lit(""))
    words = F.trim(F.regexp_replace(F.regexp_replace(text, r"[.?!]\s*$", ""), r"\s+", " "))
    rows = rows.select("file", "k", F.coalesce(F.try_element_at(names, code), code).alias("speaker"), words.alias("text"), F.coalesce(end, F.lit(".")).alias("terminator")).where("text != ''")
    return rows.select("file", _number(rows).alias("utt_idx"), "speaker", "text", "terminator")


def from_rtf(files: DataFrame) -> DataFrame:
    """Turns (*SPK: text) of rich text, without its groups and control words."""
    text = F.regexp_replace("text", r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "")
    text = F.regexp_replace(text, r"\\(?:par|line)\b ?", "\n")
    text = F.regexp_replace(text, r"\\tab\b ?", "\t")
    text = F.regexp_replace(text, r"\\[a-z]+-?\d* ?|[{}]", "")
    rows = files.select("file", F.posexplode(F.split(text, r"\n(?=\s*\*\w+:)|^(?=\s*\*\w+:)")).alias("k", "t"))
    pattern = r"^\s*\*(\w+):\s*([\s\S]*)$"
    rows = rows.select("file", "k", F.regexp_extract("t", pattern, 1).alias("speaker"), F.trim(F.regexp_replace(F.regexp_extract("t", pattern, 2), r"\s+", " ")).alias("text")).where("speaker != '' and text != ''")
    return rows.select("file", _number(rows).alias("utt_idx"), "speaker", "text")


def _attribute(x: Column, name: str) -> Column:
    return F.regexp_extract(x, rf'\b{name}="([^"]*)"', 1)


def from_its(files: DataFrame) -> DataFrame:
    """Segments of a recorder's XML: speaker by kind of segment, words as xxx, times; silence is left out."""
    tags = F.regexp_extract_all("text", F.lit(r"<[^<>]*\bspkr=[^<>]*>"), F.lit(0))
    rows = files.select("file", F.posexplode(tags).alias("k", "t"))
    kind = _attribute(F.col("t"), "spkr")
    names = F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair))
    words = F.greatest(F.lit(1), F.coalesce(F.floor(F.nullif(F.regexp_extract("t", r'\b(?:average\w*)?[wW]ord\w*="([\d.]+)"', 1), F.lit("")).try_cast("double")), F.lit(1)))
    rows = rows.select("file", "k", kind.alias("kind"), F.coalesce(F.try_element_at(names, kind), F.lit("UNK")).alias("speaker"), F.array_join(F.array_repeat(F.lit("xxx"), words.cast("int")), " ").alias("text"), iso_duration(_attribute(F.col("t"), "startTime")).alias("start_ms"), iso_duration(_attribute(F.col("t"), "endTime")).alias("end_ms")).where("kind != 'SIL'")
    return rows.select("file", _number(rows).alias("utt_idx"), "speaker", "text", "start_ms", "end_ms")


def _unescaped(x: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return x


def from_eaf(files: DataFrame) -> DataFrame:
    """Annotations of an ELAN file with their slots' times; a tier's first three letters are its speaker. By start, then tier."""
    slots = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"<TIME_SLOT\b[^>]*>"), F.lit(0))).alias("t"))
    slots = slots.select("file", _attribute(F.col("t"), "TIME_SLOT_ID").alias("id"), _attribute(F.col("t"), "TIME_VALUE").try_cast("long").alias("ms"))
    tiers = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"<TIER\b[\s\S]*?</TIER>"), F.lit(0))).alias("t"))
    rows = tiers.select("file", F.regexp_extract("t", r'<TIER\b[^>]*\bTIER_ID="([^"]*)"', 1).alias("tier"), F.posexplode(F.regexp_extract_all("t", F.lit(r"<ALIGNABLE_ANNOTATION\b[\s\S]*?</ALIGNABLE_ANNOTATION>"), F.lit(0))).alias("k", "a"))
    text = F.trim(F.regexp_replace(_unescaped(F.regexp_extract("a", r"<ANNOTATION_VALUE>([\s\S]*?)</ANNOTATION_VALUE>", 1)), r"\s+", " "))
    rows = rows.select("file", "tier", "k", _attribute(F.col("a"), "TIME_SLOT_REF1").alias("r1"), _attribute(F.col("a"), "TIME_SLOT_REF2").alias("r2"), text.alias("text")).where("text != ''")
    at = lambda ref, name: slots.select("file", F.col("id").alias(ref), F.col("ms").alias(name))
    rows = rows.join(at("r1", "start_ms"), ["file", "r1"], "left").join(at("r2", "end_ms"), ["file", "r2"], "left")
    n = F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "tier", "k")).cast("long")
    return rows.select("file", n.alias("utt_idx"), F.upper(F.substring("tier", 1, 3)).alias("speaker"), "text", "start_ms", "end_ms")


def from_textgrid(files: DataFrame) -> DataFrame:
    """Intervals of a Praat TextGrid, long or short, that have a text; by start, then tier."""
    # Both forms have the same values in the same order; the long one has names before them.
    values = F.regexp_extract_all("text", F.lit(r'"(?:[^"]|"")*"|(?<![\w"\[])-?\d+(?:\.\d+)?(?![\w\]])'), F.lit(0))
    found = F.udf(_intervals, "array<struct<tier:string,start_s:double,end_s:double,text:string>>")
    rows = files.select("file", F.inline(found(values)))
    rows = rows.select("file", "tier", F.floor(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.floor(F.col("end_s") * 1000).cast("long").alias("end_ms"), F.trim("text").alias("text")).where("text != ''")
    n = F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "tier")).cast("long")
    return rows.select("file", n.alias("utt_idx"), F.upper(F.substring("tier", 1, 3)).alias("speaker"), "text", "start_ms", "end_ms")


def _intervals(values: list[str]) -> list[tuple]:
    """Interval tiers out of a TextGrid's values: the lengths stand before what they count, so they are read in order."""
    out, at = [], next((k + 1 for k, v in enumerate(values) if v == '"TextGrid"'), None)
    if at is None:
        return []
    at += 2  # the grid's own times
    text = lambda v: v[1:-1].replace('""', '"')
    for _ in range(int(float(values[at]))):
        at += 1
        kind, name = text(values[at]), text(values[at + 1])
        at += 4
        for _ in range(int(float(values[at]))):
            if kind == "IntervalTier":
                out.append((name, float(values[at + 1]), float(values[at + 2]), text(values[at + 3])))
                at += 3
            else:
                at += 2
    return out
