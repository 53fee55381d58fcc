"""Spreadsheets of word frequencies as files: a workbook for each file of a corpus, written by tasks.

A workbook is lines of text, in order: tasks sort the lines of their workbooks and stream them out, so neither the
driver nor a task holds one. Spark's commit makes all of them visible at once, and a task that is run anew leaves nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.words import ratio
from parlance.operators.frequency import frequency, moving_ratio

# What stands before and behind the rows, and the remark on ratios that aren't of lemmas.
OPENING = '<?xml version="1.0"?>\n<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">\n<Worksheet ss:Name="sheet 1"><Table>'
CLOSING = "</Table></Worksheet>\n</Workbook>"
CAVEAT = (
    "This TTR number was not calculated on the basis of %mor line forms.",
    "If you want a TTR based on lemmas, run FREQ on the %mor line",
    "with option: +sm;*,o%",
)
#: Columns of @ID headers in a sheet.
ID_COLUMNS = {"language": "Language", "corpus": "Corpus", "age": "Age", "sex": "Sex", "grp": "Group", "ses": "SES", "role": "Role", "education": "Education", "custom": "Custom"}
_NAMED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
#: Places of lines that aren't data.
_REMARK, _HEADER = -50, -1


def text_cell(x: Column) -> Column:
    """A cell of text; a point for what is missing."""
    for char, name in _NAMED:
        x = F.replace(x, F.lit(char), F.lit(name))
    return F.concat(F.lit('<Cell><Data ss:Type="String">'), F.coalesce(x, F.lit(".")), F.lit("</Data></Cell>"))


def number_cell(x: Column, places: int = 0) -> Column:
    """A cell of a number; a point for what is missing."""
    shown = F.format_string(f"%.{places}f", x.cast("double")) if places else x.cast("long").cast("string")
    return F.when(x.isNull(), text_cell(F.lit(None).cast("string"))).otherwise(F.concat(F.lit('<Cell><Data ss:Type="Number">'), shown, F.lit("</Data></Cell>")))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("<Row>"), *cells, F.lit("</Row>"))


def _titles(*names: str) -> Column:
    return F.concat(*(text_cell(F.lit(n)) for n in names))


def write_workbooks(lines: DataFrame, path: str, packed: bool = False) -> None:
    """Rows of sheets (book, n, line) as one file for each book, in the order of n.

    packed: Parquet rows (book, line) instead, many books in a file, for so many small books that a file each costs more than what is in it.
    """
    order = Window.partitionBy("book").orderBy("n")
    none = F.array().cast("array<string>")
    frame = lambda at, text: F.when(at, F.array(F.lit(text))).otherwise(none)
    ends = lines.select("book", "n", "line", F.lag(F.lit(False), 1, True).over(order).alias("first"), F.lead(F.lit(False), 1, True).over(order).alias("last"))
    framed = ends.select("book", "n", F.posexplode(F.concat(frame(F.col("first"), OPENING), F.array("line"), frame(F.col("last"), CLOSING))).alias("k", "value"))
    every = framed.sortWithinPartitions("book", "n", "k").select("value", "book")
    if packed:
        every.write.parquet(path)
    else:
        every.write.partitionBy("book").text(path)


def read_workbooks(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """book and cells (array of text) of every row of the workbooks in a folder, titles and remarks among them; a point is read as one. packed: as they were written."""
    found = spark.read.schema("value string, book string")
    rows = (found.parquet(path) if packed else found.text(path)).where(F.col("value").startswith("<Row>"))
    cells = F.regexp_extract_all("value", F.lit(r"<Data ss:Type=\"\w+\">([^<]*)</Data>"), F.lit(1))

    def plain(x: Column) -> Column:
        for char, name in reversed(_NAMED):
            x = F.replace(x, F.lit(name), F.lit(char))
        return x

    return rows.select("book", F.transform(cells, lambda x: plain(x)).alias("cells"))


def flat_sheet(turns: DataFrame) -> DataFrame:
    """Rows (book, n, line) of a workbook for each file: file, speaker, word and count, one row for each word."""
    counts = frequency(turns, ("file", "speaker"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("speaker", "word"))
    data = counts.select(F.col("file").alias("book"), n.cast("long").alias("n"), row(text_cell(F.col("file")), text_cell(F.col("speaker")), text_cell(F.col("word")), number_cell(F.col("count"))).alias("line"))
    header = turns.select(F.col("file").alias("book")).distinct().select("book", F.lit(_HEADER).cast("long").alias("n"), row(_titles("File", "Code", "Word", "Count")).alias("line"))
    return header.unionByName(data)


def wide_sheet(turns: DataFrame, ids: DataFrame | None = None, words: bool = True, mattr: int | None = None, of_lemmas: bool = False) -> DataFrame:
    """Rows (book, n, line) of a workbook for each file: a row for each speaker, with what @ID says of them, a column for each word that anyone in the file says, and types, tokens and their ratio.

    words: False for the sheet without words. mattr: also the moving ratio over so many words. of_lemmas: no remark on the ratio.
    Each file's words are joined with its speakers; nothing is as large as the corpus.
    """
    counts = frequency(turns, ("file", "speaker"))
    key = ["file", "speaker"]
    sums = counts.groupBy(*key).agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("tokens")).withColumn("ttr", ratio("types", "tokens"))
    shown = {c: t for c, t in ID_COLUMNS.items() if ids is not None and c in ids.columns}
    if shown:
        sums = sums.join(ids.groupBy(*key).agg(*(F.first(c).alias(c) for c in shown)), key, "left")
    if words:
        every = counts.select("file", "word").distinct().join(sums.select(*key), "file").join(counts, [*key, "word"], "left")
        cells = every.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word", number_cell(F.coalesce("count", F.lit(0))).alias("cell")))).alias("w"))
        sums = sums.join(cells.select(*key, F.array_join(F.transform("w", lambda x: x["cell"]), "").alias("cells")), key)
        titles = counts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_set("word")), lambda x: text_cell(x)), "").alias("titles"))
    else:
        sums, titles = sums.withColumn("cells", F.lit("")), turns.select("file").distinct().withColumn("titles", F.lit(""))
    last = []
    if mattr:
        sums = sums.join(moving_ratio(turns, mattr).select(*key, "mattr"), key, "left")
        last = [number_cell(F.col("mattr"), 3)]
    n = F.row_number().over(Window.partitionBy("file").orderBy("speaker")).cast("long")
    data = sums.select(
        F.col("file").alias("book"), n.alias("n"),
        row(text_cell(F.col("file")), text_cell(F.col("speaker")), *(text_cell(F.nullif(F.col(c), F.lit(""))) for c in shown), F.col("cells"), number_cell(F.col("types")), number_cell(F.col("tokens")), number_cell(F.col("ttr"), 3), *last).alias("line"),
    )
    files = turns.select("file").distinct().join(titles, "file", "left").select(F.col("file").alias("book"), F.coalesce("titles", F.lit("")).alias("titles"))
    line = row(_titles("File", "Code", *shown.values()), F.col("titles"), _titles("Types", "Token", "TTR", *(["MATTR"] if mattr else [])))
    out = data.unionByName(files.select("book", F.lit(_HEADER).cast("long").alias("n"), line.alias("line")))
    if not of_lemmas:
        for k, remark in enumerate(CAVEAT):
            out = out.unionByName(files.select("book", F.lit(_REMARK + k).cast("long").alias("n"), row(text_cell(F.lit(remark))).alias("line")))
    return out
