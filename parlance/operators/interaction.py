"""What happens between turns: echoes, chains, contingencies, gems, linkers, overlaps.

Order counts within a file; a file is the unit that windows are partitioned by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parlance.functions.words import folded, sample_sd


def _order() -> WindowSpec:
    return Window.partitionBy("file").orderBy("utt_idx")



def echoes(turns: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of adjacent utterances of different speakers, both with counted words: exact, overlap or none.

    exact: the same words; overlap: common over the fewer different words is at least the threshold.
    """
    rows = turns.select("file", "utt_idx", "speaker", folded("cw").alias("w"))
    rows = rows.withColumns({"before": F.lag("w").over(_order()), "from": F.lag("speaker").over(_order())})
    rows = rows.where((F.col("from") != F.col("speaker")) & (F.size("w") > 0) & (F.size("before") > 0))
    share = F.size(F.array_intersect("before", "w")) / F.least(F.size(F.array_distinct("before")), F.size(F.array_distinct("w")))
    kind = F.when(F.sort_array("before") == F.sort_array("w"), "exact").when(share >= threshold, "overlap").otherwise("none")
    return rows.select("file", "utt_idx", "from", F.col("speaker").alias("to"), kind.alias("kind"))


def echo_counts(turns: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each directed pair of speakers: responses, exact, overlap and none."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return echoes(turns, threshold).groupBy("from", "to").agg(F.count(F.lit(1)).alias("responses"), count("exact").alias("exact"), count("overlap").alias("overlap"), count("none").alias("none"))


def codes(turns: DataFrame) -> DataFrame:
    """Counts of each speaker's codes."""
    return turns.select("speaker", F.explode("cod").alias("code")).groupBy("speaker", "code").agg(F.count(F.lit(1)).alias("count"))


def chains(turns: DataFrame) -> DataFrame:
    """Of each speaker and code: runs of the speaker's consecutive utterances with the code, their mean, SD (over n - 1), least and most lengths.

    A run is as long as the code occurs in it. Runs end with the file.
    """
    own = Window.partitionBy("file", "speaker").orderBy("utt_idx")
    rows = turns.withColumn("i", F.row_number().over(own)).select("file", "speaker", "i", F.explode("cod").alias("code"))
    rows = rows.groupBy("file", "speaker", "code", "i").agg(F.count(F.lit(1)).alias("n"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("file", "speaker", "code").orderBy("i"))
    lengths = rows.withColumn("run", run).groupBy("file", "speaker", "code", "run").agg(F.sum("n").alias("length"))
    return lengths.groupBy("speaker", "code").agg(
        F.count(F.lit(1)).alias("chains"), F.round(F.avg("length"), 6).alias("mean"), F.round(sample_sd("length"), 6).alias("sd"), F.min("length").alias("least"), F.max("length").alias("most")
    )


def contingencies(turns: DataFrame, keywords: list[str]) -> DataFrame:
    """How often a keyword code of one utterance is followed by each code of the next: from, keyword, to, code, count."""
    rows = turns.select("speaker", "cod", F.lag("speaker").over(_order()).alias("from"), F.lag("cod").over(_order()).alias("before"))
    rows = rows.where(F.exists("before", lambda c: c.isin(*keywords)))
    rows = rows.select("from", "speaker", "cod", F.explode("before").alias("keyword")).where(F.col("keyword").isin(*keywords))
    return rows.select("from", "keyword", F.col("speaker").alias("to"), F.explode("cod").alias("code")).groupBy("from", "keyword", "to", "code").agg(F.count(F.lit(1)).alias("count"))


def gems(turns: DataFrame) -> DataFrame:
    """Of each gem: utterances inside, files it occurs in, and speakers, sorted and joined by commas."""
    rows = turns.select("file", "speaker", F.explode("active_gems").alias("gem"))
    return rows.groupBy("gem").agg(F.count(F.lit(1)).alias("utterances"), F.count_distinct("file").alias("occurrences"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"))


def gem_depth(events: DataFrame) -> DataFrame:
    """Depth of each gem label after each event (file, line_no, label, step 1 or -1); an end without a beginning doesn't count."""
    order = Window.partitionBy("file", F.lower("label")).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = events.withColumn("s", F.sum("step").over(order))
    return sums.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(order))).drop("s")


# Linkers and what they ask of the utterances before.
LINKERS = ("++", "+,", "+<", '+"', "+^", "+≈", "+≋")
TRAILING, INTERRUPTED, QUOTED = ("+...", "+..?"), ("+/.", "+/?", "+//.", "+//?"), ('+"/.', '+".')


def linker_audit(turns: DataFrame) -> DataFrame:
    """Of each file: counts of linkers, and how many of ++, +, and +" follow what they need.

    ++ wants another speaker's trailing off just before; +, an interruption of the speaker's own last
    utterance; +" an announced quotation just before. blocks: runs of utterances with +<; longest: the longest.
    """
    own = Window.partitionBy("file", "speaker").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("file", "utt_idx", "speaker", "terminator", "linkers")
    rows = rows.withColumns({"pt": F.lag("terminator").over(_order()), "ps": F.lag("speaker").over(_order()), "own": F.last("terminator", ignorenulls=True).over(own)})
    has = lambda x: F.array_contains("linkers", x)
    lazy = has("+<")
    new = (lazy & ~F.coalesce(F.lag(lazy).over(_order()), F.lit(False))).cast("long")
    rows = rows.withColumn("lazy", lazy).withColumn("block", F.sum(new).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.where("lazy").groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("longest"))
    count = lambda test: F.count(F.when(test, 1))
    names = ("other_completion", "self_completion", "lazy_overlap", "quotation", "quick_uptake", "latching", "tcu")
    out = rows.groupBy("file").agg(
        *(count(has(k)).alias(n) for k, n in zip(LINKERS, names, strict=True)),
        count(has("++") & F.col("pt").isin(*TRAILING) & (F.col("ps") != F.col("speaker"))).alias("other_completion_fits"),
        count(has("+,") & F.col("own").isin(*INTERRUPTED, *TRAILING)).alias("self_completion_fits"),
        count(has('+"') & F.col("pt").isin(*QUOTED)).alias("quotation_fits"),
    )
    return out.join(blocks, "file", "left").na.fill(0, ["blocks", "longest"])


def overlap_audit(turns: DataFrame, tolerance: int = 2000, only_open: float = 0.8) -> DataFrame:
    """Of each file: overlap tops (⌈) with a bottom (⌊) of the same index by another speaker, tops and bottoms without, and quality.

    A bottom belongs to the last top of its index before it that another speaker said; one top can have
    several. timed: pairs whose times lie within the tolerance, of those that have times.
    """
    mark = lambda sign: F.regexp_extract_all("text", F.lit(f"{sign}([2-9]?)"), F.lit(1))
    base = turns.select("file", "utt_idx", "speaker", "text", *(c if c in turns.columns else F.lit(None).cast("long").alias(c) for c in ("start_ms", "end_ms")))
    of = lambda sign, kind: base.select("file", "utt_idx", "speaker", "start_ms", "end_ms", F.lit(kind).alias("kind"), F.posexplode(mark(sign)).alias("k", "index"))
    rows = of("⌈", "top").unionByName(of("⌊", "bottom"))
    order = Window.partitionBy("file", "index").orderBy("utt_idx", F.desc("kind"), "k").rowsBetween(Window.unboundedPreceding, -1)
    top = F.last(F.when(F.col("kind") == "top", F.struct("utt_idx", "k", "speaker", "start_ms", "end_ms")), ignorenulls=True).over(order)
    paired = rows.withColumn("top", top).withColumn("fits", (F.col("kind") == "bottom") & F.col("top").isNotNull() & (F.col("top.speaker") != F.col("speaker")))
    timed = F.col("fits") & F.col("start_ms").isNotNull() & F.col("top.start_ms").isNotNull()
    near = timed & (F.col("start_ms") <= F.col("top.end_ms") + tolerance) & (F.col("end_ms") >= F.col("top.start_ms") - tolerance)
    count = lambda test: F.count(F.when(test, 1))
    sums = paired.groupBy("file").agg(
        count(F.col("kind") == "top").alias("tops"),
        count(F.col("kind") == "bottom").alias("bottoms"),
        F.count_distinct(F.when(F.col("fits"), F.struct("index", "top.utt_idx", "top.k"))).alias("groups"),
        count((F.col("kind") == "bottom") & ~F.col("fits")).alias("orphan_bottoms"),
        count(timed).alias("timed"),
        count(near).alias("consistent"),
    )
    orphans = F.col("tops") - F.col("groups")
    share = (orphans + F.col("orphan_bottoms")) / F.greatest(F.lit(1), F.col("groups") + orphans + F.col("orphan_bottoms"))
    quality = F.when((orphans + F.col("orphan_bottoms")) == 0, "fully_paired").when((share > only_open), "open_only").otherwise("mixed")
    return base.select("file").distinct().join(sums.withColumn("orphan_tops", orphans).withColumn("quality", quality), "file", "left").na.fill(0).na.fill("none", ["quality"])


def overlap_summary(audited: DataFrame) -> DataFrame:
    """overlap_audit() over all files: their sums, files with overlaps, files of each quality, and the shares of tops that are paired and of timed pairs that are consistent."""
    sums = ("tops", "bottoms", "groups", "orphan_tops", "orphan_bottoms", "timed", "consistent")
    count = lambda test: F.count(F.when(test, 1))
    out = audited.agg(
        F.count(F.lit(1)).alias("files"), count(F.col("tops") + F.col("bottoms") > 0).alias("files_with_overlaps"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums),
        *(count(F.col("quality") == q).alias(q) for q in ("fully_paired", "open_only", "mixed")),
    )
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.withColumns({"paired_share": share("groups", "tops"), "consistent_share": share("consistent", "timed")})
