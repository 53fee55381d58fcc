"""Linkers and special terminators of conversations: what announces something, what follows it, and what is left alone.

All is read from windows over a file's utterances; no file is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Linkers and special terminators, with the names their counts get.
LINKERS = {"+<": "lazy_overlap", "++": "other_completion", "+^": "quick_uptake", '+"': "quotation_follows", "+,": "self_completion", "+≋": "tcu_continuation", "+≈": "no_break_tcu"}
TERMINATORS = {
    "+...": "trailing_off", "+..?": "trailing_off_question", "+/.": "interruption", "+/?": "interrupted_question", "+//.": "self_interruption", "+//?": "self_interrupted_question",
    "+!?": "broken_question", '+"/.': "quotation_follows", '+".': "quotation_precedes", "+.": "break_for_coding", "≋": "technical_break", "≈": "no_break",
}
TRAILING, INTERRUPTED = ("+...", "+..?"), ("+/.", "+/?")
#: What a linker takes up: the terminators that announce it, and whether another speaker must have said them.
ANNOUNCED = {"++": (TRAILING, True), "+,": (INTERRUPTED, False), '+"': (('+"/.',), False)}
#: Columns of linker_stats() that count what doesn't fit.
ANOMALIES = ("pp_same_speaker", "pp_wrong_terminator", "pp_first_utterance", "sc_wrong_terminator", "sc_no_prior", "qf_wrong_terminator", "qf_no_prior")
#: A file has something to audit if one of these is above zero.
SPECIAL = [f"linker_{n}" for n in LINKERS.values()] + [f"term_{n}" for n in ("trailing_off", "interruption", "self_interruption", "quotation_follows", "quotation_precedes")]


def _rows(turns: DataFrame) -> DataFrame:
    linkers = F.coalesce("linkers", F.array().cast("array<string>"))
    return turns.select("file", "utt_idx", "speaker", "terminator", linkers.alias("linkers"))


def linker_stats(turns: DataFrame) -> DataFrame:
    """One row for each file: counts of linkers and terminators, how each linker fits what came before, blocks of overlaps, and what was taken up.

    pp (++): another speaker's trailing off just before is right. sc (+,): the speaker's last terminator
    was an interruption. qf (+"): it announced a quotation, or the speaker's last utterance had a +" too (chained). lo (+<):
    runs of utterances with it. qu (+^), tcu (+≋, +≈): whether the utterance before is the same speaker's; the first one
    counts as another's. An utterance may have several linkers, and null ones count as none.
    """
    order, own = Window.partitionBy("file").orderBy("utt_idx"), Window.partitionBy("file", "speaker").orderBy("utt_idx")
    has = lambda x: F.array_contains("linkers", x)
    primary = F.get(F.filter("linkers", lambda x: x != "+<"), F.lit(0))
    rows = _rows(turns).withColumns(
        {
            "before": F.lag("speaker").over(order),
            "ended": F.lag("terminator").over(order),
            "first": F.row_number().over(order) == 1,
            "own": F.last("terminator", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)),
            "chain": F.lag(primary).over(own),
            "lazy": has("+<"),
        }
    )
    opens = F.col("lazy") & ~F.coalesce(F.lag("lazy").over(order), F.lit(False))
    rows = rows.withColumns({"opens": opens, "block": F.sum(opens.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    same = F.coalesce(F.col("before") == F.col("speaker"), F.lit(False))
    count = lambda test: F.count(F.when(test, 1))
    is_ = lambda k: lambda x: x == k
    pp, sc, qf = has("++"), has("+,"), has('+"')
    trailed, cut = F.coalesce(F.col("ended").isin(*TRAILING), F.lit(False)), F.coalesce(F.col("ended").isin(*INTERRUPTED), F.lit(False))
    prior, own_cut, own_quote, chained = F.col("own").isNotNull(), F.col("own").isin(*INTERRUPTED), F.col("own") == '+"/.', F.coalesce(F.col("chain") == '+"', F.lit(False))
    sums: dict[str, Column] = {"utterances": F.count(F.lit(1))}
    sums |= {f"linker_{name}": F.sum(F.size(F.filter("linkers", is_(k)))).cast("long") for k, name in LINKERS.items()}
    sums |= {f"term_{name}": count(F.col("terminator") == k) for k, name in TERMINATORS.items()}
    sums |= {
        "pp_correct": count(pp & ~F.col("first") & ~same & trailed),
        "pp_same_speaker": count(pp & same),
        "pp_wrong_terminator": count(pp & ~F.col("first") & ~same & ~trailed),
        "pp_first_utterance": count(pp & F.col("first")),
        "sc_correct": count(sc & own_cut),
        "sc_wrong_terminator": count(sc & prior & ~own_cut),
        "sc_no_prior": count(sc & ~prior),
        "qf_correct": count(qf & own_quote),
        "qf_chained": count(qf & prior & ~own_quote & chained),
        "qf_wrong_terminator": count(qf & prior & ~own_quote & ~chained),
        "qf_no_prior": count(qf & ~prior),
        "lo_same_speaker_start": count(F.col("opens") & same),
        "lo_combined_with_other": count(F.col("lazy") & F.exists("linkers", lambda x: x != "+<")),
        "qu_same_speaker": count(has("+^") & same),
        "qu_diff_speaker": count(has("+^") & ~same),
        "tcu_tech_same_speaker": count(has("+≋") & same),
        "tcu_tech_diff_speaker": count(has("+≋") & ~same),
        "tcu_nb_same_speaker": count(has("+≈") & same),
        "tcu_nb_diff_speaker": count(has("+≈") & ~same),
        "trailing_off_total": count(F.col("terminator").isin(*TRAILING)),
        "trailing_off_followed": count(trailed & (pp | sc)),
        "interruption_total": count(F.col("terminator").isin(*INTERRUPTED)),
        "interruption_followed": count(cut & sc),
    }
    stats = rows.groupBy("file").agg(*(c.alias(n) for n, c in sums.items()))
    size = rows.where("lazy").groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speaker").alias("speakers"))
    n = F.col("n")
    blocks = size.groupBy("file").agg(F.count(F.lit(1)).alias("lo_blocks"), count(n == 1).alias("lo_block_size_1"), count(n == 2).alias("lo_block_size_2"), count(n >= 3).alias("lo_block_size_3plus"), F.max("speakers").alias("lo_max_speakers_in_block"))
    return stats.join(blocks, "file", "left").na.fill(0, ["lo_blocks", "lo_block_size_1", "lo_block_size_2", "lo_block_size_3plus", "lo_max_speakers_in_block"])


def linker_pairs(turns: DataFrame) -> DataFrame:
    """file, linker, announced_at, taken_up_at: each announcement with the first linker that goes back to it; where one side is missing it is null.

    A linker goes back to the last announcement before it that it fits: a trailing off of another speaker for
    ++, the speaker's own interruption for +, and own announced quotation for +". Only the first linker that goes back to an
    announcement takes it up; later ones are orphans, as announcements that nothing takes up are.
    """
    order, own = Window.partitionBy("file").orderBy("utt_idx"), Window.partitionBy("file", "speaker").orderBy("utt_idx")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows, out = _rows(turns), None
    for linker, (terminators, other) in ANNOUNCED.items():
        announces = F.coalesce(F.col("terminator").isin(*terminators), F.lit(False))
        marked = rows.withColumns({"announces": announces, "links": F.array_contains("linkers", linker)})
        if other:
            # The last announcement, and the last one before it of somebody else than who made it.
            last = marked.withColumn("last", F.last(F.when(F.col("announces"), F.struct("utt_idx", "speaker")), ignorenulls=True).over(before(order)))
            elses = F.when(F.col("announces") & (F.col("last.speaker") != F.col("speaker")), F.col("last.utt_idx"))
            last = last.withColumn("else", F.last(elses, ignorenulls=True).over(before(order)))
            marked = last.withColumn("at", F.when(F.col("last.speaker") != F.col("speaker"), F.col("last.utt_idx")).otherwise(F.col("else")))
        else:
            marked = marked.withColumn("at", F.last(F.when(F.col("announces"), F.col("utt_idx")), ignorenulls=True).over(before(own)))
        links = marked.where("links").withColumn("n", F.row_number().over(Window.partitionBy("file", "at").orderBy("utt_idx")))
        links = links.select("file", F.when(F.col("n") == 1, F.col("at")).alias("announced_at"), F.col("utt_idx").alias("taken_up_at"))
        alone = marked.where("announces").select("file", F.col("utt_idx").alias("announced_at")).join(links.where("announced_at is not null").select("file", "announced_at"), ["file", "announced_at"], "left_anti")
        both = links.unionByName(alone.withColumn("taken_up_at", F.lit(None).cast("long"))).select("file", F.lit(linker).alias("linker"), "announced_at", "taken_up_at")
        out = both if out is None else out.unionByName(both)
    return out


def linker_summary(stats: DataFrame) -> DataFrame:
    """linker_stats() over all files: their sums, how many files have linkers or anomalies, and the shares of announcements that were taken up."""
    numbers = [c for c in stats.columns if c not in ("file", "lo_max_speakers_in_block")]
    anomalies = sum((F.col(c) for c in ANOMALIES[1:]), F.col(ANOMALIES[0]))
    out = stats.agg(
        F.count(F.lit(1)).alias("files"),
        F.count(F.when(F.greatest(*SPECIAL) > 0, 1)).alias("files_with_linkers"),
        F.count(F.when(anomalies > 0, 1)).alias("files_with_anomalies"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers),
        F.max("lo_max_speakers_in_block").alias("lo_max_speakers_in_block"),
    )
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.withColumns({"trailing_off_rate": share("trailing_off_followed", "trailing_off_total"), "interruption_rate": share("interruption_followed", "interruption_total")})
