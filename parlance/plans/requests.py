"""A command line to a result: one table of options, and one of commands, from which parsing, defaults and dispatch follow.

run_line("freq +tCHI -s@stop.cut corpus") reads old flags and new --options alike. Files are parsed once for a request; a stored
scan can stand for them.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import comparison, diversity, frequency, interaction, lengths, linkers, patterns, places, profiles, validation
from parlance.operators.filters import Filters
from parlance.plans.commands import CASE_SENSITIVE, REFUSED
from parlance.plans.flags import rewritten
from parlance.sources import chat, rules


class Option(NamedTuple):
    """An option: what its values are, where it goes (a filter's field, or an argument of commands), and which commands know it; none, all do."""

    name: str
    kind: str  # flag, text, number, texts, numbers, span, file: the words of a file
    to: str
    commands: str = ""


OPTIONS = (
    Option("speaker", "texts", "filter.speakers"),
    Option("exclude-speaker", "texts", "filter.not_speakers"),
    Option("gem", "texts", "filter.gems"),
    Option("exclude-gem", "texts", "filter.not_gems"),
    Option("range", "span", "filter.range"),
    Option("utterance-length", "text", "filter.length"),
    Option("length-exclude", "texts", "filter.length_left_out"),
    Option("length-exclude-file", "file", "filter.length_left_out"),
    Option("id-filter", "text", "filter.id_pattern"),
    Option("role", "texts", "filter.roles"),
    Option("case-sensitive", "flag", "case"),
    Option("include-retracings", "flag", "read.retraced"),
    Option("restore", "texts", "read.restored"),
    Option("replacement-mode", "text", "replacement", "freq"),
    Option("per-file", "flag", "per_file"),
    Option("include-word", "texts", "include", "freq gemfreq kwal"),
    Option("include-word-file", "file", "include", "freq gemfreq kwal"),
    Option("exclude-word", "texts", "exclude", "freq gemfreq"),
    Option("exclude-word-file", "file", "exclude", "freq gemfreq"),
    Option("include-word", "texts", "filter.words"),
    Option("include-word-file", "file", "filter.words"),
    Option("exclude-word", "texts", "filter.not_words"),
    Option("exclude-word-file", "file", "filter.not_words"),
    Option("tier", "text", "tier", "freq"),
    Option("capitalization", "text", "capital", "freq gemfreq"),
    Option("word-delimiters", "text", "delimiters", "freq"),
    Option("combine-speakers", "flag", "combine_speakers", "freq gemfreq"),
    Option("sort", "text", "sort", "freq uniq"),
    Option("mattr", "number", "mattr", "freq"),
    Option("types-tokens-only", "flag", "types", "freq"),
    Option("word-list-only", "flag", "list", "freq"),
    Option("include-zero-frequency", "flag", "zeros", "freq"),
    Option("speaker-percentage", "text", "share", "freq"),
    Option("per-pattern", "flag", "each", "freq"),
    Option("any-order", "flag", "any_order", "freq"),
    Option("sole", "flag", "sole", "freq"),
    Option("matched-display", "flag", "show", "freq"),
    Option("words", "flag", "words", "mlu mlt"),
    Option("exclude-solo-word", "texts", "solo", "mlu mlt"),
    Option("exclude-solo-word-file", "file", "solo", "mlu mlt"),
    Option("length-filter", "text", "bound", "wdsize"),
    Option("exclude-length", "numbers", "left_out", "maxwd"),
    Option("unique-length-only", "flag", "unique_lengths", "maxwd"),
    Option("limit", "number", "limit", "maxwd"),
    Option("second-position", "flag", "second", "freqpos"),
    Option("strict-match", "flag", "strict", "kwal"),
    Option("context-after", "number", "after", "kwal"),
    Option("context-before", "number", "before", "kwal"),
    Option("search", "texts", "expressions", "combo"),
    Option("search-file", "file", "expressions", "combo"),
    Option("exclude-search", "texts", "exclude", "combo"),
    Option("exclude-search-file", "file", "exclude", "combo"),
    Option("first-match-only", "flag", "first_only", "combo"),
    Option("dedupe-matches", "flag", "dedupe", "combo"),
    Option("cluster-size", "number", "size", "cooccur"),
    Option("once-per-turn", "flag", "once_per_turn", "dist"),
    Option("keyword", "texts", "keywords", "keymap"),
    Option("max-utterances", "number", "most", "dss ipsyn"),
    Option("tier1", "text", "first", "trnfix"),
    Option("tier2", "text", "second", "trnfix"),
    Option("template", "text", "other", "script"),
    Option("second-file", "text", "other", "rely"),
    Option("script", "text", "script", "mortable"),
    Option("error", "numbers", "include", "check"),
    Option("exclude-error", "numbers", "exclude", "check"),
    Option("bullets", "number", "bullets", "check"),
    Option("check-target", "flag", "target", "check"),
    Option("check-id", "flag", "ids", "check"),
    Option("check-unused", "flag", "unused", "check"),
    Option("list-errors", "flag", "listed", "check"),
)


class Corpus:
    """Transcripts of a request, as a table of files or a stored scan of them; each of its tables is made when it is asked for."""

    def __init__(self, spark: SparkSession, files: DataFrame) -> None:
        self.spark, self.files = spark, files

    @cached_property
    def ids(self) -> DataFrame:
        return chat.ids(self.files)

    def turns(self, request: Request) -> DataFrame:
        found = chat.turns(self.files, **request.reading, only=COMMANDS[request.command].reads)
        return request.filters.apply(found.withColumn("cw", chat.unprotected("cw")), self.ids)

    def other(self, path: str, request: Request) -> DataFrame:
        """The turns of a second file."""
        return Corpus(self.spark, chat.read_files(self.spark, path)).turns(request)


@dataclass
class Request:
    """A command with its filters, how transcripts are read, its arguments and the paths behind it."""

    command: str
    filters: Filters = field(default_factory=Filters)
    reading: dict[str, Any] = field(default_factory=dict)
    arguments: dict[str, Any] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)
    per_file: bool = False

    @property
    def by(self) -> tuple[str, ...]:
        return ("file", "speaker") if self.per_file else ("speaker",)

    def take(self, *names: str) -> dict[str, Any]:
        """Arguments that were given, of these names."""
        return {n: self.arguments[n] for n in names if n in self.arguments}


def parsed(arguments: list[str], words: Callable[[str], list[str]]) -> Request:
    """A request of a command's arguments, its name first. words: reads the words of a file. What isn't known is refused by name."""
    name, *rest = rewritten(arguments) or [""]
    if name in REFUSED:
        raise NotImplementedError(f"{name} needs a trained grammar and is not provided")
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name!r}")
    known: dict[str, Option] = {}
    for option in OPTIONS:
        if not option.commands or name in option.commands.split():
            known.setdefault(option.name, option)
    out, plain = Request(name, Filters(case_sensitive=name in CASE_SENSITIVE)), False
    while rest:
        arg = rest.pop(0)
        if plain or arg[:1] not in ("+", "-") or arg == "-":
            out.paths.append(arg)
            continue
        plain = plain or arg == "--"
        if plain:
            continue
        if arg[2:] not in known or not arg.startswith("--"):
            raise ValueError(f"{name} has no option {arg}")
        option = known[arg[2:]]
        if option.kind != "flag" and not rest:
            raise ValueError(f"{arg} wants a value")
        _put(out, option, True if option.kind == "flag" else _value(option, rest.pop(0), words))
    for needed in COMMANDS[name].needs:
        if not out.arguments.get(needed) and not (needed == "gems" and out.filters.gems):
            raise ValueError(f"{name} needs {needed}")
    return out


def _value(option: Option, text: str, words: Callable[[str], list[str]]) -> Any:
    if option.kind == "span":
        first, _, last = text.partition("-")
        return int(first), int(last)
    return {"text": str, "number": int, "texts": lambda x: [x], "numbers": lambda x: [int(x)], "file": words}[option.kind](text)


def _put(out: Request, option: Option, value: Any) -> None:
    where, _, name = option.to.rpartition(".")
    several = option.kind in ("texts", "numbers", "file")
    if where == "filter":
        setattr(out.filters, name, getattr(out.filters, name) + value if several else value)
    elif where == "read":
        out.reading[name] = (*out.reading.get(name, ()), *value) if several else value
    elif option.to == "case":  # the other way round where case counts by itself
        out.filters.case_sensitive = out.command not in CASE_SENSITIVE
    elif option.to == "per_file":
        out.per_file = True
    elif option.to == "replacement":
        out.reading["originals"] = value == "original"
    else:
        out.arguments[name] = out.arguments.get(name, []) + value if several else value


def _freq(c: Corpus, r: Request) -> DataFrame:
    turns, case = c.turns(r), r.filters.case_sensitive
    asked = r.arguments.get("include", [])
    groups = [w for w in asked if len(w.split()) > 1]
    if "tier" in r.arguments:
        return frequency.of_tier(turns, r.arguments["tier"], r.by)
    if r.arguments.get("each"):
        return patterns.pattern_counts(turns, asked, r.by, case)
    if "mattr" in r.arguments:
        return frequency.moving_ratio(turns, r.arguments["mattr"], case_sensitive=case)
    if "share" in r.arguments:
        sign = r.arguments["share"].rstrip("0123456789")
        return frequency.by_share_of_speakers(turns, int(r.arguments["share"][len(sign) :]), sign)
    if groups and r.arguments.get("show"):
        return patterns.group_counts(turns, groups, r.by, case_sensitive=case, show=True, **r.take("any_order", "sole"))
    single = [w for w in asked if len(w.split()) == 1]
    out = frequency.frequency(turns, r.by, include=single, case_sensitive=case, **r.take("exclude", "capital", "delimiters", "combine_speakers"))
    if groups:
        more = patterns.group_counts(turns, groups, r.by, case_sensitive=case, **r.take("any_order", "sole")).withColumnRenamed("group", "word")
        out = more if not single else out.unionByName(more)
    if r.arguments.get("zeros"):
        return frequency.with_zeros(out, asked, case)
    if r.arguments.get("types"):
        return frequency.types_and_tokens(out, r.by)
    if r.arguments.get("list"):
        return out.select("word").distinct()
    return frequency.ordered(out, r.arguments["sort"], r.by) if "sort" in r.arguments else out


def _mlu(c: Corpus, r: Request) -> DataFrame:
    return lengths.mean_length(c.turns(r), morphemes=not r.arguments.get("words"), by=r.by, **r.take("solo"))


def _kwal(c: Corpus, r: Request) -> DataFrame:
    return places.keyword_lines(c.turns(r), r.arguments["include"], case_sensitive=r.filters.case_sensitive, **r.take("strict", "before", "after"))


def _wdsize(c: Corpus, r: Request) -> DataFrame:
    sign, _, size = r.arguments.get("bound", "").partition(":")
    return lengths.word_sizes(c.turns(r), (sign, int(size)) if sign else None)


def _check(c: Corpus, r: Request) -> DataFrame:
    if r.arguments.get("listed"):
        return validation.numbers(c.spark)
    return validation.check(c.files if "line_no" in c.files.columns else chat.scan(c.files, ("line", "turn", "problem")), **r.take("include", "exclude", "bullets", "target", "ids", "unused"))


def _uniq(c: Corpus, r: Request) -> DataFrame:
    out = places.unique_lines(chat.lines(c.files).select("file", F.col("raw").alias("line")))
    return out.orderBy(F.desc("count"), "line") if r.arguments.get("sort") == "frequency" else out


def _mortable(c: Corpus, r: Request) -> DataFrame:
    text = "\n".join(x.value for x in c.spark.read.text(r.arguments["script"]).collect())
    return profiles.morpheme_table(c.turns(r), rules.morpheme_rules(text))


class Command(NamedTuple):
    run: Callable[[Corpus, Request], DataFrame]
    needs: tuple[str, ...] = ()
    reads: tuple[str, ...] | None = None  # fields of turns that it and the filters take; all, if not told


def _plain(operator: Callable[..., DataFrame], *names: str, by: bool = False, case: bool = False) -> Callable[[Corpus, Request], DataFrame]:
    """An operator of turns that takes these arguments, and what results are grouped by or whether case counts, if it can."""

    def run(c: Corpus, r: Request) -> DataFrame:
        more = r.take(*names) | ({"by": r.by} if by else {}) | ({"case_sensitive": r.filters.case_sensitive} if case else {})
        return operator(c.turns(r), **more)

    return run


COMMANDS: dict[str, Command] = {
    "freq": Command(_freq),
    "gemfreq": Command(_freq, ("gems",)),
    "mlu": Command(_mlu, reads=("utt_idx", "speaker", "active_gems", "postcodes", "mor")),
    "mlt": Command(_plain(lengths.turn_lengths, "solo")),
    "wdlen": Command(_plain(lengths.length_histograms)),
    "wdsize": Command(_wdsize),
    "maxwd": Command(_plain(lengths.longest_words, "left_out", "unique_lengths", "limit")),
    "freqpos": Command(_plain(places.positions, "second")),
    "timedur": Command(_plain(lengths.durations, by=True)),
    "kwal": Command(_kwal, ("include",)),
    "gemlist": Command(_plain(interaction.gems)),
    "combo": Command(_plain(places.combinations, "expressions", "exclude", "first_only", "dedupe", case=True), ("expressions",)),
    "cooccur": Command(_plain(places.clusters, "size")),
    "dist": Command(_plain(places.distances, "once_per_turn", case=True)),
    "chip": Command(_plain(interaction.echo_counts)),
    "phonfreq": Command(_plain(comparison.phones)),
    "modrep": Command(_plain(comparison.replicas)),
    "vocd": Command(_plain(diversity.sampled_diversity, by=True, case=True)),
    "codes": Command(_plain(interaction.codes)),
    "chains": Command(_plain(interaction.chains)),
    "complexity": Command(_plain(profiles.complexity)),
    "corelex": Command(_plain(frequency.core_lexicon)),
    "dss": Command(_plain(profiles.sentence_scores, "most")),
    "eval": Command(_plain(profiles.evaluation, by=True)),
    "eval-d": Command(_plain(profiles.evaluation, by=True)),
    "flucalc": Command(_plain(profiles.fluency)),
    "ipsyn": Command(_plain(profiles.syntax_index, "most")),
    "keymap": Command(_plain(interaction.contingencies, "keywords"), ("keywords",)),
    "kideval": Command(_plain(profiles.child_evaluation)),
    "mortable": Command(_mortable, ("script",)),
    "rely": Command(lambda c, r: comparison.agreement(c.turns(r), c.other(r.arguments["other"], r)), ("other",)),
    "script": Command(lambda c, r: comparison.against_template(c.turns(r), c.other(r.arguments["other"], r)), ("other",)),
    "sugar": Command(_plain(profiles.sampling_profile)),
    "trnfix": Command(lambda c, r: comparison.tier_mismatches(c.turns(r), r.arguments.get("first", "mod"), r.arguments.get("second", "pho"))),
    "uniq": Command(_uniq),
    "check": Command(_check),
    "linker-audit": Command(_plain(linkers.linker_stats)),
    "overlap-audit": Command(_plain(interaction.overlap_audit)),
}


def run_line(spark: SparkSession, line: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """The result of a command line. files: a table of files or a stored scan, instead of the paths in the line."""
    arguments = shlex.split(line) if isinstance(line, str) else list(line)

    def words(path: str) -> list[str]:
        return rules.word_list("\n".join(r.value for r in spark.read.text(path).collect()))

    request = parsed(arguments, words)
    if files is None:
        if not request.paths:
            raise ValueError(f"{request.command} needs files")
        files = chat.read_files(spark, request.paths)
    return COMMANDS[request.command].run(Corpus(spark, files), request)
