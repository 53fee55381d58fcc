"""Commands by name: turns and options to a result. per_file adds the file to what results are grouped by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from parlance.operators import diversity, frequency, interaction, lengths, places, profiles
from parlance.operators.filters import Filters

#: Commands that compare case unless told otherwise.
CASE_SENSITIVE = ("freq", "vocd")
#: Commands that look at files whole and take no filters.
UNFILTERED = ("gemlist", "uniq", "linker_audit", "overlap_audit")
#: Names of commands that need a trained tagger or lexicon; they are known and refused.
REFUSED = ("mor", "post", "megrasp", "postlist", "postmodrules", "posttrain")
#: Commands that want an option that has no default.
NEEDED = {"keymap": "keywords", "kwal": "keywords", "combo": "expressions", "mortable": "rules"}

COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "freq": frequency.frequency, "gemfreq": frequency.frequency, "mlu": lengths.mean_length, "mlt": lengths.turn_lengths, "wdlen": lengths.length_histograms, "wdsize": lengths.word_sizes,
    "maxwd": lengths.longest_words, "freqpos": places.positions, "timedur": lengths.durations, "kwal": places.keyword_lines, "combo": places.combinations, "cooccur": places.clusters,
    "dist": places.distances, "chip": interaction.echo_counts, "vocd": diversity.vocd, "codes": interaction.codes, "chains": interaction.chains, "complexity": profiles.complexity,
    "corelex": frequency.core_lexicon, "dss": profiles.sentence_scores, "ipsyn": profiles.syntax_index, "eval": profiles.evaluation, "eval-d": profiles.evaluation, "kideval": profiles.child_evaluation,
    "flucalc": profiles.fluency, "gemlist": interaction.gems, "keymap": interaction.contingencies, "mortable": profiles.morpheme_table, "sugar": profiles.sampling_profile,
    "linker_audit": interaction.linker_audit, "overlap_audit": interaction.overlap_audit,
}
_BY = ("freq", "gemfreq", "mlu", "timedur", "vocd", "eval", "eval-d")


@dataclass
class Request:
    """What to run: a command, its filters and options."""

    command: str
    filters: Filters = field(default_factory=Filters)
    options: dict[str, Any] = field(default_factory=dict)
    per_file: bool = False

    def run(self, turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        name = self.command
        if name in REFUSED:
            raise NotImplementedError(f"{name} needs a trained grammar and is not provided")
        if name not in COMMANDS:
            raise ValueError(f"unknown command {name!r}")
        if name in NEEDED and not self.options.get(NEEDED[name]):
            raise ValueError(f"{name} needs {NEEDED[name]}")
        if name == "gemfreq" and not self.filters.gems:
            raise ValueError("gemfreq needs a gem")
        options = dict(self.options)
        if self.per_file and name in _BY:
            options["by"] = ("file", "speaker")
        if name not in UNFILTERED:
            turns = self.filters.apply(turns, ids)
        return COMMANDS[name](turns, **options)
