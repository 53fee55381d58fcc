"""Old-style flags (+tCHI, -s@words, +z10-20 ...) as named options.

A table of rules, tried from the top: the commands it is for, a pattern of the flag, and the option with
its value, in which {0}, {1} ... are the pattern's groups. A flag that no rule knows stays as it is, so
that whoever reads the options can refuse it; an empty option means that the flag has no effect.
"""

from __future__ import annotations

import re

ALL = ""
# Fixed values: (commands, pattern, option, value).
RULES: tuple[tuple[str, str, str, str | None], ...] = (
    ("mlu mlt", r"-t%mor", "words", None),
    ("mlu mlt", r"-bw", "words", None),
    ("combtier", r"\+t%?(\w+)", "tier", "{0}"),
    ("mlu", r"\+t\*", "combine-speakers", None),
    (ALL, r"\+t%:?(\w+):?", "tier", "{0}"),
    (ALL, r"-t%:?(\w+):?", "exclude-tier", "{0}"),
    (ALL, r"\+t@ID=(.+)", "id-filter", "{0}"),
    (ALL, r"\+t#(.+)", "role", "{0}"),
    (ALL, r"\+t\*?(\w+)", "speaker", "{0}"),
    (ALL, r"-t\*?(\w+)", "exclude-speaker", "{0}"),
    ("script", r"\+s(.+)", "template", "{0}"),
    ("combo", r"\+s@(.+)", "search-file", "{0}"),
    ("combo", r"-s@(.+)", "exclude-search-file", "{0}"),
    ("combo", r"\+s(.+)", "search", "{0}"),
    ("combo", r"-s(.+)", "exclude-search", "{0}"),
    ("mlu", r"\+sxxx", "include-xxx", None),
    ("mlu", r"\+syyy", "include-yyy", None),
    ("mlu", r"(?:-sxxx|-syyy|[+-]swww)", "?", None),
    (ALL, r"\+s@(.+)", "include-word-file", "{0}"),
    (ALL, r"-s@(.+)", "exclude-word-file", "{0}"),
    (ALL, r"\+s(.+)", "include-word", "{0}"),
    (ALL, r"-s(.+)", "exclude-word", "{0}"),
    ("mlu mlt", r"\+g@(.+)", "exclude-solo-word-file", "{0}"),
    ("mlu mlt", r"\+g(.+)", "exclude-solo-word", "{0}"),
    ("combo", r"\+g3", "first-match-only", None),
    ("combo", r"\+g[45]", "", None),
    ("combo", r"\+g7", "dedupe-matches", None),
    ("dist", r"\+g", "once-per-turn", None),
    ("check", r"\+g[13]", "", None),
    ("check", r"\+g2", "check-target", None),
    ("check", r"\+g4", "check-id", None),
    ("check", r"\+g5", "check-unused", None),
    ("sugar", r"\+a(\d+)", "min-utterances", "{0}"),
    ("makemod", r"\+a", "all-alternatives", None),
    ("makemod ort", r"\+c(.+)", "dictionary", "{0}"),
    ("lines", r"\+n", "remove", None),
    (ALL, r"\+g(.+)", "gem", "{0}"),
    (ALL, r"-g(.+)", "exclude-gem", "{0}"),
    (ALL, r"\+z(\d+-\d+)", "range", "{0}"),
    ("keymap", r"\+b(.+)", "keyword", "{0}"),
    ("kwal", r"\+b", "strict-match", None),
    ("freq", r"\+b(\d+)", "mattr", "{0}"),
    ("freq", r"\+x(xxx|yyy|www)", "restore", "{0}"),
    ("freq", r"-x@(.+)", "length-exclude-file", "{0}"),
    ("freq", r"-x(.+)", "length-exclude", "{0}"),
    ("maxwd", r"\+x(\d+)", "exclude-length", "{0}"),
    ("maxwd", r"\+a", "unique-length-only", None),
    ("maxwd", r"\+c(\d+)", "limit", "{0}"),
    (ALL, r"\+x([<>=]\d+[cwm])", "utterance-length", "{0}"),
    ("freq", r"\+r([123])", "parenthesis-mode", "{0}"),
    ("freq", r"\+r5", "replacement-mode", "original"),
    ("freq", r"\+r7", "prosody-mode", "keep"),
    (ALL, r"\+r6", "include-retracings", None),
    (ALL, r"\+re", "", None),
    ("freq", r"\+p(.+)", "word-delimiters", "{0}"),
    ("check", r"\+u", "check-ud", None),
    ("flucalc", r"\+u", "?", None),
    (ALL, r"\+u", "", None),
    ("cooccur", r"\+n(\d+)", "cluster-size", "{0}"),
    ("wdsize", r"\+w>(\d+)", "length-filter", "gt:{0}"),
    ("wdsize", r"\+w<(\d+)", "length-filter", "lt:{0}"),
    ("wdsize", r"\+w=(\d+)", "length-filter", "eq:{0}"),
    ("kwal combo", r"\+w(\d+)", "context-after", "{0}"),
    ("kwal combo", r"-w(\d+)", "context-before", "{0}"),
    (ALL, r"\+k", "case-sensitive", None),
    ("ipsyn dss", r"\+c(\d+)", "max-utterances", "{0}"),
    ("ipsyn dss", r"\+l(.+)", "rules", "{0}"),
    ("mortable", r"\+l(.+)", "script", "{0}"),
    ("check", r"\+c(\d+)", "bullets", "{0}"),
    ("freq vocd", r"\+c0?", "capitalization", "initial"),
    ("freq vocd", r"\+c1", "capitalization", "mid"),
    ("freq", r"\+c2", "per-pattern", None),
    ("freq", r"\+c3", "any-order", None),
    ("freq", r"\+c4", "sole", None),
    ("freq", r"\+c7", "matched-display", None),
    ("freq", r"\+o", "sort", "frequency"),
    ("freq", r"\+o1", "sort", "reverse-concordance"),
    ("freq mlu", r"\+o3", "combine-speakers", None),
    ("uniq", r"-o", "sort", "frequency"),
    ("fixbullets", r"\+o(\d+)", "offset", "{0}"),
    ("fixbullets", r"-o(\d+)", "offset", "-{0}"),
    ("chat2elan", r"\+e(.+)", "media-extension", "{0}"),
    ("check", r"\+e", "list-errors", None),
    ("check", r"\+e(\d+)", "error", "{0}"),
    ("check", r"-e(\d+)", "exclude-error", "{0}"),
    ("freq", r"\+d1", "word-list-only", None),
    ("freq", r"\+d4", "types-tokens-only", None),
    ("freq", r"\+d2", "spreadsheet", "wide"),
    ("freq", r"\+d3", "spreadsheet", "summary"),
    ("freq", r"\+d20", "spreadsheet", "flat"),
    ("freq", r"\+d5", "include-zero-frequency", None),
    ("freq", r"\+d(<=|>=|<|>|=)(\d+)", "speaker-percentage", "{0}{1}"),
    ("freqpos", r"\+d", "second-position", None),
    ("cooccur", r"\+d", "no-counts", None),
    ("kwal", r"\+d", "legal-chat", None),
)
ALIASES = {"gemfreq": "freq"}


def rewritten(arguments: list[str]) -> list[str]:
    """Arguments of a command, its name first, with old flags as --options. What comes behind -- stays."""
    if not arguments:
        return []
    command = arguments[0]
    if command == "chat2srt" and "+v" in arguments:
        command, arguments = "chat2vtt", [command, *(a for a in arguments[1:] if a != "+v")]
    out, own, plain = [command], ALIASES.get(command, command), False
    for arg in arguments[1:]:
        plain = plain or arg == "--"
        if plain or arg[:1] not in ("+", "-") or arg.startswith("--") or len(arg) < 2:
            out.append(arg)
            continue
        out += _one(own, arg)
    return out


def _one(command: str, arg: str) -> list[str]:
    for commands, pattern, option, value in RULES:
        if commands and command not in commands.split():
            continue
        if m := re.fullmatch(pattern, arg):
            if option == "?":
                return [arg]
            if not option:
                return []
            return [f"--{option}"] if value is None else [f"--{option}", value.format(*m.groups())]
    return [arg]
