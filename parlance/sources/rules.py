"""Files of words, rules and norms that commands take. They are small and read on the driver; norms are a table."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from parlance.functions.times import age_in_months
from parlance.model import NORMS


def _lines(text: str) -> list[str]:
    return text.lstrip("﻿").replace("\r\n", "\n").split("\n")


def word_list(text: str) -> list[str]:
    """One pattern a line; comments (# or ;%* and a blank) and empty lines are left out."""
    return [x.rstrip(" \t") for x in _lines(text) if x.strip() and not x.startswith(("# ", ";%* "))]


def sentence_rules(text: str) -> list[tuple[str, tuple[str, ...], int]]:
    """Categories and points on a line, then their patterns; # begins a comment."""
    out: list[tuple[str, list[str], int]] = []
    for line in _lines(text):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if m := re.fullmatch(r"(\S+)\s+(\d+)", line):
            out.append((m[1], [], int(m[2])))
        elif out:
            out[-1][1].append(line)
    return [(n, tuple(p), k) for n, p, k in out]


def syntax_rules(text: str):
    """name, patterns wanted and patterns not wanted between tabs; with three fields there are none of the latter."""
    from parlance.operators.profiles import Syntax

    out = []
    for line in _lines(text):
        f = line.split("\t")
        if len(f) >= 3 and not line.startswith("#"):
            parts = lambda x: tuple(p.strip() for p in re.split(r"[+,]", x) if p.strip())
            out.append(Syntax(f[0].strip(), parts(f[1]), parts(f[2]) if len(f) > 3 else ()))
    return out


def morpheme_rules(text: str) -> list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]:
    """Lines OR and AND set the mode; "label" +pattern -pattern make a rule."""
    mode, out = "AND", []
    for line in map(str.strip, _lines(text)):
        if line in ("OR", "AND"):
            mode = line
        elif m := re.match(r'"([^"]*)"\s*(.*)$', line):
            tokens = m[2].split()
            out.append((mode, m[1], tuple(t[1:] for t in tokens if t[0] == "+"), tuple(t[1:] for t in tokens if t[0] == "-")))
    return out


def string_changes(text: str) -> list[tuple[str, str]]:
    """Lines by turns what is looked for and what takes its place."""
    lines = [x for x in _lines(text) if x]
    if len(lines) % 2:
        raise ValueError("a line to look for has none to take its place")
    return list(zip(lines[::2], lines[1::2], strict=True))


def dictionary(text: str) -> dict[str, str]:
    """word and spelling on a line; # and ; begin comments; the last line of a word counts."""
    pairs = (x.split(None, 1) for x in _lines(text) if x.strip() and x.lstrip()[0] not in "#;")
    return {p[0].lower(): p[1].strip() for p in pairs if len(p) == 2}


def lexicon(text: str) -> list[tuple[str, str, int]]:
    """(word in upper case, form, number) of lines of a word and its sounds; WORD(2) is another form of WORD."""
    out: list[tuple[str, str, int]] = []
    seen: dict[str, int] = {}
    for line in _lines(text):
        if line.startswith(";;;") or len(f := line.split(None, 1)) < 2:
            continue
        word = re.sub(r"\(\d+\)$", "", f[0]).upper()
        out.append((word, f[1].strip(), seen.setdefault(word, 0)))
        seen[word] += 1
    return out


def rewrite_rules(text: str) -> list[tuple[str, str]]:
    """from => to, or ==>."""
    found = (re.split(r"\s*==?>\s*", x.strip(), maxsplit=1) for x in _lines(text) if not x.startswith("#"))
    return [(f[0], f[1]) for f in found if len(f) == 2 and f[0]]


def expressions(text: str) -> list[str]:
    """Search expressions, one a line, read as a word list is."""
    return word_list(text)


def norm_name(path: str) -> dict[str, str] | None:
    """Language and kind of a norm database by its name: <lang>[_<kind>]_db.cut."""
    m = re.search(r"([a-z]+)(?:_(\w+?))?_db\.cut$", path)
    return {"language": m[1], "kind": m[2] or ""} if m else None


def norm_entries(text: str) -> list[dict]:
    """Entries of a norm database: =path, +@ID line, scores, - between them. Lines of gems (G...) are left out; entries without an id too."""
    out, now = [], {"path": None, "id": None, "scores": []}

    def done() -> None:
        if now["id"]:
            f = (now["id"].split("|") + [""] * 10)[:10]
            names = ("language", "corpus", "speaker_code", "age", "sex", "grp", "ses", "role", "education", "custom")
            out.append(dict(zip(names, f, strict=True)) | {"path": now["path"], "scores": now["scores"]})

    for line in _lines(text):
        if re.match(r"V\d", line) or line.startswith("G"):
            continue
        if line.startswith("="):
            if now["path"] is not None:
                done()
            now = {"path": line[1:].strip(), "id": None, "scores": []}
        elif line.startswith("+"):
            now["id"] = re.sub(r"^\+?@ID:?\s*|^\+", "", line).strip()
        elif line.strip() == "-":
            done()
            now = {"path": None, "id": None, "scores": []}
        else:
            try:
                now["scores"] = now["scores"] + [float(x) for x in line.split()]
            except ValueError:
                now["id"] = None
    done()
    return out


def norms(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """The table of norms of such databases; ages in months, ranges by their middle."""
    names = ["path", "language", "corpus", "speaker_code", "age", "sex", "grp", "ses", "role", "education", "custom", "scores"]
    rows = [tuple(e[n] for n in names) for t in texts for e in norm_entries(t)]
    schema = ", ".join(f"{n} {'array<double>' if n == 'scores' else 'string'}" for n in names)
    order = [f.strip().split(" ")[0] for f in NORMS.replace("array<double>", "x").split(",")]
    return spark.createDataFrame(rows, schema).withColumn("age_months", age_in_months("age")).select(*order)
