"""Transcript files: text to headers, @ID rows and turns, and back.

A file is read whole and parsed once, where it lies: scan() gives a row for each of its lines of interest, of all kinds
or of those asked for. Main tiers are read by a pushdown automaton: groups nest, and a mark in square brackets
belongs to the word or group before it. Written by kind (store()), a scan is read again without parsing,
and a query of headers doesn't touch the turns. What can't be parsed gives rows of the kind problem.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.functions.words import countable
from parlance.model import WORD
from parlance.storage import exists

# Linkers, terminators (longest first), and what marks a word as not understood.
LINKERS = ('+"', "+^", "+<", "+,", "++", "+≈", "+≋")
TERMINATORS = ('+"/.', '+".', "+//.", "+//?", "+/.", "+/?", "+...", "+..?", "+!?", "+.", "≈", "≋", ".", "?", "!")
UNTRANSCRIBED = {"xxx": "unintelligible", "xx": "unintelligible", "yyy": "phonetic", "www": "untranscribed"}
#: Marks of what was said again, and what each is.
RETRACES = {"[/]": "partial", "[//]": "full", "[///]": "multiple", "[/-]": "reformulation", "[/?]": "uncertain"}
_CATEGORIES = (("&-", "filler"), ("&+", "fragment"), ("&~", "nonword"), ("0", "omission"))
_TOKEN = re.compile(r"\x15(\d+)_(\d+)\x15|(\[[^\]]*\])|(<)|(>)|([“”])|((?:\+\S*)?[^\s<>\[\]“”\x15]+)")
#: The same, with what lies between marks in one piece: for tiers without +, where every token ends at white space or such a mark.
_PIECE = re.compile(r"\x15(\d+)_(\d+)\x15|(\[[^\]]*\])|(<)|(>)|([“”])|([^<>\[\]“”\x15]+)")
#: Characters that mean something in a main tier, and what stands for each in a word that has it: private ones, from U+E001 on.
SPECIAL = "<>[]()@:^~+&“”ˈˌ⌈⌉⌊⌋↑↓→↗↘°∆∇\x15"
PRIVATE = "".join(chr(0xE001 + k) for k in range(len(SPECIAL)))
#: Stands before a word that would be read as a mark as a whole.
PLAIN = "\ue000"
_ID_FIELDS = ("language", "corpus", "speaker", "age", "sex", "grp", "ses", "role", "education", "custom")


_SILENT = str.maketrans("", "", "⌈⌉⌊⌋↑↓→↗↘°∆∇")
_NO_WORD = re.compile(r"\([.\d:]+\)|&[=*{}].*|[,;:„‡]|\+.*|0")
_LETTER = re.compile(r"[^\W_]")
_CLEANED = re.compile(r"@.*$|[:^~ˈˌ()]")
_ENDS, _LINKS = frozenset(TERMINATORS), frozenset(LINKERS)


@lru_cache(1 << 16)
def _word(raw: str) -> dict | None:
    """A word, or None for pauses, events, separators and other marks. The same for each place it stands at: what is marked there gets a copy."""
    if raw.isalnum() and raw[0] != "0" and "\u02c8" not in raw and "\u02cc" not in raw:  # stress marks count as letters
        return _fields_of(raw, raw, None)
    bare = raw.translate(_SILENT)
    if not bare or _NO_WORD.fullmatch(bare) or not _LETTER.search(bare):
        return None
    category, rest = None, bare
    for mark, name in _CATEGORIES:
        if bare.startswith(mark) and len(bare) > len(mark):
            category, rest = name, bare[len(mark) :]
            break
    return _fields_of(raw, _CLEANED.sub("", rest), category)


def _fields_of(raw: str, cleaned: str, category: str | None) -> dict:
    return {"raw": raw, "cleaned": cleaned, "category": category, "untranscribed": UNTRANSCRIBED.get(cleaned.lower()), "in_retrace": False, "retrace_kind": None, "replaced": False, "replacement": False, "n_err": 0}


class MainTier:
    """A main tier read token by token; what is open stands on a stack."""

    def __init__(self, text: str) -> None:
        self.words: list[dict] = []
        self.linkers: list[str] = []
        self.postcodes: list[str] = []
        self.terminator: str | None = None
        self.times: tuple[int, int] | None = None
        self.problems: list[str] = []
        self._open: list[int] = []  # where the words of each open group begin
        self._last: tuple[int, int] | None = None  # words of the unit that a mark belongs to
        for m in (_TOKEN if "+" in text else _PIECE).finditer(text):
            what = m.lastindex
            if what == 7:
                self._tokens(m[7].split())
            elif what == 3:
                self._mark(m[3])
            elif what == 4:
                self._open.append(len(self.words))
            elif what == 5:
                if self._open:
                    self._last = self._open.pop(), len(self.words)
                else:
                    self.problems.append("> without <")
            elif what == 2:
                self.times = int(m[1]), int(m[2])
        if self._open:
            self.problems.append("< without >")

    def _tokens(self, tokens: list[str]) -> None:
        words, before = self.words, len(self.words)
        for token in tokens:
            if token in _ENDS:
                self.terminator = token
            elif token in _LINKS and not words:
                self.linkers.append(token)
            elif word := _word(token):
                words.append(word)
        if len(words) > before:
            self._last = len(words) - 1, len(words)

    def _mark(self, mark: str) -> None:
        if mark.startswith("[+ "):
            self.postcodes.append(mark[3:-1].strip())
            return
        kind = RETRACES.get(mark)
        if not (kind or mark.startswith(("[:", "[*"))):
            return
        if self._last is None:
            self.problems.append(f"{mark} without a word before it")
            return
        first, end = self._last
        if kind:
            self.words[first:end] = [w | {"in_retrace": True, "retrace_kind": w["retrace_kind"] or kind} for w in self.words[first:end]]
        elif mark.startswith("[*"):
            self.words[first : min(end, first + 1)] = [w | {"n_err": w["n_err"] + 1} for w in self.words[first : min(end, first + 1)]]
        else:
            self.words[first:end] = [w | {"replaced": True} for w in self.words[first:end]]
            self.words += [w | {"replacement": True} for w in map(_word, mark.lstrip("[: ").rstrip("]").split()) if w]
            self._last = first, len(self.words)

    def fields(self) -> dict:
        start, end = self.times or (None, None)
        return {"linkers": self.linkers, "postcodes": self.postcodes, "terminator": self.terminator, "start_ms": start, "end_ms": end, "words": self.words}


def parse_main(text: str) -> dict:
    """Words, linkers, terminator, postcodes and times of a main tier."""
    return MainTier(text).fields()


def parse_mor(text: str) -> list[dict]:
    """Items of a mor tier; ~ parts clitics, - features. Punctuation is no item."""

    def morph(x: str) -> dict | None:
        pos, bar, rest = x.partition("|")
        lemma, *features = rest.split("-")
        return {"pos": pos, "lemma": lemma, "features": features} if bar else None

    out = []
    for item in text.split():
        parts = [p for p in map(morph, item.split("~")) if p]
        if parts:
            out.append({"main": parts[0], "post_clitics": parts[1:]})
    return out


def parse_gra(text: str) -> list[dict]:
    found = (x.split("|") for x in text.split())
    return [{"idx": int(a[0]), "head": int(a[1]), "relation": a[2]} for a in found if len(a) == 3 and a[0].isdigit() and a[1].isdigit()]


def _codes(text: str) -> list[str]:
    return [x for x in text.split() if x != "." and not re.fullmatch(r"<.*>", x)]


def unfolded(text: str) -> str:
    """text with lines that go on after a tab joined."""
    return re.sub(r"\n+\t", " ", text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))


KINDS = ("header", "id", "turn", "line", "problem")
#: Tiers with a reader; turns have a column for each.
READERS = {"mor": parse_mor, "gra": parse_gra, "cod": _codes, "pho": str.split, "mod": str.split}
_OLD_LABELS = {"trn": "mor", "grt": "gra"}


def parse_lines(text: str, kinds: Iterable[str] = KINDS, main_tiers: bool = True) -> Iterator[tuple[int, str, dict]]:
    """(line number, kind, fields) of a file's text.

    header, id and turn; line: every line as it is, with the kind of thing it is (@, *, % or ?), for checks; problem: what
    can't be read. Numbers are those of lines after unfolding. A turn comes after its tiers, which it has. main_tiers: whether
    turns have what is read from their main tiers.
    """
    kinds = set(kinds)
    if not text.strip():
        if "problem" in kinds:
            yield 0, "problem", {"value": "empty"}
        return
    gems: list[str] = []
    turn: dict | None = None
    at, n_turns = 0, 0
    for n, line in enumerate(unfolded(text).split("\n"), 1):
        head, colon, value = line.partition(":")
        value = value.strip()
        sign = line[:1] if line[:1] in ("@", "*", "%") else "?"
        if "line" in kinds and line.strip():
            yield n, "line", {"sign": sign, "label": head[1:].strip() if sign != "?" else "", "value": value, "raw": line, "colon": bool(colon), "utt_idx": n_turns + (sign == "*")}
        if sign != "%" and turn is not None:
            yield at, "turn", turn
            turn = None
        if sign == "@":
            label, participant = head[1:].strip(), None
            if label.startswith("Birth of "):
                label, participant = "Birth", label[9:].strip()
            if label == "Participants" and "header" in kinds:
                for code in filter(None, map(str.split, value.split(","))):
                    yield n, "header", {"kind": "Participant", "participant": code[0], "value": " ".join(code[1:])}
            if label == "ID" and "id" in kinds:
                fields = (value.split("|") + [""] * 10)[:10]
                yield n, "id", dict(zip(_ID_FIELDS, fields, strict=True)) | {"id_raw": value}
            if label == "Bg":  # an @G is a mark only: nothing ends it
                gems.append(value)
            elif label == "Eg" and value.lower() in [g.lower() for g in gems]:
                del gems[len(gems) - 1 - [g.lower() for g in reversed(gems)].index(value.lower())]
            if "header" in kinds:
                yield n, "header", {"kind": label, "participant": participant, "value": value}
        elif sign == "*":
            n_turns, at = n_turns + 1, n
            if kinds & {"turn", "problem"}:
                main = MainTier(value) if main_tiers or "problem" in kinds else None
                if "problem" in kinds:
                    for problem in main.problems:
                        yield n, "problem", {"value": problem}
                if "turn" in kinds:
                    turn = {"utt_idx": n_turns, "speaker": head[1:].strip(), "text": value, "active_gems": list(gems), "tiers": []} | (main.fields() if main else {})
        elif sign == "%" and turn is not None:
            label = _OLD_LABELS.get(head[1:].strip(), head[1:].strip())
            turn["tiers"].append({"label": label, "content": value})
            if label in READERS and turn.get(label) is None:
                turn[label] = READERS[label](value)
    if turn is not None:
        yield at, "turn", turn


_MORPH = "struct<pos:string,lemma:string,features:array<string>>"
_FIELDS = {
    "header": "kind:string,participant:string,value:string",
    "id": ",".join(f"{f}:string" for f in _ID_FIELDS) + ",id_raw:string",
    "turn": f"""utt_idx:bigint,speaker:string,text:string,active_gems:array<string>,tiers:array<struct<label:string,content:string>>,
    mor:array<struct<main:{_MORPH},post_clitics:array<{_MORPH}>>>,gra:array<struct<idx:int,head:int,relation:string>>,cod:array<string>,pho:array<string>,mod:array<string>,
    linkers:array<string>,postcodes:array<string>,terminator:string,start_ms:bigint,end_ms:bigint,words:array<{WORD}>""",
    "line": "sign:string,label:string,value:string,raw:string,colon:boolean,utt_idx:bigint",
    "problem": "value:string",
}
#: Fields of a turn that its main tier is read for.
_OF_MAIN = frozenset(parse_main(""))
#: Rows that go to the JVM at a time.
ROWS = 2000


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """values (dicts, lists of dicts, or plain ones) field by field: many times as fast as dict by dict."""
    if pa.types.is_struct(kind):
        fields = [_column([v and v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        ends = list(accumulate(map(len, (v or () for v in values)), initial=0))
        inner = list(chain.from_iterable(filter(None, values)))
        once = {id(x): x for x in inner}  # words that aren't marked are one object wherever they stand
        at = dict(zip(once, range(len(once)), strict=True))
        inner = _column(list(once.values()), kind.value_type).take(pa.array(map(at.__getitem__, map(id, inner)), pa.int32(), size=len(inner)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.array(values, kind)


def _rows_of(held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in held], f.type) for f in schema], schema=schema)


def _asked_for(turn: T.StructType, only: set[str]) -> T.StructType:
    """The fields of a turn, and of its words, that are asked for."""
    words = T.StructType([f for f in turn["words"].dataType.elementType if "words" in only or f"words.{f.name}" in only])
    rest = [f for f in turn if f.name in only and f.name != "words"]
    return T.StructType(rest + ([T.StructField("words", T.ArrayType(words))] if words.fields else []))


def scan(files: DataFrame, kinds: Iterable[str] = KINDS, only: Iterable[str] | None = None) -> DataFrame:
    """Rows (file, line_no, kind, and a struct for each of kinds, null but for the row's own) of files (file, text).

    Only what kinds need is parsed: headers cost no reading of words. A file is one row, so it must fit in a task; files
    are as many tasks as the table of files has partitions. A file that fails gives one row of the kind problem.
    only: fields of turns, with those of words as words.cleaned (all if not given); no others are made, and main tiers are
    read only for fields of theirs.
    """
    kinds = [k for k in KINDS if k in set(kinds)]
    schema = T._parse_datatype_string("file string, line_no int, kind string, " + ", ".join(f"`{k}` struct<{_FIELDS[k]}>" for k in kinds))
    main_tiers = True
    if only is not None and "turn" in kinds:
        turn = _asked_for(schema["turn"].dataType, set(only))
        schema = T.StructType([T.StructField("turn", turn) if f.name == "turn" else f for f in schema])
        main_tiers = not _OF_MAIN.isdisjoint(turn.names)
    arrow = to_arrow_schema(schema)

    def of(file: str | None, text: str | None) -> list[dict]:
        try:
            return [{"file": file, "line_no": n, "kind": kind, kind: row} for n, kind, row in parse_lines(text or "", kinds, main_tiers)]
        except (ValueError, IndexError, KeyError) as problem:
            return [{"file": file, "line_no": 0, "kind": "problem", "problem": {"value": repr(problem)}}] if "problem" in kinds else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += of(file, text)
                while len(held) >= ROWS:
                    yield _rows_of(held[:ROWS], arrow)
                    del held[:ROWS]
            yield _rows_of(held, arrow)

    return files.select("file", "text").mapInArrow(rows, schema)


def store(files: DataFrame, path: str, kinds: Iterable[str] = KINDS, only: Iterable[str] | None = None) -> None:
    """A scan() as Parquet, by kind: files are parsed once, and a query reads the kinds it needs."""
    scan(files, kinds, only).write.partitionBy("kind").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _rows(files: DataFrame, kind: str, only: Iterable[str] | None = None) -> DataFrame:
    """Rows of a kind, of a table of files or of a scan of them."""
    lines = files if "line_no" in files.columns else scan(files, [kind], only)
    return lines.where(F.col("kind") == kind).select("file", "line_no", f"{kind}.*")


def _read(spark: SparkSession, paths: str | list[str], only: str | None, **more) -> DataFrame:
    found = spark.read.text(paths, wholetext=True, **more)
    if only:  # of names alone, so other files aren't opened
        found = found.where(F.col("_metadata.file_name").rlike(only))
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _sorted_out(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """Paths that are there, and those that aren't; a leading + or - is an error, as it is meant for an option."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if bad := [p for p in paths if p[:1] in ("+", "-") and p != "-"]:
        raise ValueError(f"not a path: {bad[0]}")
    there = [p for p in paths if exists(spark, p)]
    return there, [p for p in paths if p not in there]


def discovered(spark: SparkSession, paths: str | list[str], pattern: str = "*.cha", only: str | None = None) -> DataFrame:
    """file, name, bytes, status and reason of all there is under paths: read, or skipped because it is missing, named otherwise or not asked for.

    Nothing is opened; only: a regular expression that names of files must hold.
    """
    there, missing = _sorted_out(spark, paths)
    out = spark.createDataFrame([(p, p.rstrip("/").rpartition("/")[2], None, "skipped", "missing") for p in missing], "file string, name string, bytes long, status string, reason string")
    if there:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"))
        named = F.lit(True) if not pattern else F.col("name").rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$")
        reason = F.when(~named, "name").when(~F.col("name").rlike(only) if only else F.lit(False), "not asked for")
        out = out.unionByName(files.select("*", F.when(reason.isNull(), "read").otherwise("skipped").alias("status"), reason.alias("reason")))
    return out


def read_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.cha", only: str | None = None) -> DataFrame:
    """file and text of transcript files: folders are gone through for what fits pattern, files that are named themselves may have any name.

    Missing paths are passed over; discovered() lists them. only: a regular expression for names of files.
    """
    there, _ = _sorted_out(spark, paths)
    out = spark.createDataFrame([], "file string, text string")
    folders: list[str] = []
    for path in there:
        try:
            spark.read.text(f"{path.rstrip('/')}/*")
            folders.append(path)
        except AnalysisException:  # a file has nothing under it
            out = out.unionByName(_read(spark, path, only))
    return out.unionByName(_read(spark, folders, only, recursiveFileLookup=True, pathGlobFilter=pattern)) if folders else out


def protected(word: Column) -> Column:
    """A word (with a letter or digit) so that a main tier with it is read back as that very word: characters with a meaning by private ones."""
    whole = F.lower(word).isin(*UNTRANSCRIBED) | word.startswith("0")
    return F.concat(F.when(whole, F.lit(PLAIN)).otherwise(F.lit("")), F.translate(word, SPECIAL, PRIVATE))


def unprotected(words: Column | str) -> Column:
    """Words as they were before protected()."""
    return F.transform(words, lambda w: F.translate(w, PRIVATE + PLAIN, SPECIAL))


#: Fields of words that counting and understanding them take.
_COUNTING = tuple(f"words.{f}" for f in ("cleaned", "category", "untranscribed", "in_retrace", "replaced", "replacement"))


def turns(files: DataFrame, retraced: bool = False, originals: bool = False, restored: tuple[str, ...] = (), only: Iterable[str] | None = None) -> DataFrame:
    """Turns of files or of a scan, with their counted words (cw), whether words weren't understood (unclear), and their errors (n_err).

    only: fields that are read besides, as in scan(); n_err is there if it is among those of words. Of a scan that lacks words there are the turns alone.
    """
    rows = _rows(files, "turn", only if only is None else {*only, *_COUNTING})
    if "words" not in rows.columns:
        return rows
    more = {"cw": countable("words", retraced, originals, restored), "unclear": F.exists("words", lambda w: w["untranscribed"].isin("unintelligible", "phonetic"))}
    if "n_err" in rows.schema["words"].dataType.elementType.names:
        more["n_err"] = F.aggregate("words", F.lit(0), lambda a, w: a + w["n_err"])
    return rows.withColumns(more)


def headers(files: DataFrame) -> DataFrame:
    return _rows(files, "header")


def ids(files: DataFrame) -> DataFrame:
    return _rows(files, "id")


def lines(files: DataFrame) -> DataFrame:
    return _rows(files, "line")


def problems(files: DataFrame) -> DataFrame:
    """file, line_no and problem of what can't be read."""
    return _rows(files, "problem").withColumnRenamed("value", "problem")


def normalised(text: str) -> str:
    """A file's text as it would be written after reading: lines unfolded, one tab behind labels, single blanks."""
    out = []
    for line in filter(str.strip, unfolded(text).split("\n")):
        head, colon, value = line.partition(":")
        labelled = colon and re.fullmatch(r"[@*%][\w ]+", head)
        out.append(f"{head}:\t{' '.join(value.split())}" if labelled else " ".join(line.split()))
    return "\n".join(out) + "\n"


def fixed(files: DataFrame) -> DataFrame:
    """normalised() of each file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([normalised(x or "") for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["file", "text"])

    return files.select("file", "text").mapInArrow(rows, "file string, text string")
