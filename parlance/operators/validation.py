"""Checks of whole transcripts by the usual checker's numbers: (file, line_no, number, detail, message).

What may follow what is a finite automaton over kinds of lines, given as a table. A stretch of lines is a
function from state to state, and functions compose: files are cut in stretches that are read anywhere, their functions
composed file by file, and each stretch is gone through once more from its own first state. Rules of
single lines are all tried in one pass; the others compare a line with the ones before, or what is declared with what is said.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import checks
from parlance.sources import chat

# The checker's numbers and what it says.
MESSAGES = {
    0: "Speaker is not used in this file.",
    1: "Expected characters are: @ or % or *.",
    2: "Missing ':' character and argument.",
    4: "Found a space character instead of TAB character after Tier name.",
    6: '"@Begin" is missing at the beginning of the file.',
    7: '"@End" is missing at the end of the file.',
    12: "Missing speaker name and/or role.",
    13: "Duplicate speaker declaration.",
    15: "Illegal role.",
    16: "Illegal use of extended characters in speaker names.",
    17: "Tier is not declared in depfile file.",
    18: "Speaker is not specified in a participants list.",
    21: "Utterance delimiter expected.",
    22: "Unmatched [ found on the tier.",
    23: "Unmatched ] found on the tier.",
    24: "Unmatched < found on the tier.",
    25: "Unmatched > found on the tier.",
    28: "Unmatched ( found on the tier.",
    34: "Illegal date representation.",
    36: "Utterance delimiter must be at the end of the utterance.",
    38: "Numbers should be written out in words.",
    39: "Code tier must NOT follow header tier.",
    40: "Duplicate code tiers per one main tier are NOT allowed.",
    44: 'The file must end with "@End" tier.',
    45: "There were more @Bg than @Eg tiers found.",
    46: "This @Eg does not have matching @Bg.",
    47: "Numbers are not allowed inside words.",
    48: "Illegal character(s) found.",
    50: "Redundant utterance delimiter.",
    52: "This item must be preceded by text.",
    53: 'Only one "@Begin" can be in a file.',
    60: '"@ID:" tier is missing in the file.',
    64: "Wrong gender information (Choose: female or male).",
    68: 'PARTICIPANTS TIER IS MISSING "CHI Target_Child".',
    69: "The UTF8 header is missing.",
    70: 'Expected either text or "0" on this tier.',
    82: "BEG mark of bullet must be smaller than END mark.",
    83: "Current BEG time is smaller than previous tier BEG time.",
    84: "Current BEG time is smaller than previous tier END time.",
    85: "Gap found between current BEG time and previous tier END time.",
    87: "Malformed structure.",
    89: "Missing or extra or wrong characters found in bullet.",
    94: "Mismatch of speaker and %mor: utterance delimiters.",
    103: 'Illegal use of both CA and IPA on "@Options:" tier.',
    108: "All postcodes must precede final bullet.",
    110: "No bullet found on this tier.",
    113: 'Illegal keyword, use "audio", "video" or look in depfile.cut.',
    117: "This character must be used in pairs.",
    121: "Language code not found in ISO-639 file.",
    122: "Language on @ID tier is not defined on @Languages: tier.",
    133: "BEG time is smaller than same speaker's previous END time.",
    134: 'Illegal item on %mor tier, run "mor".',
    135: "This item is illegal.",
    140: 'Tier "%MOR:" does not link in size to its speaker tier.',
    141: "[: ...] has to be preceded by only one word and nothing else.",
    142: "Speaker's role on @ID tier does not match role on @Participants: tier.",
    143: "The @ID line needs 10 fields.",
    144: "Either illegal SES field value or symbol is not declared in depfile.",
    153: "Age's month or day are missing initial zero.",
    155: 'Please use "0word" instead of "(word)".',
    156: "Please replace ,, with special character.",
    157: "Media file name has to match datafile name.",
    158: "[: ...] has to have real word, not 0... or &... or xxx.",
    161: "Space character is missing before [ code.",
}
# Roles, headers and tiers of the transcript format.
ROLES = """Target_Child Target_Adult Child Mother Father Brother Sister Sibling Grandmother Grandfather Aunt Uncle Cousin Relative Family_Friend Student Teacher
Playmate Visitor Babysitter Caretaker Housekeeper Investigator Observer Clinician Therapist Interviewer Informant Participant Subject Partner Doctor Nurse
Patient Client Host Guest Boy Girl Man Woman Adult Teenager Male Female Leader Member Narrator Speaker Audience Group Environment Camera_Operator Friend
Justice Attorney Text Media Non_Human Unidentified Uncertain OffScript""".split()
HEADERS = [x.strip() for x in """UTF8, Begin, End, Languages, Participants, ID, Options, Media, Date, Comment, Bg, Eg, G, Location, Situation, Activities, Room Layout,
Recording Quality, Number, Transcriber, Transcription, Time Duration, Time Start, Tape Location, Types, Warning, Videos, T, Blank, New Episode, Page, PID, Font,
Window, Color words, Bck, Exceptions, Interaction Type""".split(",")]
TIERS = "mor gra trn grt cod pho mod act add alt cnl coh com def eng err exp fac flo gls gpx int lan modsyl ort orth par phoaln phosyl sit spa syn tim wor".split()
OF_A_SPEAKER = ("Birth of ", "Birthplace of ", "L1 of ")
#: Headers that may stand before @Begin.
FIRST = ("PID", "Font", "Window", "Color words")
#: Headers that have nothing to say behind a colon.
BARE = ("UTF8", "Begin", "End", "Bg", "Eg", "G", "Blank", "New Episode")
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"

# The automaton. Kinds of lines:
UTF8, BEGIN, END, EARLY, HEADER, TURN, TIER, OTHER = range(8)
START, MARKED, HEAD, BODY, BREAK, ENDED = range(6)
#: state: for each kind of line the next state and the numbers of what is wrong with it. MARKED: after @UTF8; BREAK: after a header between turns.
TABLE: dict[int, list[tuple[int, tuple[int, ...]]]] = {
    START: [(MARKED, ()), (HEAD, (69,)), (ENDED, (69, 6)), (MARKED, (69,)), (HEAD, (69, 6)), (BODY, (69, 6)), (HEAD, (69, 6, 39)), (MARKED, (69, 1))],
    MARKED: [(MARKED, ()), (HEAD, ()), (ENDED, (6,)), (MARKED, ()), (HEAD, (6,)), (BODY, (6,)), (HEAD, (6, 39)), (MARKED, (1,))],
    HEAD: [(HEAD, ()), (HEAD, (53,)), (ENDED, ()), (HEAD, ()), (HEAD, ()), (BODY, ()), (HEAD, (39,)), (HEAD, (1,))],
    BODY: [(BREAK, ()), (BREAK, (53,)), (ENDED, ()), (BREAK, ()), (BREAK, ()), (BODY, ()), (BODY, ()), (BODY, (1,))],
    BREAK: [(BREAK, ()), (BREAK, (53,)), (ENDED, ()), (BREAK, ()), (BREAK, ()), (BODY, ()), (BREAK, (39,)), (BREAK, (1,))],
    ENDED: [(ENDED, (44,))] * 8,
}
#: Lines of a stretch.
STRETCH = 10_000


def line_kind() -> Column:
    """Of a row of chat.lines(): what the automaton reads."""
    header = F.when(F.col("label") == "UTF8", UTF8).when(F.col("label") == "Begin", BEGIN).when(F.col("label") == "End", END).when(F.col("label").isin(*FIRST), EARLY).otherwise(HEADER)
    return F.when(F.col("sign") == "@", header).when(F.col("sign") == "*", TURN).when(F.col("sign") == "%", TIER).otherwise(OTHER)


def _stretches(rows: Iterator[tuple], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first columns."""
    key, held = None, []
    for row in rows:
        if row[:keys] != key:
            if held:
                yield key, held
            key, held = row[:keys], []
        held.append(row[keys:])
    if held:
        yield key, held


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def order_findings(lines: DataFrame) -> DataFrame:
    """file, line_no and number of what is wrong with the order of lines: chat.lines() (file, line_no, sign, label), however large a file.

    A file that doesn't get to its end has 7 at its last line. Lines without a file are one file of their own.
    """
    cut = lines.select("file", F.floor(F.col("line_no") / STRETCH).alias("stretch"), "line_no", line_kind().alias("kind"))
    functions, found = pa.schema([("file", pa.string()), ("stretch", pa.int64()), ("to", pa.list_(pa.int32())), ("last", pa.int32())]), pa.schema([("file", pa.string()), ("line_no", pa.int32()), ("number", pa.int32())])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _stretches(_tuples(batches), 2):
            to = list(TABLE)
            for _, kind in rows:
                to = [TABLE[s][kind][0] for s in to]
            yield _batch([(*key, to, rows[-1][0])], functions)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the functions of each file, in order: a row (kind -1 - state) before each stretch, and the file's last finding."""
        for (file,), rows in _stretches(_tuples(batches), 1):
            state, out = START, []
            for stretch, to, _ in rows:
                out.append((file, stretch, -1, -1 - state))
                state = to[state]
            if state != ENDED:
                out.append((file, rows[-1][0], rows[-1][2], -100))
            yield _batch(out, pa.schema([("file", pa.string()), ("stretch", pa.int64()), ("line_no", pa.int32()), ("kind", pa.int32())]))

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = START, []
        for file, _, line_no, kind in _tuples(batches):
            if kind == -100:
                out.append((file, line_no, 7))
            elif kind < 0:
                state = -1 - kind
            else:
                state, wrong = TABLE[state][kind]
                out += [(file, line_no, n) for n in wrong]
            if len(out) >= 10_000:
                yield _batch(out, found)
                out = []
        yield _batch(out, found)

    own = cut.repartition("file", "stretch").sortWithinPartitions("file", "stretch", "line_no").mapInArrow(composed, "file string, stretch long, to array<int>, last int")
    first = own.repartition("file").sortWithinPartitions("file", "stretch").mapInArrow(entered, "file string, stretch long, line_no int, kind int")
    return cut.unionByName(first).repartition("file", "stretch").sortWithinPartitions("file", "stretch", "line_no", "kind").mapInArrow(replayed, "file string, line_no int, number int")


def _tried(rows: DataFrame, rules: Iterable[tuple[int, Column]], detail: Column) -> DataFrame:
    """A row for each rule that holds: all are tried on a row at once."""
    numbers = F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in rules)))
    return rows.select("file", "line_no", F.explode(numbers).alias("number"), detail.alias("detail"))


def header_findings(lines: DataFrame) -> DataFrame:
    """What is wrong with single headers."""
    label, value, is_ = F.col("label"), F.col("value"), lambda x: F.col("label") == x
    entries = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    role = lambda x: F.element_at(F.split(x, r"\s+"), -1)
    parts = F.split(value, r"\|")
    field = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    whole_id = is_("ID") & (F.size(parts) == 11)
    known = label.isin(*HEADERS)
    for start in OF_A_SPEAKER:
        known = known | label.startswith(start)
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    media = F.transform(F.split(value, ","), lambda x: F.trim(x))
    rules = [
        (2, known & ~label.isin(*BARE) & ~F.col("colon")),
        (4, F.col("raw").rlike(r"^@[^:\t]*: ")),
        (12, is_("Participants") & ((F.size(entries) == 0) | F.exists(entries, lambda x: F.size(F.split(x, r"\s+")) < 2))),
        (15, is_("Participants") & F.exists(entries, lambda x: (F.size(F.split(x, r"\s+")) > 1) & ~role(x).isin(*ROLES))),
        (17, ~known),
        (34, (is_("Date") | label.startswith("Birth of ")) & ~value.rlike(rf"^\d\d-({MONTHS})-\d{{4}}$")),
        (64, whole_id & ~field(4).isin("", "male", "female")),
        (103, is_("Options") & (value == "")),
        (113, is_("Media") & ~F.coalesce(F.get(media, F.lit(1)), F.lit("")).isin("audio", "video")),
        (121, is_("Languages") & F.exists(F.split(value, r",\s*"), lambda x: ~x.rlike("^[a-z]{3}$"))),
        (143, is_("ID") & (F.size(parts) != 11)),
        (144, whole_id & ~field(6).rlike("^((White|Black|Latino|Asian|Pacific|Native|Multiple|Unknown)?,?(UC|MC|WC|LI)?)$")),
        (153, whole_id & ~field(3).rlike(r"^(\d+;(\d\d\.(\d\d)?)?)?$")),
        (157, is_("Media") & (F.lower(F.get(media, F.lit(0))) != F.lower(stem))),
    ]
    out = _tried(lines.where("sign = '@'"), rules, F.col("raw"))
    order = Window.partitionBy("file", F.lower("value")).orderBy("line_no")
    gems = lines.where("sign = '@' and label in ('Bg', 'Eg')").withColumn("step", F.when(F.col("label") == "Bg", 1).otherwise(-1))
    # How many are open, where an @Eg that closes nothing doesn't count: the sum, less what it fell below zero.
    gems = gems.withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.least(F.lit(0), F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0))
    gems = gems.withColumns({"now": low, "before": before})
    closing = gems.where("step = -1 and now < before").select("file", "line_no", F.lit(46).alias("number"), F.col("raw").alias("detail"))
    left = gems.groupBy("file", F.lower("value").alias("gem")).agg(F.max_by(F.col("sum") - F.col("now"), "line_no").alias("open"), F.max(F.when(F.col("step") == 1, F.col("line_no"))).alias("line_no"), F.max_by("raw", F.when(F.col("step") == 1, F.col("line_no"))).alias("detail"))
    return out.unionByName(closing).unionByName(left.where("open > 0").select("file", "line_no", F.lit(45).alias("number"), "detail"))


def speaker_findings(lines: DataFrame, target: bool = False, ids: bool = True, unused: bool = False) -> DataFrame:
    """What is declared against what is said: speakers, roles, languages. A file's speakers are a handful; turns are summed up before they are joined."""
    entry = lines.where("sign = '@' and label = 'Participants'").select("file", "line_no", F.posexplode(F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("k", "entry"))
    words = F.split("entry", r"\s+")
    declared = entry.select("file", "line_no", "k", words[0].alias("speaker"), F.element_at(words, -1).alias("role"))
    parts = F.split("value", r"\|")
    given = lines.where("sign = '@' and label = 'ID'").where(F.size(parts) == 11).select("file", "line_no", parts[0].alias("language"), parts[2].alias("speaker"), parts[7].alias("role"))
    said = lines.where("sign = '*'").groupBy("file", F.col("label").alias("speaker")).agg(F.min("line_no").alias("line_no"))
    of = lambda df, number, detail="speaker": df.select("file", "line_no", F.lit(number).alias("number"), F.col(detail).alias("detail"))
    people = declared.groupBy("file", "speaker").agg(F.min("line_no").alias("at"), F.min_by("role", "k").alias("role"))
    key = ["file", "speaker"]
    out = of(said.join(people.select(*key), key, "left_anti"), 18)
    out = out.unionByName(of(said.where(F.col("speaker").rlike(r"[^\x00-\x7F]")), 16))
    for table, order in ((declared, "k"), (given, "line_no")):
        again = table.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("line_no", order))).where("n > 1")
        out = out.unionByName(of(again, 13))
    both = given.join(people.select(*key, F.col("role").alias("own")), key)
    out = out.unionByName(of(both.where("role <> own"), 142))
    languages = lines.where("sign = '@' and label = 'Languages'").groupBy("file").agg(F.flatten(F.collect_list(F.split("value", r",\s*"))).alias("known"))
    out = out.unionByName(of(given.join(languages, "file").where("not array_contains(known, language) and language <> ''"), 122))
    if ids:
        out = out.unionByName(of(people.join(given.select(*key), key, "left_anti").withColumnRenamed("at", "line_no"), 60))
    if unused:
        out = out.unionByName(of(people.join(said.select(*key), key, "left_anti").withColumnRenamed("at", "line_no"), 0))
    if target:
        child = people.where("speaker = 'CHI' and role = 'Target_Child'").select("file")
        excused = lines.where("sign = '@' and label = 'Options'").where(F.exists(F.split("value", r",\s*"), lambda x: x == "notarget")).select("file")
        files = lines.select("file").distinct().join(child.unionByName(excused).distinct(), "file", "left_anti")
        out = out.unionByName(files.select("file", F.lit(0).alias("line_no"), F.lit(68).alias("number"), F.lit("CHI Target_Child").alias("detail")))
    return out


#: What MainTier says, and its number.
_PROBLEMS = {"< without >": 24, "> without <": 25}


def turn_findings(lines: DataFrame, problems: DataFrame) -> DataFrame:
    """What is wrong with single main tiers: delimiters, brackets, words."""
    value = F.col("value")
    silent = F.regexp_replace(value, "\x15[^\x15]*\x15", " ")
    brackets = F.regexp_replace(silent, r"\[[^\[\]]*\]", " ")
    tokens = F.filter(F.split(F.regexp_replace(brackets, "[<>]", " "), r"\s+"), lambda x: x != "")
    ends = F.size(F.filter(tokens, lambda x: x.isin(*chat.TERMINATORS)))
    word = lambda test: F.exists(tokens, lambda x: ~x.rlike(r"^[&+]") & ~x.isin(*chat.TERMINATORS) & test(F.regexp_replace(x, "@.*$", "")))
    count = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    rules = [
        (2, ~F.col("colon")),
        (4, F.col("raw").rlike(r"^\*[^:\t]*: ")),
        (21, (ends == 0) & (F.size(tokens) > 0)),
        (22, brackets.contains("[")),
        (23, brackets.contains("]")),
        (28, count(brackets, "(") != count(brackets, ")")),
        (36, (ends == 1) & ~F.element_at(tokens, -1).isin(*chat.TERMINATORS)),
        (38, word(lambda x: x.rlike(r"^\d+$") & (x != "0"))),
        (47, word(lambda x: (x.rlike(r"^\d+$") & (x != "0")) | x.rlike(r"\p{L}\d|[1-9]\p{L}"))),
        (48, word(lambda x: x.rlike(r"[#$*=\\{}|\"\x00-\x08\x0b-\x14\x16-\x1f]"))),
        (50, ends > 1),
        (70, F.size(F.filter(tokens, lambda x: ~x.isin(*chat.TERMINATORS, *chat.LINKERS))) == 0),
        (108, value.rlike("\x15\\d+_\\d+\x15.*\\[\\+ ")),
        (117, count(value, "“") != count(value, "”")),
        (135, word(lambda x: F.lower(x).rlike(r"^(xx|yy|ww|x{4,}|y{4,}|w{4,})$"))),
        (141, value.rlike(r">\s*\[::? ")),
        (155, word(lambda x: x.rlike(r"^\(\p{L}+\)$"))),
        (156, value.rlike(r",\s*,")),
        (158, value.rlike(r"\[::? (0|&|xxx|yyy|www)")),
        (161, silent.rlike(r"[^\s\[<]\[")),
    ]
    out = _tried(lines.where("sign = '*'"), rules, F.col("raw"))
    of = F.lit(None).cast("int")
    for text, number in _PROBLEMS.items():
        of = F.when(F.col("problem") == text, F.lit(number)).otherwise(of)
    number = F.when(F.col("problem").endswith("without a word before it"), F.lit(52)).otherwise(of)
    return out.unionByName(problems.select("file", "line_no", number.alias("number"), F.col("problem").alias("detail")).where("number is not null"))


def tier_findings(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """What is wrong with dependent tiers, and between them and their turns."""
    tiers = lines.where("sign = '%'")
    out = _tried(tiers, [(2, ~F.col("colon")), (4, F.col("raw").rlike(r"^%[^:\t]*: ")), (17, ~F.col("label").isin(*TIERS) & ~F.col("label").startswith("x"))], F.col("raw"))
    again = tiers.where("utt_idx > 0").withColumn("n", F.row_number().over(Window.partitionBy("file", "utt_idx", "label").orderBy("line_no")))
    out = out.unionByName(again.where("n > 1").select("file", "line_no", F.lit(40).alias("number"), F.col("raw").alias("detail")))
    mor = F.get(F.filter("tiers", lambda t: t["label"].isin("mor", "trn")), F.lit(0))["content"]
    tokens = F.split(F.trim(mor), r"\s+")
    n = F.size("gra")
    rules = [
        (87, F.col("gra").isNotNull() & F.exists("gra", lambda g: (g["head"] > n) | (g["idx"] > n))),
        (94, mor.isNotNull() & (F.element_at(tokens, -1) != F.coalesce("terminator", F.lit("")))),
        (134, mor.isNotNull() & F.exists(tokens, lambda x: ~x.contains("|") & ~x.isin(*chat.TERMINATORS, ",", "„", "‡"))),
        (140, F.col("mor").isNotNull() & (F.size("mor") != F.size("cw"))),
    ]
    return out.unionByName(_tried(turns, rules, mor))


def bullet_findings(lines: DataFrame, bullets: int | None = None) -> DataFrame:
    """What is wrong with times. bullets: 0, also against the tiers before (83, 84, 85, 133) and missing ones; 1, missing ones only; else each by itself."""
    said = lines.where("sign = '*'")
    mark = F.regexp_extract("value", "\x15([^\x15]*)\x15", 1)
    # Times of thirteen digits and more are no times; they would not fit either.
    fits = mark.rlike(r"^\d{1,12}_\d{1,12}$")
    times = F.split(mark, "_")
    rows = said.select("file", "line_no", "raw", F.col("label").alias("speaker"), F.col("value").contains("\x15").alias("has"), fits.alias("fits"), F.when(fits, times[0].cast("long")).alias("beg"), F.when(fits, times[1].cast("long")).alias("end"))
    order, own = Window.partitionBy("file").orderBy("line_no"), Window.partitionBy("file", "speaker").orderBy("line_no")
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rules = [(82, F.col("beg") > F.col("end")), (89, F.col("has") & ~F.col("fits"))]
    if bullets is not None:
        rules.append((110, ~F.col("has")))
    if bullets == 0:
        rows = rows.withColumns({"last_beg": last("beg", order), "last_end": last("end", order), "last_speaker": last(F.when(F.col("fits"), F.col("speaker")), order), "own_end": last("end", own)})
        other = F.col("last_speaker") != F.col("speaker")
        rules += [(83, F.col("beg") < F.col("last_beg")), (84, other & (F.col("beg") < F.col("last_end"))), (85, F.col("beg") > F.col("last_end")), (133, F.col("beg") < F.col("own_end"))]
    return _tried(rows, rules, F.col("raw"))


def check(scanned: DataFrame, include: Iterable[int] = (), exclude: Iterable[int] = (), bullets: int | None = None, target: bool = False, ids: bool = True, unused: bool = False) -> DataFrame:
    """Findings of transcripts: file, line_no, number, detail, message.

    scanned: chat.scan() of the kinds line, turn and problem, best a stored one, as it is read several times. include:
    only these numbers; else all but exclude. Findings that follow from others are taken away first.
    bullets, target, ids, unused: as in bullet_findings() and speaker_findings().
    """
    lines, turns, problems = chat.lines(scanned), chat.turns(scanned), chat.problems(scanned)
    out = order_findings(lines).withColumn("detail", F.lit(None).cast("string"))
    for more in (header_findings(lines), speaker_findings(lines, target, ids, unused), turn_findings(lines, problems), tier_findings(lines, turns), bullet_findings(lines, bullets)):
        out = out.unionByName(more)
    out = checks.cascades(out)
    include, exclude = list(include), list(exclude)
    if include:
        out = out.where(F.col("number").isin(*include))
    elif exclude:
        out = out.where(~F.col("number").isin(*exclude))
    message = F.element_at(F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair)), F.col("number"))
    return out.withColumn("message", message)


def numbers(spark) -> DataFrame:
    """number and message of everything that is looked for."""
    return spark.createDataFrame(sorted(MESSAGES.items()), "number int, message string")
