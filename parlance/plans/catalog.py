"""The queries, each over whole tables, and the same in SQL where SQL can say it.

The plain words of conversations are the main material; coded and timed utterances come from events;
tiers that no table has are derived from the words (sources.tables.with_tiers), in SQL by the view mor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.converters import export
from parlance.converters import tables as conv
from parlance.functions.words import capitalised, reversed_word
from parlance.operators import checks, comparison, filters, frequency, interaction, lengths, places, profiles
from parlance.sources.tables import POS, RELATIONS, conversation_turns, document_turns, event_turns, read, with_tiers
from parlance.transforms import tiers as tier_forms
from parlance.transforms import words as word_forms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The same views as in Spark: turns, their words, derived tiers, events.
_UTT = r"""utt AS (
  SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS BIGINT) AS utt_idx, role AS speaker, text, 'g' || CAST(turn // 2 AS VARCHAR) AS gem,
    list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '') AS cw
  FROM conversations)"""
_TOK = _UTT + """,
tok AS (SELECT file, utt_idx, speaker, gem, len(cw) AS n, unnest(cw) AS word, unnest(range(1, len(cw) + 1)) AS pos FROM utt)"""
_ALL = "[" + ", ".join(f"'{p}'" for p in POS) + "]"
_REL = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"
_MOR = (
    _TOK
    + f""",
mor AS (
  SELECT file, utt_idx, speaker, pos, lower(word) AS lemma, {_ALL}[length(word) % {len(POS)} + 1] AS p,
    CASE WHEN right(lower(word), 1) = 's' THEN 'PL' WHEN right(lower(word), 1) = 'd' THEN 'PAST' WHEN right(lower(word), 1) = 'g' THEN 'PRESP' END AS feat,
    CASE WHEN length(word) % 11 = 0 THEN 1 ELSE 0 END AS clitic, {_REL}[(length(word) + pos - 1) % {len(RELATIONS)} + 1] AS rel, '$' || left(lower(word), 1) AS code
  FROM tok),
each AS (SELECT file, utt_idx, speaker, p, lemma, feat FROM mor UNION ALL SELECT file, utt_idx, speaker, 'aux', 'be', NULL FROM mor WHERE clitic = 1)"""
)
_EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS utt_idx, 'U' || CAST(event_id % 5 AS VARCHAR) AS speaker,
    event_type AS code, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 10) AS BIGINT) - 500 AS end_ms
  FROM events)"""
_ISLE = (
    _UTT
    + """,
isl AS (
  SELECT file, utt_idx, speaker, len(cw) AS n, sum(new) OVER (PARTITION BY file ORDER BY utt_idx) AS island FROM (
    SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker THEN 1 ELSE 0 END AS new FROM utt WHERE len(cw) > 0 WINDOW w AS (PARTITION BY file ORDER BY utt_idx)))"""
)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_turns(read(spark, folder, "conversations"))


def _tiers(spark: SparkSession, folder: str) -> DataFrame:
    return with_tiers(_turns(spark, folder))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return event_turns(read(spark, folder, "events"))


def _add(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None, source: Callable = _turns) -> None:
    QUERIES[name] = lambda spark, folder: run(source(spark, folder))
    if sql:
        ORACLES[name] = sql


def _with(prelude: str, sql: str) -> str:
    return f"WITH {prelude}{'' if sql.lstrip().startswith(',') else chr(10)}{sql.lstrip()}"


# Word frequencies.
_add("freq", frequency.frequency, _with(_TOK, "SELECT speaker, word, count(*) AS count FROM tok GROUP BY ALL"))
_add("freq_by_file", lambda t: frequency.frequency(t, ("file", "speaker")), _with(_TOK, "SELECT file, speaker, word, count(*) AS count FROM tok GROUP BY ALL"))
_add("freq_combined", lambda t: frequency.frequency(t, combine_speakers=True), _with(_TOK, "SELECT word, count(*) AS count FROM tok GROUP BY ALL"))
_add("freq_folded", lambda t: frequency.frequency(t, case_sensitive=False), _with(_TOK, "SELECT speaker, lower(word) AS word, count(*) AS count FROM tok GROUP BY ALL"))
_add("freq_types", lambda t: frequency.types_and_tokens(frequency.frequency(t)), _with(_TOK, "SELECT speaker, count(DISTINCT word) AS types, count(*) AS tokens, round(count(DISTINCT word) / count(*), 6) AS ttr FROM tok GROUP BY speaker"))
_add("freq_top", lambda t: frequency.top(frequency.frequency(t), 20), _with(_TOK, """
SELECT speaker, word, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY count DESC, word) AS rank FROM (SELECT speaker, word, count(*) AS count FROM tok GROUP BY ALL)) WHERE rank <= 20"""))
_add("freq_reverse", lambda t: frequency.frequency(t).select("speaker", "word", reversed_word("word").alias("backwards"), "count"), _with(_TOK, "SELECT speaker, word, reverse(word) AS backwards, count(*) AS count FROM tok GROUP BY ALL"))
_ASKED = ["the", "of", "zebra", "der"]
_add("freq_zero", lambda t: frequency.with_zeros(frequency.frequency(t), _ASKED), _with(_TOK, "SELECT a.word, count(tok.word) AS count FROM (VALUES ('the'), ('of'), ('zebra'), ('der')) a(word) LEFT JOIN tok ON lower(tok.word) = a.word GROUP BY a.word"))
_add("freq_capital", lambda t: frequency.frequency(t, capital="initial"), _with(_TOK, r"SELECT speaker, word, count(*) AS count FROM tok WHERE regexp_matches(word, '^\p{Lu}') GROUP BY ALL"))
_add("freq_capital_mid", lambda t: frequency.frequency(t, capital="mid"), _with(_TOK, r"SELECT speaker, word, count(*) AS count FROM tok WHERE regexp_matches(word, '^.+\p{Lu}') GROUP BY ALL"))
_add("freq_delims", lambda t: frequency.frequency(t, delimiters=".-'"), _with(_TOK, """SELECT speaker, word, count(*) AS count FROM (SELECT speaker, unnest(regexp_split_to_array(translate(word, '.-''', '   '), ' +')) AS word FROM tok) WHERE word <> '' GROUP BY ALL"""))
_add("freq_include", lambda t: frequency.frequency(t, include=["th*", "of"], exclude=["*s"], case_sensitive=False), _with(_TOK, "SELECT speaker, lower(word) AS word, count(*) AS count FROM tok WHERE (lower(word) LIKE 'th%' OR lower(word) = 'of') AND NOT lower(word) LIKE '%s' GROUP BY ALL"))
_add("freq_patterns", lambda t: frequency.by_pattern(t, ["th*", "*e", "the"]), _with(_TOK, "SELECT speaker, pattern, count(*) AS count FROM tok, (VALUES ('th*', 'th%'), ('*e', '%e'), ('the', 'the')) p(pattern, l) WHERE lower(word) LIKE l GROUP BY ALL"))
_add("freq_percent_speakers", lambda t: frequency.by_share_of_speakers(t, 10), _with(_TOK, """
, c AS (SELECT file, speaker, word, count(*) AS n FROM tok GROUP BY ALL)
SELECT word, count(*) AS rows, sum(n) AS count FROM c GROUP BY word HAVING count(*) >= (SELECT count(DISTINCT (file, speaker)) FROM tok) * 10 // 100"""))
_add("freq_wide", lambda t: frequency.wide(frequency.frequency(t, ("file", "speaker")), ["the", "of", "and"]), _with(_TOK, """
SELECT file, speaker, count(*) FILTER (word = 'the') AS w_the, count(*) FILTER (word = 'of') AS w_of, count(*) FILTER (word = 'and') AS w_and, count(DISTINCT word) AS types, count(*) AS tokens, round(count(DISTINCT word) / count(*), 6) AS ttr FROM tok GROUP BY file, speaker"""))
_add("freq_tier", frequency.of_tier, _with(_MOR, "SELECT speaker, p || '|' || lemma || coalesce('-' || feat, '') AS word, count(*) AS count FROM each GROUP BY ALL"), _tiers)
_add("freq_tier_gra", lambda t: frequency.of_tier(t, "gra"), _with(_MOR, "SELECT speaker, concat(pos, '|', pos - 1, '|', rel) AS word, count(*) AS count FROM mor GROUP BY ALL"), _tiers)
_add("freq_multiword_seq", lambda t: frequency.sequences(t, ["of", "the"]), _with(_TOK, """
SELECT speaker, 'of the' AS "group", count(*) AS count FROM (SELECT speaker, word, lead(word) OVER (PARTITION BY file, utt_idx ORDER BY pos) AS w2 FROM tok) WHERE lower(word) = 'of' AND lower(w2) = 'the' GROUP BY speaker"""))
_add("freq_multiword_any", lambda t: frequency.any_order(t, ["the", "of"]), _with(_TOK, """
SELECT speaker, 'the of' AS "group", CAST(sum(least(a, b)) AS BIGINT) AS count FROM (SELECT speaker, file, utt_idx, count(*) FILTER (lower(word) = 'the') AS a, count(*) FILTER (lower(word) = 'of') AS b FROM tok GROUP BY ALL) GROUP BY speaker HAVING sum(least(a, b)) > 0"""))
_add("gemfreq", lambda t: frequency.frequency(filters.in_gems(t, ["G1"])), _with(_TOK, "SELECT speaker, word, count(*) AS count FROM tok WHERE gem = 'g1' GROUP BY ALL"))
_add("corelex", frequency.core_lexicon, _with(_TOK, "SELECT lower(word) AS word, count(*) AS frequency, count(DISTINCT speaker) AS speakers, count(*) >= 3 AS core FROM tok GROUP BY ALL"))
_add("mattr", lambda t: frequency.moving_ratio(t, 25), _with(_TOK, """
, i AS (SELECT file, speaker, lower(word) AS word, row_number() OVER (PARTITION BY file, speaker ORDER BY utt_idx, pos) AS i, count(*) OVER (PARTITION BY file, speaker) AS t FROM tok),
p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY file, speaker, word ORDER BY i), 0) AS p FROM i)
SELECT file, speaker, max(t) AS tokens, CASE WHEN max(t) >= 25 THEN round(sum(greatest(0, least(i, t - 24) - greatest(i - 24, p + 1, 1) + 1)) / (25 * (max(t) - 24)), 6) END AS mattr FROM p GROUP BY file, speaker"""))
_add("vocd_curve", lambda t: frequency.diversity_curve(t, (35, 50)), _with(_TOK, """
, c AS (SELECT speaker, word, count(*) AS f FROM tok GROUP BY ALL), s AS (SELECT speaker, f, count(*) AS k, sum(f * count(*)) OVER (PARTITION BY speaker) AS t FROM c GROUP BY speaker, f),
m AS (SELECT speaker, f, k, t, n, list_product(list_transform(range(n), lambda i: greatest(0.0, CAST(t - f - i AS DOUBLE)) / CAST(t - i AS DOUBLE))) AS missed FROM s, (VALUES (35), (50)) v(n) WHERE t >= 50)
SELECT speaker, n, round(sum(k * (1 - missed)) / n, 6) AS ttr FROM m GROUP BY speaker, n"""))

# Lengths and times.
_add("mlu_words", lengths.mean_length, _with(_UTT, """
SELECT speaker, count(*) AS utterances, sum(len(cw)) AS total, round(avg(len(cw)), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(len(cw)), 6) END AS sd, min(len(cw)) AS least, max(len(cw)) AS most FROM utt WHERE len(cw) > 0 GROUP BY speaker"""))
_add("mlu_morphemes", lambda t: lengths.mean_length(t, morphemes=True), _with(_MOR, """
, u AS (SELECT file, utt_idx, speaker, sum(CASE WHEN feat IN ('PL', 'PAST', 'PRESP') THEN 2 ELSE 1 END) AS n FROM each GROUP BY ALL)
SELECT speaker, count(*) AS utterances, sum(n) AS total, round(avg(n), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(n), 6) END AS sd, min(n) AS least, max(n) AS most FROM u GROUP BY speaker"""), _tiers)
_add("mlt", lengths.turn_lengths, _with(_ISLE, """
, t AS (SELECT speaker, file, island, count(*) AS u, sum(n) AS w FROM isl GROUP BY ALL), s AS (SELECT speaker, CASE WHEN count(*) > 1 THEN round(stddev_pop(n), 6) END AS sd FROM isl GROUP BY speaker)
SELECT t.speaker AS speaker, count(*) AS turns, sum(u) AS utterances, sum(w) AS words, round(sum(w) / count(*), 6) AS words_per_turn, round(sum(u) / count(*), 6) AS utterances_per_turn, round(sum(w) / sum(u), 6) AS words_per_utterance, any_value(sd) AS sd FROM t JOIN s ON s.speaker = t.speaker GROUP BY t.speaker"""))
_add("wdlen", lengths.length_histograms, _with(_MOR + ",\n" + _ISLE[_ISLE.index("isl AS") :], """
, runs AS (SELECT file, speaker, island, count(*) AS u, sum(n) AS w FROM isl GROUP BY ALL),
items AS (SELECT file, utt_idx, speaker, CASE WHEN feat IS NULL THEN 1 ELSE 2 END + clitic AS m FROM mor)
SELECT section, speaker, length, count(*) AS count FROM (
  SELECT 1 AS section, speaker, length(replace(word, '''', '')) AS length FROM tok
  UNION ALL SELECT 2, speaker, n FROM isl UNION ALL SELECT 3, speaker, u FROM runs UNION ALL SELECT 4, speaker, w FROM runs
  UNION ALL SELECT 5, speaker, m FROM items UNION ALL SELECT 6, speaker, sum(m + 1) FROM items GROUP BY file, utt_idx, speaker) GROUP BY ALL"""), _tiers)
_add("wdsize", lengths.word_sizes, _with(_MOR, "SELECT speaker, length(lemma) AS length, count(*) AS count FROM each GROUP BY ALL"), _tiers)
_add("wdsize_main", lambda t: lengths.word_sizes(t, ("gt", 5), main_tier=True), _with(_TOK, "SELECT speaker, length(word) AS length, count(*) AS count FROM tok WHERE length(word) > 5 GROUP BY ALL"))
_add("maxwd", lengths.longest_words, _with(_TOK, """
SELECT speaker, word, count, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY length DESC, word) AS rank FROM (SELECT speaker, lower(word) AS word, count(*) AS count, length(lower(word)) AS length FROM tok GROUP BY ALL)) WHERE rank <= 20"""))
_add("maxwd_unique", lambda t: lengths.longest_words(t, 5, unique_lengths=True, left_out=[30]), _with(_TOK, """
, w AS (SELECT speaker, lower(word) AS word, length(lower(word)) AS length, count(*) AS count FROM tok GROUP BY ALL), u AS (SELECT * FROM w WHERE length <> 30 QUALIFY count(*) OVER (PARTITION BY speaker, length) = 1)
SELECT speaker, word, count, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY length DESC, word) AS rank FROM u) WHERE rank <= 5"""))
_add("maxwd_places", lengths.longest_places, _with(_TOK, """
, w AS (SELECT file, utt_idx, lower(word) AS word, length(translate(lower(word), '+''', '')) AS length FROM tok)
SELECT word, length, file, utt_idx FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY file, utt_idx) AS r FROM w WHERE length = (SELECT max(length) FROM w)) WHERE r = 1"""))
_add("timedur", lengths.durations, _with(_EV, "SELECT speaker, count(*) AS timed, sum(greatest(end_ms - start_ms, 0)) AS total, min(greatest(end_ms - start_ms, 0)) AS least, max(greatest(end_ms - start_ms, 0)) AS most, sum(greatest(end_ms - start_ms, 0)) // count(*) AS mean FROM ev GROUP BY speaker"), _events)
_add("timedur_span", lengths.span, _with(_EV, "SELECT count(*) AS timed, sum(greatest(end_ms - start_ms, 0)) AS total, max(end_ms) - min(start_ms) AS span FROM ev"), _events)

# Places of words, and search.
_add("freqpos", places.positions, _with(_TOK, """
SELECT lower(word) AS word, count(*) AS total, count(*) FILTER (n > 1 AND pos = 1) AS initial, count(*) FILTER (n > 1 AND pos > 1 AND pos = n) AS final, count(*) FILTER (n > 1 AND pos > 1 AND pos < n) AS other, count(*) FILTER (n = 1) AS one_word FROM tok GROUP BY ALL"""))
_add("freqpos_second", lambda t: places.positions(t, second=True), _with(_TOK, """
SELECT lower(word) AS word, count(*) AS total, count(*) FILTER (n > 1 AND pos = 1) AS initial, count(*) FILTER (n > 1 AND pos = 2) AS second, count(*) FILTER (n > 1 AND pos > 2) AS other, count(*) FILTER (n = 1) AS one_word FROM tok GROUP BY ALL"""))
for _n in (2, 3):
    _lead = " || ' ' || ".join(["lower(word)"] + [f"lead(lower(word), {k}) OVER w" for k in range(1, _n)])
    _add(f"cooccur_{_n}", lambda t, n=_n: places.clusters(t, n), _with(_TOK, f"SELECT cluster, count(*) AS count FROM (SELECT {_lead} AS cluster FROM tok WINDOW w AS (PARTITION BY file, utt_idx ORDER BY pos)) WHERE cluster IS NOT NULL GROUP BY ALL"))
_add("cooccur_totals", places.cluster_totals, _with(_TOK, """
, c AS (SELECT lower(word) || ' ' || lead(lower(word)) OVER (PARTITION BY file, utt_idx ORDER BY pos) AS c FROM tok)
SELECT count(DISTINCT c) AS "unique", count(c) AS instances, (SELECT count(*) FROM utt WHERE len(cw) >= 2) AS utterances FROM c"""))
_add("dist", places.distances, _with(_TOK, """
, t AS (SELECT file, lower(word) AS word, dense_rank() OVER (PARTITION BY file ORDER BY utt_idx) AS turn FROM tok)
SELECT file, word, count(*) AS count, min(turn) AS first, CASE WHEN max(turn) <> min(turn) THEN max(turn) END AS last, round((max(turn) - min(turn)) / count(*), 6) AS average FROM t GROUP BY ALL"""))
_add("dist_once", lambda t: places.distances(t, once_per_turn=True), _with(_TOK, """
, t AS (SELECT DISTINCT file, lower(word) AS word, dense_rank() OVER (PARTITION BY file ORDER BY utt_idx) AS turn FROM tok)
SELECT file, word, count(*) AS count, min(turn) AS first, CASE WHEN max(turn) <> min(turn) THEN max(turn) END AS last, round((max(turn) - min(turn)) / count(*), 6) AS average FROM t GROUP BY ALL"""))
_has = lambda p: f"len(list_filter(cw, lambda x: lower(x) LIKE '{p}')) > 0"
_add("kwal", lambda t: places.keyword_lines(t, ["than*", "for"]), _with(_UTT, f"SELECT file, utt_idx, speaker, text, CASE WHEN {_has('than%')} THEN 'than*' ELSE 'for' END AS keyword FROM utt WHERE {_has('than%')} OR {_has('for')}"))
_add("kwal_context", lambda t: places.keyword_lines(t, ["for"], before=1, after=2).select("file", "utt_idx", "keyword", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after")), _with(_UTT, f"""
SELECT file, utt_idx, keyword, coalesce(array_to_string(b, '|'), '') AS before, coalesce(array_to_string(a, '|'), '') AS after FROM (SELECT file, utt_idx, cw, 'for' AS keyword, list(text) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b, list(text) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM utt WINDOW w AS (PARTITION BY file ORDER BY utt_idx)) WHERE {_has('for')}"""))
_add("kwal_strict", lambda t: places.keyword_lines(t, ["*"], strict=True).select("file", "utt_idx", "keyword"), _with(_UTT, "SELECT file, utt_idx, '*' AS keyword FROM utt WHERE len(cw) = 1"))
_add("kwal_counts", lambda t: places.keyword_counts(t, ["the", "*ing", "zz*"]), _with(_UTT, f"SELECT keyword, count(*) AS count FROM (SELECT unnest(list_filter([CASE WHEN {_has('the')} THEN 'the' END, CASE WHEN {_has('%ing')} THEN '*ing' END, CASE WHEN {_has('zz%')} THEN 'zz*' END], lambda x: x IS NOT NULL)) AS keyword FROM utt) GROUP BY keyword"))
_match = lambda *p: "array_to_string(list_filter(cw, lambda x: " + " OR ".join(f"lower(x) LIKE '{q}'" for q in p) + "), ' ')"
_add("combo_and", lambda t: places.combinations(t, ["the+of"]), _with(_UTT, f"SELECT file, utt_idx, speaker, 0 AS expression, {_match('the', 'of')} AS matched FROM utt WHERE {_has('the')} AND {_has('of')}"))
_add("combo_or", lambda t: places.combinations(t, ["der,le"]), _with(_UTT, f"SELECT file, utt_idx, speaker, 0 AS expression, {_match('der', 'le')} AS matched FROM utt WHERE {_has('der')} OR {_has('le')}"))
_add("combo_exclude", lambda t: places.combinations(t, ["the", "th*+was"], exclude=["of"]), _with(_UTT, f"""SELECT file, utt_idx, speaker, 0 AS expression, {_match('the')} AS matched FROM utt WHERE {_has('the')} AND NOT {_has('of')}
UNION ALL SELECT file, utt_idx, speaker, 1, {_match('th%', 'was')} FROM utt WHERE {_has('th%')} AND {_has('was')} AND NOT {_has('of')}"""))
_add("combo_first", lambda t: places.combinations(t, ["the", "of"], first_only=True, dedupe=True).select("file", "utt_idx", "expression"), _with(_UTT, f"SELECT file, utt_idx, CASE WHEN {_has('the')} THEN 0 ELSE 1 END AS expression FROM utt WHERE {_has('the')} OR {_has('of')}"))
_add("uniq", lambda t: places.unique_lines(t.select(F.explode(F.split("text", "\n")).alias("line"))), "SELECT lower(trim(line)) AS line, count(*) AS count FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY ALL")

# Interaction.
_CHIP = _UTT + """,
c AS (SELECT file, utt_idx, speaker AS "to", list_transform(cw, lambda x: lower(x)) AS w, lag(list_transform(cw, lambda x: lower(x))) OVER o AS b, lag(speaker) OVER o AS "from" FROM utt WINDOW o AS (PARTITION BY file ORDER BY utt_idx)),
k AS (SELECT file, utt_idx, "from", "to", CASE WHEN list_sort(w) = list_sort(b) THEN 'exact' WHEN len(list_intersect(b, w)) / least(len(list_distinct(b)), len(list_distinct(w))) >= 0.5 THEN 'overlap' ELSE 'none' END AS kind FROM c WHERE "from" <> "to" AND len(w) > 0 AND len(b) > 0)"""
_add("chip", interaction.echo_counts, _with(_CHIP, """SELECT "from", "to", count(*) AS responses, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'overlap') AS overlap, count(*) FILTER (kind = 'none') AS none FROM k GROUP BY ALL"""))
_add("chip_lines", interaction.echoes, _with(_CHIP, "SELECT * FROM k"))
_add("codes", interaction.codes, _with(_EV, "SELECT speaker, code, count(*) AS count FROM ev GROUP BY ALL"), _events)
_add("codes_tier", interaction.codes, _with(_MOR, "SELECT speaker, '$' || left(lemma, 1) AS code, count(*) AS count FROM mor GROUP BY ALL"), _tiers)
_add("chains", interaction.chains, _with(_EV, """
, i AS (SELECT *, row_number() OVER (PARTITION BY file, speaker ORDER BY utt_idx) AS i FROM ev), r AS (SELECT *, i - row_number() OVER (PARTITION BY file, speaker, code ORDER BY i) AS run FROM i),
l AS (SELECT file, speaker, code, run, count(*) AS n FROM r GROUP BY ALL)
SELECT speaker, code, count(*) AS chains, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS sd, min(n) AS least, max(n) AS most FROM l GROUP BY ALL"""), _events)
_add("keymap", lambda t: interaction.contingencies(t, ["click", "purchase"]), _with(_EV, """
, l AS (SELECT speaker, code, lag(speaker) OVER w AS "from", lag(code) OVER w AS keyword FROM ev WINDOW w AS (PARTITION BY file ORDER BY utt_idx))
SELECT "from", keyword, speaker AS "to", code, count(*) AS count FROM l WHERE keyword IN ('click', 'purchase') GROUP BY ALL"""), _events)
_add("gemlist", interaction.gems, _with(_UTT, "SELECT gem, count(*) AS utterances, count(DISTINCT file) AS occurrences, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM utt GROUP BY gem"))


def _linked(t: DataFrame) -> DataFrame:
    n = F.col("utt_idx") + F.char_length("text")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return t.withColumns({"terminator": pick([".", "+...", "+/.", '+"/.']), "linkers": F.array(pick(["++", "+,", "+<", '+"', "none"]))})


_add("linker_audit", lambda t: interaction.linker_audit(_linked(t)), _with(_UTT, r"""
, l AS (SELECT file, utt_idx, speaker, ['.', '+...', '+/.', '+"/.'][(utt_idx + length(text)) % 4 + 1] AS term, ['++', '+,', '+<', '+"', 'none'][(utt_idx + length(text)) % 5 + 1] AS link FROM utt),
p AS (SELECT *, lag(term) OVER w AS pt, lag(speaker) OVER w AS ps, lag(link) OVER w AS pl, lag(term) OVER (PARTITION BY file, speaker ORDER BY utt_idx) AS own FROM l WINDOW w AS (PARTITION BY file ORDER BY utt_idx)),
b AS (SELECT file, block, count(*) AS n FROM (SELECT file, link, sum(CASE WHEN link = '+<' AND coalesce(pl, '') <> '+<' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY utt_idx) AS block FROM p) WHERE link = '+<' GROUP BY ALL),
s AS (SELECT file, count(*) AS blocks, max(n) AS longest FROM b GROUP BY file)
SELECT p.file AS file, count(*) FILTER (link = '++') AS other_completion, count(*) FILTER (link = '+,') AS self_completion, count(*) FILTER (link = '+<') AS lazy_overlap, count(*) FILTER (link = '+"') AS quotation, 0 AS quick_uptake, 0 AS latching, 0 AS tcu,
  count(*) FILTER (link = '++' AND pt = '+...' AND ps <> speaker) AS other_completion_fits, count(*) FILTER (link = '+,' AND own IN ('+...', '+/.')) AS self_completion_fits, count(*) FILTER (link = '+"' AND pt = '+"/.') AS quotation_fits,
  coalesce(any_value(blocks), 0) AS blocks, coalesce(any_value(longest), 0) AS longest FROM p LEFT JOIN s ON s.file = p.file GROUP BY p.file"""))
_add("overlap_audit", lambda t: interaction.overlap_audit(t.withColumn("text", F.concat(F.element_at(F.array(F.lit("⌈"), F.lit("⌊"), F.lit("")), (F.col("utt_idx") % 3 + 1).cast("int")), "text"))), _with(_UTT, r"""
, l AS (SELECT file, utt_idx, speaker, ['⌈', '⌊', ''][utt_idx % 3 + 1] || text AS text FROM utt),
t AS (SELECT *, regexp_extract_all(text, '⌈([2-9]?)', 1) AS tops, regexp_extract_all(text, '⌊([2-9]?)', 1) AS bottoms FROM l),
m AS (SELECT file, utt_idx, speaker, 'top' AS kind, unnest(tops) AS idx, unnest(range(len(tops))) AS k FROM t UNION ALL SELECT file, utt_idx, speaker, 'bottom', unnest(bottoms), unnest(range(len(bottoms))) FROM t),
p AS (SELECT *, last_value(CASE WHEN kind = 'top' THEN {'u': utt_idx, 'k': k, 's': speaker} END IGNORE NULLS) OVER (PARTITION BY file, idx ORDER BY utt_idx, kind DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m),
f AS (SELECT *, coalesce(kind = 'bottom' AND top IS NOT NULL AND top.s <> speaker, false) AS fits FROM p),
c AS (SELECT file, count(*) FILTER (kind = 'top') AS tops, count(*) FILTER (kind = 'bottom') AS bottoms, count(DISTINCT CASE WHEN fits THEN {'i': idx, 'u': top.u, 'k': top.k} END) AS groups, count(*) FILTER (kind = 'bottom' AND NOT fits) AS orphan_bottoms FROM f GROUP BY file),
q AS (SELECT *, tops - groups + orphan_bottoms AS alone FROM c)
SELECT u.file AS file, coalesce(tops, 0) AS tops, coalesce(bottoms, 0) AS bottoms, coalesce(groups, 0) AS groups, coalesce(orphan_bottoms, 0) AS orphan_bottoms, CAST(0 AS BIGINT) AS timed, CAST(0 AS BIGINT) AS consistent, coalesce(tops - groups, 0) AS orphan_tops,
  CASE WHEN alone IS NULL THEN 'none' WHEN alone = 0 THEN 'fully_paired' WHEN alone / greatest(1, groups + alone) > 0.8 THEN 'open_only' ELSE 'mixed' END AS quality
FROM (SELECT DISTINCT file FROM utt) u LEFT JOIN q ON q.file = u.file"""))

# Comparisons.
def _coded(parity: int):
    return lambda spark, folder: _tiers(spark, folder).where(F.col("file").cast("long") % 2 == parity).groupBy("utt_idx").agg(F.flatten(F.collect_list("cod")).alias("cod"))


_RELY = _MOR + """,
x AS (SELECT CAST(file AS BIGINT) % 2 AS side, utt_idx, '$' || left(lemma, 1) AS code FROM mor), lim AS (SELECT min(m) AS m FROM (SELECT max(utt_idx) AS m FROM (SELECT CAST(file AS BIGINT) % 2 AS side, utt_idx FROM utt) GROUP BY side)),
a AS (SELECT utt_idx, code, count(*) AS n FROM x WHERE side = 0 AND utt_idx <= (SELECT m FROM lim) GROUP BY ALL), b AS (SELECT utt_idx, code, count(*) AS n FROM x WHERE side = 1 AND utt_idx <= (SELECT m FROM lim) GROUP BY ALL),
r AS (SELECT code, sum(coalesce(a.n, 0)) AS first, sum(coalesce(b.n, 0)) AS second, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS agreed FROM a FULL JOIN b USING (utt_idx, code) GROUP BY code)"""
QUERIES["rely"] = lambda s, d: comparison.agreement(_coded(0)(s, d), _coded(1)(s, d))
ORACLES["rely"] = _with(_RELY, "SELECT code, first, second, agreed, round(100 * agreed / greatest(first, second), 6) AS percent FROM r")
QUERIES["rely_kappa"] = lambda s, d: comparison.kappa(comparison.agreement(_coded(0)(s, d), _coded(1)(s, d)))
ORACLES["rely_kappa"] = _with(_RELY, """
, t AS (SELECT sum(agreed) AS agreed, greatest(sum(first), sum(second)) AS n, sum(first * second) AS p FROM r)
SELECT agreed, n, round(100 * (agreed / n), 6) AS percent, round((agreed / n - p / (n * n)) / (1 - p / (n * n)), 6) AS kappa FROM t""")
QUERIES["script"] = lambda s, d: comparison.against_template(_turns(s, d), document_turns(read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("T").alias("source"), F.lit("").alias("lang"))))
ORACLES["script"] = _with(_TOK, r"""
, b AS (SELECT unnest(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda x: x <> '')) AS word FROM benchmark),
s AS (SELECT lower(word) AS word, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT word, count(*) AS n FROM b GROUP BY ALL), j AS (SELECT coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t FROM s FULL JOIN t USING (word))
SELECT sum(s) AS produced, sum(t) AS ideal, sum(least(s, t)) AS correct, sum(t) - sum(least(s, t)) AS omitted, sum(s) - sum(least(s, t)) AS added, round(100 * (sum(least(s, t)) / sum(t)), 6) AS percent FROM j""")
_PHO = "translate(lemma, 'aeiou', 'eioua')"
_add("trnfix", lambda t: comparison.tier_mismatches(t, "pho", "mod"), _with(_MOR, f"SELECT lemma AS first, {_PHO} AS second, count(*) AS count FROM mor WHERE lemma <> {_PHO} GROUP BY ALL"), _tiers)
_add("trnfix_accuracy", lambda t: comparison.tier_accuracy(t, "pho", "mod"), _with(_MOR, f"SELECT count(*) AS items, count(*) FILTER (lemma = {_PHO}) AS equal, round(100 * count(*) FILTER (lemma = {_PHO}) / count(*), 6) AS accuracy FROM mor"), _tiers)
_add("modrep", comparison.replicas, _with(_MOR, f"SELECT speaker, {_PHO} AS model, lemma AS replica, count(*) AS count FROM mor GROUP BY ALL"), _tiers)
_add("phonfreq", comparison.phones, _with(_MOR, r"""
, c AS (SELECT list_filter(string_split(lemma, ''), lambda x: regexp_matches(x, '^[\p{L}+]$')) AS c FROM mor), e AS (SELECT len(c) AS n, unnest(c) AS phone, unnest(range(1, len(c) + 1)) AS k FROM c)
SELECT phone, count(*) AS total, count(*) FILTER (k = 1) AS initial, count(*) FILTER (k > 1 AND k = n) AS final, count(*) FILTER (k > 1 AND k < n) AS other FROM e GROUP BY phone"""), _tiers)


def _norms(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    return read(spark, folder, "documents").where("text is not null").select(F.col("lang").alias("language"), F.array(n, F.size(F.split("text", " ")).cast("double")).alias("scores"))


def _z(spark: SparkSession, folder: str) -> DataFrame:
    scores = read(spark, folder, "documents").groupBy(F.col("source").alias("speaker"), F.col("lang").alias("language")).agg(F.avg(F.col("n_chars").cast("double")).alias("score")).withColumn("measure", F.lit(0))
    return comparison.z_scores(scores, _norms(spark, folder), by=("language",))


QUERIES["norms_zscore"] = _z
ORACLES["norms_zscore"] = """WITH n AS (SELECT lang AS language, avg(CAST(n_chars AS DOUBLE)) AS mean, stddev_samp(CAST(n_chars AS DOUBLE)) AS sd, count(n_chars) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang),
s AS (SELECT source AS speaker, lang AS language, avg(CAST(n_chars AS DOUBLE)) AS score FROM documents GROUP BY ALL)
SELECT speaker, s.language AS language, 0 AS measure, round(score, 6) AS score, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN sd <> 0 THEN round((score - mean) / sd, 6) END AS z, n FROM s JOIN n ON n.language = s.language"""
QUERIES["norms_statistics"] = lambda s, d: comparison.norm_statistics(_norms(s, d), ("language",)).select("language", "measure", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")
ORACLES["norms_statistics"] = """WITH n AS (SELECT lang AS language, unnest([0, 1]) AS measure, unnest([CAST(n_chars AS DOUBLE), CAST(len(string_split(text, ' ')) AS DOUBLE)]) AS score FROM documents WHERE text IS NOT NULL)
SELECT language, measure, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd, count(score) AS n FROM n WHERE score IS NOT NULL GROUP BY ALL"""

# Profiles over derived tiers.
_FIRST = lambda most: f""", f AS (SELECT file, utt_idx, speaker, row_number() OVER (PARTITION BY speaker ORDER BY file, utt_idx) AS k FROM utt WHERE len(cw) > 0), e AS (SELECT each.* FROM each JOIN f USING (file, utt_idx, speaker) WHERE f.k <= {most})"""


def _item(pattern: str) -> str:
    pattern = pattern.strip("|").lower()
    head, dash, part = pattern.partition("-")
    if dash:
        return f"(starts_with(p, '{head}') AND contains(lower(coalesce(feat, '')), '{part}'))"
    return f"(starts_with(p, '{pattern}') OR contains(lower(coalesce(feat, '')), '{pattern}'))"


def _dss_sql() -> str:
    sums = {n: f"CASE WHEN bool_or({' OR '.join(map(_item, ps))}) THEN {k} ELSE 0 END" for n, ps, k in profiles.DSS_RULES}
    of = lambda prefixes: " OR ".join(f"starts_with(p, '{x}')" for x in prefixes)
    sums["sentence_points"] = f"CASE WHEN bool_or({of(profiles.SUBJECTS)}) AND bool_or({of(profiles.VERBS)}) THEN 1 ELSE 0 END"
    inner = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    outer = ", ".join(f"sum({n}) AS {n}" for n in sums)
    return _with(_MOR + _FIRST(50), f"SELECT speaker, count(*) AS utterances, {outer}, round(({' + '.join(f'sum({n})' for n in sums)}) / count(*), 6) AS score FROM (SELECT file, utt_idx, speaker, {inner} FROM e GROUP BY ALL) GROUP BY speaker")


def _ipsyn_sql() -> str:
    inner = ", ".join(f"{' AND '.join(f'bool_or({_item(p)})' for p in r.include)} AS {r.name}" for r in profiles.IPSYN_RULES)
    each = {r.name: f"least(2, count(*) FILTER ({r.name}))" for r in profiles.IPSYN_RULES}
    kinds = ", ".join(f"{' + '.join(e for n, e in each.items() if n[0] == k)} AS total_{k}" for k in "NQSV")
    return _with(_MOR + _FIRST(100), f"SELECT speaker, count(*) AS utterances, {', '.join(f'{e} AS {n}' for n, e in each.items())}, {kinds}, {' + '.join(each.values())} AS total FROM (SELECT file, utt_idx, speaker, {inner} FROM e GROUP BY ALL) GROUP BY speaker")


_add("dss", profiles.sentence_scores, _dss_sql(), _tiers)
_add("ipsyn", profiles.syntax_index, _ipsyn_sql(), _tiers)
_CLASS = "CASE WHEN p IN ('noun', 'propn', 'n') OR starts_with(p, 'n:prop') THEN 'noun' WHEN p IN ('aux', 'v:aux') THEN 'aux' WHEN starts_with(p, 'v') THEN 'verb' WHEN p = 'mod' THEN 'mod' WHEN p IN ('adp', 'prep') THEN 'prep' WHEN p = 'adj' THEN 'adj' WHEN starts_with(p, 'adv') THEN 'adv' WHEN p IN ('cconj', 'sconj') OR starts_with(p, 'conj') THEN 'conj' WHEN starts_with(p, 'det') THEN 'det' WHEN starts_with(p, 'pro') THEN 'pron' END"
_EVAL = _MOR + f""",
c AS (SELECT speaker, file, utt_idx, feat, {_CLASS} AS k FROM each), ut AS (SELECT speaker, count(*) AS utterances, sum(len(cw)) AS words FROM utt WHERE len(cw) > 0 GROUP BY speaker), ty AS (SELECT speaker, count(DISTINCT lower(word)) AS different_words FROM tok GROUP BY speaker),
ev AS (SELECT speaker, any_value(utterances) AS utterances, any_value(words) AS words, CAST(count(*) + count(feat) AS BIGINT) AS morphemes, 0 AS word_errors,
  {', '.join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in ('noun', 'aux', 'verb', 'mod', 'prep', 'adj', 'adv', 'conj', 'det', 'pron'))},
  count(*) FILTER (feat = 'PL') AS plurals, count(*) FILTER (feat = 'PAST') AS past, count(*) FILTER (feat = 'PRESP') AS present_participle, 0 AS past_participle, any_value(different_words) AS different_words FROM c JOIN ut USING (speaker) JOIN ty USING (speaker) GROUP BY speaker)"""
_add("eval", profiles.evaluation, _with(_EVAL, """SELECT *, round(different_words / words, 6) AS ttr, round(words / utterances, 6) AS words_per_utterance, round(morphemes / utterances, 6) AS morphemes_per_utterance,
  round((n_noun + n_verb + n_adj + n_adv) / (n_aux + n_mod + n_prep + n_conj + n_det + n_pron), 6) AS open_closed FROM ev"""), _tiers)
_add("kideval", profiles.child_evaluation, None, _tiers)
ORACLES["kideval"] = _with(_EVAL, f"""
, d AS ({_dss_sql()}), i AS ({_ipsyn_sql()})
SELECT speaker, ev.utterances AS utterances, words, different_words, round(different_words / words, 6) AS ttr, round(words / ev.utterances, 6) AS words_per_utterance, round(morphemes / ev.utterances, 6) AS morphemes_per_utterance,
  round(CASE WHEN words < 50 THEN 0 WHEN different_words = words THEN 120 ELSE least(120, words * (different_words / words) * (different_words / words) / (1 - different_words / words)) END, 6) AS d_estimate, d.score AS dss, i.total AS ipsyn FROM ev JOIN d USING (speaker) JOIN i USING (speaker)""")
_add("sugar", profiles.sampling_profile, _with(_MOR, """
, a AS (SELECT file, utt_idx, speaker, count(*) + count(feat) AS m, bool_or(p IN ('v', 'cop', 'aux')) AS verb FROM each GROUP BY ALL), b AS (SELECT file, utt_idx, count(*) AS w, 1 + count(*) FILTER (rel = 'CSUBJ') AS c FROM mor GROUP BY ALL)
SELECT speaker, count(*) AS utterances, sum(w) AS words, count(*) FILTER (verb) AS verb_utterances, coalesce(sum(c) FILTER (verb), 0) AS clauses, round(sum(m) / count(*), 6) AS mlu,
  CASE WHEN count(*) FILTER (verb) > 0 THEN round(sum(w) FILTER (verb) / count(*) FILTER (verb), 6) END AS words_per_sentence, CASE WHEN count(*) FILTER (verb) > 0 THEN round(sum(c) FILTER (verb) / count(*) FILTER (verb), 6) END AS clauses_per_sentence FROM a JOIN b USING (file, utt_idx) GROUP BY speaker"""), _tiers)
_labels = profiles.COMPLEX_UD + profiles.COMPLEX_BOTH + profiles.COMPLEX_LEGACY
_add("complexity", profiles.complexity, _with(_MOR, f"""
SELECT speaker, {', '.join(f"count(*) FILTER (rel = '{x}') AS {x.lower()}" for x in _labels)}, count(*) AS relations, count(*) FILTER (rel IN ('CCOMP', 'ADVCL', 'CSUBJ')) AS complex, round(count(*) FILTER (rel IN ('CCOMP', 'ADVCL', 'CSUBJ')) / count(*), 6) AS ratio FROM mor WHERE rel <> 'PUNCT' GROUP BY speaker"""), _tiers)
_RULES = [("OR", "plural_noun", ("n-PL",), ()), ("AND", "noun", ("n",), ()), ("OR", "past_verb", (), ("v", "PAST")), ("AND", "verb", ("v", "cop"), ())]
_add("mortable", lambda t: profiles.morpheme_table(t, _RULES), _with(_MOR, f"""
, r AS (SELECT speaker, {_item('n-PL')} AS a, {_item('n')} AS b, {_item('v')} AND {_item('PAST')} AS c, {_item('v')} OR {_item('cop')} AS d FROM mor)
SELECT speaker, label, count(*) AS count FROM (SELECT speaker, unnest(list_filter([CASE WHEN a THEN 'plural_noun' END, CASE WHEN b AND NOT a THEN 'noun' END, CASE WHEN c AND NOT a THEN 'past_verb' END, CASE WHEN d AND NOT a AND NOT c THEN 'verb' END], lambda x: x IS NOT NULL)) AS label FROM r) GROUP BY ALL"""), _tiers)
_add("flucalc_repeats", profiles.repeated_words, _with(_TOK, """
SELECT speaker, count(*) AS words, count(*) FILTER (w = b) AS repetitions, round(100 * (count(*) FILTER (w = b) / count(*)), 6) AS rate FROM (SELECT speaker, lower(word) AS w, lag(lower(word)) OVER (PARTITION BY file, utt_idx ORDER BY pos) AS b FROM tok) GROUP BY speaker"""))

# Filters.
_F = "SELECT file, utt_idx, speaker FROM utt WHERE "
_key = lambda t: t.select("file", "utt_idx", "speaker")
_add("filter_range", lambda t: _key(filters.in_range(t, 2, 3)), _with(_UTT, _F + "utt_idx BETWEEN 2 AND 3"))
_add("filter_length_words", lambda t: _key(filters.of_length(t, ">20w", ["the"])), _with(_UTT, _F + "len(list_filter(cw, lambda x: lower(x) <> 'the')) > 20"))
_add("filter_length_chars", lambda t: _key(filters.of_length(t, "<120c")), _with(_UTT, _F + "coalesce(list_sum(list_transform(cw, lambda x: length(x))), 0) < 120"))
_add("filter_length_morphemes", lambda t: _key(filters.of_length(t, ">60m")), _with(_MOR, "SELECT file, utt_idx, speaker FROM each GROUP BY ALL HAVING sum(CASE WHEN feat IS NULL THEN 1 ELSE 2 END) > 60"), _tiers)
_add("filter_speaker", lambda t: _key(filters.of_speakers(t, ["user", "system"], ["system"])), _with(_UTT, _F + "speaker = 'user'"))
_add("filter_gem", lambda t: _key(filters.in_gems(t, ["G0", "g2"], ["g1"])), _with(_UTT, _F + "gem IN ('g0', 'g2')"))
_add("filter_word_gate", lambda t: _key(filters.with_words(t, ["the"], ["was"])), _with(_UTT, _F + f"{_has('the')} AND NOT {_has('was')}"))
_add("filter_word_glob", lambda t: _key(filters.with_words(t, ["*ing", "ent*"])), _with(_UTT, _F + f"({_has('%ing')} OR {_has('ent%')})"))
_add("filter_solo", lambda t: _key(filters.without_solo(t, ["the", "of", "and"])), _with(_UTT, _F + "NOT (len(cw) > 0 AND len(list_filter(cw, lambda x: lower(x) NOT IN ('the', 'of', 'and'))) = 0)"))
_add("filter_capital", lambda t: _key(t.where(F.exists("cw", lambda w: capitalised(w, "mid")))), _with(_UTT, _F + r"len(list_filter(cw, lambda x: regexp_matches(x, '^.+\p{Lu}'))) > 0"))


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("source").alias("speaker"), "lang")
    return rows.select("file", "speaker", F.concat("lang", F.lit("|corpus|"), "speaker", F.lit("|||||"), F.when(F.col("lang") == "en", "Mother").otherwise("Target_Child"), F.lit("|||")).alias("id_raw"), F.when(F.col("lang") == "en", "Mother").otherwise("Target_Child").alias("role"))


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    return document_turns(read(spark, folder, "documents"))


_DOC = r"""doc AS (SELECT CAST(doc_id AS VARCHAR) AS file, source AS speaker, lang, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
sen AS (SELECT file, speaker, lang, unnest(range(1, len(s) + 1)) AS utt_idx, unnest(s) AS text FROM doc)"""
QUERIES["filter_id"] = lambda s, d: filters.with_id(_sentences(s, d), _ids(s, d), "de|*").groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("utterances"))
ORACLES["filter_id"] = _with(_DOC, "SELECT file, speaker, count(*) AS utterances FROM sen WHERE lang = 'de' GROUP BY ALL")
QUERIES["filter_role"] = lambda s, d: filters.with_role(_sentences(s, d), _ids(s, d), ["mother"]).groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("utterances"))
ORACLES["filter_role"] = _with(_DOC, "SELECT file, speaker, count(*) AS utterances FROM sen WHERE lang = 'en' GROUP BY ALL")

# Transforms.
_add("tr_lowcase", lambda t: word_forms.lower_case(t).select("file", "utt_idx", F.array_join("cw", " ").alias("words")), _with(_UTT, "SELECT file, utt_idx, array_to_string(list_transform(cw, lambda x: CASE WHEN x = 'I' THEN x ELSE lower(x) END), ' ') AS words FROM utt"))
_add("tr_chstring", lambda t: word_forms.changed_strings(t, [("th", "TH"), ("THe", "de")]).select("file", "utt_idx", F.array_join("cw", " ").alias("words")), _with(_UTT, "SELECT file, utt_idx, array_to_string(list_transform(cw, lambda x: replace(replace(x, 'th', 'TH'), 'THe', 'de')), ' ') AS words FROM utt"))
_add("tr_compound", lambda t: word_forms.compounds(word_forms.changed_strings(t, [("ea", "a-e")])).select("file", "utt_idx", F.array_join("cw", " ").alias("words")), _with(_UTT, r"SELECT file, utt_idx, array_to_string(list_transform(list_transform(cw, lambda x: replace(x, 'ea', 'a-e')), lambda x: CASE WHEN regexp_matches(x, '^\p{L}+(-\p{L}+)+$') THEN replace(x, '-', '+') ELSE x END), ' ') AS words FROM utt"))
_add("tr_delim", lambda t: word_forms.with_terminator(t).select("file", "utt_idx", "terminator"), _with(_UTT, r"SELECT file, utt_idx, coalesce(nullif(regexp_extract(text, '([.?!])\s*$', 1), ''), '.') AS terminator FROM utt"))
_add("tr_flo", word_forms.plain_tier, _with(_UTT, r"SELECT file, utt_idx, speaker, array_to_string(cw, ' ') || ' ' || coalesce(nullif(regexp_extract(text, '([.?!])\s*$', 1), ''), '.') AS flo FROM utt"))
_add("tr_retrace", lambda t: tier_forms.with_copy(t.withColumn("tiers", F.array(F.struct(F.lit("com").alias("label"), F.lit("x").alias("content"))))).select("file", "utt_idx", F.transform("tiers", lambda x: F.concat_ws(":", x["label"], F.substring(x["content"], 1, 9)))[0].alias("first"), F.size("tiers").alias("n")), _with(_UTT, "SELECT file, utt_idx, 'ret:' || substr(text, 1, 9) AS first, 2 AS n FROM utt"))
_add("tr_repeat", lambda t: word_forms.marked_repeats(t.withColumn("postcodes", F.array().cast("array<string>")), "user", ("[//]", "the")).select("file", "utt_idx", F.array_join("postcodes", ",").alias("codes")), _with(_UTT, "SELECT file, utt_idx, CASE WHEN speaker = 'user' AND contains(text, 'the') THEN 'rep' ELSE '' END AS codes FROM utt"))
_add("tr_roles", lambda t: word_forms.renamed_speakers(t, {"user": "CHI", "assistant": "MOT"}).groupBy("speaker").agg(F.count(F.lit(1)).alias("turns")), _with(_UTT, "SELECT CASE speaker WHEN 'user' THEN 'CHI' WHEN 'assistant' THEN 'MOT' ELSE speaker END AS speaker, count(*) AS turns FROM utt GROUP BY ALL"))


def _four_tiers(t: DataFrame) -> DataFrame:
    pair = lambda label, content: F.struct(F.lit(label).alias("label"), content.alias("content"))
    return t.withColumn("tiers", F.array(pair("com", F.col("speaker")), pair("gra", F.lit("g")), pair("com", F.col("file")), pair("mor", F.lit("m")), pair("xyz", F.lit("z"))))


_shown = lambda t: t.select("file", "utt_idx", F.array_join(F.transform("tiers", lambda x: F.concat_ws("=", x["label"], x["content"])), ";").alias("tiers"))
_add("tr_combtier", lambda t: _shown(tier_forms.combined(_four_tiers(t), "com", "/")), _with(_UTT, "SELECT file, utt_idx, 'com=' || speaker || '/' || file || ';gra=g;mor=m;xyz=z' AS tiers FROM utt"))
_add("tr_tierorder", lambda t: _shown(tier_forms.ordered(_four_tiers(t))), _with(_UTT, "SELECT file, utt_idx, 'mor=m;gra=g;com=' || speaker || ';com=' || file || ';xyz=z' AS tiers FROM utt"))
_add("tr_trim", lambda t: _shown(tier_forms.trimmed(_four_tiers(t), exclude=["com", "mor"])), _with(_UTT, "SELECT file, utt_idx, 'gra=g;xyz=z' AS tiers FROM utt"))
_add("tr_trim_include", lambda t: _shown(tier_forms.trimmed(_four_tiers(t), include=["gra"])), _with(_UTT, "SELECT file, utt_idx, 'gra=g' AS tiers FROM utt"))


def _file_lines(t: DataFrame) -> DataFrame:
    header = F.col("utt_idx") == 1
    return t.select("file", F.col("utt_idx").alias("line_no"), F.when(header, F.concat(F.lit("@Begin "), "speaker")).otherwise(F.concat(F.lit("*"), "speaker", F.lit(":\t"), F.replace("text", F.lit("\n"), F.lit(" ")))).alias("line"))


_add("tr_lines", lambda t: tier_forms.numbered(_file_lines(t)), _with(_UTT, r"SELECT file, utt_idx AS line_no, CASE WHEN utt_idx = 1 THEN '@Begin ' || speaker ELSE lpad(CAST(utt_idx - 1 AS VARCHAR), 5, ' ') || ' *' || speaker || ':' || chr(9) || replace(text, chr(10), ' ') END AS line FROM utt"))
_add("tr_lines_remove", lambda t: tier_forms.without_numbers(tier_forms.numbered(_file_lines(t))), _with(_UTT, r"SELECT file, utt_idx AS line_no, CASE WHEN utt_idx = 1 THEN '@Begin ' || speaker ELSE '*' || speaker || ':' || chr(9) || replace(text, chr(10), ' ') END AS line FROM utt"))
_add("tr_longtier", lambda t: t.select("file", "utt_idx", tier_forms.unfolded(F.replace("text", F.lit(". "), F.lit(".\n\t"))).alias("text")), _with(_UTT, r"SELECT file, utt_idx, regexp_replace(regexp_replace(text, '\n+\t+', ' ', 'g'), '\n{2,}', chr(10), 'g') AS text FROM utt"))
_add("tr_dataclean", lambda t: t.select("file", "utt_idx", tier_forms.cleaned(F.concat(F.lit("*"), "speaker", F.lit(": "), F.replace(F.replace("text", F.lit(", "), F.lit("[x]")), F.lit("."), F.lit("...")))).alias("line")).withColumn("line", F.substring("line", 1, 40)), _with(_UTT, r"""
SELECT file, utt_idx, substr(replace(regexp_replace(regexp_replace('*' || speaker || ': ' || replace(replace(text, ', ', '[x]'), '.', '...'), '(\S)\[', '\1 [', 'g'), '\]([^\s])', '] \1', 'g'), '...', '+...'), 1, 40) AS line FROM utt"""))
QUERIES["tr_dates"] = lambda s, d: tier_forms.ages(
    (o := read(s, d, "orders")).select(F.col("o_orderkey").cast("string").alias("file"), F.lit("15-MAR-2001").alias("value")), o.select(F.col("o_orderkey").cast("string").alias("file"), F.lit("CHI").alias("speaker"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("value"))
)
ORACLES["tr_dates"] = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, CAST(o_orderdate AS DATE) AS b, DATE '2001-03-15' AS d FROM orders),
m AS (SELECT file, (year(d) - year(b)) * 12 + month(d) - month(b) - CASE WHEN day(d) < day(b) THEN 1 ELSE 0 END AS m, day(d) - day(b) + CASE WHEN day(d) < day(b) THEN 28 ELSE 0 END AS k FROM o WHERE d >= b)
SELECT file, 'CHI' AS speaker, format('Age of CHI is {};{:02d}.{:02d}', m // 12, m % 12, k) AS comment FROM m"""
_LEXICON = [("THE", "ðə", 0), ("THE", "ði", 1), ("OF", "əv", 0), ("AND", "ænd", 0)]


def _lexicon(all_forms: bool) -> Query:
    return lambda s, d: word_forms.lexicon_tier(_turns(s, d), s.createDataFrame(_LEXICON, "word string, form string, k int"), all_forms)


QUERIES["tr_makemod"] = _lexicon(False)
ORACLES["tr_makemod"] = _with(_TOK, "SELECT file, utt_idx, string_agg(CASE upper(word) WHEN 'THE' THEN 'ðə' WHEN 'OF' THEN 'əv' WHEN 'AND' THEN 'ænd' ELSE '???' END, ' ' ORDER BY pos) AS mod FROM tok GROUP BY ALL")
QUERIES["tr_makemod_all"] = _lexicon(True)
ORACLES["tr_makemod_all"] = _with(_TOK, "SELECT file, utt_idx, string_agg(CASE upper(word) WHEN 'THE' THEN 'ðə^ði' WHEN 'OF' THEN 'əv' WHEN 'AND' THEN 'ænd' ELSE '???' END, ' ' ORDER BY pos) AS mod FROM tok GROUP BY ALL")
QUERIES["tr_ort"] = lambda s, d: word_forms.respelled(_turns(s, d), s.createDataFrame([("the", "THE"), ("of", "uv")], "word string, spelling string"))
ORACLES["tr_ort"] = _with(_TOK, "SELECT file, utt_idx, string_agg(CASE lower(word) WHEN 'the' THEN 'THE' WHEN 'of' THEN 'uv' ELSE word END, ' ' ORDER BY pos) AS words, CASE WHEN bool_or(lower(word) IN ('the', 'of')) THEN string_agg(word, ' ' ORDER BY pos) END AS ort FROM tok GROUP BY ALL")
_add("tr_gem", lambda t: tier_forms.in_gem(t.select("file", F.col("utt_idx").alias("line_no"), F.when(F.col("utt_idx") == 1, "header").otherwise("line").alias("kind"), F.lit("Play").alias("label"), F.when(F.col("utt_idx") == 3, 1).when(F.col("utt_idx") == 5, -1).otherwise(0).alias("step")), ["play"]).select("file", "line_no"), _with(_UTT, "SELECT file, utt_idx AS line_no FROM utt WHERE utt_idx IN (1, 3, 4)"))
_add("tr_fixbullets", lambda t: tier_forms.shifted(t, 5), f"""WITH {_EV},
o AS (SELECT file, utt_idx, start_ms + 5 AS s, end_ms + 5 AS e, row_number() OVER (PARTITION BY file ORDER BY utt_idx) AS i FROM ev WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
l AS (SELECT *, 2 * i + greatest(-1, max(greatest(e, s + 1) - 2 * i) OVER (PARTITION BY file ORDER BY i)) AS last FROM o)
SELECT file, utt_idx, greatest(s, coalesce(lag(last) OVER (PARTITION BY file ORDER BY i), -1) + 1) AS start_ms, last AS end_ms FROM l""", _events)
_add("tr_postmortem", lambda t: t.select("file", "utt_idx", word_forms.postmortem(F.lower(F.array_join("cw", " ")), [("of the", "of_the"), ("the * of", "the $- uv")]).alias("mor")))
_add("tr_quotes", lambda t: tier_forms.no_quote_postcode(t.withColumn("postcodes", F.array(F.lit("x")))).select("file", "utt_idx"), _with(_UTT, "SELECT file, utt_idx FROM utt"))
_add("tr_indent", lambda t: tier_forms.indented(t.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("utt_idx", F.concat(F.lit("*"), "speaker", F.lit(":\t"), F.element_at(F.array(F.lit("ab ⌈cd⌉"), F.lit("⌊ef⌋"), F.lit("gh")), (F.col("utt_idx") % 3 + 1).cast("int"))).alias("line")))), lambda x: x["line"]), "\n").alias("text"))))

# Converters.
_files = lambda s, d: read(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
_add("cv_text2chat", lambda f: conv.from_text(f).groupBy("file", "terminator").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.char_length("text")).alias("chars")), r"""
WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^.?!]+[.?!]?'), lambda x: trim(x)), lambda x: regexp_matches(x, '[^.?!\s]'))) AS s FROM documents)
SELECT file, coalesce(nullif(regexp_extract(s, '[.?!]$', 0), ''), '.') AS terminator, count(*) AS turns, sum(length(trim(regexp_replace(s, '[.?!]$', '')))) AS chars FROM p GROUP BY ALL""", _files)
_add("cv_chat2text", lambda t: export.plain(t, speakers=True), _with(_UTT, "SELECT file, utt_idx, speaker || ': ' || array_to_string(cw, ' ') AS line FROM utt WHERE len(cw) > 0"))
_said = lambda t: t.withColumn("text", F.concat_ws(" ", "speaker", F.element_at("cod", 1)))
_clock = lambda ms, point: f"format('{{:02d}}:{{:02d}}:{{:02d}}{point}{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
_add("cv_chat2srt", lambda t: export.subtitles(_said(t)), _with(_EV, f"SELECT file, utt_idx AS n, utt_idx || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || speaker || ' ' || code AS block FROM ev"), _events)
_add("cv_chat2vtt", lambda t: export.subtitles(_said(t), vtt=True), _with(_EV, f"SELECT file, utt_idx AS n, {_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10) || speaker || ' ' || code AS block FROM ev"), _events)
_add("cv_srt2chat", lambda t: conv.from_srt(export.whole(export.subtitles(_said(t)))), _with(_EV, "SELECT file, utt_idx, 'SPK' AS speaker, speaker || ' ' || code AS text, start_ms, end_ms FROM ev"), _events)
_add("cv_lab2chat", lambda t: conv.from_lab(t.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("utt_idx", F.concat_ws(" ", F.col("utt_idx").cast("string"), F.when(F.col("utt_idx") % 4 == 0, "sil").otherwise(F.element_at("cod", 1))).alias("l")))), lambda x: x["l"]), "\n").alias("text"))), _with(_EV, """
SELECT file, row_number() OVER (PARTITION BY file ORDER BY utt_idx) AS utt_idx, 'SPK' AS speaker, code AS text, utt_idx * 1000 AS start_ms, (utt_idx + 1) * 1000 AS end_ms FROM ev WHERE utt_idx % 4 <> 0"""), _events)
_line = lambda t, sep, *cols: t.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("utt_idx", F.concat_ws(sep, *cols).alias("l")))), lambda x: x["l"]), "\n").alias("text"))
_add("cv_play2chat", lambda t: conv.from_play(_line(t, "\t", "speaker", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.element_at("cod", 1))), _with(_EV, "SELECT file, utt_idx, speaker, code AS text, start_ms, end_ms FROM ev"), _events)
_add("cv_lipp2chat", lambda t: conv.from_lipp(_line(t, "\t", F.element_at("cod", 1), F.upper("speaker"))), _with(_EV, "SELECT file, utt_idx, 'CHI' AS speaker, code AS text, speaker AS pho FROM ev"), _events)
_add("cv_salt2chat", lambda t: conv.from_salt(_line(t, " ", F.element_at(F.array(F.lit("C"), F.lit("E"), F.lit("$")), (F.col("utt_idx") % 3 + 1).cast("int")), F.concat(F.element_at("cod", 1), F.lit("/s (um) to_go*")), F.lit("now?"))), _with(_EV, """
SELECT file, row_number() OVER (PARTITION BY file ORDER BY utt_idx) AS utt_idx, CASE utt_idx % 3 WHEN 0 THEN 'CHI' ELSE 'EXA' END AS speaker, code || ' to+go now' AS text, '?' AS terminator FROM ev WHERE utt_idx % 3 <> 2"""), _events)
_add("cv_rtf2chat", lambda t: conv.from_rtf(_line(t, "", F.lit(r"\par *"), "speaker", F.lit(r":\tab "), F.element_at("cod", 1), F.lit(" .")).withColumn("text", F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}"), "text", F.lit("}")))), _with(_EV, "SELECT file, utt_idx, speaker, code || ' .' AS text FROM ev"), _events)
_add("cv_chat2elan", lambda t: export.eaf(_said(t)), None, _events)
_add("cv_elan2chat", lambda t: conv.from_eaf(export.eaf(_said(t))), _with(_EV, "SELECT file, row_number() OVER (PARTITION BY file ORDER BY start_ms, speaker, utt_idx) AS utt_idx, speaker, speaker || ' ' || code AS text, start_ms, end_ms FROM ev"), _events)
_add("cv_chat2praat", lambda t: export.textgrid(_said(t)), None, _events)
_add("cv_praat2chat", lambda t: conv.from_textgrid(export.textgrid(_said(t).withColumns({"start_ms": F.col("utt_idx") * 2000, "end_ms": F.col("utt_idx") * 2000 + 1500}))), _with(_EV, "SELECT file, utt_idx, speaker, speaker || ' ' || code AS text, utt_idx * 2000 AS start_ms, utt_idx * 2000 + 1500 AS end_ms FROM ev"), _events)
_add("cv_lena2chat", lambda t: conv.from_its(_line(t, "", F.lit('<Segment spkr="'), F.element_at(F.array(F.lit("CHN"), F.lit("FAN"), F.lit("SIL"), F.lit("XYZ")), (F.col("utt_idx") % 4 + 1).cast("int")), F.lit('" startTime="PT'), F.col("utt_idx").cast("string"), F.lit('.25S" endTime="PT1M'), F.col("utt_idx").cast("string"), F.lit('S"/>'))), _with(_EV, """
SELECT file, row_number() OVER (PARTITION BY file ORDER BY utt_idx) AS utt_idx, CASE utt_idx % 4 WHEN 0 THEN 'CHI' WHEN 1 THEN 'MOT' ELSE 'UNK' END AS speaker, 'xxx' AS text, utt_idx * 1000 + 250 AS start_ms, 60000 + utt_idx * 1000 AS end_ms FROM ev WHERE utt_idx % 4 <> 2"""), _events)
_add("cv_chat", lambda t: export.chat(t).select("file", F.char_length("text").alias("chars"), F.size(F.split("text", "\n\\*")).alias("parts")), _with(_UTT, r"""
, b AS (SELECT file, string_agg('*' || speaker || ':' || chr(9) || text || ' ' || coalesce(nullif(regexp_extract(text, '([.?!])\s*$', 1), ''), '.'), chr(10) ORDER BY utt_idx) AS body FROM utt GROUP BY file),
s AS (SELECT file, string_agg(speaker || ' Participant', ', ' ORDER BY speaker) AS people, string_agg('@ID:' || chr(9) || 'eng|corpus|' || speaker || '|||||Participant|||', chr(10) ORDER BY speaker) AS ids FROM (SELECT DISTINCT file, speaker FROM utt) GROUP BY file),
t AS (SELECT file, concat_ws(chr(10), '@UTF8', '@Begin', '@Languages:' || chr(9) || 'eng', '@Participants:' || chr(9) || people, ids, body, '@End' || chr(10)) AS text FROM b JOIN s USING (file))
SELECT file, length(text) AS chars, len(string_split(text, chr(10) || '*')) AS parts FROM t"""))

# Checks.
_declared = lambda t: t.select("file", "speaker").unionByName(t.where("utt_idx = 1").select("file", F.lit("GHO").alias("speaker")))
_add("check_unused_speakers", lambda t: checks.unused_speakers(_declared(t), t), _with(_UTT, "SELECT file, 'GHO' AS speaker FROM utt WHERE utt_idx = 1"))
_add("check_undeclared_speakers", lambda t: checks.undeclared_speakers(_declared(t).where("speaker <> 'user'"), t), _with(_UTT, "SELECT file, speaker, min(utt_idx) AS utt_idx FROM utt WHERE speaker = 'user' GROUP BY ALL"))
_add("check_duplicate_speakers", lambda t: checks.duplicate_speakers(_declared(t)), _with(_UTT, "SELECT file, speaker, count(*) AS times FROM utt GROUP BY ALL HAVING count(*) > 1"))
_add("check_media", lambda t: checks.media_names(t.select("file", F.lit("Media").alias("kind"), F.concat(F.when(F.col("utt_idx") % 2 == 0, F.col("file")).otherwise("other"), F.lit(", audio")).alias("value"))), _with(_UTT, "SELECT file, 'other' AS media FROM utt WHERE utt_idx % 2 = 1"))
