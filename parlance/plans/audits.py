"""Queries of audits, of lexical diversity by samples, of norms and of many patterns at once, and the same in SQL.

Terminators, linkers, languages and ages, which no table has, go by rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import diversity, interaction, lengths, linkers, norms, patterns, profiles
from parlance.plans.catalog import _CLASS, _EV, _MOR, _TOK, _UTT, _with, ORACLES as _CATALOG
from parlance.sources.tables import conversation_turns, event_turns, read, with_tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Terminators and linkers that turns get by their number and length.
_ENDS = [".", "?", "!", *linkers.TERMINATORS]
_LINKS = [["++"], ["+,"], ["+<"], ['+"'], ["+^"], ["+≈"], ["+≋"], ["+<", "++"], ["+<"], [], []]


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    n, size = F.col("utt_idx"), F.coalesce(F.size("cw"), F.lit(0))
    pick = lambda values, k: F.element_at(values, (k % (F.size(values)) + 1).cast("int"))
    ends = F.array(*map(F.lit, _ENDS))
    links = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in _LINKS))
    return conversation_turns(read(spark, folder, "conversations")).withColumns({"terminator": pick(ends, n * 7 + size), "linkers": pick(links, n * 3 + size * 5)})


_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_RULED = _UTT + f""",
r AS (SELECT file, utt_idx, speaker, {_list(_ENDS)}[(utt_idx * 7 + coalesce(len(cw), 0)) % {len(_ENDS)} + 1] AS t, [{", ".join(map(_list, _LINKS))}][(utt_idx * 3 + coalesce(len(cw), 0) * 5) % {len(_LINKS)} + 1] AS l FROM utt)"""
_same = "coalesce(b.speaker = r.speaker, false)"
_STATS = _RULED + f""",
seen AS (SELECT r.*, l[1] AS l1, l[2] AS l2, lag(speaker) OVER o AS ps, lag(t) OVER o AS pt, row_number() OVER o AS k, last_value(t) OVER (PARTITION BY file, speaker ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own,
  lag(CASE WHEN l[1] = '+<' THEN l[2] ELSE l[1] END) OVER (PARTITION BY file, speaker ORDER BY utt_idx) AS chain, coalesce(list_contains(l, '+<'), false) AS lazy FROM r WINDOW o AS (PARTITION BY file ORDER BY utt_idx)),
f AS (SELECT *, coalesce(ps = speaker, false) AS same, coalesce(pt IN ('+...', '+..?'), false) AS trailed, coalesce(pt IN ('+/.', '+/?'), false) AS cut, lazy AND NOT coalesce(lag(lazy) OVER (PARTITION BY file ORDER BY utt_idx), false) AS opens FROM seen),
g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY utt_idx) AS block FROM f),
blocks AS (SELECT file, count(*) AS lo_blocks, count(*) FILTER (n = 1) AS lo_block_size_1, count(*) FILTER (n = 2) AS lo_block_size_2, count(*) FILTER (n > 2) AS lo_block_size_3plus, max(s) AS lo_max_speakers_in_block
  FROM (SELECT file, block, count(*) AS n, count(DISTINCT speaker) AS s FROM g WHERE lazy GROUP BY ALL) GROUP BY file),
stats AS (SELECT file, count(*) AS utterances,
  {", ".join(f"count(*) FILTER (list_contains(l, '{k}')) AS linker_{n}" for k, n in linkers.LINKERS.items())},
  {", ".join(f"count(*) FILTER (t = '{k}') AS term_{n}" for k, n in linkers.TERMINATORS.items())},
  count(*) FILTER (list_contains(l, '++') AND k > 1 AND NOT same AND trailed) AS pp_correct, count(*) FILTER (list_contains(l, '++') AND same) AS pp_same_speaker,
  count(*) FILTER (list_contains(l, '++') AND k > 1 AND NOT same AND NOT trailed) AS pp_wrong_terminator, count(*) FILTER (list_contains(l, '++') AND k = 1) AS pp_first_utterance,
  count(*) FILTER (list_contains(l, '+,') AND own IN ('+/.', '+/?')) AS sc_correct, count(*) FILTER (list_contains(l, '+,') AND own NOT IN ('+/.', '+/?')) AS sc_wrong_terminator, count(*) FILTER (list_contains(l, '+,') AND own IS NULL) AS sc_no_prior,
  count(*) FILTER (list_contains(l, '+"') AND own = '+"/.') AS qf_correct, count(*) FILTER (list_contains(l, '+"') AND own <> '+"/.' AND chain = '+"') AS qf_chained,
  count(*) FILTER (list_contains(l, '+"') AND own <> '+"/.' AND chain IS DISTINCT FROM '+"') AS qf_wrong_terminator, count(*) FILTER (list_contains(l, '+"') AND own IS NULL) AS qf_no_prior,
  count(*) FILTER (opens AND same) AS lo_same_speaker_start, count(*) FILTER (lazy AND len(l) > 1) AS lo_combined_with_other,
  count(*) FILTER (list_contains(l, '+^') AND same) AS qu_same_speaker, count(*) FILTER (list_contains(l, '+^') AND NOT same) AS qu_diff_speaker,
  count(*) FILTER (list_contains(l, '+≋') AND same) AS tcu_tech_same_speaker, count(*) FILTER (list_contains(l, '+≋') AND NOT same) AS tcu_tech_diff_speaker,
  count(*) FILTER (list_contains(l, '+≈') AND same) AS tcu_nb_same_speaker, count(*) FILTER (list_contains(l, '+≈') AND NOT same) AS tcu_nb_diff_speaker,
  count(*) FILTER (t IN ('+...', '+..?')) AS trailing_off_total, count(*) FILTER (trailed AND (list_contains(l, '++') OR list_contains(l, '+,'))) AS trailing_off_followed,
  count(*) FILTER (t IN ('+/.', '+/?')) AS interruption_total, count(*) FILTER (cut AND list_contains(l, '+,')) AS interruption_followed FROM g GROUP BY file),
whole AS (SELECT s.*, coalesce(lo_blocks, 0) AS lo_blocks, coalesce(lo_block_size_1, 0) AS lo_block_size_1, coalesce(lo_block_size_2, 0) AS lo_block_size_2, coalesce(lo_block_size_3plus, 0) AS lo_block_size_3plus, coalesce(lo_max_speakers_in_block, 0) AS lo_max_speakers_in_block FROM stats s LEFT JOIN blocks USING (file))"""

QUERIES["linker_stats"] = lambda spark, folder: linkers.linker_stats(_linked(spark, folder))
ORACLES["linker_stats"] = _with(_STATS, "SELECT * FROM whole")

QUERIES["linker_summary"] = lambda spark, folder: linkers.linker_summary(linkers.linker_stats(_linked(spark, folder)))
_SUMS = """utterances pp_correct pp_same_speaker pp_wrong_terminator pp_first_utterance sc_correct sc_wrong_terminator sc_no_prior qf_correct qf_chained qf_wrong_terminator qf_no_prior lo_same_speaker_start lo_combined_with_other
qu_same_speaker qu_diff_speaker tcu_tech_same_speaker tcu_tech_diff_speaker tcu_nb_same_speaker tcu_nb_diff_speaker trailing_off_total trailing_off_followed interruption_total interruption_followed
lo_blocks lo_block_size_1 lo_block_size_2 lo_block_size_3plus""".split() + [f"linker_{n}" for n in linkers.LINKERS.values()] + [f"term_{n}" for n in linkers.TERMINATORS.values()]  # fmt: skip
ORACLES["linker_summary"] = _with(_STATS, f"""
SELECT count(*) AS files, count(*) FILTER (greatest({", ".join(linkers.SPECIAL)}) > 0) AS files_with_linkers, count(*) FILTER ({" + ".join(linkers.ANOMALIES)} > 0) AS files_with_anomalies,
  {", ".join(f"sum({c}) AS {c}" for c in _SUMS)}, max(lo_max_speakers_in_block) AS lo_max_speakers_in_block, round(sum(trailing_off_followed) / sum(trailing_off_total), 6) AS trailing_off_rate, round(sum(interruption_followed) / sum(interruption_total), 6) AS interruption_rate FROM whole""")

QUERIES["linker_pairs"] = lambda spark, folder: linkers.linker_pairs(_linked(spark, folder))
# Each linker with the last announcement that fits, looked up one by one.
ORACLES["linker_pairs"] = _with(_RULED, """
, a AS (SELECT file, utt_idx, speaker, CASE WHEN t IN ('+...', '+..?') THEN '++' WHEN t IN ('+/.', '+/?') THEN '+,' WHEN t = '+"/.' THEN '+"' END AS linker FROM r),
k AS (SELECT file, utt_idx, speaker, unnest(['++', '+,', '+"']) AS linker, l FROM r),
b AS (SELECT k.file, k.linker, k.utt_idx, max(a.utt_idx) AS back FROM (SELECT * FROM k WHERE list_contains(l, linker)) k LEFT JOIN a ON a.file = k.file AND a.linker = k.linker AND a.utt_idx < k.utt_idx AND (a.speaker <> k.speaker) = (k.linker = '++') GROUP BY ALL),
p AS (SELECT file, linker, CASE WHEN utt_idx = min(utt_idx) OVER (PARTITION BY file, linker, back) THEN back END AS announced_at, utt_idx AS taken_up_at FROM b)
SELECT * FROM p UNION ALL SELECT file, linker, utt_idx, NULL FROM a WHERE linker IS NOT NULL AND (file, linker, utt_idx) NOT IN (SELECT (file, linker, announced_at) FROM p WHERE announced_at IS NOT NULL)""")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_turns(read(spark, folder, "conversations"))


_P = diversity.P
# The same draws step by step, and places looked up among the words.
_DRAWN = _TOK.replace("utt AS (", "RECURSIVE utt AS (", 1) + f""",
c AS (SELECT speaker, word, count(*) AS count, substr(md5(word), 1, 2) AS bucket FROM tok GROUP BY ALL),
w AS (SELECT speaker, word, sum(count) OVER (PARTITION BY speaker ORDER BY bucket, word) - count AS low, sum(count) OVER (PARTITION BY speaker ORDER BY bucket, word) AS high FROM c),
t AS (SELECT speaker, sum(count)::BIGINT AS t FROM c GROUP BY speaker HAVING sum(count) >= 50),
d AS (
  SELECT speaker, t, trial, n, sample, 0::BIGINT AS k, []::BIGINT[] AS chosen FROM t, range(1, 4) a(trial), range(35, 51) b(n), range(1, 101) e(sample)
  UNION ALL
  SELECT speaker, t, trial, n, sample, k + 1, list_append(chosen, CASE WHEN list_contains(chosen, 1 + y % (t - n + k + 1)) THEN t - n + k + 1 ELSE 1 + y % (t - n + k + 1) END)
  FROM (SELECT *, (x * 16807 + x * x % {_P}) % {_P} AS y FROM (SELECT *, (v * 40692 + v * v % {_P}) % {_P} AS x FROM (SELECT *, ((((trial * 64 + n) * 128 + sample) * 64 + k + 1) * 48271 + 12345) % {_P} AS v FROM d WHERE k < n)))),
places AS (SELECT speaker, trial, n, sample, unnest(chosen) - 1 AS at_place FROM d WHERE k = n),
types AS (SELECT p.speaker, trial, n, sample, count(DISTINCT word) AS types FROM places p JOIN w ON w.speaker = p.speaker AND at_place >= low AND at_place < high GROUP BY ALL),
sums AS (SELECT speaker, trial, n, sum(types) AS s, sum(types * types) AS q FROM types GROUP BY ALL),
ratios AS (SELECT speaker, trial, n, s / 100 AS types, s / (n * 100) AS ttr, sqrt(greatest(0, q / 100 - (s / 100) * (s / 100))) / n AS sd FROM sums),
each AS (SELECT *, CASE WHEN ttr < 1 THEN 0.5::DOUBLE * n * ttr * ttr / (1 - ttr) ELSE 0 END AS d FROM ratios),
mean AS (SELECT speaker, trial, avg(d) AS d_average, stddev_pop(d) AS d_sd FROM each GROUP BY ALL),
tried AS (SELECT speaker, trial, d_average, d_sd, unnest(range(1 - CAST(ceil(d_average * 1000) AS BIGINT), CAST(ceil(d_average * 1000) AS BIGINT))) AS k FROM mean),
off AS (SELECT m.speaker, m.trial, k, sum(power(ttr - (d_average + k / 1000) / n * (sqrt(1 + 2 * n / (d_average + k / 1000)) - 1), 2)) AS error FROM tried m JOIN each USING (speaker, trial) GROUP BY ALL),
best AS (SELECT speaker, trial, min(error) AS error, arg_min(k, error) AS k FROM off GROUP BY ALL)"""
QUERIES["vocd_ratios"] = lambda spark, folder: diversity.sampled_ratios(_turns(spark, folder)).withColumns({c: F.round(c, 6) for c in ("types", "ttr", "sd", "d")})
ORACLES["vocd_ratios"] = _with(_DRAWN, "SELECT speaker, trial, n, round(types, 6) AS types, round(ttr, 6) AS ttr, round(sd, 6) AS sd, round(d, 6) AS d FROM each")
QUERIES["vocd_trials"] = lambda spark, folder: diversity.sampled_trials(diversity.sampled_ratios(_turns(spark, folder))).withColumns({c: F.round(c, 6) for c in ("d_average", "d_sd", "d_optimum", "error")})
ORACLES["vocd_trials"] = _with(_DRAWN, "SELECT speaker, trial, round(d_average, 6) AS d_average, round(d_sd, 6) AS d_sd, round(d_average + k / 1000, 6) AS d_optimum, round(error, 6) AS error FROM mean JOIN best USING (speaker, trial)")
QUERIES["vocd_sampled"] = lambda spark, folder: diversity.sampled_diversity(_turns(spark, folder))
ORACLES["vocd_sampled"] = _with(_DRAWN, "SELECT speaker, round(avg(d_average + k / 1000), 3) AS d FROM mean JOIN best USING (speaker, trial) GROUP BY speaker")

# The expected curve's D: tenths first, then thousandths around the best of them.
QUERIES["vocd_expected"] = lambda spark, folder: diversity.vocd(_turns(spark, folder))
_CURVE = _CATALOG["vocd_curve"].removeprefix("WITH ").replace("(VALUES (35), (50)) v(n)", "range(35, 51) v(n)").replace("SELECT speaker, n, round", ", curve AS (SELECT speaker, n, round").rstrip() + ")"
ORACLES["vocd_expected"] = f"""WITH {_CURVE},
coarse AS (SELECT speaker, k, sum(power(ttr - k / 10 / n * (sqrt(1 + 2 * n / (k / 10)) - 1), 2)) AS e FROM curve, range(1, 20001) r(k) GROUP BY ALL),
near AS (SELECT speaker, arg_min(k, e) AS k FROM coarse GROUP BY speaker),
fine AS (SELECT speaker, unnest(range(greatest(1, k * 100 - 200), k * 100 + 201)) AS k FROM near),
e AS (SELECT fine.speaker, k, sum(power(ttr - k / 1000 / n * (sqrt(1 + 2 * n / (k / 1000)) - 1), 2)) AS e FROM fine JOIN curve USING (speaker) GROUP BY ALL)
SELECT speaker, arg_min(k, e) / 1000 AS d FROM e GROUP BY speaker"""


# Norms: of two conversations in three the evaluations are the norms, the others are held against them; languages and ages go by number.
def _who(rows: DataFrame) -> DataFrame:
    c = F.col("file").cast("long")
    return rows.select("file", "speaker", F.when(c % 10 == 7, "xyz").when(c % 2 == 0, "ENG").otherwise("deu").alias("language"), F.when(c % 11 != 0, 24 + c * 7 % 90).cast("int").alias("age_months"))


def _eval_norms(spark: SparkSession, folder: str) -> DataFrame:
    found = profiles.evaluation(with_tiers(_turns(spark, folder)).where("file is not null and speaker is not null"), ("file", "speaker"))
    is_norm = (F.col("file").cast("long") % 3 > 0) & (F.col("file").cast("long") % 10 != 7)
    entries = norms.as_norms(found.where(is_norm)).join(_who(found), ["file", "speaker"])
    rest = found.where(~is_norm)
    return norms.against_norms(rest, _who(rest), entries, widths=(2, 5), least=4)


_FIELDS = [(m.label, m.field) for m in norms.EVAL]
QUERIES["eval_norms"] = _eval_norms
# Cohorts by comparing each speaker with every norm.
ORACLES["eval_norms"] = _with(_MOR, f"""
, c AS (SELECT file, speaker, feat, {_CLASS} AS k FROM each), ut AS (SELECT file, speaker, count(*) AS utterances, sum(len(cw)) AS words FROM utt WHERE len(cw) > 0 GROUP BY ALL), ty AS (SELECT file, speaker, count(DISTINCT lower(word)) AS different_words FROM tok GROUP BY ALL),
e0 AS (SELECT file, speaker, any_value(utterances) AS utterances, any_value(words) AS words, CAST(count(*) + count(feat) AS BIGINT) AS morphemes, 0 AS word_errors,
  {', '.join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in ('noun', 'aux', 'verb', 'mod', 'prep', 'adj', 'adv', 'conj', 'det', 'pron'))},
  count(*) FILTER (feat = 'PL') AS plurals, count(*) FILTER (feat = 'PAST') AS past, count(*) FILTER (feat = 'PRESP') AS present_participle, 0 AS past_participle, any_value(different_words) AS different_words
  FROM c JOIN ut USING (file, speaker) JOIN ty USING (file, speaker) GROUP BY ALL),
e1 AS (SELECT *, round(words / utterances, 6) AS words_per_utterance, round(morphemes / utterances, 6) AS morphemes_per_utterance, CAST(file AS BIGINT) AS c FROM e0),
long AS (SELECT file, speaker, c, CASE WHEN c % 10 = 7 THEN 'xyz' WHEN c % 2 = 0 THEN 'eng' ELSE 'deu' END AS language, CASE WHEN c % 11 <> 0 THEN CAST(24 + c * 7 % 90 AS INTEGER) END AS age, c % 3 > 0 AND c % 10 <> 7 AS norm,
  unnest([{', '.join(f"{{'label': '{label}', 'score': CAST({field} AS DOUBLE)}}" for label, field in _FIELDS)}], recursive := true) FROM e1),
pairs AS (SELECT s.file, s.speaker, s.language, s.age, s.label, s.score, w.width, n.score AS other FROM (SELECT * FROM long WHERE NOT norm) s JOIN (SELECT * FROM long WHERE norm) n ON s.language = n.language AND s.label = n.label
  JOIN (VALUES (2), (5), (9999)) w(width) ON w.width = 9999 OR abs(s.age - n.age) <= w.width),
sums AS (SELECT file, speaker, label, width, count(*) AS n, avg(other) AS mean, coalesce(stddev_samp(other), 0) AS sd FROM pairs GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY file, speaker, label ORDER BY width) AS place FROM sums WHERE n >= 4 OR width = 9999)
SELECT s.file AS file, s.speaker AS speaker, language, age AS age_months, s.label AS label, round(score, 6) AS score, width, n AS entries, round(mean, 6) AS mean, round(sd, 6) AS sd, coalesce(n, 0) AS n, CASE WHEN round(sd, 9) > 0 THEN round((score - mean) / sd, 6) END AS z
FROM (SELECT * FROM long WHERE NOT norm) s LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON b.file = s.file AND b.speaker = s.speaker AND b.label = s.label""")


# Every beginning of two and three letters and every ending of two: near to nineteen thousand patterns.
_ABC = "abcdefghijklmnopqrstuvwxyz"
_TWO = [a + b for a in _ABC for b in _ABC]
QUERIES["patterns_many"] = lambda spark, folder: patterns.pattern_counts(_turns(spark, folder), [f"{x}*" for x in _TWO] + [f"*{x}" for x in _TWO] + [f"{x}{c}*" for x in _TWO for c in _ABC])
ORACLES["patterns_many"] = _with(_TOK, """
, l AS (SELECT speaker, lower(word) AS w FROM tok)
SELECT speaker, left(w, 2) || '*' AS pattern, count(*) AS count FROM l WHERE regexp_matches(w, '^[a-z]{2}') GROUP BY ALL
UNION ALL SELECT speaker, '*' || right(w, 2), count(*) FROM l WHERE regexp_matches(w, '[a-z]{2}$') GROUP BY ALL
UNION ALL SELECT speaker, left(w, 3) || '*', count(*) FROM l WHERE regexp_matches(w, '^[a-z]{3}') GROUP BY ALL""")
# Groups of different first letters: their matches never overlap, so SQL needs no recursion.
QUERIES["patterns_groups"] = lambda spark, folder: patterns.group_counts(_turns(spark, folder), [f"{a}* {b}*" for a in _ABC for b in _ABC if a != b] + [f"{a}* {b}* {c}*" for a in _ABC for b in _ABC for c in _ABC if len({a, b, c}) == 3])
ORACLES["patterns_groups"] = _with(_TOK, """
, l AS (SELECT speaker, left(lower(word), 1) AS a, left(lower(lead(word) OVER o), 1) AS b, left(lower(lead(word, 2) OVER o), 1) AS c FROM tok WINDOW o AS (PARTITION BY file, utt_idx ORDER BY pos)),
g AS (SELECT * FROM l WHERE regexp_matches(a, '^[a-z]') AND regexp_matches(b, '^[a-z]') AND a <> b)
SELECT speaker, a || '* ' || b || '*' AS "group", count(*) AS count FROM g GROUP BY ALL UNION ALL SELECT speaker, a || '* ' || b || '* ' || c || '*', count(*) FROM g WHERE regexp_matches(c, '^[a-z]') AND c <> a AND c <> b GROUP BY ALL""")
QUERIES["freq_with_groups"] = lambda spark, folder: patterns.frequency_with_groups(_turns(spark, folder), ["of the", "the w*"])
ORACLES["freq_with_groups"] = _with(_TOK, """
, l AS (SELECT speaker, lower(word) AS w, lower(lead(word) OVER (PARTITION BY file, utt_idx ORDER BY pos)) AS n FROM tok)
SELECT speaker, w AS word, count(*) AS count FROM l GROUP BY ALL UNION ALL SELECT speaker, 'of the', count(*) FROM l WHERE w = 'of' AND n = 'the' GROUP BY ALL UNION ALL SELECT speaker, 'the w*', count(*) FROM l WHERE w = 'the' AND n LIKE 'w%' GROUP BY ALL""")

QUERIES["maxwd_lengths"] = lambda spark, folder: lengths.word_lengths(_turns(spark, folder))
ORACLES["maxwd_lengths"] = _with(_TOK, "SELECT speaker, count(*) AS words, max(length(lower(word))) AS longest, round(avg(length(lower(word))), 6) AS mean FROM tok GROUP BY speaker")


def _half_timed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as turns, of which one speaker has no times and others lack some."""
    turns = event_turns(read(spark, folder, "events"))
    timed = (F.col("speaker") != "U3") & (F.col("utt_idx") % 4 > 0)
    return turns.withColumns({c: F.when(timed, F.col(c)) for c in ("start_ms", "end_ms")})


QUERIES["timedur_all"] = lambda spark, folder: lengths.durations_of_all(_half_timed(spark, folder))
ORACLES["timedur_all"] = _with(_EV, """
, d AS (SELECT speaker, CASE WHEN speaker <> 'U3' AND utt_idx % 4 > 0 THEN greatest(end_ms - start_ms, 0) END AS ms FROM ev)
SELECT speaker, count(*) AS utterances, count(ms) AS timed, coalesce(sum(ms), 0) AS total, min(ms) AS least, max(ms) AS most, CASE WHEN count(ms) > 0 THEN sum(ms) // count(ms) END AS mean FROM d GROUP BY speaker""")


def _overlapped(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with a top, a bottom or nothing by number, and times for some."""
    i = F.col("utt_idx")
    marked = F.concat(F.element_at(F.array(F.lit("⌈"), F.lit("⌊"), F.lit("")), (i % 3 + 1).cast("int")), F.lit("word"))
    return _turns(spark, folder).withColumns({"text": marked, "start_ms": F.when(i % 5 > 0, i * 1500), "end_ms": F.when(i % 5 > 0, i * 1500 + 700)})


QUERIES["overlap_summary"] = lambda spark, folder: interaction.overlap_summary(interaction.overlap_audit(_overlapped(spark, folder), tolerance=1000))
# Each bottom with the last top before it, looked up one by one; it fits if somebody else said that.
ORACLES["overlap_summary"] = _with(_UTT, """
, o AS (SELECT file, utt_idx, speaker, CASE WHEN utt_idx % 5 > 0 THEN utt_idx * 1500 END AS b, CASE WHEN utt_idx % 5 > 0 THEN utt_idx * 1500 + 700 END AS e, ['⌈', '⌊', ''][utt_idx % 3 + 1] AS m FROM utt),
k AS (SELECT o.file, o.utt_idx, o.speaker, o.b, o.e, (SELECT max(t.utt_idx) FROM o t WHERE t.file = o.file AND t.m = '⌈' AND t.utt_idx < o.utt_idx) AS at_top FROM o WHERE m = '⌊'),
p AS (SELECT k.*, t.utt_idx AS top, t.b AS tb, t.e AS te, coalesce(t.speaker <> k.speaker, false) AS fits FROM k LEFT JOIN o t ON t.file = k.file AND t.utt_idx = k.at_top),
f AS (SELECT u.file, (SELECT count(*) FROM o WHERE o.file = u.file AND m = '⌈') AS tops, (SELECT count(*) FROM o WHERE o.file = u.file AND m = '⌊') AS bottoms, (SELECT count(DISTINCT top) FROM p WHERE p.file = u.file AND fits) AS groups,
  (SELECT count(*) FROM p WHERE p.file = u.file AND NOT fits) AS orphan_bottoms, (SELECT count(*) FROM p WHERE p.file = u.file AND fits AND b IS NOT NULL AND tb IS NOT NULL) AS timed,
  (SELECT count(*) FROM p WHERE p.file = u.file AND fits AND b <= te + 1000 AND e >= tb - 1000) AS consistent FROM (SELECT DISTINCT file FROM utt) u),
q AS (SELECT *, tops - groups AS orphan_tops, tops - groups + orphan_bottoms AS alone FROM f)
SELECT count(*) AS files, count(*) FILTER (tops + bottoms > 0) AS files_with_overlaps, sum(tops) AS tops, sum(bottoms) AS bottoms, sum(groups) AS groups, sum(orphan_tops) AS orphan_tops, sum(orphan_bottoms) AS orphan_bottoms, sum(timed) AS timed, sum(consistent) AS consistent,
  count(*) FILTER (tops + bottoms > 0 AND alone = 0) AS fully_paired, count(*) FILTER (alone > 0 AND alone / greatest(1, groups + alone) > 0.8) AS open_only, count(*) FILTER (alone > 0 AND alone / greatest(1, groups + alone) <= 0.8) AS mixed,
  round(sum(groups) / sum(tops), 6) AS paired_share, round(sum(consistent) / sum(timed), 6) AS consistent_share FROM q""")
