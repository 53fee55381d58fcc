"""Licence scan: ordered signature rules, in DataFrame functions alone.

Texts with none of the gate stems are left alone. The others become normalised
text, in which each word stands between a blank and a semicolon. Each rule whose keyword is there is
matched, its matches are marked, and the marks' places among the words are the detections. Then
detections are gone through by place: one that lies inside an earlier one of the same or a more
certain priority falls to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import LOWER, UPPER, ascii_lower, own_name
from parlance.llm.license_rules import BASE, GATES, SCORES, Rule, all_rules, compiled

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_OPEN, _CLOSE = "\x01", "\x02"
_LEAST = min(SCORES)
_MOST = max(SCORES)


def _rules_by_keyword(rules: list[Rule]) -> tuple[Column, Column]:
    """The keywords, and the rules as a map from keyword to an array of structs: constants of the plan."""
    by: dict[str, list[str]] = {}
    for k, r in enumerate(rules):
        by.setdefault(r.keyword, []).append(f"struct({k} AS k, {r.priority} AS p, '{r.label}' AS label, '{r.regex}' AS regex)")
    pairs = ", ".join(f"'{word}', array({', '.join(own)})" for word, own in by.items())
    return F.array(*map(F.lit, by)), F.expr(f"map({pairs})")


def _once(value: Column, then) -> Column:
    """then(value), with value computed once: a lambda over an array of one element."""
    return F.transform(F.array(value), then)[0]


def _marked(norm: Column, regex: Column | str) -> Column:
    """Matches of regex as an array of structs s, e: first word and the word behind the last, from 0."""
    words = F.split(F.regexp_replace(norm, F.lit(regex) if isinstance(regex, str) else regex, F.lit(f"{_OPEN}$0{_CLOSE}")), ";")

    def places(w: Column) -> Column:
        at = lambda mark: F.filter(F.transform(w, lambda x, i: F.when(F.contains(x, F.lit(mark)), i)), lambda i: i.isNotNull())
        return F.zip_with(at(_OPEN), at(_CLOSE), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    return _once(words, places)


def _survivors(found: Column) -> Column:
    """Detections (s, longer, p, k, label) in order, without those inside an earlier one that is at least as certain."""
    start = lambda all_: F.struct(F.array_repeat(F.lit(-1), _MOST).alias("ends"), F.slice(all_, 1, 0).alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end = -d["longer"]
        falls = F.element_at(state["ends"], d["p"]) >= end
        # The furthest end among detections of each priority or a more certain one.
        ends = F.transform(state["ends"], lambda x, i: F.when(i + 1 >= d["p"], F.greatest(x, end)).otherwise(x))
        return F.when(falls, state).otherwise(F.struct(ends.alias("ends"), F.concat(state["kept"], F.array(d)).alias("kept")))

    return _once(found, lambda all_: F.aggregate(all_, start(all_), step, lambda state: state["kept"]))


def scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", column: str = "license_scan") -> DataFrame:
    """Adds column: the places of the base phrases and the detections that stay, null for texts that fail the gate.

    It is a struct of base (array of s, e, label) and found (array of s, longer, p, k, label: first word,
    minus the word behind the last, priority and number of the rule, its label). A null or empty text
    fails the gate. Every row gives one row; its other columns stay, and underscores tell the new one's name from theirs.
    """
    column = own_name(docs, column)
    rules = all_rules() if rules is None else rules
    given = F.coalesce(F.col(text), F.lit(""))

    def gate(low: Column) -> Column:
        out = low.rlike(f"cc{_BREAK}+by")
        for stem in GATES:
            out = F.contains(low, F.lit(stem)) | out
        return out

    def place(n: Column, label: str, pattern: str) -> Column:
        return F.transform(_marked(n, compiled(pattern)), lambda d: F.struct(d["s"].alias("s"), d["e"].alias("e"), F.lit(label).alias("label")))

    keywords, rules_of = _rules_by_keyword(rules)

    def detections(n: Column, words: Column) -> Column:
        near = F.flatten(F.transform(F.array_intersect(words, keywords), lambda w: F.element_at(rules_of, w)))
        hit = F.filter(near, lambda r: F.rlike(n, r["regex"]))
        spans = F.transform(hit, lambda r: F.transform(_marked(n, r["regex"]), lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("longer"), r["p"].alias("p"), r["k"].alias("k"), r["label"].alias("label"))))
        return _survivors(F.array_sort(F.flatten(spans)))

    def seen(words: Column) -> Column:
        norm = F.concat(F.lit(" "), F.array_join(words, "; "), F.lit(";"))
        return _once(norm, lambda n: F.struct(F.concat(*(place(n, label, p) for label, p in BASE)).alias("base"), detections(n, words).alias("found")))

    words = F.filter(F.split(ascii_lower(given), f"{_BREAK}+"), lambda w: w != "")
    return docs.withColumn(column, F.when(_once(F.lower(given), gate), _once(words, seen)))


def license_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document.

    Words are runs of digits, letters and characters outside ASCII, A-Z lower-cased. The base phrases'
    places are all counted; labels are theirs and those of the rules' detections that stay, sorted and
    joined by commas. score: that of the most certain detection, 0 without one.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")

    def row(s: Column) -> Column:
        starts, base_labels = F.transform(s["base"], lambda d: d["s"].cast("long")), F.transform(s["base"], lambda d: d["label"])
        certain, score = F.array_min(F.transform(s["found"], lambda d: d["p"])), F.lit(0.0)
        for p, value in SCORES.items():
            score = F.when(certain == p, F.lit(value)).otherwise(score)
        return F.struct(
            F.size(s["base"]).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
            joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, F.transform(s["found"], lambda d: d["label"]))).alias("labels"), score.alias("score"),
        )

    scanned = scan(narrow)
    rows = scanned.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"), F.when(F.col("license_scan").isNotNull(), _once(F.col("license_scan"), row)).alias("r"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("r.n_base", F.lit(0).cast("long")).alias("n_base"), "r.first_word", "r.last_word",
        F.coalesce("r.base_labels", F.lit("")).alias("base_labels"), F.coalesce("r.labels", F.lit("")).alias("labels"), F.coalesce("r.score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in SQL, over a table of the rules."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ",\n".join(f"({k}, {r.priority}, {q(r.label)}, {q(' ' + r.keyword + ';')}, {q(r.regex)})" for k, r in enumerate(all_rules()))
    base = ",\n".join(f"({k}, {q(label)}, {q(compiled(p))})" for k, (label, p) in enumerate(BASE))
    score = " ".join(f"WHEN {p} THEN {v}" for p, v in SCORES.items())
    spans = r"""list_zip(
      list_filter(list_transform(range(len(w)), lambda i: CASE WHEN contains(w[i + 1], chr(1)) THEN i END), lambda i: i IS NOT NULL),
      list_filter(list_transform(range(len(w)), lambda i: CASE WHEN contains(w[i + 1], chr(2)) THEN i END), lambda i: i IS NOT NULL))"""
    marked = r"string_split(regexp_replace(norm, regex, chr(1) || '\0' || chr(2), 'g'), ';')"
    return rf"""
WITH rules(k, p, label, word, regex) AS (VALUES {rules}),
base(k, label, regex) AS (VALUES {base}),
docs AS (
  SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w != '') AS words
  FROM documents),
norms AS MATERIALIZED (SELECT rid, doc_id, len(words) AS n_words, ' ' || array_to_string(words, '; ') || ';' AS norm FROM docs),
base_marked AS (SELECT rid, label, {marked} AS w FROM norms, base WHERE regexp_matches(norm, regex)),
base_found AS MATERIALIZED (SELECT rid, label, unnest({spans})[1] AS s FROM base_marked),
marked AS (SELECT rid, k, p, label, {marked} AS w FROM norms, rules WHERE contains(norm, word) AND regexp_matches(norm, regex)),
found AS MATERIALIZED (SELECT rid, k, p, label, unnest({spans}) AS d FROM marked),
ordered AS MATERIALIZED (SELECT rid, k, p, label, d[1] AS s, d[2] AS e, row_number() OVER (PARTITION BY rid ORDER BY d[1], -d[2], p, k) AS n FROM found),
kept AS MATERIALIZED (
  SELECT * FROM ordered a WHERE NOT EXISTS (SELECT 1 FROM ordered b WHERE b.rid = a.rid AND b.n < a.n AND b.p <= a.p AND b.e >= a.e)),
base_sums AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base_found GROUP BY rid),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base_found UNION SELECT rid, label FROM kept) GROUP BY rid),
scores AS (SELECT rid, CASE min(p) {score} END AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM norms LEFT JOIN base_sums USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN scores USING (rid)
"""
