"""URL filter by link-graph propagation.

Rules judge the urls they fit. They also seed a graph of hosts: pages allowed by a rule give their host
trust, blocked ones distrust. Trust flows along links (personalised PageRank), distrust against them,
as a host that links to bad hosts is worse than one that bad hosts link to. A host and the host it
is a subdomain of are linked both ways. Urls without a rule get their host's verdict.

Masses are whole numbers, WHOLE for each page that seeds, and what a link passes on is rounded down once, after
multiplying: a result doesn't depend on the order in which partitions are summed up, and small shares of
large hosts aren't lost. What reaches a host without links goes on to the seeds. Each round passes on
PASSED percent, so ROUNDS, the least number that leaves less than UNSETTLED of the mass still on its way, doesn't
depend on the graph.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import LOWER, UPPER, ascii_lower, forget, kept, scratch, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
Rule = tuple[str, str, str]
ALLOW, BLOCK = "allow", "block"
#: The share that is passed on in percent, and what may be unsettled of the mass in the end.
PASSED, UNSETTLED = 85, 0.01
ROUNDS = math.ceil(math.log(UNSETTLED) / math.log(PASSED / 100))
#: Rounds between two that are written out.
TOGETHER = 3
#: The mass of a page that seeds. Products stay below 10^38 for up to 10^12 pages.
WHOLE = 10**12
#: A host is blocked from so many times as much distrust as trust on; parts of all trust that are told in the result.
RATIO, PARTS = 2, 10**9
_LINKS = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """Host and path of a url: both empty if it is null or has no ://."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def _longest_first(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(_rule_name(r)), _rule_name(r)))


def fitting_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(_longest_first(rules)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight of the links between hosts; pages has host and html."""
    out = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINKS), F.lit(1))))
    links = pages.where("host != ''").select(F.col("host").alias("src"), out.alias("dst")).withColumn("dst", ascii_lower("dst")).where("src != dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _subdomain_edges(hosts: DataFrame) -> DataFrame:
    """Edges both ways between each host and the one above it, up to two labels."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    above = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda k: F.struct(F.concat_ws(".", F.slice(labels, k + 1, n)).alias("low"), F.concat_ws(".", F.slice(labels, k + 2, n)).alias("high"))))
    steps = hosts.select(F.explode(above).alias("s")).select("s.low", "s.high").distinct()
    return steps.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(steps.select("high", "low")).withColumn("weight", F.lit(1).cast("long"))


def _whole(product: Column, by: Column) -> Column:
    """product / by, both whole numbers, rounded down exactly."""
    product, by = product.cast("decimal(38,0)"), by.cast("decimal(38,0)")
    return ((product - product % by) / by).cast("decimal(38,0)")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, and all_trust and all_distrust, the pages that seed. edges: src, dst, weight; seeds: host, allowed, blocked (numbers of pages).

    Some rounds at a time are written out: lineage stays short, and only sums by host and edge are moved.
    """
    ways = edges.select(F.lit(ALLOW).alias("kind"), "src", "dst", "weight").union(edges.select(F.lit(BLOCK), "dst", "src", "weight"))
    ways = written(ways.groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight")), "sums")
    given = seeds.select(F.lit(ALLOW).alias("kind"), "host", F.col("allowed").alias("pages")).union(seeds.select(F.lit(BLOCK), "host", "blocked")).where("pages > 0")
    total = given.groupBy("kind").agg(F.sum("pages").alias("total"))
    given = written(given.join(F.broadcast(total), "kind"), "seeds")
    # What has no link passes its mass to the host named '', which is none.
    sources = ways.groupBy("kind", "src").agg(F.sum("weight").alias("out_weight"))
    loose = given.select("kind", F.col("host").alias("src")).union(ways.select("kind", "dst")).distinct().join(sources, ["kind", "src"], "left_anti")
    one = F.lit(1).cast("long")
    ways = written(ways.join(sources, ["kind", "src"]).select("kind", "src", "dst", "weight", "out_weight").union(loose.select("kind", "src", F.lit(""), one, one)), "ways")
    mass = F.col("mass")
    now = given.select("kind", "host", (F.col("pages") * F.lit(WHOLE).cast("decimal(38,0)")).cast("decimal(38,0)").alias("mass"))
    start = given.select("kind", "host", _whole(F.col("pages").cast("decimal(20,0)") * F.lit(WHOLE // 100 * (100 - PASSED)), one).alias("mass"))
    stored = None
    for k in range(1, rounds + 1):
        sent = now.where("host != ''").withColumnRenamed("host", "src").join(ways, ["kind", "src"])
        sent = sent.select("kind", F.col("dst").alias("host"), _whole(mass * F.col("weight") * PASSED, F.col("out_weight").cast("decimal(38,0)") * 100).alias("mass"))
        back = given.join(F.broadcast(now.where("host = ''").select("kind", "mass")), "kind").select("kind", "host", _whole(mass * F.col("pages") * PASSED, F.col("total").cast("decimal(38,0)") * 100).alias("mass"))
        now = sent.union(start).union(back).groupBy("kind", "host").agg(F.sum("mass").cast("decimal(38,0)").alias("mass"))
        if k % TOGETHER == 0 or k == rounds:
            now = written(now, "masses")
            if stored is not None:
                forget(stored)
            stored = now
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, mass)), F.lit(0)).cast("decimal(38,0)")
    pages = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("total"))), F.lit(0)).cast("long")
    totals = total.agg(pages(ALLOW).alias("all_trust"), pages(BLOCK).alias("all_distrust"))
    return now.where("host != ''").groupBy("host").agg(of(ALLOW).alias("trust"), of(BLOCK).alias("distrust")).crossJoin(F.broadcast(totals))


def judge(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page (page_id, url, html).

    rule: host and path of the longest rule that fits, else null; verdict: its own, else the host's:
    block where its share of all distrust is above 0 and at least RATIO times that of all trust, else allow. trust and
    distrust: those shares in PARTS. A url that is null or
    without :// has an empty host and path, fits no rule but one of an empty host, and is allowed. Null
    html has no links; repeated rows give repeated rows; an empty table gives none. The rules are few
    enough to be part of the plan; masses are 0 for a host that nothing reaches.
    """
    with scratch(pages.sparkSession):
        return _judged(pages, rules, rounds)


def _judged(pages: DataFrame, rules: list[Rule], rounds: int) -> DataFrame:
    host, path = url_parts("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    by = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules, _rule_name)).withColumn("by_rule", fitting_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]))
    count = lambda v: F.count(F.when(F.col("by_rule") == v, 1))
    seeds = written(by.where("host != ''").groupBy("host").agg(count(ALLOW).alias("allowed"), count(BLOCK).alias("blocked")), "hosts")
    links = written(host_edges(rows), "links")
    hosts = seeds.select("host").union(links.select("dst")).distinct()
    masses = kept(propagate(links.union(_subdomain_edges(hosts)), seeds, rounds), "masses")
    out = by.drop("html").join(masses, "host", "left")
    zero = F.lit(0).cast("decimal(38,0)")
    trust, distrust, all_trust, all_distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero), F.col("all_trust"), F.col("all_distrust")
    own = F.when((distrust > 0) & (distrust * all_trust >= trust * (all_distrust * RATIO)), BLOCK).otherwise(ALLOW)
    parts = lambda mass, pages: F.coalesce(F.when(pages > 0, _whole(mass, F.greatest(pages, F.lit(1)).cast("decimal(38,0)") * (WHOLE // PARTS))).cast("long"), F.lit(0).cast("long"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), parts(trust, all_trust).alias("trust"), parts(distrust, all_distrust).alias("distrust"))


def oracle(rules: list[Rule], rounds: int = ROUNDS) -> str:
    """The same in SQL, each round written out."""

    def case(value) -> str:
        fits = "".join(f" WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in _longest_first(rules))
        return f"CASE{fits} ELSE NULL END"

    links = _LINKS.replace("'", "''")
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""m{k} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(mass) AS HUGEINT) AS mass FROM (
    SELECT w.kind, w.dst AS host, m.mass * w.weight * {PASSED} // (w.out_weight * 100) AS mass FROM m{k - 1} m JOIN ways w ON w.kind = m.kind AND w.src = m.host WHERE m.host != ''
    UNION ALL SELECT kind, host, pages * CAST({WHOLE // 100 * (100 - PASSED)} AS HUGEINT) FROM given
    UNION ALL SELECT g.kind, g.host, m.mass * g.pages * {PASSED} // (g.total * 100) FROM given g JOIN m{k - 1} m ON m.kind = g.kind WHERE m.host = '') GROUP BY kind, host)""")
    rounds_sql = ",\n".join(steps)
    return f"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS MATERIALIZED (SELECT *, {case(_rule_name)} AS rule, {case(lambda r: r[0])} AS by_rule FROM parts),
seeds AS (SELECT host, count(*) FILTER (by_rule = '{ALLOW}') AS allowed, count(*) FILTER (by_rule = '{BLOCK}') AS blocked FROM judged WHERE host != '' GROUP BY host),
links AS MATERIALIZED (
  SELECT src, dst, count(*) AS weight FROM (
    SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{links}', 1))), '{UPPER}', '{LOWER}') AS dst FROM judged WHERE host != '')
  WHERE src != dst GROUP BY src, dst),
hosts AS (SELECT host FROM seeds UNION SELECT dst FROM links),
labels AS (SELECT DISTINCT string_split(host, '.') AS l FROM hosts),
steps AS (
  SELECT DISTINCT array_to_string(l[k + 1:], '.') AS low, array_to_string(l[k + 2:], '.') AS high FROM (SELECT l, unnest(range(0, len(l) - 2)) AS k FROM labels)),
edges AS (SELECT src, dst, weight FROM links UNION ALL SELECT low, high, 1 FROM steps UNION ALL SELECT high, low, 1 FROM steps),
both_ways AS (
  SELECT kind, src, dst, sum(weight) AS weight FROM (
    SELECT '{ALLOW}' AS kind, src, dst, weight FROM edges UNION ALL SELECT '{BLOCK}', dst, src, weight FROM edges) GROUP BY kind, src, dst),
given AS MATERIALIZED (
  SELECT kind, host, pages, sum(pages) OVER (PARTITION BY kind) AS total FROM (
    SELECT '{ALLOW}' AS kind, host, allowed AS pages FROM seeds WHERE allowed > 0 UNION ALL SELECT '{BLOCK}', host, blocked FROM seeds WHERE blocked > 0)),
ways AS MATERIALIZED (
  SELECT kind, src, dst, weight, sum(weight) OVER (PARTITION BY kind, src) AS out_weight FROM both_ways
  UNION ALL SELECT kind, host, '', 1, 1 FROM (SELECT kind, host FROM given UNION SELECT kind, dst FROM both_ways) n WHERE NOT EXISTS (SELECT 1 FROM both_ways b WHERE b.kind = n.kind AND b.src = n.host)),
m0 AS MATERIALIZED (SELECT kind, host, pages * CAST({WHOLE} AS HUGEINT) AS mass FROM given),
{rounds_sql},
masses AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = '{ALLOW}'), 0) AS trust, coalesce(sum(mass) FILTER (kind = '{BLOCK}'), 0) AS distrust FROM m{rounds} WHERE host != '' GROUP BY host),
totals AS (SELECT coalesce(sum(pages) FILTER (kind = '{ALLOW}'), 0) AS all_trust, coalesce(sum(pages) FILTER (kind = '{BLOCK}'), 0) AS all_distrust FROM given)
SELECT CAST(page_id AS BIGINT) AS page_id, j.host AS host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > 0 AND distrust * all_trust >= {RATIO} * trust * all_distrust THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict,
  CAST(coalesce(trust // (greatest(all_trust, 1) * {WHOLE // PARTS}), 0) AS BIGINT) AS trust, CAST(coalesce(distrust // (greatest(all_distrust, 1) * {WHOLE // PARTS}), 0) AS BIGINT) AS distrust
FROM judged j CROSS JOIN totals LEFT JOIN masses m ON m.host = j.host
"""
