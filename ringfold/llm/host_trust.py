"""URL filters: path rules first, and for the rest trust that spreads over the hosts' link graph.

Hosts of pages that a rule allows seed trust, hosts of blocked pages seed distrust, each by its
share of such pages. Trust follows links (personalised PageRank); distrust goes against them, to
those who link to blocked hosts. A host whose distrust exceeds threshold times its trust is blocked.

Edges are counted per pair of hosts, so a step is one join and one partial sum; a step's ranks are
written before the next. Ranks are sums of positive shares; what hosts without links hold goes back
to the seeds. Steps end when no new host was reached and ranks change by a millionth of the mass that
links move, at the latest some 85 steps after the last new host.

Defined results: a null url or one without :// has an empty host and path and fits no rule; the
empty host has no links and no seeds; hosts that nothing reaches are allowed; no pages, no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: (verdict, host and path). A rule fits its host and all subdomains; the longest that fits wins.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url.cast("string"), _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule of a list that is part of the plan; null if none fits."""
    tests = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n, share): of the links that leave the pages of src for other hosts, those to dst."""
    links = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_HREF), F.lit(1))).alias("to"),
    )
    counted = (
        links.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("to", "(?i)^https?:", ""))).alias("dst"))
        .where("src != dst and src != '' and dst != ''")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    out = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return counted.join(out, "src").select("src", "dst", "n", (F.col("n") / F.col("all")).alias("share"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, least: float = 1e-6) -> DataFrame:
    """(host, rank) by personalised PageRank from seeds (host, weight; weights sum to 1).

    least is the change, as a share of the mass that links move, at which it ends.
    """
    ranks = seeds.select("host", F.col("weight").alias("rank"))
    while True:
        sent = edges.join(ranks, F.col("src") == F.col("host")).groupBy("dst").agg(
            F.sum(F.col("rank") * F.col("share")).alias("got")
        )
        sent = stored(sent, "sent")  # it is summed first, and then joined
        moved = sent.agg(F.coalesce(F.sum("got"), F.lit(0.0))).first()[0]
        back = 1.0 - damping * moved  # the restart, and what hosts without links hold
        joined = seeds.join(sent, F.col("host") == F.col("dst"), "full_outer").select(
            F.coalesce("host", "dst").alias("host"),
            (F.coalesce("weight", F.lit(0.0)) * back + F.coalesce("got", F.lit(0.0)) * damping).alias("rank"),
        )
        following = stored(joined, "ranks")
        change, reached = (
            following.join(ranks.withColumnRenamed("rank", "was"), "host", "left")
            .agg(F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))), F.count(F.when(F.isnull("was"), 1)))
            .first()
        )
        ranks = following
        if not reached and (change or 0.0) <= max(least * moved, 1e-15):  # doubles tell no less apart
            return ranks


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each of pages (page_id, url, html)."""
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    of_rule = F.create_map(*(F.lit(x) for pair in verdicts.items() for x in pair))
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    ruled = parts.withColumn("by_rule", of_rule[F.col("rule")])
    judged = ruled.where("by_rule is not null and host != ''").groupBy("host").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allow"),
        F.count(F.when(F.col("by_rule") == "block", 1)).alias("block"),
    )
    judged = stored(judged, "seeds")
    edges = stored(host_edges(pages), "links")
    sums = judged.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    linked = not edges.isEmpty()

    def ranked(kind: str, name: str, over: DataFrame) -> DataFrame:
        share = F.col(kind) / F.lit(max(1, sums[kind] or 0))
        seeds = judged.where(F.col(kind) > 0).select("host", share.alias("weight"))
        found = spread(over, seeds) if linked and sums[kind] else seeds.withColumnRenamed("weight", "rank")
        return found.select("host", F.col("rank").alias(name))

    arriving = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    backward = edges.join(arriving, "dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share")
    )
    trust, distrust = ranked("allow", "trust", edges), ranked("block", "distrust", backward)
    blocked = (
        distrust.join(trust, "host", "left")
        .where(F.col("distrust") > F.coalesce("trust", F.lit(0.0)) * threshold)
        .select("host", F.lit("block").alias("by_host"))
    )
    return ruled.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict")
    )


#: Exact where pages link to no other host, as in the given tables: ranks are then the seeds' shares.
JUDGE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(verdict, rule, h, pre) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
m AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r
               WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)) AS hit FROM p),
s AS (SELECT host, count(*) FILTER (hit.verdict = 'allow') AS a, count(*) FILTER (hit.verdict = 'block') AS b
      FROM m WHERE host <> '' GROUP BY host),
v AS (SELECT host, b / (SELECT greatest(sum(b), 1) FROM s) > a / (SELECT greatest(sum(a), 1) FROM s) AS bad FROM s)
SELECT page_id, m.host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN v ON m.host = v.host
"""
