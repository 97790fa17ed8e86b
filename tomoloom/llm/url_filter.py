"""Verdicts on urls: rules first, then trust and distrust that spread over edges between hosts.

Two hosts share an edge if a page of one links to the other, and a host has edges to and from the nearest known host
above it (`m.shop.example` and `shop.example`). However many pages repeat a link, it is one edge. Trust starts at every
host as the share of its pages that an allow rule fits and follows the edges (personalised PageRank); distrust starts as
the share that a block rule fits and follows them backwards, because who links to a blocked host is suspect. Shares are a
host's own, and no sum over all hosts enters, so another host's number of pages moves no verdict. Both walks run together,
over tables of one row per host, until what still moves is small beside what has settled. DataFrame operations only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Part of a host's weight that goes on along its edges.
DAMPING = 0.85
#: A host is blocked with at least so much distrust, and more than so many times its trust.
LEAST, RATIO = 0.05, 1.0
#: The walks end when no host's weight grew by more than this part of itself and of `LEAST` in a round.
TOLERANCE = 1e-3
#: Longest name of a host that can have one above it.
LONGEST_NAME = 253
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?is)href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule whose host or subdomain and path beginning fit; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, rule.name).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, r.verdict).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst: pairs of different hosts of which a page of the first links to the second.

    A link without a scheme (`//host/path`) counts; one without a host stays on its page's host and is no pair.
    """
    links = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))).alias("link"),
    )
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    found = links.select("src", host_of(full).alias("dst"))
    return found.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).distinct()


def hosts_above(hosts: DataFrame) -> DataFrame:
    """host, above: the longest name of another host in the table that ends the host's name after a dot."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.filter((F.instr("host", ".") > 0) & (F.length("host") <= LONGEST_NAME)).select("host", F.explode(ends).alias("above"))
    known = hosts.select(F.col("host").alias("above")).filter("above <> ''")
    return named.join(known, "above").groupBy("host").agg(F.max_by("above", F.length("above")).alias("above"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: links between hosts, and both ways between a host of a page or link and the nearest one above it."""
    links = materialize(host_links(pages))
    named = pages.select(host_of(F.col("url")).alias("host")).unionByName(
        links.select(F.explode(F.array("src", "dst")).alias("host"))
    )
    above = materialize(hosts_above(named.filter("host <> ''").distinct()))
    up = above.select(F.col("host").alias("src"), F.col("above").alias("dst"))
    return links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """walk, host, weight: a host's seed, and the damped weight that reaches it, split evenly over a host's edges.

    seeds: walk, host, weight; edges: walk, src, dst. A round sends on what the last one brought, until that is small.
    """
    out = edges.groupBy("walk", "src").agg((F.lit(damping) / F.count(F.lit(1))).alias("part"))
    steps = materialize(edges.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", "part"))
    rank = materialize(seeds.select("walk", "host", "weight", F.col("weight").alias("fresh")))
    moving = F.col("fresh") > tolerance * (F.col("weight") + LEAST)
    while not rank.filter(moving).isEmpty():
        brought = (F.col("fresh") * F.col("part")).alias("fresh")
        moved = rank.join(steps, ["walk", "host"]).select("walk", F.col("dst").alias("host"), brought.alias("weight"), brought)
        held = rank.select("walk", "host", "weight", F.lit(0.0).alias("fresh"))
        both = held.unionByName(moved).groupBy("walk", "host")
        last, rank = rank, materialize(both.agg(F.sum("weight").alias("weight"), F.sum("fresh").alias("fresh")))
        discard(last)
    return rank.select("walk", "host", "weight")


def host_scores(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row per host of a page: host, trust, distrust, blocked.

    A host is blocked if its distrust is at least `LEAST` and more than `RATIO` times its trust.
    """
    named = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("verdict", verdict_of(matching_rule(F.col("host"), F.col("path"), rules), rules))
    hosts = materialize(
        named.groupBy("host").agg(
            (F.count_if(F.col("verdict") == "allow") / F.count(F.lit(1))).alias("trust"),
            (F.count_if(F.col("verdict") == "block") / F.count(F.lit(1))).alias("distrust"),
        )
    )
    walks = F.explode(F.array(*(F.struct(F.lit(w).alias("walk"), F.col(w).alias("weight")) for w in ("trust", "distrust"))))
    seeds = hosts.filter("host <> ''").select("host", walks.alias("s")).select("s.walk", "host", "s.weight").filter("weight > 0")
    edges = materialize(host_edges(pages))
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    weight = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("weight"))), F.lit(0.0)).alias(walk)
    scored = spread(seeds, both, damping, tolerance).groupBy("host").agg(weight("trust"), weight("distrust"))
    return (
        hosts.select("host")
        .join(scored, "host", "left")
        .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
        .withColumn("blocked", (F.col("distrust") >= LEAST) & (F.col("distrust") > RATIO * F.col("trust") + 1e-9))
    )


def url_verdicts(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url or one without `://` has empty host and path; the empty host is no seed and is allowed. Null html has no
    links; very long html is searched whole, very long urls are read whole, and hosts beyond a valid name's length have no
    host above them. Repeated rows each give a row and count each in their host's shares; an empty table gives none; other
    columns are ignored. The rules are a short parameter list; of two that fit, the one with the longer name decides.
    """
    scores = materialize(host_scores(pages, rules, damping, tolerance))
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn(
        "rule", matching_rule(F.col("host"), F.col("path"), rules)
    )
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )


def check_sql(most: int = 80) -> str:
    """The verdicts in plain SQL, from the rules as the contract words them; the walks run `most` rounds at most."""
    # The rules, longest first.
    return rf"""
with recursive cut as (select page_id, html, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as place from pages)
, split as (select page_id, html, case when place > 0 then regexp_extract(url[place + 3:], '^[^/?#]*') else '' end as raw,
    case when place > 0 then regexp_extract(url[place + 3:], '^[^?#]*') else '' end as tail from cut)
, named as (select page_id, html, tail[length(raw) + 1:] as path,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from split)
, ruled as (select page_id, html, host, path, case
    when '.' || host like '%.example.net' and path like '/en/%' then 'example.net/en/'
    when '.' || host like '%.example.com' and path like '/de/%' then 'example.com/de/'
    when '.' || host like '%.org' and path like '/fr/%' then 'org/fr/'
    when '.' || host like '%.net' and path like '/%' then 'net/' end as rule from named)
, hosts as (select host, avg((rule is not null and rule in ('example.net/en/', 'org/fr/'))::int) as allow,
    avg((rule is not null and rule in ('example.com/de/', 'net/'))::int) as block from ruled group by host)
, found as (select host as src, unnest(regexp_extract_all(coalesce(html, ''),
    '(?is)href\s*=\s*["'']?((?:[a-z][a-z0-9+.\-]*:)?//[^"''\s>]+)', 1)) as link from named)
, ends as (select src, translate(regexp_extract(link[instr(link, '//') + 2:], '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from found)
, links as (select distinct src, dst from ends where src <> dst and src <> '' and dst <> '')
, known as (select host from hosts where host <> '' union select src from links union select dst from links)
, dots as (select host, unnest(range(1, length(host) + 1)) as place from known where length(host) <= 253)
, endings as (select host, host[place + 1:] as ending from dots where host[place] = '.')
, above as (select e.host, arg_max(k.host, length(k.host)) as up from endings e join known k on k.host = e.ending group by e.host)
, edges as (select src, dst from links union select host, up from above union select up, host from above)
, steps as (select 'trust' as walk, src, dst, {DAMPING} / count(*) over (partition by src) as part from edges
    union all select 'distrust', dst, src, {DAMPING} / count(*) over (partition by dst) from edges)
, moves as (select 0 as k, 'trust' as walk, host, allow as weight from hosts where host <> '' and allow > 0
    union all select 0, 'distrust', host, block from hosts where host <> '' and block > 0
    union all select k + 1, walk, host, sum(weight) from (
        select m.k, s.walk, s.dst as host, m.weight * s.part as weight from moves m join steps s on s.walk = m.walk and s.src = m.host
        where m.k < {most}) group by k, walk, host)
, scores as (select host, coalesce(sum(weight) filter (walk = 'trust'), 0) as trust,
    coalesce(sum(weight) filter (walk = 'distrust'), 0) as distrust from moves group by host)
select r.page_id, r.host, r.path, r.rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow'
    when rule in ('example.com/de/', 'net/') then 'block'
    when distrust >= {LEAST} and distrust > {RATIO} * trust + 1e-9 then 'block' else 'allow' end as verdict
from ruled r left join scores on r.host = scores.host
"""
