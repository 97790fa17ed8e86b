"""Rules by example, and propagation against a walk in Python."""

import re
from collections import Counter

import duckdb
import pandas as pd

from tomoloom.llm import url_filter as urls

PAGES = [
    (1, "http://A.Example.NET/x?y#z", None), (2, "https://m.example.net/en/1", ""), (3, "https://example.com/de/1", "<a href='http://good.org/fr/'>"),
    (4, "https://xexample.com/de/1", None), (5, None, "x"), (6, "no scheme", None), (7, "http://good.org/fr/1", '<a HREF="http://mid.io/a">'),
    (8, "http://net", None), (9, "http://net/", None), (10, "ftp://mid.io?u=http://b.net/", '<a href="http://example.com/de/">'),
    (11, "http://bad.io/p#/net/", '<a href=http://example.com/x> <a href="http://sub.net/y">'), (11, "http://bad.io/p", "<a href='/own'>"),
    (None, "http://ÄB.org/fr/", None), (12, "http://example.net/EN/", None), (13, "x://://net/", None),
]


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")


def edges_of(pages):
    """Pairs of hosts, by reading every page and every ending of every name."""
    edges = set()
    for _, url, html in pages:
        host = parts(url)[0]
        for link in re.findall(urls.LINK.replace("(?is)", ""), html or "", re.I | re.S):
            other = parts("x:" + link if link.startswith("//") else link)[0]
            if other and host and other != host:
                edges.add((host, other))
    known = {parts(url)[0] for _, url, _ in pages} - {""} | {h for e in edges for h in e}
    for host in known:
        over = [o for o in known if host.endswith("." + o) and len(host) <= urls.LONGEST_NAME]
        if over:
            above = max(over, key=len)
            edges |= {(host, above), (above, host)}
    return edges


def plain(pages, rounds=200):
    rows = []
    for page, url, html in pages:
        host, path = parts(url)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rows.append((page, host, path, max(fits, key=lambda r: len(r.name), default=None)))
    edges, count = edges_of(pages), Counter(r[1] for r in rows)
    score = {}
    for walk, verdict in (("trust", "allow"), ("distrust", "block")):
        steps = edges if walk == "trust" else {(b, a) for a, b in edges}
        out = Counter(a for a, _ in steps)
        seed = Counter(r[1] for r in rows if r[1] and r[3] and r[3].verdict == verdict)
        seed = {h: n / count[h] for h, n in seed.items()}
        weight = Counter(seed)
        for _ in range(rounds):
            new = Counter(seed)
            for a, b in steps:
                new[b] += weight[a] / out[a] * urls.DAMPING
            weight = new
        score[walk] = weight
    out = []
    for page, host, path, rule in rows:
        t, d = score["trust"][host], score["distrust"][host]
        own = "block" if d >= urls.LEAST and d > urls.RATIO * t else "allow"
        out.append((page, host, path, rule.name if rule else None, rule.verdict if rule else own))
    return sorted(out, key=str)


def test_verdicts(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, verdict string").repartition(3)
    found = urls.url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == plain(PAGES)
    by_page = {(r[0], r[2]): r for r in got}
    assert by_page[2, "/en/1"][3:] == ("example.net/en/", "allow") and by_page[1, "/x"][3:] == ("net/", "block")
    assert by_page[8, ""][3] is None and by_page[9, "/"][3] == "net/" and by_page[5, ""][1] == ""
    assert by_page[11, "/p"][4] == "block"


def test_empty_table(spark):
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def found(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urls.url_verdicts(rows.repartition(3)).select("page_id", "host", "path", "rule", "verdict").collect()
    return sorted((tuple(r) for r in got), key=str)


def chain(length, start):
    """Hosts that link one to the next, the last to a blocked one; and a far host that only that chain reaches."""
    names = [f"h{i}.chain{start}.io" for i in range(length)] + ["example.com"]
    pages = [(start + i, f"http://{a}/", f'<a href="//{b}/x">') for i, (a, b) in enumerate(zip(names, names[1:]))]
    return [*pages, (start + length, "http://example.com/de/", None)]


def test_long_walks_and_names(spark):
    pages = chain(14, 100) + [
        (1, "http://m.bets.example.com/x", '<a href="/own"><a href="own//x">'), (2, "http://bets.example.com/de/", None),
        (3, "http://loop-a.io/", "<a href='http://loop-b.io'>"), (4, "http://loop-b.io/", '<a href="http://loop-a.io/"><a href="http://x.org">'),
        (5, "http://x.org/fr/", '<a href="http://loop-b.io">'), (6, "http://" + "a." * 400 + "io/", None), (7, "http://io/" + "x" * 100_000, "y" * 100_000),
    ]
    got = found(spark, pages)
    assert got == plain(pages)
    by_page = {r[0]: r[4] for r in got}
    assert by_page[1] == "block" and by_page[3] == "allow"
    # Distrust goes far beyond eight links, as long as enough of it is left.
    assert by_page[100] == "block" and by_page[113] == "block"


def test_other_hosts_pages_move_no_verdict(spark):
    small = [(1, "http://cheap.example.com/de/", None), *((k, "http://cheap.example.com/x", None) for k in range(2, 9))]
    linked = [(20, "http://who.io/", '<a href="http://cheap.example.com/">'), (21, "http://fan.io/", '<a href="http://good.org/fr/">')]
    pages = [*small, *linked, (30, "http://good.org/fr/", '<a href="http://fan.io/">')]
    others = [(100 + k, f"http://big.net/{k}", '<a href="http://huge.org">') for k in range(300)] + [(500 + k, "http://huge.org/fr/", None) for k in range(300)]
    alone = {r[0]: r[4] for r in found(spark, pages)}
    assert alone[5] == "block" and alone[20] == "block" and alone[21] == "allow"
    for more in (others, [(900 + p, u, h) for p, u, h in others * 2], [(900 + p, u, h) for p, u, h in pages if "good" in u] * 3):
        crowded = {r[0]: r[4] for r in found(spark, pages + more)}
        assert {k: crowded[k] for k in alone} == alone


def test_sql_agrees(spark):
    con = duckdb.connect()
    pages = PAGES + chain(9, 200)
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert sorted(con.execute(urls.check_sql()).fetchall(), key=str) == plain(pages)


def test_edges(spark):
    pages = [(1, "http://a.b.c/", '<a href="//d.c/x">'), (2, "http://b.c", '<a href="/x"><a href=HTTP://D.C>'), (3, "http://c", None), (4, "http://xb.c/", None)]
    got = {tuple(r) for r in urls.host_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == edges_of(pages)
    assert got >= {("a.b.c", "b.c"), ("b.c", "a.b.c"), ("b.c", "c"), ("xb.c", "c"), ("a.b.c", "d.c"), ("b.c", "d.c"), ("d.c", "c")}
    assert ("a.b.c", "c") not in got
