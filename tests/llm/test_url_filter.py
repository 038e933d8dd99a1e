import pytest

from sketchloom.llm.common import table
from sketchloom.llm.queries import op2_url_filter
from sketchloom.llm.url_filter import RULES, LinkRank, Rule, duckdb_sql, judge_urls

from ..oracle import connection, rows

PAGES = [
    (1, "http://a.org/x", '<a href="http://b.net/1">'),
    (2, "http://b.net/", '<a href="//c.net/2"> <a href=\'https://B.net/self\'>'),
    (3, "http://EXAMPLE.org/es/1?q", None),
    (4, "http://x.example.org/en/1#t", ""),
    (5, "http://fan.net/p", '<a href="http://example.org/es/9">' * 3),
    (6, "http://c.net", "x"),
    (7, None, '<a href="http://example.org/">'),
    (8, "no scheme", None),
    (9, "://", ""),
    (10, "ftp://org/", ""),
    (11, "http://notorg/", ""),
    (12, "http://org", ""),
    (13, "x://h.com/fr/a://b", ""),
    (14, "http://y.com/de/ü", ""),
    (14, "http://y.com/de/ü", ""),
]


@pytest.fixture
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("mass", F.lit(1))


def brute(pages, rules, how):
    """Dictionaries and loops."""
    judged = []
    for page, url, html in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text)) if fit else None
        judged.append((page, host, path, best, html))
    import re

    links = {(h, t.lower()) for _, h, _, _, html in judged if h for t in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "")}
    links = {(a, b) for a, b in links if a != b}
    seeds = {"trust": {}, "distrust": {}}
    for h in {h for _, h, _, _, _ in judged if h}:
        verdicts = [r.verdict for _, g, _, r, _ in judged if g == h and r]
        for kind, v in (("trust", "allow"), ("distrust", "block")):
            if v in verdicts:
                seeds[kind][h] = verdicts.count(v) / len(verdicts)
    ranks = {}
    for kind in seeds:
        edges = links if kind == "trust" else {(b, a) for a, b in links}
        total = sum(seeds[kind].values())
        start = {h: (1 - how.damping) * p / total for h, p in seeds[kind].items()}
        rank = dict(start)
        for _ in range(how.rounds):
            fresh = dict(start)
            for a, b in edges:
                if a in rank:
                    fresh[b] = fresh.get(b, 0) + how.damping * rank[a] / sum(1 for x, _ in edges if x == a)
            rank = fresh
        ranks[kind] = rank
    n = len({h for _, h, _, _, _ in judged if h} | {b for _, b in links})
    out = []
    for page, host, path, best, _ in judged:
        bad, good = ranks["distrust"].get(host, 0), ranks["trust"].get(host, 0)
        block = bad > 0 and round(bad * n, 6) > how.least and round(bad / (bad + good), 6) > how.share
        out.append((page, host, path, best.text if best else None, best.verdict if best else "block" if block else "allow"))
    return sorted(out, key=str)


def test_against_loops(pages):
    how = LinkRank(rounds=5)
    got = judge_urls(pages, RULES, how).drop("distrust").collect()
    assert sorted(map(tuple, got), key=str) == brute(PAGES, RULES, how)
    by = {r["page_id"]: r for r in got}
    assert by[5]["verdict"] == "block" and by[6]["verdict"] == "allow" and by[8]["host"] == ""
    assert by[13]["path"] == "/fr/a://b" and by[12]["rule"] is None


def test_no_rules_no_pages(pages):
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}
    assert judge_urls(pages.where("false"), RULES).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, [Rule("allow", str(i), "/") for i in range(1001)])


def test_equals_sql(spark, sf_dir):
    assert rows(op2_url_filter(spark, sf_dir).toPandas()) == rows(connection(sf_dir).sql(duckdb_sql()).df())


def test_plan_is_native(spark, sf_dir):
    plan = judge_urls(table(spark, sf_dir, "pages"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_walks_go_on_until_they_settle(spark):
    """A chain of 20 hosts to a blocked one, and a ring beside it: the verdicts are those of 300 rounds, also over eight hops away."""
    chain = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(20)] + [(20, "http://h20.net/", '<a href="http://example.org/">')]
    ring = [(100 + i, f"http://r{i}.net/", f'<a href="http://r{(i + 1) % 7}.net/"><a href="http://h{3 * i}.net/">') for i in range(7)]
    made = [*chain, *ring, (200, "http://example.org/es/1", None), (201, "http://x.net/y", '<a href="http://r0.net/"><a href="http://h5.net/">')]
    got = judge_urls(spark.createDataFrame(made, "page_id long, url string, html string"), RULES).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(made, RULES, LinkRank(rounds=300))
    far = {r["page_id"]: r for r in got}[12]
    assert far["verdict"] == "block" and far["distrust"] > 0
