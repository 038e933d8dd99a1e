"""URL filter: explicit host/path rules first, link-graph propagation for the rest (DataFrame operations only).

Trust flows along links from hosts with allowed pages, distrust flows against the links from hosts with blocked pages (who
links to a blocked host is suspect); a host seeds each walk with that verdict's share of its ruled pages. Both are personalised PageRanks over the deduplicated host graph,
run as one chain of joins over edges tagged with their kind. A host whose share of distrust passes a threshold is blocked.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; a null html
has no links; repeated rows are judged alike; links of a host to itself carry nothing; empty tables give no rows. Columns
of ``pages`` other than page_id, url and html are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\x22\x27]?\s*(?:https?:)?//([^/?#\x22\x27\s<>]+)"
MOST_RULES = 1000
EACH = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class LinkRank:
    """damping of both walks and their least rounds: they go on until the mass still under way is less than ``rest`` of a uniform share, half of the last
    digit that is compared. A host is blocked if its distrust is over ``least`` of a uniform share and over ``share`` of trust and distrust together."""

    damping: float = 0.85
    rounds: int = 8
    least: float = 0.1
    share: float = 0.5
    rest: float = 5e-7


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The rules are a parameter of checked size."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts; ``pages`` has host and html."""
    targets = F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1), lambda x: ascii_lower(x))
    return (
        pages.where(F.col("host") != "")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
        .where((F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )


def propagate(edges: DataFrame, seeds: DataFrame, how: LinkRank, n_hosts: float) -> DataFrame:
    """(host, trust, distrust) of every host that either walk reaches. seeds: (host, kind, part), kind trust or distrust.

    Mass only grows from round to round, and what k rounds add is damping^k of what k rounds before added at most: so much can still come."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    degree = both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"))
    walk = cut(both.join(degree, ["kind", "src"]).select("kind", "src", "dst", (how.damping / F.col("n")).alias("w")), "edges")
    total = seeds.groupBy("kind").agg(F.sum("part").alias("seeds"))
    start = cut(
        seeds.join(F.broadcast(total), "kind").select("kind", "host", ((1.0 - how.damping) * F.col("part") / F.col("seeds")).alias("mass")), "seeds"
    )  # two kinds: two rows are broadcast
    rank, was, i = start, 0.0, 0
    while True:
        moved = walk.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("mass") * F.col("w")).alias("mass")
        )
        rank = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        i += 1
        if i % EACH and i != how.rounds:
            continue
        rank = cut(rank, f"rank{i}")
        if i % EACH == 0:
            mass = rank.agg(F.sum("mass")).first()[0] or 0.0
            still = (mass - was) * how.damping**EACH / (1.0 - how.damping**EACH)
            if i >= how.rounds and still * n_hosts < max(how.rest, 1e-14 * n_hosts):  # the sum itself is no more exact
                break
            was = mass
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule], how: LinkRank = LinkRank()) -> DataFrame:
    """page_id, host, path, rule, verdict, distrust (of the host, rounded; 0 where neither walk reaches it)."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = read.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    hosts = (
        judged.where(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count_if(F.col("fit.verdict") == "block").alias("blocked"),
            F.count_if(F.col("fit.verdict") == "allow").alias("allowed"),
        )
    )
    seeds = (
        hosts.where("blocked > 0 or allowed > 0")
        .select("host", F.expr("stack(2, 'trust', try_divide(allowed, allowed + blocked), 'distrust', try_divide(blocked, allowed + blocked))").alias("kind", "part"))
        .where("part > 0")
    )
    edges = cut(host_edges(read), "links")
    n_hosts = float(hosts.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct().count())
    ranks = propagate(edges, seeds, how, n_hosts)
    suspects = (
        ranks.where("distrust > 0")
        .select(
            F.col("host"),
            F.round(F.col("distrust") * F.lit(n_hosts), 6).alias("distrust"),
            F.round(F.col("distrust") / (F.col("distrust") + F.col("trust")), 6).alias("part"),
        )
    )
    bad = (F.col("distrust") > how.least) & (F.col("part") > how.share)
    return (
        judged.drop("html")
        .join(suspects, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
            F.coalesce(F.col("distrust"), F.lit(0.0)).alias("distrust"),
        )
    )


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def duckdb_sql(rules: list[Rule] = RULES, how: LinkRank = LinkRank()) -> str:
    """The same judgement as one DuckDB statement over the view ``pages``."""
    case = lambda part: "case " + " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, part)}'"
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ) + " end"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rank = lambda i: f"""r{i} as (select kind, host, sum(mass) as mass from (select * from start union all
      select w.kind, w.dst, r.mass * w.w from walk w join r{i - 1} r on r.kind = w.kind and r.host = w.src) group by all)"""  # noqa: E731
    link = LINK.replace(r"\x22", '"').replace(r"\x27", "''")
    return f"""
with a as (select page_id, html, {low(f"coalesce(regexp_extract(url, '{URL}', 1), '')")} as host, coalesce(regexp_extract(url, '{URL}', 2), '') as path from pages),
b as (select *, {case("text")} as rule, {case("verdict")} as fit from a),
links as (select distinct host as src, dst from (select host, {low("unnest(regexp_extract_all(html, '" + link + "', 1))")} as dst from a where host <> '') where dst <> '' and dst <> host),
hosts as (select host, count(*) filter (fit = 'block') as blocked, count(*) filter (fit = 'allow') as allowed from b where host <> '' group by 1),
seeds as (select 'trust' as kind, host, allowed / (allowed + blocked) as part from hosts where allowed > 0
  union all select 'distrust', host, blocked / (allowed + blocked) from hosts where blocked > 0),
e as (select 'trust' as kind, src, dst from links union all select 'distrust', dst, src from links),
walk as (select kind, src, dst, {how.damping}::double / count(*) over (partition by kind, src) as w from e),
start as (select kind, host, {1.0 - how.damping}::double * part / sum(part) over (partition by kind) as mass from seeds),
r0 as (select * from start),
{", ".join(rank(i) for i in range(1, how.rounds + 1))},
s as (select host, sum(case when kind = 'trust' then mass else 0 end) as trust, sum(case when kind = 'distrust' then mass else 0 end) as distrust from r{how.rounds} group by 1),
t as (select host, round(distrust * (select count(distinct host) from (select host from hosts union all select dst from links)), 6) as distrust, round(distrust / (distrust + trust), 6) as part from s where distrust > 0)
select page_id, b.host as host, path, rule, coalesce(fit, case when t.distrust > {how.least} and part > {how.share} then 'block' else 'allow' end) as verdict, coalesce(t.distrust, 0.0)::double as distrust
from b left join t on t.host = b.host"""
