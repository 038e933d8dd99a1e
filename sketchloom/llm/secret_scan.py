"""Secret scans over a trigram index (DataFrame operations only).

Every rule yields a Boolean trigram query, derived from its regular expression (``trigrams``). The folded trigrams that some query asks for are the
index's terms; where a document stands in the postings of those that a query needs, so that their intersection holds it, it is a candidate of
the rule, and only candidates are verified with the regular expression. A rule without mandatory trigrams (a run of hexadecimal digits) scans every text.

One scan reads every text once, so there the membership in the postings is asked of the text itself and intersected in its row, term by term until
one is missing: no posting and no text is shuffled. ``postings`` is the same index as a table, to be kept and asked again by ``candidates``.

The documents of a posting are keyed by id and text hash, so repeated rows and null ids are safe: rows equal in both hold
the same text. A null text counts as empty and holds no secret. Offsets count code points, ends are exclusive. Columns of
``docs`` other than doc_id and text are ignored by find_secrets and kept by redact. The places of a text's matches are sums over blocks of about the root of
their number, so a text with very many matches takes no quadratic time.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key
from .trigrams import TRUE, Query, grams_of, query_of


@dataclass(frozen=True)
class SecretRule:
    """regex: matched leftmost, non-overlapping; ``group`` must have ``least`` characters or the match is dropped."""

    kind: str
    regex: str
    group: int
    least: int

    def query(self) -> Query:
        return query_of(self.regex)


BASE = [
    SecretRule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
]
#: From the BEGIN line over the body to the END line (few dashes stand in a key's headers, so five end the search); where there is none, to the end of the
#: lines of base64, after header lines. Line ends may be written as backslash and letter. No group repeats over lines: that would exhaust Java's stack.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,16}-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[ \t]*[\r\n]+[A-Za-z-]+: [^\r\n]*){0,8}[ \t]*[\r\n\\][ \t]*[A-Za-z0-9+/=\\\r\n]*)?"
)
#: Kinds that the index makes cheap to add; they come after the base kinds.
MORE = [
    SecretRule("pem", PEM, 0, 1),
    SecretRule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
]
RULES = BASE + MORE


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """(trigram, k_id, k_text): the inverted index of the folded trigrams that some query asks for; a document has one row per trigram."""
    grams = sorted({g for r in rules for g in grams_of(r.query())})
    held = F.filter(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: F.contains(F.col("t"), g))
    return docs.select(*text_key(), folded(F.col("text")).alias("t")).select("k_id", "k_text", F.explode(held).alias("trigram")).distinct()


def satisfied(query: Query, has: Callable[[str], Column]) -> Column:
    """The query, where ``has`` says whether a trigram is held."""
    if isinstance(query, str):
        return has(query)
    parts = [satisfied(q, has) for q in query[1]]
    return reduce(operator.and_ if query[0] == "and" else operator.or_, parts, *([] if parts else [F.lit(True)]))


def candidates(index: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """(k_id, k_text, kinds): documents in which the postings of a rule's query meet. A document has at most as many postings as
    the queries have trigrams, so its group is bounded by the rules. Rules without mandatory trigrams are left out: all documents are their candidates."""
    queries = {r.kind: r.query() for r in rules if r.query() != TRUE}
    met = index.groupBy("k_id", "k_text").agg(F.collect_set("trigram").alias("has"))
    fits = [F.when(satisfied(q, lambda g: F.array_contains("has", g)), F.lit(k)) for k, q in queries.items()]
    return met.select("k_id", "k_text", F.array_compact(F.array(*fits).cast("array<string>")).alias("kinds")).where(F.size("kinds") > 0)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, also where f uses it within functions over arrays."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blocks_of(items: Column) -> Column:
    """The array in blocks of about the root of its length; one empty block for an empty one."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    last = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, size))


def sums_before(values: Column, most: bool = False) -> Column:
    """array<int>: of each place the sum (or the largest, at least 0) of the values before it, and one more place for all. Blocks keep appending from being
    quadratic."""
    put = (lambda a, x: F.greatest(a, x)) if most else (lambda a, x: a + x)
    zero = F.lit(0)

    def scan(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("now"), F.array().cast("array<int>").alias("was"))
        return F.aggregate(items, first, lambda a, x: F.struct(put(a["now"], x).alias("now"), F.array_append(a["was"], a["now"]).alias("was")))

    def whole(blocks: Column) -> Column:
        sums = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, put)), zero)
        return let(sums, lambda t: F.concat(F.flatten(F.zip_with(blocks, t["was"], lambda b, start: scan(b, start)["was"])), F.array(t["now"])))

    return let(values, lambda v: let(blocks_of(v), whole))


SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of the kept matches: the text between the matches gives their places."""
    whole, part = (F.regexp_extract_all(text, F.lit(rule.regex), g) for g in (0, rule.group))
    found = F.struct(F.split(text, rule.regex, -1).alias("gaps"), whole.alias("hits"), part.alias("parts"))

    def placed(m: Column) -> Column:
        widths = F.zip_with(m["gaps"], m["hits"], lambda gap, hit: F.length(gap) + F.coalesce(F.length(hit), F.lit(0)))
        zipped = F.arrays_zip(F.slice(sums_before(widths), 2, 2**30).alias("end"), m["hits"].alias("hit"), m["parts"].alias("part"))
        made = F.transform(
            F.slice(zipped, F.lit(1), F.size(m["hits"])),  # one gap more than matches
            lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"), (F.length(x["part"]) >= rule.least).alias("keep")),
        )
        return F.transform(F.filter(made, lambda x: x["keep"]), lambda x: F.struct(x["start"], x["ord"], x["kind"], x["end"])).cast(SPANS)

    return F.when(text.rlike(rule.regex), let(found, placed)).otherwise(F.array().cast(SPANS))


def hex_quick(rule: SecretRule) -> SecretRule:
    """A plain character run of at least n is the same set of matches as the run alone, filtered by length, but far fewer
    matches are cut out of a text. True only of greedy runs of one class."""
    return SecretRule(rule.kind, rule.regex[:-1] + "{%d,}" % rule.least, rule.group, rule.least)


def with_spans(docs: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """docs (column text) with spans array<struct<start, ord, kind, end>>, ordered by start, then by the rule's
    place in ``rules``. A rule with a trigram query is verified on its candidates only."""
    none = F.array().cast(SPANS)
    low = folded(F.col("text"))
    parts = []
    for i, r in enumerate(rules):
        spans = spans_of(F.col("text"), hex_quick(r) if r.regex == "[0-9a-f]+" else r, i)
        query = r.query()
        fits = satisfied(query, lambda g: F.contains(F.col("_low"), F.lit(g)))
        parts.append(spans if query == TRUE else F.when(fits, spans).otherwise(none))
    return docs.withColumn("_low", low).withColumn("spans", F.array_sort(F.concat(*parts))).drop("_low")


def find_secrets(docs: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """doc_id, text, spans, one row per document."""
    return with_spans(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), rules)


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with ``[kind]`` in place of the spans; of overlapping spans the first one stands for all."""
    before = F.slice(sums_before(F.transform(spans, lambda s: s["end"]), most=True), F.lit(1), F.size(spans))  # where the text is done with before each span
    first = F.filter(F.zip_with(spans, before, lambda s, at: F.struct(s["start"], s["end"], s["kind"], at.alias("at"))), lambda x: x["start"] >= x["at"])

    def pieces(part: Column) -> Column:
        """A stretch of the text is cut out once for a block of spans, and the pieces are cut out of that."""
        low = F.get(part, F.lit(0))["at"]
        piece = lambda h: lambda x: F.concat(F.substring(h, x["at"] - low + 1, x["start"] - x["at"]), F.lit("["), x["kind"], F.lit("]"))
        return let(F.substring(text, low + 1, F.element_at(part, -1)["start"] - low), lambda h: F.array_join(F.transform(part, piece(h)), ""))

    done = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(let(first, lambda f: F.array_join(F.transform(blocks_of(f), pieces), "")), F.substring(text, done + 1, F.length(text)))


def redact(docs: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """docs with every found span replaced by ``[kind]`` (of overlapping spans the first one stands for all) and n_chars set
    anew where that column exists. All rows and columns stay; a null text stays null."""
    cols = docs.columns
    found = with_spans(docs.select(F.struct(*cols).alias("row"), "text"), rules)
    done = found.select("row", F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("clean"))
    value = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNull(), F.col("row")["n_chars"] if "n_chars" in cols else F.lit(None)).otherwise(F.length("clean").cast("long"))}
    return done.select(*[value.get(c, F.col("row")[c]).alias(c) for c in cols])


def secret_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    n = len(BASE)
    found = find_secrets(docs, RULES)
    base = F.filter("spans", lambda s: s["ord"] < n)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


def duckdb_sql(rules: list[SecretRule] = RULES) -> str:
    """The columns of query op3 as one DuckDB statement over ``documents``: the text between the matches gives their places, as here, and every rule
    scans every text."""
    parts = []
    for i, r in enumerate(rules):
        regex = r.regex.replace(r"\x22", '"').replace(r"\x27", "''").replace(r"\x20", " ")
        cut, hit, part = f"string_split_regex(t, '{regex}')", f"regexp_extract_all(t, '{regex}', 0)", f"regexp_extract_all(t, '{regex}', {r.group})"
        parts.append(f"""select rid, {i} as ord, '{r.kind}' as kind, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0) as s, length(h[k]) as n
          from (select rid, g, h, p, unnest(range(1, len(h) + 1)) as k from (select rid, {cut} as g, {hit} as h, {part} as p from d where regexp_matches(t, '{regex}'))) where length(p[k]) >= {r.least}""")
    said = "string_agg(kind || ':' || s::bigint::varchar || ':' || (s + n)::bigint::varchar, ',' order by s, ord)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), m as ({" union all ".join(parts)}),
      a as (select rid, {", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)}, {said} filter (ord < {len(BASE)}) as base, {said} as spans from m group by 1)
      select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)"""
