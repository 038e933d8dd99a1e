import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.llm import trigrams
from sketchloom.llm.common import table
from sketchloom.llm.secret_scan import BASE, RULES, SecretRule, candidates, find_secrets, postings, redact, secret_digest

from .conftest import ODD

KINDS = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}
TEXTS = [
    "token: token: abcdefg", "TOKEN='abc123' password=a passwd :  \"longenough\"", "apikey=ApiKey=secret api_key = x", "AKIA" + "A1" * 8 + " AKIAshort AKIA" + "Z" * 15,
    "é😀 secret=" + "ab" * 20 + " tail", "0123456789abcdef01234567 0123456789abcdef0123456", "password" * 50 + "=" * 9, "secret:\n abcdefgh", "x" * 500 + "Secret=deadbeefdeadbeefdeadbeefdeadbeef",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, "sécret=abcdefgh tokén=abcdefgh", "toKen=abcdefgh", None, "",
]


def brute(text):
    found = [(k, m.start(), m.end()) for k, (rx, g, least) in KINDS.items() for m in rx.finditer(text or "") if len(m[g]) >= least]
    order = list(KINDS)
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], order.index(x[0]))))
    return (*(sum(f[0] == k for f in found) for k in KINDS), hashlib.sha256(said.encode()).hexdigest())


def check(rows, texts):
    for r in rows:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_against_re(docs):
    rows = secret_digest(docs(list(enumerate(TEXTS)))).collect()
    assert len(rows) == len(TEXTS)
    check(rows, dict(enumerate(TEXTS)))
    assert {s.split(":")[0] for s in rows[9]["spans"].split(",")} == {"pem", "code_host"} or any("pem" in r["spans"] for r in rows)


def test_random_texts(spark, docs):
    rnd = random.Random(4)
    bits = ["token", "Secret", "api_key", "apikey", "passwd", "password", "=", ":", " ", "'", '"', "abc", "deadbeef", "0123456789", "AKIA", "ABCD1234", "\n", "é", "😀", "-", "=="]
    texts = {i: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for i in range(400)}
    check(secret_digest(docs(list(texts.items()))).collect(), texts)


def test_odd_rows(docs):
    assert secret_digest(docs(ODD)).count() == len(ODD)
    assert secret_digest(docs(ODD).where("false")).count() == 0


letters = st.sampled_from("abcAB1 _-")
pieces = st.recursive(
    st.one_of(letters.map(re.escape), st.sampled_from([".", "[ab]", "[a-z]", "[^a]", r"\w", "(?i:Ab)", "abc", "é"])),
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=4).map("".join),
        st.tuples(inner, inner).map(lambda x: f"(?:{x[0]}|{x[1]})"),
        st.tuples(inner, st.sampled_from(["?", "*", "+", "{2}", "{1,3}", "{5,}"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    ),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(pieces, st.text(alphabet="abcAB1 _-é", max_size=40))
def test_queries_have_no_false_negatives(regex, text):
    """A text with a match of any regular expression satisfies its trigram query."""
    if re.search(regex, text):
        low = text.lower()
        assert trigrams.holds(trigrams.query_of(regex), {low[i : i + 3] for i in range(len(low) - 2)})


def test_derived_queries():
    assert BASE[1].query() == ("and", ("aki", "kia"))
    assert trigrams.query_of("ab(c|d)?ef") == ("or", (("and", ("abc", "bce", "cef")), ("and", ("abd", "bde", "def")), ("and", ("abe", "bef"))))
    assert trigrams.query_of("abc+d") == ("and", ("abc",)) or "abc" in trigrams.grams_of(trigrams.query_of("abc+d"))
    assert {"pas", "tok", "sec"} <= set(trigrams.grams_of(BASE[0].query()))


def test_rules_without_trigrams_scan_fully():
    assert BASE[2].query() == trigrams.TRUE and SecretRule("x", "ab", 0, 1).query() == trigrams.TRUE


def test_candidates_are_few(docs):
    frame = docs([(1, "nothing here"), (2, "my TOKEN is"), (3, "AKIA"), (4, "tok oke ken"), (5, None)])
    rows = candidates(postings(frame, RULES), RULES).collect()
    assert {r["k_id"]: sorted(r["kinds"]) for r in rows} == {2: ["assign"], 3: ["access"], 4: ["assign"]}


def test_many_matches(docs):
    """A text with a hundred thousand matches, whose spans and masked text are those of a regular-expression engine."""
    n = 100_000
    text = "".join(f"é secret=abc{i:06d} " for i in range(n))
    row = secret_digest(docs([(1, text)])).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"], row["base_sha256"]) == brute(text)
    assert redact(docs([(1, text)])).first()["text"] == "é [assign] " * n


def test_overlapping_spans_are_masked_once(docs):
    rnd = random.Random(7)
    texts = {i: "".join(rnd.choice(["secret=", "0123456789abcdef" * 2, "ghp_" + "a1" * 20, " ", "-----BEGIN PRIVATE KEY-----", "x-"]) for _ in range(rnd.randint(0, 30))) for i in range(150)}
    found = {r["doc_id"]: r["spans"] for r in find_secrets(docs(list(texts.items()))).collect()}
    for r in redact(docs(list(texts.items()))).collect():
        out, at = "", 0
        for x in found[r["doc_id"]]:
            if x["start"] >= at:
                out += texts[r["doc_id"]][at : x["start"]] + f"[{x['kind']}]"
            at = max(at, x["end"])
        assert r["text"] == out + texts[r["doc_id"]][at:]


def test_redaction(docs):
    rows = {r["doc_id"]: r for r in redact(docs([(1, "é token=abcdefgh end"), (2, "clean"), (3, None), (3, None), (4, "secret=" + "a1" * 20)])).collect()}
    assert rows[1]["text"] == "é [assign] end" and rows[2]["text"] == "clean" and rows[3]["text"] is None and rows[4]["text"] == "[assign]"
    assert rows[1]["label"] == "clash" and rows[1]["row"] == "clash"


def test_plan_is_native(spark, sf_dir):
    plan = find_secrets(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_regexes_compile(spark, rule):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.lit("x").rlike(rule.regex)).first()[0] is False


def test_equals_sql(spark, sf_dir):
    from sketchloom.llm.queries import op3_secret_scan
    from sketchloom.llm.secret_scan import duckdb_sql

    from ..oracle import connection, rows

    for folder in (sf_dir, "/root/testdata/sf0.01"):
        assert rows(op3_secret_scan(spark, folder).toPandas()) == rows(connection(folder).sql(duckdb_sql()).df())


BODY = "\n".join("MIIEow" + "aB3+/x9Q" * 7 + "Zz" for _ in range(300)) + "\nQk1zdA=="
KEYS = {
    1: ("a -----BEGIN RSA PRIVATE KEY-----\n" + BODY + "\n-----END RSA PRIVATE KEY----- b", "a [pem] b"),
    2: ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A1B\n\n" + BODY + "\n-----END RSA PRIVATE KEY-----", "[pem]"),
    3: ("-----BEGIN PRIVATE KEY-----\n" + BODY + "\n and more - words", "[pem] and more - words"),
    4: ("-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A1B\n\n" + BODY + "\n", "[pem]"),
    5: ('"-----BEGIN PRIVATE KEY-----\\n' + BODY.replace("\n", "\\n") + '\\n-----END PRIVATE KEY-----\\n"', '"[pem]\\n"'),
    6: ("-----BEGIN PRIVATE KEY----- is how a key begins. " + "well-known - " * 9000, None),
    7: ("-----BEGIN PRIVATE KEY-----\n" + BODY + "\n-----BEGIN PRIVATE KEY-----\r\n" + BODY.replace("\n", "\r\n") + "\r\n-----END PRIVATE KEY-----", "[pem][pem]"),
}


def test_whole_private_keys_are_masked(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in redact(docs([(i, t) for i, (t, _) in KEYS.items()])).collect()}
    assert rows == {i: t.replace("-----BEGIN PRIVATE KEY-----", "[pem]") if want is None else want for i, (t, want) in KEYS.items()}


def test_whole_private_keys_equal_sql(docs):
    import duckdb

    from sketchloom.llm.secret_scan import duckdb_sql

    documents = docs([(i, t) for i, (t, _) in KEYS.items()], extra=False).toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: r for r in con.sql(duckdb_sql()).fetchall()}
    got = {r["doc_id"]: tuple(r) for r in secret_digest(docs([(i, t) for i, (t, _) in KEYS.items()])).collect()}
    assert got == want
