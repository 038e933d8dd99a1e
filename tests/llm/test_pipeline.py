import importlib
import sys

import pytest

import corpus_pipeline as c
from sketchloom.llm import near_copies, secret_scan, toxicity
from sketchloom.llm.common import cut, table

from .conftest import ODD


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returned."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, f in c.STAGES:
        docs = cut(f(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def test_names_and_columns(stages, spark, sf_dir):
    columns = table(spark, sf_dir, "documents").columns
    assert len(c.STAGES) == 5
    for s in stages[:-1]:
        assert s.columns == columns


def test_decisions(stages, spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toxic, single, masked, mixed, tokens = stages
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    assert ids(toxic) == ids(toxicity.tag(docs, model).where("score < 0.3"))
    assert ids(single) == ids(near_copies.one_of_each(toxic))
    texts = [r["text"] for r in single.select("text").collect()]
    assert len(set(texts)) == len(texts)
    assert ids(masked) == ids(single) == ids(mixed) == ids(tokens)
    assert secret_scan.secret_digest(masked).where("n_assign + n_access + n_hex > 0").count() == 0
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert tokens.where("size(ids) <> n_tokens").count() == 0


def test_run_is_the_stages(stages, spark, sf_dir):
    assert sorted(map(str, c.run(spark, sf_dir).collect())) == sorted(map(str, stages[-1].collect()))


def whole(spark, frame, sf_dir):
    """All stages over the rows of ``frame``, each written and read again."""
    for name, f in c.STAGES:
        frame = cut(f(spark, frame, sf_dir), f"test-{name}")
    return frame


def test_odd_rows(spark, sf_dir):
    """Null ids and texts, empty and very long texts and repeated rows go through all stages; copies go, one of each stays."""
    rows = [(i, t, None, f"src{k % 3}" if k % 4 else None, None) for k, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    out = {r["doc_id"]: r["n_tokens"] for r in whole(spark, docs, sf_dir).collect()}
    assert set(out) == {None, 0, 2, 5, 6, 7} and out[0] == 0 and out[5] > 1000


def test_empty_table_and_nothing_kept(spark, sf_dir):
    """An empty table, and stages that get no rows because the first rejects all, end in an empty table of the same columns."""
    docs = table(spark, sf_dir, "documents")
    assert whole(spark, docs.where("false"), sf_dir).count() == 0
    none = toxicity.clean_only(docs, toxicity.Field(intercept=20.0))
    assert none.count() == 0 and none.columns == docs.columns
    assert near_copies.one_of_each(none).count() == 0


def entry_without(monkeypatch, *missing):
    for name in [m for m in sys.modules if m.startswith("sketchloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    try:
        return importlib.import_module("__spark_entry__")
    finally:
        sys.modules.pop("__spark_entry__", None)


def test_entry_without_the_subpackage(monkeypatch):
    entry = entry_without(monkeypatch, "sketchloom.llm", "corpus_pipeline")
    assert entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_missing_library_shows_itself(monkeypatch):
    with pytest.raises(ImportError):
        entry_without(monkeypatch, "xxhash")
