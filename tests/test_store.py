"""Branches, forks and merges; the journal's views; numbering invariants."""

import pytest
from pyspark.sql import functions as F

from sylva.operators import updates
from sylva.operators.store import Store, StoreError
from sylva.plans.compile import Engine
from sylva.sources.markup import serialize, shred
from sylva.streaming import views


def text(nodes):
    return serialize(nodes).first()["text"]


def append(nodes, name):
    return updates.insert(Engine(nodes), "/r", [("element", name, [("text", "", name, {})], {})])


def test_fork_and_merge(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_branch("main", shred(spark.createDataFrame([(1, "<r><i>initial</i></r>")], "doc_id long, x string"), "doc_id", "x"))
    for name in ("one", "two"):
        store.fork("main", name)
        store.commit(name, append(store.open(name), name))
    assert text(store.open("main")) == "<r><i>initial</i></r>"
    store.merge("one")
    store.merge("two")
    assert text(store.open("main")) == "<r><i>initial</i><one>one</one><two>two</two></r>"
    assert text(store.open("main", 1)) == "<r><i>initial</i></r>"
    assert store.check("main").count() == 0
    assert [r.branch for r in store.branches().collect()] == ["main"]
    with pytest.raises(StoreError):
        store.open("one")
    with pytest.raises(StoreError):
        store.create_branch("main", store.open("main"))


def test_view_follows_journal(spark, tmp_path):
    schema = views.JOURNAL
    batches = [
        [(1, "insert", 1, "e", "a", "g", 1.0), (2, "insert", 1, "e", "b", "h", 2.0), (3, "insert", 1, "other", "a", "g", 9.0)],
        [(4, "update", 1, "e", "a", "h", 5.0), (5, "delete", 1, "e", "b", "h", 0.0), (6, "insert", 1, "e", "c", "g", 3.0)],
    ]
    aggregates = lambda: {"n": F.count(F.lit(1)), "total": F.sum("value")}
    journal, into = str(tmp_path / "journal"), str(tmp_path / "view")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(journal)
        views.maintain(spark, journal, into, str(tmp_path / "ck"), "e", aggregates, 4).awaitTermination()
    whole = views.view(spark.read.schema(schema).parquet(journal), "e", **aggregates())
    kept = spark.read.parquet(f"{into}/view")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect())) == [("g", 1, 3.0), ("h", 1, 5.0)]
