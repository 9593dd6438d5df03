"""What paths over tables cost: rows made and exchanges; and their results on small trees."""

import re

import pytest

from sylva import queries
from sylva.plans.compile import Engine
from sylva.sources.markup import shred

SF = "/root/testdata/sf0.001"


def most_rows(df) -> int:
    """The rows of the largest result within a plan, after a run."""
    df.collect()
    found, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        rows = p.metrics().get("numOutputRows")
        found = max(found, rows.get().value() if rows.isDefined() else 0)
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return found


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def family(spark):
    siblings = "".join(f"<s n='{i}' v='{i % 7}'/>" for i in range(200))
    return shred(spark.createDataFrame([(1, f"<r><g><l v='2'/>{siblings}</g><g><s n='x' v='3'/><s n='y'/></g></r>")], "doc_id long, xml string"), "doc_id", "xml").cache()


@pytest.mark.parametrize(
    "path, n",
    [("//s[not(@v < ../s/@v)]", 30), ("//s[../s/@v > @v]", 172), ("//s[@v = ../l/@v]", 29), ("//s[@v != ../l/@v]", 171), ("//s[../@none = @v]", 0), ("//s/@v[. < ../../s/@v]", 172), ("//s[../l/@v = ../s/@v]", 200)],
)
def test_sets_of_siblings(family, path, n):
    assert Engine(family).select(path).count() == n


def test_siblings_are_not_paired(family):
    assert most_rows(Engine(family).select("//s[not(@v < ../s/@v)]")) < 2000


@pytest.fixture
def joined(spark):
    """Joins as of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "path, n",
    [("/r/descendant-or-self::*", 206), ("/r/g/descendant-or-self::*", 205), ("/r/g/descendant-or-self::s", 202), ("/r/g/descendant::*/..", 2), ("//g/descendant-or-self::*/descendant-or-self::s", 202), ("/r/g/../descendant::g", 2), ("/descendant-or-self::node()", 207), ("/r/g[1]/descendant::s", 200)],
)
def test_descendants_of_one_level(family, path, n):
    assert Engine(family).select(path).count() == n


def test_descendants_of_one_level_are_not_exploded(joined):
    plan = queries.QUERIES["axis_descendant_or_self"](joined, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_only_named_attributes_are_kept(family):
    e = Engine(family)
    assert [r.asDict() for r in e.table("//l", v="@v", other="@n", n="count(../s[@n < 3])", u="number(../s/@n)").collect()] == [{"v": "2", "other": "", "n": 3.0, "u": 0.0}]
    assert {r.n for r in e.table("//g[2]/s/@*", n="concat(local-name(), '=', .)").collect()} == {"n=x", "v=3", "n=y"}
    assert "attrs[v]" not in e.table("//s", n="@n")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "path, n",
    [("//s/ancestor-or-self::*", 205), ("//s/ancestor::*", 3), ("//s/..", 2), ("//@v/..", 202), ("//@v/ancestor::*", 205), ("//s/../../ancestor-or-self::node()", 2), ("//s[2]/ancestor::*[1]", 2), ("//s/self::node()/ancestor-or-self::r", 1)],
)
def test_ancestors(family, path, n):
    assert Engine(family).select(path).count() == n


def test_ancestors_of_text(spark):
    e = Engine(shred(spark.createDataFrame([(1, "<r><a>x</a><a>y<b/>z</a></r>")], "doc_id long, xml string"), "doc_id", "xml"))
    assert [e.select(p).count() for p in ("//text()/..", "//text()/ancestor::*", "//a/node()/..", "//text()/ancestor-or-self::node()")] == [2, 3, 2, 7]


def test_ancestors_are_looked_up_once(joined):
    df = queries.QUERIES["axis_ancestor_or_self"](joined, SF)
    assert len(re.findall(r"\bWindow \[", df._jdf.queryExecution().executedPlan().toString())) == 2  # none for lineitems as ancestors


@pytest.mark.parametrize("name, most", [("pred_position", 3), ("pred_last", 3), ("pred_position_range", 3), ("pred_chained", 3), ("axis_child", 4), ("axis_attribute_all", 0)])
def test_no_exchange_for_parents_and_places(joined, name, most):
    df = queries.QUERIES[name](joined, SF)
    assert exchanges(df) <= most
    assert df.count() > 0


def test_attributes_of_parents(family):
    e = Engine(family)
    values = {"up": "../@v", "r": "parent::r/@v", "s": "string(parent::s/@n)", "n": "number(../@n)", "has": "boolean(../@n)"}
    assert [tuple(r)[:3] + (r.has,) for r in e.table("//s[@n='x']/@v", **values).collect()] == [("3", "", "x", True)]
    assert [(r.up, r.has) for r in e.table("/r/g[2]/s[last()]", up="../@v", has="boolean(../@v)").collect()] == [("", False)]
    assert [r.up for r in e.table("//s[@n='x']/following-sibling::s", up="../@v").collect()] == [""]
    assert [r.up for r in e.table("//@n[. = 'x']", up="../@v").collect()] == ["3"]
    assert [r.up for r in e.table("//@n[. = 'x'] | //@n[. = '1']", up="parent::s/@v").orderBy("up").collect()] == ["1", "3"]


def test_positions_among_children(family):
    e = Engine(family)
    assert sorted(r.n for r in e.table("//g/s[last()]", n="@n").collect()) == ["199", "y"]
    assert sorted(r.n for r in e.table("//g/s[@v = 3][2]", n="@n").collect()) == ["10"]
    assert sorted(r.n for r in e.table("//*/*[2]", n="concat(local-name(), @n)").collect()) == ["g", "s0", "sy"]
