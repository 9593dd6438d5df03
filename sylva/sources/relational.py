"""Trees over ordinary tables: a foreign key is a child step, columns are attributes.

The node rows are plain projections with literal names and number ranges, united. A test of a name, or a lookup of an
attribute, therefore folds into the scan: other tables' branches vanish, and only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import nodes as N
from ..plans.compile import union

SHIFT = 28  # a top-level element has 2^28 numbers for itself and its descendants
INNER = 4  # and each of its children 2^4
WHOLE = 1 << 62


def tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: Column, kind: str) -> Column:
    """A column as attribute text: dates by day, timestamps by second, doubles with two decimals."""
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind in ("double", "float"):
        return F.format_string("%.2f", c)
    return c.cast("string")


def attributes(df: DataFrame, names: dict[str, str], only: set[str] | None = None) -> Column:
    """A map from attribute names, or those of a set, to the texts of columns; nulls are left out at lookups."""
    kinds = dict(df.dtypes)
    parts = [x for name, column in names.items() if only is None or name in only for x in (F.lit(name), text_of(F.col(column), kinds[column]))]
    return F.create_map(*parts)


def top(spark: SparkSession, name: str, doc_id: int = 1) -> DataFrame:
    """The document's root and its outermost element."""
    one = spark.range(1)
    root = one.select(*N.row(doc_id=doc_id, pre=0, size=WHOLE, level=0, kind=N.ROOT, anc=F.array().cast("array<bigint>")))
    element = one.select(*N.row(doc_id=doc_id, pre=1, size=WHOLE - 1, level=1, parent=0, kind=N.ELEMENT, local=name, anc=F.array(F.lit(0))))
    return root.unionByName(element)


def level_two(df: DataFrame, name: str, rank: Column, attrs: Column, doc_id: int = 1, value: Column | None = None, base: int = 0) -> DataFrame:
    """One element of the outermost element for each row; ``rank`` (0, 1, ...) is unique and orders them."""
    pre = F.shiftleft(rank.cast("long") + 1 + base, SHIFT)
    return df.select(*N.row(doc_id=doc_id, pre=pre, size=(1 << SHIFT) - 1, level=2, parent=1, sib=rank.cast("long") + 1 + base, kind=N.ELEMENT, local=name, value=value, anc=F.array(F.lit(0), F.lit(1)), attrs=attrs))


def level_three(df: DataFrame, name: str, parent_rank: Column, place: Column, attrs: Column, doc_id: int = 1, value: Column | None = None) -> DataFrame:
    """One element for each row below its parent; ``place`` counts from 1."""
    parent = F.shiftleft(parent_rank.cast("long") + 1, SHIFT)
    pre = parent + F.shiftleft(place.cast("long"), INNER)
    return df.select(*N.row(doc_id=doc_id, pre=pre, size=(1 << INNER) - 1, level=3, parent=parent, sib=place, kind=N.ELEMENT, local=name, value=value, anc=F.array(F.lit(0), F.lit(1), parent), attrs=attrs))


def with_text(elements: DataFrame) -> DataFrame:
    """Elements with a value, and the text node in each."""
    texts = elements.where(F.col("value").isNotNull() & (F.col("value") != "")).select(
        *N.row(doc_id=F.col("doc_id"), pre=F.col("pre") + 1, level=F.col("level") + 1, parent=F.col("pre"), kind=N.TEXT, value=F.col("value"), anc=F.array_append("anc", F.col("pre")))
    )
    return elements.unionByName(texts)


def orders(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    """/orders/order[@key @cust @status @price @date @prio]/lineitem[@part @supp @qty @price @disc @rf @ls @ship]"""
    t = tables(spark, sf_dir)
    o, items = t("orders"), t("lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    items = items.withColumn("place", place)
    return union(
        [
            top(spark, "orders"),
            level_two(o, "order", F.col("o_orderkey"), attributes(o, {"key": "o_orderkey", "cust": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice", "date": "o_orderdate", "prio": "o_orderpriority"}, only), value=F.lit(None)),
            level_three(items, "lineitem", F.col("l_orderkey"), F.col("place"), attributes(items, {"n": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey", "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "rf": "l_returnflag", "ls": "l_linestatus", "ship": "l_shipdate"}, only), value=F.lit("")),
        ]
    )


def world(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    """/world/nation[@key @name @region]/(customer or supplier)[@key @bal @seg]"""
    t = tables(spark, sf_dir)
    nation, region, c, s = t("nation"), t("region"), t("customer"), t("supplier")
    n = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    both = c.select(F.lit("customer").alias("what"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")).unionByName(
        s.select(F.lit("supplier").alias("what"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nat"), F.col("s_acctbal").alias("bal"), F.lit(None).cast("string").alias("seg"))
    )
    pre = F.shiftleft(F.col("nat").cast("long") + 1, 40) + F.shiftleft((F.col("key").cast("long") + 1) * 2 + F.when(F.col("what") == "customer", 0).otherwise(1), 4)
    parent = F.shiftleft(F.col("nat").cast("long") + 1, 40)
    nations = n.select(*N.row(doc_id=2, pre=F.shiftleft(F.col("n_nationkey").cast("long") + 1, 40), size=(1 << 40) - 1, level=2, parent=1, sib=F.col("n_nationkey").cast("long") + 1, kind=N.ELEMENT, local="nation", anc=F.array(F.lit(0), F.lit(1)), attrs=attributes(n, {"key": "n_nationkey", "name": "n_name", "region": "r_name"}, only)))
    people = both.select(*N.row(doc_id=2, pre=pre, size=15, level=3, parent=parent, sib=pre, kind=N.ELEMENT, local=F.col("what"), value=F.lit(""), anc=F.array(F.lit(0), F.lit(1), parent), attrs=attributes(both, {"key": "key", "bal": "bal", "seg": "seg"}, only)))
    return union([top(spark, "world", 2), nations, people])


def parts(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    """/parts/part[@key @brand @type @size @price]/name/text()"""
    p = tables(spark, sf_dir)("part")
    part = level_two(p, "part", F.col("p_partkey"), attributes(p, {"key": "p_partkey", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}, only), 3)
    name = with_text(level_three(p, "name", F.col("p_partkey"), F.lit(1), F.create_map().cast("map<string,string>"), 3, F.col("p_name")))
    return union([top(spark, "parts", 3), part, name])


def log(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    """/log/event[@id @user @type @value @ts]"""
    e = tables(spark, sf_dir)("events")
    return union([top(spark, "log", 4), level_two(e, "event", F.col("event_id"), attributes(e, {"id": "event_id", "user": "user_id", "type": "event_type", "value": "value", "ts": "ts"}, only), 4, F.lit(""))])


def chat(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    """One document per conversation: /conv[@id]/turn[@n @role]/text()"""
    c = tables(spark, sf_dir)("conversations")
    ids = c.select("conv_id").distinct()
    root = ids.select(*N.row(doc_id=F.col("conv_id"), pre=0, size=WHOLE, level=0, kind=N.ROOT, anc=F.array().cast("array<bigint>")))
    conv = ids.select(*N.row(doc_id=F.col("conv_id"), pre=1, size=WHOLE - 1, level=1, parent=0, kind=N.ELEMENT, local="conv", anc=F.array(F.lit(0)), attrs=attributes(ids, {"id": "conv_id"}, only)))
    pre = F.shiftleft(F.col("turn").cast("long") + 1, 4)
    turn = c.select(*N.row(doc_id=F.col("conv_id"), pre=pre, size=15, level=2, parent=1, sib=F.col("turn").cast("long") + 1, kind=N.ELEMENT, local="turn", value=F.col("text"), anc=F.array(F.lit(0), F.lit(1)), attrs=attributes(c, {"n": "turn", "role": "role"}, only)))
    return union([root, conv, with_text(turn)])
