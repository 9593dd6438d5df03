"""Updates of trees: XUpdate's operations as rewrites of the node table.

New nodes get order keys between old ones (arrays: a prefix sorts first), and one window per document numbers all anew.
``node_id`` stays what it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import nodes as N


class UpdateError(ValueError):
    """The targets of an update are not what it needs."""


def keyed(nodes: DataFrame) -> DataFrame:
    """Nodes with order keys: ``ord`` and the ancestors' ``up``."""
    return nodes.withColumn("ord", F.array("pre")).withColumn("up", F.transform("anc", lambda a: F.array(a)))


def renumber(df: DataFrame) -> DataFrame:
    """A node table from rows with doc_id, ord, up, kind, names, value, attrs, nsdecl, node_id: dense numbers in order of ``ord``.

    Values of elements are gathered anew from their texts.
    """
    df = df.withColumn("pre", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long") - 1)
    places = df.select("doc_id", F.col("ord").alias("_a"), F.col("pre").alias("_p"))
    lines = df.select("doc_id", "pre", "kind", "value", F.posexplode("up").alias("_i", "_a")).join(places, ["doc_id", "_a"])
    anc = lines.groupBy("doc_id", "pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda x: x["_p"]).alias("anc"))
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == N.TEXT, F.struct("pre", "value"))))
    below = lines.groupBy("doc_id", "_p").agg(F.max("pre").alias("_last"), F.max(F.col("kind") == N.ELEMENT).alias("_deep"), texts.alias("_t")).withColumnRenamed("_p", "pre")
    out = df.drop("anc", "size", "parent", "level", "sib").join(anc, ["doc_id", "pre"], "left").join(below, ["doc_id", "pre"], "left")
    out = out.withColumn("anc", F.coalesce("anc", F.array().cast("array<bigint>"))).withColumn("parent", F.try_element_at("anc", F.lit(-1)))
    text = F.concat_ws("", F.transform(F.coalesce("_t", F.array().cast("array<struct<pre:bigint,value:string>>")), lambda x: x["value"]))
    value = F.when(F.col("kind").isin(N.ELEMENT, N.ROOT), F.when(F.coalesce("_deep", F.lit(False)), F.lit(None).cast("string")).otherwise(text)).otherwise(F.col("value"))
    sib = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pre"))
    return N.conform(out.withColumns({"size": F.coalesce(F.col("_last") - F.col("pre"), F.lit(0)), "level": F.size("anc"), "sib": sib, "value": value, "aord": F.lit(0)}))


def targets(engine, path: str, exactly_one: bool = False) -> DataFrame:
    found = engine.select(path)
    if exactly_one and found.groupBy("doc_id").count().where("count <> 1").limit(1).count():
        raise UpdateError(f"{path!r} selects more than one node of a document")
    return found


def remove(engine, path: str) -> DataFrame:
    """The tree without the selected elements, with all below them, or without the selected attributes."""
    nodes, found = engine.nodes, targets(engine, path)
    gone = found.where("aord = 0").select("doc_id", F.col("pre").alias("_g"))
    below = nodes.select("doc_id", "pre", F.explode(F.array_append("anc", F.col("pre"))).alias("_g")).join(gone, ["doc_id", "_g"], "left_semi").select("doc_id", "pre")
    left = nodes.join(below, ["doc_id", "pre"], "left_anti")
    names = found.where("aord > 0").groupBy("doc_id", "pre").agg(F.collect_set(clark_of()).alias("_names"))
    left = left.join(names, ["doc_id", "pre"], "left").withColumn("attrs", F.when(F.col("_names").isNotNull(), F.map_filter("attrs", lambda k, v: ~F.array_contains("_names", k))).otherwise(F.col("attrs")))
    return renumber(keyed(left.drop("_names")))


def clark_of() -> Column:
    return F.when(F.col("ns") != "", F.concat(F.lit("{"), "ns", F.lit("}"), "local")).otherwise(F.col("local"))


def update(engine, path: str, value: str) -> DataFrame:
    """Attributes get a new value, texts and elements with one text a new text; an element without text gets one."""
    nodes, found = engine.nodes, targets(engine, path)
    attrs = found.where("aord > 0").groupBy("doc_id", "pre").agg(F.collect_set(clark_of()).alias("_names"))
    texts = found.where(F.col("kind") == N.TEXT).select("doc_id", "pre")
    elements = found.where((F.col("kind") == N.ELEMENT) & F.col("value").isNotNull()).select("doc_id", "pre")
    old = nodes.join(elements.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi").where(F.col("kind") == N.TEXT).select("doc_id", "pre")
    left = nodes.join(old, ["doc_id", "pre"], "left_anti").join(attrs, ["doc_id", "pre"], "left").join(texts.withColumn("_t", F.lit(True)), ["doc_id", "pre"], "left")
    left = left.withColumn("attrs", F.when(F.col("_names").isNotNull(), F.transform_values("attrs", lambda k, v: F.when(F.array_contains("_names", k), F.lit(value)).otherwise(v))).otherwise(F.col("attrs")))
    left = left.withColumn("value", F.when(F.col("_t"), F.lit(value)).otherwise(F.col("value"))).drop("_names", "_t")
    hosts = keyed(nodes).join(elements, ["doc_id", "pre"], "left_semi")
    return renumber(with_new(keyed(left), hosts, [("text", "", value, {})], "inside"))


def rename(engine, path: str, name: str) -> DataFrame:
    found = targets(engine, path)
    elements = found.where("aord = 0").select("doc_id", "pre").withColumn("_r", F.lit(True))
    attrs = found.where("aord > 0").groupBy("doc_id", "pre").agg(F.collect_set(clark_of()).alias("_names"))
    out = engine.nodes.join(elements, ["doc_id", "pre"], "left").join(attrs, ["doc_id", "pre"], "left")
    renamed = F.transform_keys("attrs", lambda k, v: F.when(F.array_contains("_names", k), F.lit(name)).otherwise(k))
    return N.conform(out.withColumn("local", F.when(F.col("_r"), F.lit(name)).otherwise(F.col("local"))).withColumn("attrs", F.when(F.col("_names").isNotNull(), renamed).otherwise(F.col("attrs"))))


PLACES = {"inside": "append", "before": "insert-before", "after": "insert-after"}


def with_new(df: DataFrame, hosts: DataFrame, content: list[tuple], where: str) -> DataFrame:
    """df and, for each host, new nodes: (kind, local, value, attributes) or (kind, local, [content], attributes)."""
    own = {"inside": (F.col("pre") + F.col("size"), -2 * F.col("level")), "after": (F.col("pre") + F.col("size"), -2 * F.col("level") + 1), "before": (F.col("pre") - 1, F.lit(1 << 40))}[where]
    base = F.array(own[0].cast("long"), own[1].cast("long"))
    up = F.array_append("up", F.col("ord")) if where == "inside" else F.col("up")
    rows = []

    def add(items, path, above) -> None:
        for i, (kind, local, value, attrs) in enumerate(items):
            key = F.concat(base, F.array(*[F.lit(x).cast("long") for x in (*path, i)]))
            pairs = F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv]) if attrs else F.create_map()
            text = value if isinstance(value, str) else None
            rows.append(
                hosts.select("doc_id", key.alias("ord"), F.concat(up, *[F.array(a) for a in above]).alias("up"), F.lit({"text": N.TEXT, "element": N.ELEMENT, "comment": N.COMMENT, "pi": N.INSTRUCTION}[kind]).alias("kind"), F.lit("").alias("ns"), F.lit(local).alias("local"), F.lit("").alias("prefix"), F.lit(text).cast("string").alias("value"), pairs.cast("map<string,string>").alias("attrs"), F.lit(None).cast("map<string,string>").alias("nsdecl"), F.xxhash64("doc_id", "node_id", key, F.lit(where)).alias("node_id"))
            )
            if not isinstance(value, str):
                add(value, (*path, i), [*above, key])

    add(content, (), [])
    columns = ["doc_id", "ord", "up", "kind", "ns", "local", "prefix", "value", "attrs", "nsdecl", "node_id"]
    out = df.select(*columns)
    for r in rows:
        out = out.unionByName(r.select(*columns))
    return out


def insert(engine, path: str, content: list[tuple], where: str = "inside") -> DataFrame:
    """append (inside), insert-before or insert-after: new nodes at each selected element; exactly one a document, as the operations ask for."""
    found = targets(engine, path, True)
    hosts = keyed(engine.nodes).join(found.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
    return renumber(with_new(keyed(engine.nodes), hosts, content, where))
