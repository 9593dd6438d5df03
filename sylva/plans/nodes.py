"""The node table: one row per node of a tree, in document order.

``pre`` numbers a document's nodes in order, with gaps; ``size`` is such that exactly the descendants of a node have
pre < p <= pre + size. ``anc`` lists the ancestors' pre from the root down, so that ancestor and descendant steps are equi-joins.
Attributes and namespace declarations are maps in their element's row; a step to them explodes the map (``aord`` > 0 then
counts them) and a test of one is a lookup without a join. ``value`` is the text of text, comment, instruction and attribute
nodes, and of elements without element children; other elements' string values are put together on demand.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT, ELEMENT, TEXT, COMMENT, INSTRUCTION, ATTRIBUTE, NAMESPACE = "root", "elem", "text", "comment", "pi", "attr", "ns"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pre", T.LongType()),
        T.StructField("aord", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("parent", T.LongType()),
        T.StructField("sib", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ns", T.StringType()),
        T.StructField("local", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("anc", T.ArrayType(T.LongType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("nsdecl", T.MapType(T.StringType(), T.StringType())),
        T.StructField("node_id", T.LongType()),
    ]
)
COLUMNS = SCHEMA.fieldNames()
KEY = ["doc_id", "pre", "aord"]


def clark(ns: str | None, local: str) -> str:
    """The name of an attribute in ``attrs``."""
    return f"{{{ns}}}{local}" if ns else local


def row(**given) -> list[Column]:
    """All columns of a node, from the given ones; the rest are null, 0 or empty."""
    fixed = {"aord": F.lit(0), "size": F.lit(0), "ns": F.lit(""), "prefix": F.lit(""), "local": F.lit(""), "sib": F.lit(1)}
    out = []
    for f in SCHEMA:
        value = given.get(f.name, fixed.get(f.name))
        if value is None and f.name == "node_id":
            value = given["pre"]
        value = F.lit(value) if not isinstance(value, Column) else value
        out.append(value.cast(f.dataType).alias(f.name))
    return out


def conform(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])


def problems(nodes: DataFrame) -> DataFrame:
    """Rows that break an invariant, with its name: the consistency check of a store."""
    tree = nodes.where("aord = 0")
    up = tree.select("doc_id", F.col("pre").alias("parent"), F.col("size").alias("up_size"), F.col("level").alias("up_level"))
    joined = tree.where(F.col("parent").isNotNull()).join(up, ["doc_id", "parent"], "left")
    checks = {
        "no parent": F.col("up_size").isNull(),
        "outside its parent": (F.col("pre") <= F.col("parent")) | (F.col("pre") + F.col("size") > F.col("parent") + F.col("up_size")),
        "wrong level": F.col("level") != F.col("up_level") + 1,
        "wrong ancestors": F.element_at("anc", -1) != F.col("parent"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    bad = joined.select("doc_id", "pre", F.explode(found).alias("problem"))
    twice = tree.groupBy("doc_id", "pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "pre", F.lit("number used twice").alias("problem"))
    return bad.unionByName(twice)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the checkpoint folder, so that neither its plan nor its lineage grows with the rounds before it.

    The folder is the one that spark.checkpoint.dir names; where none is named, a local one, if Spark itself is local.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sylva-"))
    return df.checkpoint()
