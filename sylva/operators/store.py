"""Versioned trees: branches of immutable revisions in Parquet, with a catalog that only grows.

A revision is a folder of node rows, written aside and listed in the catalog when it is whole, so readers never see half of
one. A fork lists its parent's folder: nothing is copied. A merge replays, by ``node_id``, what the fork changed since it left
its parent: changes of nodes that are gone are skipped, new nodes are put at the end of their parents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import nodes as N
from ..plans.compile import Engine
from .updates import keyed, renumber

CATALOG = "branch string, revision long, folder string, parent string, parent_revision long, event string, seq long"


class StoreError(ValueError):
    """A branch or revision is not there, or not in the state an operation needs."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # --- catalog

    def catalog(self) -> DataFrame:
        try:
            return self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], CATALOG)
            raise

    def log(self, branch: str, revision: int, folder: str | None, parent: str | None, parent_revision: int | None, event: str) -> None:
        seq = (self.catalog().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(branch, revision, folder, parent, parent_revision, event, seq)], CATALOG).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    def entries(self, branch: str) -> list:
        rows = self.catalog().where(F.col("branch") == branch).orderBy("seq").collect()
        if not rows or rows[-1]["event"] == "drop":
            raise StoreError(f"no branch {branch!r}")
        return rows

    def branches(self) -> DataFrame:
        """The live branches with their heads and what they were forked from."""
        last = Window.partitionBy("branch").orderBy(F.desc("seq"))
        return self.catalog().withColumn("n", F.row_number().over(last)).where("n = 1 and event <> 'drop'").select("branch", "revision", "parent", "parent_revision")

    # --- reading and writing

    def create_branch(self, branch: str, nodes: DataFrame) -> int:
        if self.catalog().where(F.col("branch") == branch).limit(1).count():
            raise StoreError(f"the branch {branch!r} exists")
        return self.write(branch, 1, nodes, None, None, "create")

    def write(self, branch: str, revision: int, nodes: DataFrame, parent, parent_revision, event: str) -> int:
        folder = f"{self.path}/nodes/{uuid.uuid4().hex}"
        N.conform(nodes).write.parquet(folder)
        self.log(branch, revision, folder, parent, parent_revision, event)
        return revision

    def open(self, branch: str, revision: int | None = None) -> DataFrame:
        """The nodes of a revision, or of the head."""
        for row in reversed(self.entries(branch)):
            if row["folder"] and (revision is None or row["revision"] == revision):
                return self.spark.read.schema(N.SCHEMA).parquet(row["folder"])
        raise StoreError(f"no revision {revision} of {branch!r}")

    def xpath(self, branch: str, expression: str, **how) -> DataFrame:
        return Engine(self.open(branch), **how).select(expression)

    def commit(self, branch: str, nodes: DataFrame) -> int:
        head = self.entries(branch)[-1]
        return self.write(branch, head["revision"] + 1, nodes, head["parent"], head["parent_revision"], "commit")

    def fork(self, branch: str, name: str, revision: int | None = None) -> None:
        rows = [r for r in self.entries(branch) if revision is None or r["revision"] == revision]
        if not rows:
            raise StoreError(f"no revision {revision} of {branch!r}")
        if self.catalog().where(F.col("branch") == name).limit(1).count():
            raise StoreError(f"the branch {name!r} exists")
        self.log(name, 1, rows[-1]["folder"], branch, rows[-1]["revision"], "fork")

    def drop(self, branch: str) -> None:
        self.log(branch, self.entries(branch)[-1]["revision"], None, None, None, "drop")

    def check(self, branch: str) -> DataFrame:
        return N.problems(self.open(branch))

    def merge(self, fork: str) -> int:
        """Brings a fork's changes into its parent as a new revision, and drops the fork."""
        head = self.entries(fork)[-1]
        if head["parent"] is None:
            raise StoreError(f"{fork!r} is not a fork")
        merged = merge(self.open(head["parent"], head["parent_revision"]), self.open(fork), self.open(head["parent"]))
        revision = self.commit(head["parent"], merged)
        self.drop(fork)
        return revision


def merge(base: DataFrame, theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """ours with the changes from base to theirs."""
    ids = ["doc_id", "node_id"]
    removed = base.select(*ids).join(theirs.select(*ids), ids, "left_anti")
    gone = ours.join(removed, ids, "left_semi").select("doc_id", F.col("pre").alias("_g"))
    below = ours.select("doc_id", "pre", F.explode(F.array_append("anc", F.col("pre"))).alias("_g")).join(gone, ["doc_id", "_g"], "left_semi").select("doc_id", "pre")
    kept = ours.join(below, ["doc_id", "pre"], "left_anti")
    state = F.struct("local", "ns", F.when(F.col("kind") != N.ELEMENT, F.col("value")).alias("value"), F.array_sort(F.map_entries("attrs")).alias("attrs"))
    old, new = base.select(*ids, state.alias("_old")), theirs.select(*ids, state.alias("_new"), F.col("local").alias("_l"), F.col("value").alias("_v"), F.col("attrs").alias("_a"))
    changed = old.join(new, ids).where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*ids, "_l", "_v", "_a", F.lit(True).alias("_c"))
    kept = kept.join(changed, ids, "left").withColumns({"local": F.when(F.col("_c"), F.col("_l")).otherwise(F.col("local")), "value": F.when(F.col("_c"), F.col("_v")).otherwise(F.col("value")), "attrs": F.when(F.col("_c"), F.col("_a")).otherwise(F.col("attrs"))}).drop("_l", "_v", "_a", "_c")
    added = theirs.join(base.select(*ids), ids, "left_anti")
    # the lowest ancestor that is not new is where a new node hangs; its place in theirs orders what hangs there
    tree = theirs.select("doc_id", F.col("pre").alias("_p"), F.col("node_id").alias("_id"), F.col("level").alias("_lv"))
    line = added.select("doc_id", "pre", F.explode("anc").alias("_p")).join(tree, ["doc_id", "_p"])
    news = added.select("doc_id", F.col("node_id").alias("_id"), F.lit(True).alias("_new"))
    line = line.join(news, ["doc_id", "_id"], "left")
    host = line.groupBy("doc_id", "pre").agg(F.max_by("_id", F.when(F.col("_new").isNull(), F.col("_lv"))).alias("_host"), F.array_sort(F.collect_list(F.when(F.col("_new"), F.col("_p")))).alias("_between"))
    ends = kept.select("doc_id", F.col("node_id").alias("_host"), F.array((F.col("pre") + F.col("size")), -2 * F.col("level").cast("long")).alias("_base"), F.array_append(F.transform("anc", lambda a: F.array(a)), F.array("pre")).alias("_up"))
    hung = added.join(host, ["doc_id", "pre"]).join(ends, ["doc_id", "_host"])
    grafted = hung.withColumn("ord", F.array_append("_base", F.col("pre"))).withColumn("up", F.concat("_up", F.transform("_between", lambda p: F.array_append(F.col("_base"), p))))
    columns = ["doc_id", "ord", "up", "kind", "ns", "local", "prefix", "value", "attrs", "nsdecl", "node_id"]
    return renumber(keyed(kept).select(*columns).unionByName(grafted.select(*columns)))
