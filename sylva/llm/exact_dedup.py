"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Every row belongs to one of ``fan_in ** levels`` runs (by a hash of its place). A run holds each digest once,
with the largest and smallest id of its rows and their number. In round r, ``fan_in`` neighbouring runs are
exchanged and merged: the aggregates carry a struct, so Spark sorts each run by its digests and merges the
sorted runs (SortAggregate), with a partial merge before every exchange. After the last round one run, spread
over all tasks by digest, holds the survivors. The decision then goes down the same tree, level by level, so
that no join ever meets more than ``fan_in`` rows of a digest: a text that fills a third of the corpus
is spread over all runs.

Texts are read and hashed once: digests are stored, and all rounds work on them. The tree's depth grows with the table, so that
a run's share of a digest stays bounded.

Verified: what is merged is not the SHA-256 alone but (SHA-256, length in bytes, xxhash64), so two texts meet
only if all three agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, stored

KEYS = ["digest", "n_bytes", "check"]


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 16, levels: int | None = None, run_rows: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    A null text counts as empty; texts are equal when identical. ``keep``: "largest" or "smallest" id.
    A null id never wins against another; rows that repeat an id are one document and get the same values, each
    counted in ``group_size``. An empty table gives an empty result. ``levels``: rounds of merging; by default as many as
    leave about ``run_rows`` rows to each first run, and 2 at least.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    text = F.coalesce("text", F.lit(""))
    digests = docs_of(df, id_col, text_col).select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"))
    # which run a row is in depends on its place in the table: rows without an id, or with the same one, are spread too
    digests = stored(digests.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "digests")
    if levels is None:
        levels = max(2, math.ceil(math.log(max(1, digests.count() / run_rows), fan_in)))
    rows = digests.withColumn("run0", F.pmod("place", F.lit(fan_in**levels)))
    best = F.max if keep == "largest" else F.min
    up = [rows.groupBy(*KEYS, "run0").agg(best(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))).alias("best"), F.count(F.lit(1)).alias("size"))]
    for level in range(1, levels + 1):
        run = F.floor(F.col(f"run{level - 1}") / fan_in).cast("long")
        up.append(up[-1].select(*KEYS, run.alias(f"run{level}"), "best", "size").groupBy(*KEYS, f"run{level}").agg(best("best").alias("best"), F.sum("size").alias("size")))
    down = up[-1].select(*KEYS, f"run{levels}", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"))
    for level in range(levels - 1, -1, -1):
        run = F.floor(F.col(f"run{level}") / fan_in).cast("long")
        members = up[level].select(*KEYS, f"run{level}", run.alias(f"run{level + 1}"))
        down = members.join(down, [*KEYS, f"run{level + 1}"]).drop(f"run{level + 1}")
    return rows.join(down, [*KEYS, "run0"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs[id_col].cast("long").eqNullSafe(kept["__id"]), "left_semi")
