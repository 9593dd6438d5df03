"""Sorting keys and numbers of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import nodes as N


def text_key(c: Column, case_order: str = "upper-first") -> list[Column]:
    """Leading space and, at first, case don't count; equal texts are told apart by case."""
    t = F.ltrim(c)
    tie = F.translate(t, S.UPPER + S.LOWER, S.LOWER + S.UPPER) if case_order == "lower-first" else t
    return [S.lower_case(t), tie]


def sort_columns(keys: list[dict]) -> list[Column]:
    """keys: {"key": Column, "type": "text" or "number", "order": "ascending" or "descending", "case_order": ...}, most important first."""
    out = []
    for k in keys:
        kind, order = k.get("type", "text"), k.get("order", "ascending")
        if kind not in ("text", "number") or order not in ("ascending", "descending"):
            raise ValueError(f"no sort by {kind} {order}")
        if kind == "number":
            number = S.to_number(k["key"]) if k.get("string", True) else k["key"]
            parts = [F.when(F.isnan(number), F.lit(-S.INFINITY)).otherwise(number)]
        else:
            parts = text_key(k["key"], k.get("case_order", "upper-first"))
        out += [p.desc() if order == "descending" else p.asc() for p in parts]
    return out


def ranked(df: DataFrame, keys: list[dict], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The place of each row within its group by the keys, then in document order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(group or ["doc_id"])).orderBy(*sort_columns(keys), *N.KEY)))


ROMAN = {1000: ["", "M", "MM", "MMM"], 100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], 10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], 1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]}


def format_integer(n: Column, token: str = "1", separator: str = "", size: int = 0) -> Column:
    """A whole number by a format token: 1, 01, A, a, I, i; optional grouping of digits. Roman numbers end at 3999, beyond which, and below 1, digits are used."""
    n = n.cast("long")
    digits = n.cast("string")
    if token in ("A", "a"):
        letters = F.lit("")
        rest = n
        for _ in range(7):
            letter = F.substring(F.lit(S.UPPER), (F.pmod(rest - 1, F.lit(26)) + 1).cast("int"), F.lit(1))
            letters = F.when(rest > 0, F.concat(letter, letters)).otherwise(letters)
            rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
        out = F.when(n > 0, letters).otherwise(digits)
        return F.lower(out) if token == "a" else out
    if token in ("I", "i"):
        parts = [F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor(n / unit), F.lit(len(names))) + 1).cast("int")) for unit, names in ROMAN.items()]
        out = F.when((n > 0) & (n < 4000), F.concat(*parts)).otherwise(digits)
        return F.lower(out) if token == "i" else out
    if set(token[:-1]) <= {"0"} and token[-1:] == "1":
        out = F.when(F.length(digits) < len(token), F.lpad(digits, len(token), "0")).otherwise(digits)
        if separator and size:
            out = F.reverse(F.regexp_replace(F.reverse(out), rf"(\d{{{size}}})(?=\d)", f"$1{separator}"))
        return out
    return digits


def number_single(nodes: DataFrame, local: str) -> DataFrame:
    """Each ``local`` element with ``number``: its place among like siblings."""
    found = nodes.where((F.col("kind") == N.ELEMENT) & (F.col("local") == local))
    return found.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("sib", "pre")))


def number_any(nodes: DataFrame, local: str) -> DataFrame:
    """Each ``local`` element with ``number``: its place in the document."""
    found = nodes.where((F.col("kind") == N.ELEMENT) & (F.col("local") == local))
    return found.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")))


def number_multiple(nodes: DataFrame, locals_: list[str], separator: str = ".") -> DataFrame:
    """Each element of the names with ``number``: the places of it and its like-named ancestors, from the outermost in."""
    found = nodes.where((F.col("kind") == N.ELEMENT) & F.col("local").isin(locals_))
    place = found.select("doc_id", F.col("pre").alias("_p"), F.row_number().over(Window.partitionBy("doc_id", "parent", "local").orderBy("sib", "pre")).alias("_n"))
    line = found.select("doc_id", "pre", F.explode(F.array_append("anc", F.col("pre"))).alias("_p")).join(place, ["doc_id", "_p"])
    numbers = line.groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("_p", "_n"))).alias("_l"))
    return found.join(numbers, ["doc_id", "pre"]).withColumn("number", F.concat_ws(separator, F.transform("_l", lambda x: x["_n"].cast("string")))).drop("_l")
