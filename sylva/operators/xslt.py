"""Stylesheets, set at a time.

A context is a frame with one row per node to be processed; each row knows where its output goes: ``out`` (the result document),
``ord`` (an order key: a list that its output's keys begin with) and ``up`` (the keys of the output's ancestors). An
instruction maps a whole context to output rows; for-each and apply-templates make a longer key with each node's
place. Templates are chosen for all nodes at once: patterns become key sets, the best by import precedence, priority, then position, wins.
apply-templates goes round by round, as deep as templates call each other, not node by node, and so do named templates that call
themselves; a round takes all contexts of a mode together. At last one window numbers the output.

Variables are columns of the context: values, or the number of a set of nodes or of a piece of result that is a frame of its own.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import nodes as N
from ..plans.compile import NODES, STRING, Engine, union
from ..functions import scalars as S
from ..plans.xpath import Call, Literal, Op, Path, Step, Test, Variable, parse, parse_avt, positional
from .ordering import format_integer, sort_columns
from .updates import renumber

XSL = "{http://www.w3.org/1999/XSL/Transform}"
INSTRUCTIONS = frozenset("apply-templates apply-imports call-template for-each if choose variable param value-of copy-of copy element attribute text comment processing-instruction number message sequence fallback result-document".split())
ROUNDS = 10_000  # of templates calling each other: beyond, a stylesheet is taken to go on for ever
OUT = ["out", "ord", "up", "kind", "ns", "local", "value", "attrs"]


class StylesheetError(ValueError):
    """The stylesheet uses something wrongly or something that is not there."""


@dataclass
class Template:
    pattern: object | None
    name: str | None
    mode: str
    priority: float
    place: int
    body: list
    text: str | None = None
    precedence: int = 0
    lowest: int = 0  # the least precedence among what its stylesheet imports


@dataclass
class Stylesheet:
    templates: list[Template] = field(default_factory=list)
    keys: dict = field(default_factory=dict)
    globals: list = field(default_factory=list)
    output: dict = field(default_factory=dict)
    attribute_sets: dict = field(default_factory=dict)
    formats: dict = field(default_factory=dict)
    strip: list = field(default_factory=list)
    preserve: list = field(default_factory=list)
    aliases: dict = field(default_factory=dict)  # namespace in the stylesheet -> namespace in the result
    precedence: int = 0


def priority_of(pattern) -> float:
    """The default priority of one alternative of a pattern."""
    if not isinstance(pattern, Path) or pattern.start == "root" or len(pattern.steps) != 1 or pattern.steps[0].predicates:
        return 0.5
    test = pattern.steps[0].test
    if test.kind == "name":
        return 0.0 if test.local != "*" else -0.5 if test.prefix is None else -0.25
    return 0.0 if test.local else -0.5


def alternatives(pattern) -> list:
    return [p for a in pattern.args for p in alternatives(a)] if isinstance(pattern, Op) and pattern.name == "|" else [pattern]


def prefixes(text: str) -> dict[str, str]:
    """The namespaces that a stylesheet declares, by prefix."""
    return {prefix or "": uri for _, (prefix, uri) in ET.iterparse(io.StringIO(text), ["start-ns"])}


def load(text: str, resolve=None, into: Stylesheet | None = None, trail: tuple = ()) -> Stylesheet:
    """A stylesheet from its text. resolve: href -> text, for import and include. What is imported has a lower precedence than what imports it,
    and a later import a higher one than an earlier; what is included counts as if it stood there."""
    sheet = into or Stylesheet()
    root, declared = ET.fromstring(text), prefixes(text)
    lowest = sheet.precedence
    for e in root:
        if e.tag == XSL + "import":
            fetched(e, resolve, sheet, trail)
            sheet.precedence += 1
    own = sheet.precedence
    for e in root:
        what = e.tag.removeprefix(XSL) if e.tag.startswith(XSL) else None
        if what == "include":
            fetched(e, resolve, sheet, trail)
        elif what == "template":
            for p in alternatives(parse(e.get("match"))) if e.get("match") else [None]:
                rank = float(e.get("priority")) if e.get("priority") else (priority_of(p) if p is not None else 0.0)
                sheet.templates.append(Template(p, e.get("name"), e.get("mode", ""), rank, len(sheet.templates), list(e), e.text, own, lowest))
        elif what == "key":
            sheet.keys[e.get("name")] = (e.get("match"), e.get("use"))
        elif what in ("variable", "param"):
            sheet.globals = [g for g in sheet.globals if g.get("name") != e.get("name")] + [e]
        elif what == "output":
            cdata = " ".join(x for x in (sheet.output.get("cdata-section-elements"), e.get("cdata-section-elements")) if x)
            sheet.output |= e.attrib | ({"cdata-section-elements": cdata} if cdata else {})
        elif what == "attribute-set":
            sheet.attribute_sets.setdefault(e.get("name"), []).append(e)
        elif what == "decimal-format":
            sheet.formats[e.get("name", "")] = {k: v for k, v in e.attrib.items() if k != "name"}
        elif what in ("strip-space", "preserve-space"):
            named = [(declared.get(n.split(":")[0]), n.split(":")[1]) if ":" in n else (None if n == "*" else "", n) for n in e.get("elements").split()]
            (sheet.strip if what == "strip-space" else sheet.preserve).extend(named)
        elif what == "namespace-alias":
            one, two = (declared.get("" if x == "#default" else x, "") for x in (e.get("stylesheet-prefix"), e.get("result-prefix")))
            sheet.aliases[one] = two
        elif what not in ("import", None):
            raise StylesheetError(f"xsl:{what} is not known at the top level")
    return sheet


def fetched(e, resolve, sheet: Stylesheet, trail: tuple) -> None:
    href = e.get("href")
    if href in trail:
        raise StylesheetError(f"{href!r} imports or includes itself")
    text = resolve(href) if resolve else None
    if text is None:
        raise StylesheetError(f"no way to find {href!r}")
    load(text, resolve, sheet, (*trail, href))


def stripped(nodes: DataFrame, sheet: Stylesheet) -> DataFrame:
    """Nodes without the blank texts of elements to strip: a name decides before a namespace's names, and those before all names."""
    if not sheet.strip:
        return nodes
    decided = F.lit(0)
    for ns, local, yes in [(*n, 1) for n in sheet.strip] + [(*n, -1) for n in sheet.preserve]:
        rank = 1 if ns is None else 2 if local == "*" else 3
        hit = (F.lit(True) if ns is None else F.col("ns") == ns) & (F.lit(True) if local == "*" else F.col("local") == local)
        decided = F.when(hit & (rank >= F.abs(decided)), F.lit(rank * yes)).otherwise(decided)
    hosts = nodes.where((F.col("kind") == N.ELEMENT) & (decided > 0)).select("doc_id", F.col("pre").alias("parent"))
    blank = nodes.where((F.col("kind") == N.TEXT) & (F.trim(F.regexp_replace("value", r"[ \t\r\n]+", " ")) == "")).join(hosts, ["doc_id", "parent"], "left_semi").select("doc_id", "pre")
    return nodes.join(blank, ["doc_id", "pre"], "left_anti")


class Transform:
    def __init__(self, nodes: DataFrame, sheet: Stylesheet, params: dict | None = None, functions: dict | None = None, documents: dict | None = None, namespaces: dict | None = None):
        self.sheet = sheet
        self.engine = Engine(stripped(nodes, sheet), namespaces, {"#decimal-formats": sheet.formats}, sheet.keys, functions, documents)
        self.params = params or {}
        self.choices: dict[tuple, DataFrame] = {}
        self.pending: list[tuple[object, DataFrame]] = []  # (mode, precedence below) or a recursive template, and its context
        self.calls: list[int] = []  # the named templates that are being inlined
        self.template: Template | None = None
        self.holders = False  # whether content of attributes, comments and instructions is to be joined at the end
        self.messages: list[DataFrame] = []
        self.kinds: dict[str, tuple] = {}  # of variables, by column
        self.serial = 0

    def with_globals(self, context: DataFrame) -> DataFrame:
        """The starting context with global variables; a set of nodes is global to the engine."""
        for e in self.sheet.globals:
            name = e.get("name")
            if e.tag == XSL + "param" and name in self.params:
                self.engine.variables[name] = self.params[name]
                continue
            select = parse(e.get("select")) if e.get("select") else None
            if select is not None and not self.engine.local(select) and self.engine.kind(select) == NODES:
                frame = self.engine.select(e.get("select"))
                self.engine.variables[name] = frame
            elif isinstance(getattr(select, "value", None), (str, int, float)):
                self.engine.variables[name] = select.value
            else:
                context = self.bind(e, context)
        return context

    # --- templates

    def chosen(self, mode: str, below: tuple | None = None) -> DataFrame | None:
        """doc_id, pre, aord, template of each node that a template of the mode matches. below: (lowest, highest) precedence to choose among."""
        if (mode, below) not in self.choices:
            found = []
            for t in self.sheet.templates:
                if t.pattern is not None and t.mode == mode and (below is None or below[0] <= t.precedence < below[1]):
                    p = t.pattern
                    if not isinstance(p, Path):  # key() or id()
                        nodes = self.engine.evaluate(p, None)
                    elif p.start == "root":
                        nodes = self.engine.evaluate(p, None)
                    elif p.start is not None:
                        nodes = self.engine.evaluate(p, None)
                    else:
                        first = p.steps[0]
                        anywhere = Step("descendant", first.test, first.predicates) if first.axis in ("child", "descendant") and not any(map(positional, first.predicates)) else first
                        lead = () if anywhere.axis not in ("attribute", "child") else (Step("descendant-or-self", Test("node")),)
                        nodes = self.engine.evaluate(Path("root", (*lead, anywhere, *p.steps[1:])), None)
                    found.append(nodes.select(*N.KEY, F.lit(t.precedence).alias("_i"), F.lit(t.priority).alias("_r"), F.lit(t.place).alias("template")))
            best = Window.partitionBy(*N.KEY).orderBy(F.desc("_i"), F.desc("_r"), F.desc("template"))
            self.choices[mode, below] = union(found).withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*N.KEY, "template") if found else None
        return self.choices[mode, below]

    def rounds(self) -> list[DataFrame]:
        """The output of what is pending, and of all that it leaves to do in turn."""
        out: list[DataFrame] = []
        for _ in range(ROUNDS):
            work: dict[tuple, tuple] = {}
            for what, context in self.pending:  # contexts with the same columns are one
                key = (what if isinstance(what, tuple) else what.place, tuple(sorted(context.dtypes)))
                work[key] = (what, work[key][1].unionByName(context)) if key in work else (what, context)
            self.pending = []
            for what, context in work.values():
                context = N.cut(context)
                if context.isEmpty():
                    continue
                before = dict(self.engine.variables)
                self.seen(context)
                if isinstance(what, tuple):
                    out += self.apply(*what, context)
                else:
                    out += self.run_template(what, context)
                self.engine.variables = before
            if not self.pending:
                return out
        raise StylesheetError(f"templates call each other more than {ROUNDS} times")

    def seen(self, context: DataFrame) -> None:
        """A template sees global variables only; parameters that were given to it wait in the columns."""
        self.engine.variables = {k: v for k, v in self.engine.variables.items() if not isinstance(v, tuple) or f"var {k}" in self.global_columns}

    def run_template(self, t: Template, context: DataFrame) -> list[DataFrame]:
        before, self.template = self.template, t
        out = self.body(t.body, t.text, context)
        self.template = before
        return out

    def run(self) -> DataFrame:
        """The node table of each document's result."""
        start = self.engine.roots().drop("it").withColumns({"out": F.col("doc_id"), "ord": F.array(F.lit(0).cast("long")), "up": F.array(F.array(F.lit(-1).cast("long")))})
        out = [start.select("out", F.array(F.lit(-1).cast("long")).alias("ord"), F.array().cast("array<array<bigint>>").alias("up"), *made(N.ROOT))]
        self.global_columns: frozenset = frozenset()
        start = self.with_globals(start)
        self.global_columns = frozenset(c for c in start.columns if c.startswith("var "))
        self.pending = [(("", None), start)]
        out += self.rounds()
        rows = union(out)
        rows = self.joined_content(rows) if self.holders else rows
        rows = N.cut(rows)  # read several times below
        attrs = rows.where(F.col("kind") == N.ATTRIBUTE).select("out", F.try_element_at("up", F.lit(-1)).alias("ord"), F.struct(F.col("ord").alias("o"), F.when(F.col("ns") != "", F.concat(F.lit("{"), "ns", F.lit("}"), "local")).otherwise(F.col("local")).alias("local"), "value").alias("a"))
        pairs = attrs.groupBy("out", "ord").agg(F.array_sort(F.collect_list("a")).alias("_a"))
        latest = F.aggregate("_a", F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, v: k != a["local"]), F.create_map(a["local"], a["value"])))
        fixed = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
        both = F.map_concat(F.map_filter(fixed, lambda k, v: ~F.array_contains(F.map_keys("_l"), k)), F.col("_l"))
        tree = rows.where(F.col("kind") != N.ATTRIBUTE).join(pairs, ["out", "ord"], "left").withColumn("_l", latest).withColumn("attrs", F.when(F.col("_a").isNotNull(), both).otherwise(F.col("attrs")))
        return renumber(tree.select(F.col("out").alias("doc_id"), "ord", "up", "kind", "ns", "local", F.lit("").alias("prefix"), "value", "attrs", F.lit(None).cast("map<string,string>").alias("nsdecl"), F.xxhash64("ord").alias("node_id")))

    @staticmethod
    def joined_content(rows: DataFrame) -> DataFrame:
        """Attributes, comments and instructions with content: their value is the text of what stands in them, which goes."""
        holder = F.col("kind").isin(N.ATTRIBUTE, N.COMMENT, N.INSTRUCTION) & F.col("value").isNull()
        holders = rows.where(holder).select("out", F.col("ord").alias("_h")).distinct()
        inside = rows.select("out", F.explode("up").alias("_h"), "ord", "kind", "value").join(holders, ["out", "_h"])
        text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == N.TEXT, F.struct("ord", "value")))), lambda x: x["value"]))
        values = inside.groupBy("out", "_h").agg(text.alias("_text")).withColumnRenamed("_h", "ord")
        left = rows.join(inside.select("out", "ord").distinct(), ["out", "ord"], "left_anti").join(values, ["out", "ord"], "left")
        return left.withColumn("value", F.when(holder, F.coalesce("_text", F.lit(""))).otherwise(F.col("value"))).select(*OUT)

    def apply(self, mode: str, below: tuple | None, context: DataFrame) -> list[DataFrame]:
        choice = self.chosen(mode, below)
        out, rest = [], context
        if choice is not None:
            tagged = context.join(choice.withColumnsRenamed({c: f"_m_{c}" for c in N.KEY}), [F.col(c) == F.col(f"_m_{c}") for c in N.KEY], "left").drop(*[f"_m_{c}" for c in N.KEY])
            for t in self.sheet.templates:
                if t.pattern is not None and t.mode == mode and (below is None or below[0] <= t.precedence < below[1]):
                    out += self.run_template(t, tagged.where(F.col("template") == t.place).drop("template"))
            rest = tagged.where(F.col("template").isNull()).drop("template")
        texts = rest.where(F.col("kind").isin(N.TEXT, N.ATTRIBUTE))
        out.append(texts.select("out", "ord", "up", *made(N.TEXT, value=F.col("value"))))
        rest = rest.drop(*[c for c in rest.columns if c.startswith("var ") and c not in self.global_columns])
        self.descend(mode, rest.where(F.col("kind").isin(N.ROOT, N.ELEMENT)), Path(None, (Step("child", Test("node")),)), [], 0)
        return out

    def descend(self, mode: str, context: DataFrame, select, sorts: list, place: int) -> None:
        self.pending.append(((mode, None), self.each(context, select, sorts, place)))

    def parameters(self, e, context: DataFrame) -> DataFrame:
        """A context for another template: of the variables only the global ones and those that are given to it."""
        before = dict(self.engine.variables)
        given = {}
        for p in e:
            if p.tag == XSL + "with-param":
                context, given[p.get("name")] = self.bound(p, context, f"given {p.get('name')}")
        context = context.drop(*[c for c in context.columns if c.startswith("var ") and c not in self.global_columns])
        for name, column in given.items():
            context = context.withColumnRenamed(column, f"var {name}")
            self.kinds[f"var {name}"] = (f"var {name}", *self.kinds[column][1:])
        self.engine.variables = before
        return context

    # --- instructions

    def carried(self, context: DataFrame) -> list[str]:
        return [c for c in context.columns if c not in N.COLUMNS and c != "it" and not c.startswith("_")]

    def each(self, context: DataFrame, select, sorts: list, place: int) -> DataFrame:
        """The selected nodes as a context, each with its own order key."""
        carried = self.carried(context)
        found = self.engine.evaluate(select, context.select(F.struct(*carried, *self.engine.current_fields(select)).alias("it"), *N.COLUMNS))
        keys = []
        for s in sorts:
            found, col = self.engine.scalar(parse(s.get("select", ".")), found, STRING)
            for option in ("order", "data-type", "case-order", "lang"):
                if "{" in s.get(option, ""):
                    value = parse_avt(s.get(option))
                    known = self.engine.variables.get(getattr(value.args[0], "name", None)) if isinstance(value, Call) and isinstance(value.args[0], Variable) else None
                    if not isinstance(known, str):
                        raise StylesheetError(f"{option} of a sort must be fixed, or a global value")
                    s.set(option, known)
            lang = s.get("lang", "")
            keys.append({"key": col, "type": s.get("data-type", "text"), "order": s.get("order", "ascending"), "case_order": s.get("case-order", "lower-first" if lang.startswith("en") else "upper-first")})
        rank = F.row_number().over(Window.partitionBy("it").orderBy(*sort_columns(keys), *N.KEY)).cast("long")
        found = found.withColumn("_rank", rank)
        kept = [F.col(f"it.{c}").alias(c) for c in carried if c != "ord"]
        return found.select(*N.COLUMNS, *kept, F.concat("it.ord", F.array(F.lit(place).cast("long"), F.col("_rank"))).alias("ord"))

    def value(self, ast, context: DataFrame, kind: str = STRING) -> tuple[DataFrame, Column]:
        """The expression's value for each row; the frame still has its ``it``."""
        return self.engine.scalar(ast, context.withColumn("it", F.struct(*self.carried(context), *self.engine.current_fields(ast))), kind)

    def body(self, elements: list, text: str | None, context: DataFrame) -> list[DataFrame]:
        out: list[DataFrame] = []
        before = dict(self.engine.variables)
        self.literal(text, context, 0, out)
        for i, e in enumerate(elements):
            context = self.instruction(e, context, 2 * i + 1, out)
            self.literal(e.tail, context, 2 * i + 2, out)
        self.engine.variables = before
        return out

    def literal(self, text: str | None, context: DataFrame, place: int, out: list) -> None:
        if text and text.strip():
            out.append(context.select("out", key(place).alias("ord"), "up", *made(N.TEXT, value=F.lit(text))))

    def children(self, e, context: DataFrame, place: int) -> list[DataFrame]:
        return self.body(list(e), e.text, context.withColumn("ord", key(place)))

    def inside(self, e, context: DataFrame, place: int) -> list[DataFrame]:
        """The content of a new element at ``place``."""
        moved = context.withColumn("ord", key(place))
        return self.body(list(e), e.text, moved.withColumn("up", F.array_append("up", F.col("ord"))))

    def attribute_rows(self, name: str, value: Column, context: DataFrame, place: int, n: int) -> DataFrame:
        here = key(place)
        return context.select("out", F.concat(here, F.array(F.lit(-1).cast("long"), F.lit(n).cast("long"))).alias("ord"), F.array_append("up", here).alias("up"), *made(N.ATTRIBUTE, local=F.lit(name), value=value))

    def instruction(self, e, context: DataFrame, place: int, out: list) -> DataFrame:
        """Adds an instruction's output; gives the context for the ones after it, which a variable makes wider."""
        engine = self.engine
        if not e.tag.startswith(XSL):
            ns, local = e.tag[1:].split("}") if e.tag.startswith("{") else ("", e.tag)
            if ns and any(c.tag == XSL + "fallback" for c in e):
                for c in e:
                    if c.tag == XSL + "fallback":
                        out += self.children(c, context, place)
                return context
            out.append(context.select("out", key(place).alias("ord"), "up", *made(N.ELEMENT, ns=F.lit(self.sheet.aliases.get(ns, ns)), local=F.lit(local))))
            for n, (name, text) in enumerate(e.attrib.items()):
                if name == XSL + "use-attribute-sets":
                    self.use_sets(text, context, place, out)
                    continue
                if name.startswith(XSL):
                    continue
                df, col = self.value(parse_avt(text), context)
                out.append(self.attribute_rows(name, col, df, place, n))
            out += self.inside(e, context, place)
            return context
        what = e.tag.removeprefix(XSL)
        select = parse(e.get("select")) if e.get("select") else None
        if what in ("value-of", "sequence"):
            df, col = self.value(select, context)
            out.append(df.select("out", key(place).alias("ord"), "up", *made(N.TEXT, value=col)).where("value <> ''"))
        elif what == "text":
            out.append(context.select("out", key(place).alias("ord"), "up", *made(N.TEXT, value=F.lit(e.text or ""))))
        elif what in ("for-each", "apply-templates"):
            sorts = [c for c in e if c.tag == XSL + "sort"]
            select = select or Path(None, (Step("child", Test("node")),))
            if what == "apply-templates":
                self.descend(e.get("mode", ""), self.parameters(e, context), select, sorts, place)
            else:
                rest = [c for c in e if c.tag != XSL + "sort"]
                out += self.body(rest, e.text if not sorts else None, self.each(context, select, sorts, place))
        elif what == "if":
            df, col = self.value(parse(e.get("test")), context, "boolean")
            out += self.children(e, df.where(col).select(*context.columns), place)
        elif what == "choose":
            rest = context
            for c in e:
                if c.tag == XSL + "when":
                    df, col = self.value(parse(c.get("test")), rest, "boolean")
                    df = df.withColumn("_test", col)
                    out += self.children(c, df.where("_test").select(*context.columns), place)
                    rest = df.where("not _test").select(*context.columns)
                else:
                    out += self.children(c, rest, place)
        elif what in ("variable", "param", "with-param"):
            return self.bind(e, context)
        elif what == "call-template":
            found = [t for t in self.sheet.templates if t.name == e.get("name")]
            if not found:
                raise StylesheetError(f"no template {e.get('name')!r}")
            t = max(found, key=lambda t: (t.precedence, t.place))
            given = self.parameters(e, context).withColumn("ord", key(place))
            if t.place in self.calls or t is self.template:  # it calls itself: in the next round, where rows are left
                self.pending.append((t, given))
            else:
                self.calls.append(t.place)
                before = dict(engine.variables)
                self.seen(given)
                out += self.run_template(t, given)
                engine.variables = before
                self.calls.pop()
        elif what == "copy-of" and isinstance(select, Variable) and isinstance(v := engine.variables.get(select.name), tuple) and len(v) > 3:
            out.append(self.copied_result(v, context, place))
        elif what == "copy-of":
            if engine.kind(select) != NODES:
                df, col = self.value(select, context)
                out.append(df.select("out", key(place).alias("ord"), "up", *made(N.TEXT, value=col)))
            else:
                self.copied(self.each(context, select, [], place), out)
        elif what == "copy":
            own = context.where(F.col("kind").isin(N.ELEMENT, N.TEXT, N.COMMENT, N.INSTRUCTION))
            out.append(own.select("out", key(place).alias("ord"), "up", F.col("kind"), F.col("ns"), F.col("local"), F.col("value"), F.lit(None).cast("map<string,string>").alias("attrs")))
            out.append(context.where(F.col("kind") == N.ATTRIBUTE).select("out", key(place).alias("ord"), "up", *made(N.ATTRIBUTE, local=F.col("local"), value=F.col("value"))))
            if e.get("use-attribute-sets"):
                self.use_sets(e.get("use-attribute-sets"), context.where(F.col("kind") == N.ELEMENT), place, out)
            out += self.inside(e, context.where(F.col("kind") == N.ELEMENT), place)
            out += self.children(e, context.where(F.col("kind") == N.ROOT), place)
        elif what == "element":
            df, col = self.value(parse_avt(e.get("name")), context)
            df = df.withColumn("_name", col)
            good = F.col("_name").rlike(r"^[^\W\d][\w.\-]*(:[^\W\d][\w.\-]*)?$")
            uri = F.lit("")
            if e.get("namespace"):
                df, uri = self.value(parse_avt(e.get("namespace")), df)
            out.append(df.where(good).select("out", key(place).alias("ord"), "up", *made(N.ELEMENT, ns=uri, local=F.regexp_replace("_name", "^.*:", ""))))
            if e.get("use-attribute-sets"):
                self.use_sets(e.get("use-attribute-sets"), df.where(good).select(*context.columns), place, out)
            out += self.inside(e, df.where(good).select(*context.columns), place)
            out += self.children(e, df.where(~good).select(*context.columns), place)
        elif what in ("attribute", "comment", "processing-instruction"):
            kind = {"attribute": N.ATTRIBUTE, "comment": N.COMMENT}.get(what, N.INSTRUCTION)
            df, name, uri = context, F.lit(""), F.lit("")
            if what != "comment":
                df, name = self.value(parse_avt(e.get("name")), df)
            if e.get("namespace"):
                df, uri = self.value(parse_avt(e.get("namespace")), df)
            simple = simple_content(e)
            if simple is not None:
                df, col = self.value(simple, df)
            else:
                self.holders, col = True, F.lit(None).cast("string")
                out += self.inside(e, context, place)
            out.append(df.select("out", key(place).alias("ord"), "up", *made(kind, ns=uri, local=F.regexp_replace(name, "^.*:", ""), value=col)))
        elif what == "number":
            out.append(self.numbered(e, context, place))
        elif what == "message":
            self.messages += self.children(e, context, place)
            if e.get("terminate") == "yes" and not context.limit(1).isEmpty():
                raise StylesheetError("a message ends the transformation")
        elif what == "result-document":
            df, col = self.value(parse_avt(e.get("href")), context)
            out += self.children(e, df.withColumns({"out": F.xxhash64(col), "up": F.array(F.array(F.lit(-1).cast("long")))}).select(*context.columns), place)
            out.append(df.select(F.xxhash64(col).alias("out"), F.array(F.lit(-1).cast("long")).alias("ord"), F.array().cast("array<array<bigint>>").alias("up"), *made(N.ROOT)).dropDuplicates(["out"]))
        elif what == "apply-imports":
            t = self.template
            given = self.parameters(e, context).withColumn("ord", key(place))
            self.pending.append(((t.mode, (t.lowest, t.precedence)), given))
        elif what != "fallback":
            raise StylesheetError(f"xsl:{what} is not known")
        return context

    def use_sets(self, names: str, context: DataFrame, place: int, out: list) -> None:
        n = -1000
        for name in names.split():
            for set_ in self.sheet.attribute_sets.get(name, []):
                if set_.get("use-attribute-sets"):
                    self.use_sets(set_.get("use-attribute-sets"), context, place, out)
                for a in set_:
                    simple = simple_content(a)
                    if simple is None:
                        raise StylesheetError("an attribute set's attributes hold texts and values only")
                    df, col = self.value(simple, context)
                    out.append(self.attribute_rows(a.get("name"), col, df, place, n))
                    n += 1

    # --- variables

    def bind(self, e, context: DataFrame) -> DataFrame:
        """A variable as a column; a parameter that was given stays."""
        name = e.get("name")
        column = f"var {name}"
        if e.tag == XSL + "param" and column in context.columns:
            self.engine.variables[name] = self.kinds.get(column, (column, STRING))
            return context
        context, _ = self.bound(e, context, column)
        self.engine.variables[name] = self.kinds[column]
        return context

    def bound(self, e, context: DataFrame, column: str) -> tuple[DataFrame, str]:
        """The context with a column for the value of a variable's element."""
        simple = parse(e.get("select")) if e.get("select") else simple_content(e)
        if simple is not None:
            kind = self.engine.kind(simple)
            if kind == NODES:
                return self.bound_set(simple, context, column), column
            df, col = self.value(simple, context, kind)
            self.kinds[column] = (column, kind)
            return df.withColumn(column, col).select(*dict.fromkeys([*context.columns, column])), column
        # a piece of result: its rows are kept by the place they would have had, its text is a column
        self.serial += 1
        here = F.array_append("ord", F.lit(-self.serial - 10).cast("long"))
        waiting, self.pending = self.pending, []
        frame = self.body(list(e), e.text, context.withColumns({"ord": here, "up": F.array(here)})) + self.rounds()
        self.pending = waiting
        rows = union(frame) if frame else None
        rows = self.joined_content(rows) if self.holders else rows
        rows = N.cut(rows.withColumn("_of", F.element_at("up", 1)))
        text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == N.TEXT, F.struct("ord", "value")))), lambda x: x["value"]))
        texts = rows.groupBy(F.col("out").alias("_out"), "_of").agg(text.alias("_text"))
        df = context.join(texts, (F.col("out") == F.col("_out")) & (here == F.col("_of")), "left").withColumn(column, F.coalesce("_text", F.lit(""))).drop("_out", "_of", "_text")
        self.kinds[column] = (column, STRING, None, (rows, -self.serial - 10))
        return df.select(*dict.fromkeys([*context.columns, column])), column

    def bound_set(self, select, context: DataFrame, column: str) -> DataFrame:
        """A set of nodes for each row, by the row's place in the output, which no other row has."""
        number = F.xxhash64("out", "ord", F.struct(*N.KEY))
        df = context.withColumn(column, number)
        found = self.engine.evaluate(select, df.select(F.struct(*self.carried(df), *self.engine.current_fields(select)).alias("it"), *N.COLUMNS))
        self.kinds[column] = (column, NODES, found.select(F.col("it").getField(column).alias("_of"), *N.COLUMNS))
        return df

    def copied_result(self, variable: tuple, context: DataFrame, place: int) -> DataFrame:
        """A piece of result that a variable holds, at ``place`` of each row."""
        rows, mark = variable[3]
        at = context.select(F.col("out").alias("_out"), F.col("ord").alias("_o"), F.col("up").alias("_u"), key(place).alias("_k"))
        # the variable was made at this place or further out
        held = rows.withColumn("_n", F.size("_of") - 1).withColumn("_host", F.slice("_of", F.lit(1), F.size("_of") - 1))
        both = held.join(at, (F.col("out") == F.col("_out")) & (F.slice("_o", F.lit(1), F.size("_host")) == F.col("_host")))
        moved = lambda c: F.concat("_k", F.slice(c, F.size("_of") + 1, F.greatest(F.size(c) - F.size("_of"), F.lit(0))))
        ups = F.transform(F.slice("up", F.lit(2), F.greatest(F.size("up") - 1, F.lit(0))), moved)
        return both.select("out", moved(F.col("ord")).alias("ord"), F.concat("_u", ups).alias("up"), "kind", "ns", "local", "value", "attrs")

    # --- numbers

    def numbered(self, e, context: DataFrame, place: int) -> DataFrame:
        tokens, level = e.get("format", "1"), e.get("level", "single")
        how = (e.get("grouping-separator", ""), int(e.get("grouping-size", "0")))
        parts = re.findall(r"\w+|[^\w]+", tokens)
        before = parts.pop(0) if parts and not parts[0].isalnum() else ""
        after = parts.pop() if parts and not parts[-1].isalnum() else ""
        names, marks = [p for p in parts if p.isalnum()] or ["1"], [p for p in parts if not p.isalnum()]
        if e.get("value") or level in ("single", "any"):
            df, col = self.value(parse(e.get("value")), context, "number") if e.get("value") else self.value(number_of(e, level), context, "number")
            whole = F.when(~F.isnan(col) & (F.abs(col) < 1e15), S.rounded(col))
            shown = F.when(whole > 0, F.concat(F.lit(before), format_integer(whole, names[0], *how), F.lit(after))).otherwise("" if not e.get("value") else S.to_string(col))
            return df.select("out", key(place).alias("ord"), "up", *made(N.TEXT, value=shown)).where("value <> ''")
        if level != "multiple" or e.get("from"):
            raise StylesheetError(f"xsl:number of level {level!r} with these attributes is not known")
        line = parse(f"ancestor-or-self::{e.get('count') or '*'}")
        df = context.withColumn("it", F.struct(*self.carried(context)))
        found = self.engine.evaluate(line, df.select("it", *N.COLUMNS))
        found, n = self.engine.scalar(parse(f"count(preceding-sibling::{e.get('count') or '*'}) + 1"), found, "number")
        lists = found.withColumn("_n", n).groupBy(F.col("it.out").alias("_out"), F.col("it.ord").alias("_o")).agg(F.array_sort(F.collect_list(F.struct("level", "_n"))).alias("_l"))
        # all numbers but the first few are shown by the last token, after the last mark
        shown = F.transform("_l", lambda x, i: F.concat(*[F.when(i == 0, F.lit("")).otherwise(pick(marks or ["."], i - 1)), pick([format_integer(x["_n"], t, *how) for t in names], i)]))
        df = df.join(lists, (F.col("out") == F.col("_out")) & (F.col("ord") == F.col("_o")))
        return df.select("out", key(place).alias("ord"), "up", *made(N.TEXT, value=F.concat(F.lit(before), F.concat_ws("", shown), F.lit(after))))

    def copied(self, found: DataFrame, out: list) -> None:
        """Deep copies of a context's nodes."""
        nodes = self.engine.nodes
        attrs = found.where("aord > 0")
        out.append(attrs.select("out", "ord", "up", *made(N.ATTRIBUTE, local=F.col("local"), value=F.col("value"))))
        tops = found.where("aord = 0").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_top"), "out", F.col("ord").alias("_o"), F.col("up").alias("_u"))
        deep = nodes.select("*", F.explode(F.array_append("anc", F.col("pre"))).alias("_a")).join(tops, (F.col("doc_id") == F.col("_d")) & (F.col("_a") == F.col("_top")))
        line = F.filter("anc", lambda a: a >= F.col("_top"))
        own = F.concat("_o", F.array("pre"))
        rows = deep.where(F.col("kind") != N.ROOT).select("out", own.alias("ord"), F.concat("_u", F.transform(line, lambda a: F.concat(F.col("_o"), F.array(a)))).alias("up"), "kind", "ns", "local", "value", "attrs")
        out.append(rows)


def pick(choices: list, i: Column) -> Column:
    """The i-th of the choices, or the last one."""
    col = choices[-1] if isinstance(choices[-1], Column) else F.lit(choices[-1])
    for n in range(len(choices) - 1):
        col = F.when(i == n, choices[n]).otherwise(col)
    return col


def number_of(e, level: str):
    """A node's number as an expression. Names of what is counted may be alternatives of names."""
    count, start = e.get("count") or "*", e.get("from")
    if level == "single":
        inside = f"[ancestor::{start}]" if start else ""
        host = f"ancestor-or-self::{count}{inside}[1]"
        return parse(f"count({host}/preceding-sibling::{count}) + count({host})")
    every = f"(preceding::{count} | ancestor-or-self::{count})"
    if not start:
        return parse(f"count({every})")
    last = f"(preceding::{start} | ancestor-or-self::{start})[last()]"
    return parse(f"count({every}) - count({last}/preceding::{count} | {last}/ancestor::{count})")


def simple_content(e):
    """The content of an element as one expression, if it holds texts and values only; else None."""
    parts = [e.text] if e.text and e.text.strip() else []
    for c in e:
        if c.tag == XSL + "value-of":
            parts.append(parse(c.get("select")))
        elif c.tag == XSL + "text":
            parts.append(c.text or "")
        else:
            return None
        if c.tail and c.tail.strip():
            parts.append(c.tail)
    asts = [Literal(p) if isinstance(p, str) else Call("string", (p,)) for p in parts]
    return Literal("") if not asts else asts[0] if len(asts) == 1 else Call("concat", tuple(asts))


def key(place: int) -> Column:
    return F.concat("ord", F.array(F.lit(place).cast("long")))


def made(kind: str, **given: Column) -> list[Column]:
    values = {"kind": F.lit(kind), "ns": F.lit(""), "local": F.lit(""), "value": F.lit(None).cast("string"), "attrs": F.lit(None).cast("map<string,string>")} | given
    return [v.alias(name) for name, v in values.items()]


def transform(nodes: DataFrame, stylesheet: str, params: dict | None = None, resolve=None, **how) -> DataFrame:
    """The node table of each document's result under a stylesheet."""
    return Transform(nodes, load(stylesheet, resolve), params, **how).run()
