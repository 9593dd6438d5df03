"""XML and HTML text to node tables, and node tables to text.

Parsing has to see a document as a whole, so it runs in Python, in Arrow batches, one document per row; serialising is
sorting and joining of strings, which stays in the JVM.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans import nodes as N

XML = "http://www.w3.org/XML/1998/namespace"
#: Fixed values of HTML: elements without content, and elements whose text is not escaped.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style"])


class Builder:
    """Collects the rows of one document; numbers are dense.

    path: names of elements, the outermost first. Then only the nodes along it and those below its end have rows; numbers
    and sizes are as without it, but elements above its end have no value.
    """

    def __init__(self, doc_id: int, whitespace: str = "all", path: tuple[str, ...] = ()):
        self.doc_id, self.whitespace, self.path, self.count = doc_id, whitespace, path, 0
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.text: list[str] = []
        self.preserve = [False]
        self.add(N.ROOT)

    def add(self, kind: str, **given) -> dict:
        parent = self.open[-1] if self.open else None
        if parent is not None:
            parent["_n"] += 1
        number, level = self.count, len(self.open)
        self.count += 1
        if parent is not None and self.path and not (parent["_kept"] and (level > len(self.path) or (kind == N.ELEMENT and (given["ns"], given["local"]) == ("", self.path[level - 1])))):
            row = {"pre": number, "local": given.get("local", ""), "_n": 0, "_plain": False, "_kept": False}
            if kind == N.ELEMENT:
                parent["_plain"] = False
                self.open.append(row)
            return row
        row = {"doc_id": self.doc_id, "pre": number, "aord": 0, "size": 0, "level": level, "parent": parent["pre"] if parent else None, "sib": parent["_n"] if parent else 1, "kind": kind, "ns": "", "local": "", "prefix": "", "value": None, "anc": [x["pre"] for x in self.open], "attrs": None, "nsdecl": None, "node_id": number, "_n": 0, "_plain": level >= len(self.path), "_kept": True, "_at": len(self.rows)} | given
        self.rows.append(row)
        if kind in (N.ROOT, N.ELEMENT):
            if parent is not None:
                parent["_plain"] = False
            self.open.append(row)
        return row

    def flush(self) -> None:
        text, self.text = "".join(self.text), []
        if text and (text.strip(" \t\r\n") or self.whitespace == "all" or self.preserve[-1] or (self.whitespace == "xsl" and self.open[-1]["local"] == "text")):
            self.add(N.TEXT, value=text)

    def start(self, ns: str, local: str, prefix: str, attrs: dict, declared: dict) -> None:
        self.flush()
        space = attrs.get(N.clark(XML, "space"))
        self.preserve.append(space == "preserve" if space else self.preserve[-1])
        self.add(N.ELEMENT, ns=ns, local=local, prefix=prefix, attrs=attrs, nsdecl=declared or None)

    def end(self) -> None:
        self.flush()
        self.preserve.pop()
        row = self.open.pop()
        row["size"] = self.count - 1 - row["pre"]
        if row["_plain"]:
            row["value"] = "".join(r["value"] for r in self.rows[row["_at"] + 1 :] if r["kind"] == N.TEXT)

    def done(self) -> list[dict]:
        while len(self.open) > 1:
            self.end()
        self.flush()
        self.rows[0]["size"] = self.count - 1
        return self.rows


def split_name(name: str) -> tuple[str, str, str]:
    parts = name.split("\n")
    return ("", parts[0], "") if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else "")


def xml_rows(doc_id: int, source: str | bytes, whitespace: str = "all", path: tuple[str, ...] = ()) -> list[dict]:
    """Rows of an XML document, with its entities and namespaces resolved. Raises expat.ExpatError if it is not well formed."""
    b = Builder(doc_id, whitespace, path)
    p = expat.ParserCreate(namespace_separator="\n", encoding="utf-8" if isinstance(source, str) else None)
    p.namespace_prefixes = True
    p.ordered_attributes = True
    p.buffer_text = True
    pending: dict[str, str] = {}

    def start(name, attributes):
        pairs = {}
        for n, v in zip(attributes[::2], attributes[1::2], strict=True):
            ns, local, _ = split_name(n)
            pairs[N.clark(ns, local)] = v
        ns, local, prefix = split_name(name)
        b.start(ns, local, prefix, pairs, dict(pending))
        pending.clear()

    def declare(prefix, uri):
        pending[prefix or ""] = uri or ""

    def comment(text):
        b.flush()
        b.add(N.COMMENT, value=text)

    def instruction(target, text):
        b.flush()
        b.add(N.INSTRUCTION, local=target, value=text)

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda name: b.end(), lambda s: b.text.append(s)
    p.StartNamespaceDeclHandler, p.CommentHandler, p.ProcessingInstructionHandler = declare, comment, instruction
    p.Parse(source, True)
    return b.done()


class Html(HTMLParser):
    """Forgiving: void elements close at once, unknown ends are dropped, open elements end with their parents."""

    CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

    def __init__(self, builder: Builder):
        super().__init__(convert_charrefs=True)
        self.b = builder

    def handle_starttag(self, tag, attrs):
        while len(self.b.open) > 1 and self.b.open[-1]["local"] in self.CLOSES.get(tag, ()):
            self.b.end()
        self.b.start("", tag, "", {k: v or "" for k, v in attrs}, {})
        if tag in VOID:
            self.b.end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.b.end()

    def handle_endtag(self, tag):
        if tag not in VOID and any(r["local"] == tag for r in self.b.open[1:]):
            while self.b.open[-1]["local"] != tag:
                self.b.end()
            self.b.end()

    def handle_data(self, data):
        self.b.text.append(data)

    def handle_comment(self, data):
        self.b.flush()
        self.b.add(N.COMMENT, value=data)


def html_rows(doc_id: int, source: str, whitespace: str = "normal", path: tuple[str, ...] = ()) -> list[dict]:
    b = Builder(doc_id, whitespace, path)
    parser = Html(b)
    parser.feed(source)
    parser.close()
    return b.done()


def shred(df: DataFrame, id_col: str, text_col: str, form: str = "xml", whitespace: str = "all", path: tuple[str, ...] = ()) -> DataFrame:
    """The node table of the documents in a column (string or binary). Null documents have no nodes. path: see ``Builder``."""
    schema = to_arrow_schema(N.SCHEMA)
    parse = {"xml": xml_rows, "html": html_rows}[form]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        columns = {k: [r[k] for r in rows] for k in N.COLUMNS}
        for k in ("attrs", "nsdecl"):
            columns[k] = [None if x is None else list(x.items()) for x in columns[k]]
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for doc_id, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if source is not None:
                    rows += parse(doc_id, source, whitespace, path)
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, N.SCHEMA)


def read_xml(spark: SparkSession, path: str, whitespace: str | None = None) -> DataFrame:
    """Files of a path or glob as documents; their ids are hashes of their names, in ``files``. Stylesheets and update scripts keep white space as such files need."""
    files = spark.read.format("binaryFile").load(path)
    mode = whitespace or ("xsl" if path.endswith((".xsl", ".xup", ".xem.xml", ".xupdate.xml")) else "all")
    return shred(files.select(F.xxhash64("path").alias("doc_id"), "content"), "doc_id", "content", "xml", mode)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The file system as a table: path, length, modification time, folder, name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "modificationTime", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content of the members of zip files."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        yield pa.RecordBatch.from_pylist([{"archive": archive, "name": name, "content": z.read(name)}], pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def playlist(lines: DataFrame) -> DataFrame:
    """Lines of M3U playlists (column ``value``) as tracks: location, title, seconds; a comment line describes the next location."""
    tagged = lines.where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    from pyspark.sql import Window

    info = F.lag("value").over(Window.partitionBy(F.input_file_name()).orderBy("n"))
    tracks = tagged.withColumn("info", info).where(~F.col("value").startswith("#"))
    has = F.col("info").startswith("#EXTINF:")
    return tracks.select(F.trim("value").alias("location"), F.when(has, F.regexp_extract("info", r"^#EXTINF:-?\d+\s*,?(.*)$", 1)).alias("title"), F.when(has, F.regexp_extract("info", r"^#EXTINF:(-?\d+)", 1).cast("long")).alias("seconds"))


def escaped(c, quotes: bool = False):
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;")) if quotes else c


def serialize(nodes: DataFrame, method: str = "xml") -> DataFrame:
    """doc_id, text of each document. method: xml, html or text.

    Every node gives a start and, if it is an element, an end; sorted by place, they are the document.
    """
    kind = F.col("kind")
    name = F.when(F.col("prefix") != "", F.concat("prefix", F.lit(":"), "local")).otherwise(F.col("local"))
    entries = F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    attributes = F.concat_ws("", F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.concat(F.lit(" "), F.regexp_replace(F.replace(e["key"], F.lit("{" + XML + "}"), F.lit("xml:")), r"^\{.*\}", ""), F.lit('="'), escaped(e["value"], True), F.lit('"'))))
    declared = F.concat_ws("", F.transform(F.map_entries(F.coalesce("nsdecl", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.when(e["key"] != "", F.concat(F.lit(" xmlns:"), e["key"])).otherwise(F.lit(" xmlns")), F.lit('="'), escaped(e["value"], True), F.lit('"'))))
    if method == "text":
        start, end = F.when(kind == N.TEXT, F.col("value")), F.lit(None).cast("string")
    else:
        text = F.when(F.lit(method == "html") & F.col("_raw"), F.col("value")).otherwise(escaped(F.col("value")))
        start = F.when(kind == N.ELEMENT, F.concat(F.lit("<"), name, declared, attributes, F.lit(">"))).when(kind == N.TEXT, text).when(kind == N.COMMENT, F.concat(F.lit("<!--"), "value", F.lit("-->"))).when(kind == N.INSTRUCTION, F.concat(F.lit("<?"), "local", F.lit(" "), "value", F.lit("?>")))
        end = F.when((kind == N.ELEMENT) & ~(F.lit(method == "html") & F.col("local").isin(*VOID)), F.concat(F.lit("</"), name, F.lit(">")))
    raw = nodes.where(F.col("local").isin(*RAW)).select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("_raw")) if method == "html" else None
    df = nodes.join(raw, ["doc_id", "parent"], "left").withColumn("_raw", F.coalesce("_raw", F.lit(False))) if raw is not None else nodes.withColumn("_raw", F.lit(False))
    marks = F.array(F.struct(F.col("pre").alias("p"), F.lit(0).alias("e"), F.lit(0).cast("long").alias("q"), start.alias("s")), F.struct((F.col("pre") + F.col("size")).alias("p"), F.lit(1).alias("e"), (-F.col("pre")).alias("q"), end.alias("s")))
    parts = df.select("doc_id", F.explode(marks).alias("m")).where(F.col("m.s").isNotNull())
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select("doc_id", F.concat_ws("", F.transform("m", lambda m: m["s"])).alias("text"))
    return nodes.select("doc_id").distinct().join(whole, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
