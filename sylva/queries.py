"""Queries over the tables as trees, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ordering, updates, xslt
from .plans import nodes as N
from .plans.compile import Engine
from .sources import markup
from .sources import relational as R
from .streaming import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER_KEYS = {"by-cust": ("order", "@cust"), "by-key": ("order", "@key")}
PLACED = """(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS place FROM lineitem)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def order_tree(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(R.orders(spark, sf_dir), keys=ORDER_KEYS)


def of(tree: Callable[..., DataFrame], query_name: str, expression: str, sql: str, /, *, variables: dict | None = None, **columns: str) -> None:
    """Registers a query: a table of expressions over the nodes that a path selects."""
    QUERIES[query_name] = lambda spark, sf_dir: Engine(tree(spark, sf_dir), keys=ORDER_KEYS, variables=variables, only=lambda names: tree(spark, sf_dir, names)).table(expression, **columns)
    ORACLES[query_name] = sql


ITEM = {"order_key": "number(parent::order/@key)", "n": "number(@n)", "qty": "number(@qty)"}
OWN = {"key": "number(@key)"}
PART = {"key": "number(@key)"}
ITEM_SQL = "CAST(o_orderkey AS DOUBLE) AS order_key, CAST(l_linenumber AS DOUBLE) AS n, l_quantity AS qty"
JOINED = "orders JOIN lineitem ON l_orderkey = o_orderkey"
KEY_SQL = "SELECT CAST(o_orderkey AS DOUBLE) AS key FROM orders"

of(R.orders, "flagship", "//order[@status='F']/lineitem[@qty > 40]", f"SELECT {ITEM_SQL} FROM {JOINED} WHERE o_orderstatus = 'F' AND l_quantity > 40", **ITEM)
of(R.orders, "axis_child", "/orders/order[@prio='1-URGENT']/lineitem", f"SELECT {ITEM_SQL} FROM {JOINED} WHERE o_orderpriority = '1-URGENT'", **ITEM)
of(R.orders, "axis_descendant", "/orders/descendant::lineitem[@rf='R'][@qty >= 45]", f"SELECT {ITEM_SQL} FROM {JOINED} WHERE l_returnflag = 'R' AND l_quantity >= 45", **ITEM)
of(R.orders, "axis_descendant_or_self", "/orders/order[@status='P']/descendant-or-self::*", "SELECT 'order' AS what, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'lineitem', '' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'", what="local-name()", key="@key")
of(R.orders, "axis_parent", "//lineitem[@qty > 49]/..", f"{KEY_SQL} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)", **OWN)
of(R.orders, "axis_ancestor", "//lineitem[@qty > 49]/ancestor::order[@status='O']", f"{KEY_SQL} WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)", **OWN)
of(R.orders, "axis_ancestor_or_self", "//lineitem[@qty > 49]/ancestor-or-self::*", "SELECT 'orders' AS what, CAST(1 AS DOUBLE) AS n FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT 'order', CAST(1 AS DOUBLE) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT 'lineitem', CAST(1 AS DOUBLE) FROM lineitem WHERE l_quantity > 49", what="local-name()", n="1")
of(R.orders, "axis_following_sibling", "//lineitem[@n=1]/following-sibling::lineitem[@qty > 45]", f"WITH p AS {PLACED} SELECT {ITEM_SQL} FROM orders JOIN p ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND place > (SELECT min(q.place) FROM p q WHERE q.l_orderkey = p.l_orderkey AND q.l_linenumber = 1)", **ITEM)
of(R.orders, "axis_preceding_sibling", "//lineitem[@n=3]/preceding-sibling::lineitem[@qty > 45]", f"WITH p AS {PLACED} SELECT {ITEM_SQL} FROM orders JOIN p ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND place < (SELECT max(q.place) FROM p q WHERE q.l_orderkey = p.l_orderkey AND q.l_linenumber = 3)", **ITEM)
of(R.orders, "axis_preceding_nearest", "//lineitem[@n=3]/preceding-sibling::lineitem[1]", f"WITH p AS {PLACED}, x AS (SELECT DISTINCT a.* FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.place = b.place - 1 WHERE b.l_linenumber = 3) SELECT {ITEM_SQL} FROM orders JOIN x ON l_orderkey = o_orderkey", **ITEM)
of(R.orders, "axis_following", "//order[@key='100']/following::order[@status='P']", f"{KEY_SQL} WHERE o_orderstatus = 'P' AND o_orderkey > 100", **OWN)
of(R.orders, "axis_preceding", "//order[@key='700']/preceding::order[@status='P']", f"{KEY_SQL} WHERE o_orderstatus = 'P' AND o_orderkey < 700", **OWN)
of(R.orders, "axis_attribute", "//order[@status='P']/@price", "SELECT printf('%.2f', o_totalprice) AS price, 'price' AS name FROM orders WHERE o_orderstatus = 'P'", price=".", name="local-name()")
of(R.orders, "axis_attribute_all", "//order[@key < 50]/@*", "SELECT CAST(o_orderkey AS DOUBLE) AS key, name FROM orders, (VALUES ('key'), ('cust'), ('status'), ('price'), ('date'), ('prio')) v(name) WHERE o_orderkey < 50", key="number(../@key)", name="local-name()")
of(R.orders, "axis_self", "//*[self::order][@status='P']", f"{KEY_SQL} WHERE o_orderstatus = 'P'", **OWN)
of(R.parts, "test_text", "//part[@size='7']/name/text()", "SELECT p_name AS name FROM part WHERE p_size = 7", name=".")
of(R.orders, "pred_exists", "//order[lineitem[@rf='R']]", f"{KEY_SQL} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", **OWN)
of(R.orders, "pred_not", "//order[not(lineitem[@qty > 10])]", f"{KEY_SQL} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)", **OWN)
of(R.orders, "pred_and_or", "//order[(@status='F' or @status='P') and lineitem[@qty > 48] and not(@prio='5-LOW')]", f"{KEY_SQL} WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)", **OWN)
of(R.orders, "pred_attr_ne_lt", "//order[@prio != '1-URGENT'][@price < 50000]", f"{KEY_SQL} WHERE o_orderpriority <> '1-URGENT' AND round(o_totalprice, 2) < 50000", **OWN)
of(R.orders, "pred_path_comparison", "//order[lineitem/@rf = 'A']", f"{KEY_SQL} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')", **OWN)
of(R.world, "pred_existential_set", "//nation[customer/@key = supplier/@key]", "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey = n_nationkey AND s_nationkey = n_nationkey)", name="@name")
of(R.world, "pred_existential_less", "//nation[supplier/@bal > customer/@bal]", "SELECT n_name AS name FROM nation WHERE (SELECT max(round(s_acctbal, 2)) FROM supplier WHERE s_nationkey = n_nationkey) > (SELECT min(round(c_acctbal, 2)) FROM customer WHERE c_nationkey = n_nationkey)", name="@name")
of(R.world, "pred_absolute_set", "//customer[@key = //supplier[@bal > 5000]/@key]", "SELECT CAST(c_custkey AS DOUBLE) AS key FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)", **OWN)
of(R.orders, "pred_position", "//order/lineitem[2]", f"WITH p AS {PLACED} SELECT {ITEM_SQL} FROM orders JOIN p ON l_orderkey = o_orderkey WHERE place = 2", **ITEM)
of(R.orders, "pred_last", "//order/lineitem[last()]", f"WITH p AS {PLACED} SELECT {ITEM_SQL} FROM orders JOIN p ON l_orderkey = o_orderkey WHERE place = (SELECT max(q.place) FROM p q WHERE q.l_orderkey = p.l_orderkey)", **ITEM)
of(R.orders, "pred_position_range", "//order/lineitem[position() > 1 and position() <= 3]", f"WITH p AS {PLACED} SELECT {ITEM_SQL} FROM orders JOIN p ON l_orderkey = o_orderkey WHERE place BETWEEN 2 AND 3", **ITEM)
of(R.orders, "pred_chained", "//order/lineitem[@qty > 20][2]", f"WITH p AS {PLACED}, q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS k FROM p WHERE l_quantity > 20) SELECT {ITEM_SQL} FROM orders JOIN q ON l_orderkey = o_orderkey WHERE k = 2", **ITEM)
of(R.orders, "pred_node_set_position", "(//order[@status='P'])[position() <= 10]", "SELECT CAST(o_orderkey AS DOUBLE) AS key FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10)", **OWN)
of(R.orders, "fn_count", "//order[count(lineitem) > 6]", "SELECT CAST(l_orderkey AS DOUBLE) AS key, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) > 6", key="number(@key)", n="count(lineitem)")
of(R.orders, "fn_sum", "//order[@status='P']", "SELECT CAST(o_orderkey AS DOUBLE) AS key, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS qty FROM orders WHERE o_orderstatus = 'P'", key="number(@key)", qty="sum(lineitem/@qty)")
of(R.orders, "fn_avg_idiom", "//order[@status='P'][lineitem]", "SELECT CAST(o_orderkey AS DOUBLE) AS key, (SELECT avg(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS mean FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)", key="number(@key)", mean="sum(lineitem/@qty) div count(lineitem)")
of(R.world, "fn_max_idiom", "//supplier[not(@bal < ../supplier/@bal)]", "SELECT CAST(s_suppkey AS DOUBLE) AS key FROM supplier s WHERE round(s_acctbal, 2) = (SELECT max(round(t.s_acctbal, 2)) FROM supplier t WHERE t.s_nationkey = s.s_nationkey)", **OWN)
of(R.parts, "fn_strings", "//part", """SELECT CAST(p_partkey AS DOUBLE) AS key, upper(p_name) AS up, CAST(length(p_name) AS DOUBLE) AS n, substr(p_name, 2, 4) AS part, CASE WHEN strpos(p_name, ' ') > 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS first,
 CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS rest, translate(p_name, 'aeiou', 'AEIO') AS tr, contains(p_name, 'widget') AS has, starts_with(p_name, 's') AS s, p_brand || '/' || p_type AS both FROM part""",
   key="number(@key)", up="upper-case(name)", n="string-length(name)", part="substring(name, 2, 4)", first="substring-before(name, ' ')", rest="substring-after(name, ' ')", tr="translate(name, 'aeiou', 'AEIO')", has="contains(name, 'widget')", s="starts-with(name, 's')", both="concat(@brand, '/', @type)")
of(R.parts, "fn_numbers", "//part", "SELECT CAST(p_partkey AS DOUBLE) AS key, floor(round(p_retailprice, 2)) AS lo, ceil(round(p_retailprice, 2)) AS hi, floor(round(p_retailprice, 2) + 0.5) AS near, fmod(CAST(p_size AS DOUBLE), 7) AS m, CAST(p_size AS DOUBLE) / 4 AS q, CAST(p_size * 2 - 1 AS DOUBLE) AS a FROM part", key="number(@key)", lo="floor(@price)", hi="ceiling(@price)", near="round(@price)", m="@size mod 7", q="@size div 4", a="@size * 2 - 1")
of(R.parts, "fn_number_to_string", "//part", "SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE CAST(p_size / 4 AS VARCHAR) END AS q FROM part", key="string(number(@key))", q="string(@size div 4)")
of(R.parts, "fn_format_number", "//part", "SELECT CAST(p_partkey AS DOUBLE) AS key, format('{:,.2f}', round(p_retailprice, 2)) AS price, CAST(p_size AS VARCHAR) || '00%' AS pc FROM part", key="number(@key)", price="format-number(@price, '#,##0.00')", pc="format-number(@size, '0%')")
of(R.parts, "fn_if_boolean", "//part", "SELECT CAST(p_partkey AS DOUBLE) AS key, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS what, NOT (p_size > 25) AS no FROM part", key="number(@key)", what="if(@size > 25, 'big', 'small')", no="not(@size > 25)")
of(R.parts, "fn_name", "//part[@key='1']/*", "SELECT 'name' AS name, 'name' AS local, '' AS uri", name="name()", local="local-name()", uri="namespace-uri()")
of(R.orders, "variable_scalar", "//order[@cust = $c]", f"{KEY_SQL} WHERE o_custkey = 7", variables={"c": "7"}, **OWN)
of(R.orders, "key_lookup", "key('by-cust', '7')/lineitem", f"SELECT {ITEM_SQL} FROM {JOINED} WHERE o_custkey = 7", **ITEM)
of(R.orders, "key_join", "key('by-cust', //order[@key='5']/@cust)", f"{KEY_SQL} WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = 5)", **OWN)
of(R.orders, "key_grouping", "//order[generate-id() = generate-id(key('by-cust', @cust)[1])]", "SELECT CAST(min(o_orderkey) AS DOUBLE) AS key, CAST(o_custkey AS DOUBLE) AS cust FROM orders GROUP BY o_custkey", key="number(@key)", cust="number(@cust)")
of(R.orders, "uniq", "uniq(//order, @cust)", "SELECT CAST(min(o_orderkey) AS DOUBLE) AS key, CAST(o_custkey AS DOUBLE) AS cust FROM orders GROUP BY o_custkey", key="number(@key)", cust="number(@cust)")
of(R.orders, "set_union", "//order[@status='P'] | //order[@prio='1-URGENT']", f"{KEY_SQL} WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'", **OWN)
of(R.orders, "set_intersect", "intersect(//order[@status='P'], //order[@prio='1-URGENT'])", f"{KEY_SQL} WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'", **OWN)
of(R.orders, "set_except", "except(//order[@status='P'], //order[@prio='1-URGENT'])", f"{KEY_SQL} WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'", **OWN)
of(R.chat, "many_documents", "/conv/turn[last()][@role='user']", "SELECT CAST(conv_id AS DOUBLE) AS conv, text FROM conversations c WHERE role = 'user' AND turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)", conv="number(../@id)", text=".")


@query("value_per_document", "SELECT conv_id AS doc_id, CAST(count(*) AS DOUBLE) AS value FROM conversations WHERE role = 'user' GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 0.0 FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def value_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(R.chat(spark, sf_dir)).value("count(/conv/turn[@role='user'])")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(R.orders(spark, sf_dir)).select("//order")


@query("sort_text", "SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(row_number() OVER (ORDER BY lower(p_name), p_name, p_partkey) AS INTEGER) AS rank FROM part")
def sort_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(R.parts(spark, sf_dir))
    return ordering.ranked(e.strings("//part/name"), [{"key": F.col("string")}]).select((F.shiftright("parent", R.SHIFT) - 1).cast("string").alias("key"), "rank")


@query("sort_number_desc", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def sort_number_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_rows(spark, sf_dir).withColumn("cust", F.col("attrs")["cust"])
    return ordering.ranked(rows, [{"key": F.col("attrs")["price"], "type": "number", "order": "descending"}], ["cust"]).select(F.col("attrs")["key"].alias("key"), "rank")


@query("sort_multi_topk", "SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders ORDER BY lower(o_orderpriority), round(o_totalprice, 2) DESC, o_orderkey LIMIT 20")
def sort_multi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [{"key": F.col("attrs")["prio"]}, {"key": F.col("attrs")["price"], "type": "number", "order": "descending"}]
    return order_rows(spark, sf_dir).orderBy(*ordering.sort_columns(keys), "pre").limit(20).select(F.col("attrs")["key"].alias("key"))


@query("number_single", f"SELECT CAST(l_orderkey AS BIGINT) AS order_key, CAST(place AS INTEGER) AS number FROM {PLACED} JOIN orders ON l_orderkey = o_orderkey")
def number_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = Engine(R.orders(spark, sf_dir)).select("//order/lineitem")
    return ordering.number_single(nodes, "lineitem").select((F.shiftright("parent", R.SHIFT) - 1).alias("order_key"), F.col("number").cast("int").alias("number"))


@query("view_groupby", "SELECT event_type AS \"group\", count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def view_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.tables(spark, sf_dir)("events")
    journal = e.select(F.col("event_id").alias("seq"), F.lit("insert").alias("op"), F.lit(1).cast("long").alias("doc_id"), F.lit("event").alias("name"), F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("group"), "value")
    return views.view(journal, "event", n=F.count(F.lit(1)), total=F.round(F.sum("value"), 2))


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.tables(spark, sf_dir)("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return views.windowed(e, "ts", "1 hour", "10 minutes", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("page_titles")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.tables(spark, sf_dir)("pages")
    # each step and the gathering of texts read the nodes again, so they are parsed once, and only those that the path needs are kept
    nodes = N.cut(markup.shred(pages, "page_id", "html", "html", "normal", ("html", "head", "title")))
    return Engine(nodes).strings("/html/head/title").select("doc_id", F.col("string").alias("title"))


@query("page_links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.tables(spark, sf_dir)("pages")
    return Engine(markup.shred(pages, "page_id", "html", "html", "normal")).value("count(//a[starts-with(@href, '/')])")


@query("xupdate_remove", "SELECT CAST(conv_id AS BIGINT) AS doc_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 0 FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def xupdate_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = updates.remove(Engine(R.chat(spark, sf_dir)), "/conv/turn[@role != 'user']")
    return left.groupBy("doc_id").agg(F.count(F.when(F.col("local") == "turn", True)).alias("n"))


@query("xslt_for_each", "SELECT CAST(conv_id AS BIGINT) AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def xslt_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template match="/"><o><xsl:for-each select="conv/turn"><xsl:if test="@role = \'user\'"><xsl:value-of select="."/></xsl:if></xsl:for-each></o></xsl:template></xsl:stylesheet>'
    out = markup.serialize(xslt.transform(R.chat(spark, sf_dir), sheet), "text")
    return out.where("text <> ''")
