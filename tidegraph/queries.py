"""Queries over the driver's tables, each running an operator of the engine, and the same in DuckDB's SQL.

FK is the graph of foreign keys (an order depends on its customer and suppliers, these on their nation, this on its region); ADJ the graph of
parts on neighbouring lines of an order, which has cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import jsscan, paths, pyimports, rules
from .operators import classify, graph, report
from .operators.closure import reverse_closure
from .operators.detect import detected, facts
from .operators.graph import Graph
from .operators.impact import compute, impact_rows
from .plans import jest, pytest
from .sources import tree


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def project() -> Column:
    return F.lit("p").alias("project")


def fk_edges(spark: SparkSession, sf: str) -> DataFrame:
    nation, customer, supplier = (read(spark, sf, t) for t in ("nation", "customer", "supplier"))
    orders, lineitem = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    e = [
        nation.select(key("nation", "n_nationkey"), key("region", "n_regionkey")),
        customer.select(key("customer", "c_custkey"), key("nation", "c_nationkey")),
        supplier.select(key("supplier", "s_suppkey"), key("nation", "s_nationkey")),
        orders.select(key("order", "o_orderkey"), key("customer", "o_custkey")),
        lineitem.select("l_orderkey", "l_suppkey").distinct().select(key("order", "l_orderkey"), key("supplier", "l_suppkey")),
    ]
    out = e[0].toDF("src", "dst")
    for x in e[1:]:
        out = out.unionByName(x.toDF("src", "dst"))
    return out.select(project(), "src", "dst")


def fk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders are tests; customers in debt are dynamic."""
    no = F.lit(False)
    n = [
        read(spark, sf, "region").select(key("region", "r_regionkey"), no, no),
        read(spark, sf, "nation").select(key("nation", "n_nationkey"), no, no),
        read(spark, sf, "customer").select(key("customer", "c_custkey"), no, F.col("c_acctbal") < 0),
        read(spark, sf, "supplier").select(key("supplier", "s_suppkey"), no, no),
        read(spark, sf, "orders").select(key("order", "o_orderkey"), F.col("o_orderstatus") == "F", no),
    ]
    out = n[0].toDF("node_id", "has_tests", "has_dynamic")
    for x in n[1:]:
        out = out.unionByName(x.toDF("node_id", "has_tests", "has_dynamic"))
    return out.select(project(), "node_id", "has_tests", "has_dynamic")


def fk_graph(spark: SparkSession, sf: str) -> Graph:
    """Each node owns one file, r/KIND/KEY.go."""
    nodes = fk_nodes(spark, sf)
    p = F.concat(F.lit("r/"), F.replace("node_id", F.lit(":"), F.lit("/")), F.lit(".go"))
    files = nodes.select("project", "node_id", p.alias("path")).withColumn("dir", paths.parent(F.col("path")))
    return Graph("go", nodes, files, fk_edges(spark, sf))


def adj_edges(spark: SparkSession, sf: str, least: int | None = None) -> DataFrame:
    """ADJ, or with ``least`` the graph of the lines of at least that quantity only: its neighbours need not be neighbours in ADJ."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = read(spark, sf, "lineitem")
    li = (li if least is None else li.where(F.col("l_quantity") >= least)).select("l_orderkey", "l_linenumber", "l_partkey")
    return li.select(project(), F.col("l_partkey").cast("string").alias("src"), F.lead("l_partkey").over(w).cast("string").alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


FK_SQL = """
fk AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem
)"""
ADJ_SQL = """
adj AS (
  SELECT DISTINCT src, dst FROM (SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS VARCHAR) AS dst FROM lineitem WHERE l_quantity >= 45)
  WHERE dst IS NOT NULL AND src <> dst
)"""
ADJ_ALL_SQL = """
adj AS (
  SELECT DISTINCT src, dst FROM (SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS VARCHAR) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst
)"""
QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- closures and impact


@query(f"WITH RECURSIVE {FK_SQL}, c AS (SELECT 'region:0' AS node_id UNION SELECT src FROM fk JOIN c ON dst = node_id) SELECT node_id FROM c")
def impact_fk_closure(spark, sf):
    return reverse_closure(fk_edges(spark, sf), spark.createDataFrame([("region:0",)], "node_id string")).select("node_id")


@query(f"WITH RECURSIVE {ADJ_SQL}, c AS (SELECT src AS node_id FROM adj WHERE CAST(src AS BIGINT) % 100 = 0 UNION SELECT src FROM adj JOIN c ON dst = node_id) SELECT node_id FROM c")
def impact_adj_closure(spark, sf):
    e = adj_edges(spark, sf, 45).persist()
    return reverse_closure(e, e.where("cast(src AS long) % 100 = 0").select(F.col("src").alias("node_id"))).select("node_id")


@query(
    f"""WITH RECURSIVE {ADJ_ALL_SQL}, c AS (SELECT CAST(l_partkey AS VARCHAR) AS node_id FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem) UNION SELECT src FROM adj JOIN c ON dst = node_id)
SELECT node_id FROM c"""
)
def impact_adj_closure_all(spark, sf):
    """As ``impact_adj_closure``, over all of ADJ; the change set is the parts on the lines shipped last."""
    li = read(spark, sf, "lineitem")
    last = li.agg(F.max("l_shipdate").alias("l_shipdate"))
    seeds = li.join(F.broadcast(last), "l_shipdate").select(F.col("l_partkey").cast("string").alias("node_id"))
    return reverse_closure(adj_edges(spark, sf), seeds).select("node_id")


def region_changes(spark, sf) -> DataFrame:
    """A change set for each region, named after it, of the region's own file."""
    r = key("region", "r_regionkey")
    return read(spark, sf, "region").select(project(), r.alias("change_set_id"), F.lit(0).alias("ord"), F.concat(F.lit("r/region/"), F.col("r_regionkey").cast("string"), F.lit(".go")).alias("path"))


KEYED_SQL = "c AS (SELECT 'region:' || r_regionkey AS change_set_id, 'region:' || r_regionkey AS node_id FROM region UNION SELECT change_set_id, src FROM fk JOIN c ON dst = node_id)"


@query(f"WITH RECURSIVE {FK_SQL}, {KEYED_SQL} SELECT change_set_id, CAST(count(*) AS BIGINT) AS n_nodes, min(node_id) AS first_node, max(node_id) AS last_node FROM c GROUP BY change_set_id")
def impact_batched_changesets(spark, sf):
    r = key("region", "r_regionkey")
    seeds = read(spark, sf, "region").select(r.alias("change_set_id"), r.alias("node_id"))
    c = reverse_closure(fk_edges(spark, sf), seeds, seed_keys=["change_set_id"])
    return c.groupBy("change_set_id").agg(F.count("*").alias("n_nodes"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))


TESTS_SQL = "t AS (SELECT 'order:' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'F')"
DYN_SQL = "u AS (SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0 UNION SELECT src FROM fk JOIN u ON dst = node_id)"
NATION_SQL = "c AS (SELECT 'nation:3' AS node_id UNION SELECT src FROM fk JOIN c ON dst = node_id)"


def nation_rows(spark, sf) -> DataFrame:
    changes = spark.createDataFrame([("p", "one", 0, "r/nation/3.go"), ("p", "one", 1, "r/readme.md")], "project string, change_set_id string, ord int, path string")
    return impact_rows(fk_graph(spark, sf), changes)[1]


@query(f"WITH RECURSIVE {FK_SQL}, {TESTS_SQL}, {DYN_SQL}, {NATION_SQL} SELECT node_id FROM u WHERE node_id IN (SELECT node_id FROM t) EXCEPT SELECT node_id FROM c")
def impact_uncertain_targets(spark, sf):
    return nation_rows(spark, sf).where("kind = 'uncertain'").select("node_id")


@query(f"WITH RECURSIVE {FK_SQL}, {TESTS_SQL}, {DYN_SQL}, {NATION_SQL} SELECT node_id FROM (SELECT node_id FROM u UNION SELECT node_id FROM c) WHERE node_id IN (SELECT node_id FROM t)")
def impact_targets(spark, sf):
    return nation_rows(spark, sf).where("kind = 'target'").select("node_id")


@query(
    f"""WITH RECURSIVE {FK_SQL}, {TESTS_SQL}, {DYN_SQL}, o AS (SELECT 'order:' || min(o_orderkey) AS node_id FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT node_id FROM o UNION SELECT 'nation:3' UNION SELECT src FROM fk JOIN c ON dst = node_id)
SELECT node_id AS target, CASE WHEN node_id IN (SELECT node_id FROM o) THEN '*' WHEN node_id NOT IN (SELECT node_id FROM c) THEN '~' ELSE ' ' END AS marker
FROM (SELECT node_id FROM u UNION SELECT node_id FROM c) WHERE node_id IN (SELECT node_id FROM t)"""
)
def impact_markers(spark, sf):
    first = read(spark, sf, "orders").where("o_orderstatus = 'F'").agg(F.min("o_orderkey").alias("k"))
    own = first.select(project(), F.lit("one").alias("change_set_id"), F.lit(0).alias("ord"), F.concat(F.lit("r/order/"), F.col("k").cast("string"), F.lit(".go")).alias("path"))
    more = spark.createDataFrame([("p", "one", 1, "r/nation/3.go")], own.schema)
    return report.markers(impact_rows(fk_graph(spark, sf), own.unionByName(more))[1]).select("target", "marker")


@query(
    f"""WITH RECURSIVE {FK_SQL}, {TESTS_SQL}, {DYN_SQL}, {KEYED_SQL},
a AS (SELECT change_set_id, node_id FROM c UNION SELECT 'region:' || r_regionkey, node_id FROM region, u),
n AS (SELECT change_set_id, count(*) AS selected FROM a WHERE node_id IN (SELECT node_id FROM t) GROUP BY change_set_id), s AS (SELECT count(*) AS total FROM t)
SELECT 'region:' || r_regionkey AS change_set_id, CAST(coalesce(selected, 0) AS BIGINT) AS selected, CAST(total AS BIGINT) AS total,
CASE WHEN total > 0 THEN CAST(round_even((total - coalesce(selected, 0)) / total * 100, 0) AS DOUBLE) ELSE 0.0 END AS skip_pct
FROM region CROSS JOIN s LEFT JOIN n ON n.change_set_id = 'region:' || r_regionkey"""
)
def impact_report(spark, sf):
    g = fk_graph(spark, sf)
    gates, rows = impact_rows(g, region_changes(spark, sf))
    n = rows.where("kind = 'target'").groupBy("project", "change_set_id").agg(F.count("*").alias("selected"))
    t = gates.join(n, ["project", "change_set_id"], "left").join(report.totals(g.nodes), "project").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return t.select("change_set_id", "selected", "total", report.skip_percent(F.col("selected"), F.col("total")).alias("skip_pct"))


# -- graph tables


@query(f"WITH {ADJ_SQL} SELECT dst, CAST(count(*) AS BIGINT) AS n_importers, string_agg(src, ',' ORDER BY src) AS importers FROM adj GROUP BY dst")
def importers_index(spark, sf):
    return graph.importers(adj_edges(spark, sf, 45)).select("dst", "n_importers", F.array_join("importers", ",").alias("importers"))


@query(f"WITH {ADJ_ALL_SQL} SELECT dst, CAST(count(*) AS BIGINT) AS n_importers, string_agg(src, ',' ORDER BY src) AS importers FROM adj GROUP BY dst")
def importers_index_all(spark, sf):
    """As ``importers_index``, over all of ADJ."""
    return graph.importers(adj_edges(spark, sf)).select("dst", "n_importers", F.array_join("importers", ",").alias("importers"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS node_id, bool_or(l_returnflag = 'R') AS has_tests, bool_or(l_quantity >= 50) AS has_dynamic FROM lineitem GROUP BY l_partkey")
def node_upsert(spark, sf):
    li = read(spark, sf, "lineitem").select(project(), F.col("l_partkey").cast("string").alias("node_id"), (F.col("l_returnflag") == "R").alias("has_tests"), (F.col("l_quantity") >= 50).alias("has_dynamic"))
    return graph.upsert_nodes(li).select("node_id", "has_tests", "has_dynamic")


def page_files(spark, sf) -> DataFrame:
    """Pages as files of nodes: the node is the page's id modulo 40 and its host, the file its url without scheme."""
    p = read(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"))
    host = F.regexp_extract("path", r"^([^/]*)", 1)
    return p.select(project(), F.concat(host, F.lit("#"), (F.col("page_id") % 40).cast("string")).alias("node_id"), "path", paths.parent(F.col("path")).alias("dir"))


PAGES_SQL = """
f AS (
  SELECT regexp_extract(path, '^([^/]*)', 1) || '#' || (page_id % 40) AS node_id, path, CASE WHEN NOT contains(path, '/') THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir
  FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
), o AS (SELECT dir, min(node_id) AS node_id FROM f GROUP BY dir HAVING count(DISTINCT node_id) = 1), e AS (SELECT path, min(node_id) AS node_id FROM f GROUP BY path)"""


@query(f"WITH {PAGES_SQL} SELECT dir, node_id FROM o")
def dir_unique_owner(spark, sf):
    return graph.dir_owners(page_files(spark, sf)).select("dir", "node_id")


@query(
    f"""WITH {PAGES_SQL}, c AS (SELECT DISTINCT path, dir FROM f UNION SELECT DISTINCT dir || '/gone.html', dir FROM f WHERE dir <> '.')
SELECT c.path, coalesce(e.node_id, o.node_id) AS node_id FROM c LEFT JOIN e ON e.path = c.path LEFT JOIN o ON o.dir = c.dir"""
)
def file_to_node(spark, sf):
    f = page_files(spark, sf)
    own = f.select("path").unionByName(f.where("dir <> '.'").select(F.concat("dir", F.lit("/gone.html")).alias("path"))).distinct()
    return classify.with_owner(own.select(project(), "path"), f).select("path", "node_id")


# -- classification; a day's events are a change set, users its paths


def event_changes(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    path = F.concat(F.lit("u/"), F.when(F.col("event_type") == "error", F.lit("go.mod")).when(F.col("event_type") == "view", F.concat(F.lit("note"), F.col("user_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".go"))))
    return e.select(project(), F.date_format("ts", "yyyy-MM-dd").alias("change_set_id"), F.col("event_id").cast("int").alias("ord"), path.alias("path"))


def event_classes(spark, sf) -> DataFrame:
    """Even users own two nodes' files, so no folder has one owner."""
    users = read(spark, sf, "events").select("user_id").distinct().where("user_id % 2 = 0")
    f = users.select(project(), key("user", "user_id").alias("node_id"), F.concat(F.lit("u/f"), F.col("user_id").cast("string"), F.lit(".go")).alias("path"), F.lit("u").alias("dir"))
    return classify.classify(event_changes(spark, sf), f, "go")


EVENTS_SQL = """
c AS (
  SELECT strftime(ts, '%Y-%m-%d') AS change_set_id, CASE event_type WHEN 'error' THEN 'u/go.mod' WHEN 'view' THEN 'u/note' || user_id || '.md' ELSE 'u/f' || user_id || '.go' END AS path,
    CAST(min(event_id) AS INTEGER) AS ord, any_value(user_id) AS user_id FROM events GROUP BY 1, 2
), k AS (
  SELECT *, CASE WHEN path = 'u/go.mod' THEN 'full' WHEN path LIKE '%.md' THEN 'ignored' WHEN user_id % 2 = 0 THEN 'node' ELSE 'unresolved' END AS cls FROM c
)"""


@query(f"WITH {EVENTS_SQL} SELECT change_set_id, ord, path, cls, CASE WHEN cls = 'node' THEN 'user:' || user_id END AS node_id FROM k")
def classify_changes(spark, sf):
    return event_classes(spark, sf).select("change_set_id", "ord", "path", "cls", "node_id")


@query(f"WITH {EVENTS_SQL} SELECT change_set_id, bool_or(cls IN ('full', 'unresolved')) AS full_run FROM k GROUP BY 1")
def full_run_gate(spark, sf):
    return classify.gate(event_classes(spark, sf)).select("change_set_id", "full_run")


@query(f"WITH {EVENTS_SQL} SELECT change_set_id, CAST(row_number() OVER (PARTITION BY change_set_id ORDER BY cls <> 'full', ord, path) - 1 AS INTEGER) AS place, path AS reason FROM k WHERE cls IN ('full', 'unresolved')")
def full_run_reasons(spark, sf):
    return classify.gate(event_classes(spark, sf)).select("change_set_id", F.posexplode("full_run_reasons").alias("place", "reason"))


@query(
    """WITH f AS (SELECT user_id, min(event_id) AS ord FROM events WHERE event_type = 'click' GROUP BY 1), s AS (SELECT user_id, min(event_id) AS ord FROM events WHERE event_type <> 'click' GROUP BY 1), m AS (SELECT max(event_id) + 1 AS m FROM events WHERE event_type = 'click')
SELECT CAST(user_id AS VARCHAR) AS path, CAST(min(ord) AS INTEGER) AS ord FROM (SELECT * FROM f UNION ALL SELECT user_id, ord + m FROM s, m) GROUP BY 1"""
)
def changed_distinct_ordered(spark, sf):
    e = read(spark, sf, "events")
    c = e.select(project(), F.lit("one").alias("change_set_id"), F.col("event_id").cast("int").alias("ord"), F.col("user_id").cast("string").alias("path"), "event_type")
    both = classify.concatenated(c.where("event_type = 'click'"), c.where("event_type <> 'click'"))
    return classify.ordered_changes(both).select("path", F.col("ord").cast("int").alias("ord"))


# -- paths and predicates


@query(
    """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN NOT contains(url, '/') THEN '.' WHEN regexp_replace(url, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(url, '/[^/]*$', '') END AS dir,
regexp_extract(url, '(\\.[^./]*)$', 1) AS ext FROM pages"""
)
def path_parts(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", paths.base(u).alias("base"), paths.parent(u).alias("dir"), paths.ext(u).alias("ext"))


@query(
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/part' || p_partkey || '.test.ts' WHEN 1 THEN 'a/__tests__/part' || p_partkey || '.ts' WHEN 2 THEN 'a/part' || p_partkey || '.tests.ts' ELSE 'a/test_part' || p_partkey || '.py' END AS path FROM part)
SELECT path, p_partkey % 4 IN (0, 1) AS jest, p_partkey % 4 = 3 AS pytest FROM f"""
)
def test_file_filter(spark, sf):
    k = F.col("p_partkey")
    n = k.cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("a/part"), n, F.lit(".test.ts"))).when(k % 4 == 1, F.concat(F.lit("a/__tests__/part"), n, F.lit(".ts"))).when(k % 4 == 2, F.concat(F.lit("a/part"), n, F.lit(".tests.ts"))).otherwise(F.concat(F.lit("a/test_part"), n, F.lit(".py")))
    f = read(spark, sf, "part").select(path.alias("path"))
    return f.select("path", rules.test_file("jest", F.col("path")).alias("jest"), rules.test_file("pytest", F.col("path")).alias("pytest"))


@query(
    f"""WITH {ADJ_SQL}, n AS (SELECT CAST(p_partkey AS VARCHAR) AS node_id FROM part WHERE p_size <= 25)
SELECT src, dst FROM adj WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)"""
)
def external_edge_filter(spark, sf):
    nodes = read(spark, sf, "part").where("p_size <= 25").select(project(), F.col("p_partkey").cast("string").alias("node_id"))
    return graph.clean_edges(adj_edges(spark, sf, 45), nodes).select("src", "dst")


@query(
    f"""WITH {ADJ_ALL_SQL}, n AS (SELECT CAST(p_partkey AS VARCHAR) AS node_id FROM part WHERE p_size <= 25)
SELECT src, dst FROM adj WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)"""
)
def external_edge_filter_all(spark, sf):
    """As ``external_edge_filter``, over all of ADJ."""
    nodes = read(spark, sf, "part").where("p_size <= 25").select(project(), F.col("p_partkey").cast("string").alias("node_id"))
    return graph.clean_edges(adj_edges(spark, sf), nodes).select("src", "dst")


@query(
    f"""WITH {PAGES_SQL}, w AS (SELECT DISTINCT dir, 'crate' || length(dir) AS owner FROM f WHERE dir <> '.' UNION SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1), 'host' FROM f WHERE contains(path, '/'))
SELECT p.path, arg_max(w.owner, (length(w.dir), w.owner)) AS owner FROM (SELECT DISTINCT path FROM f) p JOIN w ON p.path = w.dir OR starts_with(p.path, w.dir || '/') GROUP BY p.path"""
)
def longest_prefix_owner(spark, sf):
    f = page_files(spark, sf)
    crates = f.where("dir <> '.'").select("project", "dir", F.concat(F.lit("crate"), F.length("dir").cast("string")).alias("owner"))
    hosts = f.where("path LIKE '%/%'").select("project", F.regexp_extract("path", r"^([^/]*)", 1).alias("dir"), F.lit("host").alias("owner"))
    return graph.longest_prefix_owner(f.select("project", "path").distinct(), crates.unionByName(hosts).distinct()).select("path", "owner")


@query(
    f"""WITH {PAGES_SQL}, d AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1) || '/caller.ts' AS src, dir FROM f WHERE dir <> '.')
SELECT d.src, p.path AS dst FROM d JOIN (SELECT DISTINCT path FROM f) p ON starts_with(p.path, d.dir || '/') WHERE d.src <> p.path GROUP BY 1, 2"""
)
def glob_edges(spark, sf):
    f = page_files(spark, sf)
    dirs = f.where("dir <> '.'").select("project", F.concat(F.regexp_extract("path", r"^([^/]*)", 1), F.lit("/caller.ts")).alias("src"), "dir")
    return jest.glob_edges(dirs, f.select("project", "path").distinct()).select("src", "dst")


ALIASES = [("/p", 0, "^U", 0, "src/u/$1"), ("/p", 1, r"^NATION_(\d)(\d?)$", 0, "src/gone/$2"), ("/p", 1, r"^NATION_(\d)(\d?)$", 1, "src/$1"), ("/p", 2, "^(.*)$", 0, "<rootDir>/src/all/$1")]


@query(
    """SELECT n_name AS spec, CASE WHEN n_name[8:8] IN ('1', '7') THEN '/p/src/' || n_name[8:8] || '.ts' ELSE '/p/src/all/' || n_name || '.ts' END AS dst FROM nation"""
)
def alias_first_match(spark, sf):
    spec = read(spark, sf, "nation").select(F.lit("/p").alias("project"), F.concat(F.lit("/p/"), F.col("n_name")).alias("src"), F.col("n_name").alias("spec"))
    there = spec.select("project", F.concat(F.lit("/p/src/all/"), "spec", F.lit(".ts")).alias("path")).unionByName(spark.createDataFrame([("/p", "/p/src/1.ts"), ("/p", "/p/src/7.ts")], "project string, path string"))
    found = jest.resolved(spec, spark.createDataFrame(ALIASES, "project string, rule_ord int, pattern string, target_ord int, template string"), there)
    return found.select(F.regexp_replace("src", "^/p/", "").alias("spec"), "dst")


# -- inline sources

TREES = {
    "both": {"go.mod": "module m\n", "package.json": '{"jest": {}}'},
    "js": {"package.json": '{"devDependencies": {"jest": "1"}}', "conftest.py": ""},
    "jsless": {"package.json": '{"dependencies": {"left": "1"}}', "Cargo.toml": "[workspace]\n"},
    "py": {"pyproject.toml": "[tool.pytest.ini_options]\n"},
    "pyless": {"setup.cfg": "[metadata]\n"},
    "rust": {"Cargo.toml": "[package]\n", "setup.cfg": "[pytest]\n"},
}


def inline_files(spark: SparkSession, trees: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(f"/{p}", f"/{p}/{name}", bytearray(text.encode())) for p, fs in trees.items() for name, text in fs.items()]
    return tree.described(spark.createDataFrame(rows, "project string, path string, content binary"))


@query("SELECT * FROM (VALUES ('/both', 'go'), ('/js', 'jest'), ('/jsless', 'cargo'), ('/py', 'pytest'), ('/pyless', NULL), ('/rust', 'cargo')) t(project, analyzer)")
def detect_first_match(spark, sf):
    return detected(facts(inline_files(spark, TREES)))


JS = {
    "a literal": ("import('./a');", False, 0),
    "b require": ('const x = require("./b")', False, 0),
    "c variable": ("import(name)", True, 0),
    "d call": ("require(pick('x'))", True, 0),
    "e sum": ("import('./a' + x)", True, 0),
    "f plain template": ("import(`./a`)", False, 0),
    "g template": ("import(`./l/${x}.js`)", False, 1),
    "h template sum": ("import(`./l/${x}` + y)", True, 0),
    "i require variable": ("require(v)", True, 0),
    "j in string": ("const s = 'import(x)'", False, 0),
    "k in line comment": ("// import(x)\n", False, 0),
    "l in block comment": ("/* require(x) */", False, 0),
    "m nested": ("import(`./${a ? `x${'}'}` : \"`\"}/y`)", False, 1),
    "n method": ("loader.import(x)", True, 0),
    "o unterminated": ("import(", True, 0),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(o).lower()}, {n})" for k, (_, o, n) in JS.items()) + ") t(name, opaque, template_calls)")
def js_dynamic_scan(spark, sf):
    def run(batches):
        for b in batches:
            found = [jsscan.scan(bytes(s)) for s in b["source"]]
            yield b.assign(opaque=[f.opaque for f in found], template_calls=[len(f.calls) for f in found])[["name", "opaque", "template_calls"]]

    src = spark.createDataFrame([(k, bytearray(v[0].encode())) for k, v in JS.items()], "name string, source binary")
    return src.mapInPandas(run, "name string, opaque boolean, template_calls int")


PY = {
    "py": {
        "pyproject.toml": "",
        "src/pk/__init__.py": "",
        "src/pk/leaf.py": "import os\n",
        "src/pk/mid.py": "from . import leaf\nfrom .leaf import f\n",
        "src/pk/sub/__init__.py": "from .. import mid\n",
        "src/pk/sub/deep.py": "from ..mid import g\nimport importlib\nimportlib.import_module('pk.leaf')\n",
        "tests/test_mid.py": "def test():\n    import pk.mid\n    from pk.sub import deep\n",
        "tests/test_bad.py": "import pk.leaf\ndef (\n",
    }
}


@query(
    """SELECT '/py/' || src AS src, '/py/' || dst AS dst FROM (VALUES ('src/pk/mid.py', 'src/pk/__init__.py'), ('src/pk/mid.py', 'src/pk/leaf.py'), ('src/pk/sub/__init__.py', 'src/pk/__init__.py'),
('src/pk/sub/deep.py', 'src/pk/mid.py'), ('tests/test_mid.py', 'src/pk/mid.py'), ('tests/test_mid.py', 'src/pk/sub/__init__.py')) t(src, dst)"""
)
def py_import_edges(spark, sf):
    return pytest.build(inline_files(spark, PY)).edges.select("src", "dst")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Impact of one change set for each region over FK, as a report of targets with markers."""
    g = fk_graph(spark, sf)
    return report.report(compute(g, region_changes(spark, sf)), g.nodes)


__all__ = ["QUERIES", "SQL", "flagship", "pyimports"]
