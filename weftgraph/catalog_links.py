"""Registered queries of parsing, interval joins and linking, with their DuckDB text.

The tables hold no source code, so text, scopes and references are made from them: a customer is a file, orders are scopes and
imports in it, lineitems are symbols and uses; suppliers of a nation are the functions of a source file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import ORACLE_SQL, QUERIES
from weftgraph.operators import detectors, intervals, link
from weftgraph.operators.graph import CodeGraph
from weftgraph.sources.projection import SUPPLIER_FILE, SUPPLIER_NAME, _refs, _symbols, conversation_graph, lines
from weftgraph.sources.rows import ROWS


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = "cast(datediff(cast(o_orderdate AS date), date'1992-01-01') AS bigint)"
    return o.selectExpr(
        "concat('O', o_orderkey) AS id", "CASE WHEN o_orderkey % 7 = 0 THEN 'File' WHEN o_orderkey % 2 = 0 THEN 'Function' ELSE 'Method' END AS kind", "concat('c', o_custkey) AS file", "concat('n', o_orderkey % 3) AS name",
        f"{day} AS line", "cast(1 AS bigint) AS column", f"{day} + o_orderkey % 400 AS end_line", "cast(9 AS bigint) AS end_column", "o_orderkey AS ord",
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    day = "cast(datediff(cast(l_shipdate AS date), date'1992-01-01') AS bigint)"
    return li.selectExpr(
        f"concat_ws('_', concat('L', l_orderkey), l_linenumber, l_partkey, l_suppkey, {day}, cast(l_quantity AS bigint)) AS id", "concat('c', o_custkey) AS file", "concat('n', l_partkey % 4) AS name", f"{day} AS line", "cast(2 AS bigint) AS column",
        f"{day} + l_partkey % 30 AS end_line", "cast(5 AS bigint) AS end_column",
    )


_O = """o AS (SELECT 'O' || o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'File' WHEN o_orderkey % 2 = 0 THEN 'Function' ELSE 'Method' END AS kind, 'c' || o_custkey AS file, 'n' || (o_orderkey % 3) AS name,
  datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS line, datediff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 400 AS end_line, o_orderkey AS ord FROM orders)"""
_L = """i AS (SELECT concat_ws('_', 'L' || l_orderkey, l_linenumber, l_partkey, l_suppkey, datediff('day', DATE '1992-01-01', l_shipdate::DATE), l_quantity::BIGINT) AS id, 'c' || o_custkey AS file, 'n' || (l_partkey % 4) AS name, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS line,
  datediff('day', DATE '1992-01-01', l_shipdate::DATE) + l_partkey % 30 AS end_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("scope_parents", f"""WITH {_O}, met AS (SELECT a.id, b.id AS parent, row_number() OVER (PARTITION BY a.id ORDER BY b.line DESC, b.end_line, b.ord) AS k FROM o a JOIN o b ON a.file = b.file
  AND b.line <= a.line AND a.end_line <= b.end_line AND NOT (a.line = b.line AND a.end_line = b.end_line) AND b.ord < a.ord)
SELECT o.id, parent AS parent_id FROM o LEFT JOIN met ON met.id = o.id AND k = 1""")
def _(spark, sf_dir):
    return intervals.scope_parents(_orders(spark, sf_dir))


@query("scope_interval", f"""WITH {_O}, {_L}, met AS (SELECT i.id, o.id AS s, row_number() OVER (PARTITION BY i.id ORDER BY o.line DESC, o.end_line, o.ord DESC) AS k FROM i JOIN o ON i.file = o.file AND o.line <= i.line AND i.end_line <= o.end_line),
first AS (SELECT file, arg_min(id, ord) AS s FROM o GROUP BY file)
SELECT i.id, coalesce(met.s, first.s) AS scope_id FROM i LEFT JOIN met ON met.id = i.id AND k = 1 LEFT JOIN first ON first.file = i.file""")
def _(spark, sf_dir):
    return intervals.symbol_scopes(_items(spark, sf_dir), _orders(spark, sf_dir))


@query("enclosing_callable", f"""WITH {_O}, {_L}, met AS (SELECT i.id, o.id AS s, row_number() OVER (PARTITION BY i.id ORDER BY o.line DESC, o.end_line, o.ord DESC) AS k FROM i JOIN o ON i.file = o.file AND o.line <= i.line AND i.end_line <= o.end_line
  AND o.kind <> 'File') SELECT i.id, s AS caller FROM i LEFT JOIN met ON met.id = i.id AND k = 1""")
def _(spark, sf_dir):
    return intervals.enclosing_callables(_items(spark, sf_dir), _orders(spark, sf_dir))


@query("asof_import", f"""WITH {_O}, {_L}, met AS (SELECT i.id, o.id AS s, row_number() OVER (PARTITION BY i.id ORDER BY o.line <= i.line DESC, CASE WHEN o.line <= i.line THEN o.line END DESC NULLS LAST, o.ord) AS k
  FROM i JOIN o ON i.file = o.file AND i.name = o.name) SELECT i.id, s AS import_id FROM i LEFT JOIN met ON met.id = i.id AND k = 1""")
def _(spark, sf_dir):
    return intervals.nearest_imports(_items(spark, sf_dir), _orders(spark, sf_dir)).select("id", "import_id")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROWS of a file for each nation, with functions and methods (suppliers) of few names, and a call for each of its lineitems."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k", "s_nationkey AS n")
    symbols = s.selectExpr(
        "'symbol' AS row_kind", "concat('S', k) AS id", "CASE k % 5 WHEN 0 THEN 'Variable' WHEN 1 THEN 'Function' ELSE 'Method' END AS kind", "concat('n', k % 7) AS name", "concat('f', n) AS file", "cast(1 AS bigint) AS line",
        "concat('k', k % 3) AS scope_id", "array() AS annotations", "k AS ord", "concat('f', n, '::n', k % 7) AS qualified_name",
    )
    li = lines(spark, sf_dir).select("sk", "pk", "ln").distinct().join(s, F.col("sk") == F.col("k"))
    refs = li.selectExpr(
        "'ref' AS row_kind", "concat('R', sk, '_', pk, '_', ln) AS id", "'Call' AS kind", "concat('f', n) AS file", "concat('S', sk) AS src", "'call' AS tag",
        "concat(CASE ln % 3 WHEN 0 THEN 'self.' WHEN 1 THEN '' ELSE 'other.' END, 'n', pk % 9) AS arg", "concat('k', sk % 3) AS class_scope", "cast(2 AS bigint) AS line",
    )
    empty = spark.createDataFrame([], ROWS)
    return empty.unionByName(symbols, allowMissingColumns=True).unionByName(refs, allowMissingColumns=True)


@query("callee_resolution", """WITH s AS (SELECT 'S' || s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'Variable' WHEN 1 THEN 'Function' ELSE 'Method' END AS kind, 'n' || (s_suppkey % 7) AS name, s_nationkey AS f, s_suppkey % 3 AS sc, s_suppkey AS ord FROM supplier),
r AS (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk, l_linenumber AS ln FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT 'R' || sk || '_' || pk || '_' || ln AS ref, s.id AS src, s.f, s.sc, ln % 3 AS how, 'n' || (pk % 9) AS wanted FROM r JOIN s ON s.ord = sk),
met AS (SELECT ref, c.src, s.id AS dst, row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN how = 1 THEN (s.kind IN ('Function', 'Method'))::INT ELSE 0 END DESC, s.ord) AS k FROM c JOIN s ON s.f = c.f AND s.name = wanted
  AND (how = 1 OR how = 0 AND s.kind = 'Method' AND s.sc = c.sc))
SELECT ref AS id, src, dst FROM met WHERE k = 1""")
def _(spark, sf_dir):
    return link.resolve_in_files(_parsed(spark, sf_dir)).refs.filter("kind = 'Call'").select("id", "src", "dst")


@query("transitive_calls", """WITH li AS (SELECT DISTINCT o_custkey AS ck, l_suppkey AS sk, l_linenumber AS ln, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
imp AS (SELECT DISTINCT ck, sk FROM li WHERE q >= 46), via AS (SELECT DISTINCT ck, sk FROM li WHERE q >= 46 AND ln <= 2), direct AS (SELECT DISTINCT ck, sk FROM li WHERE q >= 49 AND ln = 1)
SELECT 'C' || ck AS src, 'I' || ck || '_' || sk AS dst, 'Call' AS kind FROM via UNION ALL SELECT 'C' || ck, 'S' || sk, 'Call' FROM direct UNION ALL SELECT 'I' || ck || '_' || sk, 'S' || sk, 'Import' FROM imp
UNION ALL SELECT 'C' || ck, 'S' || sk, 'Call' FROM (SELECT * FROM via EXCEPT SELECT * FROM direct)""")
def _(spark, sf_dir):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    supplier, customer = table("supplier"), table("customer")
    s = _symbols(supplier, "concat('S', s_suppkey)", "Function", SUPPLIER_NAME, SUPPLIER_FILE, "10", "s_suppkey")
    c = _symbols(customer, "concat('C', c_custkey)", "Function", "concat('handle_', c_custkey)", "concat('main/c', c_custkey, '.py')", "10", "c_custkey")
    li = lines(spark, sf_dir).join(supplier, F.col("sk") == F.col("s_suppkey")).join(customer.select("c_custkey"), F.col("ck") == F.col("c_custkey"))
    module = f"replace(replace({SUPPLIER_FILE}, '.py', ''), '/', '.')"
    i = _symbols(
        li.filter("q >= 46").dropDuplicates(["ck", "sk"]), "concat('I', ck, '_', sk)", "Module", SUPPLIER_NAME, "concat('main/c', ck, '.py')", "1", "sk", annotations=f"array('import', concat('from:', {module}))", resolution="'Partial'"
    )
    pair = lambda cond, a, b: li.filter(cond).selectExpr(f"{a} AS src", f"{b} AS dst").distinct()
    calls = _refs(pair("q >= 46 AND ln <= 2", "concat('C', ck)", "concat('I', ck, '_', sk)"), "Call", "'-'").unionByName(_refs(pair("q >= 49 AND ln = 1", "concat('C', ck)", "concat('S', sk)"), "Call", "'-'"))
    modules = supplier.selectExpr(f"{module} AS key", f"{SUPPLIER_FILE} AS path").distinct()
    g = link.resolve_across_files(CodeGraph.of(s.unionByName(c).unionByName(i), calls), modules)
    return g.edges().select("src", "dst", "kind")


#: How a function of each language is written: three lines each.
_TEXTS = {
    "python": ("py", "concat('def ', if(hidden, '_', ''), name, '(a, b):\\n    ', callee, '(a)\\n\\n')"),
    "javascript": ("js", "concat(if(hidden, '', 'export '), 'function ', name, '(a, b) {\\n  ', callee, '(a);\\n}\\n')"),
    "rust": ("rs", "concat(if(hidden, '', 'pub '), 'fn ', name, '(a: u8, b: u8) {\\n    ', callee, '(a);\\n}\\n')"),
}


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schemas.FILES of a source file for each nation and language: a function for each supplier, which calls the next one."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k", "s_nationkey AS n", "s_acctbal < 0 AS hidden", "concat('job_', s_suppkey) AS own")
    s = s.withColumn("later", F.expr("lead(struct(hidden, own)) OVER (PARTITION BY n ORDER BY k)"))
    out = None
    for language, (ext, text) in _TEXTS.items():
        called = "coalesce(if(later.hidden, concat('_', later.own), later.own), 'print')" if language == "python" else "coalesce(later.own, 'print')"
        each = s.withColumn("name", F.col("own")).withColumn("callee", F.expr(called)).withColumn("text", F.expr(text))
        files = each.groupBy("n").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, text))), x -> x.text), '')").alias("content"))
        files = files.selectExpr(f"concat('src/m', n, '.{ext}') AS path", f"concat('src/m', n, '.{ext}') AS rel_path", f"'{ext}' AS ext", f"'{language}' AS language", "content", "cast(octet_length(content) AS bigint) AS n_bytes")
        out = files if out is None else out.unionByName(files)
    return out


_W = """w AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal < 0 AS hidden, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS next,
  lead(s_acctbal < 0) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS next_hidden FROM supplier),
lang AS (SELECT unnest(['py', 'js', 'rs']) AS ext)"""


@query("parse_symbols", f"""WITH {_W} SELECT 'src/m' || n || '.' || ext AS file, 'Function' AS kind, CASE WHEN hidden AND ext = 'py' THEN '_' ELSE '' END || 'job_' || k AS name, CASE WHEN hidden THEN 'Private' ELSE 'Public' END AS visibility,
  (3 * rn - 2)::BIGINT AS line, CASE ext WHEN 'rs' THEN '(a: u8, b: u8) -> ()' ELSE '(a, b)' END AS signature FROM w, lang""".replace(" -> ()", ""))
def _(spark, sf_dir):
    rows = link.parse_files(_written(spark, sf_dir)).filter("row_kind = 'symbol'")
    return rows.select("file", "kind", "name", "visibility", "line", "signature")


@query("parse_calls", f"""WITH {_W}, q AS (SELECT n, ext, k, next, CASE WHEN hidden AND ext = 'py' THEN '_' ELSE '' END || 'job_' || k AS own, CASE WHEN next_hidden AND ext = 'py' THEN '_' ELSE '' END || 'job_' || next AS other FROM w, lang)
SELECT 'src/m' || n || '.' || ext || '::' || own AS src, 'src/m' || n || '.' || ext || '::' || other AS dst FROM q WHERE next IS NOT NULL""")
def _(spark, sf_dir):
    g = link.analyze_files(_written(spark, sf_dir))
    names = g.symbols.select(F.col("id").alias("_i"), F.col("qualified_name").alias("q"))
    e = g.callees().join(names, F.col("src") == F.col("_i")).select(F.col("q").alias("src"), F.col("dst").alias("_d")).join(names, F.col("_d") == F.col("_i"))
    return e.select("src", F.col("q").alias("dst"))


@query("module_keys", """WITH m AS (SELECT DISTINCT s_nationkey AS n FROM supplier) SELECT 'm' || n AS key, 'src/m' || n || CASE WHEN true THEN '.js' END AS path FROM m
UNION ALL SELECT 'crate::m' || n, 'src/m' || n || '.rs' FROM m""")
def _(spark, sf_dir):
    return link.module_map(_written(spark, sf_dir).select("rel_path", "language"))


@query("isolated_clusters", """WITH t AS (SELECT DISTINCT conv_id AS cv, turn AS tn, role FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY tn, role) AS k, count(*) OVER (PARTITION BY cv) AS n FROM t)
SELECT 'isolated_cluster' AS pattern, 'warning' AS severity, 'high' AS confidence, string_agg(coalesce(role, '') || '_' || tn, ', ' ORDER BY k) AS entity, 'talk/c' || cv || '.py:11' AS loc,
  n || ' symbols with ' || (n - 1) || ' references among themselves have no caller outside' AS message FROM k WHERE n > 1 GROUP BY cv, n""")
def _(spark, sf_dir):
    g = conversation_graph(spark, sf_dir)
    quiet = CodeGraph.of(g.symbols.withColumn("annotations", F.array().cast("array<string>")), g.refs)
    return detectors.isolated_cluster(quiet).select("pattern", "severity", "confidence", "entity", "loc", "message")
