"""A code graph projected from star-schema tables, so that every graph query can run on them.

Suppliers and parts become functions, customers methods, and the pairs that lineitem links imports and calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import CodeGraph, edge_kind

PARTIAL = "module resolved, symbol not found"


def _lay(k: str) -> str:
    return f"CASE ({k}) % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'service' ELSE 'db' END"


SUPPLIER_NAME = "concat(CASE s_suppkey % 4 WHEN 0 THEN 'legacy_' WHEN 1 THEN 'old_' WHEN 2 THEN 'new_' ELSE '' END, 'job_', s_suppkey div 4)"
SUPPLIER_FILE = f"concat({_lay('s_suppkey div 4')}, '/m', s_nationkey, '.py')"
CUSTOMER_FILE = f"concat({_lay('c_nationkey')}, '/m', c_nationkey, '.py')"


def _symbols(df: DataFrame, id_: str, kind: str, name: str, file: str, line: str, ord_: str, **more: str) -> DataFrame:
    values = {
        "id": id_, "kind": f"'{kind}'", "name": name, "qualified_name": f"concat({file}, '::', {name})", "visibility": "'Public'", "signature": "cast(null AS string)", "file": file,
        "line": f"cast({line} AS bigint)", "column": "cast(1 AS bigint)", "end_line": f"cast({line} + 3 AS bigint)", "end_column": "cast(1 AS bigint)", "resolution": "'Resolved'",
        "resolution_info": "cast(null AS string)", "scope_id": "cast(null AS string)", "annotations": "cast(array() AS array<string>)", "ord": f"cast({ord_} AS bigint)",
    } | more
    return df.selectExpr(*(f"{v} AS `{k}`" for k, v in values.items()))


def _refs(df: DataFrame, kind: str, file: str) -> DataFrame:
    e = df.select(
        F.concat(F.lit(kind[0] + ":"), "src", F.lit(">"), "dst").alias("id"), "src", "dst", F.lit(kind).alias("kind"), edge_kind(F.lit(kind)).alias("edge_kind"), F.expr(file).alias("file"),
        *(F.lit(v).cast("bigint").alias(n) for n, v in (("line", 5), ("column", 1), ("end_line", 5), ("end_column", 9))), F.lit("Resolved").alias("resolution"), F.lit(None).cast("string").alias("resolution_info"),
    )
    return e


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ck, sk, pk, ln, q, t, d) of each lineitem with its order's customer."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), F.col("l_discount").alias("d"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("ck"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("ck", "sk", "pk", "ln", "q", "t", "d")


def project(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph of one set of tables."""
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    supplier, customer = table("supplier"), table("customer")
    s = _symbols(supplier, "concat('S', s_suppkey)", "Function", SUPPLIER_NAME, SUPPLIER_FILE, "10 + s_suppkey", "s_suppkey", visibility="CASE WHEN s_acctbal < 0 THEN 'Private' ELSE 'Public' END")
    p = _symbols(
        table("part"), "concat('P', p_partkey)", "Function", "concat('part_', p_partkey div 3, '_v', p_partkey % 3 + 1)", f"concat({_lay('p_partkey div 3')}, '/p', p_partkey % 50, '.py')", "10 + p_partkey",
        "1000000000 + p_partkey", visibility="CASE WHEN p_size < 10 THEN 'Private' ELSE 'Public' END",
    )
    c = _symbols(
        customer, "concat('C', c_custkey)", "Method", "concat('handle_', c_custkey % 100)", CUSTOMER_FILE, "10 + c_custkey", "2000000000 + c_custkey",
        visibility="CASE WHEN c_acctbal < 0 THEN 'Private' ELSE 'Public' END", annotations="CASE WHEN c_custkey % 50 = 0 THEN array('entry_point') ELSE cast(array() AS array<string>) END",
        signature="CASE WHEN c_custkey % 100 < 50 THEN '(self, x)' WHEN (c_custkey div 100) % 2 = 0 THEN '(self, f(a, b), c=[1, 2])' ELSE '(self)' END",
    )
    li = lines(spark, sf_dir)
    pairs = li.filter("q >= 46").select("ck", "sk").distinct().join(supplier, F.col("sk") == F.col("s_suppkey")).join(customer, F.col("ck") == F.col("c_custkey"))
    i = _symbols(
        pairs, "concat('I', ck, '_', sk)", "Module", SUPPLIER_NAME, CUSTOMER_FILE, "1 + sk % 7", "3000000000 + ck * 100000 + sk", annotations=f"array('import', concat('from:', {SUPPLIER_NAME}))",
        resolution="CASE WHEN sk % 5 = 0 THEN 'Partial' ELSE 'Resolved' END", resolution_info=f"CASE WHEN sk % 5 = 0 THEN '{PARTIAL}' END",
    )
    j = _symbols(
        supplier.filter("s_suppkey % 2 = 0"), "concat('J', s_suppkey)", "Module", SUPPLIER_NAME, f"concat({_lay('s_suppkey div 4')}, '/__init__.py')", "1", "4000000000 + s_suppkey", annotations="array('import')"
    )
    pair = lambda cond, a, b: li.filter(cond).selectExpr(f"{a} AS src", f"{b} AS dst").distinct()
    c_, s_, p_, i_ = "concat('C', ck)", "concat('S', sk)", "concat('P', pk)", "concat('I', ck, '_', sk)"
    calls = [
        pair("q >= 49 AND ln = 1", c_, s_), pair("q >= 49 AND t >= 0.06", s_, p_), pair("q >= 50 AND t >= 0.08 AND d <= 0.02", p_, s_), pair("q >= 50 AND d >= 0.07", s_, c_),
        pair("q >= 46 AND ln <= 2", c_, i_),
    ]
    refs = _refs(pair("q >= 46", i_, s_), "Import", "'-'")
    for e in calls:
        refs = refs.unionByName(_refs(e, "Call", "'-'"))
    symbols = s
    for more in (p, c, i, j):
        symbols = symbols.unionByName(more)
    g = CodeGraph.of(symbols, refs)
    return g


def conversation_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Each turn of a conversation calls the next one, and the first is an entry point; all paths of this graph end."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("cv"), F.col("turn").cast("long").alias("tn"), "role").distinct()
    by = Window.partitionBy("cv").orderBy("tn", "role")
    turns = turns.withColumns({"k": F.row_number().over(by), "more": F.lead("tn").over(by).isNotNull()})
    s = _symbols(
        turns, "concat('T', cv, '_', k)", "Function", "concat(coalesce(role, ''), '_', tn)", "concat('talk/c', cv, '.py')", "10 + k", "k",
        annotations="CASE WHEN k = 1 THEN array('entry_point') ELSE cast(array() AS array<string>) END",
    )
    e = turns.filter("more").selectExpr("concat('T', cv, '_', k) AS src", "concat('T', cv, '_', k + 1) AS dst")
    return CodeGraph.of(s, _refs(e, "Call", "'-'"))


def _duck_lay(k: str) -> str:
    return f"CASE ({k}) % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'service' ELSE 'db' END"


_SN = "(CASE s_suppkey % 4 WHEN 0 THEN 'legacy_' WHEN 1 THEN 'old_' WHEN 2 THEN 'new_' ELSE '' END || 'job_' || (s_suppkey // 4))"
_SF = f"({_duck_lay('s_suppkey // 4')} || '/m' || s_nationkey || '.py')"
_CF = f"({_duck_lay('c_nationkey')} || '/m' || c_nationkey || '.py')"
#: The same projection for DuckDB: CTEs li, sym and edge (src, dst, kind, edge_kind).
DUCK = f"""
li AS (SELECT o_custkey AS ck, l_suppkey AS sk, l_partkey AS pk, l_linenumber AS ln, l_quantity AS q, l_tax AS t, l_discount AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
imp AS (SELECT DISTINCT ck, sk FROM li WHERE q >= 46),
sym AS (
  SELECT 'S' || s_suppkey AS id, 'Function' AS kind, {_SN} AS name, {_SF} AS file, (10 + s_suppkey)::BIGINT AS line, CASE WHEN s_acctbal < 0 THEN 'Private' ELSE 'Public' END AS visibility,
    false AS is_import, false AS entry, 'Resolved' AS resolution, s_suppkey::BIGINT AS ord, NULL AS signature FROM supplier
  UNION ALL SELECT 'P' || p_partkey, 'Function', 'part_' || (p_partkey // 3) || '_v' || (p_partkey % 3 + 1), {_duck_lay('p_partkey // 3')} || '/p' || (p_partkey % 50) || '.py', 10 + p_partkey,
    CASE WHEN p_size < 10 THEN 'Private' ELSE 'Public' END, false, false, 'Resolved', 1000000000 + p_partkey, NULL FROM part
  UNION ALL SELECT 'C' || c_custkey, 'Method', 'handle_' || (c_custkey % 100), {_CF}, 10 + c_custkey, CASE WHEN c_acctbal < 0 THEN 'Private' ELSE 'Public' END, false, c_custkey % 50 = 0, 'Resolved',
    2000000000 + c_custkey, CASE WHEN c_custkey % 100 < 50 THEN 'two' WHEN (c_custkey // 100) % 2 = 0 THEN 'three' ELSE 'one' END FROM customer
  UNION ALL SELECT 'I' || ck || '_' || sk, 'Module', {_SN}, {_CF}, 1 + sk % 7, 'Public', true, false, CASE WHEN sk % 5 = 0 THEN 'Partial' ELSE 'Resolved' END, 3000000000 + ck * 100000 + sk, NULL
    FROM imp JOIN supplier ON sk = s_suppkey JOIN customer ON ck = c_custkey
  UNION ALL SELECT 'J' || s_suppkey, 'Module', {_SN}, {_duck_lay('s_suppkey // 4')} || '/__init__.py', 1, 'Public', true, false, 'Resolved', 4000000000 + s_suppkey, NULL FROM supplier WHERE s_suppkey % 2 = 0
),
edge AS (
  SELECT 'I' || ck || '_' || sk AS src, 'S' || sk AS dst, 'Import' AS kind, 'References' AS edge_kind FROM imp
  UNION ALL SELECT DISTINCT 'C' || ck, 'S' || sk, 'Call', 'Calls' FROM li WHERE q >= 49 AND ln = 1
  UNION ALL SELECT DISTINCT 'S' || sk, 'P' || pk, 'Call', 'Calls' FROM li WHERE q >= 49 AND t >= 0.06
  UNION ALL SELECT DISTINCT 'P' || pk, 'S' || sk, 'Call', 'Calls' FROM li WHERE q >= 50 AND t >= 0.08 AND d <= 0.02
  UNION ALL SELECT DISTINCT 'S' || sk, 'C' || ck, 'Call', 'Calls' FROM li WHERE q >= 50 AND d >= 0.07
  UNION ALL SELECT DISTINCT 'C' || ck, 'I' || ck || '_' || sk, 'Call', 'Calls' FROM li WHERE q >= 46 AND ln <= 2
),
ex AS (SELECT *, file || '::' || name AS qualified_name, file || ':' || line AS loc, (entry OR is_import) AS excluded, regexp_replace(file, '/[^/]*$', '') AS dir,
  CASE split_part(file, '/', 1) WHEN 'api' THEN 'API' WHEN 'service' THEN 'Service' ELSE 'Data' END AS layer FROM sym)
"""

