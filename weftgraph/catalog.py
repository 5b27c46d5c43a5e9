"""All registered queries over the driver's tables, with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import detectors as d
from weftgraph.operators.graph import CodeGraph
from weftgraph.runtime import Scratch
from weftgraph.sources.projection import DUCK, conversation_graph, project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = DUCK, recursive: bool = False, source: Callable[[SparkSession, str], CodeGraph] = project):
    """Register a query of the projected graph (or another source's) and its DuckDB text after the projection's CTEs."""

    def add(fn: Callable[[CodeGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}{sql.strip() if sql.strip().startswith(',') else chr(10) + sql.strip()}"
        return fn

    return add


def _finding(df: DataFrame) -> DataFrame:
    return df.select("pattern", "severity", "confidence", "entity", "loc")


@query("symbols_scan", "SELECT id, kind, name, qualified_name, visibility, file, line, ord FROM ex")
def _(g):
    return g.symbols.select("id", "kind", "name", "qualified_name", "visibility", "file", "line", "ord")


@query("references_scan", "SELECT src, dst, kind, edge_kind FROM edge")
def _(g):
    return g.edges().select("src", "dst", "kind", "edge_kind")


@query("graph_counts", "SELECT (SELECT count(*) FROM sym) AS symbols, 0::BIGINT AS scopes, (SELECT count(*) FROM edge) AS \"references\"")
def _(g):
    return g.counts().withColumnRenamed("refs", "references")


@query("callees", "SELECT src, dst FROM edge WHERE edge_kind = 'Calls'")
def _(g):
    return g.callees()


@query("callers", "SELECT dst, src FROM edge WHERE edge_kind = 'Calls'")
def _(g):
    return g.callers()


@query("importers", "SELECT dst, src FROM edge WHERE edge_kind = 'References'")
def _(g):
    return g.importers()


@query("in_degree", "SELECT id, count(dst) AS in_degree FROM sym LEFT JOIN edge ON dst = id GROUP BY id")
def _(g):
    return g.in_degree()


@query("remove_private", "SELECT (SELECT count(*) FROM sym WHERE visibility <> 'Private') AS symbols, (SELECT count(*) FROM edge) AS refs, (SELECT count(*) FROM edge WHERE src NOT IN (SELECT id FROM sym WHERE visibility = 'Private') AND dst NOT IN (SELECT id FROM sym WHERE visibility = 'Private')) AS edges")
def _(g):
    h = g.remove_symbols(g.symbols.filter("visibility = 'Private'").select("id"))
    n = lambda f, name: f.agg(F.count("*").alias(name))
    return n(h.symbols, "symbols").crossJoin(n(h.refs, "refs")).crossJoin(n(h.edges(), "edges"))  # single rows


UNUSED = "NOT excluded AND NOT EXISTS (SELECT 1 FROM edge WHERE dst = id)"


@query("dead_end", f"SELECT 'data_dead_end' AS pattern, 'warning' AS severity, CASE visibility WHEN 'Private' THEN 'high' ELSE 'low' END AS confidence, qualified_name AS entity, loc FROM ex WHERE kind = 'Function' AND {UNUSED}")
def _(g):
    return _finding(d.dead_end(g))


@query("orphaned", f"SELECT 'orphaned_impl' AS pattern, 'warning' AS severity, CASE visibility WHEN 'Private' THEN 'high' ELSE 'moderate' END AS confidence, qualified_name AS entity, loc FROM ex WHERE kind = 'Method' AND {UNUSED}")
def _(g):
    return _finding(d.orphaned_impl(g))


@query("phantom", "SELECT 'phantom_dependency' AS pattern, 'info' AS severity, 'high' AS confidence, name AS entity, loc FROM ex WHERE is_import AND NOT EXISTS (SELECT 1 FROM edge JOIN sym s ON s.id = src WHERE dst = ex.id AND s.file = ex.file AND src <> dst)")
def _(g):
    return _finding(d.phantom_dependency(g))


@query(
    "missing_reexport",
    """SELECT 'missing_reexport' AS pattern, 'info' AS severity, 'moderate' AS confidence, qualified_name AS entity, loc FROM (
  SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY ord) AS k FROM ex WHERE kind = 'Function' AND visibility = 'Public' AND NOT EXISTS (SELECT 1 FROM sym i WHERE i.is_import AND i.file = ex.file AND i.name = ex.name)
) e WHERE k = 1 AND EXISTS (SELECT 1 FROM sym i WHERE i.file = e.dir || '/__init__.py') AND NOT EXISTS (SELECT 1 FROM sym i WHERE i.is_import AND i.file = e.dir || '/__init__.py' AND i.name = e.name)""",
)
def _(g):
    return _finding(d.missing_reexport(g))


@query(
    "layer_violation",
    "SELECT 'layer_violation' AS pattern, 'warning' AS severity, 'moderate' AS confidence, a.qualified_name AS entity, a.loc FROM (SELECT DISTINCT src, dst FROM edge) JOIN ex a ON a.id = src JOIN ex b ON b.id = dst WHERE a.layer = 'API' AND b.layer = 'Data' AND NOT a.excluded",
)
def _(g):
    return _finding(d.layer_violation(g))


@query("stale_reference", "SELECT 'stale_reference' AS pattern, 'warning' AS severity, 'high' AS confidence, name AS entity, loc FROM ex WHERE is_import AND resolution = 'Partial'")
def _(g):
    return _finding(d.stale_reference(g))


@query("arity_mismatch", "SELECT name, count(DISTINCT signature) AS arities, count(*) AS members FROM sym WHERE signature IS NOT NULL GROUP BY name HAVING count(DISTINCT signature) > 1")
def _(g):
    a = d.arity_groups(g)
    return a.select("name", F.col("n").alias("arities"), F.size("members").cast("long").alias("members"))


PROD = """, calls AS (SELECT DISTINCT src, dst FROM edge WHERE edge_kind = 'Calls'), n AS (SELECT dst, count(DISTINCT src) AS n FROM calls GROUP BY dst)"""


@query(
    "naming_pairs",
    PROD
    + """, marked AS (
  SELECT *, regexp_replace(name, '^(legacy|old)_', '') AS base, CASE WHEN name LIKE 'legacy%' THEN 'high' ELSE 'moderate' END AS conf FROM ex WHERE kind IN ('Function', 'Method') AND regexp_matches(name, '^(legacy|old)_.')
), fresh AS (
  SELECT id, dir, name, regexp_replace(name, '^new_', '') AS base FROM ex WHERE kind IN ('Function', 'Method') AND name LIKE 'new\\__%' ESCAPE '\\'
  UNION ALL SELECT id, dir, name, name FROM ex WHERE kind IN ('Function', 'Method')
)
SELECT o.name || ', ' || f.name AS entity, o.conf AS confidence, o.loc, a.n AS old_callers, b.n AS new_callers FROM marked o JOIN fresh f ON f.base = o.base AND f.dir = o.dir AND f.id <> o.id
JOIN n a ON a.dst = o.id JOIN n b ON b.dst = f.id WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE (c.src = o.id AND c.dst = f.id) OR (c.src = f.id AND c.dst = o.id))""",
)
def _(g):
    p = d.naming_pairs(g)
    return p.select(F.concat_ws(", ", "old_name", "new_name").alias("entity"), F.col("conf").alias("confidence"), F.concat_ws(":", "old_rel", "old_line").alias("loc"), "old_callers", "new_callers")


@query(
    "version_pairs",
    PROD
    + """, v AS (SELECT *, regexp_extract(name, '^(.+)_v([0-9]+)$', 1) AS base, regexp_extract(name, '_v([0-9]+)$', 1)::BIGINT AS ver FROM ex WHERE kind IN ('Function', 'Method') AND regexp_matches(name, '^.+_v[0-9]+$')),
sizes AS (SELECT base, count(*) AS size FROM v GROUP BY base),
chain AS (SELECT v.base FROM calls JOIN v ON v.id = calls.dst JOIN sizes ON sizes.base = v.base GROUP BY v.base, calls.src, size HAVING size >= 3 AND count(DISTINCT v.id) = size)
SELECT o.name || ', ' || f.name AS entity, o.loc, a.n AS old_callers, b.n AS new_callers FROM v o JOIN v f ON f.base = o.base AND f.dir = o.dir AND (f.ver > o.ver OR (f.ver = o.ver AND f.ord > o.ord))
JOIN n a ON a.dst = o.id JOIN n b ON b.dst = f.id WHERE o.base NOT IN (SELECT base FROM chain)""",
)
def _(g):
    return d.version_pairs(g).select(F.concat_ws(", ", "old_name", "new_name").alias("entity"), F.concat_ws(":", "old_rel", "old_line").alias("loc"), "old_callers", "new_callers")


@query(
    "import_coexistence",
    """SELECT o.file, o.name AS old_name, f.name AS new_name, count(*) AS pairs FROM ex o JOIN ex f ON f.file = o.file AND f.is_import AND o.is_import AND f.name = regexp_replace(o.name, '^(legacy|old)_', '')
WHERE regexp_matches(o.name, '^(legacy|old)_') AND o.id LIKE 'I%' AND f.id LIKE 'I%' GROUP BY ALL""",
)
def _(g):
    c = d.import_coexistence(g)
    return c.groupBy("file", "old_name", "new_name").agg(F.count("*").alias("pairs"))


@query(
    "partial_wiring",
    """, by_file AS (SELECT DISTINCT e.dst, s.file, e.edge_kind FROM edge e JOIN sym s ON s.id = e.src JOIN ex t ON t.id = e.dst WHERE (e.edge_kind = 'Calls' OR e.kind = 'Import') AND s.file <> t.file
  AND t.kind IN ('Function', 'Method') AND t.visibility = 'Public' AND NOT t.excluded),
w AS (SELECT dst, count(DISTINCT file) FILTER (edge_kind = 'Calls') AS c, count(DISTINCT file) AS n FROM by_file GROUP BY dst)
SELECT 'partial_wiring' AS pattern, 'warning' AS severity, CASE WHEN c / n < 0.5 THEN 'high' ELSE 'moderate' END AS confidence, name AS entity, loc FROM w JOIN ex ON ex.id = w.dst WHERE n >= 3 AND c >= 1 AND n > c AND c / n < 0.8""",
)
def _(g):
    return _finding(d.partial_wiring(g))


REACH = """, pair AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM edge JOIN sym a ON a.id = edge.src JOIN sym b ON b.id = edge.dst WHERE a.file <> b.file),
reach AS (SELECT src, dst FROM pair UNION SELECT r.src, p.dst FROM reach r JOIN pair p ON p.src = r.dst)"""


@query("cycle_membership", REACH + " SELECT DISTINCT src AS file FROM reach WHERE src = dst", recursive=True)
def _(g):
    from weftgraph.operators.components import strong_components

    return strong_components(d.file_edges(g)).select(F.col("node").alias("file"))


@query("file_components", REACH.replace("edge JOIN", "edge JOIN") + """, both_ways AS (SELECT src, dst FROM reach UNION SELECT dst, src FROM reach), r2 AS (SELECT src, dst FROM both_ways UNION SELECT r.src, b.dst FROM r2 r JOIN both_ways b ON b.src = r.dst)
SELECT src AS node, least(src, min(dst)) AS component FROM r2 GROUP BY src""", recursive=True)
def _(g):
    from weftgraph.operators.components import star_components

    return star_components(d.file_edges(g))


@query("canonical_cycles")
def _(g):
    return d.file_cycles(g).select(F.array_join("cycle", " > ").alias("cycle"), F.size("cycle").alias("length"))


ALL_FOUND = f""", found AS (
  SELECT 'data_dead_end' AS pattern, 'warning' AS severity, CASE visibility WHEN 'Private' THEN 'high' ELSE 'low' END AS confidence, file, line, qualified_name AS entity FROM ex WHERE kind = 'Function' AND {UNUSED}
  UNION ALL SELECT 'orphaned_impl', 'warning', CASE visibility WHEN 'Private' THEN 'high' ELSE 'moderate' END, file, line, qualified_name FROM ex WHERE kind = 'Method' AND {UNUSED}
  UNION ALL SELECT 'phantom_dependency', 'info', 'high', file, line, name FROM ex WHERE is_import AND NOT EXISTS (SELECT 1 FROM edge JOIN sym s ON s.id = src WHERE dst = ex.id AND s.file = ex.file AND src <> dst)
  UNION ALL SELECT 'stale_reference', 'warning', 'high', file, line, name FROM ex WHERE is_import AND resolution = 'Partial')"""


def _settled(g: CodeGraph) -> CodeGraph:
    """The graph with its rows written once: all detectors read them."""
    own = Scratch(g.symbols.sparkSession, "graph")
    return CodeGraph(own.write(g.symbols), own.write(g.refs), g.scopes, g.boundaries)


@query("severity_counts")
def _(g):
    from weftgraph.operators.summary import severity_counts

    own = Scratch(g.symbols.sparkSession, "findings")
    return severity_counts(d.findings(_settled(g), own, columns=("severity",)))


@query("filtered_findings", ALL_FOUND + " SELECT pattern, entity, confidence FROM found WHERE severity <> 'info' AND confidence <> 'low' AND pattern IN ('data_dead_end', 'stale_reference')")
def _(g):
    return d.diagnostics(g, checks=["data_dead_end", "stale_reference", ""], severity="warning", confidence="moderate").select("pattern", "entity", "confidence")


@query("top_issues")
def _(g):
    return d.first_findings(_settled(g), 5).select("id", "pattern", "entity")


@query("diagnostics")
def _(g):
    return d.diagnostics(_settled(g)).select("id", "pattern", "severity", "confidence", "entity", "loc")


FLOW = """, fe AS (SELECT DISTINCT c.src, coalesce(r.dst, c.dst) AS dst FROM edge c LEFT JOIN sym i ON i.id = c.dst AND i.is_import LEFT JOIN edge r ON r.src = i.id AND r.edge_kind = 'References' WHERE c.edge_kind = 'Calls'),
walk AS (
  SELECT id AS entry, [id] AS path, id AS last, false AS cyc, 0 AS depth FROM {start}
  UNION ALL SELECT w.entry, list_append(w.path, e.dst), e.dst, list_contains(w.path, e.dst), w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.last WHERE NOT w.cyc AND w.depth < {depth}
)
SELECT entry, array_to_string(path[2:], '>') AS path, cyc AS is_cyclic FROM walk w WHERE depth > 0 AND (cyc OR depth = {depth} OR NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.src = w.last))"""


def _shown(flows: DataFrame) -> DataFrame:
    return flows.select("entry", F.array_join("path", ">").alias("path"), "is_cyclic")


TALK = """t AS (SELECT DISTINCT conv_id AS cv, turn AS tn, role FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY tn, role) AS k, count(*) OVER (PARTITION BY cv) AS n, 'talk/c' || cv || '.py::' || coalesce(role, '') || '_' || tn AS q FROM t)
"""


@query("flow_forward", "SELECT 'T' || cv || '_1' AS entry, string_agg('T' || cv || '_' || k, '>' ORDER BY k) FILTER (k > 1) AS path, false AS is_cyclic FROM k WHERE n > 1 GROUP BY cv", ctes=TALK, source=conversation_graph)
def _(g):
    from weftgraph.operators.flows import all_flows

    return _shown(all_flows(g))


@query("flow_backward", FLOW.format(start="sym", edges="(SELECT DISTINCT dst AS src, src AS dst FROM edge WHERE edge_kind = 'Calls')", depth=10), recursive=True)
def _(g):
    from weftgraph.operators.flows import trace_to

    return _shown(trace_to(g, g.symbols))


@query("flow_dedup", """SELECT any_value(q) FILTER (k = 1) AS entry, any_value(q) FILTER (k = n) AS exit, string_agg(q, '>' ORDER BY k) FILTER (k > 1) AS steps, 1::BIGINT AS n FROM k WHERE n > 1 GROUP BY cv""", ctes=TALK, source=conversation_graph)
def _(g):
    from weftgraph.operators.flows import all_flows, deduplicated, flow_entries

    f = deduplicated(flow_entries(g, all_flows(g)))
    return f.groupBy("entry", "exit", F.array_join(F.transform("steps", lambda s: s["entity"]), ">").alias("steps")).agg(F.count("*").alias("n"))


@query("dependency_graph", """, e AS (SELECT a.file AS src, b.file AS dst FROM edge JOIN sym a ON a.id = edge.src JOIN sym b ON b.id = edge.dst WHERE a.file <> b.file),
g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight, bool_or(src > dst) AS back, bool_or(src < dst) AS forth FROM e GROUP BY ALL)
SELECT CASE WHEN back AND NOT forth THEN b ELSE a END AS "from", CASE WHEN back AND NOT forth THEN a ELSE b END AS "to", weight, CASE WHEN back AND forth THEN 'bidirectional' ELSE 'unidirectional' END AS direction FROM g""")
def _(g):
    from weftgraph.operators.summary import dependency_graph

    return dependency_graph(g).select("from", "to", "weight", "direction")


@query("module_roles", """, g AS (SELECT file, count(*) FILTER (kind <> 'Module') AS entity_count, bool_or(entry) AS main, count(*) FILTER (kind = 'Function') AS n FROM sym GROUP BY file)
SELECT file AS name, entity_count, CASE WHEN main THEN 'Entry point module' WHEN n = 0 THEN 'Empty module' ELSE 'Utility module' END AS role FROM g""")
def _(g):
    from weftgraph.operators.summary import modules

    return modules(g)


@query("ambiguous_names", "SELECT qualified_name, count(*) AS n FROM ex WHERE kind <> 'Module' GROUP BY ALL HAVING count(*) > 1")
def _(g):
    from weftgraph.operators.summary import ambiguous_names

    return ambiguous_names(g)


@query("entities", """, c AS (SELECT src, count(*) AS n FROM edge WHERE edge_kind = 'Calls' GROUP BY src), amb AS (SELECT qualified_name FROM ex WHERE kind <> 'Module' GROUP BY ALL HAVING count(*) > 1),
by_name AS (SELECT dst, count(*) FILTER (edge_kind = 'Calls') AS n, count(DISTINCT s.qualified_name) FILTER (edge_kind = 'References' AND NOT EXISTS (SELECT 1 FROM edge k JOIN ex z ON z.id = k.src WHERE k.dst = edge.dst AND k.edge_kind = 'Calls' AND z.qualified_name = s.qualified_name)) AS m FROM edge JOIN ex s ON s.id = src GROUP BY dst)
SELECT ex.id AS symbol_id, CASE WHEN qualified_name IN (SELECT qualified_name FROM amb) THEN split_part(file, '/', 1) || '/' ELSE '' END || qualified_name AS id, CASE kind WHEN 'Method' THEN 'method' ELSE 'fn' END AS kind,
CASE visibility WHEN 'Public' THEN 'pub' ELSE 'priv' END AS vis, loc, coalesce(c.n, 0) AS n_calls, coalesce(b.n, 0) + coalesce(b.m, 0) AS n_called_by FROM ex LEFT JOIN c ON c.src = ex.id LEFT JOIN by_name b ON b.dst = ex.id WHERE kind <> 'Module'""")
def _(g):
    from weftgraph.operators.summary import entities

    return entities(g).select("symbol_id", "id", "kind", "vis", "loc", F.size("calls").cast("long").alias("n_calls"), F.size("called_by").cast("long").alias("n_called_by"))


def _older(g: CodeGraph) -> CodeGraph:
    """An earlier state of the graph: every seventh symbol missing, every fifth private."""
    s = g.symbols.filter("ord % 7 <> 0").withColumn("visibility", F.when(F.col("ord") % 5 == 0, "Private").otherwise(F.col("visibility")))
    return CodeGraph.of(s, g.refs)


@query("diff_entities", """, now AS (SELECT DISTINCT id, visibility AS vis FROM ex WHERE kind <> 'Module'), old AS (SELECT DISTINCT id, CASE WHEN ord % 5 = 0 THEN 'Private' ELSE visibility END AS vis FROM ex WHERE kind <> 'Module' AND ord % 7 <> 0)
SELECT id, 'added' AS change FROM now WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id, 'removed' FROM old WHERE id NOT IN (SELECT id FROM now)
UNION ALL SELECT now.id, 'vis' FROM now JOIN old ON old.id = now.id WHERE old.vis <> now.vis""")
def _(g):
    from weftgraph.operators import diff

    rows = lambda x: x.symbols.filter("kind <> 'Module'").select("id", "kind", F.col("visibility").alias("vis"), F.col("signature").alias("sig"), F.concat_ws(":", "file", "line").alias("loc"), "ord")
    new, old = rows(g), rows(_older(g))
    out = diff.entities_added(old, new).withColumn("change", F.lit("added")).union(diff.entities_removed(old, new).withColumn("change", F.lit("removed")))
    return out.union(diff.entities_changed(old, new).select("id", F.col("field").alias("change")))


@query("diff_diagnostics", f""", u AS (SELECT qualified_name AS entity, loc, ord FROM ex WHERE kind = 'Function' AND {UNUSED}),
gone AS (SELECT id FROM ex WHERE ord % 7 = 0),
o AS (SELECT qualified_name AS entity, loc FROM ex WHERE kind = 'Function' AND NOT excluded AND ord % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM edge WHERE dst = ex.id AND src NOT IN (SELECT id FROM gone)))
SELECT entity, loc, 'new' AS change FROM u WHERE (entity, loc) NOT IN (SELECT (entity, loc) FROM o) UNION ALL SELECT entity, loc, 'resolved' FROM o WHERE (entity, loc) NOT IN (SELECT (entity, loc) FROM u)""")
def _(g):
    from weftgraph.operators import diff

    now, old = d.dead_end(g), d.dead_end(g.remove_symbols(g.symbols.filter("ord % 7 = 0").select("id")))
    a = diff.diagnostics_new(old, now).withColumn("change", F.lit("new"))
    return a.unionByName(diff.diagnostics_resolved(old, now).withColumn("change", F.lit("resolved"))).select("entity", "loc", "change")
