"""Graph operators and detectors on small hand-made graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph import schemas
from weftgraph.functions import paths
from weftgraph.operators import detectors, diff, flows, summary
from weftgraph.operators.graph import CodeGraph, edge_kind


def symbol(id_, name, kind="Function", file="a.py", visibility="Public", line=1, signature=None, annotations=(), resolution="Resolved", info=None):
    return (id_, kind, name, f"{file}::{name}", visibility, signature, file, line, 1, line + 3, 1, resolution, info, None, list(annotations), line)


def graph(spark, symbols, refs):
    s = spark.createDataFrame(symbols, schemas.SYMBOLS)
    r = spark.createDataFrame([(f"r{i}", a, b, kind, "Calls" if kind == "Call" else "References", "a.py", 1, 1, 1, 1, "Resolved", None) for i, (a, b, kind) in enumerate(refs)], schemas.REFS)
    return CodeGraph.of(s, r)


def names(df):
    return sorted(r.entity for r in df.collect())


def test_dead_ends_and_orphans_never_meet(spark):
    kinds = schemas.SYMBOL_KINDS
    g = graph(spark, [symbol(f"x{i}", f"n{i}", kind=k) for i, k in enumerate(kinds)], [])
    dead, orphan = set(names(detectors.dead_end(g))), set(names(detectors.orphaned_impl(g)))
    assert not dead & orphan and orphan == {"a.py::n1"}


def test_confidence_follows_visibility(spark):
    g = graph(spark, [symbol("a", "_hidden"), symbol("b", "shown"), symbol("c", "inner", visibility="Private"), symbol("d", "crate", visibility="Crate"), symbol("e", "main"), symbol("f", "test_x")], [])
    assert {r.entity.split("::")[1]: r.confidence for r in detectors.dead_end(g).collect()} == {"_hidden": "high", "shown": "low", "inner": "high", "crate": "moderate"}


def test_imports(spark):
    g = graph(
        spark,
        [symbol("i", "used", "Module", annotations=["import"]), symbol("j", "unused", "Module", annotations=["import"]), symbol("f", "f"), symbol("k", "gone", "Module", annotations=["import", "from:m"], resolution="Partial", info="module resolved, symbol not found")],
        [("f", "i", "Call"), ("j", "j", "Read")],
    )
    assert names(detectors.phantom_dependency(g)) == ["gone", "unused"]
    assert names(detectors.stale_reference(g)) == ["gone"]


def test_clusters_components_and_cycles(spark):
    g = graph(spark, [symbol("a", "a"), symbol("b", "b"), symbol("c", "c", file="b.py"), symbol("d", "d", file="c.py")], [("a", "b", "Call"), ("b", "a", "Call"), ("c", "d", "Call"), ("d", "c", "Read"), ("a", None, "Read")])
    assert {r.id: r.component for r in g.components().collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert names(detectors.isolated_cluster(g)) == ["a, b", "c, d"]
    assert [r.cycle for r in detectors.file_cycles(g).collect()] == [["b.py", "c.py"]]
    assert sorted(sorted(r.cycle) for r in g.cycles().collect()) == [["a", "b"], ["c", "d"]]


def test_contracts(spark):
    g = graph(
        spark,
        [symbol("a", "s", "Method", signature="(self, x)", annotations=["staticmethod"]), symbol("b", "k", "Method", signature="(cls)", annotations=["classmethod"]), symbol("c", "p", "Method", signature="(self, y)", annotations=["property"]),
         symbol("d", "many", signature="(a, b=f(1, 2))"), symbol("e", "many", file="b.py", signature="(a)"), symbol("f", "free", signature="(*args)"), symbol("g", "free", file="b.py", signature="(a)")],
        [],
    )
    found = {(r.entity, r.severity) for r in detectors.contract_mismatch(g).collect()}
    assert found == {("s", "critical"), ("p", "warning"), ("many", "warning")}


def test_registry_numbers_and_filters(spark):
    g = graph(spark, [symbol("a", "a"), symbol("m", "m", "Method")], [])
    rows = detectors.diagnostics(g).orderBy("id").collect()
    assert [r.id for r in rows] == [f"D{i:03d}" for i in range(1, len(rows) + 1)]
    assert [r.pattern for r in detectors.diagnostics(g, checks=["orphaned_impl", ""]).collect()] == ["orphaned_impl"]
    with pytest.raises(ValueError):
        detectors.diagnostics(g, checks=["nothing"])


def test_flows(spark):
    g = graph(spark, [symbol("m", "main"), symbol("a", "a"), symbol("b", "b")], [("m", "a", "Call"), ("a", "b", "Call"), ("b", "a", "Call")])
    assert [(r.path, r.is_cyclic) for r in flows.all_flows(g, 6).collect()] == [(["a", "b", "a"], True)]
    assert [(r.path, r.is_cyclic) for r in flows.all_flows(g, 2).collect()] == [(["a", "b"], False)]
    assert sorted(r.path for r in flows.trace_to(g, g.symbols.filter("id = 'b'"), 5).collect()) == [["a", "b"], ["a", "m"]]
    e = summary.entities(g)
    assert flows.find_symbol(e, "main") == "a.py::main"
    with pytest.raises(LookupError):
        flows.find_symbol(e, "py")


def test_removal_keeps_rows_without_edges(spark):
    g = graph(spark, [symbol("a", "a"), symbol("b", "b")], [("a", "b", "Call")])
    h = g.remove_symbols(g.symbols.filter("id = 'b'").select("id"))
    assert (h.symbols.count(), h.refs.count(), h.edges().count()) == (1, 1, 0)


def test_diff_of_a_graph_with_itself_is_empty(spark):
    g = graph(spark, [symbol("a", "a"), symbol("b", "b")], [("a", "b", "Call")])
    side = {"entities": summary.entities(g), "diagnostics": detectors.diagnostics(g)}
    assert all(x.isEmpty() for x in diff.diff(side, side).values()) and not diff.has_regressions(side["diagnostics"], side["diagnostics"])
    assert diff.summary_lines({}) == ["no changes"]


def test_path_predicates(spark):
    rows = [("tests/util.py", False), ("a/test_x.py", True), ("x_test.rs", True), ("a.spec.ts", True), ("a/__tests__/b.js", True), ("conftest.py", True)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert df.filter(paths.is_test_path(F.col("p")) != F.col("want")).isEmpty()
    assert df.select(edge_kind(F.lit("Read"))).first()[0] == "References"


def test_pattern_filter_prunes_the_other_detectors(spark):
    g = graph(spark, [symbol("a", "a")], [])
    both = detectors.dead_end(g).unionByName(detectors.orphaned_impl(g)).filter("pattern = 'orphaned_impl'")
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_versions_of_many_digits(spark):
    from weftgraph.operators import detectors
    from weftgraph.sources.projection import _symbols

    names = ["job_v9", "job_v10", "job_v12345678901", "job_V12345678902", "job_v007", "plain", "_v1"]
    s = _symbols(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string"), "concat('s', i)", "Function", "n", "'a/b.py'", "i", "i")
    got = {r.name: (r.base, r.version.digits) for r in detectors.version_members(CodeGraph.of(s, spark.createDataFrame([], schemas.REFS))).collect()}
    assert got == {"job_v9": ("job", "9"), "job_v10": ("job", "10"), "job_v12345678901": ("job", "12345678901"), "job_V12345678902": ("job", "12345678902"), "job_v007": ("job", "7")}
    ordered = [r.name for r in detectors.version_members(CodeGraph.of(s, spark.createDataFrame([], schemas.REFS))).orderBy("version").collect()]
    assert ordered == ["job_v007", "job_v9", "job_v10", "job_v12345678901", "job_V12345678902"]


def test_components_of_a_long_chain_and_of_isolated_symbols(spark):
    from weftgraph.sources.projection import _refs, _symbols

    s = _symbols(spark.range(3000), "concat('s', lpad(id, 5, '0'))", "Function", "concat('f', id)", "'a.py'", "id", "id")
    e = _refs(spark.range(999).selectExpr("concat('s', lpad(id, 5, '0')) AS src", "concat('s', lpad(id + 1, 5, '0')) AS dst"), "Call", "'a.py'")
    sizes = CodeGraph.of(s, e).components().groupBy("component").count()
    assert sorted(r["count"] for r in sizes.collect()) == [1] * 2000 + [1000]


def strong_by_hand(edges):
    """Node -> largest node of its strongly connected component, for nodes on cycles; by closing over all pairs."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), list(near.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        return seen

    far = {a: reach(a) for a in {x for e in edges for x in e}}
    return {a: max(b for b in far[a] if a in far[b]) for a in far if a in far[a]}


def test_strong_components(spark):
    import random

    from weftgraph.operators.components import strong_components

    rng = random.Random(3)
    for n, m in ((1, 1), (6, 8), (30, 45), (60, 50)):
        edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]
        rows = edges + edges[:3] + [(None, "n00"), ("n00", None)]
        got = {r.node: r.component for r in strong_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
        assert got == strong_by_hand(edges)
    assert strong_components(spark.createDataFrame([], "src string, dst string")).collect() == []
