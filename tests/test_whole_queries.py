"""The registered queries over the whole graph against brute force, besides their SQL in test_catalog."""

from __future__ import annotations

from collections import Counter

import duckdb

from weftgraph import catalog
from weftgraph.operators import flows
from weftgraph.sources.projection import project

SF = "/root/testdata/sf0.001"


def near(edges):
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
    return out


def brute_paths(edges, starts, depth):
    """(entry, path, is_cyclic) of all simple paths, by a depth-first search."""
    nexts, out, todo = near(edges), [], [(s, (s,)) for s in starts]
    while todo:
        entry, path = todo.pop()
        cyclic = path[-1] in path[:-1]
        following = () if cyclic or len(path) > depth else nexts.get(path[-1], ())
        todo += [(entry, (*path, d)) for d in following]
        if len(path) > 1 and not following:
            out.append((entry, ">".join(path[1:]), cyclic))
    return sorted(out)


def test_paths_back_from_every_symbol(spark):
    g = project(spark, SF)
    ids = [r.id for r in g.symbols.select("id").collect()]
    want = brute_paths([(r.dst, r.src) for r in g.callees().collect()], ids, 10)
    got = sorted((r.entry, r.path, r.is_cyclic) for r in catalog.QUERIES["flow_backward"](spark, SF).collect())
    assert got == want and {e[0] for e, _, _ in got} == set("SPCI") and max(p.count(">") for _, p, _ in got) == 9


def test_callers_of_all_kinds_of_targets(spark):
    want = sorted((r.dst, r.src) for r in project(spark, SF).calls().select("src", "dst").collect())
    got = sorted((r.dst, r.src) for r in catalog.QUERIES["callers"](spark, SF).collect())
    assert got == want and {d[0] for d, _ in got} == set("SPCI")


def talks(spark):
    by = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role))
    return {c: sorted(t) for c, t in by.items()}


def test_flows_to_the_real_end(spark):
    want = sorted((f"T{c}_1", ">".join(f"T{c}_{k}" for k in range(2, len(t) + 1)), False) for c, t in talks(spark).items() if len(t) > 1)
    got = sorted((r.entry, r.path, r.is_cyclic) for r in catalog.QUERIES["flow_forward"](spark, SF).collect())
    assert got == want and max(p.count(">") for _, p, _ in got) >= 4  # deeper than flow_forward goes
    name = lambda c, t: f"talk/c{c}.py::{t[1]}_{t[0]}"
    want = sorted((name(c, t[0]), name(c, t[-1]), ">".join(name(c, x) for x in t[1:]), 1) for c, t in talks(spark).items() if len(t) > 1)
    got = sorted((r.entry, r.exit, r.steps, r.n) for r in catalog.QUERIES["flow_dedup"](spark, SF).collect())
    assert got == want


def test_flows_of_the_projection_to_the_real_end(spark):
    g = project(spark, SF)
    entries = [r.id for r in flows.entry_points(g).collect()]
    want = brute_paths([(r.src, r.dst) for r in flows.flow_edges(g).collect()], entries, flows.ALL_DEPTH)
    rows = flows.all_flows(g).collect()
    assert sorted((r.entry, ">".join(r.path), r.is_cyclic) for r in rows) == want
    assert max(len(r.path) for r in rows) < flows.ALL_DEPTH and any(r.is_cyclic and len(r.path) > 6 for r in rows)


def test_reports_count_every_detector(spark):
    con = duckdb.connect()
    for t in ("supplier", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    count = lambda q, n="count(*)": con.execute(f"SELECT {n} FROM ({catalog.ORACLE_SQL[q]})").fetchall()[0][0] or 0
    want = {"data_dead_end": count("dead_end"), "orphaned_impl": count("orphaned"), "phantom_dependency": count("phantom")}
    want |= {n: count(n) for n in ("missing_reexport", "layer_violation", "stale_reference", "partial_wiring")}
    want["incomplete_migration"] = count("naming_pairs") + count("version_pairs") + int(count("import_coexistence", "sum(pairs)"))
    rows = catalog.QUERIES["diagnostics"](spark, SF).collect()
    got = Counter(r.pattern for r in rows)
    assert {n: got[n] for n in want} == want and got["layer_violation"] and got["incomplete_migration"]
    assert sorted(r.id for r in rows) == sorted(f"D{k:03d}" for k in range(1, len(rows) + 1))


def test_severities_count_every_detector(spark):
    n = catalog.QUERIES["severity_counts"](spark, SF).first()
    rows = catalog.QUERIES["diagnostics"](spark, SF).collect()
    by = Counter(r.severity for r in rows)
    assert (n.critical, n.warning, n.info, n.has_critical, n.has_findings) == (by["critical"], by["warning"], by["info"], by["critical"] > 0, True)
    assert [(r.id, r.pattern, r.entity) for r in catalog.QUERIES["top_issues"](spark, SF).collect()] == sorted((r.id, r.pattern, r.entity) for r in rows)[:5]


def test_paths_beyond_the_limit_of_recursive_queries(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    edges = spark.createDataFrame([(f"{k}", f"{k + j}") for k in range(6) for j in (1, 2)], "src string, dst string")
    spark.conf.set(key, "5")
    try:
        got = sorted((r.entry, ">".join(r.path), r.is_cyclic) for r in flows.paths(edges, spark.range(6).selectExpr("cast(id AS string) AS id"), 4).collect())
    finally:
        spark.conf.set(key, before)
    assert got == brute_paths([(r.src, r.dst) for r in edges.collect()], [str(k) for k in range(6)], 4) and len(got) > 20
