"""Interval joins: repeated ids, far ranges, and how often rows are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import catalog, catalog_links  # noqa: F401
from weftgraph.operators import intervals

SF = "/root/testdata/sf0.001"


def test_no_shuffle_by_id(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("scope_interval", "enclosing_callable", "scope_parents", "asof_import"):
            plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning(file" in plan and "Exchange hashpartitioning(id" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_and_far_ranges(spark):
    place = lambda *r: dict(zip(("line", "column", "end_line", "end_column"), r, strict=True))
    scope = "id string, kind string, file string, line long, column long, end_line long, end_column long, ord long"
    scopes = spark.createDataFrame([{"id": i, "kind": k, "file": "f", "ord": o, **place(*r)} for i, k, o, r in (("all", "File", 0, (1, 1, 1 << 50, 1)), ("in", "Function", 1, (9, 1, 90000, 1)))], scope)
    refs = spark.createDataFrame([{"id": i, "file": f, **place(*r)} for i, f, r in (("a", "f", (10, 1, 10, 2)), ("a", "f", (10, 1, 10, 2)), ("b", "f", (95000, 1, 95000, 2)), ("c", None, (1, 1, 1, 1)), ("d", "g", (1, 1, 1, 1)))], "id string, file string, line long, column long, end_line long, end_column long")
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert got(intervals.symbol_scopes(refs, scopes)) == [("a", "in"), ("a", "in"), ("b", "all"), ("c", None), ("d", None)]
    assert got(intervals.enclosing_callables(refs, scopes)) == [("a", "in"), ("a", "in"), ("b", None), ("c", None), ("d", None)]
    assert got(intervals.scope_parents(scopes)) == [("all", None), ("in", "all")]
    uses, imports = refs.withColumn("name", F.lit("n")), spark.createDataFrame([("x", "f", "n", 1, 0)], "id string, file string, name string, line long, ord long")
    assert got(intervals.nearest_imports(uses, imports).select("id", "import_id")) == [("a", "x"), ("a", "x"), ("b", "x"), ("c", None), ("d", None)]
