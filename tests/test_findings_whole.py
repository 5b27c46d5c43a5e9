"""Whole reports run one detector after another."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftgraph import catalog, runtime

SF = "/root/testdata/sf0.001"


def test_detectors_run_one_after_another(spark, monkeypatch):
    joins = []
    note = lambda df: joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
    write, check = runtime.Scratch.write, DataFrame.checkpoint
    monkeypatch.setattr(runtime.Scratch, "write", lambda self, df, **sums: (note(df), write(self, df, **sums))[1])
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: (note(self), check(self, *a, **k))[1])
    for name in ("severity_counts",):
        joins.clear()
        note(catalog.QUERIES[name](spark, SF))
        assert 2 * max(joins) < sum(joins), name  # no plan holds the joins of all detectors
