"""Session helpers: names, scratch tables, row numbers and the shared folder."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftgraph import runtime


def test_fresh_names():
    assert runtime.fresh(["a", "B_"], "a", "b", "b_", "c") == ["a_", "b", "b__", "c"]


def test_scratch_tables(spark):
    scratch = runtime.Scratch(spark, "test")
    path = lambda t: t._weft_path.removeprefix("file://")
    a = scratch.write(spark.range(10), total=F.sum("id"))
    b, empty = scratch.write(a.filter("id > 7")), scratch.write(a.filter("id > 99"), total=F.sum("id"))
    assert (runtime.rows(a), runtime.seen(a, "total"), runtime.rows(b), runtime.rows(empty), runtime.seen(empty, "total")) == (10, 45, 2, 0, None)
    assert b.count() == 2 and empty.schema == a.schema
    scratch.drop(a)
    assert not os.path.exists(path(a)) and os.path.exists(path(b))
    scratch.drop_but(b)
    assert b.count() == 2 and not os.path.exists(path(empty))
    scratch.drop_but()
    assert not os.path.exists(path(b))


def test_row_numbers(spark):
    df = spark.createDataFrame([(k * 37 % 100, None if k % 10 == 0 else "x") for k in range(100)], "k long, v string")
    got = runtime.number_rows(df, [F.col("v").isNull(), F.col("k")]).collect()
    want = sorted(((r.v is None, r.k) for r in got))
    assert [(r.v is None, r.k) for r in sorted(got, key=lambda r: r.row_no)] == want and sorted(r.row_no for r in got) == list(range(100))
    assert runtime.number_rows(df.limit(0), [F.col("k")]).collect() == []


def test_a_cluster_must_name_its_shared_folder():
    asked = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(asked)
