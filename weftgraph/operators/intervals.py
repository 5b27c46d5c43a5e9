"""Interval joins over tables of scopes, symbols and references: nesting of scopes, scopes of symbols, callers of references, nearest imports.

Rows meet by file and by blocks of BLOCK_LINES lines, so that a large file is no single group of pairs: an interval lies in every block that
it touches, a point or the start of another interval in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_LINES = 256
#: Ranges of more blocks than these are cut at the last start of their file.
FAR = 16
PLACE = ("line", "column", "end_line", "end_column")


def _start(p: str = "") -> Column:
    return F.struct(F.col(f"{p}line").alias("l"), F.col(f"{p}column").alias("c"))


def _end(p: str = "") -> Column:
    return F.struct(F.col(f"{p}end_line").alias("l"), F.col(f"{p}end_column").alias("c"))


def _blocks(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of outer as o_*, once for each block `_ob` that their range touches; ranges that touch none are left out.

    A range of more than FAR blocks needs none behind the last start of its file in inner, which is only looked up where there are such ranges.
    """
    o = outer.select(*(F.col(c).alias(f"o_{c}") for c in outer.columns))
    low, block = (F.col("o_line") / BLOCK_LINES).cast("long"), lambda c: (c / BLOCK_LINES).cast("long")
    o = o.withColumns({"_low": low, "_high": block(F.col("o_end_line"))}).filter("_high >= _low")
    far = o.filter(F.col("_high") - F.col("_low") > FAR)
    if not far.isEmpty():
        ends = inner.groupBy("file").agg(F.max("line").alias("_last")).withColumnRenamed("file", "_lf")
        far = far.join(ends, F.col("o_file") == F.col("_lf")).withColumn("_high", F.least("_high", block(F.col("_last")))).filter("_high >= _low")
        o = o.filter(F.col("_high") - F.col("_low") <= FAR).unionByName(far.drop("_lf", "_last"))
    return o.withColumn("_ob", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def _held(inner: DataFrame, outer: DataFrame, order: list, where: Column | None = None) -> DataFrame:
    """Every row of inner with the columns o_* of the row of outer that comes first among those of its file whose range holds its own; nulls without one.

    All candidates of a row meet in its one block, so the first is found where they meet: pairs are not shuffled again, and neither are rows of inner.
    Rows are told apart by a mark of their own; ids may repeat.
    """
    i = inner.withColumns({"_ib": (F.col("line") / BLOCK_LINES).cast("long"), "_u": F.monotonically_increasing_id()})
    holds = (F.col("file") == F.col("o_file")) & (F.col("_ib") == F.col("_ob")) & (_start("o_") <= _start()) & (_end() <= _end("o_"))
    met = i.join(_blocks(outer, inner), holds if where is None else holds & where, "left")
    return _first(met, ["file", "_ib", "_u"], order).drop("_ib", "_ob", "_u")


def _first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def _same() -> Column:
    return (_start() == _start("o_")) & (_end() == _end("o_"))


def scope_parents(scopes: DataFrame) -> DataFrame:
    """(id, parent_id) of every scope: the innermost scope before it in its file that holds it and is larger; null without one.

    Of equal ranges the earlier scope is the parent. Scopes with a null file or place have no parent.
    """
    s = scopes.select("id", "file", *PLACE, "ord")
    order = [F.desc("o_line"), F.desc("o_column"), "o_end_line", "o_end_column", "o_ord"]
    return _held(s, s, order, ~_same() & (F.col("o_ord") < F.col("ord"))).select("id", F.col("o_id").alias("parent_id"))


def symbol_scopes(symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, scope_id) of every symbol: the innermost scope that holds it and is not its own, else its own, else the file's first scope.

    A scope with the symbol's very range is its own, unless it is the file's. Of equal ranges the later scope counts. Null in files without scopes.
    """
    own = (_same() & (F.col("o_kind") != "File")).cast("int")
    order = [own, F.desc("o_line"), F.desc("o_column"), "o_end_line", "o_end_column", F.desc("o_ord")]
    best = _held(symbols.select("id", "file", *PLACE), scopes.select("id", "kind", "file", *PLACE, "ord"), order).select("id", "file", "o_id")
    first = scopes.groupBy("file").agg(F.min_by("id", F.struct("ord", "id")).alias("_first")).withColumnRenamed("file", "_f")
    # only symbols outside all scopes go to their file's first one
    inside, outside = best.filter("o_id IS NOT NULL"), best.filter("o_id IS NULL").join(first, F.col("file") == F.col("_f"), "left")
    return inside.select("id", F.col("o_id").alias("scope_id")).unionByName(outside.select("id", F.col("_first").alias("scope_id")))


def enclosing_callables(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, caller) of every reference: the innermost function or method that holds it; of equal ranges the later one. Null outside all."""
    callables = symbols.filter(F.col("kind").isin("Function", "Method")).select("id", "file", *PLACE, "ord")
    order = [F.desc("o_line"), F.desc("o_column"), "o_end_line", "o_end_column", F.desc("o_ord")]
    return _held(refs.select("id", "file", *PLACE), callables, order).select("id", F.col("o_id").alias("caller"))


def nearest_imports(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """uses (id, file, name, line, ...) with `import_id`: the import (id, file, name, line, ord) of that name in the file that stands nearest above, else its first one, else null."""
    i = imports.select(F.col("id").alias("_dst"), F.col("file").alias("_file"), F.col("name").alias("_name"), F.col("line").alias("_line"), F.col("ord").alias("_ord"))
    met = uses.withColumn("_u", F.monotonically_increasing_id()).join(i, (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")), "left")
    above = F.coalesce(F.col("_line") <= F.col("line"), F.lit(False))
    best = _first(met, ["file", "name", "_u"], [above.cast("int").desc(), F.when(above, F.col("_line")).desc_nulls_last(), "_ord"])
    return best.withColumnRenamed("_dst", "import_id").drop("_file", "_name", "_line", "_ord", "_u")
