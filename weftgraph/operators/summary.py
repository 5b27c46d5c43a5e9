"""Projections and aggregates of a graph and its findings: entities, modules, dependencies, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import schemas
from weftgraph.functions import paths
from weftgraph.operators.graph import CodeGraph


def _names(graph: CodeGraph, column: str) -> DataFrame:
    return graph.symbols.select(F.col("id").alias("_i"), F.col("qualified_name").alias(column))


def calls(graph: CodeGraph) -> DataFrame:
    """(id, calls): qualified names of callees as a bag, in order of reference ids."""
    e = graph.calls().join(_names(graph, "q"), F.col("dst") == F.col("_i"))
    return e.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "q"))), lambda x: x["q"]).alias("calls"))


def called_by(graph: CodeGraph) -> DataFrame:
    """(id, called_by): callers as a bag, then importers that are not among them."""
    e = graph.edges().join(_names(graph, "q"), F.col("src") == F.col("_i"))
    bag = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("edge_kind") == k, F.struct("ref_id", "q")))), lambda x: x["q"])
    g = e.groupBy(F.col("dst").alias("id")).agg(bag("Calls").alias("c"), bag("References").alias("r"))
    return g.select("id", F.concat("c", F.array_except("r", "c")).alias("called_by"))


def ambiguous_names(graph: CodeGraph) -> DataFrame:
    """(qualified_name, n) of names that several symbols other than modules have."""
    return graph.symbols.filter("kind <> 'Module'").groupBy("qualified_name").agg(F.count("*").alias("n")).filter("n > 1")


def entities(graph: CodeGraph, root: str = "") -> DataFrame:
    """symbol_id, id, kind, vis, sig, loc, calls, called_by, annotations of symbols other than modules; ambiguous ids get their directory's name before them."""
    s = graph.symbols.filter("kind <> 'Module'").withColumn("n", F.count("*").over(Window.partitionBy("qualified_name")))
    folder = paths.base_name(paths.parent_dir(F.col("file")))
    name = F.when((F.col("n") > 1) & (folder != ""), F.concat(folder, F.lit("/"), "qualified_name")).otherwise(F.col("qualified_name"))
    none = F.array().cast("array<string>")
    s = s.withColumnRenamed("id", "symbol_id")
    s = s.join(calls(graph).withColumnRenamed("id", "_a"), F.col("symbol_id") == F.col("_a"), "left").join(called_by(graph).withColumnRenamed("id", "_b"), F.col("symbol_id") == F.col("_b"), "left")
    return s.select(
        "symbol_id", name.alias("id"), schemas.lookup(F.col("kind"), schemas.KIND_LABELS).alias("kind"), schemas.lookup(F.col("visibility"), schemas.VISIBILITY_LABELS).alias("vis"),
        F.coalesce("signature", F.lit("")).alias("sig"), F.concat_ws(":", paths.relative_path(F.col("file"), root), "line").alias("loc"), F.coalesce("calls", none).alias("calls"),
        F.coalesce("called_by", none).alias("called_by"), "annotations", "ord", "file",
    )


def role(n: Column, classes: Column, imports: Column, functions: Column) -> Column:
    most = lambda c: (c > 0) & (c * 2 >= n)
    return (
        F.when(n == 0, "Empty module").when(most(classes), "Data model module").when(most(imports), "API boundary module").when(most(functions), "Utility module").otherwise("Service module")
    )


def modules(graph: CodeGraph, root: str = "") -> DataFrame:
    """name, entity_count and role of each file, most entities first."""
    s = graph.symbols.withColumn("is_import", paths.is_import(F.col("annotations")))
    plain = ~F.col("kind").isin("Module", "Method")
    main = F.col("name").isin("main", "__main__") | F.coalesce(F.array_contains("annotations", "entry_point"), F.lit(False))
    test = F.col("name").startswith("test_") & F.col("kind").isin("Function", "Method")
    g = s.groupBy("file").agg(
        F.count_if(F.col("kind") != "Module").alias("entity_count"), F.bool_or(main).alias("main"), F.bool_or(test).alias("test"), F.count_if(plain).alias("n"),
        F.count_if(F.col("kind").isin("Class", "Struct", "Enum")).alias("c"), F.count_if(plain & F.col("is_import")).alias("i"), F.count_if(F.col("kind") == "Function").alias("f"),
    )
    kind = F.when(F.col("main"), "Entry point module").when(F.col("test") | paths.is_test_path(F.col("file")), "Test module").otherwise(role(F.col("n"), F.col("c"), F.col("i"), F.col("f")))
    out = g.select(paths.relative_path(F.col("file"), root).alias("name"), "entity_count", kind.alias("role"))
    return out.orderBy(F.desc("entity_count"), "name")


def dependency_graph(graph: CodeGraph, root: str = "", compat: bool = False) -> DataFrame:
    """from, to, weight, direction, issues: cross-file edges by unordered pair of files.

    compat calls a pair bidirectional as soon as one edge leads from the later to the earlier path.
    """
    from weftgraph.operators.detectors import file_edges

    e = file_edges(graph)
    g = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("weight"), F.bool_or(F.col("src") > F.col("dst")).alias("back"), F.bool_or(F.col("src") < F.col("dst")).alias("forth"))
    both = F.col("back") if compat else F.col("back") & F.col("forth")
    p = lambda c: paths.relative_path(F.col(c), root)
    # a pair that only leads from the later path to the earlier one keeps its direction
    turned = F.lit(False) if compat else F.col("back") & ~F.col("forth")
    out = g.select(
        F.when(turned, p("b")).otherwise(p("a")).alias("from"), F.when(turned, p("a")).otherwise(p("b")).alias("to"), "weight",
        F.when(both, "bidirectional").otherwise("unidirectional").alias("direction"), F.array().cast("array<string>").alias("issues"),
    )
    return out.orderBy("from", "to")


def program_entries(entity_rows: DataFrame) -> DataFrame:
    return entity_rows.filter(F.col("id").endswith("::main") | F.contains("id", F.lit("__main__"))).select("id")


def severity_counts(found: DataFrame) -> DataFrame:
    """One row: critical, warning, info, has_critical, has_findings."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(n("critical").alias("critical"), n("warning").alias("warning"), n("info").alias("info"), (n("critical") > 0).alias("has_critical"), (F.count("*") > 0).alias("has_findings"))


def top_issues(found: DataFrame, n: int = 5) -> DataFrame:
    return found.orderBy("id").limit(n)


def architecture(languages: list[str], n_modules: int, n_entities: int) -> str:
    """One sentence about the project."""
    if not n_modules:
        return "A project without source files that can be analyzed."
    kind = languages[0] if len(languages) == 1 else f"Mixed ({', '.join(languages)})"
    return f"{kind} project: {n_modules} modules, {n_entities} entities."


def manifest_entries(found: DataFrame) -> DataFrame:
    """Findings as they stand in a manifest."""
    return found.select("id", "pattern", "severity", "confidence", "entity", "message", "evidence", "suggestion", "loc")
