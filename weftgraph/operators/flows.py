"""Call paths: enumeration forward and backward, with import proxies, deduplication and symbol lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import CodeGraph
from weftgraph.runtime import Scratch, number_rows, release, seen

ALL_DEPTH, TRACE_DEPTH = 64, 10
FLOWS = "entry string, path array<string>, is_cyclic boolean"


def flow_edges(graph: CodeGraph) -> DataFrame:
    """(src, dst): calls, where a call to an import leads on to what the import refers to, if to anything."""
    imports = graph.symbols.filter(F.array_contains("annotations", "import")).select(F.col("id").alias("_i"))
    onward = graph.edges().filter("edge_kind = 'References'").join(imports, F.col("src") == F.col("_i"), "left_semi").select(F.col("src").alias("_p"), F.col("dst").alias("_t"))
    met = graph.callees().join(onward, F.col("dst") == F.col("_p"), "left")
    return met.select("src", F.coalesce("_t", "dst").alias("dst"))


def paths(edges: DataFrame, entries: DataFrame, depth: int, distinct: bool = True) -> DataFrame:
    """All simple paths from the ids in column `id`: (entry, path, is_cyclic), path without the entry.

    A path ends where nothing follows, where it meets one of its own nodes (kept as last step, is_cyclic) or at
    `depth` steps. Entries without a next step give no row. With distinct=False parallel edges give
    parallel paths, and a path cut at `depth` counts once for each step that would follow. Paths of each length but the last
    are a table in the shared folder, so their number has no limit.
    """
    spark = edges.sparkSession
    own = Scratch(spark, "paths")
    e = edges.select("src", "dst")
    e = e.distinct() if distinct else e
    out = e.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("n_out"))
    e = own.write(e.join(out, F.col("dst") == F.col("_s"), "left").select("src", "dst", "n_out"))  # n_out: steps that follow dst
    found, front = spark.createDataFrame([], f"{FLOWS}, n_out bigint"), entries.select(F.col("id").alias("entry"), F.array().cast("array<string>").alias("path")).distinct()
    for k in range(1, depth + 1):
        last = F.col("entry") if k == 1 else F.element_at("path", -1)
        step = front.withColumn("_at", last).join(e, F.col("_at") == F.col("src"))
        again = (F.col("dst") == F.col("entry")) | F.array_contains("path", F.col("dst"))
        step = step.select("entry", F.concat("path", F.array("dst")).alias("path"), again.alias("is_cyclic"), "n_out")
        if k == depth:
            found = found.unionByName(step)
            break
        step = own.write(step, n_open=F.count_if(~F.col("is_cyclic") & F.col("n_out").isNotNull()))
        release(spark)
        found = found.unionByName(step.filter("is_cyclic OR n_out IS NULL"))
        if not seen(step, "n_open"):
            break
        front = step.filter("NOT is_cyclic AND n_out IS NOT NULL").select("entry", "path")
    if distinct:
        return found.select("entry", "path", "is_cyclic")
    times = F.when(F.col("is_cyclic") | F.col("n_out").isNull(), 1).otherwise(F.col("n_out"))
    return found.withColumn("_t", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("entry", "path", "is_cyclic")


def entry_points(graph: CodeGraph) -> DataFrame:
    """Symbols named main or __main__ or marked as entry points, other than modules."""
    s = graph.symbols.filter((F.col("kind") != "Module") & (F.col("name").isin("main", "__main__") | F.coalesce(F.array_contains("annotations", "entry_point"), F.lit(False))))
    return s.select("id")


def trace_from(graph: CodeGraph, entries: DataFrame, depth: int = TRACE_DEPTH, distinct: bool = True) -> DataFrame:
    return paths(flow_edges(graph), entries, depth, distinct)


def trace_to(graph: CodeGraph, targets: DataFrame, depth: int = TRACE_DEPTH, distinct: bool = True) -> DataFrame:
    """Paths over callers; import proxies are not followed. entry is the target."""
    return paths(graph.callees().select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets, depth, distinct)


def all_flows(graph: CodeGraph, depth: int = ALL_DEPTH, distinct: bool = True) -> DataFrame:
    return trace_from(graph, entry_points(graph), depth, distinct)


def flow_entries(graph: CodeGraph, flows: DataFrame) -> DataFrame:
    """Flows by qualified names: id, description, entry, exit, steps, issues; numbered in order of entry and path."""
    names = graph.symbols.select(F.col("id").alias("_i"), F.col("qualified_name").alias("_q"))
    f = number_rows(flows, [F.col(c) for c in ("entry", "path", "is_cyclic")], "_no").withColumn("n", F.col("_no") + 1).drop("_no")
    steps = f.select("n", F.posexplode("path").alias("k", "step")).join(names, F.col("step") == F.col("_i"), "left")
    step = F.struct("k", F.coalesce("_q", F.lit("unknown")).alias("entity"))
    steps = steps.groupBy("n").agg(F.array_sort(F.collect_list(step)).alias("s")).withColumnRenamed("n", "_n")
    met = f.join(steps, F.col("n") == F.col("_n"), "left").join(names, F.col("entry") == F.col("_i"), "left").withColumn("e", F.coalesce("_q", "entry"))
    met = met.withColumn("exit", F.coalesce(F.expr("element_at(s, -1).entity"), "e"))
    text = F.when(F.col("is_cyclic"), F.concat(F.lit("Cyclic flow from "), "e")).otherwise(F.concat(F.lit("Flow from "), "e", F.lit(" to "), "exit"))
    as_step = F.transform(
        F.coalesce("s", F.array().cast("array<struct<k:int,entity:string>>")),
        lambda x: F.struct(x["entity"].alias("entity"), F.lit("call").alias("action"), F.lit("unknown").alias("in_type"), F.lit("unknown").alias("out_type")),
    )
    return met.select(
        F.format_string("F%03d", "n").alias("id"), text.alias("description"), F.col("e").alias("entry"), "exit", as_step.alias("steps"), F.array().cast("array<string>").alias("issues")
    )


def deduplicated(entries: DataFrame) -> DataFrame:
    """The first flow of each (entry, exit, steps), numbered anew."""
    w = Window.partitionBy("entry", "exit", "steps").orderBy(F.length("id"), "id")
    first = entries.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return number_rows(first, [F.length("id"), F.col("id")], "_no").withColumn("id", F.format_string("F%03d", F.col("_no") + 1)).drop("_no")


def find_symbol(entities: DataFrame, wanted: str) -> str:
    """The one entity id that is `wanted`, ends in it as its last :: part, or contains it; LookupError otherwise."""
    ids = entities.select("id")
    rules = [F.col("id") == wanted, F.element_at(F.split("id", "::"), -1) == wanted, F.contains("id", F.lit(wanted))]
    for k, rule in enumerate(rules):
        found = [r["id"] for r in ids.filter(rule).orderBy("id").limit(6).collect()]
        if len(found) == 1:
            return found[0]
        if found and k:
            raise LookupError(f"{wanted!r} is ambiguous: {', '.join(found[:5])}")
    raise LookupError(f"no symbol matches {wanted!r}")
