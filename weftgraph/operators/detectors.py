"""Structural detectors: each takes a CodeGraph and gives rows of schemas.DIAGNOSTICS.

Every detector's rows carry its pattern as a literal, so a filter on `pattern` over their union prunes the
other branches when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import schemas
from weftgraph.functions import paths
from weftgraph.operators.graph import CodeGraph, back_edge_cycles, canonical
from weftgraph.runtime import Scratch, number_rows, release

CALLABLE = ("Function", "Method")
#: Callers that a finding names.
SHOWN = 5


def prepared(graph: CodeGraph, root: str = "") -> DataFrame:
    """Symbols with rel (path below root), is_test, is_import and excluded."""
    s = graph.symbols
    return s.withColumns(
        {
            "rel": paths.relative_path(F.col("file"), root), "is_test": paths.is_test_path(F.col("file")), "is_import": paths.is_import(F.col("annotations")),
            "excluded": paths.is_excluded(F.col("name"), F.col("file"), F.col("annotations")),
        }
    )


def used_edges(graph: CodeGraph) -> DataFrame:
    return graph.edges().filter(F.col("edge_kind").isin("Calls", "References"))


def _text(template: str, *args) -> Column:
    return F.format_string(template, *args)


def _evidence(*items: tuple) -> Column:
    kind = "struct<observation:string,location:string,context:string>"
    parts = [F.struct(*(F.lit(None).cast("string") if x is None else x for x in (*i, None, None)[:3])).cast(kind) for i in items]
    return F.array(*parts)


def _found(df: DataFrame, pattern: str, severity: str | Column, confidence: str | Column, entity: Column, message: Column, evidence: Column, suggestion: Column, loc: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    place = _text("%s:%d", "rel", "line") if loc is None else loc
    return df.select(
        F.lit(pattern).alias("pattern"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), entity.alias("entity"), message.alias("message"), evidence.alias("evidence"),
        suggestion.alias("suggestion"), place.alias("loc"), F.col("rel").alias("file"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"),
    )


def _with_file_count(df: DataFrame, graph: CodeGraph) -> DataFrame:
    n = graph.symbols.agg(F.countDistinct("file").alias("n_files"))
    return df.crossJoin(F.broadcast(n))  # one row


def _unused(graph: CodeGraph, root: str) -> DataFrame:
    s = prepared(graph, root).filter(~F.col("excluded"))
    return s.join(used_edges(graph).select(F.col("dst").alias("_d")), F.col("id") == F.col("_d"), "left_anti")


def _confidence(public: str) -> Column:
    hidden = F.col("name").startswith("_") & ~F.col("name").startswith("__")
    return F.when(F.col("visibility").isin("Private", "Protected"), "high").when(F.col("visibility") == "Crate", "moderate").when(hidden, "high").otherwise(public)


def dead_end(graph: CodeGraph, root: str = "") -> DataFrame:
    """Definitions other than containers and methods that nothing calls or references."""
    s = _with_file_count(_unused(graph, root).filter(~F.col("kind").isin("Module", "Class", "Struct", "Method")), graph)
    return _found(
        s, "data_dead_end", "warning", _confidence("low"), F.col("qualified_name"), _text("%s '%s' has no caller and no reference", F.lower("kind"), "name"),
        _evidence((_text("no use in %d analyzed files", "n_files"), _text("%s:%d", "rel", "line"), _text("visibility %s, kind %s", "visibility", "kind"))),
        _text("Delete '%s', call it, or mark it as an entry point.", "name"),
    )


def orphaned_impl(graph: CodeGraph, root: str = "") -> DataFrame:
    """Methods that nothing calls or references."""
    s = _with_file_count(_unused(graph, root).filter("kind = 'Method'"), graph)
    return _found(
        s, "orphaned_impl", "warning", _confidence("moderate"), F.col("qualified_name"), _text("method '%s' is implemented but never used", "name"),
        _evidence((_text("no use in %d analyzed files", "n_files"), _text("%s:%d", "rel", "line"), _text("visibility %s", "visibility"))),
        _text("Call '%s' or delete it.", "name"),
    )


def phantom_dependency(graph: CodeGraph, root: str = "") -> DataFrame:
    """Imports without a use by another symbol of their own file."""
    s = prepared(graph, root).filter("is_import")
    users = used_edges(graph).filter("src <> dst").join(graph.symbols.select(F.col("id").alias("_u"), F.col("file").alias("_f")), F.col("src") == F.col("_u")).select("dst", "_f")
    s = _with_file_count(s.join(users, (F.col("id") == F.col("dst")) & (F.col("file") == F.col("_f")), "left_anti"), graph)
    return _found(
        s, "phantom_dependency", "info", "high", F.col("name"), _text("import '%s' is not used in its file", "name"),
        _evidence((_text("'%s' has no use here, %d files analyzed", "name", "n_files"), _text("%s:%d", "rel", "line"), F.lit("no symbol of the importing file refers to it"))),
        _text("Remove the import of '%s'.", "name"),
    )


def isolated_cluster(graph: CodeGraph, root: str = "") -> DataFrame:
    """Components of two or more symbols without any root or import, that have edges of their own."""
    parts = graph.components()
    s = prepared(graph, root).join(parts.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).drop("_i")
    counted = ~F.col("is_test") & ~F.col("name").startswith("test_") & (F.col("kind") != "Module")
    order = F.struct("ord", "file", "line", "column", "name", "rel")
    kept = s.groupBy("component").agg(F.count_if(counted).alias("n"), F.bool_or("excluded").alias("rooted"), F.bool_and("is_test").alias("tests")).filter("n >= 2 AND NOT rooted AND NOT tests")
    # only members of components that are found are collected
    groups = s.join(kept.select(F.col("component").alias("_k"), "n"), F.col("component") == F.col("_k")).groupBy("component").agg(
        F.first("n").alias("n"), F.min(order).alias("first"), F.array_sort(F.collect_list(F.when(counted & ~F.col("excluded"), order))).alias("members"),
    )
    inner = used_edges(graph).join(parts.withColumnRenamed("id", "_i").withColumnRenamed("component", "_c"), F.col("src") == F.col("_i")).groupBy("_c").agg(F.count("*").alias("n_edges"))
    g = groups.join(inner, F.col("component") == F.col("_c"))
    g = g.withColumns({"names": F.array_join(F.transform("members", lambda m: m["name"]), ", "), "rel": F.col("first.rel"), "line": F.col("first.line"), "column": F.col("first.column")})
    g = _with_file_count(g, graph)
    return _found(
        g, "isolated_cluster", "warning", "high", F.col("names"), _text("%d symbols with %d references among themselves have no caller outside", "n", "n_edges"),
        _evidence((_text("no outside caller in %d analyzed files", "n_files"), _text("%s:%d", "rel", "line")), (_text("%d inner references among %d symbols", "n_edges", "n"), None, _text("members: %s", "names"))),
        F.lit("Call one of these symbols from the rest of the code, or remove them all."),
    )


def file_edges(graph: CodeGraph) -> DataFrame:
    """(src, dst, n): Calls and References between two different files, by file."""
    f = graph.symbols.select("id", "file")
    e = used_edges(graph).join(f.select(F.col("id").alias("_s"), F.col("file").alias("a")), F.col("src") == F.col("_s")).join(f.select(F.col("id").alias("_d"), F.col("file").alias("b")), F.col("dst") == F.col("_d"))
    return e.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"))


def file_cycles(graph: CodeGraph) -> DataFrame:
    """(cycle array<string>): different cycles of two or more files, the least file first."""
    found = back_edge_cycles(file_edges(graph).select("src", "dst", F.lit(0).alias("o")), least=2)
    return found.select(canonical(F.col("cycle")).alias("cycle")).distinct()


def circular_dependency(graph: CodeGraph, root: str = "") -> DataFrame:
    """Cycles of files that depend on each other; each step shows its first reference."""
    cycles = Scratch(graph.symbols.sparkSession, "cycles").write(file_cycles(graph).withColumn("key", F.monotonically_increasing_id()))
    # there may be many steps to a cycle, whose own size tells the planner nothing of theirs: they are merged, never sent to the driver
    ahead = F.concat(F.slice("cycle", 2, F.size("cycle")), F.slice("cycle", 1, 1))
    steps = cycles.select("key", F.posexplode(F.arrays_zip(F.col("cycle").alias("a"), ahead.alias("b"))).alias("k", "x")).select("key", "k", "x.a", "x.b").hint("merge")
    f = graph.symbols.select("id", "file", "name", "line")
    e = used_edges(graph).join(f.select(F.col("id").alias("_s"), F.col("file").alias("_a"), F.col("name").alias("_an"), F.col("line").alias("_al")), F.col("src") == F.col("_s"))
    e = e.join(f.select(F.col("id").alias("_d"), F.col("file").alias("_b"), F.col("name").alias("_bn")), F.col("dst") == F.col("_d")).filter("_a <> _b")
    first = e.groupBy("_a", "_b").agg(F.min(F.struct("_al", "_an", "_bn", "edge_kind")).alias("r"))
    met = steps.join(first, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    rel = lambda c: paths.relative_path(F.col(c), root)
    item = F.struct(
        F.col("k"), _text("%s -> %s: %s uses %s", rel("a"), rel("b"), "r._an", "r._bn").alias("observation"), _text("%s:%d", rel("a"), "r._al").alias("location"), _text("edge %s", "r.edge_kind").alias("context")
    )
    g = met.groupBy(F.col("key").alias("_k")).agg(F.array_sort(F.collect_list(item)).alias("items")).hint("merge").join(cycles, F.col("_k") == F.col("key"))
    g = g.withColumns({"rel": paths.relative_path(F.get("cycle", F.lit(0)), root), "line": F.lit(1), "column": F.lit(1), "names": F.array_join(F.transform("cycle", lambda p: paths.relative_path(p, root)), ", ")})
    return _found(
        g, "circular_dependency", "warning", "high", F.col("names"), _text("%d files depend on each other in a circle: %s", F.size("cycle"), "names"),
        F.transform("items", lambda i: F.struct(i["observation"].alias("observation"), i["location"].alias("location"), i["context"].alias("context"))),
        F.lit("Break the circle by moving what both sides need to a file of its own."),
    )


def missing_reexport(graph: CodeGraph, root: str = "") -> DataFrame:
    """Public definitions of a package's files that its parent file (__init__.py or mod.rs) does not import."""
    s = prepared(graph, root).withColumns({"base": paths.base_name(F.col("file")), "dir": paths.parent_dir(F.col("file"))})
    parents = s.filter(F.col("base").isin("__init__.py", "mod.rs")).select(F.col("file").alias("parent"), F.col("dir").alias("_dir"), F.col("rel").alias("parent_rel")).distinct()
    imports = s.filter("is_import").select(F.col("file").alias("_f"), F.col("name").alias("_n")).distinct()
    own = s.filter(~F.col("base").isin("__init__.py", "mod.rs") & (F.col("visibility") == "Public") & ~F.col("kind").isin("Module", "Method") & ~F.col("is_import"))
    own = own.join(imports, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")), "left_anti")
    first = Window.partitionBy("file", "name").orderBy("ord", "line", "column", "id")
    own = own.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    met = own.join(parents, F.col("dir") == F.col("_dir"))
    met = met.join(imports, (F.col("parent") == F.col("_f")) & (F.col("name") == F.col("_n")), "left_anti")
    return _found(
        met, "missing_reexport", "info", "moderate", F.col("qualified_name"), _text("'%s' of %s is public but %s does not pass it on", "name", "rel", "parent_rel"),
        _evidence((_text("%s imports no '%s'", "parent_rel", "name"), _text("%s:%d", "rel", "line"), _text("parent %s, part %s", "parent_rel", "rel"))),
        _text("Import '%s' in %s, or make it private.", "name", "parent_rel"),
    )


def layer_violation(graph: CodeGraph, root: str = "", compat: bool = False) -> DataFrame:
    """Edges that lead straight from the API layer to the data layer; compat judges whole paths instead of those below root."""
    s = prepared(graph, root).withColumn("layer", paths.layer(F.col("file") if compat else F.col("rel")))
    a = s.filter("layer = 'API' AND NOT is_test AND NOT excluded").drop("column").withColumn("column", F.col("line") * 0 + 1)
    b = s.filter("layer = 'Data' AND NOT is_test").select(F.col("id").alias("_t"), F.col("name").alias("t_name"), F.col("rel").alias("t_rel"), F.col("line").alias("t_line"))
    pairs = used_edges(graph).select("src", "dst").distinct()
    met = pairs.join(a, F.col("src") == F.col("id")).join(b, F.col("dst") == F.col("_t"))
    return _found(
        met, "layer_violation", "warning", "moderate", F.col("qualified_name"), _text("'%s' of the API layer uses '%s' of the data layer directly", "name", "t_name"),
        _evidence((_text("%s refers to %s", "rel", "t_rel"), _text("%s:%d", "rel", "line"), _text("API layer, to data layer at %s:%d", "t_rel", "t_line"))),
        _text("Reach '%s' through the service layer.", "t_name"),
    )


def stale_reference(graph: CodeGraph, root: str = "") -> DataFrame:
    """Imports whose module is known but has no such symbol (high), or that resolve to nothing in known code (moderate)."""
    s = prepared(graph, root).filter(F.col("is_import") & ~F.col("name").startswith("*")).withColumn("module", paths.annotation_value(F.col("annotations"), "from:"))
    stems = graph.symbols.select(paths.file_stem(F.col("file")).alias("_stem")).distinct()
    missing = s.filter((F.col("resolution") == "Partial") & (F.col("resolution_info") == "module resolved, symbol not found")).withColumn("conf", F.lit("high"))
    dangling = s.filter((F.col("resolution") == "Unresolved") & F.col("module").isNotNull())
    near = dangling.filter(F.col("module").startswith(".")).unionByName(dangling.filter(~F.col("module").startswith(".")).join(stems, F.col("module") == F.col("_stem"), "left_semi")).withColumn("conf", F.lit("moderate"))
    both = missing.unionByName(near)
    return _found(
        both, "stale_reference", "warning", F.col("conf"), F.col("name"), F.when(F.col("conf") == "high", _text("import '%s': its module no longer has it", "name")).otherwise(_text("import '%s' leads nowhere", "name")),
        _evidence((_text("'%s' from '%s' was not found", "name", F.coalesce("module", F.lit("?"))), _text("%s:%d", "rel", "line"), F.lit("renamed or removed"))),
        _text("Correct the import of '%s' or remove it.", "name"),
    )


def signed(graph: CodeGraph, root: str) -> DataFrame:
    s = prepared(graph, root).filter(F.col("kind").isin(*CALLABLE) & (F.col("signature") != ""))
    s = s.withColumn("params", paths.parameters(F.col("signature")))
    return s.withColumn("names", F.transform("params", paths.parameter_name))


def decorator_mismatch(graph: CodeGraph, root: str = "") -> DataFrame:
    """Static methods that take self, class methods that do not take cls, properties with parameters."""
    s = signed(graph, root).withColumn("first", F.get("names", F.lit(0)))
    has = lambda a: F.coalesce(F.array_contains("annotations", a), F.lit(False))
    extra = F.exists("names", lambda n: n != "self")
    cases = F.array(
        F.when(has("staticmethod") & (F.col("first") == "self"), F.struct(F.lit("staticmethod").alias("d"), F.lit("critical").alias("s"), F.lit("takes self").alias("w"))),
        F.when(has("classmethod") & ~F.col("first").isin("cls", "klass", "class_", "mcls"), F.struct(F.lit("classmethod").alias("d"), F.lit("critical").alias("s"), F.lit("does not take its class first").alias("w"))),
        F.when(has("property") & extra, F.struct(F.lit("property").alias("d"), F.lit("warning").alias("s"), F.lit("takes parameters besides self").alias("w"))),
    )
    met = s.withColumn("case", F.explode(F.filter(cases, lambda c: c.isNotNull())))
    return _found(
        met, "contract_mismatch", F.col("case.s"), "high", F.col("name"), _text("@%s '%s' %s", "case.d", "name", "case.w"),
        _evidence((_text("signature: %s", "signature"), _text("%s:%d", "rel", "line"), _text("decorator @%s", "case.d"))), _text("Change the parameters of '%s' or its decorator.", "name"),
    )


def arity_groups(graph: CodeGraph, root: str = "") -> DataFrame:
    """(language, name, members) of functions that several definitions give different numbers of parameters."""
    s = signed(graph, root).withColumn("language", paths.contract_language(F.col("file"))).filter(
        F.col("language").isNotNull() & ~F.col("is_import") & ~(F.col("name").startswith("__") & F.col("name").endswith("__")) & ~F.col("name").startswith("test_")
    )
    s = s.filter(~F.exists("params", lambda p: p.startswith("*")))
    s = s.withColumn("arity", F.size("params"))
    item = F.struct("ord", "rel", "line", "column", "arity")
    g = s.groupBy("language", "name").agg(F.countDistinct("arity").alias("n"), F.countDistinct("file").alias("files"), F.array_sort(F.collect_list(item)).alias("members"))
    return g.filter("n > 1 AND NOT (language = 'rust' AND files > 1)")


def arity_mismatch(graph: CodeGraph, root: str = "") -> DataFrame:
    """Functions of one name and language whose definitions differ in their number of parameters."""
    g = arity_groups(graph, root).withColumn("f", F.get("members", F.lit(0)))
    g = g.withColumns({"rel": F.col("f.rel"), "line": F.col("f.line"), "column": F.col("f.column"), "each": F.array_join(F.transform("members", lambda m: F.format_string("%d at %s:%d", m["arity"], m["rel"], m["line"])), ", ")})
    return _found(
        g, "contract_mismatch", "warning", "moderate", F.col("name"), _text("definitions of '%s' differ in their number of parameters", "name"),
        _evidence((_text("parameters: %s", "each"), _text("%s:%d", "rel", "line"), F.lit("one name, several signatures"))), _text("Give all definitions of '%s' one signature, or different names.", "name"),
    )


def contract_mismatch(graph: CodeGraph, root: str = "") -> DataFrame:
    return decorator_mismatch(graph, root).unionByName(arity_mismatch(graph, root))


OLD = {"deprecated": "high", "legacy": "high", "old": "moderate", "sync": "moderate"}
NEW = ("new", "async")


def production_calls(graph: CodeGraph) -> DataFrame:
    """(caller, callee, c_name, c_ord) of different callers outside test files."""
    c = prepared(graph).filter("NOT is_test").select(F.col("id").alias("caller"), F.col("name").alias("c_name"), F.col("ord").alias("c_ord"))
    e = graph.calls().select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return e.join(c, "caller").distinct()


def _caller_counts(graph: CodeGraph) -> DataFrame:
    """(callee, n, who): callers outside tests and the names of the first SHOWN of them; a task holds no more than these of one callee."""
    calls = production_calls(graph)
    n = calls.groupBy("callee").agg(F.count("*").alias("n"))
    first = calls.withColumn("_k", F.row_number().over(Window.partitionBy("callee").orderBy("c_ord", "caller"))).filter(F.col("_k") <= SHOWN)
    who = first.groupBy(F.col("callee").alias("_w")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "c_name"))), lambda x: x["c_name"]), ", ").alias("who"))
    return n.join(who, F.col("callee") == F.col("_w")).select("callee", "n", "who")


def _same_place(a: str, b: str) -> Column:
    return paths.parent_dir(F.col(a)) == paths.parent_dir(F.col(b))  # one file is in one directory


def _callables(graph: CodeGraph, root: str) -> DataFrame:
    return prepared(graph, root).filter(F.col("kind").isin(*CALLABLE) & ~F.col("is_test") & (F.col("name") != "")).select("id", "name", "file", "rel", "line", "column", "ord")


def naming_candidates(graph: CodeGraph, root: str = "") -> DataFrame:
    """Callables by base name and side: old or new markers, and the bare name as a new side."""
    s = _callables(graph, root)
    marks = []
    for word, conf in OLD.items():
        marks += [(f"^{word}_(.+)$", "old", conf), (f"^(.+)_{word}$", "old", conf)]
    marks += [x for word in NEW for x in ((f"^{word}_(.+)$", "new", ""), (f"^(.+)_{word}$", "new", ""))]
    marks.append(("^(.+)$", "new", ""))
    each = [F.when(F.col("name").rlike(p), F.struct(F.regexp_extract("name", p, 1).alias("base"), F.lit(side).alias("side"), F.lit(conf).alias("conf"))) for p, side, conf in marks]
    return s.select("*", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("m")).select("*", "m.base", "m.side", "m.conf").drop("m")


def naming_pairs(graph: CodeGraph, root: str = "") -> DataFrame:
    """(old_*, new_*, conf): old and new forms of one base name in one file or directory, both with callers outside tests, neither calling the other."""
    c = naming_candidates(graph, root)
    side = lambda k: c.filter(F.col("side") == k).select("base", paths.parent_dir(F.col("file")).alias("dir"), *(F.col(x).alias(f"{k}_{x}") for x in ("id", "name", "rel", "line", "column", "ord")), *([F.col("conf")] if k == "old" else []))
    met = side("old").join(side("new"), ["base", "dir"]).filter("old_id <> new_id")
    # an unordered pair counts once, the surest old side first
    w = Window.partitionBy(F.least("old_id", "new_id"), F.greatest("old_id", "new_id")).orderBy(F.col("conf"), "old_ord", "old_id")
    met = met.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    calls = graph.callees().select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    for a, b in (("old_id", "new_id"), ("new_id", "old_id")):
        met = met.join(calls, (F.col(a) == F.col("_s")) & (F.col(b) == F.col("_d")), "left_anti")
    return _with_callers(met, graph)


def _with_callers(met: DataFrame, graph: CodeGraph) -> DataFrame:
    n = _caller_counts(graph)
    for k in ("old", "new"):
        met = met.join(n.select(F.col("callee").alias("_c"), F.col("n").alias(f"{k}_callers"), F.col("who").alias(f"{k}_who")), F.col(f"{k}_id") == F.col("_c")).drop("_c")
    return met


def _migration(met: DataFrame, conf: str | Column) -> DataFrame:
    met = met.withColumns({"rel": F.col("old_rel"), "line": F.col("old_line"), "column": F.col("old_column"), "total": F.col("old_callers") + F.col("new_callers")})
    show = lambda k, what: (_text(f"{what} form '%s' has %d callers: %s", f"{k}_name", f"{k}_callers", f"{k}_who"), _text("%s:%d", f"{k}_rel", f"{k}_line"), F.lit(f"{what} form in use"))
    return _found(
        met, "incomplete_migration", "warning", conf, _text("%s, %s", "old_name", "new_name"), _text("'%s' and '%s' are both in use; %d of %d callers use the old one", "old_name", "new_name", "old_callers", "total"),
        _evidence(show("old", "old"), show("new", "new")), _text("Move the callers %s from '%s' to '%s'.", "old_who", "old_name", "new_name"),
    )


def version_members(graph: CodeGraph, root: str = "") -> DataFrame:
    """Callables named <base>_v<number> (else the last _V<number>); version compares as a number of any length."""
    s = _callables(graph, root).filter(F.col("name").rlike("^.+_[vV][0-9]+$"))
    digits = F.regexp_replace(F.regexp_extract("name", r"_[vV]([0-9]+)$", 1), "^0+(?=.)", "")
    return s.withColumns({"base": F.regexp_extract("name", r"^(.+)_[vV][0-9]+$", 1), "version": F.struct(F.length(digits).alias("n"), digits.alias("digits"))})


def version_pairs(graph: CodeGraph, root: str = "") -> DataFrame:
    """(old_*, new_*): two versions of one base in one file or directory, both with callers outside tests.

    Bases of three or more members that share a caller are chains of migration steps and left out.
    """
    m = version_members(graph, root)
    sizes = m.groupBy("base").agg(F.count("*").alias("size"))
    shared = production_calls(graph).join(m.select(F.col("id").alias("callee"), "base"), "callee").groupBy("base", "caller").agg(F.countDistinct("callee").alias("k"))
    chains = shared.join(sizes, "base").filter("size >= 3 AND k = size").select("base").distinct()
    m = m.join(chains, "base", "left_anti")
    side = lambda k: m.select("base", paths.parent_dir(F.col("file")).alias("dir"), F.struct("version", "ord", "id").alias(f"{k}_o"), *(F.col(x).alias(f"{k}_{x}") for x in ("id", "name", "rel", "line", "column")))
    met = side("old").join(side("new"), ["base", "dir"]).filter("old_o < new_o")
    return _with_callers(met, graph)


def import_coexistence(graph: CodeGraph, root: str = "") -> DataFrame:
    """(rel, old_name, new_name, ...): modules that one file imports in an old-marked form and in the plain one; every pair of such imports counts."""
    s = prepared(graph, root).filter("is_import AND NOT is_test").withColumn("module", paths.annotation_value(F.col("annotations"), "from:")).filter("module IS NOT NULL")
    words = [w for w in OLD if w != "sync"]
    stripped = F.array(*(F.when(F.col("module").rlike(p), F.regexp_extract("module", p, 1)) for w in words for p in (f"^{w}_(.+)$", f"^(.+)_{w}$")))
    old = s.select("file", "rel", "line", "column", F.col("module").alias("old_name"), F.explode(F.filter(stripped, lambda x: x.isNotNull())).alias("plain"))
    new = s.select(F.col("file").alias("_f"), F.col("module").alias("new_name"), F.col("line").alias("new_line"))
    return old.join(new, (F.col("file") == F.col("_f")) & (F.col("plain") == F.col("new_name")))


def naming_migration(graph: CodeGraph, root: str = "") -> DataFrame:
    return _migration(naming_pairs(graph, root), F.col("conf"))


def version_migration(graph: CodeGraph, root: str = "") -> DataFrame:
    return _migration(version_pairs(graph, root), "moderate")


def import_migration(graph: CodeGraph, root: str = "") -> DataFrame:
    both = import_coexistence(graph, root)
    return _found(
        both, "incomplete_migration", "warning", "moderate", _text("%s, %s", "old_name", "new_name"), _text("one file imports both '%s' and '%s'", "old_name", "new_name"),
        _evidence((_text("'%s' imported", "old_name"), _text("%s:%d", "rel", "line"), F.lit("old form")), (_text("'%s' imported", "new_name"), _text("%s:%d", "rel", "new_line"), F.lit("new form"))),
        _text("Import '%s' only.", "new_name"),
    )


def incomplete_migration(graph: CodeGraph, root: str = "") -> DataFrame:
    """Old and new forms in use side by side: by name markers, by version numbers, and by imports."""
    return naming_migration(graph, root).unionByName(version_migration(graph, root)).unionByName(import_migration(graph, root))


def wiring(graph: CodeGraph, root: str = "") -> DataFrame:
    """Public callables with the files that call them, that refer to them by import, and the share that calls."""
    s = prepared(graph, root)
    target = s.filter(F.col("kind").isin(*CALLABLE) & F.col("visibility").isin("Public", "Crate") & ~F.col("excluded"))
    by = s.filter("NOT is_test").select(F.col("id").alias("_s"), F.col("file").alias("f"), F.col("rel").alias("f_rel"))
    e = graph.edges().filter("edge_kind = 'Calls' OR kind = 'Import'").join(by, F.col("src") == F.col("_s")).select("dst", "edge_kind", "f", "f_rel")
    met = e.join(target.select(F.col("id").alias("dst"), F.col("file").alias("own")), "dst").filter("f <> own")
    g = met.groupBy("dst").agg(F.collect_set(F.when(F.col("edge_kind") == "Calls", F.col("f_rel"))).alias("callers"), F.collect_set(F.when(F.col("edge_kind") != "Calls", F.col("f_rel"))).alias("importers"))
    g = g.withColumns({"n_callers": F.size("callers").cast("long"), "n_total": F.size(F.array_union("callers", "importers")).cast("long"), "unwired": F.array_sort(F.array_except("importers", "callers"))})
    return target.join(g.withColumnRenamed("dst", "_g"), F.col("id") == F.col("_g")).withColumn("ratio", F.col("n_callers") / F.col("n_total"))


def partial_wiring(graph: CodeGraph, root: str = "") -> DataFrame:
    """Callables that three or more files import or call, but fewer than 80 % call."""
    w = wiring(graph, root).filter("n_total >= 3 AND n_callers >= 1 AND size(unwired) > 0 AND ratio < 0.8")
    return _found(
        w, "partial_wiring", "warning", F.when(F.col("ratio") < 0.5, "high").otherwise("moderate"), F.col("name"),
        _text("'%s' is called in %d of %d files that know it (%d%%)", "name", "n_callers", "n_total", F.floor(F.col("ratio") * 100).cast("int")),
        _evidence((_text("%d of %d files call it (%d%%)", "n_callers", "n_total", F.round(F.col("ratio") * 100).cast("int")), _text("%s:%d", "rel", "line"), _text("imported without a call in: %s", F.array_join("unwired", ", ")))),
        _text("Call '%s' in %s, or drop those imports.", "name", F.array_join("unwired", ", ")),
    )


def _none(pattern: str) -> Callable[[CodeGraph, str], DataFrame]:
    """Patterns whose name is known but which find nothing."""

    def detect(graph: CodeGraph, root: str = "") -> DataFrame:
        return graph.symbols.sparkSession.createDataFrame([], schemas.DIAGNOSTICS).withColumn("pattern", F.lit(pattern))

    return detect


REGISTRY: dict[str, Callable[[CodeGraph, str], DataFrame]] = {
    "isolated_cluster": isolated_cluster, "data_dead_end": dead_end, "phantom_dependency": phantom_dependency, "circular_dependency": circular_dependency, "orphaned_impl": orphaned_impl,
    "missing_reexport": missing_reexport, "layer_violation": layer_violation, "stale_reference": stale_reference, "contract_mismatch": contract_mismatch, "incomplete_migration": incomplete_migration,
    "partial_wiring": partial_wiring, "duplication": _none("duplication"), "asymmetric_handling": _none("asymmetric_handling"),
}


#: Findings stand in order of their detectors and of these columns.
ORDER = ("file", "line", "column", "entity", "message", "confidence", "loc")


def _in_order() -> list[Column]:
    return [schemas.rank(F.col("pattern"), schemas.PATTERNS), *(F.col(c) for c in ORDER)]


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("id", F.format_string("D%03d", F.col("_no") + 1)).drop("_no")


#: Detectors that findings() runs in parts, which together find the same.
PARTS = {"incomplete_migration": (naming_migration, version_migration, import_migration)}


def numbered(found: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Add ids D001, D002 and so on, in order of detector and place; rows are numbered by partition, not in one task."""
    return _named(number_rows(found, _in_order(), "_no", scratch))


def findings(
    graph: CodeGraph, scratch: Scratch, root: str = "", checks: list[str] | None = None, severity: str | None = None, confidence: str | None = None, columns: tuple[str, ...] = ()
) -> DataFrame:
    """Findings (or some columns of them) without ids, a table of `scratch` for each detector or part of one.

    Detectors run one after another: in one plan, the driver would hold the stages and broadcasts of all of them at once.
    """
    out = None
    for detect in (f for n in check_names(checks) or list(REGISTRY) for f in PARTS.get(n, (REGISTRY[n],))):
        found = at_least(detect(graph, root), severity, confidence)
        each = scratch.write(found.select(*columns) if columns else found)
        release(each.sparkSession)
        out = each if out is None else out.unionByName(each)
    return out


def diagnostics(
    graph: CodeGraph, root: str = "", checks: list[str] | None = None, severity: str | None = None, confidence: str | None = None
) -> DataFrame:
    """All detectors' findings, filtered by pattern and by least severity and confidence, then numbered."""
    own = Scratch(graph.symbols.sparkSession, "findings")
    return numbered(findings(graph, own, root, checks, severity, confidence), own)


def first_findings(graph: CodeGraph, n: int, root: str = "") -> DataFrame:
    """id and the columns of the order of the first n findings of diagnostics(), without numbering the rest."""
    own = Scratch(graph.symbols.sparkSession, "findings")
    first = findings(graph, own, root, columns=("pattern", *ORDER)).orderBy(*_in_order()).limit(n)
    return _named(first.withColumn("_no", F.row_number().over(Window.orderBy(*_in_order())) - 1))  # n rows


def at_least(found: DataFrame, severity: str | None = None, confidence: str | None = None, checks: list[str] | None = None) -> DataFrame:
    """Findings at or above a severity and a confidence, of some patterns; unknown level names count as the lowest."""
    for column, ordered, least in (("severity", schemas.SEVERITIES, severity), ("confidence", schemas.CONFIDENCES, confidence)):
        if least:
            found = found.filter(schemas.rank(F.col(column), ordered) >= (ordered.index(least) if least in ordered else 0))
    names = [c for c in checks or [] if c]
    return found.filter(F.col("pattern").isin(names)) if names else found


def check_names(checks: list[str] | None) -> list[str]:
    """Valid, different pattern names; empty strings are ignored."""
    names = [c for c in checks or [] if c]
    for c in names:
        if c not in REGISTRY:
            raise ValueError(f"unknown pattern {c!r}; known: {', '.join(REGISTRY)}")
    return list(dict.fromkeys(names))
