"""From parsed rows to a linked code graph: names within files, imports across files, calls through imports.

Rust's child modules are told by `::` keys, Python's by dotted ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import schemas
from weftgraph.functions import paths
from weftgraph.operators.graph import CodeGraph, edge_kind
from weftgraph.operators.intervals import nearest_imports
from weftgraph.runtime import cut
from weftgraph.sources.files import source_files
from weftgraph.sources.javascript_code import parse_scripts
from weftgraph.sources.python_code import parse_python
from weftgraph.sources.rust_code import parse_rust

SYMBOL = [c.split()[0] for c in schemas.SYMBOLS.split(", ")]
REF = [c.split()[0] for c in schemas.REFS.split(", ")]
MISSING, STAR = "module resolved, symbol not found", "star import - module resolved"


def _first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_k = 1").drop("_k")


def _named(symbols: DataFrame) -> DataFrame:
    """(_file, _name, _dst): of equal names in a file the first function, method or class, else the first symbol."""
    pick = [F.col("kind").isin("Function", "Method", "Class").cast("int").desc(), "ord"]
    return _first(symbols, ["file", "name"], pick).select(F.col("file").alias("_file"), F.col("name").alias("_name"), F.col("id").alias("_dst"))


def resolve_in_files(rows: DataFrame) -> CodeGraph:
    """Symbols, scopes and references of parsed rows, with names resolved within each file.

    self.m() means the method m of the caller's class, self.a.m() the method m of the class that the file's constructors give
    the attribute a; a plain name the file's first callable of that name; a use of an import the nearest one above it. Calls that resolve
    to nothing are dropped, other uses, imports and attribute types stay without a target.
    """
    symbols = rows.filter("row_kind = 'symbol'").select(*SYMBOL)
    refs = rows.filter("row_kind = 'ref'").withColumn("owned", F.col("arg").rlike("^(self|this)\\.[^.]+$"))
    methods = _first(symbols.filter("kind = 'Method'"), ["file", "name", "scope_id"], ["ord"]).select(F.col("file").alias("_file"), F.col("name").alias("_name"), F.col("scope_id").alias("_scope"), F.col("id").alias("_dst"))
    calls = refs.filter("tag = 'call'")
    own = calls.filter("owned").withColumn("m", F.split_part("arg", F.lit("."), F.lit(2)))
    own = own.join(methods, (F.col("file") == F.col("_file")) & (F.col("m") == F.col("_name")) & (F.col("class_scope") == F.col("_scope")))
    typed = refs.filter("tag = 'instance_attr_type'").select("file", F.regexp_extract("arg", r"\.([^.=]+)=", 1).alias("_attr"), F.regexp_extract("arg", "=(.*)$", 1).alias("_type"), "ord")
    typed = _first(typed, ["file", "_attr"], ["ord"]).select(F.col("file").alias("_tf"), "_attr", "_type")
    of_class = symbols.filter("kind = 'Method'").withColumn("_class", F.element_at(F.split("qualified_name", "::"), -2))
    of_class = _first(of_class, ["file", "_class", "name"], ["ord"]).select(F.col("file").alias("_file"), "_class", F.col("name").alias("_name"), F.col("id").alias("_dst"))
    held = calls.filter(F.col("arg").rlike("^(self|this)\\.[^.]+\\.[^.]+$")).withColumns({"a": F.split_part("arg", F.lit("."), F.lit(2)), "m": F.split_part("arg", F.lit("."), F.lit(3))})
    held = held.join(typed, (F.col("file") == F.col("_tf")) & (F.col("a") == F.col("_attr"))).join(of_class, (F.col("file") == F.col("_file")) & (F.col("_type") == F.col("_class")) & (F.col("m") == F.col("_name")))
    plain = calls.filter("NOT contains(arg, '.')").join(_named(symbols), (F.col("file") == F.col("_file")) & (F.col("arg") == F.col("_name")))
    other = refs.filter("tag IN ('import', 'instance_attr_type')").withColumn("_dst", F.lit(None).cast("string"))
    uses = nearest_imports(refs.filter("tag = 'attribute_access'").withColumn("name", F.col("arg")), symbols.filter(paths.is_import(F.col("annotations")))).withColumnRenamed("import_id", "_dst")
    out = [x.withColumn("dst", F.col("_dst")) for x in (own, held, plain, uses, other)]
    done = F.when(F.col("dst").isNotNull(), "Resolved").otherwise("Partial")
    found = [x.withColumns({"edge_kind": edge_kind(F.col("kind")), "resolution": done, "resolution_info": F.when(F.col("dst").isNull(), F.concat_ws(":", "tag", "arg"))}).select(*REF) for x in out]
    scopes = rows.filter("row_kind = 'scope'").select(*(c.split()[0] for c in schemas.SCOPES.split(", ")))
    spark = rows.sparkSession
    return CodeGraph(symbols, reduce(DataFrame.unionByName, found), scopes, spark.createDataFrame([], schemas.BOUNDARIES))


def _shared(f: DataFrame) -> DataFrame:
    """One row: the number n of leading folders that all rows' `dir` arrays have in common."""
    ends = f.agg(F.min("dir").alias("a"), F.max("dir").alias("b"))  # all folders lie between these two
    return ends.select(F.size(F.filter(F.transform(F.sequence(F.lit(0), F.size("a")), lambda i: F.when(F.slice("a", 1, i) == F.slice("b", 1, i), i)), lambda i: i.isNotNull())).alias("n"))


def _keyed(f: DataFrame, joint: str, rank: int) -> DataFrame:
    """(key, path, rank): path parts `p` without the folders that all rows share."""
    met = f.crossJoin(F.broadcast(_shared(f)))  # one row
    return met.select(F.array_join(F.slice("p", F.col("n"), F.size("p")), joint).alias("key"), F.col("rel_path").alias("path"), F.lit(rank).alias("rank"))


def python_keys(files: DataFrame) -> DataFrame:
    """Dotted paths without the folders that all Python files share; a package's file has the package's key."""
    package = paths.base_name(F.col("rel_path")) == "__init__.py"
    parts = F.split(F.regexp_replace("rel_path", r"(/?__init__)?\.py$", ""), "/")
    folder = F.when(package, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    return _keyed(files.filter("language = 'python'").select("rel_path", parts.alias("p"), folder.alias("dir")), ".", 0)


def script_keys(files: DataFrame) -> DataFrame:
    """Paths of JavaScript and TypeScript files without the folders that all of them share and without the last extension."""
    parts = F.split(F.regexp_replace("rel_path", r"\.[^./]*$", ""), "/")
    return _keyed(files.filter("language IN ('javascript', 'typescript')").select("rel_path", parts.alias("p"), F.slice(parts, 1, F.size(parts) - 1).alias("dir")), "/", 1)


def rust_keys(files: DataFrame) -> DataFrame:
    """`crate::` paths below the nearest folder with a lib.rs or main.rs; where no file has one, below the folders that all Rust files share."""
    f = files.filter("language = 'rust'").select("rel_path", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("folder"))
    roots = f.filter(paths.base_name(F.col("rel_path")).isin("lib.rs", "main.rs")).select(F.col("folder").alias("root")).distinct()
    # every folder above a file may be its root: an equi-join on these instead of a prefix comparison
    above = f.withColumn("parts", F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/")))
    above = above.select("rel_path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("depth", "above"))
    nearest = above.join(roots, F.col("above") == F.col("root")).groupBy("rel_path").agg(F.max_by("root", "depth").alias("root"))
    dirs = f.select(F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/")).alias("dir"), "rel_path")
    shared = dirs.crossJoin(F.broadcast(_shared(dirs))).crossJoin(F.broadcast(roots.agg(F.count("*").alias("roots")))).filter("roots = 0")
    fallback = shared.select("rel_path", F.array_join(F.slice("dir", 1, F.col("n") - 1), "/").alias("root"))
    rel = nearest.unionByName(fallback).withColumn("rest", F.when(F.col("root") == "", F.col("rel_path")).otherwise(F.expr("substring(rel_path, length(root) + 2)")))
    stem = F.regexp_replace("rest", r"\.rs$", "")
    inner = F.regexp_replace(F.regexp_replace(stem, r"(^|/)mod$", ""), "/", "::")
    key = F.when(stem.isin("lib", "main") | (inner == ""), "crate").otherwise(F.concat(F.lit("crate::"), inner))
    return rel.select(key.alias("key"), F.col("rel_path").alias("path"), F.lit(2).alias("rank"))


def module_map(files: DataFrame) -> DataFrame:
    """(key, path) of all files. Of equal keys the one of Rust goes before JavaScript's and that before Python's, then the last path."""
    keys = python_keys(files).unionByName(script_keys(files)).unionByName(rust_keys(files)).filter("key <> ''")
    return _first(keys, ["key"], [F.desc("rank"), F.desc("path")]).select("key", "path")


def normalized(parts: Column) -> Column:
    """Path parts without `.` and with each `..` taking one part away; at the top it takes nothing."""
    none = F.array().cast("array<string>")
    return F.aggregate(parts, none, lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))


def _rust_target(module: Column, own: Column) -> Column:
    """`self::` and `super::` (once) taken from the importing file's key."""
    path = F.when(module.startswith("self::super"), F.expr("substring(module, 7)")).otherwise(module)
    parent = F.when(own.contains("::"), F.regexp_replace(own, "::[^:]*$", "")).otherwise(F.lit("crate"))
    rest = F.regexp_replace(path, "^(self|super)::", "")
    return F.when(path.startswith("self::"), F.concat_ws("::", own, rest)).when(path == "super", parent).when(path.startswith("super::"), F.concat_ws("::", parent, rest)).otherwise(path)


def resolve_across_files(graph: CodeGraph, modules: DataFrame) -> CodeGraph:
    """Imports led to what they import, and each call of an import to its definition too. Doing it again adds nothing.

    What stands behind `from:` says how the module is found: a path from the importing file's folder (`./`, `../`; a file without its
    extension or the index file of a folder), a path of Rust (`crate::`, `self::`, `super::`), leading points of Python, and else a key of the
    module map, in Rust also one below the importing module.
    """
    s = graph.symbols
    value = lambda p: paths.annotation_value(F.col("annotations"), p)
    c = s.filter(paths.is_import(F.col("annotations")) & (F.col("resolution") != "Resolved")).withColumns({"module": value("from:"), "wanted": F.coalesce(value("original_name:"), F.col("name"))}).filter("module IS NOT NULL")
    own = modules.select(F.col("path").alias("_own"), F.col("key").alias("own_key"))
    c = c.join(own, F.col("file") == F.col("_own"), "left")
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    rest = F.regexp_replace("module", r"^\.+", "")
    up = F.size(F.split("own_key", "\\.")) - dots + (paths.base_name(F.col("file")) == "__init__.py").cast("int")
    base = F.array_join(F.slice(F.split("own_key", "\\."), 1, F.greatest(up, F.lit(0))), ".")
    relative = F.when(up >= 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))
    from_folder = F.col("module").rlike(r"^\.\.?/") | F.col("module").isin(".", "..") & ~F.col("file").endswith(".py")
    folder = F.split(F.regexp_replace("file", "[^/]*$", ""), "/")
    by_path = F.array_join(normalized(F.concat(folder, F.split("module", "/"))), "/")
    of_rust = F.col("module").rlike("^(crate|self|super)::") | F.col("module").isin("super", "self") & F.col("file").endswith(".rs")
    c = c.withColumns({"from_folder": from_folder, "below": F.when(F.col("file").endswith(".rs") & ~of_rust, F.concat_ws("::", "own_key", "module"))})
    target = F.when(from_folder, by_path).when(of_rust, _rust_target(F.col("module"), F.col("own_key"))).when((dots > 0) & F.col("file").endswith(".py"), relative).otherwise(F.col("module"))
    c = c.withColumn("target", target)
    keys = modules.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.lit(False).alias("_at_path"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    files = modules.select(stem.alias("_key"), F.col("path").alias("_path"), F.lit(True).alias("_at_path"))
    index = files.filter(F.col("_key").rlike("(^|/)index$")).withColumn("_key", F.regexp_replace("_key", "/?index$", ""))
    ways = keys.unionByName(files).unionByName(index)
    asked = c.select("id", F.col("target").alias("_t"), "from_folder", F.lit(0).alias("_k")).union(c.filter("below IS NOT NULL").select("id", "below", "from_folder", F.lit(1)))
    led = asked.join(ways, (F.col("_t") == F.col("_key")) & (F.col("from_folder") == F.col("_at_path")))
    led = led.groupBy("id").agg(F.min(F.struct("_k", "_path", "_t")).alias("m")).select(F.col("id").alias("_led"), F.col("m._path").alias("t_path"), F.col("m._t").alias("t_key"))
    c = c.join(led, F.col("id") == F.col("_led")).withColumn("target", F.col("t_key"))
    child = modules.select(F.col("key").alias("_child")).distinct()
    joint = F.when(F.col("file").endswith(".rs"), "::").when(F.col("file").endswith(".py"), ".")  # a module below the named one is no symbol of it
    below = F.concat(F.coalesce(F.concat(F.nullif("target", F.lit("")), joint), F.lit("")), F.col("wanted"))
    c = c.join(child, F.when(joint.isNotNull(), below) == F.col("_child"), "left")
    c = c.join(_named(s.filter("kind <> 'Module'")), (F.col("t_path") == F.col("_file")) & (F.col("wanted") == F.col("_name")), "left")
    star = F.col("name").startswith("*:")
    fine = F.col("_dst").isNotNull() | (F.col("wanted") == F.col("module")) | F.col("_child").isNotNull()
    c = cut(c.select("id", F.col("_dst").alias("def"), F.when(fine & ~star, "Resolved").otherwise("Partial").alias("_r"), F.when(star, STAR).when(~fine, MISSING).alias("_i")))
    known = c.select(F.col("id").alias("_id"), "_r", "_i")
    met = s.join(known, F.col("id") == F.col("_id"), "left").withColumns({"resolution_info": F.when(F.col("_id").isNotNull(), F.col("_i")).otherwise(F.col("resolution_info")), "resolution": F.coalesce("_r", "resolution")})
    symbols = met.select(*SYMBOL)
    place = s.select(F.col("id").alias("_p"), *schemas_place())
    to_def = c.filter("def IS NOT NULL").select("id", "def")
    links = to_def.join(place, F.col("id") == F.col("_p")).select(F.concat(F.lit("import:"), "id").alias("id"), F.col("id").alias("src"), F.col("def").alias("dst"), F.lit("Import").alias("kind"), *schemas_place())
    onward = graph.callees().join(to_def, F.col("dst") == F.col("id")).select("src", F.col("def").alias("dst"), F.col("id").alias("via"))
    fresh = onward.join(graph.callees().select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct(), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")
    calls = fresh.distinct().join(place, F.col("src") == F.col("_p")).select(F.concat(F.lit("through:"), "src", F.lit(">"), "via").alias("id"), "src", "dst", F.lit("Call").alias("kind"), *schemas_place())
    new = links.unionByName(calls).withColumns({"edge_kind": edge_kind(F.col("kind")), "resolution": F.lit("Resolved"), "resolution_info": F.lit(None).cast("string")}).select(*REF)
    return CodeGraph(symbols, graph.refs.unionByName(new), graph.scopes, graph.boundaries)


def schemas_place() -> list[str]:
    return [c.split()[0] for c in schemas.PLACE.split(", ")]


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of all files, each by the front-end of its language."""
    return parse_python(files).unionByName(parse_scripts(files)).unionByName(parse_rust(files))


def analyze_files(files: DataFrame) -> CodeGraph:
    """The linked graph of source files. Parsed rows are cut, for parsing is the dear step."""
    return resolve_across_files(resolve_in_files(cut(parse_files(files))), module_map(files))


def analyze_source(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None) -> CodeGraph:
    """The linked graph of the files below root in the given languages (default: all known ones)."""
    return analyze_files(source_files(spark, root, exclude, languages))


def analyze_python(spark: SparkSession, root: str, exclude: list[str] | None = None) -> CodeGraph:
    """The linked graph of the Python files below root."""
    return analyze_source(spark, root, exclude, ["python"])
