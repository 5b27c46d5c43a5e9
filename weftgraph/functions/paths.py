"""Column predicates on file paths and symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Test files by name, or below a __tests__ folder; a tests/ folder alone does not count.
TEST_PATH = r"(^|/)(test_|conftest)[^/]*$|(_tests?\.(py|rs)|\.(test|spec)\.(js|ts|jsx|tsx))$|(^|/)__tests__/.+"
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust"}
LAYERS = {
    "API": ("api", "handler", "handlers", "route", "routes", "view", "views", "endpoint", "endpoints", "controller", "controllers"),
    "Service": ("service", "services", "business", "logic", "usecase", "usecases"),
    "Data": ("db", "database", "repo", "repository", "model", "models", "dal"),
}


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_test_path(path: Column) -> Column:
    return slashed(path).rlike(TEST_PATH)


def is_import(annotations: Column) -> Column:
    return F.coalesce(F.array_contains(annotations, "import"), F.lit(False))


def is_excluded(name: Column, file: Column, annotations: Column) -> Column:
    """Roots and imports, which no detector of unused definitions reports."""
    marked = F.coalesce(F.arrays_overlap(annotations, F.array(F.lit("entry_point"), F.lit("import"))), F.lit(False))
    dunder = name.startswith("__") & name.endswith("__")
    root = name.isin("main", "__main__", "if_name_main") | name.startswith("main_") | name.endswith("_main")
    return marked | dunder | name.startswith("test_") | is_test_path(file) | root


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def parent_dir(path: Column) -> Column:
    """Text before the last slash; empty without one."""
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)


def relative_path(path: Column, root: str) -> Column:
    """Path below root; the file name if nothing is left; the path itself outside root."""
    root = root.rstrip("/")
    if not root:
        return path
    inside = F.when(path == root, F.lit("")).when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)
    return F.when(inside == "", base_name(path)).otherwise(inside)


def layer(path: Column) -> Column:
    """Architecture layer named by the first directory that names one; null without."""
    parts = F.split(F.lower(slashed(path)), "/")
    names = {n: k for k, v in LAYERS.items() for n in v}
    known = F.array(*(F.lit(n) for n in names))
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    first = F.get(F.filter(inner, lambda p: F.array_contains(known, p)), F.lit(0))
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), first)


def language_of(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


def contract_language(path: Column) -> Column:
    """Language family of a path for comparing signatures; null when unknown."""
    ext = extension(path)
    return F.when(ext == "py", "python").when(ext == "rs", "rust").when(ext.isin("js", "jsx", "mjs", "cjs", "ts", "tsx"), "javascript")


def annotation_value(annotations: Column, prefix: str) -> Column:
    """Text after the first annotation with a prefix; null without one."""
    found = F.get(F.filter(annotations, lambda a: a.startswith(prefix)), F.lit(0))
    return F.substr(found, F.lit(len(prefix) + 1))


def parameters(signature: Column) -> Column:
    """array<string>: the parameters between the first parenthesis and its match, cut at commas outside () and [].

    Null without a signature; an unclosed parenthesis runs to the end.
    """
    chars = F.split(F.regexp_extract(signature, r"(?s)^[^(]*\((.*)$", 1), "")
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("square"), F.lit(False).alias("done"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out")
    )

    def step(acc: Column, c: Column) -> Column:
        def state(depth=acc["depth"], square=acc["square"], done=acc["done"], now=acc["now"], out=acc["out"]) -> Column:
            return F.struct(depth.alias("depth"), square.alias("square"), done.alias("done"), now.alias("now"), out.alias("out"))

        longer = F.concat(acc["now"], c)
        inner = (acc["depth"] == 0) & (acc["square"] == 0)
        return (
            F.when(acc["done"], state())
            .when((c == ")") & (acc["depth"] == 0), state(done=F.lit(True)))
            .when((c == ",") & inner, state(now=F.lit(""), out=F.concat(acc["out"], F.array(acc["now"]))))
            .when(c == "(", state(depth=acc["depth"] + 1, now=longer))
            .when(c == ")", state(depth=acc["depth"] - 1, now=longer))
            .when(c == "[", state(square=acc["square"] + 1, now=longer))
            .when(c == "]", state(square=acc["square"] - 1, now=longer))
            .otherwise(state(now=longer))
        )

    parts = F.aggregate(chars, zero, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))
    return F.when(signature.isNotNull(), F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != ""))


def parameter_name(parameter: Column) -> Column:
    """Text before the type mark, or else before the default."""
    cut = F.when(F.contains(parameter, F.lit(":")), F.split_part(parameter, F.lit(":"), F.lit(1))).otherwise(F.split_part(parameter, F.lit("="), F.lit(1)))
    return F.trim(cut)
