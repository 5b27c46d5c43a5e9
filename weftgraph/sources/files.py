"""Source trees as rows of schemas.FILES."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.sources import ignore

SCHEME = "^[a-z0-9]+:(//[^/]*)?"
#: Folders that hold no source of the project.
SKIPPED = ("target", "node_modules", "__pycache__", ".git", ".weftgraph", "build", "dist", ".venv", "venv")

#: Extensions of the known languages.
EXTENSIONS = ("py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "rs")


def _matches(regex: str):
    return lambda x: x.rlike(regex)


def excluded(rel: Column, patterns: list[str]) -> Column:
    """Whether a glob matches the whole relative path, the file name or any component."""
    out = F.lit(False)
    for p in (p.rstrip("/") for p in patterns):
        if p:
            regex = fnmatch.translate(p)
            out = out | rel.rlike(f"^{regex}") | (F.size(F.filter(F.split(rel, "/"), _matches(f"^{regex}"))) > 0)
    return out


def _listed(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below root, without scheme; the driver holds as many as the reader's own index."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(top).isFile():
        return [top.toUri().getPath()]
    found, each = [], fs.listFiles(top, True)
    while each.hasNext():
        found.append(each.next().getPath().toUri().getPath())
    return found


def _read(spark: SparkSession, root: str, path: str) -> bytes:
    """A small file, by the driver."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    stream = top.getFileSystem(spark._jsc.hadoopConfiguration()).open(jvm.org.apache.hadoop.fs.Path(path))
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _hidden(path: str, base: str) -> bool:
    """Whether Spark's readers pass over a file: its name or a folder's below base begins with a point or an underscore."""
    return any(p[:1] in "._" for p in path[len(base) :].split("/") if p)


def _contents(spark: SparkSession, root: str, found: list[str]) -> DataFrame:
    """(_path, content) of files that Spark's readers pass over: by executors where all machines see the same files, else by the driver."""
    kind = "_path string, content binary"
    scheme = re.match(r"^([a-z0-9]+):", root)
    if scheme and scheme[1] != "file":
        return spark.createDataFrame([(f, _read(spark, root, f)) for f in found], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError:  # unreadable files are left out
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["_path", "content"])

    return spark.createDataFrame([(f,) for f in found], "path string").mapInArrow(run, kind)


def ignore_rules(spark: SparkSession, root: str, listed: list[str], base: str) -> list[ignore.Rule]:
    """Rules of the user, of the repository's own exclude file, and of all ignore files below root, from the weakest to the strongest."""
    out = ignore.rules_of(ignore.user_rules())
    if f"{base}/.git/info/exclude" in listed:
        out += ignore.rules_of(_read(spark, root, f"{base}/.git/info/exclude").decode("utf-8", "replace"))
    files = [f for f in listed if f.endswith("/.gitignore") and f.startswith(base)]
    return out + ignore.ordered({f[len(base) + 1 :]: _read(spark, root, f).decode("utf-8", "replace") for f in files})


def source_files(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None, ignores: bool = True) -> DataFrame:
    """Files below root (or root itself) in a known language, outside skipped folders and not ignored; files that are not UTF-8 are left out.

    Names that begin with a point or an underscore count. A root without files gives no rows. ignores=False passes over ignore files.
    """
    full = F.regexp_replace("path", SCHEME, "")
    base = re.sub(SCHEME, "", root).rstrip("/")
    known = tuple(f".{e}" for e in EXTENSIONS)
    everything = _listed(spark, root)
    names = [f for f in everything if f.endswith(known)]
    hidden = [f for f in names if _hidden(f, base)]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(EXTENSIONS)}}}").load(root)
    # the reader passes over files without a byte, which may be packages all the same
    listed = spark.createDataFrame([(f,) for f in names], "path string")
    read = df.select(full.alias("_path"), "content")
    if hidden:
        read = read.unionByName(_contents(spark, root, hidden))
    df = listed.join(read, F.col("path") == F.col("_path"), "left")
    relative = paths.relative_path(F.col("path"), base)
    df = df.withColumn("rel_path", F.when(relative == "", paths.base_name(F.col("path"))).otherwise(relative)).withColumn("ext", paths.extension(F.col("path")))
    df = df.withColumn("language", paths.language_of(F.col("ext"))).filter(F.col("language").isNotNull())
    df = df.filter(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, SKIPPED))) & ~excluded(F.col("rel_path"), exclude or []))
    if ignores:
        df = df.filter(~ignore.ignored(F.col("rel_path"), ignore_rules(spark, root, everything, base)))
    if languages:
        df = df.filter(F.col("language").isin(*languages))
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))
    return df.filter(F.is_valid_utf8(text)).select("path", "rel_path", "ext", "language", text.alias("content"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n_bytes"))


def detected_languages(spark: SparkSession, root: str) -> list[str]:
    """The languages of the files below root, sorted."""
    return [r[0] for r in source_files(spark, root).select("language").distinct().orderBy("language").collect()]
