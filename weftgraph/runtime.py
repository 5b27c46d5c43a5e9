"""Session helpers: code shipping, durable lineage cuts and row numbering."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 2 << 20
FULL = 0.4


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    Texts may be long, so a session that does not say how many bytes an Arrow batch may have gets ARROW_BYTES: a worker and its executor hold
    a few batches each.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    if getattr(sc, "_weftgraph_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._weftgraph_shipped = True


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores appended until none is among the columns (whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session; any other one is refused, as its executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    if not getattr(sc, "_weftgraph_swept", False):
        _delete_at_exit(spark, sc.getCheckpointDir())  # this application's own folder below it
        sc._weftgraph_swept = True
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and ends the lineage.

    Its files go when the application ends, or sooner, by release(), where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables below the shared folder; drop() deletes them, and what is left goes when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
        self._n = 0
        _delete_at_exit(spark, self.root)

    def write(self, df: DataFrame, **sums: Column) -> DataFrame:
        """The rows, written and reread. The same job counts them (rows()) and computes further aggregates (seen())."""
        self._n += 1
        path, seen = f"{self.root}/t{self._n}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(v.alias(k) for k, v in sums.items())).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path, out._weft_seen = path, seen.get
        _breathe(self.spark)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the given tables."""
        for f in frames:
            p, fs = _path(self.spark, f._weft_path)
            fs.delete(p, True)

    def drop_but(self, *frames: DataFrame) -> None:
        """Delete all tables but the given ones."""
        kept = {f._weft_path for f in frames}
        if not kept:
            p, fs = _path(self.spark, self.root)
            fs.delete(p, True)
        for k in range(1, self._n + 1 if kept else 1):
            if f"{self.root}/t{k}" not in kept:
                p, fs = _path(self.spark, f"{self.root}/t{k}")
                fs.delete(p, True)


def _breathe(spark: SparkSession) -> None:
    """Collect the driver's garbage where its heap has grown beyond FULL of what it may have: plans of many small jobs would else fill it."""
    run = spark._jvm.java.lang.Runtime.getRuntime()
    if run.totalMemory() > FULL * run.maxMemory():
        spark._jvm.System.gc()


def rows(table: DataFrame) -> int:
    """Rows of a scratch table."""
    return table._weft_seen["n_rows"]


def seen(table: DataFrame, name: str):
    """An aggregate that was computed as a scratch table was written."""
    return table._weft_seen[name]


def release(spark: SparkSession) -> None:
    """Let the cluster delete shuffle files that no live frame needs (and checkpoints, see cut()); they go with their driver-side handles."""
    gc.collect()
    spark._jvm.System.gc()


def number_rows(df: DataFrame, order: list, name: str = "row_no", scratch: Scratch | None = None) -> DataFrame:
    """Add gapless numbers from 0 in the given order, without one task seeing all rows.

    Rows are range-partitioned and sorted, each gets its place within its partition,
    and the partitions' counts (one row per partition) give the offsets. The rows are a table of `scratch`, if given, else a checkpoint.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = (scratch.write if scratch else cut)(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = sorted((r["_pid"], r["n"]) for r in placed.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for pid, c in counts:
        offsets.append((pid, total))
        total += c
    bases = spark.createDataFrame(offsets, "_pid int, _base long") if offsets else spark.createDataFrame([], "_pid int, _base long")
    out = placed.join(F.broadcast(bases), "_pid").withColumn(name, F.col("_base") + F.col("_at")).drop("_pid", "_at", "_base")
    out._weft_total = total
    return out
