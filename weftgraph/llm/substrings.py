"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. Two equal windows hold equal
ANCHOR-word grams, so they have the same least gram hash: it serves as the window's fingerprint, and a
document has only about one different fingerprint for every six words.

Index: each batch of documents gives one immutable run, sorted and bucketed by fingerprint, with a row
per fingerprint. A new batch is merge-joined with every run; a fingerprint met in two
different texts, or in a window that its document repeats, is a hit. Runs of a level are compacted into one
of the next level as soon as there are FANOUT of them. An index with a path outlives its session: a manifest there lists the
runs by level and the summaries of the documents, and the next batch opens it again.

Verification: the windows behind hits are compared by digests of their very words (64 bits beside the
fingerprint's 64), runs of windows with one fingerprint at a time where all such runs are equal, and each
word covered by a window that starts earlier elsewhere is removed. Documents whose whole
word sequence an earlier document has are removed as a whole and do not enter verification.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.words import Words, canonical, chunks
from weftgraph.llm.tasks import tidy
from weftgraph.runtime import Scratch, cut, release, shared_dir, ship_package

WINDOW, ANCHOR = 20, 10
BATCHES, FANOUT = 3, 2


def window_fingerprints(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, fingerprint) of every window."""
    n = len(w.starts) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    grams = np.full(len(w.starts), np.iinfo(np.uint64).max, dtype=np.uint64)
    at, h = w.windows(anchor)
    grams[at] = h
    least, width, span = grams, 1, window - anchor + 1
    while 2 * width <= span:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    first = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    return first, least[first]


def summarise(df: DataFrame) -> DataFrame:
    """(_id, key, n_words, prints, again) of each row: digest of its words, fingerprints, and which of them stand for a window that it repeats."""
    schema = T.StructType([df.schema["_id"], *T.StructType.fromDDL("key binary, n_words long, prints array<long>, again array<boolean>").fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [canonical(v) for v in part.column("_text").to_pylist()]
                sizes, prints, again = np.zeros(len(texts), dtype=np.int64), [None] * len(texts), [None] * len(texts)
                for at, some in chunks(texts):
                    w = Words(some)
                    sizes[at : at + len(some)] = w.counts
                    first, f = window_fingerprints(w)
                    whole = w.spans(first, first + WINDOW - 1)
                    ends = np.searchsorted(w.doc[first], np.arange(len(some) + 1)) if len(first) else np.zeros(len(some) + 1, dtype=np.int64)
                    for i in range(len(some)):
                        a, b = ends[i], ends[i + 1]
                        u = np.unique(f[a:b])
                        flags = np.zeros(len(u), dtype=bool)
                        order = np.argsort(whole[a:b], kind="stable")
                        same = np.flatnonzero(whole[a:b][order][1:] == whole[a:b][order][:-1])
                        if len(same):
                            flags[np.searchsorted(u, f[a:b][order][same])] = True
                        prints[at + i], again[at + i] = u.view(np.int64), flags
                cols = [part.column("_id"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array(sizes), pa.array(prints, pa.list_(pa.int64())), pa.array(again, pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "key", "n_words", "prints", "again"])

    return df.mapInArrow(run, schema)


class FingerprintIndex:
    """Sorted immutable runs in levels; rows: (print, low, high, again), low and high being the least and largest text digest.

    With a path (in a store that all machines share) the index lasts: opened again, it goes on where it was saved. Without one it lies in a
    folder of its own until drop(). generation counts the saved batches.
    """

    RUN = "print BIGINT, low BIGINT, high BIGINT, again BOOLEAN"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.lasting = spark, fanout, path is not None
        self.root = path.rstrip("/") if path else f"{shared_dir(spark)}/weft-index-{uuid.uuid4().hex}"
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self._replaced: list[str] = []
        self.summaries: list[str] = []
        if self.lasting and (saved := self._saved()):
            self.buckets, self.levels, self.summaries = saved["buckets"], saved["levels"], saved["summaries"]
            for name in (r for level in self.levels for r in level):
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} ({self.RUN}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    @property
    def generation(self) -> int:
        return len(self.summaries)

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _saved(self) -> dict | None:
        p, fs = self._at("manifest.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def save(self, summaries: DataFrame) -> None:
        """Keep the summaries of a batch and write the manifest; it is written beside the old one first. Runs that compaction replaced go last."""
        name = f"summaries-{uuid.uuid4().hex}"
        summaries.write.parquet(f"{self.root}/{name}")
        self.summaries.append(name)
        new, fs = self._at("manifest.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "levels": self.levels, "summaries": self.summaries}).encode()))
        stream.close()
        old, _ = self._at("manifest.json")
        fs.delete(old, False)
        if not fs.rename(new, old):
            raise OSError(f"{self.root}/manifest.json could not be written")
        for gone in self._replaced:
            self._drop(gone)
        self._replaced = []

    def known(self) -> DataFrame | None:
        """Summaries of all earlier batches."""
        return self.spark.read.parquet(*(f"{self.root}/{n}" for n in self.summaries)) if self.summaries else None

    def _write(self, rows: DataFrame) -> str:
        name = f"weft_run_{uuid.uuid4().hex}"
        ordered = rows.repartition(self.buckets, "print").sortWithinPartitions("print")
        ordered.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        p, fs = self._at(name)
        fs.delete(p, True)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("print").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("again").alias("again"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Store a batch (print, text, again) as a run and give the fingerprints that are hits with it."""
        new = self._summed(batch.select("print", F.col("text").alias("low"), F.col("text").alias("high"), "again"))
        name = self._write(new)
        new = self.spark.table(name)
        met = new.select("print", "low", "high", "again")
        for old in [r for level in self.levels for r in level]:
            run = self.spark.table(old).select(F.col("print").alias("_p"), F.col("low").alias("_l"), F.col("high").alias("_h"))
            met = met.join(run, F.col("print") == F.col("_p"), "left")
            met = met.select("print", F.least("low", "_l").alias("low"), F.greatest("high", "_h").alias("high"), "again")
        hits = cut(met.filter((F.col("low") != F.col("high")) | F.col("again")).select("print"))
        self._push(name, 0)
        return hits

    def _push(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            rows = self.spark.table(old[0])
            for r in old[1:]:
                rows = rows.union(self.spark.table(r))
            merged = self._write(self._summed(rows))
            for r in old:
                if self.lasting:  # the manifest names it until the next save
                    self._replaced.append(r)
                else:
                    self._drop(r)
            self._push(merged, level + 1)

    def drop(self) -> None:
        for name in [r for level in self.levels for r in level]:
            self._drop(name)
        self.levels = []


def _stretches(df: DataFrame) -> DataFrame:
    """(print, digest, _id, start, n, windows, again): runs of n windows with one fingerprint among `prints`.

    digest and windows (packed) are 64-bit digests of the run's and of each window's very words; with the
    fingerprint they make 128 bits. Windows that stand earlier in the same text are left out; again, on the
    first row of a text, has their starts.
    """
    fields = T.StructType.fromDDL("print long, digest long").fields
    schema = T.StructType([*fields, df.schema["_id"], *T.StructType.fromDDL("start int, n int, windows binary, again array<int>").fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [canonical(v) for v in part.column("_text").to_pylist()]
                ids, prints = part.column("_id"), part.column("prints")
                for at, some in chunks(texts):
                    w = Words(some)
                    first, f = window_fingerprints(w)
                    docs = w.doc[first]
                    ends = np.searchsorted(docs, np.arange(len(some) + 1))
                    keep = np.zeros(len(first), dtype=bool)
                    for i in range(len(some)):
                        a, b = ends[i], ends[i + 1]
                        if b > a:
                            keep[a:b] = np.isin(f[a:b], prints[at + i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    got, kind, doc = first[keep], f[keep], docs[keep]
                    if not len(got):
                        continue
                    blob, one = w.blob, xxhash.xxh3_64_intdigest
                    starts, stops = w.starts[got], w.stops[got + WINDOW - 1]
                    digests = np.fromiter((one(blob[s:e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)), dtype=np.uint64, count=len(got))
                    place = (got - w.first[doc]).astype(np.int32)
                    order = np.lexsort((got, digests, doc))
                    same = (doc[order][1:] == doc[order][:-1]) & (digests[order][1:] == digests[order][:-1])
                    late = np.zeros(len(got), dtype=bool)
                    late[order[1:][same]] = True
                    # what a text repeats is late already: only its first windows meet other documents
                    repeats = {int(d): place[late & (doc == d)] for d in np.unique(doc[late])}
                    got, kind, doc, place, digests, starts, stops = (v[~late] for v in (got, kind, doc, place, digests, starts, stops))
                    heads = np.flatnonzero(np.concatenate([[True], (got[1:] != got[:-1] + 1) | (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])]))
                    tails = np.concatenate([heads[1:], [len(got)]])
                    whole = np.fromiter((one(blob[s:e]) for s, e in zip(starts[heads].tolist(), stops[tails - 1].tolist(), strict=True)), dtype=np.uint64, count=len(heads))
                    twice = [repeats.pop(d, None) for d in doc[heads].tolist()] if repeats else [None] * len(heads)
                    cols = [
                        pa.array(kind[heads].view(np.int64)), pa.array(whole.view(np.int64)), ids.take(pa.array(doc[heads] + at)), pa.array(place[heads]), pa.array((tails - heads).astype(np.int32)),
                        pa.array([digests[a:b].tobytes() for a, b in zip(heads.tolist(), tails.tolist(), strict=True)], pa.binary()), pa.array(twice, pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in schema.fields])

    return df.mapInArrow(run, schema)


def _unpacked(df: DataFrame) -> DataFrame:
    """(print, digest, _id, start, n) of the single windows of stretches."""
    schema = T.StructType([df.schema["print"], T.StructField("digest", T.LongType()), df.schema["_id"], *T.StructType.fromDDL("start int, n int").fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.column("n").to_numpy()
            rows = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            digests = np.frombuffer(b"".join(part.column("windows").to_pylist()), dtype=np.int64)
            take = pa.array(rows)
            start = (part.column("start").to_numpy()[rows] + inner).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("print").take(take), pa.array(digests), part.column("_id").take(take), pa.array(start), pa.array(np.ones(len(rows), dtype=np.int32))], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _later(rows: DataFrame) -> DataFrame:
    """rows with `late`: whether an earlier document has the same print and digest."""
    least = rows.groupBy("print", "digest").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    least = least.select(F.col("print").alias("_p"), F.col("digest").alias("_d"), "_least")
    met = rows.join(least, (F.col("print") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    return met.withColumn("late", F.coalesce(F.col("_id") > F.col("_least"), F.lit(False))).drop("_p", "_d", "_least")


def _covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words the runs of windows (start, number) cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] + WINDOW - 1, -1)
    return np.cumsum(edge)[:n] > 0


def _cleaned(df: DataFrame, columns: list[T.StructField]) -> DataFrame:
    names = [f.name for f in columns]
    schema = T.StructType([*columns, *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, removed, kept = [], [], []
                for text, starts, copies in zip(part.column("_text").to_pylist(), part.column("starts"), part.column("copies").to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n = len(words)
                    gone = np.zeros(n, dtype=bool)
                    if copies and n >= WINDOW and xxhash.xxh3_128_digest(b" ".join(words)) in copies:
                        gone[:] = True
                    elif starts.is_valid:
                        runs = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in starts.values.flatten()], axis=1)
                        gone = _covered(n, runs[runs.sum(axis=1) + WINDOW - 1 <= n])
                    sizes.append(n)
                    removed.append(int(gone.sum()))
                    left = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                cols = [*(part.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _placed(df: DataFrame, id_col: str, text: str, generation: int) -> DataFrame:
    """(_id, _text): the order of documents as a struct of batch, whether the id is null, and the id."""
    return df.select(F.struct(F.lit(generation).alias("b"), F.col(id_col).isNull().alias("o"), F.col(id_col).alias("i")).alias("_id"), F.col(text).alias("_text"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(id_col, n_words, n_removed, kept) of every row: words covered by a window that starts earlier elsewhere are removed.

    Earlier is a smaller id, or the same id and an earlier start; a null id comes after all others.
    Rows that share an id count as the same document, so equal rows do not remove each other. Null and empty texts have no
    words and keep an empty text; texts under WINDOW words stay whole. Windows are judged on the input. Other columns play no part.

    With a lasting index, df is the next batch: all documents of earlier calls come before it, whatever their ids; `history`
    has the same columns of these (they are read again where they share something with the batch), and the index is saved with the batch.
    """
    spark = df.sparkSession
    ship_package(spark)
    own = FingerprintIndex(spark) if index is None else index
    if own.generation and history is None:
        raise ValueError("the index knows earlier documents; they are asked for as `history`")
    scratch = Scratch(spark, "substrings")
    try:
        met = _marked(df, id_col, text, batches, own, history, scratch)
    except BaseException:
        scratch.drop_but()
        raise
    finally:
        if index is None:
            own.drop()
    return _cleaned(met, [met.schema["_id"]]).select(F.col("_id.i").alias(id_col), "n_words", "n_removed", "kept")


def _marked(df: DataFrame, id_col: str, text: str, batches: int, index: FingerprintIndex, history: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(_id, _text, starts, copies) of the rows of df: what _cleaned removes."""
    spark, now = df.sparkSession, index.generation
    docs = _placed(df, id_col, text, now)
    fresh = scratch.write(summarise(docs))
    known = index.known()
    marks = fresh if known is None else known.unionByName(fresh)
    # rows whose whole word sequence stands in an earlier document
    firsts = marks.filter(f"n_words >= {WINDOW}").groupBy("key").agg(F.min("_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_key"), "least")
    copies = marks.filter(f"n_words >= {WINDOW}").select("_id", "key").join(firsts, F.col("key") == F.col("_key")).filter(F.col("_id") > F.col("least"))
    copies = scratch.write(copies.select("_id", "key").distinct())
    # batches in order of ids
    cuts = [] if batches < 2 else sorted({r for r in fresh.select(F.percentile_approx("_id.i", [k / batches for k in range(1, batches)], 10_000)).first()[0] or []})
    hits, bounds, i = None, [None, *cuts, None], F.col("_id.i")
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = fresh
        if lo is not None:
            part = part.filter((i > lo) | i.isNull() if hi is None else i > lo)
        if hi is not None:
            part = part.filter(i <= hi)
        each = part.select("key", F.explode(F.arrays_zip("prints", "again")).alias("p"))
        found = index.add(each.select(F.col("p.prints").alias("print"), F.expr("conv(hex(left(key, 8)), 16, -10)").cast("long").alias("text"), F.col("p.again").alias("again")))
        hits = found if hits is None else hits.union(found)
    hits = scratch.write(hits.distinct().select(F.col("print").alias("_hit")))
    live = marks.join(copies.select(F.col("_id").alias("_c"), F.col("key").alias("_ck")), (F.col("_id") == F.col("_c")) & (F.col("key") == F.col("_ck")), "left_anti")
    behind = live.select("_id", F.explode("prints").alias("print")).join(hits, F.col("print") == F.col("_hit"), "left_semi")
    behind = scratch.write(behind.groupBy("_id").agg(F.collect_set("print").alias("prints")))
    if index.lasting:
        index.save(fresh)
    scratch.drop(fresh, hits)
    del live, marks, hits, found, each, part, firsts
    release(spark)
    need = behind.select(F.col("_id").alias("_b"), "prints")
    texts = docs.join(need, F.col("_id") == F.col("_b")).select("_id", "_text", "prints")
    if known is not None:
        old = history.select(F.col(id_col).alias("_i"), F.col(text).alias("_text"))
        texts = texts.unionByName(need.filter(F.col("_b.b") < now).join(old, F.col("_b.i").eqNullSafe(F.col("_i"))).select(F.col("_b").alias("_id"), "_text", "prints"))
    stretches = scratch.write(_stretches(texts))
    scratch.drop(behind)
    del need, behind, texts
    release(spark)
    # equal stretches settle all their windows; a fingerprint with different stretches is settled window by window
    whole = _later(stretches.select("print", "digest", "_id", "start", "n")).filter("late").select("_id", "start", "n")
    mixed = stretches.groupBy("print").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select(F.col("print").alias("_m"))
    single = scratch.write(_unpacked(stretches.join(mixed, F.col("print") == F.col("_m"), "left_semi").select("print", "_id", "start", "n", "windows")))
    late = whole.union(_later(single).filter("late").select("_id", "start", "n"))
    late = late.union(stretches.filter("again IS NOT NULL").select("_id", F.explode("again").alias("start"), F.lit(1).alias("n"))).filter(F.col("_id.b") == now)
    late = late.groupBy("_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    of_copies = copies.filter(F.col("_id.b") == now).groupBy("_id").agg(F.collect_set("key").alias("copies")).withColumnRenamed("_id", "_x")
    marked = late.join(of_copies, F.col("_id") == F.col("_x"), "full")
    marked = scratch.write(marked.select(F.coalesce("_id", "_x").alias("_m"), "starts", "copies"))
    scratch.drop(stretches, single, copies)
    del whole, mixed, single, stretches
    release(spark)
    return docs.join(marked, F.col("_id") == F.col("_m"), "left").select("_id", "_text", "starts", "copies")


def op4_fingerprint_index(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The same result for a few documents with different ids, by comparing all windows."""
    words = {i: (t or "").encode().split() for i, t in rows}
    seen: dict[tuple, tuple] = {}
    for i in sorted(words):
        for s in range(len(words[i]) - WINDOW + 1):
            seen.setdefault(tuple(words[i][s : s + WINDOW]), (i, s))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - WINDOW + 1):
            if seen[tuple(w[s : s + WINDOW])] != (i, s):
                gone[s : s + WINDOW] = [True] * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
