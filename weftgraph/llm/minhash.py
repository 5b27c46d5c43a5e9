"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. A fixed-size table of document counts by shingle hash is summed over the corpus.
2. Each text gets SAMPLES consistent weighted samples. Texts with the same words are one node.
3. Bands of ROWS samples give buckets. In a bucket of up to SMALL nodes every pair that agrees in
   AGREE of the samples is a candidate; in a larger one every node meets those of the bucket's PIVOTS (drawn by
   hash, so bands have different ones) that agree with it best.
4. Candidates are verified on whole shingle sets by weighted Jaccard similarity, first the best one of each node; pairs that a
   component already joins need no verification. Links become classes by star contraction.
5. Larger buckets that then still hold several components are settled exactly. All their nodes but those of the largest
   component, and those of its nodes that share a shingle with them, go through a prefix filter: each is put under its rarest
   shingles, as many as leave less than the threshold to all others, so that two similar texts share one of them for
   certain. These groups are searched like buckets first. Where one still holds several components, it is split by total
   weight (similar texts lie in the same or in neighbouring classes of WIDTH) and into salted blocks of BLOCK nodes and
   BLOCK_BYTES; every two blocks that can hold a similar pair meet in one task, which counts shared shingles.

A pair is linked where its weighted Jaccard similarity is at least the threshold. A shingle weighs its count in the text times
1 + SPREAD * idf, idf from 0 (in all texts) to 1 (in one). The spread is small on purpose: it keeps a very large group
of near copies, whose common shingles are frequent, from falling apart at its members' few edits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.tasks import tidy
from weftgraph.llm.words import Words, canonical, chunks, mix64
from weftgraph.operators.components import star_components
from weftgraph.runtime import Scratch, fresh, release, rows, ship_package

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Candidates of buckets agree in this share of their samples (at similarity 0.8 a pair falls below with a chance of 1e-5), those of prefix groups in the second.
AGREE, AGREE_PREFIX = 0.5, 1 / 3
SMALL, PIVOTS, BEST = 24, 8, 3
#: Nodes and shingle bytes of one block of a group (a larger node is a block of its own), and the ratio of total weights in one class (1 / threshold at least).
BLOCK, BLOCK_BYTES, WIDTH = 1024, 1 << 23, 1.2501
#: Bits of the filter of wanted ids or shingles for each of them, and at most (16 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: Counters of the document-count table, a fixed size, dealt in slices.
TABLE_BITS, SLICES = 20, 128
#: Weight of the rarest shingle is 1 + SPREAD times that of one found everywhere.
SPREAD = 0.25

_LOG = -np.log((np.arange(65536, dtype=np.float32) + 0.5) / 65536).astype(np.float32)


def shingles(texts: list[bytes], k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, 32-bit shingle hashes, shingles of each text) by chunks of canonical texts.

    A text of fewer than k words has one shingle of all its words; one without words has none.
    """
    for at, part in chunks(texts):
        w = Words(part)
        first, hashes = w.windows(k)
        docs = w.doc[first]
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(short):
            extra = w.spans(w.first[short], w.first[short + 1] - 1)
            docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, extra])
            order = np.argsort(docs, kind="stable")
            docs, hashes = docs[order], hashes[order]
        yield at, (hashes >> np.uint64(32)).astype(np.uint32), np.bincount(docs, minlength=len(part))


def _unique(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different shingles in order, how often each occurs, and their number by text."""
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = np.sort(doc << np.uint64(32) | hashes)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    tf = np.diff(np.concatenate([new, [len(key)]]))
    key = key[new]
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), tf, np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(counts))


class Idf:
    """Weights from the table of counts, less the counts that other shingles leave in a slot on average."""

    def __init__(self, table: np.ndarray, docs: int):
        self.n = max(2, docs)
        noise = table.sum() / len(table)
        df = np.clip(table - noise, 1, self.n)
        self.weight = (1 + SPREAD * np.log(self.n / df) / np.log(self.n)).astype(np.float32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.weight[hashes & np.uint32((1 << TABLE_BITS) - 1)]


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint32(seed)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    return h


def icws(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Consistent weighted samples of texts with at least one shingle: uint32[len(counts), samples].

    r and c are Gamma(2, 1), b uniform, all fixed by shingle and sample; with t = floor(ln w / r + b),
    the shingle of the least ln c - r (t - b + 1) is drawn. That least value names the pair (shingle, t).
    """
    out = np.empty((len(counts), samples), dtype=np.uint32)
    if not len(counts):
        return out
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    lnw = np.log(weights).astype(np.float32)
    m = np.uint32(0xFFFF)
    for d in range(samples):
        h = _mix(hashes, (d + 1) * 0x61C88647 & 0xFFFFFFFF)
        r = _LOG[h & m] + _LOG[h >> np.uint32(16)]
        h = _mix(h, 0x7FEB352D)
        lnc = np.log(_LOG[h & m] + _LOG[h >> np.uint32(16)])
        b = (_mix(h, 0x5851F42D) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(lnw / r + b)
        out[:, d] = np.minimum.reduceat(lnc - r * (t - b + 1), starts).view(np.uint32)
    return out


def similarity(a: bytes, b: bytes, idf: Idf) -> float:
    """Weighted Jaccard similarity of two packed shingle lists."""
    (x, nx), (y, ny) = (np.unique(np.frombuffer(v, dtype=np.uint32), return_counts=True) for v in (a, b))
    both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = float((idf(both) * np.minimum(nx[ix], ny[iy])).sum(dtype=np.float64))
    high = float((idf(x) * nx).sum(dtype=np.float64) + (idf(y) * ny).sum(dtype=np.float64)) - low
    return low / high if high else 0.0


def _of_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(texts, their different shingles)."""
    for at in range(0, len(column), 512):
        part = [canonical(v) for v in column.slice(at, 512).to_pylist()]
        found = [_unique(h, counts)[0] for _, h, counts in shingles(part)]
        yield len(part), np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def _of_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for v in column:
        yield 1, np.unique(np.frombuffer(v.as_buffer(), dtype=np.uint32))


def _count_table(texts: DataFrame, different) -> tuple[np.ndarray, int]:
    """Texts by shingle hash over all rows of one column, and the number of texts; the result's size is fixed.

    A partition hands on its counters other than zero, so what is shuffled follows the data where that is less than the table.
    """
    size, width = 1 << TABLE_BITS, (1 << TABLE_BITS) // SLICES

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs = np.zeros(size, dtype=np.int32), 0
        for batch in batches:
            for n, hashes in different(batch.column(0)):
                docs += n
                if len(hashes) > 1 << 15:
                    table += np.bincount(hashes & np.uint32(size - 1), minlength=size).astype(np.int32)
                else:
                    np.add.at(table, hashes & np.uint32(size - 1), 1)
        if docs:
            some = np.flatnonzero(table)
            ends = np.searchsorted(some, np.arange(SLICES + 1) * width)
            packed = [np.int64(docs).tobytes()]
            for k in range(SLICES):
                at = some[ends[k] : ends[k + 1]]
                packed.append(zlib.compress((at - k * width).astype(np.uint16).tobytes() + table[at].tobytes(), 1) if len(at) else None)
            full = [k for k, v in enumerate(packed) if v]
            yield pa.RecordBatch.from_arrays([pa.array([k - 1 for k in full], pa.int32()), pa.array([packed[k] for k in full], pa.binary())], names=["slice", "counts"])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k < 0:
                    sums[k] = sums.get(k, 0) + np.frombuffer(v.as_buffer(), dtype=np.int64)
                else:
                    raw = zlib.decompress(v.as_buffer())
                    n = len(raw) // 6
                    sums.setdefault(k, np.zeros(width, dtype=np.int64))[np.frombuffer(raw, dtype=np.uint16, count=n)] += np.frombuffer(raw, dtype=np.int32, offset=2 * n)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])

    kind = "slice int, counts binary"
    found = texts.mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).collect()
    table, docs = np.zeros(size, dtype=np.int64), 0
    for r in found:
        v = np.frombuffer(r["counts"], dtype=np.int64)
        if r["slice"] < 0:
            docs += int(v[0])
        else:
            table[r["slice"] * width : (r["slice"] + 1) * width] += v
    release(texts.sparkSession)
    return table, docs


def prefix(vec: bytes, rank: np.ndarray, weigh: Idf, threshold: float) -> tuple[np.ndarray, float]:
    """The rarest shingles (by rank, then hash) of a text that leave less than the threshold to its others, and its total weight."""
    u, tf = np.unique(np.frombuffer(vec, dtype=np.uint32), return_counts=True)
    order = np.lexsort((u, rank[u & np.uint32((1 << TABLE_BITS) - 1)]))
    w = (weigh(u) * tf)[order].astype(np.float64)
    left = w.sum() - np.cumsum(w)  # behind the first k + 1
    k = int(np.argmax(left < (threshold - 1e-6) * w.sum())) + 1
    return u[order[:k]], float(w.sum())


def _prefixes(vectors: DataFrame, rank, idf, threshold: float, wanted=None) -> DataFrame:
    """(bucket, key, total, n_bytes) of every shingle in a node's prefix that another node may have (one counted once is its own) and that `wanted` may hold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, totals = zip(*(prefix(v.as_buffer(), rank.value, idf.value, threshold) for v in part.column("vec")), strict=True)
                found = [f[rank.value[f & np.uint32((1 << TABLE_BITS) - 1)] > 1] for f in found]
                if wanted is not None:
                    found = [f[_holds(wanted.value, mix64(f.astype(np.uint64)))] for f in found]
                sizes = [len(f) for f in found]
                rows = np.repeat(np.arange(len(found)), sizes)
                bytes_of = np.array([len(v.as_buffer()) for v in part.column("vec")])
                cols = [pa.array(np.concatenate(found).astype(np.int64)), part.column("key").take(pa.array(rows)), pa.array(np.array(totals)[rows]), pa.array(bytes_of[rows])]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "key", "total", "n_bytes"])

    return vectors.select("key", "vec").mapInArrow(run, "bucket long, key binary, total double, n_bytes long")


def _banded(samples: np.ndarray) -> np.ndarray:
    """The bucket of each band of ROWS samples: int64[texts, BANDS]."""
    h = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(samples), axis=0)
    for r in range(ROWS):
        h = mix64(h ^ samples[:, r::ROWS].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def _signed(df: DataFrame, text: str, idf) -> DataFrame:
    """(_id..., key, bands, sig): the digest of a text's words (null: none), its buckets, and a byte of each sample."""
    kept = [c for c in df.columns if c != text]
    fields = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.ByteType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = idf.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [canonical(v) for v in part.column(text).to_pylist()]
                keys = [xxhash.xxh3_128_digest(t) if t else None for t in texts]
                sigs, bands = [None] * len(texts), [None] * len(texts)
                for first, h, counts in shingles(texts):
                    u, tf, n = _unique(h, counts)
                    some = np.flatnonzero(n)
                    drawn = icws(u, weigh(u) * tf, n[some])
                    for i, b, s in zip(some, _banded(drawn), (drawn & np.uint32(255)).astype(np.uint8).view(np.int8), strict=True):
                        bands[first + i], sigs[first + i] = b, s
                cols = [*(part.column(c) for c in kept), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, "key", "bands", "sig"])

    return df.mapInArrow(run, schema)


def _vectors(texts: DataFrame, wanted) -> DataFrame:
    """(key, vec): digest and packed shingles of the texts whose id the broadcast filter may hold; both come from one pass over the texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _holds(wanted.value, mix64(batch.column("h").to_numpy().view(np.uint64)))
            if not some.any():
                continue
            column = batch.column("_text").filter(pa.array(some))
            for at in range(0, len(column), 256):
                texts = [canonical(v) for v in column.slice(at, 256).to_pylist()]
                keys, vecs = [], []
                for first, h, counts in shingles(texts):
                    ends = np.cumsum(counts)
                    for i, (e, n) in enumerate(zip(ends, counts, strict=True)):
                        if n:
                            keys.append(xxhash.xxh3_128_digest(texts[first + i]))
                            vecs.append(h[e - n : e].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["key", "vec"])

    return texts.select(F.xxhash64("_id").alias("h"), "_text").mapInArrow(run, "key binary, vec binary")


#: SQL for the samples that two nodes share.
AGREEMENT = "aggregate(zip_with({}, {}, (s, t) -> int(s = t)), 0, (n, v) -> n + v)"


def _candidates(members: DataFrame, agree: float, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((a, b, agree), members of buckets of more than SMALL): candidate pairs of different components c among (bucket, key, sig, c, ...)."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("bucket").alias("_bucket"), "n")
    met = members.join(sizes, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    large = scratch.write(met.filter(F.col("n") > SMALL).drop("n"))
    drawn = large.groupBy("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(PIVOTS))).agg(F.min(F.struct(F.xxhash64("key", "bucket", F.lit(seed)).alias("h"), "key", "sig", "c")).alias("p"))
    drawn = drawn.groupBy(F.col("bucket").alias("_bucket")).agg(F.collect_list(F.struct("p.key", "p.sig", "p.c")).alias("pivots"))  # PIVOTS at most
    least = agree * SAMPLES
    near = F.filter(F.transform("pivots", lambda p: F.struct(F.aggregate(F.zip_with("sig", p["sig"], lambda s, t: (s == t).cast("int")), F.lit(0), lambda n, v: n + v).alias("agree"), p["key"].alias("key"), p["c"].alias("c"))), lambda p: (p["agree"] >= least) & (p["c"] != F.col("c")))
    best = large.join(drawn, F.col("bucket") == F.col("_bucket")).select(F.col("key").alias("a"), F.explode(F.slice(F.sort_array(near, asc=False), 1, BEST)).alias("p"))
    best = best.select("a", F.col("p.key").alias("b"), "p.agree")
    groups = met.filter(F.col("n") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "sig", "c"))).alias("m"))
    each = f"transform(filter(slice(m, i + 2, size(m)), y -> y.c <> x.c), y -> struct(x.key AS a, y.key AS b, {AGREEMENT.format('x.sig', 'y.sig')} AS agree))"
    pairs = groups.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> filter({each}, z -> z.agree >= {least})))")).alias("p")).select("p.a", "p.b", "p.agree")
    return best.union(pairs).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "agree").distinct(), large


def _labelled(df: DataFrame, comps: DataFrame | None, key: str, out: str) -> DataFrame:
    """Append the component of a node; one without links is its own."""
    if comps is None:
        return df.withColumn(out, F.col(key))
    c = comps.select(F.col("node").alias("_node"), F.col("component").alias("_comp"))
    return df.join(c, F.col(key) == F.col("_node"), "left").withColumn(out, F.coalesce("_comp", key)).drop("_node", "_comp")


class _Search:
    """Links found so far, the components that they make, and the shingles of the nodes that were looked at."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, idf, threshold: float, scratch: Scratch):
        self.texts, self.nodes, self.idf, self.threshold, self.scratch = texts, nodes, idf, threshold, scratch
        self.links: list[DataFrame] = []
        self.comps: DataFrame | None = None
        self.vectors: list[DataFrame] = []

    def fetch(self, wanted: DataFrame) -> None:
        """Shingles of the nodes (key), besides those known already; a filter on ids keeps most texts from giving any."""
        for known in self.vectors:
            wanted = wanted.join(known.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_anti")
        keys = wanted.select(F.col("key").alias("_w"))
        need = self.scratch.write(self.nodes.join(keys, F.col("key") == F.col("_w"), "left_semi").select("key", "rep"))
        if rows(need):
            held = self.scratch.spark.sparkContext.broadcast(_filter_of(need.select(F.xxhash64("rep").alias("v")), rows(need)))
            met = _vectors(self.texts, held).join(need.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_semi")
            self.vectors.append(self.scratch.write(met.dropDuplicates(["key"])))
        self.scratch.drop(need)
        release(self.scratch.spark)

    def known(self) -> DataFrame:
        return reduce(DataFrame.union, self.vectors)

    def add(self, found: DataFrame) -> None:
        """New links; the components so far are stars that they join."""
        found = self.scratch.write(found)
        self.links.append(found)
        edges = found.select("a", "b")
        if self.comps is not None:
            edges = edges.union(self.comps.select("node", "component"))
        old, self.comps = self.comps, star_components(edges, "a", "b", self.scratch)
        if old is not None:
            self.scratch.drop(old)
        release(self.scratch.spark)

    def verify(self, pairs: DataFrame) -> None:
        """Link those of the candidate pairs (a, b, agree) that reach the threshold: each node's best first, then those that these links do not join.

        After the best ones, nodes go by the least node that they are linked to; that is enough to leave out most pairs of a large group.
        """
        pairs = self.scratch.write(pairs)
        if rows(pairs):
            self.fetch(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
            best = self.scratch.write(pairs.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("p")).select("a", F.col("p.b").alias("b")))
            first = self.scratch.write(_verified(best, self.known(), self.idf, self.threshold))
            both = first.select(F.col("a").alias("node"), F.col("b").alias("component")).union(first.select("b", "a"))
            least = both.groupBy("node").agg(F.min("component").alias("component")).select("node", F.least("node", "component").alias("component"))
            done = best.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
            rest = pairs.select("a", "b").join(done, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
            rest = self.scratch.write(_labelled(_labelled(rest, least, "a", "_ca"), least, "b", "_cb").filter("_ca <> _cb").drop("_ca", "_cb"))
            self.add(first.union(_verified(rest, self.known(), self.idf, self.threshold)) if rows(rest) else first)
            self.scratch.drop(best, first, rest)
        self.scratch.drop(pairs)
        release(self.scratch.spark)

    def settle(self, large: DataFrame) -> None:
        """All links between the nodes of mixed buckets (key, c), by the prefix filter."""
        write = self.scratch.write
        hot = write(large.groupBy("key").agg(F.first("c").alias("c")))
        self.fetch(hot.select("key"))
        own = write(self.known().join(hot.select(F.col("key").alias("_h"), "c"), F.col("key") == F.col("_h")).select("key", "c", "vec"))
        spark = self.scratch.spark
        rank = spark.sparkContext.broadcast(np.minimum(_count_table(own.select("vec"), _of_vectors)[0], 2**31 - 1).astype(np.int32))
        main = hot.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").first()["c"]
        is_main = F.col("c") == F.lit(bytes(main))
        outer = write(_prefixes(own.filter(~is_main), rank, self.idf, self.threshold))
        wanted = spark.sparkContext.broadcast(_filter_of(outer.select(F.col("bucket").alias("v")), rows(outer)))
        inner = write(_prefixes(own.filter(is_main), rank, self.idf, self.threshold, wanted))
        members = write(_with_signs(outer.union(inner), hot, self.nodes))
        self.scratch.drop(outer, inner)
        release(spark)
        pairs, left = _candidates(members, AGREE_PREFIX, 1, self.scratch)
        self.verify(pairs)
        rest = write(_mixed(_labelled(left.drop("c", "sig"), self.comps, "key", "c")))
        self.scratch.drop(members, left)
        if rows(rest):
            self.add(_searched(rest, own.select("key", "vec"), self.idf, self.threshold, self.scratch))
        self.scratch.drop(rest, own, hot)
        release(spark)


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, class_id, n_links) of every row of df.

    class_id is the least id of the row's class; n_links counts the verified links of its
    text's words to other texts. Pairs that others have joined already are not verified, so n_links is no degree; a
    text may be in a class without links if only copies share its words.
    Rows whose texts have the same words share a class. Null and empty texts, and texts of white space only, are
    each a class of their own. Rows with a null id take part; a class of null ids only has a
    null class_id. An empty table gives an empty result. Other columns play no part, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "minhash")
    try:
        done = scratch.write(_classes(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), threshold, scratch))
    except BaseException:
        scratch.drop_but()
        raise
    scratch.drop_but(done)
    release(spark)
    return done.select(F.col("_id").alias(id_col), "class_id", "n_links")


def _classes(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    idf = texts.sparkSession.sparkContext.broadcast(Idf(*_count_table(texts.select("_text"), _of_texts)))
    signed = scratch.write(_signed(texts, "_text", idf))
    nodes = scratch.write(signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("_id").alias("rep"), F.min("bands").alias("bands"), F.min("sig").alias("sig")))
    own = scratch.write(signed.select("_id", "key"))
    scratch.drop(signed)
    search = _Search(texts, nodes, idf, threshold, scratch)
    members = scratch.write(_with_signs(nodes.select("key", F.explode("bands").alias("bucket")), None, nodes))
    release(texts.sparkSession)
    pairs, large = _candidates(members, AGREE, 0, scratch)
    search.verify(pairs)
    mixed = scratch.write(_mixed(_labelled(large.select("bucket", "key"), search.comps, "key", "c")))
    scratch.drop(members, large)
    if rows(mixed):
        search.settle(mixed)
    scratch.drop(mixed)
    if not search.links:
        reps = nodes.select(F.col("key").alias("_key"), F.col("rep").alias("_class"), F.lit(0).cast("long").alias("n_links"))
    else:
        links = reduce(DataFrame.union, search.links)
        ends = links.select(F.col("a").alias("_key")).union(links.select(F.col("b").alias("_key"))).groupBy("_key").agg(F.count("*").alias("n_links"))
        named = _labelled(nodes.select("key", "rep"), search.comps, "key", "comp")
        least = named.groupBy("comp").agg(F.min("rep").alias("_class")).withColumnRenamed("comp", "_c")
        reps = named.join(least, F.col("comp") == F.col("_c")).join(ends.withColumnRenamed("_key", "_e"), F.col("key") == F.col("_e"), "left")
        reps = reps.select(F.col("key").alias("_key"), "_class", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = own.join(reps, F.col("key") == F.col("_key"), "left")
    kind = texts.schema["_id"].dataType
    return out.select("_id", F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("_class")).cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _with_signs(members: DataFrame, comps: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(bucket, key, ..., sig, c) of the buckets of two or more members (and components, if comps (key, c) are given); only those carry samples on."""
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("bucket").alias("_b"))
    members = members.join(shared, F.col("bucket") == F.col("_b"), "left_semi")
    if comps is None:
        members = members.withColumn("c", F.col("key"))
    else:
        members = _mixed(members.join(comps.select(F.col("key").alias("_h"), "c"), F.col("key") == F.col("_h")).drop("_h"))
    return members.join(nodes.select(F.col("key").alias("_k"), "sig"), F.col("key") == F.col("_k")).drop("_k")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    some = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select(F.col("bucket").alias("_b"))
    return members.join(some, F.col("bucket") == F.col("_b"), "left_semi")


def _holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a packed filter may hold the values with these 64-bit hashes."""
    p = (hashes & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)


def _filter_of(values: DataFrame, count: int) -> np.ndarray:
    """A packed filter of the longs in column v, `count` at most: FILTER_BITS bits for each, FILTER_MOST at most; a full filter holds every value."""
    bits = min(FILTER_MOST, 1 << max(16, (FILTER_BITS * count - 1).bit_length()))
    width = bits // SLICES

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = (mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((p // width).astype(np.int32)), pa.array((p % width).astype(np.int32))], names=["slice", "at"])

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in np.unique(slices).tolist():
                found.setdefault(k, np.zeros(width, dtype=bool))[at[slices == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(v).tobytes() for v in found.values()], pa.binary())], names=["slice", "bits"])

    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in values.select("v").mapInArrow(place, "slice int, at int").repartition("slice").mapInArrow(fill, "slice int, bits binary").collect():
        table[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def _searched(members: DataFrame, vectors: DataFrame, idf, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): all links between nodes of different components in each bucket of (bucket, key, c, total, n_bytes), one pair of blocks at a time."""
    write = scratch.write
    classed = members.withColumn("k", F.floor(F.log("total") / F.log(F.lit(max(WIDTH, 1.0001 / threshold)))))
    sizes = classed.groupBy("bucket", "k").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
    sizes = write(sizes)
    shifted = lambda by, name: sizes.select(F.col("bucket").alias(f"_b{name}"), (F.col("k") + by).alias(f"_k{name}"), F.col("parts").alias(name))
    met = classed
    for by, name in ((0, "parts"), (-1, "above"), (1, "below")):
        met = met.join(shifted(by, name), (F.col("bucket") == F.col(f"_b{name}")) & (F.col("k") == F.col(f"_k{name}")), "left" if by else "inner").drop(f"_b{name}", f"_k{name}")
    met = met.withColumn("i", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int"))
    cells = F.expr(
        "concat(transform(sequence(0, parts - 1), j -> struct(k AS lo, k AS hi, least(i, j) AS p, greatest(i, j) AS q)), "
        "transform(if(above IS NULL, cast(array() AS array<int>), sequence(0, above - 1)), j -> struct(k AS lo, k + 1 AS hi, i AS p, j AS q)), "
        "transform(if(below IS NULL, cast(array() AS array<int>), sequence(0, below - 1)), j -> struct(k - 1 AS lo, k AS hi, j AS p, i AS q)))"
    )
    dealt = met.select(F.explode(cells).alias("cell"), "bucket", "key", "c").select(F.xxhash64("bucket", "cell").alias("bucket"), "key", "c")
    dealt = write(_mixed(dealt))
    v = vectors.select(F.col("key").alias("_v"), "vec")
    groups = dealt.join(v, F.col("key") == F.col("_v")).groupBy("bucket").agg(F.collect_list(F.struct("key", "c", "vec")).alias("m"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("m"):
                keys, comps, vecs = (c.to_pylist() for c in group.values.flatten())
                a, b = linked(comps, vecs, idf.value, threshold)
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in a], pa.binary()), pa.array([keys[i] for i in b], pa.binary())], names=["a", "b"])

    found = groups.select("m").mapInArrow(run, "a binary, b binary")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(comps: list[bytes], vecs: list[bytes], weigh: Idf, threshold: float) -> tuple[list[int], list[int]]:
    """Pairs of one group's nodes in different components that reach the threshold; the first is outside the largest component."""
    n = len(comps)
    _, comp = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)
    parts = [np.unique(np.frombuffer(v, dtype=np.uint32), return_counts=True) for v in vecs]
    sizes = np.array([len(u) for u, _ in parts])
    owner, flat, tf = np.repeat(np.arange(n), sizes), np.concatenate([u for u, _ in parts]), np.concatenate([t for _, t in parts])
    w = weigh(flat).astype(np.float64)
    total = np.bincount(owner, w * tf, n)
    order = np.argsort(flat, kind="stable")
    shingle, start = np.unique(flat[order], return_index=True)
    stop = np.append(start[1:], len(flat))
    a, b = [], []
    for i in np.flatnonzero(comp != np.bincount(comp).argmax()).tolist():
        u, t = parts[i]
        at = np.searchsorted(shingle, u)
        lengths = stop[at] - start[at]
        rows = order[np.repeat(start[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        low = np.bincount(owner[rows], w[rows] * np.minimum(tf[rows], np.repeat(t, lengths)), n)
        score = low / (total + total[i] - low)
        hits = np.flatnonzero((score >= threshold) & (comp != comp[i])).tolist()
        a += [i] * len(hits)
        b += hits
    return a, b


def _verified(pairs: DataFrame, vectors: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b) of the pairs at or above the threshold."""
    a = vectors.select(F.col("key").alias("_ka"), F.col("vec").alias("va"))
    b = vectors.select(F.col("key").alias("_kb"), F.col("vec").alias("vb"))
    met = pairs.join(a, F.col("a") == F.col("_ka")).select("a", "b", "va").join(b, F.col("b") == F.col("_kb")).select("a", "b", "va", "vb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = idf.value
        for batch in batches:
            keep = [similarity(x.as_py(), y.as_py(), weigh) >= threshold for x, y in zip(batch.column("va"), batch.column("vb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a binary, b binary")


def op5_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of every document: five-word shingles, similarity 0.8 or more."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that lead their class of near duplicates: those of the least id, and of rows repeated with that id and text, one.

    All columns stay, whatever their names.
    """
    classes = near_duplicate_classes(docs, id_col, text)
    key, none, lead, gone = fresh(docs.columns, "key", "none", "lead", "gone")
    of = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())  # noqa: E731  a null id equals itself
    leaders = classes.filter(F.col("class_id").eqNullSafe(F.col(id_col))).select(*(v.alias(n) for v, n in zip(of(id_col), (lead, gone), strict=True))).distinct()
    keyed = docs.withColumns(dict(zip((key, none), of(f"`{id_col}`"), strict=True)))
    met = keyed.join(leaders, (F.col(key) == F.col(lead)) & (F.col(none) == F.col(gone)), "left_semi")
    return met.dropDuplicates([key, none, text]).drop(key, none)  # dealt by id already
