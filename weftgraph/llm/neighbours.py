"""Nearest neighbours by collision counting over query-centred hash windows.

Every projection hashes a vector to one number. The index is built once: blocks of vectors, each with one array of numbers
for every projection, sorted, and the order that sorts it. A query opens windows around its own numbers; a vector
collides once for each projection whose window holds it, and at THRESHOLD collisions it is verified by its exact cosine.
Rounds widen all windows (virtual rehashing) until the k-th best similarity known lies inside the radius that the windows
stand for. Each query brings a k-th best to begin with, from a bounded sample of the vectors, so that a block
without near vectors ends its search early; most blocks then return nothing.

Collisions are counted where the block lies: a window of the first round holds a third of all numbers, so handing on (query, vector)
pairs would move many times the data. The index stays in place, and queries come to it by broadcast, in batches of bounded
size. What leaves a block is at most k rows for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.llm.tasks import tidy
from weftgraph.runtime import Scratch, ship_package

K, EVERY = 5, 50
PROJECTIONS, SEED = 32, 11
#: Vectors of one block, on average; bytes of the query vectors in one batch; vectors in the sample.
BLOCK, BATCH_BYTES, SAMPLE = 4096, 1 << 24, 2048
#: Share of the projections in which a vector must collide.
THRESHOLD = 0.5
#: Half width of the first windows in units of a projection's spread, the factor of each widening, and how far the radius must reach beyond the k-th best.
WIDTH, RATIO, SLACK = 0.8, 1.25, 1.15


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q in double precision, the same for equal rows wherever they stand."""
    return (x * q).sum(axis=1) / (norms(x) * np.sqrt((q * q).sum()))


def _hashes(x: np.ndarray) -> np.ndarray:
    """The numbers of vectors under each projection: [PROJECTIONS, vectors]."""
    a = np.random.default_rng(SEED).standard_normal((x.shape[1], PROJECTIONS)) / math.sqrt(x.shape[1])
    return ((x / norms(x)[:, None]) @ a).T


class Block:
    """Vectors with their sorted arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray | None = None, order: np.ndarray | None = None):
        self.ids, self.x, self.lengths = ids, x, norms(x)
        if lines is None:
            hashes = _hashes(x)
            order = np.argsort(hashes, axis=1, kind="stable")
            lines = np.take_along_axis(hashes, order, axis=1)
        self.lines, self.order = lines, order.astype(np.int64)

    def search(self, qids: np.ndarray, q: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) for each query: the k nearest different ids that are found, best first; those below a k-th best known elsewhere may be left out."""
        n, dim = self.x.shape
        spread, need = 1 / math.sqrt(dim), math.ceil(THRESHOLD * PROJECTIONS)
        count, done = np.zeros((len(q), n), dtype=np.int8), np.zeros((len(q), n), dtype=bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(q)
        active, width = np.arange(len(q)), WIDTH
        low = high = np.zeros((PROJECTIONS, len(q)), dtype=np.int64)
        while len(active):
            half, first = width * spread, width == WIDTH
            new_low, new_high = low.copy(), high.copy()
            for i, line in enumerate(self.lines):
                new_low[i, active] = np.searchsorted(line, own[active, i] - half, "left")
                new_high[i, active] = np.searchsorted(line, own[active, i] + half, "right")
            ended = []
            for j in active.tolist():
                gained = []  # only what the windows gained; a vector stands in an array once
                for i, order in enumerate(self.order):
                    if first:
                        gained.append(order[new_low[i, j] : new_high[i, j]])
                    else:
                        gained += (order[new_low[i, j] : low[i, j]], order[high[i, j] : new_high[i, j]])
                count[j] += np.bincount(np.concatenate(gained), minlength=n).astype(np.int8)
                new = np.flatnonzero((count[j] >= need) & ~done[j])
                done[j, new] = True
                best[j] = self._verified(new, qids[j], q[j], bounds[j], best[j], k)
                known = max(bounds[j], best[j][1][k - 1] if len(best[j][1]) == k else -np.inf)
                whole = not new_low[:, j].any() and bool((new_high[:, j] == n).all())
                if whole or (SLACK * SLACK) * (2 - 2 * known) <= width * width:  # squared distance of unit vectors
                    ended.append(j)
            low, high, width = new_low, new_high, width * RATIO
            active = np.setdiff1d(active, ended)
        return [(ids[scores >= b], scores[scores >= b]) for (ids, scores), b in zip(best, bounds, strict=True)]

    def _verified(self, new: np.ndarray, qid: int, q: np.ndarray, bound: float, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those known and of the new vectors, by their exact cosine; a quick product leaves out what cannot be among them."""
        new = new[self.ids[new] != qid]
        if not len(new):
            return best
        length = np.sqrt((q * q).sum())
        rough = self.x[new] @ q / (self.lengths[new] * length)
        least = max(bound, best[1][k - 1] if len(best[1]) == k else -np.inf)
        new = new[rough >= least - 1e-9]
        x = self.x[new]
        ids, scores = np.concatenate([best[0], self.ids[new]]), np.concatenate([best[1], (x * q).sum(axis=1) / (self.lengths[new] * length)])
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)  # an id counts once, with its best vector
        order = order[np.sort(first)[:k]]
        return ids[order], scores[order]


#: Queries that search a block together.
TOGETHER = 256


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray | None = None, k: int = K, block: Block | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of what each query finds among the vectors."""
    block = block or Block(ids, x)
    own = _hashes(q).T if own is None else own
    bounds = np.full(len(q), -np.inf) if bounds is None else bounds
    found = [r for a in range(0, len(q), TOGETHER) for r in block.search(qids[a : a + TOGETHER], q[a : a + TOGETHER], own[a : a + TOGETHER], bounds[a : a + TOGETHER], k)]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return np.repeat(qids, [len(a) for a, _ in found]), np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])


def _index(rows: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """(dim, ids, x, lines, order): one row of packed arrays for each block of vectors of one length."""
    schema = "dim int, ids binary, x binary, lines binary, `order` binary"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        b = Block(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame([{"dim": b.x.shape[1], "ids": b.ids.tobytes(), "x": b.x.tobytes(), "lines": b.lines.tobytes(), "order": b.order.astype(np.int32).tobytes()}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return scratch.write(dealt.groupBy("dim", "block").applyInPandas(build, schema))


def _bounded(queries: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(id, v, dim, bound): the k-th best similarity to a sample by dim, lowered by what rounding may differ; without k different ids, none."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)
    schema = T.StructType([*queries.select("id", "v", "dim").schema.fields, T.StructField("bound", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bounds = []
                for i, v in zip(part.column("id").to_pylist(), part.column("v"), strict=True):
                    q = v.values.to_numpy()
                    ids, x = shared.value.get(len(q), (np.empty(0, dtype=np.int64), np.empty((0, len(q)))))
                    x, ids = x[ids != i], ids[ids != i]
                    scores = cosine(x, q)
                    _, of = np.unique(ids, return_inverse=True)
                    top = np.full(int(of.max()) + 1 if len(of) else 0, -np.inf)
                    np.maximum.at(top, of, scores)
                    bounds.append(float(np.partition(top, -k)[-k]) - 1e-9 if len(top) >= k else -np.inf)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("dim"), pa.array(bounds, pa.float64())], names=["id", "v", "dim", "bound"])

    return queries.select("id", "v", "dim").mapInArrow(run, schema)


def nearest(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, id_col, score): the k rows nearest by cosine to each row whose id is divisible by `every`.

    A row is no candidate of its own. Vectors that are null, zero, or hold null or non-finite
    components, and rows with a null id, take no part; vectors meet those of their own length only. Ties go to the
    smaller id. Fewer than k candidates: all are returned. An empty table gives no rows. Other columns play no part.
    Rows that share an id are one candidate, with the vector that is nearest, and never candidates of that id's query; of query rows
    that share an id, the one of the least vector asks. So (query_id, rank) and (query_id, id_col) are unique.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "neighbours")
    fine = F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    rows = rows.dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    try:
        index = _index(rows, max(1, -(-rows.count() // BLOCK)), scratch)
        drawn = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
        sample = {d: (np.array([r["id"] for r in drawn if r["dim"] == d]), np.array([r["v"] for r in drawn if r["dim"] == d])) for d in {r["dim"] for r in drawn}}
        queries = scratch.write(_bounded(queries, sample, k))
        size = queries.agg(F.sum(F.lit(8) * F.col("dim")).alias("n")).first()["n"] or 0
        batches = -(-size // BATCH_BYTES)
        best = [scratch.write(_asked(index, queries.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b), k)) for b in range(batches)]
    except BaseException:
        scratch.drop_but()
        raise
    kind = df.schema[id_col].dataType
    if not best:
        empty = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kind), T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], empty)
    scratch.drop_but(*best)
    return reduce(DataFrame.union, best).select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("id").cast(kind).alias(id_col), "score")


def _asked(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query of one batch, which is broadcast, over all blocks."""
    got = queries.collect()  # BATCH_BYTES of vectors on average
    by: dict[int, tuple[np.ndarray, ...]] = {}
    for d in {r["dim"] for r in got}:
        own = sorted((r for r in got if r["dim"] == d), key=lambda r: r["id"])
        q = np.array([r["v"] for r in own])
        by[d] = (np.array([r["id"] for r in own], dtype=np.int64), q, np.array([r["bound"] for r in own]), _hashes(q).T)
    shared = index.sparkSession.sparkContext.broadcast(by)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("dim")[i].as_py()
                if d not in shared.value:
                    continue
                raw = {c: batch.column(c)[i].as_buffer() for c in ("ids", "x", "lines", "order")}
                ids = np.frombuffer(raw["ids"], dtype=np.int64)
                n = len(ids)
                block = Block(ids, np.frombuffer(raw["x"]).reshape(n, d), np.frombuffer(raw["lines"]).reshape(PROJECTIONS, n), np.frombuffer(raw["order"], dtype=np.int32).reshape(PROJECTIONS, n))
                qids, q, bounds, own = shared.value[d]
                a, b, s = search_block(ids, block.x, qids, q, bounds, k, block, own)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    blocks = index.repartition(max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("ids"))  # a task gets few whole blocks
    found = blocks.mapInArrow(run, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k)


def op7_collision_counting(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every row whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def brute_force(ids: list[int], vectors: list[list[float]], every: int = EVERY, k: int = K) -> Iterator[tuple[int, int, int, float]]:
    """The exact answer for different ids, for recall."""
    x, ids = np.array(vectors, dtype=np.float64), np.array(ids)
    for n in np.flatnonzero(ids % every == 0):
        s = cosine(x, x[n])
        s[n] = -np.inf
        for rank, i in enumerate(np.lexsort((ids, -s))[:k]):
            if s[i] > -np.inf:
                yield int(ids[n]), rank + 1, int(ids[i]), float(s[i])
