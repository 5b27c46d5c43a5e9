"""Mixing sources to target weights: fixed-length token blocks, drawn per output shard.

Each source's documents form one stream of words, packed into blocks of BLOCK words. A source's target
gives its number of slots; a multinomial draw spreads them over the output shards (so the sources' counts of every shard are
multinomial draws conditioned on the sources' totals, and every source ends at its target). The draw decides which slots a shard
holds: shard k has the source's slots between the k-th and the next partial sum. Slot j of a source is
block permute(j mod blocks) of pass j div blocks, and its place in the shard is permuted once more.

Blocks meet their slots by index. The permutations are computable both ways, so each document's row
finds the slots of its own blocks by the inverse, and no table of slots is made or shuffled. What documents hold
of one block comes together by shard and slot in mix_blocks().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.llm.permute import permute
from weftgraph.llm.tasks import tidy
from weftgraph.runtime import Scratch, number_rows, ship_package

WEIGHTS, PASSES, BLOCK, SHARDS, SEED = (5, 2, 1), 3, 64, 8, 20240301
#: Sources whose shard counts are summed up in one task; their sums are summed in the next.
RANKS = 1024
#: Rows planned together, and characters of one output batch; a longer text is handled alone.
PART, BYTES_OUT = 256, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
PIECE = "struct<from:bigint,words:bigint,at:bigint,shard:int,slot:bigint>"


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = PASSES) -> list[float]:
    """Targets of sources in order: shares of the total by repeating weights, none above cap times its size.

    The driver-side twin of what _sources() computes over a table.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left, free = sum(sizes) - cap * sum(sizes[i] for i in full), sum(w[i] for i in range(len(sizes)) if i not in full)
        more = {i for i in range(len(sizes)) if i not in full and float(left) * w[i] / free > cap * sizes[i]}
        if not more:
            return [float(cap * sizes[i]) if i in full else float(left) * w[i] / free for i in range(len(sizes))]
        full |= more


def slot_count(target: float, size: int, block: int = BLOCK) -> tuple[int, int]:
    """(blocks, slots) of a source: as many slots as come nearest to its target, none beyond PASSES a block."""
    blocks = -(-size // block)
    return blocks, min(PASSES * blocks, round(target * blocks / size)) if size else 0


def shard_draw(slots: int, rank: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The multinomial draw of one source: its slots in each shard."""
    return np.random.default_rng([seed, rank]).multinomial(slots, np.full(shards, 1 / shards))


def block_key(rank: int, turn: int, seed: int = SEED) -> int:
    """Key of a source's permutation of blocks in one pass."""
    return seed + (rank << 20) + (turn << 60) & (1 << 64) - 1


def shard_key(shard: int, seed: int = SEED) -> int:
    """Key of a shard's permutation of slots."""
    return ~(seed + (shard << 20)) & (1 << 64) - 1


def _streams(df: DataFrame, source: Column, size: Column, order: list[Column], scratch: Scratch) -> DataFrame:
    """(row, _g, _n, _pid, _local): all columns as a struct, source, words, and the words of the same source before the row in its partition."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_o{i}" for i in range(len(order))]
    staged = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), source.alias("_g"), size.cast("long").alias("_n"), *(o.alias(k) for o, k in zip(order, names, strict=True)))
    keys = [F.col("_g").isNull(), F.col("_g"), *map(F.col, names)]
    placed = staged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", "_g", "_n")
    schema = T.StructType([*placed.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            g, words = batch.column("_g"), batch.column("_n").to_numpy(zero_copy_only=False)
            null = g.is_null().to_numpy(zero_copy_only=False)
            changed = np.ones(m, dtype=bool)
            changed[1:] = (null[1:] != null[:-1]) | pc.fill_null(pc.not_equal(g.slice(1), g.slice(0, m - 1)), False).to_numpy(zero_copy_only=False)
            before = np.cumsum(words) - words
            run_at = np.flatnonzero(changed)
            local = before - np.repeat(before[run_at], np.diff(np.append(run_at, m)))
            first = int(run_at[1]) if len(run_at) > 1 else m
            if last is not None and last == (g[0].as_py(),):  # the last batch's source goes on
                local[:first] += carried
            last, carried = (g[m - 1].as_py(),), int(local[-1] + words[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, pid, dtype=np.int32)), pa.array(local)], names=[f.name for f in schema.fields])

    return scratch.write(placed.mapInArrow(run, schema))


def _sources(per: DataFrame, block: int, shards: int, seed: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """((_g, rank, size, target, blocks, slots, cum, start), slots by shard) from each source's words (_g, size)."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = scratch.write(number_rows(per, [F.col("_g").isNull(), F.col("_g")], "rank").withColumn("w", weight.cast("long")))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    first = ranked.agg(whole("size").alias("n"), F.sum("w").alias("w")).first()
    left, free, full = int(first["n"] or 0), int(first["w"] or 0), 0
    over = lambda: F.lit(float(left)) * F.col("w") / F.lit(float(free)) > PASSES * F.col("size")
    while free:  # what is full stays full, as the share of a weight only grows
        got = ranked.filter(over()).agg(F.count("*").alias("k"), whole("size").alias("n"), F.sum("w").alias("w")).first()
        if got["k"] == full:
            break
        full, left, free = got["k"], int(first["n"]) - PASSES * int(got["n"]), int(first["w"]) - int(got["w"])
    goal = F.when(over(), PASSES * F.col("size").cast("double")).otherwise(F.lit(float(left)) * F.col("w") / F.lit(float(free))) if free else PASSES * F.col("size").cast("double")

    @tidy
    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, size, target = (batch.column(c).to_pylist() for c in ("rank", "size", "target"))
            counts = [slot_count(t, n, block) for t, n in zip(target, size, strict=True)]
            drawn = [shard_draw(s, r, shards, seed) for r, (_, s) in zip(rank, counts, strict=True)]
            more = [pa.array([b for b, _ in counts], pa.int64()), pa.array([s for _, s in counts], pa.int64()), pa.array(drawn, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_g", "rank", "size", "target")), *more], names=[f.name for f in schema.fields])

    table = ranked.select("_g", F.col("rank").cast("long").alias("rank"), F.col("size").cast("long").alias("size"), goal.alias("target"))
    schema = T.StructType([*table.schema.fields, *T.StructType.fromDDL("blocks long, slots long, drawn array<long>").fields])
    table = scratch.write(table.mapInArrow(planned, schema).withColumn("part", F.floor(F.col("rank") / RANKS)))
    cells = table.select("rank", "part", F.posexplode("drawn").alias("shard", "c"))
    sums = cells.groupBy("shard", "part").agg(F.sum("c").alias("c"))
    totals = {r["shard"]: r["n"] for r in sums.groupBy("shard").agg(F.sum("c").alias("n")).collect()}  # a row for each shard
    earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_parts = sums.select(F.col("shard").alias("_s"), F.col("part").alias("_p"), earlier(Window.partitionBy("shard").orderBy("part")).alias("base"))
    cells = cells.withColumn("own", earlier(Window.partitionBy("shard", "part").orderBy("rank"))).join(of_parts, (F.col("shard") == F.col("_s")) & (F.col("part") == F.col("_p")))
    starts = cells.groupBy(F.col("rank").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", (F.col("base") + F.col("own")).alias("v")))), lambda x: x["v"]).alias("start"))
    cum = F.expr("transform(drawn, (c, k) -> aggregate(slice(drawn, 1, k + 1), 0L, (a, v) -> a + v))").alias("cum")
    return table.join(starts, F.col("rank") == F.col("_r")).select("_g", "rank", "size", "target", "blocks", "slots", cum, "start"), [int(totals.get(k, 0)) for k in range(shards)]


def drawn_pieces(off: np.ndarray, n: np.ndarray, rank: np.ndarray, plan: dict[int, tuple], totals: list[int], block: int = BLOCK, seed: int = SEED) -> dict[str, np.ndarray]:
    """The drawn pieces of rows that start at word off of their source and have n words: row, from, words, at, shard, slot.

    plan: rank -> (blocks, slots, partial sums over shards, first slots in shards).
    """
    some = np.flatnonzero(n > 0)
    low, high = off[some] // block, (off[some] + n[some] - 1) // block
    width = high - low + 1
    row = np.repeat(some, width)
    blocks = np.repeat(low - np.cumsum(width) + width, width) + np.arange(len(row))
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "block", "shard", "slot")}
    of = rank[row]
    order = np.argsort(of, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of))
    for a, b in zip(edges, edges[1:], strict=False):
        at = order[a:b]
        r = int(of[at[0]])
        count, slots, cum, start = plan[r]
        before = np.concatenate([[0], cum[:-1]])
        for turn in range(PASSES):
            if turn * count >= slots:
                break
            j = permute(blocks[at], count, block_key(r, turn, seed), back=True) + turn * count
            hit = j < slots
            j = j[hit]
            shard = np.searchsorted(cum, j, side="right")
            slot = start[shard] + j - before[shard]
            for k in np.unique(shard).tolist():
                own = shard == k
                slot[own] = permute(slot[own], totals[k], shard_key(k, seed))
            for name, v in (("row", row[at][hit]), ("block", blocks[at][hit]), ("shard", shard), ("slot", slot)):
                out[name].append(v)
    got = {k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in out.items()}
    place = np.lexsort((got["slot"], got["shard"], got["block"], got["row"]))
    got = {k: v[place] for k, v in got.items()}
    at = np.maximum(off[got["row"]], got["block"] * block)
    stop = np.minimum(off[got["row"]] + n[got["row"]], (got["block"] + 1) * block)
    return {"row": got["row"], "from": at - off[got["row"]], "words": stop - at, "at": at, "shard": got["shard"], "slot": got["slot"]}


ITEM = pa.struct([("from", pa.int64()), ("words", pa.int64()), ("at", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64())])


def _planned(df: DataFrame, source: Column, size: Column, order: list[Column], block: int, shards: int, seed: int, fields: list[T.StructField] | None = None, make=None) -> DataFrame:
    """(row, size, source_size, target, taken, pieces) of every row; or, in the same pass, what `make` yields of a part and its pieces as RecordBatches of the given fields."""
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "mix")
    rows = _streams(df, source, size, order, scratch)
    sums = scratch.write(rows.groupBy("_pid", "_g").agg(F.sum("_n").alias("words")))
    table, totals = _sources(sums.groupBy("_g").agg(F.sum("words").alias("size")), block, shards, seed, scratch)
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = sums.select(F.col("_pid").alias("_bp"), F.col("_g").alias("_bg"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    bases = scratch.write(bases.join(table, F.col("_bg").eqNullSafe(F.col("_g"))).drop("_g"))
    met = rows.join(bases, (F.col("_pid") == F.col("_bp")) & F.col("_g").eqNullSafe(F.col("_bg"))).select("row", "_n", (F.col("base") + F.col("_local")).alias("_off"), "rank", "size", "target", "blocks", "slots", "cum", "start")
    own = [met.schema["row"], *T.StructType.fromDDL(f"size long, source_size long, target double, taken long, pieces array<{PIECE}>").fields]
    schema = T.StructType(fields or own)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[int, tuple] = {}
        for batch in batches:
            ranks = batch.column("rank").to_numpy()
            distinct, first = np.unique(ranks, return_index=True)
            if len(plan) > 1 << 16:
                plan.clear()
            for r, i in zip(distinct.tolist(), first.tolist(), strict=True):
                if r not in plan:
                    plan[r] = (batch.column("blocks")[i].as_py(), batch.column("slots")[i].as_py(), np.array(batch.column("cum")[i].as_py()), np.array(batch.column("start")[i].as_py()))
            for lo in range(0, batch.num_rows, PART):
                part = batch.slice(lo, PART)
                n = part.column("_n").to_numpy()
                got = drawn_pieces(part.column("_off").to_numpy(), n, part.column("rank").to_numpy(), plan, totals, block, seed)
                if make is not None:
                    yield from make(part, got)
                    continue
                ends = np.searchsorted(got["row"], np.arange(len(n) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(got[f.name].astype(np.int32 if f.name == "shard" else np.int64)) for f in ITEM], fields=list(ITEM))
                taken = np.bincount(got["row"], got["words"], len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("_n"), part.column("size"), part.column("target"), pa.array(taken), pa.ListArray.from_arrays(pa.array(ends), values)], names=[f.name for f in schema.fields])

    return met.mapInArrow(run, schema)


def mix_plan(df: DataFrame, source: str = "source", size: str = "size", order: tuple[str, ...] = ("doc_id",), block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """How much a mix takes of each row: appends source_size, target, taken and pieces.

    `size` counts a row's words (at least 0, not null). pieces: array<struct<from,words,at,shard,slot>>, one for each slot that holds words of the row: the
    first word and the number of words in the row, the first word's place in its source, and the slot's shard and
    place there. Sources by code point, null last, weigh WEIGHTS in turn; see targets(). No word is taken more than PASSES times. Rows that tie
    in source and order are interchangeable; the result depends on the rows and seed only. Any number of sources will do. An
    empty table stays empty; columns with the appended names are replaced, all others stay.
    """
    df = df.drop("source_size", "target", "taken", "pieces")
    done = _planned(df, F.col(f"`{source}`"), F.col(f"`{size}`"), [F.col(f"`{c}`") for c in order], block, shards, seed)
    return done.select(*(F.col(f"row.`{c}`") for c in df.columns), "source_size", "target", "taken", "pieces")


def _of_texts(docs: DataFrame, id_col: str, text: str, source: str, block: int, shards: int, seed: int, fields: list[T.StructField], make) -> DataFrame:
    """What `make` yields of the rows of documents and their pieces."""
    t = F.col(f"`{text}`")
    order = [F.col(f"`{id_col}`"), F.crc32(F.coalesce(t, F.lit("")).cast("binary"))]
    return _planned(docs, F.col(f"`{source}`"), word_count(t), order, block, shards, seed, fields, make)


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed corpus by document: copy k holds the document's words of blocks drawn k times or more.

    A copy of the whole text is left as it is; else each run of taken words keeps its own text,
    and runs are joined by one space. Documents without words, or of which nothing is taken, give no row.
    All columns stay, whatever their names; the text changes.
    """
    words = regex.compile(WORD)
    names = docs.columns
    at_text = names.index(text)

    def copies(part: pa.RecordBatch, got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = part.column("row").flatten()
        edges = np.append(np.flatnonzero(np.diff(got["row"], prepend=-1)), len(got["row"])).tolist()
        take, texts_out, size = [], [], 0
        for a, b in zip(edges, edges[1:], strict=False):
            i = int(got["row"][a])
            t = columns[at_text][i].as_py()
            first, at_first, draws = np.unique(got["from"][a:b], return_index=True, return_counts=True)
            lengths = got["words"][a:b][at_first]
            places = [m.span() for m in words.finditer(t)]
            for k in range(1, int(draws.max()) + 1):
                runs: list[list[int]] = []
                for s, n in zip(first[draws >= k].tolist(), lengths[draws >= k].tolist(), strict=True):
                    if runs and runs[-1][1] == s:
                        runs[-1][1] += n
                    else:
                        runs.append([s, s + n])
                take.append(i)
                texts_out.append(t if runs == [[0, len(places)]] else " ".join(t[places[s][0] : places[e - 1][1]] for s, e in runs))
                size += len(texts_out[-1])
            if size > BYTES_OUT or b == edges[-1]:
                rows = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(texts_out, pa.string()) if k == at_text else c.take(rows) for k, c in enumerate(columns)], names=names)
                take, texts_out, size = [], [], 0

    return _of_texts(docs, id_col, text, source, BLOCK, SHARDS, seed, docs.schema.fields, copies)


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus by block: (shard, slot, source, block, n_words, text), text being the block's words joined by one space.

    What documents hold of a block comes together by its shard and slot. The slots of a shard are gapless from 0. A block has
    `block` words, the last one of a source fewer. Null and empty texts have no words; an empty table gives no rows.
    """
    words = regex.compile(WORD)
    names = docs.columns
    at_text, at_source = names.index(text), names.index(source)
    kind = T.StructField("source", docs.schema[source].dataType)
    fields = [*T.StructType.fromDDL("shard int, slot long").fields, kind, *T.StructType.fromDDL("at long, n long, part string").fields]

    def parts_of(part: pa.RecordBatch, got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = part.column("row").flatten()
        edges = np.append(np.flatnonzero(np.diff(got["row"], prepend=-1)), len(got["row"])).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            i = int(got["row"][a])
            spelled = words.findall(columns[at_text][i].as_py())
            texts = [" ".join(spelled[s : s + n]) for s, n in zip(got["from"][a:b].tolist(), got["words"][a:b].tolist(), strict=True)]
            cols = [pa.array(got["shard"][a:b].astype(np.int32)), pa.array(got["slot"][a:b]), columns[at_source].take(pa.array(np.full(b - a, i))), pa.array(got["at"][a:b]), pa.array(got["words"][a:b]), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    pieces = _of_texts(docs, id_col, text, source, block, shards, seed, fields, parts_of)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ")  # a piece has a word at least
    return pieces.groupBy("shard", "slot").agg(F.min("source").alias("source"), F.expr(f"min(at) div {block}").alias("block"), F.sum("n").alias("n_words"), joined.alias("text"))


def op10_block_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"))
    return mix_plan(docs, order=("doc_id", "_crc")).select("doc_id", "size", "source_size", "target", "taken")


def brute_force(rows: list[tuple], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[dict, dict]:
    """(words taken by row number, (source, block) by (shard, slot)) for rows (id, source, size), by going through all slots."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] is None, (rows[i][1] or "").encode(), rows[i][0]))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in names]
    taken, slots_of, filled = dict.fromkeys(range(len(rows)), 0), {}, [0] * shards
    for rank, (name, size, goal) in enumerate(zip(names, sizes, targets(sizes), strict=True)):
        owner = [i for i in order if rows[i][1] == name for _ in range(rows[i][2])]
        blocks, slots = slot_count(goal, size, block)
        j = 0
        for k, c in enumerate(shard_draw(slots, rank, shards, seed).tolist()):
            for _ in range(c):
                b = int(permute(np.array([j % blocks]), blocks, block_key(rank, j // blocks, seed))[0])
                slots_of[k, filled[k]] = (name, b)
                filled[k] += 1
                for i in owner[b * block : (b + 1) * block]:
                    taken[i] += 1
                j += 1
    places = {(k, at): v for (k, slot), v in slots_of.items() for at in permute(np.array([slot]), filled[k], shard_key(k, seed)).tolist()}
    return taken, places
