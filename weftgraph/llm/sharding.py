"""Reproducible global shuffle into shards: a keyed permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.permute import ROUNDS, half_bits, permute, round_keys
from weftgraph.runtime import number_rows, ship_package

SHARDS, KEY = 8, 20240229


def locate(row_no: int, n: int, shards: int, key: int) -> tuple[int, int]:
    """Shard and slot of one global row number; no data is read."""
    at = int(permute(np.array([row_no]), n, key)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int) -> int:
    """The global row number that stands in a slot; undoes locate."""
    return int(permute(np.array([slot * shards + shard]), n, key, back=True)[0])


def shuffle_into_shards(df: DataFrame, order: list[Column | str], shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """Append row_no, shard and slot: numbers by `order`, permuted and dealt out in turn.

    Shards hold equally many rows or one more, slots count from 0 without gaps, and the
    same rows, order, key and shard count give the same places on any cluster. Rows that tie
    in every order column are interchangeable. An empty table stays empty. Columns with these
    names are replaced.
    """
    ship_package(df.sparkSession)
    numbered = number_rows(df.drop("row_no", "shard", "slot"), order)
    n = numbered._weft_total

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, key))

    placed = numbered.withColumn("_place", place("row_no"))
    return placed.withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": F.floor(F.col("_place") / F.lit(shards)).cast("long")}).drop("_place")


def op6_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal row counts (law rows), by a Feistel permutation of their numbers.

    The permutation works on single rows, so equal texts get no common shard.
    """
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shuffle_into_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _mix_sql(v: str) -> str:
    """mix32 of DuckDB expression v, each value named once by a one-element list."""
    m = "4294967295::UBIGINT"
    out = f"[{v}]"
    for f, s in ((0x9E3779B1, 15), (0x85EBCA77, 13), (0xC2B2AE3D, 16)):
        out = f"list_transform(list_transform({out}, lambda q: (q * {f}::UBIGINT) & {m}), lambda q: xor(q, q >> {s}::UBIGINT))"
    return f"({out})[1]"


def _op6_sql() -> str:
    # half the bits depend on the row count, so they are columns
    keys = round_keys(KEY)

    def walked(source: str) -> str:
        rel = f"SELECT row_no, n, h, v >> h AS l, v & ((1::UBIGINT << h) - 1) AS r FROM {source}"
        for k in keys:
            rel = f"SELECT row_no, n, h, r AS l, xor(l, {_mix_sql(f'xor(r, {k}::UBIGINT)')} & ((1::UBIGINT << h) - 1)) AS r FROM ({rel})"
        return f"SELECT row_no, n, h, (l << h) | r AS v FROM ({rel})"

    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, coalesce(text, '') AS text FROM documents
), numbered AS (
  SELECT doc_id, size, text, (row_number() OVER (ORDER BY doc_id NULLS FIRST, size) - 1)::UBIGINT AS row_no, count(*) OVER () AS n FROM sized
), start AS (
  SELECT row_no, n, greatest(1, ((ceil(log2(greatest(2, n)))::BIGINT + 1) // 2))::UBIGINT AS h, row_no AS v FROM numbered
), walk AS (
  SELECT * FROM ({walked('start')})
  UNION ALL
  SELECT * FROM ({walked('(SELECT * FROM walk WHERE v >= n)')})
)
SELECT d.doc_id, d.size, 'rows' AS law, (w.v % {SHARDS})::INT AS shard, (w.v // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, {CRC_SQL} AS text_crc32
FROM numbered d JOIN walk w ON w.row_no = d.row_no AND w.v < d.n
"""


#: DuckDB has no crc32; a table-driven one over the bytes.
_TABLE = []
for _b in range(256):
    _c = _b
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE.append(_c)
CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(d.text)), '..'), lambda b: ('0x' || b)::BIGINT)), "
    f"lambda c, b: xor(c >> 8, ([{','.join(map(str, _TABLE))}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
)
assert ROUNDS == 6 and half_bits(5) == 2
OP6_SQL = _op6_sql()
