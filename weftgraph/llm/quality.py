"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import gbdt
from weftgraph.llm.tasks import tidy
from weftgraph.runtime import Scratch, ship_package

#: At most this many labelled rows fit the trees, those of the least hashes.
SAMPLE = 20_000
TREES, DEPTH, CUT = 80, 4, 0.7
STATS = [
    "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "letters", "digits", "upper", "spaces", "marks", "other_marks", "non_ascii", "unique_words", "top_word", "top_pair",
    "unique_lines", "mean_line", "short_lines", "ends_in_mark", "bare_words", "capital_words", "upper_words", "mark_runs", "pipes", "url_like", "deflated",
]
_KINDS = bytearray(b"m" * 256)
for _c in range(256):
    _s = chr(_c)
    if _c >= 128:
        _KINDS[_c] = ord("n")
    elif _s.isdigit():
        _KINDS[_c] = ord("d")
    elif _s.isupper():
        _KINDS[_c] = ord("U")
    elif _s.islower():
        _KINDS[_c] = ord("l")
    elif _s.isspace():
        _KINDS[_c] = ord("s")
    elif _s in ".,;:'\"!?()-":
        _KINDS[_c] = ord("p")
_KINDS = bytes(_KINDS)


def statistics(text: str | None) -> list[float]:
    """The STATS of a text; those of null equal those of an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATS)
    n, size = len(words), len(raw)
    kinds = raw.translate(_KINDS)
    count = {k: kinds.count(k.encode()) for k in "ldUspmn"}
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    index = {w: i for i, w in enumerate(seen)}
    codes = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=n)
    top = np.unique(codes[:-1] * len(seen) + codes[1:], return_counts=True)[1].max() if n > 1 else 1
    tails = Counter(w[-1] for w in words)
    marks = sum(v for k, v in tails.items() if _KINDS[k] in b"pm")
    caps = sum(_KINDS[w[0]] == 85 for w in words)
    upper = sum(w.isupper() for w in words)
    mark_runs = kinds.count(b"mm") + kinds.count(b"pp")
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), (count["l"] + count["U"]) / size, count["d"] / size, count["U"] / size,
        count["s"] / size, count["p"] / size, count["m"] / size, count["n"] / size, len(seen) / n, max(seen.values()) / n, float(top) / n, len(set(lines)) / len(lines), n / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), sum(_KINDS[x.rstrip()[-1]] in b"pm" for x in lines) / len(lines), 1 - marks / n, caps / n, upper / n, mark_runs / n, raw.count(b"|") / n,
        (raw.count(b"://") + raw.count(b"www.")) / n, len(zlib.compress(raw, 1)) / size,
    ]


def document_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Append column stats: array<float> in the order of STATS."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, "stats")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("stats", T.ArrayType(T.FloatType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [statistics(v) for v in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(rows, pa.list_(pa.float32()))], names=[*kept, "stats"])

    return df.mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE, label_id: str = "doc_id") -> gbdt.Trees:
    """Trees from the labelled rows that are not held out; ids are used to join and split only.

    Null labels teach nothing. Without labels of both classes every score is the smoothed base rate.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(label_id).alias("_l"), F.col(label).cast("int").alias("_y"))
    rows = stats.filter(~held_out(id_col)).join(known, F.col(id_col) == F.col("_l")).select("stats", "_y", F.pmod(F.xxhash64("_l", "stats"), F.lit(1 << 30)).alias("_h"))
    # a threshold on the hash bounds what the driver gets; the few rows beyond the sample are cut there
    share = min(1.0, 1.1 * sample / max(1, rows.count()))
    got = sorted(rows.filter(F.col("_h") < int(share * (1 << 30))).collect(), key=lambda r: (r["_h"], r["_y"], r["stats"]))[:sample]
    x = np.array([r["stats"] for r in got], dtype=np.float64).reshape(len(got), len(STATS))
    return gbdt.fit(x, np.array([r["_y"] for r in got]), TREES, DEPTH)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; null texts score like empty ones.

    predicted is 1 where score >= CUT. Repeated ids are scored row by row.
    """
    spark = docs.sparkSession
    stats = Scratch(spark, "quality").write(document_statistics(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text"))
    model = spark.sparkContext.broadcast(fit_quality(stats, labels, "_id", label, label_id=id_col))

    @F.pandas_udf("double")
    def score(s):
        import pandas as pd

        return pd.Series(model.value.score(np.stack(s.to_numpy()))) if len(s) else pd.Series([], dtype="float64")

    out = stats.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op8_boosted_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
