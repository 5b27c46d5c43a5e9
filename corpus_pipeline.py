"""The corpus pipeline: five stages over documents, each one operator of weftgraph.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import bpe_encode
from weftgraph.llm.langid import UNKNOWN, detect_languages, fit_languages
from weftgraph.llm.minhash import keep_one_of_each
from weftgraph.llm.mixing import mix_texts
from weftgraph.llm.pii import pii_redact
from weftgraph.runtime import Scratch, fresh, release

#: Documents whose words on average have less than this share of the character trigrams that the learned languages have are in none of them.
LEAST_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null texts among them) and those in no learned language."""
    label, score, known = fresh(docs.columns, "language", "score", "known")
    found = detect_languages(docs, fit_languages(docs), out=(label, score, known))
    return found.filter((F.col(label) != UNKNOWN) & (F.col(known) >= LEAST_KNOWN)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each class of near duplicates."""
    return keep_one_of_each(docs).select(*docs.columns)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in square brackets."""
    return _measured(pii_redact(docs)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their target weights; a document that is taken more than once gives a row for each copy."""
    return _measured(mix_texts(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (packed little-endian unsigned 32-bit integers) of every row."""
    import public_tokenizers

    done = bpe_encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("encode", encode)]

#: Boosted trees, random fields and sampled hashes have no SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    try:
        for _, stage in STAGES[:-1]:
            done = scratch.write(stage(spark, docs, sf_dir))
            if before is not None:
                scratch.drop(before)
            docs = before = done
            release(spark)
    except BaseException:
        scratch.drop_but()
        raise
    return STAGES[-1][1](spark, docs, sf_dir)
