"""From raw documents to token ids: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, linededup, quality, simhash
from lodestone.llm.common import Stored, spread, table
from lodestone.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(spread(docs), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without their source's boilerplate lines; n_chars, if there is one, follows the text."""
    names = [c for c in docs.columns if c != "text"]
    done = linededup.drop_boilerplate(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "source", "text"))
    n = lambda: F.when(F.col("n_lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return done.select(*(F.col("text") if c == "text" else n() if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.keep_one(spread(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.keep_clean(spread(docs), table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text; null and empty texts have no ids."""
    done = bpe.encode_decode(spread(docs).select("doc_id", "source", "text"), vocabulary("word_bpe_49k.json"))
    return done.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("bpe encoding and decoding", token_ids),
]

#: A trained classifier decides in the first stage, which SQL can't express; a brute-force version tests the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, each stage's result being a stored table that the next one reads."""
    store, docs, last = Stored(spark), table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        with Stored.scope():  # what the stage's operator stores is read no more when its result is written
            docs = store.put(f"stage{i}", stage(spark, docs, sf_dir))
        if last:
            store.drop(last)
        last = f"stage{i}"
    return docs
