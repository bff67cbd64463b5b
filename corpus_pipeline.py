"""The training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next one's docs;
all but the last return the columns of ``documents``.

1. language ID: rows without a language (no letters, or its label covers less
   than 0.3 of the words) go;
2. SimHash near-dedup: one document of each component stays;
3. substring dedup: repeated windows of 50 words leave the texts;
4. mixing: documents are repeated or left out to meet the sources' targets;
5. SentencePiece: the ids of every text, with the end id, their byte spans and
   the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixtrace.llm import language, mixing, registry, sentencepiece_codec, simhash, substring
from mixtrace.llm.common import held_out, pick, table
from mixtrace.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that aren't held out."""
    known = pick(docs, "doc_id", "text", "lang").filter(~held_out("doc_id"))
    return language.keep(docs, language.fit(known))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.apply(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, registry.tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Language models, fingerprints and subword segmentation are no SQL; tests
#: hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
