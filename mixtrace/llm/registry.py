"""Queries of this package, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chunks, decontamination, language, lexical, mixing, neighbours, quality, sentencepiece_codec,
               simhash, substring, token_files, toxicity)
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file on the driver's and the executors' machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Encodes and decodes every document; NULL text is the empty text."""
    return sentencepiece_codec.encode_digests(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


@register("op9_token_files")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Writes every document's ids to shard files and reads them back."""
    return token_files.read(token_files.write(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"), end_id=1))


@register("op4_mixing", mixing.oracle_sql())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Mixes all documents to the weights 5, 2, 1."""
    p = mixing.plan(table(spark, sf, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    out = simhash.near_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op3_substring_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Removes every repeated window of 50 words from all documents."""
    return substring.digests(table(spark, sf, "documents"))


@register("op1_language")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf, "documents")
    model = language.fit(docs.filter(~held_out("doc_id")))
    return language.identify(docs, model, spans=False).withColumn("held_out", held_out("doc_id"))


@register("op2_quality")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))
    return out.withColumns({"held_out": held_out("doc_id"),
                            "predicted": F.when(F.col("score") >= quality.GOOD, 1).otherwise(0)})


@register("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Expected toxicity grade of every document."""
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels"))).withColumn("held_out", held_out("doc_id"))


@register("op6_fingerprints")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return chunks.compare(table(spark, sf, "documents"))


@register("op7_neighbours")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.search(table(spark, sf, "embeddings"))


@register("op11_lexical_search", lexical.oracle_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op12_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers."""
    return alignment.score(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@register("op13_decontamination", decontamination.oracle_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("items")
