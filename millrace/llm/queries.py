"""One query per training-data operator, over the whole table it is meant for, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, pii, toxicity, urls, warc
from .common import table
from .minhash import near_duplicates
from .minhash import oracle as near_oracle
from .packing import pack_documents
from .quality import judge_documents
from .quality import oracle as quality_oracle


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts of its base rules and the line-first verdict."""
    return judge_documents(table(spark, sf_dir, "documents")).drop("cleaned")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts and digest of its base spans, and all spans."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; learned off the evaluation fold."""
    return langid.evaluated(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the host, path, longest fitting rule and verdict of its url."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(urls.RULES, "verdict string, host string, path string"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a log made from pages, with the response that it stands for."""
    return warc.digest(warc.resolve_revisits(warc.captures_of(table(spark, sf_dir, "pages"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score; learned off the evaluation fold."""
    return toxicity.evaluated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one planted one, read back from its formatted examples."""
    return chat.digest(chat.examples(chat.with_planted(spark, table(spark, sf_dir, "conversations"))))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate group."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_pii": op2_pii, "op3_langid": op3_langid, "op4_packing": op4_packing, "op5_url_filter": op5_url_filter, "op6_decontamination": op6_decontamination, "op7_warc": op7_warc, "op8_toxicity": op8_toxicity, "op9_chat": op9_chat, "op10_minhash": op10_minhash}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality_oracle(), "op5_url_filter": urls.oracle(), "op6_decontamination": decontaminate.oracle(), "op7_warc": warc.oracle(), "op9_chat": chat.oracle(), "op10_minhash": near_oracle()}
