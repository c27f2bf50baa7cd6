"""A training-corpus pipeline: each stage reads the documents that its predecessor kept and returns the columns of documents, the last one packed pieces.

Quality rules drop documents and failing lines; near-duplicate groups keep one document; documents that hold a benchmark item go; personal
data is masked in place; what remains is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import hinted, settle, table
from millrace.llm.decontaminate import contaminated
from millrace.llm.minhash import BROADCAST_IDS, near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.pii import find_personal_data, redacted
from millrace.llm.quality import judge_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the present text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines. Null and empty texts go; rows are judged alone, whole and whatever their id, so repeated rows stay; extra columns go."""
    judged = judge_documents(docs, carry=("lang", "source"))
    return _shaped(judged.where("kept").withColumn("text", F.col("cleaned")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; documents without a word are all kept.

    Rows with a null id, or an id that other rows have too, are judged each by its own text under a negative id made from text and id; of such rows that agree in both one stays.
    In a group those stay first, then the smallest id. Very long texts are compared whole. Extra columns go, an empty table stays empty.
    """
    repeated, n_repeated = settle(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_known")))
    if not n_repeated:
        return _without_copies(docs.withColumn("_row", F.col("doc_id"))).select(*COLUMNS)
    named = docs.withColumn("_known", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    plain = named.join(hinted(repeated, n_repeated, BROADCAST_IDS), "_known", "left_anti").withColumn("_row", F.col("doc_id"))
    odd = named.join(hinted(repeated, n_repeated, BROADCAST_IDS), "_known", "left_semi").withColumn("_row", -1 - F.abs(F.shiftright(F.xxhash64("text", "_known"), 1)))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    empty = odd.where(wordless)
    spoken = odd.where(~wordless).groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*", "_row")
    return _without_copies(plain.select(*COLUMNS, "_row").unionByName(spoken)).select(*COLUMNS).unionByName(empty.select(*COLUMNS))


def _without_copies(docs: DataFrame) -> DataFrame:
    """Rows whose ``_row``, a unique id, is the smallest of its near-duplicate group."""
    dropped, n_dropped = settle(near_duplicates(docs, "_row").where("not kept").select("_row"))
    return docs.join(hinted(dropped, n_dropped, BROADCAST_IDS), "_row", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Ids are unique by now but for null ones, which go by their text. Null and empty texts hold nothing and stay; very long ones are searched whole; extra columns go."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2("text", 256))
    keyed = docs.withColumn("_key", key)
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key")
    held, n_held = settle(found.select("_key").distinct())
    return keyed.join(hinted(held, n_held, BROADCAST_IDS), "_key", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets. Null texts stay null; rows are judged alone and whole; extra columns go."""
    return _shaped(find_personal_data(docs).withColumn("text", redacted()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence; a null or empty text is one piece of one token, and longer texts are cut."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_personal_data", mask_personal_data), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
