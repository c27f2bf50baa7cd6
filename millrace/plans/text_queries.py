"""Cleaning queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..sources.tables import spread, table


def _lines(verdict=None):
    def run(spark, sf_dir):
        out = clean.line_verdicts(spread(table(spark, sf_dir, "documents")))
        if verdict is None:
            return out.select("doc_id", "line_no", "line")
        return out.where(F.col("verdict") == verdict).select("doc_id", "line_no", "line")

    return run


def clean_verdicts(spark, sf_dir):
    return clean.line_verdicts(spread(table(spark, sf_dir, "documents"))).groupBy("doc_id", "verdict").agg(F.count("*").alias("n_lines"))


def clean_documents(spark, sf_dir):
    return clean.cleaned(spread(table(spark, sf_dir, "documents"))).select("doc_id", F.sha2("cleaned", 256).alias("cleaned_sha256"), F.length("cleaned").alias("cleaned_chars"))


_VERDICTS = {"clean_tail_sections": "tail", "clean_boilerplate": "boilerplate", "clean_toc": "contents", "clean_citations": "citation", "clean_tiny": "tiny", "clean_dedup": "duplicate"}
QUERIES = {"clean_lines": _lines(), "clean_verdicts": clean_verdicts, "clean_documents": clean_documents, **{k: _lines(v) for k, v in _VERDICTS.items()}}
ORACLES = {
    "clean_lines": clean.oracle_lines() + "select doc_id, line_no, line from v",
    "clean_verdicts": clean.oracle_lines() + "select doc_id, verdict, count(*) n_lines from v group by all",
    "clean_documents": clean.oracle_cleaned() + "select d.doc_id, sha256(coalesce(cleaned, '')) cleaned_sha256, length(coalesce(cleaned, '')) cleaned_chars from documents d left join c on d.doc_id = c.doc_id",
    **{k: clean.oracle_lines() + f"select doc_id, line_no, line from v where verdict = '{v}'" for k, v in _VERDICTS.items()},
}
