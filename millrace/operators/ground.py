"""Question terms, follow-up resolution and the lexical grounding gate, over batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, java, lit

#: Words that say nothing about a question's subject.
STOPWORDS = tuple(
    (
        "a an the and or but if then than that this these those of to in on at for with as is are was were be been being it its by from can could will would shall should may might must do does did "
        "have has had i you he she we they me him her us them my your his their our what which who whom whose when where why how all any both each few more most other some such no nor not only own "
        "same so too very just about into over under between during before after above below up down out off again further once here there while whether tell give show explain describe define list "
        "summarise summarize mean means meaning happened happen thing things something anything please write compose draft create make produce generate elaborate expand detail discuss analyse analyze "
        "compare contrast outline review cover address answer respond continue rephrase reword clarify simplify shorten lengthen add include mention state provide essay article report paragraph "
        "paragraphs page pages section sections summary overview introduction conclusion note notes point points details example examples topic subject matter content text piece writing full complete "
        "comprehensive detailed thorough brief short long longer additional extra deeper depth length word words sentence sentences line lines"
    ).split()
)
_STOPPED = frozenset(STOPWORDS)
#: Fixed value: requests for a long answer.
LONG_REQUEST = (
    r"(?i)\b(essay|elaborate|expand|in detail|detailed|comprehensive|thorough|at length|full(?:y)?\s+(?:explain|describe|cover)|more detail|go deeper|deep dive|write (?:a|an|me)?\s*(?:long|full|complete)|"
    r"long(?:er)? (?:answer|response|explanation)|tell me (?:much )?more|several paragraphs|multiple paragraphs)\b"
)


def terms(text: Column) -> Column:
    """Distinct content terms in first-seen order: lower case, letters and digits, over two characters, no stopword."""
    words = F.split(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{WS}]", " "), f"[{WS}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def lettered_sql(text: str) -> str:
    """SQL of a text in lower case with a blank for what is no letter, digit or white space."""
    return f"regexp_replace(lower({text}), {lit(rf'[^\p{{L}}\p{{N}}{WS}]')}, ' ')"


def lettered_terms(text: str | None) -> list[str] | None:
    """``terms`` of a text that ``lettered_sql`` made. Of its white space only U+FEFF is none to Python."""
    return text if text is None else list(dict.fromkeys(w for w in text.replace("\ufeff", " ").split() if len(w) > 2 and w not in _STOPPED))


def wants_long(text: Column) -> Column:
    return text.rlike(java(LONG_REQUEST))


def parameters(text: Column, k: int = 4, max_tokens: int = 1100, max_tokens_long: int = 1400, min_score: float = 0.35) -> Column:
    """Retrieval parameters by mode."""
    long = wants_long(text)
    return F.struct(F.when(long, max(2 * k, 6)).otherwise(k).alias("k"), F.when(long, max_tokens_long).otherwise(max_tokens).alias("max_tokens"), F.lit(min_score).alias("min_score"))


def resolved(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Add ``query`` to each turn: its text, or with the latest earlier user text that has terms before it when it has none itself."""
    own = terms(F.col(text))
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when((F.col(role) == "user") & (F.size(own) > 0), F.col(text)), ignorenulls=True).over(before)
    return turns.withColumn("query", F.when((F.size(own) == 0) & prior.isNotNull(), F.concat(prior, F.lit(" "), F.col(text))).otherwise(F.col(text)))


def present(term: Column, haystack: Column) -> Column:
    """Whether a term, or the first three quarters of one over five letters, is in a lower-case haystack."""
    stem = F.when(F.length(term) > 5, F.substring(term, F.lit(1), F.ceil(F.length(term) * 0.75).cast("int"))).otherwise(term)
    return F.contains(haystack, term) | ((F.length(stem) > 3) & F.contains(haystack, stem))


def absent_terms(asked: DataFrame, corpus: DataFrame, term: str = "term", text: str = "text", most_terms: int = 100_000) -> DataFrame:
    """Terms that no corpus text contains, case folded. Terms are runs of letters and digits, so it is enough to look into the corpus's distinct
    words: those that are words drop out by an equi-join, and only the rest (counted, at most ``most_terms``) are looked for inside words."""
    distinct = asked.select(term).where(F.col(term).isNotNull()).distinct()
    n = distinct.count()
    if n > most_terms:
        raise ValueError(f"{n} distinct terms in one batch; send at most {most_terms}")
    words = corpus.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("_word")).distinct()
    rest = distinct.join(words.withColumnRenamed("_word", term), term, "left_anti")
    found = words.join(F.broadcast(rest), F.contains("_word", term)).select(term).distinct()
    return rest.join(found, term, "left_anti")


def gate(questions: DataFrame, corpus: DataFrame, ratio: float = 0.5) -> DataFrame:
    """question_id, n_terms, n_matched, n_absent, grounded. questions: question_id, question, haystack (lower-case retrieved passages with titles); corpus: text.

    No terms: grounded. A missing term that is nowhere in the corpus: not grounded. One term: it must match; else a share of ``ratio`` must.
    """
    each = questions.select("question_id", "haystack", F.explode_outer(terms(F.col("question"))).alias("term"))
    each = each.withColumn("hit", present(F.col("term"), F.coalesce("haystack", F.lit(""))))
    nowhere = absent_terms(each.where(~F.col("hit")), corpus).withColumn("absent", F.lit(True))
    counted = each.join(F.broadcast(nowhere), "term", "left").groupBy("question_id").agg(
        F.count("term").alias("n_terms"), F.count_if("hit").alias("n_matched"), F.count_if(F.coalesce("absent", F.lit(False)) & ~F.col("hit")).alias("n_absent")
    )
    grounded = F.when(F.col("n_terms") == 0, True).when(F.col("n_absent") > 0, False).when(F.col("n_terms") == 1, F.col("n_matched") == 1).otherwise(F.col("n_matched") / F.col("n_terms") >= ratio)
    return counted.withColumn("grounded", grounded)
