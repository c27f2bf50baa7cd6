"""URL rules by expression hashing, in DataFrame operations only.

Method. A url expands into expressions: each host suffix with each path prefix that ends in a slash (and the empty prefix). A rule is filed under its host and its path up to the last slash. Both are
hashed; an equi-join on short hash prefixes proposes rules, full digests and the rest of the rule's path confirm them, and the longest rule wins. Only as many host labels and
slashes as some rule has are expanded, which loses nothing and bounds the expansion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, prepare

#: Rules are broadcast up to this many; beyond, pages are joined to rules by a shuffle in which every key is dealt over SALTS places.
BROADCAST_RULES, SALTS = 50_000, 16
#: Fixed value: the rules of the contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(of_host: str, of_path: str) -> str:
    return f"sha2(concat({of_host}, chr(10), {of_path}), 256)"


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, default: str = "allow") -> DataFrame:
    """One row per input row: id_col, host, path, rule (host and path of the winning rule, else null), verdict (the rule's, else ``default``).

    ``rules`` has verdict (block or allow), host, path. A rule fits its host and all subdomains when the url's path starts with its path. The longest host + path wins, then the longer host, then block.
    A null url and one without ``://`` have an empty host and path. Null rule hosts and paths are empty. Repeated rows stay separate, null ids stay
    null, other columns are ignored; without rules every verdict is the default; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    known = rules.select(
        F.lower("verdict").alias("verdict"), F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")
    ).where("verdict in ('block', 'allow')").distinct()
    known = known.withColumn("folder", F.regexp_extract("r_path", r"(?s)\A(?:.*/)?", 0))
    n, labels, slashes = known.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("folder") - F.length(F.replace("folder", F.lit("/"))))).first()
    known = known.select(
        F.expr(_digest("r_host", "folder")).alias("digest"), "r_path",
        F.expr("(char_length(r_host) + char_length(r_path)) * 4294967296L + char_length(r_host) * 2 + IF(verdict = 'block', 1, 0)").alias("code"),
    ).withColumn("short", F.substring("digest", 1, 8))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    hosts = f"transform(sequence(1, least({labels or 1}, size(split(host, r'\\.')))), k -> array_join(slice(split(host, r'\\.'), -k, k), '.'))"
    paths = f"transform(sequence(0, least({slashes or 0}, size(split(path, '/')) - 1)), k -> IF(k = 0, '', concat(array_join(slice(split(path, '/'), 1, k), '/'), '/')))"
    expressions = urls.withColumn("h", F.explode_outer(F.expr(hosts))).withColumn("p", F.explode_outer(F.expr(paths))).withColumn("full", F.expr(_digest("h", "p")))
    expressions = expressions.select("row", "id", "host", "path", "full", F.substring("full", 1, 8).alias("short"))
    on = ["short"]
    if n > BROADCAST_RULES:
        on = ["short", "salt"]
        expressions = expressions.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = (
        expressions.join(hinted(known, n, BROADCAST_RULES), on, "left")
        .withColumn("code", F.when((F.col("full") == F.col("digest")) & F.startswith("path", "r_path"), F.col("code")))
        .groupBy("row", "id", "host", "path")
        .agg(F.max("code").alias("code"))
    )
    length, in_host = F.expr("cast(code div 4294967296L as int)"), F.expr("cast(code % 4294967296L div 2 as int)")
    return best.select(
        F.col("id").alias(id_col), "host", "path",
        F.when(F.col("code").isNotNull(), F.concat(F.when(in_host > 0, F.substring("host", -in_host, in_host)).otherwise(""), F.substring("path", F.lit(1), length - in_host))).alias("rule"),
        F.when(F.col("code").isNull(), F.lit(default)).when(F.col("code") % 2 == 1, "block").otherwise("allow").alias("verdict"),
    )


def oracle() -> str:
    """The contract's rows in DuckDB SQL."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""
with r(v, h, p) as (values {rules}),
u as (select row_number() over () n, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
m as (select n, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from u left join m on u.n = m.n
"""
