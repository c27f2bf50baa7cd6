"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Method. Every assistant turn becomes an example: all turns before it as context, and its text alone trainable. A conversation that does not end in an assistant turn also gives an example of all its turns without
a trainable part, so no turn is lost. A turn is ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts a backslash is doubled and every control string, of this or other common
templates, is broken by ``\\e`` after its first character; both are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

TURN, END = "<|turn|>", "<|end|>"
#: Control strings are <|name|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST] and [/INST].
_CONTROL = r"(<)(\|[A-Za-z0-9_]*\|>|/?s>|</?SYS>>)|(\[)(/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$3\\e$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\e", "$1")


def examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_col, example (from 0), formatted, loss_start and loss_end (code points of the trainable part, end exclusive; null without one).

    Turns are ordered by turn, then role and text, nulls first; repeated turns all count. A null text or role is empty; only the role ``assistant`` is trainable, even with an empty text. Rows with a null
    conversation id form one conversation. Other columns are ignored; an empty table gives no example. The output of a conversation grows with the square
    of its turns, as the method implies; examples are made one at a time from its sorted turns.
    """
    prepare(conversations.sparkSession)
    turn = F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    turns = conversations.select(F.col(conv_col).alias("conv"), turn.alias("turn")).groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    done = F.transform("turns", lambda t: F.struct(t["r"].alias("r"), F.concat(F.lit(TURN), escaped(t["r"]), F.lit("\n"), escaped(t["x"]), F.lit(END + "\n")).alias("m"), F.length(escaped(t["x"])).alias("n")))
    ends = F.expr("filter(sequence(1, size(turns)), i -> element_at(turns, i).r = 'assistant' OR i = size(turns))")
    whole = turns.withColumn("turns", done).withColumn("ends", ends)
    each = whole.select("conv", "turns", F.posexplode("ends").alias("example", "until"))
    each = each.select("conv", "example", F.expr("array_join(transform(slice(turns, 1, until), t -> t.m), '')").alias("formatted"), F.expr("element_at(turns, until)").alias("last"))
    end = F.when(F.col("last.r") == "assistant", F.length("formatted") - len(END) - 1)
    return each.select(F.col("conv").alias(conv_col), "example", "formatted", (end - F.col("last.n")).alias("loss_start"), end.alias("loss_end"))


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The contract's columns, read back from the examples: the last one holds all turns, the masks hold each assistant text once."""
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    one = formatted.select(F.col(conv_col).alias("conv"), "example", "formatted", F.struct("example", loss.alias("text")).alias("loss"))
    read = one.groupBy("conv").agg(
        F.max_by("formatted", "example").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"), F.sum(F.length("formatted")).alias("chars")
    )
    end = r"\Q" + END + r"\E\n"
    read = read.withColumn("turns", F.transform(F.slice(F.split("all", end, -1), 1, F.size(F.split("all", end, -1)) - 1), lambda t: F.substr(t, F.lit(len(TURN) + 1))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(unescaped(F.substring_index(t, "\n", 1)), F.lit("\n"), unescaped(F.substr(t, F.instr(t, F.lit("\n")) + 1)), F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )


PLANTED = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def with_planted(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and the contract's conversation -7."""
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(planted)


def oracle() -> str:
    """The contract's rows in DuckDB SQL."""
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PLANTED)
    esc = rf"regexp_replace(replace({{}}, '\', '\\'), '{_CONTROL}', '\1\3\\e\2\4', 'g')"
    return rf"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations union all select * from (values {rows}) v(conv_id, turn, r, x)),
o as (select *, row_number() over w i, count(*) over (partition by conv_id) n, length({esc.format('r')}) + length({esc.format('x')}) + {len(TURN) + len(END) + 2} m
    from c window w as (partition by conv_id order by turn nulls first, r, x)),
s as (select *, sum(m) over (partition by conv_id order by i) upto from o)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by i)) turns_sha256,
  cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(x, '' order by i) filter (r = 'assistant'), '')) loss_sha256,
  cast(sum(upto) filter (r = 'assistant' or i = n) as bigint) formatted_chars
from s group by conv_id
"""
