"""Grounding, prompting and evaluation queries over benchmark questions, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import TERMINAL, WS, duck, duck_tokens, duck_trimmed, tokens
from ..operators import answer as a
from ..operators import ground as g
from ..sources.tables import spread, table


def question_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(g.terms(F.col("text"))), " ").alias("terms"))


def long_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", g.wants_long(F.col("text")).alias("is_long"), g.parameters(F.col("text"))["k"].alias("k"))


def followup_resolve(spark, sf_dir):
    return g.resolved(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.sha2("query", 256).alias("query_sha256"))


def _questions(spark, sf_dir):
    """Each benchmark item as a question, with the document of the same number as its retrieved passage."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lower(F.concat_ws(" ", "text", "source")).alias("haystack"))
    return table(spark, sf_dir, "benchmark").join(d, "item_id", "left").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "haystack")


def haystack_presence(spark, sf_dir):
    q = _questions(spark, sf_dir).select("question_id", "haystack", F.explode(g.terms(F.col("question"))).alias("term"))
    return q.select("question_id", "term", g.present(F.col("term"), F.coalesce("haystack", F.lit(""))).alias("is_present"))


def terms_absent(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select(F.explode(g.terms(F.col("text"))).alias("term"))
    return g.absent_terms(t, table(spark, sf_dir, "documents"))


def lexical_gate(spark, sf_dir):
    return g.gate(_questions(spark, sf_dir), table(spark, sf_dir, "documents"))


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))


def history_window(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", F.filter("ts", lambda x: x["role"].isin("user", "assistant")).alias("ts"))
    return t.select("conv_id", F.inline(a.history_window(F.col("ts"), 6))).select("conv_id", "turn", "role")


def format_context(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", a.context(F.transform("ts", lambda x: x["text"])).alias("c"))
    return t.select("conv_id", F.sha2("c", 256).alias("context_sha256"), F.length("c").alias("context_chars"))


def build_messages(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("last", F.element_at("ts", -1)["text"])
    history = F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    m = a.messages(F.col("last"), F.transform("ts", lambda x: x["text"]), history, g.wants_long(F.col("last")))
    return t.select("conv_id", m.alias("m")).select("conv_id", F.size("m").alias("n_messages"), F.sha2(F.element_at("m", -1)["content"], 256).alias("user_sha256"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


def prompt_fit(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", F.array_join(F.transform("ts", lambda x: x["text"]), "\n").alias("p"))
    return t.select("conv_id", tokens(F.col("p")).alias("n_tokens"), a.prompt_fits(F.col("p"), 512).alias("fits"))


def tidy_answer(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(a.tidied("text"), 256).alias("tidy_sha256"))


def refusal_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", a.is_refusal(F.col("text")).alias("is_refusal"), a.is_stub(F.col("text")).alias("is_stub"))


def support_ratio(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("ratio", a.support(F.col("question"), F.coalesce("haystack", F.lit(""))))
    return q.select("question_id", F.round("ratio", 6).alias("ratio"), a.passes(F.lit(False), F.lit(1), F.col("ratio")).alias("passes"))


def source_rollup(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("url"), F.col("value").alias("score"))
    return a.sources(hits)


def job_progress(spark, sf_dir):
    """The latest event of each job."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"))
    return e.select("user_id", "x.event_id", F.col("x.event_type").alias("phase"), "x.value")


_STOP = ", ".join(f"'{w}'" for w in g.STOPWORDS)
_PLAIN = ", ".join(f"'{w}'" for w in a.PLAIN_WORDS)


def _terms(x):
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), {duck(f'[^\\p{{L}}\\p{{N}}{WS}]')}, ' ', 'g'), {duck(f'[{WS}]+')}), lambda w: length(w) > 2 and w not in ({_STOP})))"


def _words(x):
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), {duck(f'[^a-z0-9{WS}]')}, ' ', 'g'), {duck(f'[{WS}]+')}), lambda w: length(w) > 3 and w not in ({_PLAIN})))"


_Q = "with q as (select b.item_id question_id, b.text question, lower(d.text || ' ' || d.source) haystack from benchmark b left join documents d on d.doc_id = b.item_id)"
_STEM = "case when length(term) > 5 then term[1:ceil(length(term) * 0.75)::int] else term end"
_HIT = f"(contains(coalesce(haystack, ''), term) or (length({_STEM}) > 3 and contains(coalesce(haystack, ''), {_STEM})))"
_T = "with t as (select conv_id, list(struct_pack(turn, role, text) order by turn, role, text) ts from conversations group by 1)"
_ABSENT = "not exists (select 1 from documents d where contains(lower(d.text), term))"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\"'']', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))".replace('\\"', '"')
_LONG = f"regexp_matches({{}}, {duck(g.LONG_REQUEST)})"
_FLAT = (
    f"regexp_replace({duck_trimmed(f'''regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {duck_trimmed(f'regexp_replace(l, {duck(f"^[{WS}]*#{{1,6}}[{WS}]+")}, chr(32))')}), lambda l: l <> ''), ' '), {duck(f'[{WS}]+')}, ' ', 'g')''')}, "
    f"{duck(rf'^\d+\.[{WS}]*')}, '')"
)
_LAST = "greatest(" + ", ".join(f"case when contains(f, '{s} ') then length(f) - instr(reverse(f), ' {s}') - 1 else -2 end" for s in ".!?") + ")"
QUERIES = {f.__name__: f for f in (question_terms, long_intent, followup_resolve, haystack_presence, terms_absent, lexical_gate, history_window, format_context, build_messages, prompt_fit, tidy_answer, refusal_detect, support_ratio, source_rollup, job_progress)}
ORACLES = {
    "question_terms": f"select item_id, array_to_string(list_sort({_terms('text')}), ' ') terms from benchmark",
    "long_intent": f"select conv_id, turn, {_LONG.format('text')} is_long, case when {_LONG.format('text')} then 8 else 4 end k from conversations",
    "followup_resolve": f"""with t as (select *, len({_terms('text')}) n from conversations),
p as (select *, last_value(case when role = 'user' and n > 0 then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) prior from t)
select conv_id, turn, sha256(case when n = 0 and prior is not null then prior || ' ' || text else text end) query_sha256 from p""",
    "haystack_presence": _Q + f", t as (select question_id, haystack, unnest({_terms('question')}) term from q) select question_id, term, {_HIT} is_present from t",
    "terms_absent": f"with t as (select distinct unnest({_terms('text')}) term from benchmark) select term from t where {_ABSENT}",
    "lexical_gate": _Q + f""", t as (select question_id, haystack, unnest({_terms('question')}) term from q), h as (select question_id, term, {_HIT} hit from t),
x as (select term, {_ABSENT} gone from (select distinct term from h where not hit)),
c as (select question_id, count(*) n_terms, count_if(hit) n_matched, count_if(not hit and coalesce(gone, false)) n_absent from h left join x using (term) group by 1)
select question_id, coalesce(n_terms, 0) n_terms, coalesce(n_matched, 0) n_matched, coalesce(n_absent, 0) n_absent,
 case when coalesce(n_terms, 0) = 0 then true when n_absent > 0 then false when n_terms = 1 then n_matched = 1 else n_matched / n_terms >= 0.5 end grounded from q left join c using (question_id)""",
    "history_window": "select conv_id, turn, role from conversations where role in ('user', 'assistant') qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) <= 6",
    "format_context": _T + ", c as (select conv_id, array_to_string(list_transform(ts, lambda x, i: '[' || i || '] ' || x.text), chr(10) || chr(10)) c from t) select conv_id, sha256(c) context_sha256, length(c) context_chars from c",
    "build_messages": _T + f""", c as (select conv_id, ts, array_to_string(list_transform(ts, lambda x, i: '[' || i || '] ' || x.text), chr(10) || chr(10)) c from t)
select conv_id, least(len(ts), 4) + 2 n_messages, sha256('Passages:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || ts[-1].text || chr(10) || chr(10) || 'Answer using only the passages above.') user_sha256,
 'system,' || array_to_string(list_transform(ts[-4:], lambda x: x.role), ',') || ',user' roles from c""",
    "prompt_fit": _T + f", p as (select conv_id, array_to_string(list_transform(ts, lambda x: x.text), chr(10)) p from t) select conv_id, {duck_tokens('p')} n_tokens, {duck_tokens('p')} <= 512 fits from p",
    "tidy_answer": f"with f as (select doc_id, {_FLAT} f from documents), l as (select *, {_LAST} k from f) select doc_id, sha256(trim(case when not regexp_matches(f, {duck(TERMINAL)}) and k > 40 then f[1:k + 1] else f end)) tidy_sha256 from l",
    "refusal_detect": f"select doc_id, {' or '.join(f'contains({_NORM}, {duck(p)})' for p in a.REFUSAL_PHRASES)} or {_NORM} = 'nothing in the indexed pages answers this please ask about what they cover' is_refusal, len(list_filter(regexp_split_to_array(text, {duck(f'[{WS}]+')}), lambda w: w <> '')) < 15 or ends_with(trim(text), ':') is_stub from documents",
    "support_ratio": _Q + f", w as (select question_id, coalesce(haystack, '') h, {_words('question')} ws from q), r as (select question_id, case when len(ws) = 0 then 1.0::double else len(list_filter(ws, lambda x: contains(h, x)))::double / len(ws) end ratio from w) select question_id, round(ratio, 6) ratio, ratio >= 0.8 passes from r",
    "source_rollup": "select user_id question_id, event_type url, round(max(value), 3) score from events group by all",
    "job_progress": "select user_id, event_id, event_type phase, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
}
