"""Queries of sessions: conversations as transcripts, events as tool calls (user is the session)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import sessions as S

from .registry import query

_TURNS = "t as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn)::bigint turn_no from conversations)"
_CALLS = "c as (select user_id session, event_type tool, row_number() over (partition by user_id order by ts, event_id) seq, ts, event_id, value from events)"


@query("turns", f"with {_TURNS} select conv_id, turn, role, turn_no from t")
def _(t):
    return S.turns(t("conversations")).select("conv_id", "turn", "role", "turn_no")


@query("prompt_per_turn", f"with {_TURNS} select conv_id, turn_no, turn, sha256(text) text_sha256 from t where role = 'user' and trim(text) <> '' qualify row_number() over (partition by conv_id, turn_no order by turn) = 1")
def _(t):
    return S.prompts(t("conversations")).select("conv_id", "turn_no", "turn", F.sha2("text", 256).alias("text_sha256"))


@query("final_result", "select conv_id, max(turn) line, sha256(arg_max(text, turn)) text_sha256 from conversations where role = 'assistant' group by conv_id")
def _(t):
    return S.results(t("conversations")).select("conv_id", F.col("at").alias("line"), F.sha2("text", 256).alias("text_sha256"))


@query("last_user_text", r"select conv_id, sha256(trim(regexp_replace(arg_max(text, turn), '[\t\n\x0B\f\r ]+', ' ', 'g'))) text_sha256 from conversations where role = 'user' and trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) <> '' group by conv_id")
def _(t):
    return S.last_user_text(t("conversations")).select("conv_id", F.sha2("text", 256).alias("text_sha256"))


@query("tool_pattern", f"with {_CALLS} select session, count(*) n, sha256(string_agg(tool, ' ' order by seq)) pattern_sha256 from c group by session having count(*) >= 2")
def _(t):
    out = S.segments(S.calls(t("events")), F.lit(False))
    return out.select("session", "n", F.sha2("pattern", 256).alias("pattern_sha256"))


@query("step_split", f"with {_CALLS}, g as (select *, coalesce(sum((tool = 'error')::int) over (partition by session order by seq rows between unbounded preceding and 1 preceding), 0)::bigint segment from c) select session, segment, count(*) n, string_agg(tool, ' ' order by seq) pattern from g group by all having count(*) >= 2")
def _(t):
    return S.segments(S.calls(t("events")), F.col("tool") == "error").withColumn("segment", F.col("segment").cast("long"))


@query("plan_skeleton", f"""with {_CALLS}, g as (select *, seq - row_number() over (partition by session, tool order by seq) g from c), r as (select session, tool, min(seq) seq, count(*) n from g group by session, tool, g.g),
k as (select *, row_number() over (partition by session order by seq) k from r) select session, string_agg(case when n > 1 then tool || '(×' || n || ')' else tool end, ' → ' order by seq) skeleton, count(*) n_stages from k where k <= 24 group by session""")
def _(t):
    return S.stages(S.calls(t("events")))


@query("call_results", f"""with {_CALLS}, x as (select session, tool, seq, (event_id // 3)::bigint call_id, props args from c join events using (event_id)), y as (select session, call_id, seq, tool content from x where tool <> 'view'),
a as (select * from x where tool = 'view' qualify row_number() over (partition by session, call_id order by length(args) desc, seq desc) = 1), b as (select * from y qualify row_number() over (partition by session, call_id order by seq) = 1)
select a.session, a.call_id, a.seq, b.content result from a left join b using (session, call_id)""")
def _(t):
    """Views are calls, other events their results, paired by a shared id."""
    rows = S.calls(t("events")).join(t("events").select("event_id", F.col("props").alias("args")), "event_id").withColumn("call_id", F.floor(F.col("event_id") / 3))
    return S.pair_results(rows.filter("tool = 'view'"), rows.filter("tool <> 'view'").withColumn("content", F.col("tool"))).select("session", "call_id", F.col("seq").cast("long").alias("seq"), "result")


@query("latest_verification", f"with {_CALLS}, m as (select session, max(seq) filter (tool = 'purchase') changed, max(seq) filter (tool in ('signup', 'error')) checked, arg_max(tool = 'signup', seq) filter (tool in ('signup', 'error')) passed from c group by session) select session, coalesce(passed, false) and coalesce(checked, 0) > coalesce(changed, 0) verified from m")
def _(t):
    tool = F.col("tool")
    return S.latest_verified(S.calls(t("events")), tool == "purchase", tool.isin("signup", "error"), tool == "signup")


@query("around_window", "select c.conv_id, c.turn, m.turn mark from conversations c join (select conv_id, turn from conversations where role = 'user' and length(text) > 200) m on c.conv_id = m.conv_id and c.turn between m.turn - 3 and m.turn + 4")
def _(t):
    lines = t("conversations")
    return S.around(lines, lines.filter("role = 'user' and length(text) > 200"), 1, 4).select("conv_id", "turn", "mark")


_WORDS = r"w as (select conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) term from conversations)"


@query("context_frequency", f"with {_WORDS}, n as (select conv_id, term, count(*) n from w group by all having count(*) >= 2) select conv_id, term, n, row_number() over (partition by conv_id order by n desc, term) rank from n qualify rank <= 5")
def _(t):
    return S.frequent(t("conversations").select("conv_id", F.explode(text.tokens(F.col("text"))).alias("term")), "conv_id", "term")


@query("pitfalls", "with l as (select lang, split_part(text, chr(10), 1) line from documents), n as (select lang, line, count(*) n from l where line <> '' group by all having count(*) >= 2) select lang, line, n, row_number() over (partition by lang order by n desc, line) rank from n qualify rank <= 6")
def _(t):
    first = F.element_at(F.split("text", "\n", 2), 1)
    return S.frequent(t("documents").select("lang", first.alias("line")).filter("line <> ''"), "lang", "line", 2, 6)


@query("slice_ids", f"""with {_TURNS}, p as (select 'prompt' kind, 0 k, conv_id session, text content from t where role = 'user' and trim(text) <> '' qualify row_number() over (partition by conv_id, turn_no order by turn) = 1),
r as (select 'result' kind, 3 k, conv_id session, arg_max(text, turn) content from conversations where role = 'assistant' group by conv_id), u as (select * from p union all select * from r)
select left(sha256(unhex(lpad(hex(k), 2, '0')) || unhex('00') || encode(content)), 16) id, any_value(kind) kind, min(session) session from u group by 1""")
def _(t):
    return S.slices(t("conversations")).select("id", "kind", "session")


_HIST = """k as (select conv_id, turn, role, text, unnest(case when text like '%error%' or length(text) < 40 then ['tool_error', 'tool_output'] else [role] end) kind from conversations)"""


def _history(t):
    return S.history_documents(t("conversations"), F.col("text").contains("error") | (F.length("text") < 40))


@query("history_documents", f"with {_HIST} select conv_id || ':' || turn || ':' || kind id, conv_id session, turn \"order\", kind, sha256(text) text_sha256 from k")
def _(t):
    """A line that looks like an error counts both as an error and as output."""
    return _history(t).select("id", "session", "order", "kind", F.sha2("text", 256).alias("text_sha256"))


@query("history_filter", f"with {_HIST} select conv_id || ':' || turn || ':' || kind id from k where kind in ('user', 'tool_error') and conv_id % 3 in (0, 1) and turn % 2 = 0")
def _(t):
    docs = _history(t).withColumn("root", (F.col("session") % 3).cast("string")).withColumn("scope", F.when(F.col("order") % 2 == 0, "project").otherwise("global"))
    return S.history_filter(docs, ("user", "tool_error"), roots=("0", "1"), scope="project").select("id")


@query("final_result_without_calls", "select conv_id, max(turn) line from conversations where role = 'assistant' and turn % 4 <> 1 group by conv_id")
def _(t):
    return S.results(t("conversations").withColumn("has_calls", F.col("turn") % 4 == 1)).select("conv_id", F.col("at").alias("line"))


@query("verification_with_pending_calls", f"with {_CALLS}, w as (select *, event_id % 9 = 0 p from c), m as (select session, max(seq) filter (tool = 'purchase' or p) changed, max(seq) filter (tool in ('signup', 'error') and not p) checked, arg_max(tool = 'signup', seq) filter (tool in ('signup', 'error') and not p) passed from w group by session) select session, coalesce(passed, false) and coalesce(checked, 0) > coalesce(changed, 0) verified from m")
def _(t):
    tool = F.col("tool")
    return S.latest_verified(S.calls(t("events")), tool == "purchase", tool.isin("signup", "error"), tool == "signup", F.col("event_id") % 9 == 0)


@query("library_totals", f"with {_TURNS}, p as (select conv_id, text from t where role = 'user' and trim(text) <> '' qualify row_number() over (partition by conv_id, turn_no order by turn) = 1) select count(distinct text) n_slices, count(distinct conv_id) n_sessions from p")
def _(t):
    p = S.prompts(t("conversations"))
    return p.agg(F.countDistinct("text").alias("n_slices"), F.countDistinct("conv_id").alias("n_sessions"))


@query("tool_rounds", f"with {_CALLS}, g as (select *, sum((tool = 'signup')::int) over (partition by session order by seq)::bigint round from c) select session, round, count(*) dispatched, count(*) filter (tool <> 'error') succeeded from g group by all")
def _(t):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rounds = S.calls(t("events")).withColumn("round", F.sum((F.col("tool") == "signup").cast("int")).over(w))
    return rounds.groupBy("session", "round").agg(F.count(F.lit(1)).alias("dispatched"), F.count_if(F.col("tool") != "error").alias("succeeded"))


@query("project_groups", "with f as (select user_id session, min(ts) first_ts, (user_id % 10)::bigint project from events group by user_id) select project, session, (row_number() over (partition by project order by first_ts, session))::bigint k, count(*) over (partition by project) n from f qualify n >= 4 and k <= 5")
def _(t):
    """Sessions of projects that have four or more, the first five by time."""
    f = t("events").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("first_ts")).withColumn("project", F.col("session") % 10)
    w = Window.partitionBy("project")
    return f.select("project", "session", F.row_number().over(w.orderBy("first_ts", "session")).cast("long").alias("k"), F.count(F.lit(1)).over(w).alias("n")).filter("n >= 4 and k <= 5")


@query("ingest_counts", f"with {_TURNS}, p as (select conv_id, count(*) prompts from (select conv_id from t where role = 'user' and trim(text) <> '' qualify row_number() over (partition by conv_id, turn_no order by turn) = 1) group by 1), r as (select conv_id, 1::bigint results from conversations where role = 'assistant' group by 1) select conv_id, coalesce(prompts, 0) prompts, coalesce(results, 0) results from p full join r using (conv_id)")
def _(t):
    return S.pipeline_counts(t("conversations"))


@query("kernel_events", f"with {_TURNS} select conv_id, turn_no, turn, case role when 'user' then 'turn_started' when 'assistant' then 'tool_dispatch' when 'tool' then 'tool_result' else 'note' end kind from t")
def _(t):
    return S.kernel_events(t("conversations"))


@query("event_passthrough", "select event_id, 'user' role, event_type || ': ' || props as text from events where event_type in ('view', 'click', 'error')")
def _(t):
    rows = t("events").select("event_id", F.col("event_type").alias("kind"), F.col("props").alias("data"))
    return S.passthrough(rows, ("view", "click", "error")).select("event_id", "role", "text")


@query("stream_lines", """with e as (select user_id session, event_id seq, (event_id // 4)::bigint m, event_type = 'click' part, case when event_type = 'view' then 'tool' else 'assistant' end role, event_type x, case when event_id % 2 = 0 then event_id // 8 end call_id from events),
l as (select * from e where not part qualify row_number() over (partition by session, m order by seq desc) = 1), d as (select distinct session, call_id from l where role = 'tool'),
o as (select a.* from l a left join d on a.session = d.session and a.call_id = d.call_id where a.role = 'assistant' and a.call_id is not null and d.session is null)
select session, seq, role, x as text from l union all select session, seq, 'tool', '[no result]' from o""")
def _(t):
    i, e = F.col("event_id"), F.col("event_type")
    rows = t("events").select(
        F.col("user_id").alias("session"), i.alias("seq"), F.floor(i / 4).alias("message_id"), (e == "click").alias("partial"), F.when(e == "view", "tool").otherwise("assistant").alias("role"), e.alias("text"), F.when(i % 2 == 0, F.floor(i / 8)).alias("call_id"),
    )
    return S.lines_of_stream(rows).select("session", "seq", "role", "text")


@query("outcome_card", f"with {_CALLS}, x as (select session, seq, tool, 'f' || floor(value)::bigint path from c), e as (select session, path, min(seq) s from x where tool = 'click' group by all), f as (select session, string_agg(path, ', ' order by s) files from (select * from e qualify row_number() over (partition by session order by s) <= 10) group by session), k as (select session, bool_or(tool = 'signup' and path > 'f3') checked from x group by session) select session, coalesce(files, '') files, checked from k left join f using (session)")
def _(t):
    path = F.concat(F.lit("f"), F.floor("value").cast("string"))
    calls = S.calls(t("events")).withColumn("path", path).withColumn("stage", F.when(F.col("tool") == "click", "edit").when(F.col("tool") == "signup", "verify").otherwise("")).withColumn("ok", F.col("path") > "f3")
    return S.outcome_card(calls)


@query("command_card", f"with {_CALLS}, x as (select session, seq, tool || ' ' || floor(value / 10)::bigint command, case when value > 5 then 'ok' else 'failed' end outcome from c), g as (select session, command, min(seq) f, arg_max(outcome, seq) outcome from x group by all) select session, command, outcome, row_number() over (partition by session order by f) rank from g qualify rank <= 8")
def _(t):
    calls = S.calls(t("events")).withColumn("command", F.concat_ws(" ", "tool", F.floor(F.col("value") / 10).cast("string"))).withColumn("outcome", F.when(F.col("value") > 5, "ok").otherwise("failed"))
    return S.command_card(calls)
