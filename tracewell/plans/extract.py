"""All kinds of slices, over events that stand for the lines of a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import extract as X
from tracewell.operators import sessions as S

from .registry import query

_SQL = """with l as (select user_id session, event_id "order", event_type, 'ask ' || event_id % 90 q, 'done ' || event_id % 40 a, event_id % 3 f, event_id % 4 g from events),
n as (select *, sum((event_type = 'signup')::int) over (partition by session order by "order") turn_no from l),
p as (select session, 'prompt' kind, 0 k, q content, '' status from n where event_type = 'signup'),
c as (select session, turn_no, "order", case event_type when 'view' then 'read_file' when 'click' then 'edit_file' else 'bash' end tool, case when event_type <> 'purchase' then 'src/m' || f || '/f' || g || '.py' end path, case event_type when 'purchase' then case when g = 0 then 'make' else 'pytest' end end head from n where event_type in ('view', 'click', 'purchase')),
t as (select session, 'tool_pattern' kind, 1 k, string_agg(tool, ' ' order by "order") content, '' status from c group by session, turn_no having count(*) >= 2),
e as (select session, 1 o, 'Frequent paths:' title, path entry, count(*) n from c where path is not null group by all union all select session, 2, 'Frequent directories:', 'src/m' || split_part(path, '/', 2)[2:], count(*) from c where path is not null group by all union all select session, 3, 'Common command heads:', head, count(*) from c where head is not null group by all),
b as (select *, row_number() over (partition by session, o order by n desc, entry) r from e where n >= 2),
x as (select session, 'context' kind, 2 k, 'Project context observed from repeated tool calls:' || chr(10) || string_agg(part, chr(10) order by o) content, '' status from (select session, o, title || chr(10) || string_agg('- ' || entry || ' (' || n || ')', chr(10) order by r) part from b where r <= 5 group by session, o, title) group by session),
v as (select session, max("order") filter (event_type = 'click') changed, max("order") filter (event_type = 'purchase') checked, arg_max(g > 0, "order") filter (event_type = 'purchase') passed from l group by session),
a as (select l.session, 'result' kind, 3 k, arg_max(a, "order") content, case when coalesce(any_value(passed), false) and coalesce(any_value(checked), 0) > coalesce(any_value(changed), 0) then 'verified' else 'probation' end status from l join v using (session) where event_type = 'error' group by l.session),
u as (select * from p union all select * from t union all select * from x union all select * from a)"""


def _lines(t):
    """Signups are prompts, views and clicks calls with a path, purchases commands, errors answers."""
    e, i = F.col("event_type"), F.col("event_id")
    path = F.concat(F.lit("src/m"), i % 3, F.lit("/f"), i % 4, F.lit(".py"))
    call = F.struct(
        F.when(e == "view", "read_file").when(e == "click", "edit_file").otherwise("bash").alias("name"),
        F.when(e == "purchase", F.when(i % 4 == 0, "cd /x && make all").otherwise("A=1 pytest -q")).alias("command"),
        F.when(e != "purchase", F.array(path)).otherwise(F.array().cast("array<string>")).alias("paths"),
    )
    return t("events").select(
        F.col("user_id").alias("session"), i.alias("order"), "event_type",
        F.when(e == "signup", "user").otherwise("assistant").alias("role"),
        F.when(e == "signup", F.concat(F.lit("ask "), i % 90)).when(e == "error", F.concat(F.lit("done "), i % 40)).otherwise("").alias("text"),
        F.when(e.isin("view", "click", "purchase"), F.array(call)).alias("calls"),
    )


def _verified(lines):
    e = F.col("event_type")
    return S.latest_verified(lines.withColumnRenamed("order", "seq"), e == "click", e == "purchase", F.col("seq") % 4 > 0)


@query("extracted_slices", _SQL + """ select left(sha256(unhex(lpad(hex(k), 2, '0')) || unhex('00') || encode(content)), 16) id, any_value(kind) kind, min(session) session, arg_min(status, session) status from u group by k, content""")
def _(t):
    lines = _lines(t)
    return X.extracted(lines, _verified(lines)).select("id", "kind", "session", "status")


@query("extracted_counts", _SQL + """, d as (select distinct session, kind, content from u) select session, """ + ", ".join(f"count(*) filter (kind = '{k}') {k}s" for k in X.KINDS) + " from d group by session")
def _(t):
    lines = _lines(t)
    return X.counted(lines, _verified(lines))
