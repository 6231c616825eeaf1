"""Edits of files, over events that stand for a session's calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import edits as E

from .registry import query

_CALLS = r"""with c as (select user_id session, event_id seq, event_type, user_id % 5 p, event_id % 7 q, event_id % 11 f from events),
e as (select session, seq, case event_type when 'view' then 'cd /w/p' || q || case when f % 2 = 0 then '/src && ls' else '/' end when 'error' then case when f % 2 = 0 then 'cd lib; make' else 'cd ..' end end command,
  case event_type when 'click' then '/w/p' || q || '/src/f' || f || '.py' when 'purchase' then 'g' || f || '.md' when 'signup' then '/w/p' || p || '/h.txt' end path from c),
r as (select distinct session, rtrim(regexp_extract(command, '^cd ([^ \t&;]*)', 1), '/') root from e where command is not null),
s as (select e.session, seq, path, max(length(root)) n from e left join r on r.session = e.session and starts_with(path, root || '/') where path is not null group by all)"""


def _calls(t):
    """Views and errors are commands; clicks, purchases and signups results of edits."""
    kind, p, q, f = F.col("event_type"), F.col("user_id") % 5, F.col("event_id") % 7, F.col("event_id") % 11
    rows = t("events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"),
        F.when(kind == "view", F.concat(F.lit("cd /w/p"), q, F.when(f % 2 == 0, "/src && ls").otherwise("/"))).when(kind == "error", F.when(f % 2 == 0, "cd lib; make").otherwise("cd ..")).alias("command"),
        F.when(kind == "click", F.concat(F.lit("edited /w/p"), q, F.lit("/src/f"), f, F.lit(".py\n1 change")))
        .when(kind == "purchase", F.concat(F.lit("ok\nwrote "), q, F.lit(" bytes to g"), f, F.lit(".md")))
        .when(kind == "signup", F.concat(F.lit("edited /w/p"), p, F.lit("/h.txt"))).alias("result"),
    )
    return rows


@query("edit_receipts", _CALLS + " select session, seq, path, case when n is null then path else substr(path, n + 2) end file from s")
def _(t):
    """Paths of edits below the session's longest root."""
    calls = _calls(t)
    paths = calls.select("session", "seq", F.explode(E.receipt_paths(F.col("result"), E.EVERY)).alias("path"))
    return E.stripped(paths, E.roots(calls))


_CWD = r""", d as (select *, rtrim(regexp_extract(command, '^cd ([^ \t&;]*)', 1), '/') t from e),
g as (select *, count(*) filter (t like '/%') over (partition by session order by seq rows between unbounded preceding and current row) grp from d),
w as (select *, list(t) filter (t is not null and t <> '') over (partition by session, grp order by seq rows between unbounded preceding and current row) steps from g),
k(session, seq, i, steps, done) as (select session, seq, 1, string_split(array_to_string(steps, '/'), '/'), []::varchar[] from w where t is not null and t <> ''
  union all select session, seq, i + 1, steps, case when steps[i] in ('', '.') then done when steps[i] = '..' and len(done) > 0 and done[-1] <> '..' then done[:-2] when steps[i] = '..' and steps[1] = '' then done else list_append(done, steps[i]) end from k where i <= len(steps)),
n as (select session, seq, case when steps[1] = '' then '/' else '' end || array_to_string(done, '/') dir from k where i = len(steps) + 1),
x as (select w.session, w.seq, path, last_value(dir ignore nulls) over (partition by w.session order by w.seq rows between unbounded preceding and 1 preceding) cwd from w left join n on n.session = w.session and n.seq = w.seq)"""


@query("edit_directories", _CALLS.replace("with c", "with recursive c", 1) + _CWD + " select session, seq, cwd, case when path like '/%' or cwd is null then path else rtrim(cwd, '/') || '/' || path end path from x where path is not null")
def _(t):
    """Where a session's commands have led when it edits, and the path that this makes."""
    calls = E.current_directory(_calls(t))
    rows = calls.select("session", "seq", "cwd", F.explode(E.receipt_paths(F.col("result"), E.EVERY)).alias("path"))
    return rows.withColumn("path", E.resolved(F.col("path"), F.col("cwd")))
