"""Queries of library maintenance: documents with statistics derived from their ids stand in for slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scores, text
from tracewell.operators import quality as Q

from .registry import query

NOW = 1_700_000_000
# Ids spread over kinds, ages and counters; a null text is empty.
SLICES = f"""s as (select doc_id id, case doc_id % 5 when 0 then 'prompt' when 1 then 'context' when 2 then 'tool_pattern' when 3 then 'result' else 'memory' end kind, coalesce(text, '') as content, lang, source,
 case when doc_id % 13 = 0 then 0 else {NOW} - (doc_id * 7919 % 8000000) end created, case when doc_id % 3 = 0 then 0 else {NOW} - (doc_id * 104729 % 9000000) end last_used, doc_id % 17 hits, doc_id % 7 injected, doc_id % 4 rejected, ((doc_id % 9) - 4)::double feedback, doc_id % 11 = 0 protected, doc_id % 19 = 0 missing from documents)"""
WEIGHT = f"""w as (select *, round(least(greatest(case when greatest(last_used, created) > 0 then exp(-ln(2) * greatest({NOW} - greatest(last_used, created), 0) / (30 * 86400.0::double)) else 0.5 end * ((hits + injected + 0.5::double) / (hits + injected + 3)) * ((injected + 1.0::double) / (injected + 1 + 2 * rejected)) * least(greatest(1 + 0.5 * feedback, 0.25), 2), 0.001), 1), 9) weight from s)"""


def slices(t):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("prompt", "context", "tool_pattern", "result", "memory"))), (i % 5 + 1).cast("int"))
    return t("documents").select(
        i.alias("id"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source",
        F.when(i % 13 == 0, 0).otherwise(NOW - i * 7919 % 8_000_000).alias("created"), F.when(i % 3 == 0, 0).otherwise(NOW - i * 104729 % 9_000_000).alias("last_used"),
        (i % 17).alias("hits"), (i % 7).alias("injected"), (i % 4).alias("rejected"), (i % 9 - 4).cast("double").alias("feedback"), (i % 11 == 0).alias("protected"), (i % 19 == 0).alias("missing"),
    )


def weighted(t):
    w = scores.value_weight(F.lit(NOW), *[F.col(c) for c in ("created", "last_used", "hits", "injected", "rejected", "feedback")])
    return slices(t).withColumn("weight", F.round(w, 9))


@query("value_weight", f"with {SLICES}, {WEIGHT} select id, weight from w")
def _(t):
    return weighted(t).select("id", "weight")


_GC = f"""{SLICES}, {WEIGHT}, g as (select *, case when created > 0 and created < {NOW} - 80 * 86400 then 'expired' when weight > 0 and weight < 0.01 then 'low_score' end reason from w),
o as (select id, row_number() over (order by (created > 0 and {NOW} - created < 7 * 86400), case kind when 'result' then 0 when 'tool_pattern' then 1 when 'memory' then 2 when 'prompt' then 3 when 'context' then 4 else 5 end, weight, created, id) r, count(*) over () n from g where reason is null),
e as (select id, kind, case when o.r <= o.n - 300 then 'over_cap' else reason end reason from g left join o using (id))"""


@query("gc_evict", f"with {_GC} select id, reason from e where reason is not null")
def _(t):
    return Q.gc(weighted(t), NOW, 80, 0.01, 300).filter("reason is not null").select("id", "reason")


@query("gc_by_type", f"with {_GC} select kind, coalesce(reason, 'kept') reason, count(*) n from e group by all")
def _(t):
    return Q.gc(weighted(t), NOW, 80, 0.01, 300).groupBy("kind", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("prune_plan", f"""with {SLICES}, p as (select *, created < {NOW} - 60 * 86400 and last_used < {NOW} - 60 * 86400 stale from s),
r as (select *, case when protected then [] else list_filter([case when missing then 'missing_dependency' end, case when stale then 'stale_unused' end, case when stale and kind = 'result' and id % 2 = 1 then 'stale_probation' end, case when stale and (rejected > 0 or feedback < 0) then 'stale_rejected' end], lambda x: x is not null) end own from p),
q as (select *, count(*) over (partition by kind, content) n, first_value(case when protected or len(own) = 0 then id end) over (partition by kind, content order by (protected or len(own) = 0) desc, not protected, last_used desc, created desc, id) rep from r)
select id, array_to_string((case when n > 1 and rep is not null and rep <> id and not protected and content <> '' then ['exact_duplicate'] else [] end) || own, ',') reasons, case when n > 1 and rep <> id and not protected and content <> '' then rep else -1 end retained from q where (n > 1 and rep is not null and rep <> id and not protected and content <> '') or len(own) > 0""")
def _(t):
    rows = slices(t).withColumn("status", F.when(F.col("id") % 2 == 1, "probation").otherwise("verified"))
    return Q.prune_plan(rows, NOW, 60).select("id", F.array_join("reasons", ",").alias("reasons"), F.coalesce("retained", F.lit(-1)).alias("retained"))


_PROTECTED = f"""{SLICES}, p as (select *, case when id % 23 = 0 then 'odd' else kind end k2, case id % 6 when 0 then 'user-curated' when 1 then 'import' when 2 then 'elsewhere' when 3 then 'session-auto' else '' end origin, case when id % 29 = 0 then 'verified' when id % 31 = 0 then 'lost' when id % 2 = 0 then 'probation' else '' end status, id % 37 = 0 useful from s),
pr as (select id, k2 = 'odd' or created <= 0 or created >= {NOW} - 30 * 86400 or last_used >= {NOW} - 30 * 86400 or ((hits > 0 or injected > 0) and last_used = 0) or origin in ('user-curated', 'elsewhere') or feedback > 0 or useful or status in ('verified', 'lost') protected from p)"""


@query("prune_protected", f"with {_PROTECTED} select id, protected from pr")
def _(t):
    """The whole rule of what pruning leaves alone."""
    i = F.col("id")
    origin = F.element_at(F.array(*map(F.lit, ("user-curated", "import", "elsewhere", "session-auto", "", ""))), (i % 6 + 1).cast("int"))
    status = F.when(i % 29 == 0, "verified").when(i % 31 == 0, "lost").when(i % 2 == 0, "probation").otherwise("")
    rows = slices(t).withColumn("kind", F.when(i % 23 == 0, "odd").otherwise(F.col("kind"))).withColumn("origin", origin).withColumn("result_status", status).withColumn("useful", (i % 37 == 0).cast("int"))
    return rows.select("id", Q.protected(NOW, 30).alias("protected"))


@query("exact_duplicates", "select sha256(coalesce(text, '')) content_sha256, count(*) n, min(doc_id) keep_id from documents group by coalesce(text, '') having count(*) > 1")
def _(t):
    return t("documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id")).filter("n > 1")


@query("stats_merge", f"with {SLICES}, d as (select user_id id, count(*) h, sum((event_type = 'error')::int) r, max(floor(value))::bigint lu from events group by user_id) select id, (hits + coalesce(h, 0))::bigint hits, (rejected + coalesce(r, 0))::bigint rejected, greatest(last_used, coalesce(lu, 0))::bigint last_used from s left join d using (id)")
def _(t):
    d = t("events").select(F.col("user_id").alias("id"), F.lit(1).alias("hits"), (F.col("event_type") == "error").cast("long").alias("rejected"), F.floor("value").cast("long").alias("last_used"))
    return Q.merge_stats(slices(t), d, ("hits", "rejected")).select("id", "hits", "rejected", "last_used")


@query("store_replay", "with b as (select p_partkey id, p_name v, -1 seq, 'put' op from part), j as (select event_id % 500 id, event_type v, event_id seq, case when event_type = 'error' then 'del' else 'put' end op from events), u as (select * from b union all select * from j), l as (select id, arg_max(v, seq) v, arg_max(op, seq) op from u group by id) select id, v from l where op = 'put'")
def _(t):
    """A base and a journal of puts and deletes."""
    base = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("v"))
    j = t("events").select((F.col("event_id") % 500).alias("id"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"))
    return Q.upsert(base, j)


@query("missing_sweep", "with k as (select doc_id id, case when doc_id % 6 = 0 then 1000 - doc_id % 500 else 0 end m from documents), s as (select distinct doc_id id from labels), x as (select id, case when s.id is not null then 0 when m > 0 then m else 1000 end missing_since from k left join s using (id)) select id, missing_since::bigint missing_since from x where missing_since = 0 or missing_since > 1000 - 300")
def _(t):
    i = F.col("doc_id")
    known = t("documents").select(i.alias("id"), F.when(i % 6 == 0, 1000 - i % 500).otherwise(0).alias("missing_since"))
    return Q.swept(known, t("labels").select(i.alias("id")), 1000, 300)


@query("dependency_freshness", "with d as (select l_orderkey id, 'f' || l_partkey path, sha256('v' || l_partkey) sha from lineitem), f as (select 'f' || p_partkey path, sha256(case when p_partkey % 50 = 0 then 'w' else 'v' end || p_partkey) sha, p_partkey % 97 = 0 is_link from part where p_partkey % 101 <> 0) select distinct id from d left join f using (path) where f.sha is null or is_link or f.sha <> d.sha")
def _(t):
    n = F.col("l_partkey").cast("string")
    deps = t("lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), n).alias("path"), F.sha2(F.concat(F.lit("v"), n), 256).alias("sha256"))
    p = F.col("p_partkey")
    files = t("part").filter(p % 101 != 0).select(F.concat(F.lit("f"), p.cast("string")).alias("path"), F.sha2(F.concat(F.when(p % 50 == 0, "w").otherwise("v"), p.cast("string")), 256).alias("sha256"), (p % 97 == 0).alias("is_link"))
    return Q.stale_ids(deps, files)


@query("rejection_blacklist", "select user_id id, count(*) n from events where event_type = 'error' and epoch(ts)::bigint >= 1706000000 - 800000 group by user_id having count(*) >= 3")
def _(t):
    rej = t("events").filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"))
    return Q.blacklisted(rej, 1_706_000_000, 800_000, 3)


@query("promotions", "with r as (select user_id id from events where event_type = 'error' group by 1 having count(*) >= 15), p as (select event_id, user_id id, epoch(date_trunc('second', ts))::bigint at_s from events where event_type = 'purchase') select event_id, id from p where at_s >= 1706500000 - 1000000 and id not in (select id from r)")
def _(t):
    at = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    e = t("events").select("event_id", F.col("user_id").alias("id"), "event_type", at.alias("at"))
    rejected = Q.blacklisted(e.filter("event_type = 'error'"), 1 << 40, 1 << 41, 15)
    return Q.promoted(e.filter("event_type = 'purchase'"), rejected, 1_706_500_000, 1_000_000).select("event_id", "id")


@query("trust_upgrade", "with o as (select doc_id id, case doc_id % 4 when 0 then 'import' when 1 then 'session-auto' when 2 then 'user-curated' else 'prefetch' end origin, case when doc_id % 3 = 0 then 'user-curated' else 'session-auto' end new from documents), l as (select *, case origin when 'user-curated' then 3 when 'import' then 1 else 2 end a, case new when 'user-curated' then 3 else 2 end b from o) select id, b > a upgraded, case when b > a then new else origin end origin from l")
def _(t):
    i = F.col("doc_id")
    origin = F.element_at(F.array(*map(F.lit, ("import", "session-auto", "user-curated", "prefetch"))), (i % 4 + 1).cast("int"))
    return Q.trust_upgrade(t("documents").select(i.alias("id"), origin.alias("origin")), F.when(F.col("id") % 3 == 0, "user-curated").otherwise("session-auto"))


@query("shadowed_facts", "with p as (select 'name:' || lower(s_name) k from supplier where s_suppkey % 2 = 0), g as (select s_suppkey + 1000000 id, s_name name from supplier) select id from g where 'name:' || lower(name) not in (select k from p)")
def _(t):
    s = t("supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"))
    return Q.shadowed(s.filter("(id - 1000000) % 2 = 0"), s, ["name"]).select("id")


@query("commit_freshness", "select doc_id, case when doc_id % 5 = 0 then 'commit_unknown' when doc_id % 5 < 3 then 'stale_commit' else 'same' end reason from documents")
def _(t):
    i = F.col("doc_id")
    commit = F.when(i % 5 == 0, "").when(i % 5 < 3, "old").otherwise("new")
    return t("documents").select("doc_id", F.coalesce(Q.commit_reason(commit, F.lit("new")), F.lit("same")).alias("reason"))


@query("first_facts", "with f as (select p_partkey id, lower(p_name) a, p_type b from part), w as (select *, min(id) over (partition by a) x, min(id) over (partition by lower(b), id // 40) y from f) select id from w where id = x and id = y")
def _(t):
    """Of parts of one name, or of one type among forty neighbours, the first stays."""
    b = F.concat_ws("/", "p_type", F.floor(F.col("p_partkey") / 40).cast("string"))
    return Q.first_facts(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), b.alias("subject")), ["name", "subject"]).select("id")


@query("redact_counts", r"""with r as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9]{20,}', '[REDACTED_KEY]', 'g'), 'AKIA[0-9A-Z]{16}', '[REDACTED_KEY]', 'g'), 'ghp_[A-Za-z0-9]{36}', '[REDACTED_KEY]', 'g'), 'xox[baprs]-[A-Za-z0-9-]{10,}', '[REDACTED_KEY]', 'g'), '(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g'), '(?:/home|/Users)/[A-Za-z0-9_.\-]+', '[REDACTED_PATH]', 'g'), '(?i)C:\\Users\\[A-Za-z0-9_.\-]+', '[REDACTED_PATH]', 'g') x from documents)
select doc_id, (length(x) - length(text))::bigint grown, len(regexp_extract_all(x, '\[REDACTED_EMAIL\]'))::bigint n_email, sha256(x) text_sha256 from r where x <> text""")
def _(t):
    r = t("documents").withColumn("x", text.redacted(F.col("text"))).filter("x <> text")
    return r.select("doc_id", (F.length("x") - F.length("text")).cast("long").alias("grown"), F.regexp_count("x", F.lit(r"\[REDACTED_EMAIL\]")).cast("long").alias("n_email"), F.sha2("x", 256).alias("text_sha256"))


def _task_sql() -> str:
    def one(k: str) -> str:
        w = lambda c: c.isascii() and (c.isalnum() or c == "_")
        return f"regexp_matches(x, '{'(^|[^a-z0-9_])' if w(k[0]) else ''}{k}{'($|[^a-z0-9_])' if w(k[-1]) else ''}')"

    return " ".join(f"when {' or '.join(map(one, keys))} then '{kind}'" for kind, keys in text.TASK_KEYS)


@query("classify_task", f"with l as (select conv_id, turn, lower(text) x from conversations) select conv_id, turn, case {_task_sql()} else 'general' end kind from l")
def _(t):
    return t("conversations").select("conv_id", "turn", text.task_kind(F.col("text")).alias("kind"))


@query("admission_scope", f"with {SLICES} select id, kind, case when id % 3 = 2 and kind in ('tool_pattern', 'result') then 'project' when id % 3 = 2 then 'user' when id % 3 = 1 then 'project' else 'session' end scope from s")
def _(t):
    """Tool patterns and results aren't admitted to the user's scope; they stay in the project's."""
    scope = F.element_at(F.array(*map(F.lit, ("session", "project", "user"))), (F.col("id") % 3 + 1).cast("int"))
    return slices(t).select("id", "kind", F.when((scope == "user") & F.col("kind").isin("tool_pattern", "result"), "project").otherwise(scope).alias("scope"))


@query("freshness", f"with {SLICES}, f as (select id, created, {NOW} - created age, (id % 4) * 1000000 ttl from s) select id, case when ttl <= 0 then 'hit' when created <= 0 or age < 0 or age > ttl then 'miss' when age > ttl // 2 then 'grey' else 'hit' end zone from f")
def _(t):
    return slices(t).select("id", scores.freshness(F.col("created"), F.lit(NOW), (F.col("id") % 4) * 1_000_000).alias("zone"))
