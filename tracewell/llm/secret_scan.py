"""Secret scans with DataFrame functions only: patterns, then how widely the corpus owns each candidate.

A candidate's hash is counted over the whole corpus by distinct repositories and owners. What several owners
hold, or many repositories of whatever owner, is a widely copied example; what one owner holds in few repositories
is a live-looking credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash2, split_join, stored, table

# The kinds' patterns, in the order of their names in results.
PATTERNS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{14,}"),
    ("hex", r"[0-9a-f]{16,}"),
)
#: The least length of an assigned value.
LEAST = 12
#: The method's own kind: other long mixed tokens, where they look live.
OWNED = "owned"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: A token with fewer unlike characters isn't random enough to be a credential.
UNLIKE = 10
#: A candidate that so many owners, or so many repositories, hold is an example.
SHARED_OWNERS, SHARED_REPOS = 3, 5


KINDS = (*PATTERNS, (OWNED, TOKEN))


def _matches() -> Column:
    """All kinds' leftmost matches that don't overlap: kind's number, turn, the gap before it, length and body."""
    def kind(k: int) -> Column:
        row = lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("turn"), F.get(f"_g{k}", i).alias("gap"), F.length(x).alias("len"), x.alias("body"))
        return F.transform(f"_m{k}", row)

    return F.concat(*map(kind, range(len(KINDS))))


def _found(docs: DataFrame, text: str, owner: str, repo: str) -> DataFrame:
    """Each row's keys and matches, without its text; one pass over the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = hash2(*[x for c in (repo, owner) for x in (F.col(c).isNull(), F.col(c))], body)
    rows = docs.select(F.col("doc_id"), F.col(owner).alias("_owner"), F.col(repo).alias("_repo"), k1.alias("_k1"), k2.alias("_k2"), body.alias("_text"))
    rows = rows.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m{k}") for k, (_, p) in enumerate(KINDS)])
    gaps = [F.when(F.size(f"_m{k}") > 0, F.transform(F.split("_text", p, -1), lambda g: F.length(g))).alias(f"_g{k}") for k, (_, p) in enumerate(KINDS)]
    rows = rows.select("*", *gaps)
    return rows.select("doc_id", "_owner", "_repo", "_k1", "_k2", _matches().alias("_found"))


def _candidates(found: DataFrame) -> DataFrame:
    """One row a candidate with its place and the hash of its value; matches that fail are dropped."""
    once = found.filter(F.size("_found") > 0).dropDuplicates(["_k1", "_k2"])
    rows = once.select("_k1", "_k2", "_owner", "_repo", F.inline("_found"))
    # Matches and the gaps between them take turns, so places are running sums of their lengths.
    upto = Window.partitionBy("_k1", "_k2", "kind").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("body", PATTERNS[0][1], 2)).otherwise(F.col("body"))
    rows = rows.withColumn("value", value)
    unlike = F.size(F.array_distinct(F.split("value", "")))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (unlike >= UNLIKE)
    fits = F.when(F.col("kind") == 0, F.length("value") >= LEAST).when(F.col("kind") == len(PATTERNS), mixed).otherwise(F.lit(True))
    h1, h2 = hash2(F.col("value"))
    return rows.filter(fits).select("_k1", "_k2", "_owner", "_repo", "kind", "start", "end", h1.alias("_h1"), h2.alias("_h2"))


def _ownership(candidates: DataFrame) -> DataFrame:
    """Candidates of each hash and its distinct owners and repositories, counted over the corpus in steps."""
    keys = ["_h1", "_h2"]
    pairs = candidates.groupBy(*keys, "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy(*keys, "_owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_repos"))
    return owners.groupBy(*keys).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"))


def secret_scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id and its spans.

    spans is an array of (start, kind number, kind, end, n_owners, n_repos, live), by start, then kind.
    Base kinds' spans are all there; live tells whether fewer than SHARED_OWNERS owners, in fewer than SHARED_REPOS
    repositories, hold the value. Kind "owned" adds live mixed tokens of 20 characters or more, UNLIKE of them unlike.
    A hash that a hot share of all candidates has is joined by broadcast. A null text counts as empty;
    null owners count as one owner, an owner's null repositories as one. Repeated rows each get the same spans.
    """
    found = stored(_found(docs, text, owner, repo))
    candidates = stored(_candidates(found))
    owned = stored(_ownership(candidates))
    met = split_join(candidates.select("_k1", "_k2", "kind", "start", "end", "_h1", "_h2"), owned, ["_h1", "_h2"], "_n", candidates.count())
    rows = met.withColumn("live", (F.col("n_owners") < SHARED_OWNERS) & (F.col("n_repos") < SHARED_REPOS)).filter((F.col("kind") < len(PATTERNS)) | F.col("live"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in KINDS]), F.col("kind") + 1)
    spans = rows.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("k"), name.alias("kind"), "end", "n_owners", "n_repos", "live"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint,n_owners:bigint,n_repos:bigint,live:boolean>>")
    return found.select("doc_id", "_k1", "_k2").join(spans, ["_k1", "_k2"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _of(k: int):
    return lambda span: span["k"] == k


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["k"] < len(PATTERNS))
    return out.select(
        "doc_id",
        *[count(_of(k)).alias(f"n_{n}") for k, (n, _) in enumerate(PATTERNS)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repos"])), F.lit(0)).cast("long").alias("most_repos"),
    )


def _sql_kind(k: int, name: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract(body, '{p}', 2)" if k == 0 else "body"
    test = f"length(value) >= {LEAST}" if k == 0 else f"regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= {UNLIKE}" if name == OWNED else "true"
    return f"""select doc_id, source, {k} k, '{name}' kind, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[: i - 1], lambda x: length(x))), 0) a, length(body) n, value
      from (select *, {value} as value from (select *, m[i] body from (select *, unnest(range(1, len(m) + 1)) i from (select doc_id, source, regexp_extract_all(t, '{p}') m, string_split_regex(t, '{p}') g from d)))) where {test}"""


SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
c as ({" union all ".join(_sql_kind(k, n, p) for k, (n, p) in enumerate(KINDS))}),
o as (select value, count(distinct coalesce(source, chr(0))) n_owners, count(distinct (coalesce(source, chr(0)), doc_id)) n_repos from c group by value),
r as (select *, n_owners < {SHARED_OWNERS} and n_repos < {SHARED_REPOS} live, kind || ':' || a::bigint || ':' || (a + n)::bigint x from c join o using (value) where k < {len(PATTERNS)} or (n_owners < {SHARED_OWNERS} and n_repos < {SHARED_REPOS})),
s as (select doc_id, {", ".join(f"count(*) filter (k = {k})::bigint n_{n}" for k, (n, _) in enumerate(PATTERNS))},
        coalesce(string_agg(x, ',' order by a, k) filter (k < {len(PATTERNS)}), '') base, string_agg(x, ',' order by a, k) spans,
        count(*) filter (live)::bigint n_live, count(*) filter (not live)::bigint n_example, max(n_owners)::bigint most_owners, max(n_repos)::bigint most_repos from r group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{n}, 0) n_{n}" for n, _ in PATTERNS)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example, coalesce(most_owners, 0) most_owners, coalesce(most_repos, 0) most_repos
from d left join s using (doc_id)
"""
