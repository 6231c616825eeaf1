import pytest

from tracewell.llm import url_filter as u

BLOCKED = tuple(f"{name}.example.{top}" for name in ("spam-farm", "free-bets", "ads") for top in ("com", "net", "org"))
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/", "https://example.com/en", "https://a.example.com/en/x?y=/es/", "https://x.net/es/1", "https://net/fr/#a",
    "http://examplexcom/en/", "http://notexample.com/en/7", "ftp://spam-farm.example.org", "http://www.spam-farm.example.net/en/1", "http://spam-farm.example.com/de/", "x://com/", "x://com", "x://a..com/", "http://É.com/",
    "http://h.org/a://b/c", "http://www.example.com:80/en/", "http://.com/en/",
]


def by_hand(url, blocked=BLOCKED):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0] if rest[cut : cut + 1] == "/" else ""
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    bad = any(host == b or host.endswith("." + b) for b in blocked)
    return host, path, best.host + best.path if best else None, best.verdict if best else "block" if bad else "allow"


@pytest.mark.parametrize("shard", [u.SHARD_KEYS, 3])
def test_verdicts(spark, monkeypatch, shard):
    monkeypatch.setattr(u, "SHARD_KEYS", shard)
    pages = spark.createDataFrame([(i, x, "old") for i, x in enumerate(URLS)] + [(0, URLS[4], "twice")], "page_id long, url string, rule string")
    blocked = spark.createDataFrame([(h,) for h in BLOCKED] + [(None,)], "host string")
    got = u.url_filter(pages, u.RULES, blocked).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(r.url), r.url


def test_cascade_is_exact_over_its_universe(spark):
    import numpy as np

    keys = spark.range(6000).selectExpr("xxhash64(id) h1", "xxhash64(7, id) h2", "id % 3 = 0 l")
    levels = u.cascade(keys.filter("l"), keys.filter("not l"))
    rows = keys.collect()
    found = u.member(levels, *(np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (0, 1)))
    assert len(levels) > 1 and found.tolist() == [r.l for r in rows]


def test_equal_keys_of_both_kinds_are_told(spark, monkeypatch):
    monkeypatch.setattr(u, "MOST_LEVELS", 8)
    keys = spark.range(3).selectExpr("1L h1", "2L h2")
    with pytest.raises(ValueError):
        u.cascade(keys, keys)


def test_nothing_listed_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    (r,) = u.url_filter(pages, ()).collect()
    assert (r.rule, r.verdict) == (None, "allow")
    assert u.url_filter(pages.limit(0)).count() == 0


def test_listed_hosts_come_from_the_table(spark):
    urls = ["http://a.org/x?q", "http://a.org/y", "http://b.org/x", "http://B.org/z?1", "http://b.org/y", "no ? scheme", None]
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string")
    assert [r.host for r in u.tracking_hosts(pages).collect()] == ["a.org"]
