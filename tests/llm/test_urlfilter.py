import random
import re

import pytest

from lexquarry.llm import urlfilter as U


def brute(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(a, r) for a, r in rules if under(r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    rule = min(fits, key=lambda x: (-len(x[1]), x[1])) if fits else None
    verdict = rule[0] if rule else "block" if any(map(under, blocked)) else "allow"
    return host, path, rule[1] if rule else None, verdict


BLOCKED = ["casino-win.example.net", "b.a.com"]


@pytest.mark.parametrize("group_bytes", [U.GROUP_BYTES, 300])
def test_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(U, "GROUP_BYTES", group_bytes)
    rng = random.Random(3)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "notexample.org", "x.com", "com", "org", "m.casino-win.example.net", "casino-win.example.net", "É.example.org", "u@x.com:80", "a..com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/?q=/de/", "/de/#x", "?x://y", "#f", "/de/é", "/DE/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/de/"]
    urls += ["https://" + ".".join(rng.choices("ab", k=30)) + ".com/de/" + "x" * 5000, urls[0]]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = U.judge(pages, U.RULES, BLOCKED)
    got = {r[0]: tuple(r)[3:] for r in out.collect()}
    assert out.columns[:3] == ["page_id", "url", "rule"]
    assert got == {i: brute(u, U.RULES, BLOCKED) for i, u in enumerate(urls)}
    assert U.judge(pages.where("false"), U.RULES, BLOCKED).count() == 0


def test_colliding_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda d: len(d))
    U.DigestArray.write(["aa/", "bb/", "c/"], str(tmp_path), "r")
    found = U.DigestArray(str(tmp_path), "r")
    assert [found.string(i).decode() if i >= 0 else None for i in found.find([b"bb/", b"dd/", b"aa/", b"c/"])] == ["bb/", None, "aa/", "c/"]


def test_long_lists(spark):
    """A hundred thousand rules, most of which fit nothing."""
    rules = spark.range(100_000).selectExpr("concat('host', id, '.example.com') as rule")
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://www.host', id * 97, '.example.com/a') as url")
    out = U.judge(pages, [], rules).where("verdict = 'block'")
    assert {r["page_id"] for r in out.collect()} == {i for i in range(3000) if i * 97 < 100_000}


def test_hosts_that_name_themselves(spark):
    urls = ["http://www.Casino-win.example.org/x", "https://m.free-bets.a.b.c", "http://adsorb.com", "http://x.ads.com/", "http://spam", "http://a-spam-b.c.xxx.net", None, "spam.com"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0] for r in U.blocked_hosts(pages).collect()} == {"casino-win.example.org", "free-bets.a.b.c", "ads.com", "a-spam-b.c.xxx.net"}


def broadcast_rows(plan):
    """Of each broadcast in a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    return own + [n for i in range(plan.children().size()) for n in broadcast_rows(plan.children().apply(i))]


@pytest.mark.parametrize("sent_bytes", [U.SENT_BYTES, 0])
def test_no_urls_pass_through_the_driver(spark, monkeypatch, sent_bytes):
    """The strings of the urls that could be rules come from a small file, but are many."""
    monkeypatch.setattr(U, "SENT_BYTES", sent_bytes)
    key, n = "spark.sql.autoBroadcastJoinThreshold", 20_000
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        pages = spark.range(n).selectExpr("id as page_id", "concat('http://www.', if(id % 3 = 0, 'casino.', 'm.'), if(id % 2 = 0, 'com', 'example.org'), if(id % 5 = 0, '/de/', '/en/'), id) as url")
        out = U.judge(pages, U.RULES, U.blocked_hosts(pages))
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
        sent = broadcast_rows(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(key, before)
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert got == {i: brute(u, U.RULES, ["casino.com", "casino.example.org"]) for i, u in urls.items()}
    assert max(sent, default=0) < 100 and len(sent) == (sent_bytes > 0)
