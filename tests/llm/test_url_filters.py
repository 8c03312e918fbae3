import random
import re

import pytest
from pyspark.sql import functions as F

from granary.llm import entry
from granary.llm.url_filters import BloomCascade, judge_urls


def brute(url, rules=entry.URL_RULES, hosts=entry.BLOCKED_HOSTS):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fit = []
    for rule in rules:
        at = rule.index("/")
        if ("." + host).endswith("." + rule[:at]) and path.startswith(rule[at:]):
            fit.append((len(rule), rule))
    rule = max(fit)[1] if fit else None
    verdict = rules[rule] if rule else "block" if any(("." + host).endswith("." + h) for h in hosts) else "allow"
    return host, path, rule, verdict


ODD = [
    None, "", "no url", "://", "http://", "http://ORG/", "http://org", "http://example.org/es/x", "http://example.org/es", "http://a.b.EXAMPLE.org/en/1?x=/es/", "http://xexample.org/en/1", "https://x.com/fr/#", "https://com/de/", "http://com./de/",
    "http://a..org/", "http://x.org?/es/", "http://u@example.org:80/es/", "ftp://www.casino-win.example.com/fr/1", "http://casino-win.example.com", "http://not-casino-win.example.com/x", "http://ÄÖ.org/é", "http://example.org/en/12", "a://b://example.org/es/", "http://x.org/\n?",
]


#: A cascade as it comes, one of many chunks, and none (semi-joins).
CASCADES = {"plain": {}, "chunks": {"max_words": 2}, "joins": {"max_total": 0}}


@pytest.mark.parametrize("kind", CASCADES)
def test_odd_urls(spark, kind):
    rows = [(i, u, "h", "r", "v") for i, u in enumerate(ODD)] + [(3, ODD[3], "h", "r", "v"), (None, ODD[7], None, None, None), (None, ODD[8], None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, key string")
    judged = judge_urls(df, entry.URL_RULES, entry.BLOCKED_HOSTS, cascade=BloomCascade(**CASCADES[kind]))
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in judged.collect())
    want = sorted((-1 if i is None else i, *(str(x) if k == 2 else x for k, x in enumerate(brute(u)))) for i, u, *_ in rows)
    assert got == want
    assert judge_urls(df.limit(0), entry.URL_RULES, cascade=BloomCascade(**CASCADES[kind])).count() == 0


@pytest.mark.parametrize("kind", CASCADES)
def test_long_lists(spark, kind):
    """Lists of thousands of rules and hosts, as tables: one cascade, many chunks, or joins beyond its bound."""
    rnd = random.Random(2)
    rules = {f"d{rnd.randrange(3000)}.net/{'ab'[: rnd.randrange(3)]}": rnd.choice(["allow", "block"]) for _ in range(3000)}
    hosts = [f"h{i}.net" for i in rnd.sample(range(4000), 2000)]
    urls = [f"http://{rnd.choice(['', 'www.'])}{rnd.choice('dh')}{rnd.randrange(4000)}.net/{rnd.choice(['', 'a', 'ab', 'abc', 'b'])}" for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    tables = spark.createDataFrame(list(rules.items()), "key string, verdict string"), spark.createDataFrame([(h,) for h in hosts], "key string")
    cascade = BloomCascade(**CASCADES[kind])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(df, *tables, cascade=cascade).collect()}
    assert cascade.fits == (kind != "joins")
    if kind == "chunks":
        assert cascade.filters[0][0].chunks > 100
    listed = set(hosts)
    for i, u in enumerate(urls):
        host = u.split("/")[2]
        own = {k: v for k, v in rules.items() if k.split("/")[0] in (host, host.removeprefix("www."))}
        near = [h for h in (host, host.removeprefix("www.")) if h in listed]
        assert got[i] == brute(u, own, near)[2:]


@pytest.mark.parametrize("max_words", [1 << 16, 4])
def test_cascade_is_exact(spark, max_words):
    rnd = random.Random(1)
    universe = [f"k{i}" for i in range(4000)]
    listed = rnd.sample(universe, 1300)
    asked = spark.createDataFrame([(k, 1) for k in universe] + [(None, 1)], "key string, bits int")
    keys = spark.createDataFrame([(k,) for k in listed + listed[:9]] + [(None,)], "key string")
    cascade = BloomCascade(bits_per_key=2, max_words=max_words).build(keys, asked.select("key"))
    assert len(cascade.levels) > 2
    assert sorted(r["key"] for r in cascade.filter_members(asked).collect()) == sorted(listed)
    beyond = BloomCascade(max_total=1).build(keys, asked.select("key"))
    assert not beyond.fits and sorted(r["key"] for r in beyond.filter_members(asked).collect()) == sorted(listed)
    assert BloomCascade().build(keys.limit(0), asked.select("key")).filter_members(asked).count() == 0


def test_level_0_follows_the_universe(spark):
    keys = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = BloomCascade().build(keys, spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key")))
    assert len(cascade.levels) > 1 and cascade.filters[1][0].words * 64 < 8 * 500  # far fewer than 200,000 wrong keys pass


def test_lookup_is_native(spark, small):
    plan = entry.op6_url_filters(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
