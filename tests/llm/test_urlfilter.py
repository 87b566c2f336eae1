import re

from profuse.llm import queries, urlfilter

from .conftest import SF


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, rule in urlfilter.RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    count = lambda terms: [len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", (url or "").lower())) for t in terms]
    strict, soft = sum(count(urlfilter.STRICT)), sum(n > 0 for n in count(urlfilter.SOFT))
    verdict = best[1] if best else "block" if strict or soft >= 2 else "allow"
    return host, path, best[0] if best else None, verdict, strict, soft


URLS = [
    None, "", "no scheme free-bets", "http://A.Example.NET/en/x", "http://net/en", "http://x.net", "http://x.net?q=/", "http://notexample.net/en/",
    "http://example.com/de", "http://www.example.com/de/1#f", "http://fr.org/fr/", "https://a.b.org/FR/", "http://casino.com/", "http://casinos.com/",
    "http://free.com/free/free", "http://free.com/win", "http://x.com/?ads=1#track", "a://b://c/d", "http://[::1]:80/xxx", "http://üfree.com/bets", "http://u@H:8/p\nq?x",
]


def test_urls(spark):
    frame = spark.createDataFrame([(k, u, 1, "x") for k, u in enumerate(URLS)] + [(None, URLS[3], 2, "y")], "page_id long, url string, rule int, hits string")
    got = sorted((tuple(r) for r in urlfilter.judge(frame).collect()), key=str)
    assert got == sorted(((k, *brute(u)) for k, u, *_ in frame.collect()), key=str)
    assert urlfilter.judge(frame.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    assert sorted(map(tuple, queries.op10_url_terms(spark, SF).collect())) == sorted((p, *brute(u)) for p, u in pages)
