from repeatlens.llm import url_filter as U
from tests.llm.helpers import table, with_clashes


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:n], rest[n:]
    m = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:m]


def brute(url, rules):
    host, path = parse(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = ["http://a.example.org/en/157", "https://EXAMPLE.ORG/es/", "http://example.org", "http://org/",
        "http://notexample.org/es/x", "ftp://x.com/fr/?a=/de/", "http://x.com/de/#top", "x.com/de/",
        None, "", "://", "http://x.com?q=1", "http://com/de/", "http://a..com/fr/é", "http://İ.com/fr/",
        "http://u:p@x.com:80/fr/", "http://x.com/en/1", "a://b://c.com/fr/", "http://x\n.com/fr/",
        "http://" + "a." * 3000 + "com/de/" + "z" * 5000, "http://x.com/fr", "http://.org/x"]


def judged(df, rules, spark):
    out = U.judge(df, U.rule_table(spark, rules)).select("page_id", "host", "path", "rule", "verdict")
    return {r.page_id: tuple(r)[1:] for r in out.collect()}


def test_driver_table_and_tricky_urls(spark):
    rows = [(r.page_id, r.url) for r in table(spark, "pages").collect()]
    rows += [(10_000 + i, u) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    assert judged(df, U.RULES, spark) == {i: brute(u, U.RULES) for i, u in rows}


def test_precedence_and_null_rules(spark):
    rules = [("b.com", "/x", "allow"), ("com", "/xyz9", "block"), ("a.b.com", "", "allow"),
             ("b.com", "/x", "block"), ("", "", "block"), ("com", "/x", "allow")]
    urls = ["http://a.b.com/xyz99", "http://b.com/xy", "nothing", "http://b.com/", "http://c.com/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    nulls = rules + [(None, None, "block")]
    assert judged(df, nulls, spark) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_repeated_rows_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, URLS[0]), (1, URLS[0]), (None, URLS[0]), (2, None)],
                               "page_id long, url string")
    clash = with_clashes(df, "host", "rule", "verdict", "digest", "short", "h", "p")
    out = U.judge(clash, U.rule_table(spark))
    assert out.count() == 4 and out.filter("verdict = 'block'").count() == 3
    assert U.judge(df.limit(0), U.rule_table(spark)).collect() == []
    none = U.judge(df, U.rule_table(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}
