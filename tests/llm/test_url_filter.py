from linewell.llm import queries, url_filter
from tests.llm.conftest import rows_of
from tests.oracle_check import compare, duck


def test_oracle(spark, sf):
    got, want, _ = compare(spark, duck(sf), "op6", queries.QUERIES["op6_url_filter"], queries.ORACLES["op6_url_filter"], sf)
    assert got == want


def brute(url):
    host, path = url_filter.split(url)
    fits = [r for r in url_filter.HOST_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    import re
    word = next((w for w in url_filter.BLOCKED_WORDS if re.search(url_filter.word_regex(w), (url or "").translate(url_filter.FOLD))), None)
    return host, path, best and best[0] + best[1], best[2] if best else "block" if word else "allow", word


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x", "https://www.example.com/en/1?q", "http://xwww.example.com/en/", "http://example.com/en", "http://notexample.com/EN/", "http://com/", "http://com", "x://a.net/es/1#f",
        "x://net/fr/", "x://b.net/esp/", "x://b.net?/es/", "http://free-bets.org/", "http://m.casino.example.org/a", "http://casinos.org/", "http://a.org/casino.html", "a://b://c.net/es/", "http://ex\u00c4mple.net/es/", "http://user@h.net:80/es/", "http://a.org/" + "x" * 100_000, "http://a b.com/x", "http:// com/", "http://a\nb.net/es/", "http://" + "a." * 50_000 + "net/fr/", "http://net /es/", "http://x.com /y", "http://com?/", "http://a.net\t/es/"]


def test_urls(spark):
    rows = [(k, u, "<p>") for k, u in enumerate(URLS)] + [(None, "http://a.net/es/", None), (1, "", None), (1, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    assert rows_of(url_filter.judge(pages)) == sorted(((k, *brute(u)) for k, u, _ in rows), key=repr)
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_rules_are_filed_under_the_rarest_token():
    index, always = url_filter.index_rules(url_filter.RULES, {"net": 100, "es": 3, "example": 50, "com": 60, "en": 200, "www": 10})
    assert index["es"] == [3] and 2 in index["www"] and 1 in index["example"] and 0 in index["com"] and not always
    assert url_filter.host_rule("a.b", "/c", "block").tokens == ("a", "b")  # c may go on in a url
    assert url_filter.index_rules((url_filter.Rule("r", "block", "x", (), False),), {}) == ({}, [0])
